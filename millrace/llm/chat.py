"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Chat services log a conversation again after every turn, so that a log holds many prefixes of one conversation. The
rolling hash of a conversation's turns (position, role and text, combined by xor, so that it rolls along a window)
names each of its prefixes. A conversation whose whole is a proper prefix of another is a snapshot; an anti-join
against the distinct prefixes removes those. Of conversations that are equal as a whole, the one with the smallest id
stays. What is left is maximal and is rendered, turn by turn, with role tags.

Prefixes are compared by two independent 64-bit hashes and their length. Only hashes are joined, never texts; prefixes
are made distinct before the join, so a first turn that many conversations share is one row there.

Defined results: turns are ordered by ``turn``, then role and text (null turns first; ties and repeated rows count as turns of
their own); a null role renders as ``unknown`` and a null text as the empty text, and both compare as such; rows with a
null conv_id form one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common




def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n (1, 2, ... within the conversation), role and text; nulls replaced."""
    chosen = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return chosen.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))


def prefixes(conversations: DataFrame) -> DataFrame:
    """A row per turn: conv_id, n, and the rolling hashes a and b of the first n turns; total is the number of turns."""
    along = W.partitionBy("conv_id").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    rolled = _turns(conversations).select(
        "conv_id",
        "n",
        F.bit_xor(F.xxhash64("n", "role", "text")).over(along).alias("a"),
        F.bit_xor(F.xxhash64(F.lit("b"), "n", "text", "role")).over(along).alias("b"),
    )
    return rolled.withColumn("total", F.max("n").over(W.partitionBy("conv_id")))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_snapshots (collapsed equal conversations) of the conversations that stay."""
    rows = common.materialize(prefixes(conversations), "chat-prefixes")
    whole = rows.where("n = total").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    proper = rows.where("n < total").select("n", "a", "b").distinct()
    kept = whole.join(proper, ["n", "a", "b"], "left_anti")
    return kept.select("conv_id", F.col("n").cast("long").alias("n_turns"), F.col("n_equal").cast("long").alias("n_equal"))


def render(conversations: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal and the rendered text of the conversations in ``kept``."""
    tagged = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    right = kept.withColumnRenamed("conv_id", "__id")
    turns = _turns(conversations).join(right, F.col("conv_id").eqNullSafe(F.col("__id")))
    # A group is one conversation, never the many that share a turn.
    grouped = turns.groupBy("conv_id", "n_turns", "n_equal").agg(F.sort_array(F.collect_list(F.struct(F.col("n"), tagged.alias("t")))).alias("turns"))
    return grouped.select("conv_id", "n_turns", "n_equal", F.array_join(F.transform("turns", lambda x: x["t"]), "").alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    return render(conversations, common.materialize(maximal(conversations), "chat-kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(common.table(spark, sf_dir, "conversations"))


#: The same result for DuckDB, by comparing the texts of the prefixes.
SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS n,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS s
  FROM conversations
), p AS (
  SELECT conv_id, n, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY n) AS prefix, max(n) OVER (PARTITION BY conv_id) AS total FROM t
), w AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*)::BIGINT AS n_equal, prefix AS rendered FROM p WHERE n = total GROUP BY n, prefix)
SELECT conv_id, n_turns::BIGINT AS n_turns, n_equal, rendered FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.total AND p.n = w.n_turns AND p.prefix = w.rendered)
"""
