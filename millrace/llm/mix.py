"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's share of all words, stopped at ``CAP`` times what it has; the excess goes to the
others by weight until none is above its stop. That is the level L with sum(min(cap, weight * L)) = total, which one
ordered pass over the table of sources finds. Every document of a source then expects target / source size copies.
Within a source, ordered by size, prefix sums of the expected copies plus one offset are taken; a document is emitted
once per integer boundary that its step crosses. Ordering by size keeps the words taken within about one document of
the target. The offset is a hash of seed and source, so reruns agree.

Prefix sums are ranks times a constant, and ranks are built from counts: by (source, size), then by (source, size,
one of 256 buckets of the id's hash), then by id and text inside a bucket. No task ever holds a whole source, nor a whole
group of one size; rows that repeat in id and text are one counted row until the end.

Defined results: null and empty texts have size 0 (and so add no words); the null source is a source, ordered last; a
source without words has target 0 and is not taken; repeated rows count each, and share their group's copies out among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

CAP = 3
SEED = "mix-1"
#: Rows alike that one task unrolls at a time.
PIECE = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, a hash of the text (key) and its number of words, for every row."""
    size = F.size(common.words(F.col("text").cast("string"))).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), _key().alias("key"), size.alias("size"))


def _key() -> Column:
    return F.xxhash64(F.col("text"), F.col("text").isNull())


def targets(rows: DataFrame) -> DataFrame:
    """A row per source: source, source_size, target, ratio (expected copies of each document) and offset.

    The windows without partitions are over this table of sources, one row each.
    """
    totals = common.materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long")).withColumn("cap", CAP * F.col("source_size"))
    # Sources reach their stop in the order of cap per weight; before each, what is left and the weight that shares it.
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = weighed.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("shares"),
    ).withColumn("open", F.col("left").cast("decimal(28,0)") * F.col("weight") < F.col("cap").cast("decimal(28,0)") * F.col("shares"))
    # From the first source that stays below its stop on, all do, at its level.
    first = F.min_by(F.struct("left", "shares"), F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"))).over(whole)
    found = level.withColumn("at", first)
    share = (F.col("at.left") * F.col("weight")).cast("double") / F.col("at.shares").cast("double")
    # The order of cap per weight decides by doubles only between sources whose levels are equal to the last digit.
    target = F.when(F.col("at").isNull() | (F.col("cap").cast("double") <= share), F.col("cap").cast("double")).otherwise(share)
    offset = F.conv(F.substring(F.md5(F.when(F.col("source").isNull(), F.lit(SEED)).otherwise(F.concat(F.lit(SEED + ":"), "source")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    return found.withColumn("target", target).select("source", "source_size", "target", ratio.alias("ratio"), offset.alias("offset"))


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on ``keys``, null meeting null."""
    right = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    return left.join(right, on, "inner").drop(*[f"r_{k}" for k in keys])


def placed(rows: DataFrame) -> DataFrame:
    """A row for all rows alike in source, size, doc_id and key: how many they are (n) and the rank of the first of them.

    Ranks are 0, 1, ... within the source by (size, bucket, doc_id, key), from counts at four levels.
    """
    named = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bucket = F.conv(F.substring(named, 1, 2), 16, 10).cast("int")
    alike = rows.groupBy("source", "size", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket)
    fine = alike.groupBy("source", "size", "bucket").agg(F.sum("n").alias("m"))
    coarse = fine.groupBy("source", "size").agg(F.sum("m").alias("m"))
    # The sizes of one source: as many rows as it has different sizes, not documents.
    over_sizes = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    coarse = coarse.select("source", "size", F.coalesce(F.sum("m").over(over_sizes), F.lit(0)).alias("below"))
    over_buckets = W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    fine = fine.select("source", "size", "bucket", F.coalesce(F.sum("m").over(over_buckets), F.lit(0)).alias("beside"))
    inside = W.partitionBy("source", "size", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "key").rowsBetween(W.unboundedPreceding, -1)
    numbered = alike.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    out = _met(_met(numbered, fine, ["source", "size", "bucket"]), coarse, ["source", "size"])
    return out.select("source", "size", "doc_id", "key", "n", (F.col("below") + F.col("beside") + F.col("inside")).alias("first"))


def _goals(docs: DataFrame) -> DataFrame:
    """:func:`placed` with source_size, target, ratio and offset."""
    rows = common.materialize(sized(docs), "mix-sizes")
    return _met(placed(rows), targets(rows), ["source"])


def _copies(rank: Column, ratio: str = "ratio", offset: str = "offset") -> Column:
    """Integer boundaries that the step of the document at ``rank`` crosses."""
    step = lambda k: F.floor(F.col(ratio) * k.cast("double") + F.col(offset))
    return F.least(F.lit(CAP), step(rank + 1) - step(rank)).cast("long")


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and copies for every row of ``docs``."""
    goals = common.materialize(_goals(docs), "mix-goals")
    # Rows alike are unrolled again; many of them in pieces, so that no task unrolls a large group alone.
    few = goals.where(F.col("n") <= PIECE).withColumn("piece", F.lit(0).cast("long"))
    many = goals.where(F.col("n") > PIECE).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long")))).repartition("doc_id", "key", "piece")
    rows = few.unionByName(many).withColumn("i", F.explode(F.sequence("piece", F.least(F.col("piece") + PIECE, F.col("n")) - 1)))
    return rows.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("first") + F.col("i")).alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` once per copy, with ``copy_no`` from 1 on, and its source's target.

    Rows meet their place by id, source and a hash of the text; the texts are shuffled once. ``copy_no`` and ``target_words``
    are added unless ``docs`` has columns of these names; no column of ``docs`` is lost or changed.
    """
    goals = common.materialize(_goals(docs), "mix-goals").select("doc_id", "source", "key", "n", "first", "target", "ratio", "offset")
    at = [common.unused(docs, f"__mix_{k}") for k in ("doc_id", "source", "key")]
    rest = ("n", "first", "target", "ratio", "offset")
    name = {c: common.unused(docs, f"__mix_{c}") for c in (*rest, "part", "i", "copy")}
    keyed = docs.withColumns({at[1]: F.col("source").cast("string"), at[2]: _key()})

    def placed_in(goals: DataFrame, rows: DataFrame, *, counted: int | None = None) -> DataFrame:
        ids = common.unused(docs, "__mix_id"), common.unused(docs, "__mix_of"), common.unused(docs, "__mix_hash")
        right = goals.select(F.col("doc_id").alias(ids[0]), F.col("source").alias(ids[1]), F.col("key").alias(ids[2]), *[F.col(c).alias(name[c]) for c in rest])
        right = right if counted is None else common.small(right, counted)
        return rows.join(right, F.col("doc_id").eqNullSafe(F.col(ids[0])) & F.col(at[1]).eqNullSafe(F.col(ids[1])) & (F.col(at[2]) == F.col(ids[2])))

    def emitted(rows: DataFrame, rank: Column) -> DataFrame:
        n = _copies(rank, name["ratio"], name["offset"])
        out = rows.where(n > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias(name["copy"]))
        added = {"copy_no": F.col(name["copy"]), "target_words": F.col(name["target"])}
        return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[added[c].alias(c) for c in added if c not in docs.columns])

    out = emitted(placed_in(goals.where("n = 1"), keyed), F.col(name["first"]))
    repeated = goals.where("n > 1")
    if groups := repeated.count():
        # Rows that repeat in id, source and text are numbered, in two steps: by the parts they were read in, then inside a part.
        rows = placed_in(repeated, keyed, counted=groups).withColumn(name["part"], F.spark_partition_id())
        rows = common.materialize(rows, "mix-repeated")
        alike = ["doc_id", at[1], at[2]]
        parts = rows.groupBy(*alike, name["part"]).agg(F.count(F.lit(1)).alias("m"))
        parts = parts.withColumn(name["i"], F.coalesce(F.sum("m").over(W.partitionBy(*alike).orderBy(name["part"]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("m")
        rows = _met(rows, parts, [*alike, name["part"]])
        inside = F.row_number().over(W.partitionBy(*alike, name["part"]).orderBy(F.lit(0))) - 1
        rows = rows.withColumn(name["i"], F.col(name["first"]) + F.col(name["i"]) + inside)
        out = out.unionByName(emitted(rows, F.col(name["i"])))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same result for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents
), t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (SELECT source, source_size, 3 * source_size AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM t
), l AS (
  SELECT *, row_number() OVER o AS k,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS remain,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS shares
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)
), a AS (SELECT remain, shares FROM l WHERE remain * weight < cap * shares ORDER BY k LIMIT 1
), g AS (
  SELECT source, source_size, CASE WHEN a.remain IS NULL OR cap::DOUBLE <= (a.remain * weight)::DOUBLE / a.shares::DOUBLE THEN cap::DOUBLE
    ELSE (a.remain * weight)::DOUBLE / a.shares::DOUBLE END AS target,
    ('0x' || substr(md5(CASE WHEN source IS NULL THEN 'mix-1' ELSE 'mix-1:' || source END), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM l LEFT JOIN a ON true
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2))::INT, doc_id NULLS LAST) - 1 AS k FROM d
), x AS (
  SELECT doc_id, size, source_size, target, u, k, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS q
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (least(3, floor(q * (k + 1)::DOUBLE + u) - floor(q * k::DOUBLE + u))::BIGINT * size)::BIGINT AS taken FROM x
"""
