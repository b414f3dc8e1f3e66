"""Hard-negative mining: for an anchor and each of its nearest rows of the same label, the highest rows of another label just below.

Scores are integers: a component x counts as floor(256 * x), and a score is the inner product with the anchor. Every
anchor meets every row, in cells: the anchors are dealt into groups and the rows into shards, both of a fixed size, and a
task gets one group and one shard at a time. In a cell each anchor's scores are sorted in full by score and id; a first
pass reads off the nearest rows of the anchor's label, a second one searches each of them in the sorted scores for its
upper limit and reads the rows of other labels from there down to the lower limit. What cells find, at most k rows an
anchor (and positive), is ranked again over all shards.

Defined results: rows with a null id, label or vector, or with a null, NaN or infinite component take no part. An id that is
repeated counts once, with the smallest (label, vector). Vectors of different lengths score over their common part. A score
has 64 bits and wraps around beyond. An anchor without a row of its label, or a positive without a negative in its range,
gives no row. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these hundredths of its positive's score.
LOW, HIGH = 80, 100
#: Rows of a shard and anchors of a group; both bound what a task holds at a time.
SHARD, GROUP = 4096, 4096
#: Anchors scored at a time within a cell.
BLOCK = 64


def quantised(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label and the integer components (vec) of the rows that take part, an id once."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    vec = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    of_id = kept.select("vec_id", F.struct(F.col("label").cast("bigint").alias("label"), vec.alias("vec")).alias("r")).groupBy("vec_id").agg(F.min("r").alias("r"))
    return of_id.select("vec_id", "r.label", "r.vec")


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for the anchors among ``rows``.

    ``rows`` has vec_id, embedding and label; ``is_anchor`` is a condition on vec_id.
    """
    spark = rows.sparkSession
    all_rows = common.materialize(quantised(rows), "negatives-rows")
    anchors = all_rows.where(is_anchor)
    shards = max(1, -(-all_rows.count() // SHARD))
    groups = max(1, -(-anchors.count() // GROUP))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    right = all_rows.select("vec_id", "label", "vec", dealt(shards).alias("shard"), each(groups).alias("part"))
    left = anchors.select("vec_id", "label", "vec", dealt(groups).alias("part"))

    def cells(mine: DataFrame, found, schema: str) -> DataFrame:
        spread = mine.select("*", each(shards).alias("shard"))
        return spread.groupBy("part", "shard").cogroup(right.groupBy("part", "shard")).applyInPandas(found, schema)

    near = cells(left, lambda a, r: _nearest(a, r, positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    first = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives)
    wanted = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("positive_id").alias("ids"), F.collect_list("positive_score").alias("scores"))
    wanted = common.materialize(left.join(wanted, "vec_id"), "negatives-positives")
    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    hard = cells(wanted, lambda a, r: _below(a, r, negatives, low, high), schema)
    best = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _matrix(vecs: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width), np.int64)
    for i, v in enumerate(vecs):
        out[i, : len(v)] = v
    return out


def _sorted(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor its place, the places of all rows by falling score and rising id, and the scores in that order."""
    if not len(anchors) or not len(rows):
        return
    width = max(*map(len, anchors["vec"]), *map(len, rows["vec"]), 1)
    a, r = _matrix(anchors["vec"], width), _matrix(rows["vec"], width)
    # Sums of doubles are exact below 2^53; beyond, integers are multiplied, which is slower.
    if width * float(np.abs(a.astype(np.float64)).max()) * float(np.abs(r.astype(np.float64)).max()) < 2.0**53:
        a, r = a.astype(np.float64), r.astype(np.float64)
    ids, turned = rows["vec_id"].to_numpy(), np.ascontiguousarray(r.T)
    for at in range(0, len(a), BLOCK):
        for i, scores in enumerate((a[at : at + BLOCK] @ turned).astype(np.int64), at):
            order = np.lexsort((ids, ~scores))  # ~x falls as x rises, without the overflow of -x
            yield i, order, scores[order]


def _nearest(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k other rows of each anchor's label in the sorted scores."""
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    own, of = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
    found = []
    for i, order, scores in _sorted(anchors, rows):
        places = np.flatnonzero((labels[order] == of[i]) & (ids[order] != own[i]))[:k]
        found.append((np.full(len(places), own[i]), ids[order[places]], scores[places]))
    return _frame(found, ("anchor_id", "positive_id", "positive_score"))


def _below(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """For each anchor and positive the first k rows of other labels from the upper limit down, above the lower one."""
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    own, of = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
    found = []
    for i, order, scores in _sorted(anchors, rows):
        other = np.flatnonzero(labels[order] != of[i])
        falling = ~scores[other]
        for positive, score in zip(anchors["ids"].iloc[i], anchors["scores"].iloc[i], strict=True):
            most, least = high * int(score) // 100, -(-low * int(score) // 100)
            start = np.searchsorted(falling, ~np.int64(most), "left")
            places = other[start : start + k]
            places = places[scores[places] >= least]
            found.append((np.full(len(places), own[i]), np.full(len(places), positive), np.full(len(places), score), ids[order[places]], scores[places]))
    return _frame(found, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))


def _frame(found: list[tuple], names: tuple[str, ...]) -> pd.DataFrame:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * len(names)
    return pd.DataFrame(dict(zip(names, columns, strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))), true)
),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id AS id, r.label AS label, list_inner_product(a.vec, r.vec)::BIGINT AS score
  FROM v a, v r WHERE a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INT AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> s.own
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
