"""The token store: packing, zones for training and validation, and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.frames import aside, unused
from millrace.plans.storage import materialize

from .mixture import running

IGNORED = -100


def supervised(questions: Column, answers: Column) -> tuple[Column, Column]:
    """(ids, mask) of an instruction: only the answer's tokens count for the loss."""
    return F.concat(questions, answers), F.concat(F.array_repeat(F.lit(0), F.size(questions)), F.array_repeat(F.lit(1), F.size(answers)))


def pack(docs: DataFrame, *, order: str = "doc_id", tokens_per_shard: int = 100_000_000) -> DataFrame:
    """``docs`` (ids, optionally mask) with ``start`` (global position) and ``shard``.

    A shard is closed before the document that would begin at or beyond its bound, so documents are never split. A
    mask of another length than its ids raises; without a mask all tokens count.
    """
    docs, back = aside(docs, "__n", "__all")
    masked = docs if "mask" in docs.columns else docs.withColumn("mask", F.transform("ids", lambda _: F.lit(1)))
    checked = masked.withColumn("mask", F.when(F.size("mask") == F.size("ids"), F.col("mask")).otherwise(F.raise_error(F.lit("mask and ids differ in length"))))
    placed = running(checked.withColumn("__n", F.size("ids").cast("bigint")).withColumn("__all", F.lit(0)), ["__all"], [order], "__n", "start")
    # Here a shard starts with the first document at or beyond each multiple of the bound; in_shards has the writer's rule.
    return back(placed.withColumn("shard", F.floor(F.col("start") / F.lit(tokens_per_shard)).cast("int")).drop("__n", "__all"))


def in_shards(packed: DataFrame, tokens_per_shard: int) -> DataFrame:
    """``packed`` with ``shard`` by the rule of a writer that takes documents in turn: a shard ends with the document that fills it.

    So a shard begins with the first document at or beyond ``tokens_per_shard`` tokens from where the one before began. Two
    beginnings are never in one block of that many positions, so each document's successor is found inside its block or else is the first
    document of a later block; from the first document on, successors are then followed in doubled steps, in as many
    rounds as the logarithm of the number of shards. Documents without tokens go with the shard that is open.
    """
    spark, t = packed.sparkSession, tokens_per_shard
    block = lambda c: F.floor(c / F.lit(t)).cast("bigint")
    starts = materialize(packed.where(F.size("ids") > 0).select("start").distinct(), "shard-starts")
    places = starts.select(F.col("start").alias("at"), F.lit(1).alias("is_start"), "start").unionByName(starts.select((F.col("start") + t).alias("at"), F.lit(0).alias("is_start"), "start"))
    places = places.withColumn("block", block(F.col("at")))
    follow = W.partitionBy("block").orderBy("at", "is_start").rowsBetween(1, W.unboundedFollowing)
    inside = places.withColumn("next", F.min(F.when(F.col("is_start") == 1, F.col("start"))).over(follow)).where("is_start = 0")
    # A row per block of the stream: the first document of the blocks after it.
    blocks = places.groupBy("block").agg(F.min(F.when(F.col("is_start") == 1, F.col("start"))).alias("first"))
    blocks = blocks.select("block", F.min("first").over(W.orderBy("block").rowsBetween(1, W.unboundedFollowing)).alias("later"))
    jump = inside.join(blocks, "block").select("start", F.coalesce("next", "later").alias("next")).where("next is not null")
    jump = materialize(jump, "shard-jumps")
    marked = materialize(starts.agg(F.min("start").alias("start")).where("start is not null"), "shard-marks")
    while True:
        reached = marked.join(jump, "start").select(F.col("next").alias("start")).join(marked, "start", "left_anti")
        grown = materialize(marked.unionByName(reached), "shard-marks")
        if grown.count() == marked.count():
            break
        marked = grown
        twice = jump.join(jump.select(F.col("start").alias("next"), F.col("next").alias("after")), "next").select("start", F.col("after").alias("next"))
        jump = materialize(twice, "shard-jumps", instead_of=jump)
    # A row per shard, at most one to a block; a block without a beginning belongs to the shard before.
    begins = marked.select("start", (F.row_number().over(W.orderBy("start")) - 1).alias("number")).withColumn("block", block(F.col("start")))
    last = starts.agg(F.max("start")).first()[0] or 0
    open_ = spark.range(last // t + 2).select(F.col("id").alias("block")).join(begins, "block", "left")
    known = open_.select("block", F.col("start").alias("begin"), "number", F.last("number", ignorenulls=True).over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    at, begin, number, earlier = (unused(packed, f"__{x}") for x in ("block", "begin", "number", "earlier"))
    known = known.select(F.col("block").alias(at), F.col("begin").alias(begin), F.col("number").alias(number), F.col("earlier").alias(earlier))
    met = packed.withColumn(at, F.least(block(F.col("start")), F.lit(last // t + 1))).join(known, at, "left")
    shard = F.coalesce(F.when(F.col("start") >= F.col(begin), F.col(number)), F.col(earlier), F.lit(0)).cast("int")
    return met.withColumn("shard", shard).select(*[c for c in packed.columns if c != "shard"], "shard")


def stats(packed: DataFrame) -> DataFrame:
    counted = F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    out = packed.agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.size("ids").cast("bigint")).alias("n_tokens"), F.sum(counted).alias("n_supervised"))
    return out.withColumn("supervised_share", F.bround(F.try_divide("n_supervised", "n_tokens"), 3))


def zones(spark: SparkSession, n_tokens: int, val_tokens: int, val_blocks: int) -> DataFrame:
    """(split, start, len): validation blocks spread evenly, and what lies between them for training."""
    if val_tokens <= 0:
        return spark.createDataFrame([("train", 0, n_tokens)], "split string, start bigint, len bigint")
    size, stride = val_tokens // val_blocks, n_tokens // val_blocks
    if size == 0 or stride < size:
        raise ValueError(f"{val_blocks} blocks of {size} tokens don't fit into {n_tokens}")
    val = spark.range(val_blocks).select(F.lit("val").alias("split"), (F.col("id") * stride + (stride - size) // 2).alias("start"), F.lit(size).cast("bigint").alias("len"))
    by_start = W.orderBy("start")  # a row per block
    gaps = val.select(F.coalesce(F.lag(F.col("start") + F.col("len")).over(by_start), F.lit(0)).alias("start"), F.col("start").alias("end"))
    last = val.agg((F.max("start") + size).alias("start")).withColumn("end", F.lit(n_tokens).cast("bigint"))
    train = gaps.unionByName(last).where("end > start").select(F.lit("train").alias("split"), "start", (F.col("end") - F.col("start")).alias("len"))
    return val.unionByName(train)


def placements(found: DataFrame, window: int) -> DataFrame:
    """Zones with ``usable`` (starts at which a window fits) and ``cum`` (those of earlier zones of the split)."""
    usable = found.withColumn("usable", F.greatest(F.lit(0), F.col("len") - (window - 1)).cast("bigint"))
    before = W.partitionBy("split").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return usable.withColumn("cum", F.coalesce(F.sum("usable").over(before), F.lit(0)))


def _located(points: DataFrame, ranges: DataFrame, total: int, n_ranges: int) -> DataFrame:
    """``points`` (k below ``total``) beside the range of ``ranges`` (cum, size; side by side) that holds them.

    Both meet by buckets of k, one to a range on average: a range is in as many buckets as it touches, twice the ranges
    in all at most. An equi-join, however many ranges there are.
    """
    width = max(1, -(-total // max(1, n_ranges)))
    number = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    dealt = ranges.where("size > 0").withColumn("bucket", F.explode(F.sequence(number(F.col("cum")), number(F.col("cum") + F.col("size") - 1))))
    met = points.withColumn("bucket", number(F.col("k"))).join(dealt, "bucket")
    return met.where((F.col("k") >= F.col("cum")) & (F.col("k") < F.col("cum") + F.col("size"))).drop("bucket")


def draw(found: DataFrame, n: int, window: int, seed: int, split: str = "train") -> DataFrame:
    """``n`` starts, uniform over all places of a window in the split's zones: (i, pos). Depends on the seed only, by md5."""
    placed = placements(found.where(F.col("split") == split), window).where("usable > 0").select("start", "cum", F.col("usable").alias("size"))
    total, zones_ = placed.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not total:
        raise ValueError("no zone can hold a window")
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    drawn = found.sparkSession.range(n).select(F.col("id").alias("i"), (number % F.lit(total)).alias("k"))
    return _located(drawn, placed, total, zones_).select("i", (F.col("start") + F.col("k") - F.col("cum")).alias("pos"))


def sequential(found: DataFrame, window: int, batch: int = 1, split: str = "val") -> DataFrame:
    """Windows side by side inside each zone, in order, full batches only: (i, pos)."""
    fits = found.where((F.col("split") == split) & (F.col("len") >= window)).select("start", F.floor(F.col("len") / window).alias("size"))
    before = W.orderBy("start").rowsBetween(W.unboundedPreceding, -1)  # a row per zone
    placed = fits.withColumn("cum", F.coalesce(F.sum("size").over(before), F.lit(0)))
    total, zones_ = placed.agg(F.sum("size"), F.count(F.lit(1))).first()
    numbered = found.sparkSession.range((total or 0) // batch * batch).select(F.col("id").alias("i"), F.col("id").alias("k"))
    return _located(numbered, placed, total or 0, zones_).select("i", (F.col("start") + (F.col("i") - F.col("cum")) * window).alias("pos"))


def windows(packed: DataFrame, positions: DataFrame, length: int, block: int = 1 << 16, *, partial: bool = False) -> DataFrame:
    """The tokens and masks at ``positions`` (i, pos): (i, ids, mask), across documents.

    Documents and windows meet by blocks of positions: an equi-join, however many documents there are. A window that
    begins or ends outside the stream raises; with ``partial`` it has what there is.
    """
    if not partial:
        total = packed.agg(F.max(F.col("start") + F.size("ids"))).first()[0] or 0
        low, high = positions.agg(F.min("pos"), F.max("pos")).first()
        if low is not None and (low < 0 or high + length > total):
            raise IndexError(f"windows of {length} at {low} to {high} reach beyond the {total} tokens")
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor(b / block)))
    left = positions.withColumn("b", blocks(F.col("pos"), F.col("pos") + length - 1))
    end = F.col("start") + F.size("ids")
    right = packed.where(F.size("ids") > 0).select("start", "ids", "mask").withColumn("b", blocks(F.col("start"), end - 1))
    # A document comes to a block with its tokens of that block only.
    first, last = F.greatest(F.col("start"), F.col("b") * block), F.least(end, (F.col("b") + 1) * block)
    cut = lambda c, a, z: F.slice(c, (a - F.col("start") + 1).cast("int"), (z - a).cast("int")).alias(c)
    right = right.select("b", first.alias("start"), cut("ids", first, last), cut("mask", first, last), (last - first).alias("n"))
    a, z = F.greatest("pos", "start"), F.least(F.col("pos") + length, F.col("start") + F.col("n"))
    # Windows are dealt once they are cut: an aggregation would carry, and spill, what they are cut from.
    met = left.join(right, "b").where(a < z).select("i", a.alias("a"), cut("ids", a, z), cut("mask", a, z)).repartition("i")
    parts = met.groupBy("i").agg(*[F.sort_array(F.collect_list(F.struct("a", c))).alias(c) for c in ("ids", "mask")])
    return parts.select("i", *[F.flatten(F.col(c)[c]).alias(c) for c in ("ids", "mask")])


def shifted(windows_: DataFrame) -> DataFrame:
    """Inputs and targets: the next token, or ``IGNORED`` where its mask is 0."""
    targets = F.zip_with(F.slice("ids", F.lit(2), F.size("ids") - 1), F.slice("mask", F.lit(2), F.size("mask") - 1), lambda t, m: F.when(m == 0, F.lit(IGNORED)).otherwise(t))
    return windows_.select("i", F.slice("ids", F.lit(1), F.size("ids") - 1).alias("inputs"), targets.alias("targets"))


def evaluation_windows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, ids): windows of ``length`` + 1 tokens that advance by ``length``; shorter than 2 are left out."""
    starts = F.when(F.size("ids") >= 2, F.sequence(F.lit(0), F.size("ids") - 2, F.lit(length)))
    return docs.select("doc_id", "ids", F.explode(starts).alias("start")).select("doc_id", "start", F.slice("ids", F.col("start") + 1, length + 1).alias("ids"))


def sft(examples: DataFrame, replay: DataFrame | None = None, *, max_tokens: int, eot: int) -> DataFrame:
    """(doc_id, ids, mask) for fine-tuning of examples (doc_id, question, answer: token ids) and of replayed documents (doc_id, ids).

    An answer ends with ``eot``; an example of more than ``max_tokens`` is left out, never cut. A replayed document ends with it
    too, counts for the loss whole, and is cut at ``max_tokens``.
    """
    ids, mask = supervised(F.col("question"), F.array_append("answer", F.lit(eot)))
    out = examples.where(F.size("question") + F.size("answer") + 1 <= max_tokens).select("doc_id", ids.alias("ids"), mask.alias("mask"))
    if replay is None:
        return out
    cut = F.slice(F.array_append("ids", F.lit(eot)), 1, max_tokens)
    again = replay.select("doc_id", cut.alias("ids")).withColumn("mask", F.transform("ids", lambda _: F.lit(1)))
    return out.unionByName(again)
