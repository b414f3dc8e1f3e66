"""A stored BM25 index: postings by term, in blocks of documents, each with what bounds its scores.

Documents are dealt into blocks of about ``BLOCK`` by a hash of their ids, the same for all terms. A row of ``postings`` is a term's documents of
one block (ids, tfs, lengths) with their largest impact, the part of the score that does not depend on the corpus; rows lie in folders by
a hash of the term, sorted by term. Adding passages writes one more segment and touches no other. A segment counts once its ``stats`` are there.

A search first reads the impacts alone: their weighted sum over a question's terms bounds the score of any document of a block. The blocks of
the highest bounds are scored, the k-th best score found is reached by k documents, and only blocks whose bound reaches it are scored
in full. The result is that of a search through all postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.frames import small
from millrace.operators import retrieval
from millrace.plans.storage import exists, materialize, remove

BLOCK = 64
BUCKETS = 64
#: Rows of a file of postings, about.
FILE_ROWS = 500_000
#: Blocks of a question that are scored to find the score to beat.
FIRST_BLOCKS = 8
#: What sums of the same terms in another order may differ by.
SLACK = 1e-8
PARAMETERS = "title_weight int, k1 double, b double, buckets int"
STATS = "n bigint, length bigint, segment int"


def build(passages: DataFrame, path: str, *, title_weight: int = 2, k1: float = 1.5, b: float = 0.75, buckets: int = BUCKETS) -> None:
    """A new index of passages (id, text, and title if there is one) at ``path``; what was there goes."""
    spark = passages.sparkSession
    remove(spark, path)
    spark.createDataFrame([(title_weight, k1, b, buckets)], PARAMETERS).coalesce(1).write.json(f"{path}/parameters")
    add(passages, path)


def add(passages: DataFrame, path: str) -> None:
    """More passages, under ids that the index does not have yet, as a segment of their own."""
    spark = passages.sparkSession
    kept, found = parameters(spark, path), stats(spark, path)
    number = 1 + max((r["segment"] for r in found), default=-1)
    at = f"{path}/segments/{number:06d}"
    remove(spark, at)  # what a run that failed has left
    k1, b, buckets = kept["k1"], kept["b"], kept["buckets"]
    cut = materialize(passages.select("id", retrieval.counted_terms(passages, kept["title_weight"]).alias("terms")), "terms")
    dl = retrieval.counted_length(F.col("terms"))
    n, length, n_postings = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum(dl), F.lit(0)), F.coalesce(F.sum(F.size("terms").cast("bigint")), F.lit(0))).first()
    average, blocks = (length / n if length else 1.0), max(1, -(-n // BLOCK))
    placed = cut.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), dl.alias("dl"), "terms")
    placed.drop("terms").write.parquet(f"{at}/lengths")
    postings = placed.select("id", "block", "dl", F.inline("terms"))
    if retrieval.repeated(cut):
        postings = postings.groupBy("term", "block", "id", "dl").agg(F.sum("tf").alias("tf"))
    # Dealt once, to the folder where they will lie; a folder of many rows to several tasks by blocks.
    bucket, share = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), F.pmod("block", F.lit(max(1, -(-n_postings // (FILE_ROWS * buckets)))))
    dealt = postings.withColumns({"bucket": bucket, "share": share}).repartition("bucket", "share")
    rows = dealt.groupBy("term", "block", "bucket", "share").agg(
        F.max(_impact(F.col("tf"), F.col("dl"), k1, b, average)).alias("impact"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("postings")
    )
    rows.select("term", "block", "impact", "n", "postings", "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{at}/postings")
    written = _postings(spark, at)
    written.groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{at}/lexicon")
    spark.createDataFrame([(n, length, number)], STATS).coalesce(1).write.json(f"{at}/stats")


def _impact(tf: Column, dl: Column, k1: float, b: float, average: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(float(average))))


def parameters(spark: SparkSession, path: str) -> dict:
    return spark.read.schema(PARAMETERS).json(f"{path}/parameters").first().asDict()


def stats(spark: SparkSession, path: str) -> list:
    """A row per complete segment: its number, documents and sum of lengths."""
    if not exists(spark, f"{path}/segments"):
        return []
    return spark.read.schema(STATS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{path}/segments").orderBy("segment").collect()


def _postings(spark: SparkSession, at: str) -> DataFrame:
    # Without a term there is no file that would tell the columns.
    kind = spark.read.parquet(f"{at}/lengths").schema["id"].dataType.simpleString()
    return spark.read.schema(f"term string, block bigint, impact double, n bigint, postings array<struct<id:{kind},tf:bigint,dl:bigint>>, bucket int").parquet(f"{at}/postings")


def _table(spark: SparkSession, path: str, name: str, found: list) -> DataFrame:
    """A table of all segments, with their numbers."""
    out = None
    for r in found:
        at = f"{path}/segments/{r['segment']:06d}"
        part = (_postings(spark, at) if name == "postings" else spark.read.parquet(f"{at}/{name}")).withColumn("segment", F.lit(r["segment"]))
        out = part if out is None else out.unionByName(part)
    return out


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """(id, dl) of all documents."""
    return _table(spark, path, "lengths", stats(spark, path)).select("id", "dl")


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(term, id, tf) as they are stored."""
    return _table(spark, path, "postings", stats(spark, path)).select("term", F.inline("postings")).select("term", "id", "tf")


def search(spark: SparkSession, path: str, queries: DataFrame, *, k: int = 3, read: list[tuple[int, int]] | None = None) -> DataFrame:
    """The ``k`` best passages of each query (qid, terms): (qid, id, score, rank), as :func:`retrieval.search` gives them.

    ``read``, if given, gets the postings that were scored in full and all those of the terms asked for.
    """
    kept, found = parameters(spark, path), stats(spark, path)
    k1, b = kept["k1"], kept["b"]
    n, length = sum(r["n"] for r in found), sum(r["length"] for r in found)
    average = length / n if length else 1.0
    df = _table(spark, path, "lexicon", found).groupBy("term").agg(F.sum("df").alias("df"))
    asked = queries.select("qid", F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("m"))
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = materialize(asked.join(df, "term").select("qid", "term", (F.col("m") * idf).alias("weight")), "weighed")
    n_weights = weighed.count()
    weights, terms = small(weighed, n_weights), small(weighed.select("term").distinct(), n_weights)
    wanted = [r[0] for r in weighed.select(F.pmod(F.xxhash64("term"), F.lit(kept["buckets"])).cast("int")).distinct().collect()]
    rows = _table(spark, path, "postings", found).where(F.col("bucket").isin(wanted))
    # A longer average since a segment was written raises impacts, by its share at most.
    rise = F.lit(1.0)
    for r in found:
        own = r["length"] / r["n"] if r["length"] else 1.0
        rise = F.when(F.col("segment") == r["segment"], max(1.0, average / own)).otherwise(rise)
    bounds = rows.select("term", "segment", "block", "n", (F.col("impact") * rise).alias("impact")).join(weights, "term")
    bounds = bounds.groupBy("qid", "segment", "block").agg(F.sum(F.col("weight") * F.col("impact")).alias("bound"), F.sum("n").alias("n"))
    bounds = materialize(bounds, "bounds")

    def scored(blocks: DataFrame) -> DataFrame:
        # Blocks are dealt before they meet the questions, with those that ask for them: postings are shuffled once, not once a question.
        wanted = materialize(blocks.groupBy("segment", "block").agg(F.collect_list("qid").alias("qids")), "wanted")
        met = rows.drop("impact", "n").join(terms, "term", "left_semi").join(small(wanted.select("segment", "block"), wanted.count()), ["segment", "block"], "left_semi")
        met = met.repartition("segment", "block").join(wanted, ["segment", "block"]).join(weights, "term").where(F.array_contains("qids", F.col("qid")))
        each = met.select("segment", "block", "qid", "weight", F.inline("postings"))
        part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(average)))
        return each.groupBy("segment", "block", "qid", "id").agg(F.sum(part).alias("score")).select("qid", "id", "score")

    first = bounds.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("bound"), "segment", "block"))).where(F.col("r") <= FIRST_BLOCKS)
    best = scored(first).withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("r") == k)
    beat = materialize(best.select("qid", F.col("score").alias("beat")), "beat")
    needed = bounds.join(beat, "qid", "left").where(F.col("beat").isNull() | (F.col("bound") >= F.col("beat") - SLACK))
    if read is not None:
        read.append((needed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    ranked = scored(needed).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")))
    return ranked.where(F.col("rank") <= k)
