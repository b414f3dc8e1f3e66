"""What the training-data operators share: intermediate tables, row keys, hold-outs, samples and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.arrays import let, rolling
from millrace.functions.frames import small, unused
from millrace.plans.storage import materialize, shared_dir

__all__ = ["id_crc", "labelled_sample", "let", "materialize", "rolling", "row_key", "shared_dir", "small", "table", "unused", "words"]

#: Runs of ASCII white space; what lies between them are words.
WHITESPACE = r"[\x20\x09-\x0D]+"
#: Bounds of a classifier's sample over all labels together: documents, and bytes of their texts.
SAMPLE_DOCUMENTS = 24_000
SAMPLE_BYTES = 256 << 20


def words(text: Column, breaks: str = WHITESPACE) -> Column:
    """The words of a text between ``breaks``; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), breaks), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of a row's identifier and text; rows that repeat in full share it."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(doc_id).isNull(), F.col(text).isNull())


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the identifier as text (null counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, known: DataFrame, per_label: int, documents: int = SAMPLE_DOCUMENTS, size: int = SAMPLE_BYTES) -> list[tuple]:
    """(text, label, lang) of a bounded sample of labelled documents, in the order of a hash of their ids.

    ``known`` has doc_id and label, rows without either count for nothing; ``docs`` has doc_id, text and lang, and
    label too where rows of one id differ in it. Of each
    label up to ``per_label`` documents are drawn over all rows, fewer if the labels are so many that this would be
    more than ``documents`` in all (then the most frequent labels first); of these, as many as begin within the label's
    share of ``size`` bytes. Texts are whole. An id counts once however many rows repeat it, with the smallest of its texts.
    """
    spark = docs.sparkSession
    ids = known.select("doc_id", F.col("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    # Labels of documents that are not there (or have no text) would take places in the draw; keys alone are joined.
    ids = materialize(ids.join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi"), "sample-known")
    # Counted without a shuffle of ids; twice the share is drawn at first, so an estimate is enough.
    counts = materialize(ids.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("n")), "sample-labels")
    n_labels = counts.count()
    if n_labels > documents:
        counts = materialize(counts.orderBy(F.desc("n"), "label").limit(documents), "sample-labels")
        n_labels = documents
    each = max(1, min(per_label, documents // max(1, n_labels)))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    wide = ids.join(small(counts, n_labels), "label").where(draw < F.lit(2.0 * each + 20) / F.col("n")).select("doc_id", "label").distinct()
    order = W.partitionBy("label").orderBy(draw, "doc_id")  # about 2 * per_label rows each
    chosen = wide.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("doc_id", "label")
    chosen = materialize(chosen, "sample-ids")
    keys = ["doc_id", "label"] if "label" in docs.columns else ["doc_id"]
    met = docs.select(*keys, F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null")
    met = met.join(small(chosen, chosen.count()), keys).groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang")).alias("d"))
    before = F.sum(F.octet_length("d.text").cast("bigint")).over(order.rowsBetween(W.unboundedPreceding, -1))
    fits = materialize(met.select("doc_id", "label", "d.text", "d.lang", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < F.lit(size // max(1, n_labels))), "sample")
    return [(r["text"], r["label"], r["lang"]) for r in fits.orderBy(draw, "label").select("text", "label", "lang").collect()]
