"""Sinks: document shards, metric points and search indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import search_index
from millrace.sources import to_json, zstd_lines


def write_shards(docs: DataFrame, path: str, *, max_documents: int = 100_000, max_bytes: int | None = None, format: str = "parquet", mode: str = "overwrite") -> DataFrame:
    """Write documents in shards of at most so many documents (zstd or gzip JSON lines, or zstd Parquet); totals per source.

    ``max_bytes`` bounds a shard too. As ``zstd`` a shard is closed once it has so many compressed bytes, 256 MB by default; of the
    other formats Spark writes the files, and as many rows go into each as texts of the mean length fit, before compression.
    """
    if format == "zstd":
        zstd_lines.register(docs.sparkSession)
        out = to_json(docs).write.format("zstd_lines").mode(mode).option("max_documents", max_documents)
        (out if max_bytes is None else out.option("max_bytes", max_bytes)).save(path)
        return _totals(docs)
    if max_bytes is not None:
        mean = docs.agg(F.avg(F.octet_length("text"))).first()[0] or 0.0
        max_documents = max(1, min(max_documents, int(max_bytes / mean) if mean else max_documents))
    out = docs.write.mode(mode).option("maxRecordsPerFile", max_documents)
    if format == "json":
        out.option("ignoreNullFields", "true").option("compression", "gzip").json(path)
    else:
        out.option("compression", "zstd").parquet(path)
    return _totals(docs)


def _totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(T.n_words(F.col("text")).cast("bigint")).alias("words"))


def append_metrics(points: DataFrame, path: str, **context: str | int | float) -> None:
    """Append points, each with a UTC timestamp ``t`` and the constant ``context``."""
    stamped = points if "t" in points.columns else points.withColumn("t", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    stamped.withColumns({k: F.lit(v) for k, v in context.items()}).write.mode("append").json(path)


def token_type(vocab_size: int) -> str:
    """The narrowest type whose values all ids of a vocabulary are: Spark's are signed."""
    return "smallint" if vocab_size <= 1 << 15 else "int"


def write_tokens(packed: DataFrame, path: str) -> None:
    """Token documents with their masks and positions, by shard."""
    packed.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(path)


def write_index(passages: DataFrame, path: str, *, title_weight: int = 2, k1: float = 1.5, b: float = 0.75, mode: str = "overwrite") -> None:
    """Store the index of passages (:mod:`search_index`); with ``append`` add them to the one that is there, as it was set up."""
    if mode == "append":
        search_index.add(passages, path)
    else:
        search_index.build(passages, path, title_weight=title_weight, k1=k1, b=b)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(postings, lengths, k1 and b) of an index that :func:`write_index` wrote, as they are stored."""
    kept = search_index.parameters(spark, path)
    return search_index.postings(spark, path), search_index.lengths(spark, path), {"k1": kept["k1"], "b": kept["b"]}
