"""Structured Streaming: deduplicated ingestion and metric roll-ups, with checkpoints that make them resumable."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions import text as T
from millrace.functions.frames import unused
from millrace.operators import dedup, novelty
from millrace.plans.storage import remove
from millrace.sources import SCHEMA


def documents(spark: SparkSession, path: str, *, format: str = "json", schema: str = SCHEMA, max_files: int | None = None) -> DataFrame:
    """New shards of a folder as they come."""
    reader = spark.readStream.format(format).schema(schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).load(path)


def unique(docs: DataFrame) -> DataFrame:
    """Documents whose fingerprint the stream has not seen; the state is the set of fingerprints."""
    fp = unused(docs, "__fp")
    return docs.withColumn(fp, T.fingerprint(F.col("text"))).dropDuplicates([fp]).drop(fp)


def ingest(docs: DataFrame, out: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Write a stream to a table; with ``available_now`` take what is there and stop, so a second run is idempotent."""
    writer = docs.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(out)


#: Keeps state on disk, so that it may be larger than memory.
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def near_unique(docs: DataFrame, table: str, checkpoint: str, *, read: list[int] | None = None, **params: int) -> StreamingQuery:
    """Deduplication of each batch against the keys of the documents kept in all batches before: exact copies, then greedy near ones.

    Documents come by batch, in a batch in the order of their ids (null first; rows of one id in that of a hash of their texts),
    and rows alike in both are one. The result is what :func:`dedup.greedy` gives over all documents in that order, with the fingerprint as one more key.

    The keys of kept documents are the state of a second stream (:func:`_met`), which each batch feeds with the keys it asks for and,
    when it is done, with those it keeps. A batch reads its own keys and those the batch before has kept, whatever the history; ``read``,
    if given, gets these numbers. ``table`` gets ``batch=N/docs``; a batch that is run again overwrites them, and what it had
    registered counts for later batches alone.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumnRenamed("id", "doc_id") if "doc_id" not in batch.columns else batch
        place = unused(rows, "__place")
        rows = rows.withColumn(place, dedup.row_place()).dropDuplicates([place])
        # A text's fingerprint is one more key: exact copies, short texts too, share it.
        texts = rows.select(F.col(place).alias("doc_id"), "text", F.xxhash64(F.lit("exact"), T.fingerprint(F.coalesce("text", F.lit("")))).alias("own"))
        found = dedup.band_keys(texts, **params, carry=("own",)).select("doc_id", F.array_append("keys", F.col("own")).alias("keys"))
        found.write.mode("overwrite").parquet(f"{table}/batch={n}/candidates")
        keys = spark.read.parquet(f"{table}/batch={n}/candidates")
        asked = keys.select("doc_id", F.explode("keys").alias("key"))
        asked.select("key", F.lit(None).cast("bigint").alias("batch")).distinct().write.parquet(f"{table}/log/{n:09d}-asked-{uuid.uuid4().hex}")
        met = _met(spark, table, n, read)
        keys = keys.join(asked.join(met, "key", "left_semi").select("doc_id").distinct(), "doc_id", "left_anti")
        kept = keys.join(dedup.greedy(keys.withColumn("ord", F.col("doc_id"))), "doc_id", "left_anti")
        kept.write.mode("overwrite").parquet(f"{table}/batch={n}/kept")
        kept = spark.read.parquet(f"{table}/batch={n}/kept")
        rows.join(kept.select(F.col("doc_id").alias(place)), place, "left_semi").drop(place).write.mode("overwrite").parquet(f"{table}/batch={n}/docs")
        registered = kept.select(F.explode("keys").alias("key"), F.lit(n).cast("bigint").alias("batch")).distinct()
        registered.write.mode("overwrite").parquet(f"{table}/log/{n:09d}-kept")
        remove(spark, f"{table}/batch={n}/candidates")
        remove(spark, f"{table}/batch={n}/kept")

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _met(spark: SparkSession, table: str, n: int, read: list[int] | None = None) -> DataFrame:
    """The keys of the log's new rows that a batch before ``n`` has registered.

    A stream over the log with the first batch of each key as its state: in update mode it gives the keys that new rows touch, asked
    ones included, and looks up no others. Rows that are read twice change nothing, as the first batch of a key stays.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    out = f"{table}/met/{n:09d}-{uuid.uuid4().hex}"

    def keep(touched: DataFrame, k: int) -> None:
        touched.where(F.col("first") < n).select("key").write.mode("overwrite").parquet(f"{out}/part={k}")

    log = spark.readStream.schema("key bigint, batch bigint").parquet(f"{table}/log/*")
    first = log.groupBy("key").agg(F.min("batch").alias("first"))
    query = first.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{table}/keys").trigger(availableNow=True).start()
    query.awaitTermination()
    if read is not None:
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    return spark.read.schema("key bigint").option("recursiveFileLookup", "true").parquet(out).distinct()


def novelty_of_batches(docs: DataFrame, history: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The overlap of each batch with each artifact of ``history`` (artifact, fp), appended to ``out``."""

    def step(batch: DataFrame, n: int) -> None:
        found = novelty.overlaps(novelty.fingerprints(batch), history)
        found.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily(points: DataFrame, *, at: str = "ts", key: str = "event_type", value: str = "value", late: str = "1 day") -> DataFrame:
    """Counts and sums per day and key; rows later than ``late`` are no longer waited for (streams only)."""
    rows = points.withWatermark(at, late) if points.isStreaming else points
    return rows.groupBy(F.window(at, "1 day").alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("day"), key, "n", "total")


def stop_after(query: StreamingQuery, seconds: float) -> bool:
    """Let a stream run for so long, then stop it between two batches; whether it had ended by itself.

    A batch that is under way is finished first, so the checkpoint is that of whole batches.
    """
    if query.awaitTermination(seconds):
        return True
    while query.isActive and query.status["isTriggerActive"]:
        if query.awaitTermination(0.05):
            return True
    query.stop()
    return False
