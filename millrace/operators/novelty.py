"""How much of a collection is new: overlaps of prefix fingerprints, as sets; the measure is asymmetric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans import storage

ALERT = 0.5


def fingerprints(docs: DataFrame, *, length: int = 400, limit: int | None = None, order: str = "doc_id") -> DataFrame:
    """Distinct fingerprints; of the first ``limit`` documents in order, where a limit is asked for."""
    rows = docs if limit is None else docs.orderBy(order).limit(limit)
    return rows.select(T.prefix_fingerprint(F.col("text"), length).alias("fp")).where("fp is not null").distinct()


def overlaps(mine: DataFrame, others: DataFrame, *, rounded: int = 4) -> DataFrame:
    """The share of ``mine`` (fp) that each artifact of ``others`` (artifact, fp) has; artifacts without rows have none."""
    n = mine.count()
    both = others.select("artifact", "fp").distinct().join(mine.withColumn("hit", F.lit(1)), "fp", "left")
    found = both.groupBy("artifact").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("shared"))
    share = F.col("shared") / F.lit(n) if n else F.lit(0.0)
    return found.select("artifact", F.bround(share, rounded).alias("overlap")).withColumn("alert", F.col("overlap") >= ALERT)


def worst(found: DataFrame) -> DataFrame:
    """The largest overlap, the first by name of equal ones; no row's values if there is nothing to compare with."""
    return found.agg(F.max("overlap").alias("overlap"), F.min_by("artifact", F.struct(-F.col("overlap"), "artifact")).alias("artifact"))


#: The table beside an artifact's corpus that holds its distinct fingerprints.
SIDE_TABLE = "fingerprints"


def remember(artifact: storage.Artifact, corpus: DataFrame) -> DataFrame:
    """Write the distinct fingerprints of an artifact's corpus beside it, so that comparing reads no texts again."""
    return artifact.write(SIDE_TABLE, fingerprints(corpus), compression="zstd")


def compare_to_existing(corpus: DataFrame, root: str, *, stage: str = "corpora", exclude: str | None = None, limit: int | None = None) -> DataFrame:
    """:func:`overlaps` of ``corpus`` with every complete artifact under ``root`` but the one at the path ``exclude``.

    Artifacts are named by their folder; those without a text are left out. What :func:`remember` has written is read in place of texts;
    an artifact without it, or a ``limit`` of documents, has the texts read.
    """
    spark = corpus.sparkSession
    theirs = spark.createDataFrame([], "fp string, artifact string")
    for row in storage.artifacts(spark, root, stage).where("complete").orderBy("path").collect():  # a row per artifact
        if exclude is None or row["path"].rpartition("/")[2] != exclude.rstrip("/").rpartition("/")[2]:
            side = f"{row['path']}/{SIDE_TABLE}"
            if limit is None and storage.exists(spark, f"{side}/_SUCCESS"):
                part = spark.read.parquet(side)
            else:
                part = fingerprints(spark.read.parquet(f"{row['path']}/corpus"), limit=limit)
            theirs = theirs.unionByName(part.withColumn("artifact", F.lit(f"{row['label']}-{row['hash']}")))
    return overlaps(fingerprints(corpus, limit=limit), theirs)
