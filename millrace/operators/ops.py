"""Operational roll-ups of metric logs, collections and milestones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessions(log: DataFrame, days: int = 7) -> DataFrame:
    """Per day of the newest ``days``: steps since the day before, tokens seen, last loss; nothing below two days.

    ``log`` has t (ISO text or timestamp), step, tokens_seen and loss. The first shown day counts from its own first step.
    """
    day = F.substring(F.col("t").cast("string"), 1, 10)
    daily = log.withColumn("day", day).groupBy("day").agg(
        F.min_by("step", "t").alias("first_step"),
        F.max_by("step", "t").alias("last_step"),
        F.min_by("tokens_seen", "t").alias("first_tokens"),
        F.max_by("tokens_seen", "t").alias("last_tokens"),
        F.max_by("loss", "t").alias("last_loss"),
        F.count(F.lit(1)).alias("points"),
    )
    # Windows over a row per day.
    newest = daily.withColumn("r", F.row_number().over(W.orderBy(F.desc("day")))).withColumn("n", F.max("r").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).where(F.col("r") <= days)
    before = F.lag("last_step").over(W.orderBy("day"))
    out = newest.withColumn("steps", F.col("last_step") - F.coalesce(before, F.col("first_step"))).withColumn("tokens", F.greatest(F.lit(0), F.col("last_tokens") - F.col("first_tokens")))
    return out.where("n >= 2").select("day", "steps", "tokens", "last_loss", "points")


def tokens_processed(log: DataFrame, corpus: str | None = None) -> DataFrame:
    """Tokens of each run's last point that has them, optionally of the runs that declare the corpus."""
    rows = log
    if corpus is not None:
        rows = log.join(log.where(F.col("corpus") == corpus).select("run").distinct(), "run", "left_semi")
    return rows.where("tokens_seen is not null").groupBy("run").agg(F.max_by("tokens_seen", F.struct("t", "step")).alias("tokens_seen"))


def coverage(seen: Column, size: Column) -> Column:
    """The expected share of a store seen after so many draws."""
    return F.when(size > 0, 1 - F.exp(-seen / size)).otherwise(0.0)


def recent(collections: DataFrame, n: int, alert: float = 0.5) -> DataFrame:
    """The newest complete collections with their overlap and whether it is too large."""
    rows = collections.where("complete").orderBy(F.desc("created_at"), "label").limit(n)
    return rows.withColumn("alert", F.coalesce(F.col("overlap") >= alert, F.lit(False)))


def keep_last(checkpoints: DataFrame, n: int) -> DataFrame:
    """``checkpoints`` (run, step, loss) with ``kept`` (the newest ``n`` by step) and ``best`` (the first of the lowest loss)."""
    newest = F.row_number().over(W.partitionBy("run").orderBy(F.desc("step"))) <= n
    best = F.row_number().over(W.partitionBy("run").orderBy(F.isnan("loss"), "loss", "step")) == 1
    return checkpoints.withColumns({"kept": newest, "best": best})


def milestones(lines: DataFrame, today: Column) -> DataFrame:
    """(day, label, status) of lines ``YYYY-MM-DD text``; blank lines, comments and bad dates are left out."""
    value = F.trim("value")
    day = F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    rows = lines.where((value != "") & ~value.startswith("#")).select(day.alias("day"), F.trim(F.substr(value, F.lit(11))).alias("label")).where("day is not null")
    left = F.datediff("day", today)
    status = F.when(left < 0, F.concat(F.lit("late by "), (-left).cast("string"))).when(left == 0, F.lit("today")).otherwise(F.concat(F.lit("in "), left.cast("string")))
    return rows.withColumn("status", status)


def age(at: Column, now: Column) -> Column:
    """Minutes, hours or days since ``at``."""
    m = F.timestamp_diff("MINUTE", at, now)
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).when(m < 48 * 60, F.concat(F.floor(m / 60).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit(" d")))


def session_kind(line: Column) -> Column:
    """What a line of a scheduled session's log says of its end."""
    return F.when(F.contains(line, F.lit("Traceback")), "failed").when(F.contains(line, F.lit("interrupt")), "interrupted").when(F.contains(line, F.lit("done")), "done").otherwise("running")


def is_assembly(sources: Column) -> Column:
    """Whether a collection only re-reads others: it has sources (structs with a name), and all are shards."""
    return F.coalesce((F.size(sources) > 0) & F.forall(sources, lambda s: F.coalesce(s["name"] == "shards", F.lit(False))), F.lit(False))


def recent_collections(collections: DataFrame, n: int = 4, alert: float = 0.5) -> DataFrame:
    """:func:`recent`, assemblies (by their ``sources``) left out."""
    return recent(collections.where(~is_assembly(F.col("sources"))), n, alert)


def largest_store(stores: DataFrame, log: DataFrame) -> DataFrame:
    """The store (path, label, n_tokens) with the most tokens, what runs on its label have read of it, and the share never read."""
    largest = stores.where("n_tokens > 0").agg(F.max_by(F.struct("path", "label", "n_tokens"), F.struct("n_tokens", "path")).alias("s")).select("s.*").where("path is not null")
    declared = log.where("corpus is not null").select("run", F.col("corpus").alias("label")).distinct()
    seen = tokens_processed(log).join(declared, "run").groupBy("label").agg(F.sum("tokens_seen").alias("seen"))
    share = coverage(F.col("seen").cast("double"), F.col("n_tokens"))
    return largest.join(seen, "label", "left").withColumn("coverage", F.when(F.col("seen") > 0, share)).withColumn("never_read", F.col("n_tokens") * (1 - F.col("coverage")))


def last_steps(paths: DataFrame) -> DataFrame:
    """(run, step): the furthest step by the names ``.../<run>/checkpoints/step-<digits>.pt`` of ``paths`` (path); others are passed over."""
    named = paths.select(F.regexp_extract("path", r"([^/]+)/checkpoints/step-[^/]*\.pt$", 1).alias("run"), F.regexp_extract("path", r"/step-(?:[^/]*-)?([0-9]+)\.pt$", 1).alias("step"))
    return named.where("run <> ''").groupBy("run").agg(F.coalesce(F.max(F.when(F.col("step") != "", F.col("step").cast("bigint"))), F.lit(0)).alias("step"))
