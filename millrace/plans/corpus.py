"""The corpus build: sources, cleaning, deduplication, mixture plan, assembly, novelty, report."""

from __future__ import annotations

import inspect
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dedup, filters, mixture, novelty
from millrace.plans.config import check_keys, derive_seed
from millrace.plans.storage import Artifact, materialize, scratch
from millrace.sources import SOURCES, sinks

KEYS = {"label", "seed", "sources", "filters", "dedup", "mixture", "novelty"}


def collect(spark: SparkSession, config: dict[str, Any]) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of the sources with ``source_ord`` and their chain's ``reject_step``; and what failed, by label.

    A source that fails leaves nothing behind; the others go on.
    """
    chains = {name: filters.build(specs) for name, specs in config.get("filters", {}).items()}
    out: DataFrame | None = None
    failed: dict[str, str] = {}
    for i, spec in enumerate(config["sources"]):
        spec = dict(spec)
        label, chain, weight = spec["label"], spec.pop("chain", None), spec.pop("weight", None)
        del weight
        if chain is not None and chain not in chains:
            raise KeyError(f"unknown chain {chain!r}; there are {', '.join(sorted(chains))}")
        try:
            name = spec.pop("name")
            if "seed" in inspect.signature(SOURCES.get(name)).parameters:
                spec.setdefault("seed", derive_seed(config.get("seed", 1337), "source", label))
            # Read inside the try: most sources fail when they are read, not when they are planned.
            rows = materialize(SOURCES.get(name)(spark, **spec).withColumn("source_ord", F.lit(i)), "source")
        except Exception as e:  # noqa: BLE001 - any source may fail in its own way; the report says so
            failed[label] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        rows = filters.apply(rows, chains[chain] if chain else [])
        out = rows if out is None else out.unionByName(rows)
    return out, failed


def build(spark: SparkSession, root: str, config: dict[str, Any], force: bool = False) -> Artifact:
    """Build the corpus unless it is complete already; the artifact holds ``corpus``, ``documents`` and the report."""
    check_keys(config, KEYS)
    if not config.get("sources"):
        raise ValueError("a corpus needs a source")
    artifact = Artifact(spark, root, "corpora", config["label"], config)
    if artifact.complete() and not force:
        return artifact
    with scratch(spark):
        return _build(spark, artifact, config)


def _build(spark: SparkSession, artifact: Artifact, config: dict[str, Any]) -> Artifact:
    rows, failed = collect(spark, config)
    if rows is None:
        raise ValueError(f"every source failed: {failed}")
    rows = artifact.write("cleaned", rows)
    # One key that carries the order over all sources.
    kept = rows.where("reject_step is null").withColumn("doc_id", F.format_string("%06d:%s", "source_ord", F.concat_ws("\0", "ord", "id")))
    spec = config.get("dedup", {"enabled": True})
    if spec.get("enabled", True):
        judged = dedup.deduplicate(kept, **{k: v for k, v in spec.items() if k != "enabled"}, seed=config.get("seed", 1337))
    else:
        judged = kept.withColumn("verdict", F.lit("kept"))
    judged = artifact.write("judged", judged)
    documents = artifact.write("documents", judged.where("verdict = 'kept'").drop("verdict", "reject_step"), compression="zstd")
    measured = {r["source"]: r["tokens"] for r in mixture.available(documents).collect()}  # a row per source
    mix = config.get("mixture", {})
    weights = {s["label"]: s.get("weight", 1.0) for s in config["sources"] if s["label"] not in failed}
    plans = mixture.plan(measured, weights, mix.get("total_tokens") or sum(measured.values()), mix.get("max_repeats", 1.0), mix.get("redistribute", True))
    planned = artifact.write("plan", mixture.plan_table(spark, plans))
    corpus = artifact.write("corpus", mixture.assemble(documents, planned, strict_repeats=mix.get("strict_repeats", False), seed=config.get("seed", 1337), drawn=True), compression="zstd")
    novelty.remember(artifact, corpus)
    report: dict[str, Any] = {
        "failed_sources": failed,
        "rejected": [r.asDict() for r in filters.rejections(rows).collect()],
        "dedup": dedup.stats(judged).first().asDict(),
        "mixture": [r.asDict() for r in planned.collect()],
        "corpus": [r.asDict() for r in mixture.available(corpus).collect()],
    }
    if others := config.get("novelty", {}).get("against"):
        limit = config["novelty"].get("limit")  # all documents, unless a limit is asked for
        mine = novelty.fingerprints(corpus, limit=limit)
        theirs = None
        for name, path in others.items():
            part = novelty.fingerprints(spark.read.parquet(path), limit=limit).withColumn("artifact", F.lit(name))
            theirs = part if theirs is None else theirs.unionByName(part)
        report["novelty"] = [r.asDict() for r in novelty.overlaps(mine, theirs).collect()]
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, default=str),)], "report string").coalesce(1).write.mode("overwrite").text(f"{artifact.path}/report")
    artifact.commit(documents=sum(r["documents"] for r in report["corpus"]))
    return artifact


__all__ = ["build", "collect", "sinks"]
