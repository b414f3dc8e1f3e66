"""What a scheduler calls: a collection a day, and stages one after the other within a budget of time."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date
from typing import Any

from pyspark.sql import SparkSession

from millrace.plans import corpus
from millrace.plans.config import derive_seed
from millrace.plans.storage import Artifact


def daily(spark: SparkSession, root: str, config: dict[str, Any], day: date) -> Artifact:
    """The collection of a day: labelled and seeded by the date, so calling again on the same day finds it complete."""
    dated = {**config, "label": f"{config['label']}-{day:%Y%m%d}", "seed": derive_seed(config.get("seed", 1337), day.isoformat())}
    return corpus.build(spark, root, dated)


def chain(stages: list[tuple[str, Callable[[], Any]]], seconds: float | None = None, clock: Callable[[], float] = time.monotonic) -> dict[str, str]:
    """Run stages in order: done, failed (with what it raised) or skipped, which is all after a failure or beyond the budget.

    A stage under way is finished, however long it takes.
    """
    began, told, stopped = clock(), {}, False
    for name, stage in stages:
        if stopped or (seconds is not None and clock() - began >= seconds):
            told[name] = "skipped"
            continue
        try:
            stage()
            told[name] = "done"
        except Exception as e:  # noqa: BLE001 - the report says what failed
            told[name], stopped = f"failed: {type(e).__name__}: {str(e)[:200]}", True
    return told
