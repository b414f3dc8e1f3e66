"""Intermediate tables in the folder that driver and executors share, and artifacts with a commit marker."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import UTC, datetime
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or else the checkpoint folder of the context; on one machine a temporary folder of this process.

    On a cluster executors would each write to a disk of their own there, so without a folder this raises.
    """
    context = getattr(spark, "sparkContext", None)
    named = spark.conf.get("spark.checkpoint.dir", None) or (context and context.getCheckpointDir())
    if named:
        return named
    if context and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="millrace-")


def materialize(df: DataFrame, tag: str, instead_of: DataFrame | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors.

    ``instead_of``: a table of an earlier round that nothing reads any more once this one is written; it is removed.
    ``options`` are those of Spark's Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/millrace-{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    for kept in _scopes.get():
        kept.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    if instead_of is not None:
        remove(spark, instead_of.table_path)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path, wherever Spark finds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark finds it; nothing happens if it is gone."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: The scopes that are open here; another thread's tables are no business of theirs.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, the tables that were materialised inside; for work whose results are written elsewhere."""
    own: list[str] = []
    before = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in own:
            remove(spark, path)


def config_hash(config: Any) -> str:
    """First 8 hex digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()[:8]


class Artifact:
    """A directory ``<root>/<stage>/<label>-<hash>``; complete once its ``meta`` table is there, which is written last.

    All files go through Spark, so the root may be in any store that Spark reads.
    """

    def __init__(self, spark: SparkSession, root: str, stage: str, label: str, config: Any) -> None:
        self.spark, self.stage, self.label, self.hash = spark, stage, label, config_hash(config)
        self.path = f"{root.rstrip('/')}/{stage}/{label}-{self.hash}"
        self._config = config

    def complete(self) -> bool:
        return exists(self.spark, f"{self.path}/meta/_SUCCESS")

    def write(self, name: str, df: DataFrame, **options: Any) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def commit(self, **meta: Any) -> None:
        row = {"stage": self.stage, "label": self.label, "hash": self.hash, "completed_at": datetime.now(UTC).isoformat(timespec="milliseconds"), **meta}
        self.spark.createDataFrame([(json.dumps(row, ensure_ascii=False, default=str), json.dumps(self._config, default=str))], "meta string, config string").coalesce(1).write.mode("overwrite").json(f"{self.path}/meta")

    def meta(self) -> dict[str, Any]:
        return json.loads(self.spark.read.json(f"{self.path}/meta").first()["meta"])


def latest(catalog: DataFrame, label: str) -> DataFrame:
    """The path of the newest complete artifact of a label; ``catalog`` has label, path, complete and completed_at."""
    return catalog.where((F.col("label") == label) & F.col("complete")).agg(F.max_by("path", F.struct("completed_at", "path")).alias("path"))


def artifacts(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """(label, hash, path, complete, completed_at) of every artifact of a stage: a row per folder ``label-hash``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{stage}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for found in files.listStatus(at) if files.exists(at) else ():
        label, _, digest = found.getPath().getName().rpartition("-")
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{found.getPath().toString()}/meta/_SUCCESS")
        if found.isDirectory() and label:
            done = files.exists(mark)
            rows.append((label, digest, found.getPath().toString(), done, files.getFileStatus(mark).getModificationTime() if done else None))
    return spark.createDataFrame(rows, "label string, hash string, path string, complete boolean, completed_at bigint")


def newest(spark: SparkSession, root: str, stage: str, label: str) -> str:
    """The path of the newest complete artifact of a label; none raises."""
    path = latest(artifacts(spark, root, stage), label).first()["path"]
    if path is None:
        raise FileNotFoundError(f"no complete artifact {label!r} of stage {stage!r} in {root}")
    return path
