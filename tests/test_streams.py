from __future__ import annotations

import random

import pytest

from millrace import streaming
from millrace.functions import text as T
from millrace.operators import dedup

SCHEMA = "doc_id bigint, text string, note string"


def arrivals():
    """Four batches of (doc_id, text): copies and near copies within and across them, ids repeated and null."""
    rng = random.Random(11)
    base = [" ".join(f"m{k}x{rng.randrange(10**6)}" for _ in range(120)) for k in range(6)]
    near = lambda t, w: t + " " + w
    return [
        [(1, base[0]), (2, near(base[0], "fin")), (3, base[1]), (4, "court"), (4, "court"), (None, base[2])],
        [(5, base[0].upper()), (6, near(base[1], "suite")), (7, base[3]), (7, near(base[3], "un")), (8, "Court  ")],
        [(9, base[4]), (10, near(base[3], "deux")), (None, near(base[2], "z")), (None, None)],
        [(11, near(base[4], "a")), (12, base[5]), (13, near(base[5], "b")), (14, None), (15, near(base[0], "fin x"))],
    ]


def expected(spark, batches):
    """What a fold over all rows in order keeps."""
    rows = [(b, i, t) for b, own in enumerate(batches) for i, t in own]
    frame = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(rows)], "doc_id bigint, text string")
    keys = {r["doc_id"]: set(r["keys"]) for r in dedup.band_keys(frame).collect()}
    prints = {r["doc_id"]: r["fp"] for r in frame.select("doc_id", T.fingerprint(frame["text"]).alias("fp")).collect()}
    places = {r["doc_id"]: r["p"] for r in frame.select("doc_id", dedup.row_place().alias("p")).collect()}
    met, kept = set(), []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0], rows[k][1] is not None, rows[k][1] or 0, places[k]["h1"], places[k]["h2"]))
    for k in order:
        own = keys[k] | {("fp", prints[k] or "")}
        if not met & own:
            met |= own
            kept.append(rows[k][1:])
    return sorted(kept, key=str)


@pytest.fixture
def feed(spark, tmp_path):
    def put(k, rows):
        spark.createDataFrame([(i, t, "n") for i, t in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")

    return put


def kept(spark, path):
    return sorted((tuple(r) for r in spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*[str(p) for p in path.glob("out/batch=*/docs")]).select("doc_id", "text").collect()), key=str)


def run(spark, path, read=None):
    docs = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    streaming.near_unique(docs, f"{path}/out", f"{path}/check", read=read).awaitTermination()


def test_stream_of_near_copies_equals_the_fold(spark, tmp_path, feed):
    batches, read = arrivals(), []
    for k, rows in enumerate(batches):
        feed(k, rows)
        run(spark, tmp_path, read)
    assert kept(spark, tmp_path) == expected(spark, batches)
    # What a batch reads is its own keys and those kept just before, not the history.
    most = max(len(b) for b in batches) * 17
    assert len(read) == 4 and all(n <= 2 * most for n in read)
    run(spark, tmp_path, read)  # nothing new
    assert len(read) == 4


def test_a_batch_that_failed_half_way_is_run_again(spark, tmp_path, feed, monkeypatch):
    batches, whole = arrivals(), dedup.greedy
    for k, rows in enumerate(batches):
        feed(k, rows)
        if k in (1, 2):
            # Batch 1 fails before its verdicts, batch 2 when its keys are registered already.
            at = "greedy" if k == 1 else "remove"
            owner = dedup if k == 1 else streaming

            def broken(*_, **__):
                raise RuntimeError("lost")

            with monkeypatch.context() as m:
                m.setattr(owner, at, broken)
                with pytest.raises(Exception, match="lost"):
                    run(spark, tmp_path)
        run(spark, tmp_path)
    assert dedup.greedy is whole
    assert kept(spark, tmp_path) == expected(spark, batches)
