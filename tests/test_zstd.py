from __future__ import annotations

import json

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from millrace.sources import SOURCES, sinks, to_json, zstd_lines


@pytest.fixture
def docs(spark):
    rows = [(f"t:{i}", f"été numéro {i}   suite\nligne " + "é" * (i % 50) + str(hash(str(i))) * 3, f"s{i % 3}", "fr", {"i": str(i)} if i % 2 else {}) for i in range(600)]
    return spark.createDataFrame(rows, "id string, text string, source string, lang string, meta map<string,string>").repartition(2)


def files(path):
    return sorted(p for p in path.iterdir() if p.name.endswith(".zst"))


def test_round_trip_rotation_and_other_readers(spark, docs, tmp_path):
    out = tmp_path / "shards"
    totals = sinks.write_shards(docs, str(out), format="zstd", max_bytes=4000)
    assert {r["source"]: r["documents"] for r in totals.collect()} == {"s0": 200, "s1": 200, "s2": 200}
    assert sorted(map(tuple, SOURCES.get("shards")(spark, path=str(out), format="zstd").drop("ord").collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    found = files(out)
    assert [p.name for p in found] == [f"part-{i:05d}.jsonl.zst" for i in range(len(found))] and len(found) > 5
    assert not (out / "_temporary").exists() and (out / "_SUCCESS").exists()
    # Each file but the last of a task has reached the bound, and exceeds it by less than a document.
    longest = max(len(r["value"].encode()) for r in to_json(docs).collect()) + 64
    sizes = [p.stat().st_size for p in found]
    assert max(sizes) < 4000 + longest and sum(s < 4000 for s in sizes) <= 2
    # Plain zstd and DuckDB read the same documents.
    lines = [json.loads(line) for p in found for line in zstandard.ZstdDecompressor().stream_reader(p.open("rb")).read().decode().split("\n") if line]
    assert {x["id"]: x["text"] for x in lines} == {r["id"]: r["text"] for r in docs.collect()}
    rows = duckdb.sql(f"SELECT id, text, source FROM read_json('{out}/*.jsonl.zst', format='newline_delimited', compression='zstd')").fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in docs.select("id", "text", "source").collect())


def test_documents_bound_append_and_overwrite(spark, docs, tmp_path):
    out = tmp_path / "shards"
    one = docs.coalesce(1)
    sinks.write_shards(one.limit(35), str(out), format="zstd", max_documents=10)
    assert [len(zstandard.ZstdDecompressor().stream_reader(p.open("rb")).read().splitlines()) for p in files(out)] == [10, 10, 10, 5]
    sinks.write_shards(one.limit(5), str(out), format="zstd", mode="append")
    assert len(files(out)) == 5 and files(out)[-1].name == "part-00004.jsonl.zst"
    sinks.write_shards(one.limit(7), str(out), format="zstd")
    assert len(files(out)) == 1 and SOURCES.get("shards")(spark, path=str(out), format="zstd").count() == 7
    sinks.write_shards(one.where("false"), str(out), format="zstd")
    assert SOURCES.get("shards")(spark, path=str(out), format="zstd").count() == 0


def test_bad_lines_are_left_out(spark, tmp_path):
    good = [json.dumps({"id": f"a:{i}", "text": f"très long {i}", "source": "a"}, ensure_ascii=False).encode() for i in range(4)]
    raw = b"\n".join([good[0], b"", b"{broken", good[1], b'{"id": "x"}', b"\xff\xfe", b"   ", good[2], good[3]])
    (tmp_path / "part-00000.jsonl.zst").write_bytes(zstandard.compress(raw))
    got = SOURCES.get("shards")(spark, path=str(tmp_path), format="zstd").collect()
    assert sorted((r["id"], r["text"], r["lang"], r["meta"]) for r in got) == [(f"a:{i}", f"très long {i}", "unknown", {}) for i in range(4)]


@pytest.mark.parametrize("every", [1, 7, 50, 10_000])
def test_frames_of_large_files_are_read_apart(spark, tmp_path, every):
    """Lines that end with a frame, cross frames, or are longer than one are read once."""
    lines = [f"{i}:" + "x" * (i * 37 % 90) for i in range(120)] + ["y" * 5000] + [str(i) for i in range(20)]
    raw = "\n".join(lines).encode()
    cut = [raw[i : i + every * 10] for i in range(0, len(raw), every * 10)]
    skip = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    path = tmp_path / "part-00000.jsonl.zst"
    path.write_bytes(skip + b"".join(zstandard.ZstdCompressor(write_checksum=k % 2 == 0).compress(c) for k, c in enumerate(cut)))
    with path.open("rb") as f:
        found = list(zstd_lines.frames(f, path.stat().st_size))
    assert len(found) == len(cut) + 1 and sum(n for _, n in found) == path.stat().st_size
    zstd_lines.register(spark)
    read = spark.read.format("zstd_lines").option("split_bytes", 60).load(str(path))
    assert sorted(r["value"] for r in read.collect()) == sorted(lines)


def test_failed_tasks_leave_nothing(spark, docs, tmp_path):
    out = tmp_path / "shards"
    sinks.write_shards(docs.limit(10), str(out), format="zstd")
    before = [p.name for p in files(out)]
    broken = docs.withColumn("text", F.when(F.col("id") == "t:77", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        sinks.write_shards(broken, str(out), format="zstd")
    assert [p.name for p in files(out)] == before and not (out / "_temporary").exists()
    assert SOURCES.get("shards")(spark, path=str(out), format="zstd").count() == 10
