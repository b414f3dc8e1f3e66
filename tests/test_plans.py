from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace import streaming
from millrace.plans import config, corpus, storage
from millrace.plans.registry import Registry
from millrace.sources import SOURCES, hash_split, sinks


def test_config(tmp_path):
    (tmp_path / "base.toml").write_text('a = 1\nlist = [1, 2]\n[t]\nx = 1\ny = "${HERE:-there}"\n')
    (tmp_path / "own.toml").write_text('extends = "base.toml"\nlist = [3]\n[t]\nx = 2\n')
    got = config.load(tmp_path / "own.toml", ["t.z=[1]", "name=plain text"], env={"HERE": ""})
    assert got == {"a": 1, "list": [3], "t": {"x": 2, "y": "there", "z": [1]}, "name": "plain text"}
    (tmp_path / "loop.toml").write_text('extends = "loop.toml"\n')
    with pytest.raises(ValueError, match="extends itself"):
        config.load(tmp_path / "loop.toml")
    with pytest.raises(KeyError):
        config.expand("${NOT_SET_AT_ALL}", {})
    with pytest.raises(ValueError, match="unknown keys"):
        config.check_keys({"tpyo": 1}, {"typo"})
    assert config.derive_seed(1, "a") == config.derive_seed(1, "a") != config.derive_seed(1, "b")
    assert storage.config_hash({"a": 1, "b": 2}) == storage.config_hash({"b": 2, "a": 1})


def test_registry():
    made: Registry[int] = Registry("thing")
    made.register("one", "uno")(lambda: 1)
    assert made.build("uno") == 1 and made.build({"name": "one"}) == 1
    with pytest.raises(ValueError):
        made.register("uno")(lambda: 2)
    with pytest.raises(KeyError, match="did you mean 'one'"):
        made.get("onne")


def test_sources_and_sinks(spark, tmp_path):
    vault = tmp_path / "vault"
    (vault / "sub").mkdir(parents=True)
    (vault / "Templates").mkdir()
    for name in ("a.md", "sub/b é.md", "Templates/t.md"):
        (vault / name).write_text("---\nx: 1\n---\n" + "mot [[Lien|libre]] " * 20)
    (vault / "short.md").write_text("court")
    got = SOURCES.build({"name": "obsidian"}, spark=spark, label="n", vault=str(vault)).collect()
    assert {r["id"] for r in got} == {"n:a.md", "n:sub/b é.md"} and all("[[" not in r["text"] for r in got)
    split = {s: {r["id"] for r in SOURCES.build("notes", spark=spark, label="n", vault=str(vault), split=s, val_fraction=0.5).collect()} for s in ("train", "val")}
    assert split["train"] | split["val"] == {r["id"] for r in got} and not split["train"] & split["val"]
    books = tmp_path / "books"
    books.mkdir()
    (books / "x.txt").write_text("*** START OF THE PROJECT GUTENBERG EBOOK ***\nCHAPITRE I\n" + "mot " * 150 + "\nCHAPITRE II\ncourt\nCHAPITRE III\n" + "mot " * 150 + "\n*** END OF THE PROJECT GUTENBERG EBOOK ***")
    ids = [r["id"] for r in SOURCES.build("gutenberg", spark=spark, label="b", root=str(books)).orderBy("ord").collect()]
    assert ids == ["b:x#0", "b:x#2"]
    rows = spark.createDataFrame([(f"s:{i}", f"texte é {i}", "s", "fr", {"k": "v"}) for i in range(35)], "id string, text string, source string, lang string, meta map<string,string>")
    totals = sinks.write_shards(rows, str(tmp_path / "out"), max_documents=10, format="json").first()
    assert (totals["documents"], totals["words"]) == (35, 105)
    (tmp_path / "out" / "part-bad.json").write_text('{"id": "x"}\nnot json\n')
    back = SOURCES.build("shards", spark=spark, path=str(tmp_path / "out"), format="json", label="other")
    assert back.count() == 35 and {r["source"] for r in back.collect()} == {"other"}
    with pytest.raises(ValueError, match="no document"):
        SOURCES.build("hf", spark=spark, label="e", dataset=str(tmp_path / "out"), format="json", text_field="missing")
    share = spark.range(4000).select(hash_split(F.col("id").cast("string"), 0.15).alias("v")).agg(F.avg(F.col("v").cast("double"))).first()[0]
    assert 0.12 < share < 0.18


def test_corpus_build(spark, tmp_path):
    base = " ".join(f"mot{i}" for i in range(80))
    rows = [(i, f"{base} {i} " + " ".join(f"x{i}_{j}" for j in range(120))) for i in range(20)] + [(90, "court"), (91, f"{base} 0 " + " ".join(f"x0_{j}" for j in range(120)))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    spec = {
        "label": "c",
        "sources": [
            {"name": "hf", "label": "a", "dataset": str(tmp_path / "in"), "chain": "main"},
            {"name": "hf", "label": "broken", "dataset": str(tmp_path / "missing")},
        ],
        "filters": {"main": [{"name": "normalize"}, {"name": "word_count", "min_words": 10}]},
        "novelty": {"against": {"itself": str(tmp_path / "in")}},
    }
    made = corpus.build(spark, str(tmp_path / "root"), spec)
    report = json.loads(spark.read.text(f"{made.path}/report").first()[0])
    assert made.complete() and list(report["failed_sources"]) == ["broken"]
    assert report["dedup"]["exact"] == 1 and {"source": "a", "reject_step": "word_count", "n": 1} in report["rejected"]
    assert made.read("documents").count() == report["dedup"]["kept"]
    assert report["novelty"][0]["overlap"] > 0.9
    assert corpus.build(spark, str(tmp_path / "root"), spec).meta() == made.meta()
    with pytest.raises(ValueError):
        corpus.build(spark, str(tmp_path / "root"), {"label": "c", "sources": []})


def test_streams(spark, tmp_path):
    schema = "id string, text string, source string, lang string, meta map<string,string>"
    words = " ".join(f"mot{i}" for i in range(100))

    def put(n, texts):
        spark.createDataFrame([(f"{n}-{i}", t, "s", "fr", None) for i, t in enumerate(texts)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    put(0, [words, words.upper(), "autre texte " + " ".join(f"b{i}" for i in range(60))])
    run = lambda: streaming.ingest(streaming.unique(streaming.documents(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    put(1, [words, "neuf " + " ".join(f"c{i}" for i in range(60))])
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    streaming.near_unique(streaming.documents(spark, str(tmp_path / "in"), max_files=1), str(tmp_path / "near"), str(tmp_path / "cp2"), bands=16, rows=4).awaitTermination()
    kept = spark.read.option("recursiveFileLookup", "true").parquet(*[str(p) for p in (tmp_path / "near").glob("batch=*/docs")])
    assert kept.count() == 3


def test_shared_folder_without_a_setting(spark, monkeypatch):
    class Unset:
        def __init__(self):
            self.conf = self

        def get(self, name, default=None):
            return default

    assert storage.shared_dir(Unset()) == storage.shared_dir(Unset())
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_shared_folder_of_a_cluster_must_be_named():
    class Cluster:
        master, named = "spark://host:7077", None

        def __init__(self):
            self.conf = self.sparkContext = self

        def get(self, name, default=None):
            return default

        def getCheckpointDir(self):  # noqa: N802
            return self.named

    session = Cluster()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session)
    session.named = "hdfs:/shared"
    assert storage.shared_dir(session) == "hdfs:/shared"
    session.named, session.master = None, "local[4]"
    assert storage.shared_dir(session)


def test_tables_are_removed_when_done(spark):
    rows = spark.range(5)
    with storage.scratch(spark):
        first = storage.materialize(rows, "one")
        second = storage.materialize(first, "two", instead_of=first)
        assert not Path(first.table_path).exists() and second.count() == 5
    assert not Path(second.table_path).exists()


def test_overrides_replace_levels_that_are_no_tables():
    got = {"a": 1, "b": {"c": 2, "d": 3}}
    after = config.override(config.override(got, "a.x.y=5"), "b.c={z = 1}")
    assert after == {"a": {"x": {"y": 5}}, "b": {"c": {"z": 1}, "d": 3}} and got == {"a": 1, "b": {"c": 2, "d": 3}}
    assert config.override({}, "a.b = [1, 2]") == {"a": {"b": [1, 2]}} and config.override({}, "a=b c") == {"a": "b c"}
    assert config.override({}, 'a={x="=1"}') == {"a": {"x": "=1"}} and config.override({"t": {"u": 1}}, "t={v=2}") == {"t": {"v": 2}}
    assert config.override({}, 'a.b=it\'s "so"') == {"a": {"b": 'it\'s "so"'}}
    for bad in ("a", "=1", " = 2"):
        with pytest.raises(ValueError, match="key=value"):
            config.override({}, bad)


def test_a_source_that_fails_when_it_is_read_fails_alone(spark, tmp_path):
    spark.createDataFrame([("1", "bon texte")], "id string, text string").write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_bytes((next((tmp_path / "good").glob("*.parquet"))).read_bytes()[:-200] + b"x" * 192 + b"\x20\x00\x00\x00PAR1")
    spec = {"sources": [{"name": "hf", "label": "bad", "dataset": str(tmp_path / "bad")}, {"name": "hf", "label": "good", "dataset": str(tmp_path / "good")}]}
    rows, failed = corpus.collect(spark, spec)
    assert list(failed) == ["bad"] and [r["source"] for r in rows.collect()] == ["good"]
