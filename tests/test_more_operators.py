from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace import streaming
from millrace.functions import frames
from millrace.operators import dedup, evaluation, filters, mixture, novelty, ops, retrieval, tokenizer, tokens
from millrace.plans import config, corpus, schedule, storage
from millrace.sources import SOURCES, from_json, peek, shard_paths, sinks, synthetic_tokens, to_json


def test_exact_copies_among_repeated_rows(spark):
    rows = [(1, "t x", "a"), (1, "t x", "a"), (2, "T  x", "a"), (3, None, "b"), (3, None, "b"), (4, "", "c"), (5, "u", "d")] + [(9, "hot", "e")] * 40
    docs = spark.createDataFrame(rows, "doc_id int, text string, __hit string").repartition(3)
    got = dedup.exact(docs).collect()
    assert sorted((r["doc_id"], r["exact_copy"]) for r in got) == sorted([(1, False), (1, True), (2, True), (3, False), (3, True), (4, False), (5, False), (9, False)] + [(9, True)] * 39)
    assert {r["__hit"] for r in got} == set("abcde")
    assert dedup.exact(docs.where("false")).count() == 0


def test_greedy_rounds_by_brute_force(spark):
    import random

    rng = random.Random(3)
    for _ in range(3):
        keys = {i: [rng.randrange(60) for _ in range(rng.randrange(4))] for i in range(80)}
        keys |= {100 + i: [1000 + i, 1001 + i] for i in range(15)}  # a chain
        seen, dropped = set(), []
        for i, own in sorted(keys.items()):
            if seen & set(own):
                dropped.append(i)
            else:
                seen |= set(own)
        frame = spark.createDataFrame([(i, i, k) for i, k in keys.items()], "doc_id int, ord int, keys array<bigint>")
        assert sorted(r[0] for r in dedup.greedy(frame).collect()) == dropped


def test_prefix_sums_with_repeated_keys_and_ranges(spark):
    rows = [("a" if i % 3 else None, i // 2, i) for i in range(100)]
    got = mixture.running(spark.createDataFrame(rows, "g string, k int, v bigint"), ["g"], ["k"], "v", "before", per_range=7).collect()
    for g in ("a", None):
        own = sorted((r["before"], r["v"], r["k"]) for r in got if r["g"] == g)
        assert [b for b, _, _ in own] == [sum(v for _, v, _ in own[:k]) for k in range(len(own))]
        assert [k for _, _, k in own] == sorted(k for _, _, k in own)


def test_documents_as_json(spark):
    docs = [("a:1", "é \"x\"\n", "a", "fr", {"k": "v"}), ("a:2", "", "a", "en", {})]
    frame = spark.createDataFrame(docs, "id string, text string, source string, lang string, meta map<string,string>")
    lines = [r["value"] for r in to_json(frame).collect()]
    assert json.loads(lines[0]) == {"id": "a:1", "text": "é \"x\"\n", "source": "a", "lang": "fr", "meta": {"k": "v"}}
    assert "meta" not in json.loads(lines[1]) and "é" in lines[0]
    assert [tuple(r) for r in from_json(to_json(frame)).orderBy("id").collect()] == docs
    more = spark.createDataFrame([('{"id": "b", "text": "t", "source": "s"}',), ("{bad",), ('{"id": "c"}',)], "value string")
    assert [tuple(r) for r in from_json(more).collect()] == [("b", "t", "s", "unknown", {})]


def test_artifacts_are_found_by_label(spark, tmp_path):
    def source(name, n):
        spark.createDataFrame([(str(i), f"{name} texte numéro {i}") for i in range(n)], "id string, text string").write.parquet(str(tmp_path / name))
        return {"name": "hf", "label": name, "dataset": str(tmp_path / name)}

    root = str(tmp_path / "root")
    spec = {"dedup": {"enabled": False}}
    old = corpus.build(spark, root, {**spec, "label": "c", "sources": [source("a", 4)]})
    new = corpus.build(spark, root, {**spec, "label": "c", "sources": [source("b", 6)]})
    other = corpus.build(spark, root, {**spec, "label": "c-d", "sources": [{"name": "hf", "label": "b", "dataset": str(tmp_path / "b")}]})
    (tmp_path / "root" / "corpora" / "c-ffffffff").mkdir()
    listed = {r["path"].rpartition("/")[2]: r["complete"] for r in storage.artifacts(spark, root, "corpora").collect()}
    assert listed == {old.path.rpartition("/")[2]: True, new.path.rpartition("/")[2]: True, other.path.rpartition("/")[2]: True, "c-ffffffff": False}
    assert storage.newest(spark, root, "corpora", "c").endswith(new.path.rpartition("/")[2])
    with pytest.raises(FileNotFoundError):
        storage.newest(spark, root, "corpora", "none")
    rows = SOURCES.get("shards")(spark, artifact="c", root=root, source="documents", label="again")
    assert rows.count() == 6 and {r["source"] for r in rows.collect()} == {"again"}
    with pytest.raises(ValueError):
        SOURCES.get("shards")(spark)
    found = {r["artifact"]: r["overlap"] for r in novelty.compare_to_existing(new.read("corpus"), root, exclude=new.path).collect()}
    assert found == {f"c-{old.hash}": 0.0, f"c-d-{other.hash}": 1.0}
    assert novelty.worst(novelty.compare_to_existing(new.read("corpus"), str(tmp_path / "none"))).first()["overlap"] is None
    assert [r["ord"] for r in peek(rows, 2).collect()] == sorted(r["ord"] for r in rows.collect())[:2]
    files = shard_paths(spark, f"{new.path}/corpus").collect()
    assert files and all(r["path"].endswith(".parquet") and r["bytes"] > 0 for r in files)


def test_daily_collections_and_chains(spark, tmp_path):
    spark.createDataFrame([("1", "un texte")], "id string, text string").write.parquet(str(tmp_path / "a"))
    spec = {"label": "jour", "sources": [{"name": "hf", "label": "a", "dataset": str(tmp_path / "a")}], "dedup": {"enabled": False}}
    one, again, next_day = (schedule.daily(spark, str(tmp_path / "r"), spec, date(2024, 1, d)) for d in (1, 1, 2))
    assert one.path == again.path != next_day.path and one.meta()["completed_at"] == again.meta()["completed_at"]
    ran, now = [], iter([0, 0, 1, 5, 9])
    told = schedule.chain([("a", lambda: ran.append("a")), ("b", lambda: ran.append("b")), ("c", lambda: ran.append("c"))], seconds=4, clock=lambda: next(now))
    assert ran == ["a", "b"] and told == {"a": "done", "b": "done", "c": "skipped"}
    told = schedule.chain([("a", lambda: 1 / 0), ("b", lambda: ran.append("never"))])
    assert told["a"].startswith("failed: ZeroDivisionError") and told["b"] == "skipped" and "never" not in ran


def test_synthetic_tokens_follow_the_signal(spark):
    rows = {r["i"]: r["ids"] for r in synthetic_tokens(spark, 200, 50, vocab=16).collect()}
    assert len(rows) == 200 and all(len(ids) == 50 and 0 <= min(ids) <= max(ids) < 16 for ids in rows.values())
    pairs = [p for ids in rows.values() for p in zip(ids, ids[1:], strict=False)]
    follow = {}
    for a, b in pairs:
        follow.setdefault(a, []).append(b)
    top = sum(max(x.count(b) for b in set(x)) for x in follow.values()) / len(pairs)
    assert 0.78 < top < 0.85
    assert rows == {r["i"]: r["ids"] for r in synthetic_tokens(spark, 200, 50, vocab=16).repartition(7).collect()}
    assert [len(r["ids"]) for r in synthetic_tokens(spark, 2, 1).collect()] == [1, 1]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(f"s:{i}", "mot " * 250, "s") for i in range(35)], "id string, text string, source string").coalesce(1)
    told = sinks.write_shards(docs, str(tmp_path / "shards"), max_bytes=10_000).first()
    assert (told["documents"], told["words"]) == (35, 35 * 250) and shard_paths(spark, str(tmp_path / "shards")).count() == 4
    sinks.append_metrics(spark.createDataFrame([(1, 2.0)], "step int, loss double"), str(tmp_path / "log"), run="r1", seed=7)
    point = spark.read.json(str(tmp_path / "log")).first()
    assert (point["run"], point["seed"], point["step"]) == ("r1", 7, 1) and point["t"]
    assert sinks.token_type(32_768) == "smallint" and sinks.token_type(32_769) == "int"
    passages = spark.createDataFrame([("p1", "chats noirs", "n1", "jardin"), ("p2", "chiens", "n2", "chats")], "id string, text string, source string, title string")
    sinks.write_index(passages, str(tmp_path / "index"), title_weight=3, k1=1.2)
    postings, lengths, kept = sinks.read_index(spark, str(tmp_path / "index"))
    assert {(r["term"], r["id"]): r["tf"] for r in postings.collect()}["chats", "p2"] == 3 and kept == {"k1": 1.2, "b": 0.75}
    assert {r["id"]: r["dl"] for r in lengths.collect()} == {"p1": 5, "p2": 4}


def test_corpus_is_tokenized_and_packed(spark, tmp_path):
    docs = spark.createDataFrame([(i, "l'eau claire " * (i + 1)) for i in range(5)], "doc_id int, text string")
    codec = tokenizer.Codec(tokenizer.train(tokenizer.frequencies(docs), vocab_size=290))
    told = tokenizer.tokenize_corpus(docs, codec, str(tmp_path / "tokens"), tokens_per_shard=10).first()
    stored = spark.read.parquet(str(tmp_path / "tokens")).orderBy("start").collect()
    assert told["n_documents"] == 5 and told["n_tokens"] == sum(len(r["ids"]) for r in stored) and all(r["ids"][-1] == tokenizer.EOT for r in stored)
    assert [r["start"] for r in stored] == [sum(len(x["ids"]) for x in stored[:k]) for k in range(5)]
    assert tokenizer.service_ids() == list(range(18))


def test_fine_tuning_sets(spark):
    examples = spark.createDataFrame([(1, [5, 6], [7]), (2, [5] * 4, [7])], "doc_id int, question array<int>, answer array<int>")
    replay = spark.createDataFrame([(3, [8, 9]), (4, [8] * 9)], "doc_id int, ids array<int>")
    got = {r["doc_id"]: (r["ids"], r["mask"]) for r in tokens.sft(examples, replay, max_tokens=5, eot=0).collect()}
    assert got == {1: ([5, 6, 7, 0], [0, 0, 1, 1]), 3: ([8, 9, 0], [1, 1, 1]), 4: ([8] * 5, [1] * 5)}
    with pytest.raises(IndexError):
        tokens.windows(tokens.pack(replay), spark.createDataFrame([(0, 9)], "i int, pos int"), 3)


def test_prompts_and_continuations(spark):
    ranked = [(1, 1, "a", "un deux", "n1"), (1, 2, "b", "mot " * 50, "n2"), (1, 3, "c", "trois", "n3")]
    frame = spark.createDataFrame(ranked, "qid int, rank int, title string, text string, source string")
    asked = spark.createDataFrame([(1, "Quoi ?"), (2, "Rien ?")], "qid int, question string")
    got = retrieval.prompts(frame, asked, 20).collect()
    assert len(got) == 1 and got[0]["sources"] == ["n1", "n2", "n3"]
    assert got[0]["prompt"] == "Extraits de mes notes :\n\n[a]\nun deux\n\n[c]\ntrois\n\nQuestion : Quoi ?\nRéponse :"
    texts = [" oui.\n\nQuestion : et", "a\n[b", "x\n\n\ny", " net "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(retrieval.continuation(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["oui.", "a", "x", "net"]


def test_body_queries_leave_out_the_title(spark):
    passages = spark.createDataFrame([("a#0", "muon optimiseur rapide muon", "a", "optimiseur"), ("b#0", "rapide rapide", "b", "rapide"), ("c#0", "rapide lent", "c", "x")], "id string, text string, source string, title string")
    postings, _ = retrieval.index(passages.drop("title"))
    rare = {r["qid"]: r["terms"] for r in retrieval.body_queries(passages, postings, n=1).collect()}
    assert rare == {"a": ["muon"], "c": ["lent"]}
    any_ = {r["qid"]: r["terms"] for r in retrieval.body_queries(passages, postings, n=2, choice="random").collect()}
    assert any_ == {"a": ["muon", "rapide"], "c": ["lent", "rapide"]}
    assert retrieval.sampled(passages, 2).count() == 2 and retrieval.sampled(passages, 9).count() == 3
    with pytest.raises(ValueError):
        retrieval.body_queries(passages, postings, choice="best")


def test_evaluation_reports(spark):
    assert {r["category"] for r in evaluation.probe_set(spark).collect()} >= {"accord", "genre", "elision"}
    rows = [("matmul", "bfloat16", 8.0, None, None), ("matmul", "float32", 4.0, None, None), ("bandwidth", None, None, 200.0, None), ("attention", "bfloat16", 3.0, None, 512)]
    told = evaluation.kernel_report(spark.createDataFrame(rows, "benchmark string, dtype string, tflops double, gb_per_s double, seq_len int")).first()
    assert told["peak_tflops"] == {"bfloat16": 8.0, "float32": 4.0} and told["bf16_over_fp32"] == 2.0 and told["peak_gb_per_s"] == 200.0 and told["attention_tflops"] == {512: 3.0}
    empty = evaluation.kernel_report(spark.createDataFrame([], "benchmark string, dtype string, tflops double, gb_per_s double, seq_len int")).first()
    assert empty["bf16_over_fp32"] is None and empty["peak_tflops"] == {}
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(evaluation.utilization(F.lit(1.0), F.lit(1.0), F.lit(0.0))).collect()


def test_rejections_are_summed_up(spark):
    docs = spark.createDataFrame([("un " * 60, "a"), ("court", "a"), ("court", None), (None, "b")], "text string, source string").withColumn("lang", F.lit("fr"))
    told = {(r["overall"], r["source"]): (r["seen"], r["kept"], r["rejected"], r["keep_rate"]) for r in filters.summary(filters.apply(docs, [filters.word_count()])).collect()}
    assert told == {(False, "a"): (2, 1, {"word_count": 1}, 0.5), (False, None): (1, 0, {"word_count": 1}, 0.0), (False, "b"): (1, 0, {"word_count": 1}, 0.0), (True, None): (4, 1, {"word_count": 3}, 0.25)}


def test_status(spark):
    paths = ["/m/r1/checkpoints/step-00000007.pt", "/m/r1/checkpoints/step-00000012.pt", "/m/r1/checkpoints/step-last.pt", "/m/r2/checkpoints/step-x.pt", "/m/r3/other/step-9.pt", "/m/r1/checkpoints/step-99.txt"]
    assert {r["run"]: r["step"] for r in ops.last_steps(spark.createDataFrame([(p,) for p in paths], "path string")).collect()} == {"r1": 12, "r2": 0}
    sets = [("x", [("shards",)], 1), ("y", [("hf",), ("shards",)], 2), ("z", [], 3), ("w", None, 4)]
    rows = spark.createDataFrame([(label, True, at, 0.6, s) for label, s, at in sets], "label string, complete boolean, created_at int, overlap double, sources array<struct<name:string>>")
    assert [r["label"] for r in ops.recent_collections(rows, 2).collect()] == ["w", "z"]
    stores = spark.createDataFrame([("p", "l", 0)], "path string, label string, n_tokens bigint")
    log = spark.createDataFrame([], "run string, t string, step int, tokens_seen bigint, corpus string")
    assert ops.largest_store(stores, log).count() == 0
    one = ops.largest_store(stores.withColumn("n_tokens", F.lit(5).cast("bigint")), log).first()
    assert one["path"] == "p" and one["seen"] is None and one["coverage"] is None


def test_a_stream_stops_between_batches(spark, tmp_path):
    rows = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
    assert not streaming.stop_after(query, 3) and not query.isActive and query.exception() is None
    (tmp_path / "empty").mkdir()
    ended = streaming.ingest(spark.readStream.schema("a string").json(str(tmp_path / "empty")), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert streaming.stop_after(ended, 60)


def test_secrets():
    assert config.has_secret("K", {"K": " v "}) and not config.has_secret("K", {"K": "  "}) and config.require_secret("K", {"K": " v "}) == "v"
    with pytest.raises(KeyError, match="K"):
        config.require_secret("K", {})


def test_frames(spark):
    df = spark.createDataFrame([(1, 2)], "__K int, `a b` int")
    assert frames.unused(df, "__k") == "__k_" and frames.unused(df, "x") == "x" and df.select(*frames.columns(df)).columns == df.columns


def test_residues():
    import numpy as np

    p = (1 << 61) - 1
    x = [0, 1, p - 1, p, p + 1, 2 * p, 3 * p, 7 * p, 8 * p, 8 * p + 7, (1 << 64) - 1, *(k * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(1000))]
    assert [int(r) for r in dedup._residues(np.array(x, dtype=np.uint64))] == [v % p for v in x]


def test_files_in_another_encoding(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("été à Noël".encode("latin-1"))
    rows = SOURCES.get("files")(spark, label="f", root=str(tmp_path / "in"), encoding="ISO-8859-1").collect()
    assert [(r["id"], r["text"]) for r in rows] == [("f:a.txt", "été à Noël")]


def test_env_file_is_read_once(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".env").write_text("MILLRACE_TEST_PLACE=here\n")
    (tmp_path / "c.toml").write_text('a = "${MILLRACE_TEST_PLACE}"\n')
    monkeypatch.setenv("MILLRACE_TEST_PLACE", "")
    monkeypatch.delenv("MILLRACE_TEST_PLACE")
    config._own_env.cache_clear()
    assert config.load(tmp_path / "c.toml") == {"a": "here"}
