from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from millrace.operators import evaluation, filters, mixture, novelty, retrieval, search_index, tokens
from millrace.plans.storage import Artifact


def drawn(spark, budgets, docs, seed):
    plans = spark.createDataFrame([(s, b, 1.0) for s, b in budgets.items()], "source string, take bigint, repeats double")
    out = mixture.assemble(docs, plans, seed=seed, drawn=True)
    return out, [r["source"] for r in out.orderBy("position").select("source").collect()]


def test_drawn_order_has_the_law_of_weighted_draws(spark):
    """The share of each source among the first draws lies within what many sequential draws give."""
    rows = [(i, "w " * 20, s, "mine", 5) for i, s in enumerate("a" * 200 + "b" * 100 + "c" * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __est string, take int")
    budgets = {"a": 4000, "b": 1500, "c": 1000}
    out, order = drawn(spark, budgets, docs, 3)
    assert {(r["__est"], r["take"]) for r in out.collect()} == {("mine", 5)}
    assert drawn(spark, budgets, docs, 3)[1] == order != drawn(spark, budgets, docs, 4)[1]
    # Inside a source, passes and documents keep their order.
    for s in budgets:
        own = [(r["pass_no"], r["doc_id"]) for r in out.where(F.col("source") == s).orderBy("position").collect()]
        assert own == sorted(own)
    rng, spend, runs = random.Random(1), 29, 300
    tenth = len(order) // 10
    seen = {s: [[] for _ in range(9)] for s in budgets}
    for _ in range(runs):
        left, n, count = dict(budgets), 0, dict.fromkeys(budgets, 0)
        while any(v > 0 for v in left.values()):
            s = rng.choices(list(left), [max(0, v) for v in left.values()])[0]
            left[s] -= spend
            count[s] += 1
            n += 1
            if n % tenth == 0 and n // tenth <= 9:
                for k, v in count.items():
                    seen[k][n // tenth - 1].append(v)
    for s in budgets:
        for k in range(9):
            mean = sum(seen[s][k]) / runs
            sd = math.sqrt(sum((x - mean) ** 2 for x in seen[s][k]) / runs)
            assert abs(order[: (k + 1) * tenth].count(s) - mean) <= 4 * sd + 1


def test_columns_of_the_caller_are_kept(spark):
    docs = spark.createDataFrame([(1, "un deux trois", "s", "m", "b"), (2, "un", "s", "m", "b")], "doc_id bigint, text string, source string, __mark string, __before string")
    out = filters.apply(docs, filters.build([{"name": "word_count", "min_words": 2}, {"name": "repeated_ngrams"}, {"name": "drop_short_lines"}]))
    assert [(r["__mark"], r["__before"]) for r in out.collect()] == [("m", "b")] * 2 and out.columns == [*docs.columns, "reject_step"]
    ids = spark.createDataFrame([(1, [1, 2], "x", "y")], "doc_id bigint, ids array<int>, __n string, __all string")
    got = tokens.pack(ids).first()
    assert (got["__n"], got["__all"], got["start"]) == ("x", "y", 0)


def test_shards_end_with_the_document_that_fills_them(spark):
    rng = random.Random(8)
    for bound in (1, 7, 40, 10_000):
        sizes = [rng.choice((0, 1, 3, 5, 9, 30)) for _ in range(120)]
        rows = spark.createDataFrame([(i, [0] * n) for i, n in enumerate(sizes)], "doc_id bigint, ids array<int>").repartition(3)
        expected, number, filled = {}, -1, None
        for i, n in enumerate(sizes):
            if n:
                if filled is None or filled >= bound:
                    number, filled = number + 1, 0
                filled += n
                expected[i] = number
        got = {r["doc_id"]: r["shard"] for r in tokens.in_shards(tokens.pack(rows), bound).collect()}
        assert {i: got[i] for i in expected} == expected and len(got) == 120
    assert tokens.in_shards(tokens.pack(rows.where("false")), 5).count() == 0


def test_many_zones_are_met_by_an_equi_join(spark):
    n = 100_000
    zones = spark.range(n).select(F.lit("train").alias("split"), (F.col("id") * 50).alias("start"), (F.lit(20) + F.col("id") % 7).alias("len"))
    got = tokens.draw(zones, 500, 10, seed=3)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert all(r["pos"] % 50 + 10 <= 20 + r["pos"] // 50 % 7 for r in got.collect()) and got.count() == 500


def test_stored_search_reads_fewer_postings_and_finds_the_same(spark, tmp_path):
    rng = random.Random(2)
    coded = lambda stem, i: stem + "".join(chr(97 + int(x)) for x in str(i))
    words = [coded("mot", i) for i in range(400)]
    text = lambda: " ".join(words[min(399, int(rng.paretovariate(0.7)))] for _ in range(60))
    rows = [(i, text() + (f" {coded('rare', i % 50)}" * 2 if i % 3 == 0 else ""), coded("titre", i % 9)) for i in range(900)]
    passages = spark.createDataFrame(rows, "id bigint, text string, title string")
    path = str(tmp_path / "index")
    search_index.build(passages.where("id < 500"), path, title_weight=2)
    search_index.add(passages.where("id >= 500"), path)
    asked = spark.createDataFrame([(q, [coded("rare", q), words[3], words[7], coded("titre", q % 9), words[3]]) for q in range(20)] + [(50, ["absent"]), (51, [words[2]])], "qid bigint, terms array<string>")
    read: list[tuple[int, int]] = []
    got = search_index.search(spark, path, asked, k=4, read=read)
    postings, lengths = retrieval.index(passages, title_weight=2)
    want = retrieval.search(postings, lengths, asked, k=4)
    shown = lambda df: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert shown(got) == shown(want) and want.count() > 60
    assert read[0][0] < 0.8 * read[0][1]
    assert sorted(map(tuple, search_index.postings(spark, path).collect())) == sorted(map(tuple, postings.collect()))
    # A segment that was not finished does not count, and its place is used again.
    (tmp_path / "index/segments/000002/postings").mkdir(parents=True)
    assert shown(search_index.search(spark, path, asked, k=4)) == shown(want)
    search_index.add(passages.where("id < 0"), path)
    assert shown(search_index.search(spark, path, asked, k=4)) == shown(want)


def test_novelty_reads_the_fingerprints_beside_an_artifact(spark, tmp_path):
    docs = lambda a, b: spark.createDataFrame([(i, f"texte {i}") for i in range(a, b)], "doc_id bigint, text string")
    root = str(tmp_path)
    for name, a, b, side in (("un", 0, 10, True), ("deux", 5, 15, False)):
        artifact = Artifact(spark, root, "corpora", name, {"n": name})
        corpus = artifact.write("corpus", docs(a, b))
        if side:
            novelty.remember(artifact, corpus)
            artifact.write("corpus", docs(100, 101))  # the text is not looked at again
        artifact.commit()
    got = {r["artifact"].partition("-")[0]: r["overlap"] for r in novelty.compare_to_existing(docs(0, 10), root).collect()}
    assert got == {"un": 1.0, "deux": 0.5}


def test_kneser_ney_is_a_distribution_and_losses_add_up(spark):
    texts = ["a b a b c", "a c", "b", "c a b", ""]
    docs = spark.createDataFrame([(i, t.split(), "s" if i % 2 else None) for i, t in enumerate(texts)], "doc_id bigint, t array<string>, source string")
    pairs = evaluation.token_pairs(docs, F.col("t"), "source")
    model = {(r["prev"], r["tok"]): r["loss"] for r in evaluation.kneser_ney(pairs).collect()}
    n: dict[tuple[str, str], int] = {}
    for t in texts:
        w = t.split()
        for pair in zip(w, w[1:], strict=False):
            n[pair] = n.get(pair, 0) + 1
    for prev in "abc":
        m, kinds = sum(v for (p, _), v in n.items() if p == prev), sum(p == prev for p, _ in n)
        share = {tok: sum(t == tok for _, t in n) / len(n) for tok in "abc"}
        p = {tok: max(n.get((prev, tok), 0) - 0.75, 0) / m + 0.75 * kinds / m * share[tok] for tok in "abc"}
        assert math.isclose(sum(p.values()), 1)
        assert all(math.isclose(model[prev, tok], -math.log(p[tok])) for tok in "abc" if (prev, tok) in n)
    total = evaluation.pair_losses(pairs, evaluation.kneser_ney(pairs)).first()
    assert total["n_tokens"] == sum(n.values()) and math.isclose(total["total_loss"], sum(v * model[k] for k, v in n.items()))


def test_searches_deal_passages_not_pairs_of_questions_and_passages(spark, tmp_path):
    word = lambda k: "mot" + "bcdefghijk"[k // 10] + "bcdefghijk"[k % 10]
    texts = [" ".join(word((i * k) % 37) for k in range(1, 9)) for i in range(300)]
    passages = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    asked = spark.createDataFrame([(q, [word(q), word(q + 1), word(q)]) for q in range(20)], "qid bigint, terms array<string>")
    postings, lengths = retrieval.index(passages)
    search_index.build(passages, str(tmp_path / "index"))
    found = [retrieval.search(postings, lengths, asked, k=4), search_index.search(spark, str(tmp_path / "index"), asked, k=4)]
    shown = [sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in f.collect()) for f in found]
    assert shown[0] == shown[1] and len(shown[0]) == 80
    # Nothing but the best of each task is dealt by question.
    exchanges = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
    assert all("hashpartitioning(qid" not in x or "id#" not in x.split("hashpartitioning(qid")[1].split(",")[1] for f in found for x in exchanges(f))
    # A text's terms are counted where it is.
    assert not exchanges(postings)
    twice, _ = retrieval.index(passages.unionByName(passages.where("id < 3")))
    assert {(r["term"], r["id"]): r["tf"] for r in twice.collect()} == {(r["term"], r["id"]): r["tf"] * (1 + (r["id"] < 3)) for r in postings.collect()}
    odd = spark.createDataFrame([("Ⅻ½x İstanbul 12ab ΌΣΟΣ été1 éà a b1 ٣٤ ß œuvre x²y",), (None,)], "t string")
    assert [r[0] for r in odd.select(retrieval.terms(F.col("t"))).collect()] == [["ⅻ½x", "istanbul", "12", "ab", "οσος", "ete", "ea", "٣٤", "œuvre", "x²y"], []]
