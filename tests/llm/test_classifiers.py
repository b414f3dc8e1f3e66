from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, langid, quality_knn, toxicity

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "sch ung en er ich ü ei ge nd", "fr": "eau ou è on qu ai en ré é", "es": "ción ñ os la ue ar o que í"}


def prose(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def held(i, mod, value):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod == value


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(15, 300)), lang) for i in range(400)]


def test_languages_held_out(documents, corpus, odd, spark):
    rows = corpus + [(1000, "th er on", None), (1001, "123 ... !!", "en")] + [(i, t, "de") for i, t in odd]
    docs = documents(rows)
    model = langid.train(langid.sample(docs.select("doc_id", "text", "lang").where(langid.common.id_crc() % 4 != 2)))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows) and all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in got)
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    known = [(i, lang) for i, _, lang in corpus if held(i, 4, 2)]
    assert np.mean([pred[i] == lang for i, lang in known]) > 0.97
    assert pred[1001] == pred[2] == pred[3] == "und" and pred[7] != "und"
    nothing = langid.train(langid.sample(docs.where("false")))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).count() == 0


def test_samples_count_an_id_once(documents, spark):
    rows = [(1, f"same id {i % 7}", "de") for i in range(300)] + [(10 + i, f"other text {i}", "en" if i % 2 else "de") for i in range(300)]
    docs = documents(rows)
    got = langid.sample(docs)
    assert len(got) == 301 and len(set(got)) == 301 and ("same id 0", "de") in got
    labels = spark.createDataFrame([(i, int(i % 2)) for i, _, _ in rows], "doc_id bigint, quality int").withColumn("toxic", quality_knn.F.col("quality"))
    known = [i for i in {r[0] for r in rows} if not held(i, 5, 0)]
    assert len(quality_knn.sample(docs, labels, "quality", 1500)) == len(known)
    assert len(toxicity.sample(docs, labels)[0]) == len(known)
    some = quality_knn.sample(docs, labels, "quality", 20)
    assert sorted(y for _, y in some) == [0] * 20 + [1] * 20
    assert some == quality_knn.sample(docs.repartition(5), labels, "quality", 20)


def test_samples_are_bounded_over_all_languages(documents):
    rows = [(i, f"word{i} " * 20, f"l{i % 1000:03}") for i in range(3000)]
    docs = documents(rows)
    known = docs.select("doc_id", docs["lang"].alias("label"))
    take = lambda **bounds: common.labelled_sample(docs, known, 600, **bounds)
    assert len(take()) == 3000
    got = take(documents=2000)
    assert len(got) == 2000 and len({label for _, label, _ in got}) == 1000
    assert len({label for _, label, _ in take(documents=100)}) == len(take(documents=100)) == 100
    # A label's documents are taken while those before them have not used up its share of the bytes.
    assert len(take(size=1000)) == 1000
    model = langid.train([(text, label) for text, label, _ in got[:600]])
    assert langid.predict(model, ["word5 word5"])[0][0] in model.languages


def test_language_uses_the_whole_text(corpus):
    model = langid.train([(t, lang) for _, t, lang in corpus])
    rng = random.Random(2)
    late = prose(rng, "en", 20) + " " + prose(rng, "es", 3000)
    assert langid.predict(model, [late])[0] == ["es"]
    a, b = langid.predict(model, [t for _, t, _ in corpus[:40]]), [langid.predict(model, [t]) for _, t, _ in corpus[:40]]
    assert a[0] == [x[0][0] for x in b] and np.allclose(a[1], [x[1][0] for x in b], atol=1e-5)


def test_features_match_the_definition(corpus):
    model = langid.train([(t, lang) for _, t, lang in corpus[:60]])
    windows, _ = langid.windows_of([corpus[0][1].encode()])
    got = model.features(windows)
    for j, tables in enumerate(model.tables):
        for f in range(langid.FILTERS):
            best = max(sum(t[windows[0][p + k], f] for k, t in enumerate(tables)) for p in range(langid.WINDOW - len(tables) + 1))
            assert got[0, j * langid.FILTERS + f] == pytest.approx(max(0, best), abs=1e-4)


def junk(rng, text):
    return rng.choice([lambda t: " ".join(w + "$$$" for w in t.split()), lambda t: " ".join(w.upper() + "!!" for w in t.split()), lambda t: " ".join([t.split()[0]] * 60)])(text)


def test_quality_held_out(spark, documents, corpus, odd):
    rng = random.Random(3)
    label = {i: int(rng.random() > 0.3) for i, _, _ in corpus}
    rows = [(i, t if label[i] else junk(rng, t), lang) for i, t, lang in corpus] + odd
    docs = documents(rows)
    labels = spark.createDataFrame([(i, q) for i, q in label.items()] + [(None, 1), (9999, 0), (1, None), (2, 7)], "doc_id bigint, quality int")
    model = quality_knn.train(quality_knn.sample(docs, labels, "quality", 500))
    got = quality_knn.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"], 5, 0) for r in got)
    right = [r["predicted"] == label[r["doc_id"]] for r in got if r["doc_id"] in label and r["held_out"] and r["doc_id"] > 10]
    assert np.mean(right) > 0.95
    nothing = quality_knn.train(quality_knn.sample(docs, labels.where("false"), "quality", 500))
    assert {r["score"] for r in quality_knn.score(docs, nothing).collect()} == {0.5}
    assert quality_knn.score(docs.where("false"), model).count() == 0


def test_neighbours_are_the_exact_ones(corpus):
    model = quality_knn.train([(t, i % 2) for i, t, _ in corpus[:120]])
    texts = [t for _, t, _ in corpus[120:150]]
    latent = model.latent(quality_knn.term_vectors(texts))
    for text, v in zip(texts, latent, strict=True):
        cosines = sorted(((float(v @ u), y) for u, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: quality_knn.NEIGHBOURS]
        w = [max(c, 0) ** 4 for c, _ in cosines]
        assert model.scores([text])[0] == pytest.approx(sum(a * y for a, (_, y) in zip(w, cosines, strict=True)) / sum(w), abs=1e-4)


def insult(rng, lang):
    return {"en": rng.choice(["idiot", "scum"]), "de": "lowei" + prose(rng, "de", 1), "fr": "vequ" + prose(rng, "fr", 1), "es": "chll" + prose(rng, "es", 1)}[lang]


def test_toxicity_held_out(spark, documents, corpus, odd):
    rng = random.Random(4)
    label, rows = {}, []
    for k in range(4):
        for i, t, lang in corpus:
            w = t.split()
            label[i + 1000 * k] = y = int(rng.random() < 0.3)
            for _ in range(3 * y):
                w.insert(rng.randrange(len(w) + 1), insult(rng, lang))
            rows.append((i + 1000 * k, " ".join(w), lang))
    docs = documents(rows + odd)
    labels = spark.createDataFrame([(i, y) for i, y in label.items() if i > 10] + [(None, 1), (99999, 0), (1, None)], "doc_id bigint, toxic int")
    model = toxicity.train(*toxicity.sample(docs, labels))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == held(r["doc_id"], 5, 0) for r in got)
    seen = Counter((label[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in label and r["doc_id"] > 10)
    assert seen[1, 1] / (seen[1, 0] + seen[1, 1]) > 0.9 and seen[0, 1] / (seen[0, 0] + seen[0, 1]) < 0.05
    nothing = toxicity.train(*toxicity.sample(docs, labels.where("false")))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_texts_do_not_see_each_other(corpus):
    texts = [t for _, t, _ in corpus[:60]] + ["", "one"]
    rows = [(t + (" idiot" if i % 2 else ""), i % 2, lang) for i, (_, t, lang) in enumerate(corpus[:200])]
    model = toxicity.train(rows)
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts], atol=1e-6)


def test_toxicity_score_by_brute_force(corpus):
    rows = [(t + (" idiot idiotic" if i % 2 else ""), i % 2, lang) for i, (_, t, lang) in enumerate(corpus[:200])]
    model = toxicity.train(rows)
    for text in [rows[0][0], rows[1][0], "Idiot", "a idiots b", "never seen words", ""]:
        words = re.findall(r"\w+", text.lower())
        parts = [[w, *("\0" + w[:n] for n in toxicity.PREFIXES if n < len(w))] for w in words]
        rows_of = [[int(model.number[zlib.crc32(p.encode()) % toxicity.BUCKETS]) for p in ps] for ps in parts]
        vectors = [sum((model.embeddings[k].astype(float) for k in ks if k), np.zeros(toxicity.DIMENSIONS)) for ks in rows_of]
        vectors += [np.zeros(toxicity.DIMENSIONS)] * toxicity.PAD
        maxima = []
        for group in model.filters:
            for f in range(toxicity.FILTERS):
                maxima.append(max(sum(vectors[p + k] @ kernel[:, f] for k, kernel in enumerate(group)) for p in range(max(1, len(words)))))
        guess = np.zeros(len(model.languages))
        for ks in rows_of:
            guess += sum(model.language_table[k].astype(float) for k in ks)
        shift = model.shifts[guess.argmax() if guess.any() else len(model.languages)]
        z = np.maximum(maxima, 0) @ model.weights + model.bias - shift
        assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4), text


def test_threshold_is_the_best_cut():
    rng = np.random.default_rng(5)
    for _ in range(30):
        z, y, w = rng.normal(size=20), rng.integers(0, 2, 20), rng.random(20)
        cut = toxicity._threshold(z, y, w)
        error = lambda c: (w * ((z >= c) != (y == 1))).sum()
        assert error(cut) == pytest.approx(min(error(c) for c in [*z, z.min() - 1, z.max() + 1]))


def test_language_by_brute_force(corpus):
    model = langid.train([(t, lang) for _, t, lang in corpus[:80]])
    for text in [corpus[0][1], corpus[1][1] * 3, "é", "x" * 256, "x" * 257]:
        raw = text.encode()
        logs = []
        for a in range(0, len(raw), langid.WINDOW):
            w = raw[a : a + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            best = []
            for tables in model.tables:
                for f in range(langid.FILTERS):
                    best.append(max(0.0, *(sum(float(t[w[p + k], f]) for k, t in enumerate(tables)) for p in range(langid.WINDOW - len(tables) + 1))))
            z = np.array(best) @ model.weights + model.bias
            logs.append(z - np.log(np.exp(z).sum()))
        p = np.exp(np.mean(logs, axis=0))
        p /= p.sum()
        langs, scores = langid.predict(model, [text])
        assert langs == [model.languages[int(p.argmax())]] and scores[0] == pytest.approx(p.max(), abs=1e-4)


def test_terms_by_brute_force():
    for text in ["", "a", "Ab 1! é\nab ab", "one two one\none two one\n\nx"]:
        raw, got = text.encode(), quality_knn.term_vectors([text])[0]
        pairs = Counter((quality_knn.CLASS[a], quality_knn.CLASS[b]) for a, b in zip(raw, raw[1:], strict=False))
        norm = sum(pairs.values()) ** 0.5
        v = np.zeros(quality_knn.TERMS)
        for (a, b), n in pairs.items():
            v[a * quality_knn.CLASSES + b] = n**0.5 / norm
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        if pairs:
            n = max(1, len(words))
            shares = [max(0, 1 - len(set(words)) / n**0.8) if words else 0, 1 - len(set(lines)) / len(lines) if lines else 0, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n]
            for k, s in enumerate(shares):
                for j in range(quality_knn.STEPS):
                    v[quality_knn.PAIRS + k * quality_knn.STEPS + j] = quality_knn.REPEAT_WEIGHT * min(1, max(0, s * quality_knn.STEPS - j))
            v /= np.linalg.norm(v)
        assert np.allclose(got, v, atol=1e-5)


def test_labels_of_absent_documents_take_no_places_in_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(300)] + [(900, None, "en")], "doc_id bigint, text string, lang string")
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    got = common.labelled_sample(docs, labels, 60)
    assert [sum(label == k for _, label, _ in got) for k in (0, 1)] == [60, 60]
    assert len(common.labelled_sample(docs, labels, 1000)) == 300


def test_every_language_with_both_labels_has_a_threshold_of_its_own():
    rng = np.random.default_rng(3)
    rows = []
    for lang, n in (("aa", 400), ("bb", 120), ("cc", 60), ("dd", 40)):
        base = [f"{lang}mot{i}" for i in range(60)]
        for i in range(n):
            words = list(rng.choice(base, 30))
            if i % 3 == 0:
                words[int(rng.integers(30))] = f"{lang}vilain{i % 4}"
            rows.append((" ".join(words), int(i % 3 == 0), lang))
    model = toxicity.train(rows)
    assert model.languages == ["aa", "bb", "cc", "dd"] and len(set(model.shifts.tolist())) == 5
    assert np.isfinite(model.shifts).all()


def test_toxicity_is_learned_from_every_labelled_row(spark, documents):
    rng = random.Random(6)
    label = {i: int(rng.random() < 0.15) for i in range(3600)}
    rows = []
    for i, y in label.items():
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, f"{prose(rng, lang, 8)} eigen{i} " + (insult(rng, lang) if y else prose(rng, lang, 1)), lang))
    docs = documents(rows)
    labels = spark.createDataFrame(list(label.items()), "doc_id bigint, toxic int")
    learned = [(r["text"], r["lang"]) for r in toxicity.labelled(docs, labels).where("not calibrates").collect()]
    assert len(learned) > toxicity.SAMPLE_PER_LABEL + sum(label.values())
    model = toxicity.fit(docs, labels, block_rows=1500)
    # Each text's own word has an embedding and speaks for its language, whichever block it is in.
    own = [(next(w for w in text.split() if w.startswith("eigen")), lang) for text, lang in learned]
    assert all(model.number[toxicity.buckets(w)[0]] for w, _ in own)
    told = [model.language_table[model.number[toxicity.buckets(w)[0]]].argmax() == model.languages.index(lang) for w, lang in own]
    assert np.mean(told) > 0.99  # but for buckets that words share
    # Blocks and sums do not hang on how the rows lie.
    again = toxicity.fit(docs.repartition(7), labels.repartition(3), block_rows=1500)
    assert np.array_equal(model.embeddings, again.embeddings) and np.array_equal(model.shifts, again.shifts) and np.array_equal(model.weights, again.weights)
    got = [r for r in toxicity.score(docs, model).collect() if r["held_out"]]
    seen = Counter((label[r["doc_id"]], r["predicted"]) for r in got)
    assert seen[1, 1] / (seen[1, 0] + seen[1, 1]) > 0.9 and seen[0, 1] / (seen[0, 0] + seen[0, 1]) < 0.05


def test_toxicity_deals_texts_once_and_leaves_nothing_on_disk(spark, documents, monkeypatch):
    rng = random.Random(7)
    rows = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), 6) + (" " + insult(rng, lang) if i % 4 == 0 else ""), lang) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    dealt, materialize = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, *tag, **options: ("text" in df.columns and dealt.append(df._jdf.queryExecution().executedPlan().toString())) or materialize(df, *tag, **options))
    files = lambda: {p for d in (common.shared_dir(spark), spark.sparkContext._temp_dir) for p in Path(d).iterdir()}
    before = files()
    model = toxicity.fit(documents(rows), labels, block_rows=300)
    assert model.learned and [p.count("Exchange hashpartitioning") for p in dealt] == [1]
    assert files() <= before


def test_toxicity_learns_from_the_same_rows_whether_labels_are_broadcast_or_dealt(spark, documents, odd, monkeypatch):
    rows = [(i, f"wort{i} und {k}", "de") for i in range(40) for k in range(1 + 9 * (i == 7))] + odd + [(12, "wort12 und 0", None)]
    docs = documents(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (7, 0)], "doc_id bigint, toxic int")
    want = Counter()
    for i, y in {(i, i % 2) for i in range(200)} | {(7, 0)}:
        texts = sorted(((t, g) for j, t, g in [(*r, "en")[:3] for r in rows] if j == i and t is not None), key=lambda r: (r[0], r[1] or ""))
        if texts and not held(i, 5, 0):
            want[y, *texts[0]] += 1
    known, dealt = toxicity._known(labels), []
    for limit in (10**6, 0):
        monkeypatch.setattr(toxicity, "LABELS_ABROAD", limit)
        dealt.append([tuple(r) for r in toxicity._dealt(docs, known, known.count(), F.pmod("draw", F.lit(3)), 12).collect()])
        assert Counter(r[1:4] for r in dealt[-1]) == want
    assert dealt[0] == dealt[1] and len({r[0] for r in dealt[0]}) == 3  # in the same order too


def test_toxicity_steps_go_over_every_row(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 4)
    met, texts = Counter(), [f"wort{i}" for i in range(300)]
    model = toxicity.untrained(np.array(sorted({k for t in texts for k in toxicity.buckets(t)} - {-1})), 1)
    known = toxicity.Words(model.number)
    by_label = [[np.array(known.ids(t), np.int32) for t in texts[:290]], [np.array(known.ids(t), np.int32) for t in texts[290:]]]
    joined = toxicity.joined
    monkeypatch.setattr(toxicity, "joined", lambda texts: met.update(int(t[0]) for t in texts) or joined(texts))
    for part in range(3):
        toxicity.learn(model, known.rows(), by_label, part, 3, [1, 2])
    assert len(met) == 300


def test_toxicity_without_both_labels_learns_nothing(spark, documents, odd):
    docs = documents(odd)
    labels = spark.createDataFrame([(i, 0) for i in range(10)], "doc_id bigint, toxic int")
    for some in (labels, labels.where("false")):
        assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()} == {0.0}
    both = labels.unionByName(labels.withColumn("toxic", F.lit(1)))
    got = toxicity.score(docs, toxicity.fit(docs, both)).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)


def test_buckets_of_many_words_are_those_of_each():
    rng = random.Random(8)
    words = ["a", "abc", "abcd", "é", "éàü", "éàüß", "漢字漢字", "🙂🙂🙂🙂", "\ud800abc", "x" * 31, "x" * 32, "x" * 33, "é" * 16, "é" * 17, "x" * 70_000]
    words += ["".join(rng.choice("abé漢🙂0_") for _ in range(rng.randrange(1, 14))) for _ in range(500)]
    got = toxicity.buckets_of(words)
    assert got.tolist() == [toxicity.buckets(w) for w in words]
    assert toxicity.buckets_of([]).shape == (0, toxicity.ROWS)
