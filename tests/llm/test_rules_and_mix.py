from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import mix, quality_rules


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(grams)
    hit = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, sym, dup, chars = len(w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(map(len, w))
    stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
    failed = n < 20 or 100 * len(hit) > 30 * n
    bad = 10 * sym > 3 * n or 10 * t.count("!") > 3 * n or 10 * stutter > 3 * n or (dup >= 4 and 10 * dup > 6 * (t.count("\n") + 1)) or chars < 2 * n or chars > 25 * n
    return n, chars, sym, dup, len(hit), failed, not (failed or bad)


def texts():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    out = [" ".join(rng.choice(vocab[:k]) for _ in range(n)) for k in (1, 2, 5, 30) for n in (1, 7, 8, 9, 19, 20, 40, 150)]
    out += ["\n".join(["one two three"] * 9), "\n".join(f"line {i} is here now" for i in range(9)), "A!! " * 30, "abc$$$ def### ghi " * 9, "word " * 50, " ".join(f"v{i}" for i in range(60)) + "\n\n|", "a b " * 12]
    out += [" ".join(f"u{i}" for i in range(40)) + " " + " ".join(f"u{i}" for i in range(10, 30))]
    return out


def test_measures_and_verdicts_by_brute_force(documents, odd):
    rows = [(100 + i, t) for i, t in enumerate(texts())] + odd
    got = quality_rules.verdicts(documents(rows)).drop("reject_rule").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *brute(t)) for i, t in rows)


def test_order_changes_no_verdict(documents):
    docs = documents([(i, t) for i, t in enumerate(texts())])
    rules = quality_rules.base_rules() + quality_rules.method_rules()
    verdict = lambda x: quality_rules.over_parts(F.col("text"), lambda p: quality_rules.cascade(x, p)).isNull()
    kept = [sorted(r[0] for r in docs.where(verdict(x)).select("doc_id").collect()) for x in (rules, rules[::-1])]
    assert kept[0] == kept[1] == sorted(r["doc_id"] for r in quality_rules.keep(docs).collect()) and kept[0]
    shares = {r.name: share for r, _, share in quality_rules.estimate(docs, rules)}
    assert 0 < shares["too_short"] < 1


def test_order_is_by_rejection_per_cost_and_stable(documents):
    rows = [(i, t) for k in range(4) for i, t in enumerate(texts(), 1000 * k)]
    docs, rules = documents(rows), quality_rules.base_rules() + quality_rules.method_rules()
    by = {r.name: (cost, share) for r, cost, share in quality_rules.estimate(docs, rules, sample_rows=10**6)}
    n = [len(t or "") for _, t in rows]
    assert by["shouting"][0] == pytest.approx(100 + 0.7 * sum(n) / len(n)) and by["stutter"][0] == pytest.approx(100 + 23.3 * sum(n) / len(n))
    assert by["too_short"][1] == sum(brute(t)[0] < 20 for _, t in rows) / len(rows)
    # A measure that is known already costs its rule nothing more.
    assert quality_rules.estimate(docs, rules[1:2], measures=quality_rules.BASE)[0][1] == 100
    names = [r.name for r in quality_rules.ordered(docs, rules)]
    found = {r.name: share / cost for r, cost, share in quality_rules.estimate(docs, rules)}
    assert names[0] == "too_short" and [found[x] for x in names] == sorted(found.values(), reverse=True)
    for parts in (1, 2, 7):
        assert [r.name for r in quality_rules.ordered(docs.repartition(parts), rules[::-1])] == names
    assert [r.name for r in quality_rules.ordered(docs.where("false"), rules)] == sorted(by)


def test_one_id_on_many_rows_does_not_enter_the_sample_as_rows(documents):
    docs = documents([(1, "same words again " * 10)] * 300 + [(i, t) for i, t in enumerate(texts(), 10)])
    rules = quality_rules.method_rules()
    assert [r.name for r in quality_rules.ordered(docs, rules, sample_rows=30)] == [r.name for r in quality_rules.ordered(docs.repartition(2), rules, sample_rows=30)]


def test_keep_leaves_columns_and_copes_with_empty_tables(documents, spark):
    docs = documents([(1, " ".join(f"w{i}" for i in range(30)))])
    assert quality_rules.keep(docs).columns == docs.columns and quality_rules.keep(docs).collect() == docs.collect()
    assert quality_rules.keep(docs.where("false")).count() == 0
    assert quality_rules.verdicts(docs.where("false")).count() == 0


def water(sizes):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        pool = sum(weight[s] for s in rest)
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / pool for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken(documents, seed):
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", None, "c", "tiny"]
    rows = [(i, "w " * rng.randrange(0, 60), "en", s) for i, s in enumerate(rng.choices(names, weights=[400, 40, 90, 9, 100, 300, 1], k=900))]
    got = mix.plan(documents(rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, _, s in rows:
        sizes[s] += len(t.split())
    for r in got:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    expected = water(dict(sizes))
    for r in got:
        assert r["target"] == pytest.approx(expected[r["source"]], abs=1e-6) and r["source_size"] == sizes[r["source"]]
    for s, target in expected.items():
        assert abs(taken[s] - target) <= 61, s
    again = mix.plan(documents(rows, parts=1)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_systematic_steps_by_brute_force(documents, monkeypatch):
    monkeypatch.setattr(mix, "PIECE", 3)
    rows = [(i, "w " * (i % 5 + 1), "en", "ab"[i % 3 == 0]) for i in range(60)] + [(7, "w w", "en", "a")] * 11 + [(None, "w", "en", None)] * 4
    got = mix.placed(mix.sized(documents(rows))).collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]] += [(r["first"] + i, r["size"]) for i in range(r["n"])]
    for ranks in by.values():
        assert [k for k, _ in sorted(ranks)] == list(range(len(ranks)))
        assert [s for _, s in sorted(ranks)] == sorted(s for _, s in ranks)
    planned = mix.plan(documents(rows)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in planned) == Counter((i, s, len(t.split())) for i, t, _, s in rows)


def test_mix_shares_copies_among_repeated_rows_and_keeps_columns(documents):
    rows = [(1, "w w w", "en", "a")] * 50 + [(None, None, "en", "a")] * 20 + [(i, "x " * 9, "en", "b") for i in range(2, 30)] + [(2, "y " * 9, "en", "b")]
    docs = documents(rows, parts=4)
    out = mix.mixed(docs)
    planned = Counter()
    for r in mix.plan(docs).collect():
        planned[r["doc_id"], r["source"]] += r["copies"]
    got = out.collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == +planned and len(got) > 30
    assert all(r["__key"] == r["score"] == r["copies"] == "own" for r in got)
    # Repeated rows get the same number of copies, give or take one.
    assert max(r["copy_no"] for r in got if r["doc_id"] == 1) <= -(-planned[1, "a"] // 50)
    named = docs.withColumns({"__mix_n": F.lit("mine"), "__mix_key": F.lit("mine"), "copy_no": F.lit("mine"), "n": F.lit("mine")})
    again = mix.mixed(named).collect()
    assert len(again) == len(got) and all(r["__mix_n"] == r["__mix_key"] == r["copy_no"] == r["n"] == "mine" for r in again)


def test_mix_emits_each_row_as_often_as_planned(documents, odd):
    rows = [(i, "w " * (i % 7 + 1), "en", "ab"[i % 4 == 0]) for i in range(40)] + [(i, t, "en", "c") for i, t in odd]
    docs = documents(rows)
    plan = Counter()
    for r in mix.plan(docs).collect():
        plan[r["doc_id"], r["source"], r["size"]] += r["copies"]
    out = mix.mixed(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    size = F.size(quality_rules.common.words(F.col("text"))).cast("long")
    got = Counter((r["doc_id"], r["source"], r["s"]) for r in out.select("doc_id", "source", size.alias("s")).collect())
    assert got == +plan
    assert mix.mixed(docs.where("false")).count() == 0 and mix.plan(docs.where("false")).count() == 0
