from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash_cover, winnow


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(range(len(prints)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                ids[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_code_covers_with_radius_three():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 200)
    near = simhash_cover._near(words)
    for w, a in zip(words, near[0][:, 0], strict=True):
        assert int(w ^ a).bit_count() <= 3 and simhash_cover._syndromes(np.array([a]))[0] == 0
    data = np.arange(4096) << 11
    full = data ^ simhash_cover._syndromes(data)
    assert len(set(full.tolist())) == 4096 and min(int(c).bit_count() for c in full if c) == 7
    for k, w in enumerate(words.tolist()):
        d = np.bitwise_count(full ^ w)
        got = np.concatenate([x[k] for x in near])
        assert set(full[d <= 5].tolist()) == set(got[got >= 0].tolist())


def test_replicas_hold_the_home_of_every_neighbour():
    rng = np.random.default_rng(2)
    for x in rng.integers(0, 1 << 63, 20):
        _, anchors = simhash_cover.replicas(np.array([x]))
        flips = [0] + [1 << i for i in range(46)] + [1 << i | 1 << j for i in range(46) for j in range(i)]
        found = simhash_cover.homes(np.array([int(x) ^ f for f in flips]))
        assert set(found.tolist()) <= set(anchors.tolist())


def _link_components(spark, prints):
    signed = np.array(prints, dtype=np.uint64).view(np.int64)
    home = simhash_cover.homes(signed)
    nodes = spark.createDataFrame([(int(f), int(h)) for f, h in zip(signed, home, strict=True)], "fp long, home long")
    roots = {r["node"]: r["root"] for r in simhash_cover.components(simhash_cover.links(nodes)).collect()}
    group = {}
    for i, f in enumerate(signed.tolist()):
        group.setdefault(roots.get(f, f), []).append(i)
    return {tuple(sorted(v)) for v in group.values()}


@pytest.mark.parametrize(("hot", "n"), [(32, 300), (1, 300)])
def test_links_by_brute_force(spark, monkeypatch, hot, n):
    monkeypatch.setattr(simhash_cover, "HOT_HOMES", hot)
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = set()
    while len(prints) < n:
        x = rng.choice(seeds)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {0, 1 << 63, (1 << 64) - 1, 1 << 62}
    prints = sorted(prints)
    group = {}
    for i, root in enumerate(brute_components(prints)):
        group.setdefault(root, []).append(i)
    assert _link_components(spark, prints) == {tuple(v) for v in group.values()}


def test_one_hot_anchor(spark):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(46, 64)) ^ (1 << rng.randrange(46, 64)) for _ in range(150)})
    group = {}
    for i, root in enumerate(brute_components(prints)):
        group.setdefault(root, []).append(i)
    assert _link_components(spark, prints) == {tuple(v) for v in group.values()}


def test_groups_and_keep_one(documents, odd):
    base = [" ".join(f"w{i}_{j}" for j in range(300)) for i in range(5)]
    rows = [(10 + k, t) for k, t in enumerate(base)] + [(20 + k, t + " tail") for k, t in enumerate(base)] + [(30, base[0]), (31, "Two Words"), (32, "two words"), (33, "one")] + odd
    docs = documents(rows)
    got = simhash_cover.groups(docs).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(prints)
    smallest = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    expected = Counter((rows[i][0], prints[i], smallest[root[i]]) for i in range(len(rows)))
    assert Counter((r["doc_id"], r["__fp"] % (1 << 64), r["component_id"]) for r in got) == expected
    kept = simhash_cover.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(smallest.values())
    assert {(r["__key"], r["n_words"], r["score"], r["copies"]) for r in kept.collect()} == {("own",) * 4}
    assert simhash_cover.groups(docs.where("false")).count() == 0 and simhash_cover.keep_one(docs.where("false")).count() == 0


def brute_hits(text, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w = fold(text)
    hit, ids = set(), set()
    for i, t in items:
        b = fold(t)
        k = min(10, len(b))
        grams = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if b else set()
        for j in range(len(w) - k + 1):
            if tuple(w[j : j + k]) in grams:
                hit |= set(range(j, j + k))
                ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_contamination_by_brute_force(spark, documents, odd, monkeypatch, broadcast):
    monkeypatch.setattr(winnow, "BROADCAST_FINGERPRINTS", broadcast)
    rng = random.Random(8)
    words = [f"v{i}" for i in range(400)]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, draw(n)) for i, n in enumerate((10, 10, 25, 40, 12, 9, 6, 5, 3, 2, 1))] + [(50, None), (51, ""), (52, "..."), (0, draw(11)), (60, "Über Ärger " * 6), (61, items_text := draw(30)), (62, items_text)]
    rows = []
    for k in range(60):
        _, t = rng.choice(items)
        w = (t or "").split()
        a = rng.randrange(max(1, len(w) - 9))
        part = " ".join(w[a : a + rng.choice((9, 10, 14, 40))])
        rows.append((k, f"{draw(rng.randrange(30))} {part.upper() if k % 3 == 0 else part}, {draw(rng.randrange(30))}"))
    rows += odd
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(rows)
    got = Counter(tuple(r) for r in winnow.contamination(docs, bench).drop("__key").collect())
    assert got == Counter((i, *brute_hits(t, items)) for i, t in rows)
    clean = winnow.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, t in rows if not brute_hits(t, items)[-1])
    assert {r["__key"] for r in clean.collect()} == {"own"}
    assert winnow.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert winnow.contamination(docs.where("false"), bench).count() == 0


def test_contamination_of_repetitive_texts(spark, documents):
    rng = random.Random(9)
    draw = lambda n, k: " ".join(rng.choice("abcdef"[:k]) for _ in range(n))
    items = [(i, draw(n, k)) for i, (n, k) in enumerate([(30, 1), (25, 2), (12, 3), (10, 2), (9, 2), (7, 2), (4, 3), (40, 6)])]
    rows = [(i, draw(rng.randrange(60), rng.choice((1, 2, 2, 3, 6)))) for i in range(80)] + [(100, "a " * 3000), (101, "a b " * 900)]
    rows += [(200 + i, f"{draw(5, 6)} {t} {draw(5, 6)}") for i, t in items]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter(tuple(r) for r in winnow.contamination(documents(rows), bench).drop("__key").collect())
    assert got == Counter((i, *brute_hits(t, items)) for i, t in rows)


def test_fingerprints_thin_and_cover(spark):
    rng = random.Random(10)
    words = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    row = spark.createDataFrame([(words,)], "w array<string>").select(winnow.hashes(winnow.F.col("w")).alias("h"))
    for length in (10, 9, 6, 3, 1):
        got = row.select(winnow.fingerprints(winnow.F.col("h"), length).alias("x")).first()["x"]
        covered = [i for r in got for i in range(r["a"], r["b"] + 1)]
        assert covered == list(range(4000 - length + 1))
        assert all(x["fp"] != y["fp"] for x, y in zip(got, got[1:], strict=False))
        if length == 10:
            assert len(got) < 0.31 * 4000
