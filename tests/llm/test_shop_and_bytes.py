"""Point-in-time features, hard negatives and repeated strings against brute force, on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest

from millrace.llm import hard_negatives, point_in_time, suffix_dedup

DAY = timedelta(days=1)
CLICKS = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string, value double, props string"
SALES = "sale_id bigint, client_id bigint, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id bigint, line_no int, item_id bigint, vendor_id bigint, amount double, shipped_at timestamp_ntz"
BEGIN = datetime(2024, 1, 1)


def shop(seed):
    rng = random.Random(seed)
    some = lambda p, x: None if rng.random() < p else x
    at = lambda: BEGIN + timedelta(seconds=rng.choice((rng.randrange(40 * 86400), 3600 * rng.randrange(40 * 24))))
    late = lambda t: t and t + rng.choice((timedelta(seconds=5), timedelta(hours=20), 3 * DAY, 15 * DAY, -DAY))
    client = lambda: rng.choice((1, 1, 1, 1, 2, 3, None))
    clicks = [(some(0.05, i), t := some(0.05, at()), some(0.05, late(t)), client(), rng.choice(("purchase", "view", None)), rng.choice((None, 1.005, -3.5, 7.0, math.nan)), "{}") for i in range(150)]
    sales = [(i, client(), "done", rng.choice((None, 10.0, 2.675, math.inf)), t := some(0.05, at()), some(0.05, late(t)), 1) for i in range(90)] + [(None, 1, "x", 1.0, BEGIN + DAY, BEGIN + DAY, 1)]
    lines = [(rng.choice((*range(40), 7, 7, 7, None, 500)), 1, rng.choice((1, 1, 2, 3, None)), 1, rng.choice((None, 0.125, 20.0)), some(0.05, at())) for _ in range(250)]
    return clicks + clicks[:20], sales + sales[:3], lines + lines[:20]


def by_hand(clicks, sales, lines):
    cents = lambda x: 0 if x is None or not math.isfinite(x) else math.floor(100 * x + 0.5)
    known = lambda arrived, t: arrived is not None and arrived + timedelta(minutes=240) <= t
    out = []
    for sale, client, _, _, sold, _, _ in sales:
        if client is None or sold is None:
            continue
        t = sold + timedelta(seconds=zlib.crc32(("" if sale is None else str(sale)).encode()) % 259200)
        label = any(c == client and s is not None and t < s <= t + 7 * DAY for _, c, _, _, s, _, _ in sales)
        for d in (2, 14):
            unique = {tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in c): c for c in clicks}.values()
            own = [c for c in unique if c[3] == client and c[1] is not None and t - d * DAY < c[1] <= t and known(c[2], t)]
            seen = [s for s in sales if s[1] == client and s[4] is not None and t - d * DAY < s[4] <= t and known(s[5], t)]
            met = [x for s in seen for x in lines if x[0] is not None and x[0] == s[0] and x[5] is not None and x[5] <= t]
            last = max(own, key=lambda c: (c[1], -1 if c[0] is None else c[0]))[0] if own else None
            us = (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            out.append((sale, d, us, label, len(own), sum(c[4] == "purchase" for c in own), sum(cents(c[5]) for c in own), last, len(seen), sum(cents(s[3]) for s in seen), len(met), len({x[2] for x in met} - {None}), sum(cents(x[4]) for x in met)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_features_at_a_time_equal_a_scan_of_the_history(spark, seed, monkeypatch):
    """Slices of few rows, so that the one busy client is cut often and balances are carried."""
    monkeypatch.setattr(point_in_time, "SLICE", 60)
    tables = shop(seed)
    frames = [spark.createDataFrame(rows, schema).withColumnRenamed("props", "known").repartition(3) for rows, schema in zip(tables, (CLICKS, SALES, LINES), strict=True)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")  # times are UTC whatever the session's zone
        got = sorted((tuple(r) for r in point_in_time.features(*frames).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == by_hand(*tables)


def test_features_of_empty_tables(spark):
    frames = [spark.createDataFrame([], schema) for schema in (CLICKS, SALES, LINES)]
    assert point_in_time.features(*frames).count() == 0
    one = spark.createDataFrame([(5, 1, "x", 2.0, BEGIN, BEGIN, 1)], SALES)
    got = point_in_time.features(frames[0], one, frames[2]).collect()
    assert [(r["sale_id"], r["d"], r["n_clicks"], r["last_click_id"], r["n_lines"], r["label"]) for r in got] == [(5, 2, 0, None, 0, False), (5, 14, 0, None, 0, False)]


def negatives_by_hand(rows):
    taken = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            found = (label, [math.floor(256 * float(np.float32(x))) for x in v])
            taken[i] = min(taken.get(i, found), found)
    out = []
    for a in (i for i in taken if i % 10 == 0):
        score = {i: sum(x * y for x, y in zip(v, taken[a][1], strict=False)) for i, (_, v) in taken.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if taken[i][0] == taken[a][0]][:5]:
            near = [i for i in order if taken[i][0] != taken[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(near, 1)]
    return sorted(out)


def test_hard_negatives_over_cells_equal_a_sort_of_all_scores(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD", 16)
    monkeypatch.setattr(hard_negatives, "GROUP", 4)
    monkeypatch.setattr(hard_negatives, "BLOCK", 2)
    rng = random.Random(6)
    rows = [(i, [rng.choice((0.1, 0.5, -0.2, 0.25)) for _ in range(4)], rng.randrange(3)) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5], i % 3) for i in range(30)]  # ties
    rows += [(None, [1.0], 1), (300, None, 1), (310, [math.nan, 1.0], 1), (320, [None, 1.0], 1), (330, [math.inf], 0), (340, [1.0], None), (350, [], 1), (360, [0.3, 0.4], 2), (10, [0.9, 0.9, 0.9, 0.9], 0), (20, *rows[20][1:])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % 10 == 0).collect())
    assert got == negatives_by_hand(rows) and len(got) > 100
    assert hard_negatives.mine(frame.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    # Scores beyond what doubles hold exactly.
    large = [(i, [1e6 + i, 1e6 - 3 * i, 7.5e6], i % 2) for i in range(40)]
    got = sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(large, "vec_id bigint, embedding array<float>, label int"), F.col("vec_id") % 10 == 0).collect())
    assert got == negatives_by_hand(large)


def kept_by_hand(docs, length):
    """The rows alike in id and text are one document; null ids come last."""
    rows = {(i is None, i or 0, t or "") for i, t in docs}
    order = sorted(rows)
    met, out = set(), {}
    for key in order:
        b = key[2].encode()
        cut = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in met:
                cut[p : p + length] = True
            met.add(b[p : p + length])
        spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if len(b) else 0
        out[key] = (len(b), int(cut.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cut])).hexdigest())
    return sorted(((i, *out[(i is None, i or 0, t or "")]) for i, t in docs), key=str)


@pytest.mark.parametrize("buffer", [2 << 20, 150])
@pytest.mark.parametrize("length", [100, 20])
def test_repeated_strings_equal_a_scan_of_all_windows(spark, monkeypatch, buffer, length):
    monkeypatch.setattr(suffix_dedup, "BUFFER", buffer)
    rng = random.Random(length + buffer)
    word = lambda: rng.choice(("le", "château", "maison", "été", "verte", "sur", "x" * 9))
    text = lambda n: " ".join(word() + str(rng.randrange(99)) for _ in range(n))
    passage, other = text(40), text(30)
    docs = [(i, text(rng.randrange(1, 60))) for i in range(20)]
    docs += [(30, passage), (31, text(5) + passage + text(4)), (32, passage[30:] + other), (33, other + passage[:130]), (34, passage), (35, passage[:60] + "!" + passage[61:]), (29, text(9) + passage[50:170])]
    docs += [(40, "ab" * 200), (41, "b" + "ab" * 80), (42, "x" * 400), (43, None), (44, ""), (45, "é" * 70), (None, passage), (34, passage), (46, other * 3)]
    frame = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id bigint, text string, k1 string").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.deduplicated(frame, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == kept_by_hand(docs, length)


def test_repeated_strings_of_empty_tables_and_bounds(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.deduplicated(empty).count() == 0
    with pytest.raises(ValueError, match="between"):
        suffix_dedup.spans(empty, 500)
