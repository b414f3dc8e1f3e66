from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup
from millrace.operators.components import components

KEYS = "doc_id bigint, ord bigint, keys array<bigint>"


def by_order(keys):
    met, dropped = set(), set()
    for i, own in sorted(keys.items()):
        if met & set(own):
            dropped.add(i)
        else:
            met |= set(own)
    return dropped


def test_components_of_a_long_chain_take_few_rounds(spark):
    n = 10_000
    order = random.Random(5).sample(range(n), n)
    edges = spark.createDataFrame([*zip(order, order[1:], strict=False), (20_000, 20_001), (20_001, 20_002), (30_000, 30_000)], "a bigint, b bigint")
    rounds: list[int] = []
    got = {r["node"]: r["root"] for r in components(edges, rounds).collect()}
    assert got == dict.fromkeys(range(n), 0) | dict.fromkeys((20_000, 20_001, 20_002), 20_000)
    assert len(rounds) <= 16


def test_greedy_on_a_chain_of_ten_thousand(spark):
    n = 10_000
    keys = {i: [i, i + 1] for i in range(n)}
    frame = spark.createDataFrame([(i, i, k) for i, k in keys.items()], KEYS)
    assert {r[0] for r in dedup.greedy(frame).collect()} == set(range(1, n, 2))


@pytest.mark.parametrize("limit", [1_000_000, 30, 0])
def test_small_and_giant_components_by_brute_force(spark, limit):
    """The same verdicts whether a component is solved in a task or in rounds."""
    rng = random.Random(limit)
    keys = {i: [rng.randrange(90) for _ in range(rng.randrange(4))] for i in range(80)} | {200 + i: [1000 + i, 1001 + i] for i in range(12)}
    frame = spark.createDataFrame([(i, i, k) for i, k in keys.items()], KEYS).repartition(3)
    assert {r[0] for r in dedup.greedy(frame, component_rows=limit).collect()} == by_order(keys)


def test_repeated_and_null_ids_and_clashing_columns(spark):
    t = " ".join(f"mot{i}" for i in range(200))
    rows = [(1, t), (1, t + " fin"), (None, t + " fin fin"), (2, t + " x"), (2, "autre " * 3), (2, "autre " * 3), (None, None), (3, None)]
    docs = spark.createDataFrame([(i, x, "n", "c", 7) for i, x in rows], "doc_id bigint, text string, __near string, __at string, verdict_ int").repartition(3)
    out = dedup.deduplicate(docs)
    assert out.columns == [*docs.columns, "verdict"]
    got = out.collect()
    assert all((r["__near"], r["__at"], r["verdict_"]) == ("n", "c", 7) for r in got)
    # Null ids come first, so the null row is kept, and one row of the copies among the others is not: one document stays.
    assert [r["verdict"] for r in got if r["text"] and r["text"].startswith("mot")].count("kept") == 1
    assert {(r["doc_id"], r["verdict"]) for r in got if r["text"] and r["text"].startswith("mot")} == {(None, "kept"), (1, "near"), (2, "near")}
    assert sorted(r["verdict"] for r in got if r["text"] and r["text"].startswith("autre")) == ["exact", "kept"]
    assert sorted((str(r["doc_id"]), r["verdict"]) for r in got if r["text"] is None) == [("3", "exact"), ("None", "kept")]


def test_keys_are_made_once(spark):
    """The keys cost a pass over all texts: finding who is dropped takes them from the table."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    keys = spark.createDataFrame([(i, i, [i // 2, 1000 + i]) for i in range(40)], "doc_id bigint, ord bigint, keys array<bigint>")
    dropped = dedup.greedy(keys.mapInArrow(run, keys.schema))
    assert sorted(r["doc_id"] for r in dropped.collect()) == list(range(1, 40, 2)) and made.value == 40


def test_band_keys_carry_columns_and_hash_shingles_as_the_expression_does(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g " * 300, "x"), (2, None, "y"), (3, "too short", None), (4, "", "z")], "doc_id bigint, text string, own string")
    got = {r["doc_id"]: r for r in dedup.band_keys(docs, carry=("own",)).collect()}
    assert {i: r["own"] for i, r in got.items()} == {1: "x", 2: "y", 3: None, 4: "z"} and [len(got[i]["keys"]) for i in (1, 2, 3, 4)] == [16, 0, 0, 0]
    row = docs.where("doc_id = 1").select(dedup.word_hashes(F.col("text")).alias("w")).select("w", dedup.shingle_hashes(F.col("w")).alias("s")).first()
    assert dedup._shingles(np.array(row["w"], np.uint64), 5).tolist() == row["s"]
    c, h = dedup.coefficients(8, 1), np.arange(1, 1500, dtype=np.uint64) * np.uint64(2863311)
    assert dedup._minima(h, c, np.empty((2, 8, 512), np.uint64)).tolist() == [min((int(a) * int(x) + int(b)) % dedup.MERSENNE_61 for x in h) for a, b in c.T]
