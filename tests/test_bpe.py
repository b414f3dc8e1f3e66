from __future__ import annotations

import random
import time
from collections import Counter

from millrace.operators import tokenizer


def brute_train(counts: dict[str, int], n: int, min_frequency: int = 2) -> list[tuple[int, int]]:
    """One merge after another over all pieces."""
    rows = [([tokenizer.SPECIALS + b for b in p.encode()], m) for p, m in counts.items()]
    merges = []
    while len(merges) < n:
        weight = Counter()
        for ids, m in rows:
            for pair in zip(ids, ids[1:], strict=False):
                weight[pair] += m
        if not weight:
            break
        pair = min(weight, key=lambda p: (-weight[p], p))
        if weight[pair] < min_frequency:
            break
        rows = [(tokenizer.merged(ids, pair, tokenizer.SPECIALS + 256 + len(merges)), m) for ids, m in rows]
        merges.append(pair)
    return merges


def brute_piece(ids: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    while len(ids) > 1:
        best = min(zip(ids, ids[1:], strict=False), key=lambda p: ranks.get(p, 1 << 60))
        if best not in ranks:
            break
        ids = tokenizer.merged(ids, best, tokenizer.SPECIALS + 256 + ranks[best])
    return ids


def some_counts(seed: int, n: int = 300) -> dict[str, int]:
    rng = random.Random(seed)
    parts = ["aa", "ba", "nan", "é", "lo", "l", "o", "tion", "aaa", "x"]
    return {"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))): rng.choice((1, 1, 2, 3, 5, 40)) for _ in range(n)}


def test_merges_are_those_of_one_merge_at_a_time_however_few_runs_the_driver_takes(spark):
    for seed in range(2):
        counts = some_counts(seed)
        frame = spark.createDataFrame(list(counts.items()), "piece string, n bigint").repartition(3)
        wanted = brute_train(counts, 60)
        for runs in (1_000_000, 40, 2):
            passes: list[int] = []
            got = tokenizer.train(frame, vocab_size=tokenizer.SPECIALS + 256 + (60 if runs > 2 else 12), max_runs=runs, passes=passes)
            assert got == wanted[: len(got)] and len(got) == min(len(wanted), 60 if runs > 2 else 12)
            assert runs < 1_000_000 or len(passes) == 1
            assert runs != 40 or 1 < len(passes) < 20


def test_training_stops_at_the_least_frequency_and_on_empty_tables(spark):
    frame = spark.createDataFrame([("ab", 3), ("cd", 1), ("", 9), ("z", 50)], "piece string, n bigint")
    assert tokenizer.train(frame, vocab_size=400) == [(tokenizer.SPECIALS + 97, tokenizer.SPECIALS + 98)]
    assert tokenizer.train(frame.where("false"), vocab_size=400) == []


def test_encoding_by_a_heap_equals_a_rescan(spark):
    rng = random.Random(4)
    merges = brute_train(some_counts(9), 60)
    ranks = {m: i for i, m in enumerate(merges)}
    for _ in range(60):
        ids = [tokenizer.SPECIALS + b for b in "".join(rng.choice("abnélotix") for _ in range(rng.randrange(40))).encode()]
        assert tokenizer.joined(list(ids), ranks) == brute_piece(list(ids), ranks)


def test_a_very_long_piece_is_encoded_in_about_a_second(spark):
    merges = brute_train(some_counts(9), 60)
    codec = tokenizer.Codec(merges)
    rng = random.Random(1)
    piece = "".join(rng.choice(("aa", "ba", "nan", "lo", "tion")) for _ in range(80_000))[:200_000]
    began = time.process_time()
    ids = codec.piece(piece)
    assert time.process_time() - began < 3 and len(ids) < 200_000  # about 0.7 s on one idle core
    assert codec.decode(ids) == piece


def test_a_batch_is_encoded_one_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    codec = tokenizer.Codec([(tokenizer.SPECIALS + ord("a"), tokenizer.SPECIALS + ord("b"))])
    texts = pa.array([[f"ab{i}" for i in range(400)], None, []] * 300, pa.list_(pa.string()))
    tracemalloc.start()
    got = tokenizer.encoded(texts, codec, [tokenizer.EOT])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [codec.encode(p or []) + [tokenizer.EOT] for p in texts.to_pylist()]
    assert got.to_pylist() == want and got.type == pa.list_(pa.int32())
    # Four bytes an id, twice while they are copied; lists of numbers, and all pieces as strings, would take five times that.
    assert peak < 12 * sum(map(len, want)) + (1 << 20)
