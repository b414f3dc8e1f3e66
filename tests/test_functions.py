from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.arrays import longest_run, rolling


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "unify", "expected"),
    [
        ("été", True, "été"),
        ("l’eau “pure”", True, "l'eau \"pure\""),
        ("l’eau", False, "l’eau"),
        ("a\x00b\x07c", True, "abc"),
        ("a\n\n\n\n\nb", True, "a\n\nb"),
        ("a  \t b \nc\t\n  ", True, "a b\nc"),
        ("", True, ""),
    ],
)
def test_normalize(spark, raw, unify, expected):
    assert one(spark, raw, T.normalize(F.col("text"), unify_apostrophes=unify)) == expected


def test_fingerprint_ignores_case_and_space(spark):
    a, b, c = (one(spark, t, T.fingerprint(F.col("text"))) for t in ("Un  chat\n noir", "un chat noir ", "un chat gris"))
    assert a == b != c


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("---\ntitle: x\n---\nBody", "Body"),
        ("see [[Note|the note]] and [[Other]]", "see the note and Other"),
        ("![[image.png]] text", "text"),
        ("[label](http://x.y)", "label"),
        ("#tag #other/sub\nline", "line"),
    ],
)
def test_strip_markdown(spark, raw, expected):
    assert one(spark, raw, T.strip_markdown(F.col("text"))) == expected


def test_book_frame(spark):
    book = "header\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nStory.\n*** END OF THIS PROJECT GUTENBERG EBOOK X ***\nlicence"
    assert one(spark, book, T.strip_book_frame(F.col("text"))) == "Story."
    assert one(spark, "plain", T.strip_book_frame(F.col("text"))) == "plain"


def test_words_and_nulls(spark):
    assert one(spark, "a b c", T.n_words(F.col("text"))) == 3
    assert one(spark, None, T.n_words(F.col("text"))) is None
    assert one(spark, "x " * 100, T.estimate_tokens(T.n_words(F.col("text")))) == 145


def test_language(spark):
    fr = "le chat est dans la maison et il ne veut pas sortir car il pleut sur les toits de la ville avec du vent"
    s = T.language_scores(F.col("text"))
    assert one(spark, fr, T.detect_language(s)) == "fr"
    assert one(spark, "short", T.detect_language(s)) == "unknown"


def test_format_tokens(spark):
    rows = spark.createDataFrame([(5,), (1500,), (2_500_000,), (4 * 10**9,)], "n bigint").select(T.format_tokens(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["5", "1.5 k", "2.50 M", "4.00 Md"]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 10])
def test_rolling_minimum(spark, n):
    xs = [5, 3, 9, 1, 7, 7, 2, 8, 4, 6, 0, 5]
    got = spark.createDataFrame([(xs,), (xs[: n - 1],)], "v array<int>").select(rolling(F.col("v"), n, F.least).alias("x")).collect()
    assert got[0]["x"] == [min(xs[i : i + n]) for i in range(len(xs) - n + 1)]
    assert got[1]["x"] == []


def test_longest_run(spark):
    xs = sorted([3, 1, 3, 3, 2, 2])
    assert spark.createDataFrame([(xs,)], "v array<bigint>").select(longest_run(F.col("v")).alias("x")).first()["x"] == max(Counter(xs).values())


def test_fold_by_brute_force(spark):
    import random

    rng = random.Random(5)
    blocks = [*range(0x20, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2060), 0x300, 0x301, 0x3A3, 0x3C3, 0x130, 0xFB01, 0x1F600]
    texts = ["".join(chr(rng.choice(blocks)) for _ in range(rng.randrange(40))) for _ in range(300)] + [chr(c) for c in blocks] + ["ΣΑΣ", "Élan vital’s", "été"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold(F.col("t")).alias("f")).collect()
    assert [(r["t"], r["f"]) for r in rows] == [(t, T._fold(t)) for t in texts]
