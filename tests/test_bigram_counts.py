from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluation


def test_counted_pairs_give_the_losses_of_single_tokens(spark):
    docs = spark.createDataFrame([(1, "a b a b c", "x"), (2, "b a a", "y"), (3, "a b", "x"), (4, "z", "y"), (5, "", None)], "doc_id int, text string, source string")
    words = F.split("text", " ")
    tokens = docs.select("doc_id", F.posexplode(words).alias("pos", "tok"))
    single = evaluation.bigram_losses(tokens).join(docs, "doc_id").groupBy("source").agg(F.sum("total_loss").alias("loss"), F.sum("n_tokens").alias("n"))
    pairs = evaluation.token_pairs(docs, words, "source")
    counted = evaluation.pair_losses(pairs, evaluation.add_alpha(pairs, tokens.select("tok").distinct().count()), "source")
    got = {r["source"]: (r["n_tokens"], r["total_loss"]) for r in counted.collect()}
    want = {r["source"]: (r["n"], r["loss"]) for r in single.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_kneser_ney_losses_are_those_of_the_joined_model_and_no_join_is_made(spark):
    docs = spark.createDataFrame([(1, "a b a b c", "x"), (2, "b a a", "y"), (3, "a b", "x"), (4, "z", "y"), (5, "", None), (6, "a b c c", None)], "doc_id int, text string, source string")
    pairs = evaluation.token_pairs(docs, F.split("text", " "), "source")
    lost = evaluation.kneser_ney_losses(pairs, "source")
    shown = lambda df: {r["source"]: (r["n_tokens"], pytest.approx(r["total_loss"])) for r in df.collect()}
    assert shown(lost) == shown(evaluation.pair_losses(pairs, evaluation.kneser_ney(pairs), "source")) and lost.count() == 3
    assert "Join" not in lost._jdf.queryExecution().executedPlan().toString()
    assert evaluation.kneser_ney_losses(pairs.where("false"), "source").count() == 0
    total = evaluation.kneser_ney_losses(pairs).first()
    assert total["n_tokens"] == sum(r["n_tokens"] for r in lost.collect())
