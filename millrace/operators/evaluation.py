"""Grouped losses, probes, comparisons of runs, and predicates over answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.storage import materialize

#: The parts of an instruction prompt, and the marks at which an answer ends.
INSTRUCTION, INPUT, ANSWER = "### Instruction\n", "\n### Entrée\n", "\n### Réponse\n"


def scores(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of loss, tokens, chars and documents by group and, with ``by``, overall (null group), and what they give.

    loss = loss per token, ppl = exp of it (20 at most), bpc = bits per character; NaN where there is nothing.
    """
    nan = F.lit(float("nan"))
    grouped = rows.rollup(*by) if by else rows.groupBy()
    out = grouped.agg(*[F.sum(c).alias(c) for c in ("total_loss", "n_tokens", "n_chars", "n_documents")])
    loss = F.when(F.col("n_tokens") > 0, F.col("total_loss") / F.col("n_tokens")).otherwise(nan)
    return out.withColumns({"loss": loss, "ppl": F.when(F.isnan(loss), nan).otherwise(F.exp(F.least(loss, F.lit(20.0)))), "bpc": F.when(F.col("n_chars") > 0, F.col("total_loss") / F.ln(F.lit(2.0)) / F.col("n_chars")).otherwise(nan)})


def bigram_losses(tokens: DataFrame, *, alpha: float = 0.5) -> DataFrame:
    """(doc_id, total_loss, n_tokens) under an add-alpha bigram model of the corpus; ``tokens`` has doc_id, pos, tok.

    The first token of a document is not predicted; documents of fewer than two tokens have no row.
    """
    pairs = tokens.withColumn("prev", F.lag("tok").over(W.partitionBy("doc_id").orderBy("pos"))).where("prev is not null")
    vocab = tokens.select("tok").distinct().count()
    both = pairs.groupBy("prev", "tok").agg(F.count(F.lit(1)).alias("n"))
    first = both.groupBy("prev").agg(F.sum("n").alias("m"))
    logs = both.join(first, "prev").select("prev", "tok", (-F.ln((F.col("n") + alpha) / (F.col("m") + alpha * vocab))).alias("loss"))
    return pairs.join(logs, ["prev", "tok"]).groupBy("doc_id").agg(F.sum("loss").alias("total_loss"), F.count(F.lit(1)).alias("n_tokens"))


def token_pairs(docs: DataFrame, tokens: Column, *by: str) -> DataFrame:
    """(by, prev, tok, n): how often a token follows another, by group; neighbours meet inside the arrays, and counts are summed before the shuffle."""
    listed = docs.select(*by, tokens.alias("t")).where(F.size("t") > 1)
    pairs = F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.struct(a.alias("prev"), b.alias("tok")))
    return listed.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.prev", "p.tok").agg(F.count(F.lit(1)).alias("n"))


def add_alpha(pairs: DataFrame, vocab: int, alpha: float = 0.5) -> DataFrame:
    """(prev, tok, loss) of the pairs counted in ``pairs`` (prev, tok, n), under an add-alpha model of them over ``vocab`` tokens."""
    both = pairs.groupBy("prev", "tok").agg(F.sum("n").alias("n"))
    first = both.groupBy("prev").agg(F.sum("n").alias("m"))
    return both.join(first, "prev").select("prev", "tok", (-F.ln((F.col("n") + alpha) / (F.col("m") + alpha * vocab))).alias("loss"))


def kneser_ney(pairs: DataFrame, discount: float = 0.75) -> DataFrame:
    """(prev, tok, loss) of the pairs counted in ``pairs`` (prev, tok, n), under an interpolated Kneser-Ney model of them.

    What the discount takes from each pair goes to tokens by how many different ones they follow.
    """
    counted = pairs.groupBy("prev", "tok").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "pairs")
    before = counted.groupBy("prev").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("kinds"))
    after = counted.groupBy("tok").agg(F.count(F.lit(1)).alias("follows"))
    n_kinds = counted.count()
    p = (F.col("n") - discount) / F.col("m") + discount * F.col("kinds") / F.col("m") * F.col("follows") / F.lit(float(n_kinds or 1))
    return counted.join(before, "prev").join(after, "tok").select("prev", "tok", (-F.ln(p)).alias("loss"))


def kneser_ney_losses(pairs: DataFrame, *by: str, discount: float = 0.75) -> DataFrame:
    """(by, total_loss, n_tokens) of counted pairs (by, prev, tok, n) under the model that :func:`kneser_ney` makes of them.

    Pairs are dealt twice, by the token before and by the token; what the model needs is summed where they lie, so it is never joined with them.
    """
    pair, before = W.partitionBy("prev", "tok"), W.partitionBy("prev")
    dealt = pairs.repartition("prev").withColumn("first", (F.row_number().over(pair.orderBy(*by or ("n",))) == 1).cast("bigint"))
    dealt = dealt.select(*by, "tok", "first", F.col("n").alias("own"), F.sum("n").over(pair).alias("n"), F.sum("n").over(before).alias("m"), F.sum("first").over(before).alias("kinds"))
    dealt = materialize(dealt, "pairs")
    n_kinds = dealt.agg(F.sum("first")).first()[0]
    follows = F.sum("first").over(W.partitionBy("tok"))
    p = (F.col("n") - discount) / F.col("m") + discount * F.col("kinds") / F.col("m") * follows / F.lit(float(n_kinds or 1))
    lost = dealt.select(*by, "own", (-F.ln(p)).alias("loss"))
    return lost.groupBy(*by).agg(F.sum(F.col("own") * F.col("loss")).alias("total_loss"), F.sum("own").alias("n_tokens"))


def pair_losses(pairs: DataFrame, model: DataFrame, *by: str) -> DataFrame:
    """(by, total_loss, n_tokens) of counted pairs under a model (prev, tok, loss); no token is a row of its own here."""
    met = pairs.join(model, ["prev", "tok"])
    return met.groupBy(*by).agg(F.sum(F.col("n") * F.col("loss")).alias("total_loss"), F.sum("n").alias("n_tokens"))


def sequence_logprob(rows: DataFrame, key: str) -> DataFrame:
    """Total log-probability of each sequence of token log-probabilities (pos, logp); -inf below two tokens."""
    return rows.groupBy(key).agg(F.when(F.count(F.lit(1)) >= 2, F.sum("logp")).otherwise(F.lit(float("-inf"))).alias("logprob"))


def probes(rows: DataFrame) -> DataFrame:
    """Accuracy of minimal pairs by category and overall: a pair is right if the good one is strictly likelier."""
    return rows.rollup("category").agg(F.sum((F.col("good") > F.col("bad")).cast("bigint")).alias("correct"), F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.try_divide("correct", "total"))


def compare_runs(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """(measure, base, tuned, change): the relative change of a perplexity, the difference of anything else."""
    met = base.select("measure", "kind", F.col("value").alias("base")).join(tuned.select("measure", F.col("value").alias("tuned")), "measure")
    return met.withColumn("change", F.when(F.col("kind") == "ppl", F.try_divide("tuned", "base") - 1).otherwise(F.col("tuned") - F.col("base")))


def latest_delta(evals: DataFrame) -> DataFrame:
    """Each evaluation's change against the one before it, in per cent: ``evals`` has label, at, value."""
    before = F.lag("value").over(W.partitionBy("label").orderBy("at"))
    return evals.withColumn("delta_pct", 100 * F.try_divide(F.col("value") - before, before))


def instruction_prompt(instruction: Column, given: Column) -> Column:
    with_input = F.when(T.strip(F.coalesce(given, F.lit(""))) != "", F.concat(F.lit(INPUT), T.strip(given))).otherwise("")
    return F.concat(F.lit(INSTRUCTION), T.strip(instruction), with_input, F.lit(ANSWER))


def truncated(answer: Column, marks: tuple[str, ...]) -> Column:
    """Cut at the first occurrence of each mark in turn."""
    for m in marks:
        answer = F.substring_index(answer, m, 1)
    return answer


def verify(check: Column, answer: Column) -> Column:
    """Programmatic checks of an answer: liste3, court, phrase, francais; an empty answer fails all."""
    t = T.strip(F.coalesce(answer, F.lit("")))
    n = T.n_words(t)
    items = F.size(F.filter(F.split(t, r"(?md)[,\n]|^\s*[-•*]\s*"), lambda x: T.strip(x) != ""))
    out = F.when(t == "", False).when(check == "liste3", items >= 3).when(check == "court", n <= 8).when(check == "phrase", n.between(3, 60))
    return out.when(check == "francais", T.with_language_scores(t, lambda s: s["fr"] >= 0.05)).otherwise(False)


def flops_per_token(parameters: int, layers: int, width: int, length: int) -> int:
    return 6 * parameters + 12 * layers * width * length


def training_hours(parameters: int, layers: int, width: int, length: int, tokens: int, tflops: float) -> float:
    return flops_per_token(parameters, layers, width, length) * tokens / (tflops * 1e12) / 3600


def kernel_summary(rows: DataFrame) -> DataFrame:
    """Best TFLOPS by benchmark and dtype; ``rows`` as the benchmark writes them, nulls where a figure is missing."""
    return rows.groupBy("benchmark", "dtype").agg(F.max("tflops").alias("tflops"), F.max("gb_per_s").alias("gb_per_s"))


def sweep_verdict(rows: DataFrame) -> DataFrame:
    """The best rate by width (NaN losses ignored), and whether it is the same at every width."""
    best = rows.where(~F.isnan("loss")).groupBy("optimizer", "width").agg(F.min_by("lr", F.struct("loss", "lr")).alias("lr"))
    return best.groupBy("optimizer").agg((F.count_distinct("lr") == 1).alias("transfers"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("width", "lr")))).alias("best"))


#: Minimal pairs of French: category, the right sentence, the wrong one.
PROBES = (
    ("accord", "Les enfants jouent dehors.", "Les enfants joue dehors."),
    ("accord", "La porte est ouverte.", "La porte est ouvert."),
    ("accord", "Ces maisons sont anciennes.", "Ces maisons sont ancien."),
    ("genre", "Une grande table ronde.", "Un grande table ronde."),
    ("genre", "Le soleil est brillant.", "La soleil est brillant."),
    ("negation", "Je ne mange pas de pain.", "Je ne mange de pas pain."),
    ("elision", "L'arbre du jardin est haut.", "Le arbre du jardin est haut."),
    ("elision", "J'arrive demain matin.", "Je arrive demain matin."),
    ("ordre", "Il a beaucoup de livres.", "Il a livres de beaucoup."),
    ("preposition", "Elle pense à son frère.", "Elle pense de à son frère."),
)


def probe_set(spark: SparkSession) -> DataFrame:
    """(id, category, good, bad): sentences to be scored by a model and judged by :func:`probes`."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PROBES)], "id int, category string, good string, bad string")


def answer_scores(answers: DataFrame) -> DataFrame:
    """Per model: how many answers (model, check, answer, stopped) keep their format, stop by themselves and are French, of how many.

    An answer ends where a new block (``###``) begins.
    """
    cut = T.strip(F.substring_index(F.coalesce("answer", F.lit("")), "###", 1))
    french = T.with_language_scores(cut, lambda s: s["fr"] >= 0.05)
    counted = lambda x, name: F.count_if(x).alias(name)
    return answers.groupBy("model").agg(counted(verify(F.col("check"), cut), "format"), counted(F.col("stopped"), "stopped"), counted(french, "french"), F.count(F.lit(1)).alias("total"))


def campaign(losses: DataFrame, judge: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(part, name, measure, value): perplexity and bits per character by source and overall, of a second corpus, and probe accuracies."""

    def unrolled(rows: DataFrame, part: str, name: str, *measures: str) -> DataFrame:
        values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
        return rows.select(F.lit(part).alias("part"), F.coalesce(F.col(name).cast("string"), F.lit("all")).alias("name"), values.alias("x")).select("part", "name", "x.*")

    out = unrolled(scores(losses, "source"), "perplexity", "source", "ppl", "bpc")
    if judge is not None:
        out = out.unionByName(unrolled(scores(judge).withColumn("source", F.lit(None)), "judge", "source", "ppl", "bpc"))
    return out if pairs is None else out.unionByName(unrolled(probes(pairs), "probes", "category", "accuracy"))


def training_flops(parameters: Column, tokens: Column) -> Column:
    """The usual estimate: six operations a parameter and token."""
    return 6.0 * parameters * tokens


def tokens_for_budget(parameters: Column, hours: Column, tflops: Column) -> Column:
    """Tokens that so many hours at a real rate are worth."""
    return tflops * 1e12 * hours * 3600.0 / (6.0 * parameters)


def utilization(tokens_per_second: Column, flops: Column, peak: Column) -> Column:
    """The share of the peak that training uses; a peak that is not positive raises."""
    return F.when(peak > 0, tokens_per_second * flops / peak).otherwise(F.raise_error(F.lit("the peak must be positive")))


def kernel_report(rows: DataFrame) -> DataFrame:
    """One row: peak TFLOPS of matmul by dtype, bfloat16 over float32, peak bandwidth, attention TFLOPS by length."""
    matmul, attention = rows.where("benchmark = 'matmul'"), rows.where("benchmark = 'attention'")
    entries = lambda df, k, v: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v)))).alias("m")).select("m")
    peak = entries(matmul.groupBy("dtype").agg(F.max("tflops").alias("tflops")), "dtype", "tflops").withColumnRenamed("m", "peak_tflops")
    by_length = entries(attention.groupBy("seq_len").agg(F.max("tflops").alias("tflops")), "seq_len", "tflops").withColumnRenamed("m", "attention_tflops")
    band = rows.agg(F.max(F.when(F.col("benchmark") == "bandwidth", F.col("gb_per_s"))).alias("peak_gb_per_s"))
    ratio = F.try_divide(F.nullif(F.col("peak_tflops")["bfloat16"], F.lit(0.0)), F.col("peak_tflops")["float32"])
    one = lambda df: df.withColumn("k", F.lit(1))
    # Each side is the one row of an aggregation.
    return one(peak.withColumn("bf16_over_fp32", ratio)).join(one(band), "k").join(one(by_length), "k").drop("k")


def mean_loss(batches: DataFrame, *by: str) -> DataFrame:
    """The mean loss of evaluation batches, NaNs left out."""
    return batches.where(~F.isnan("loss")).groupBy(*by).agg(F.avg("loss").alias("val_loss"), F.count(F.lit(1)).alias("batches"))
