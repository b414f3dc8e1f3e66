"""Cleaning steps and the pipeline that counts what each step rejects.

A step takes the columns as they are at that point (``text``, ``lang``) and tells which rows stay; some steps also
rewrite a column. The pipeline evaluates the steps of rejected rows no further: every predicate is guarded by the
step that rejected before, and one aggregation over (source, reject_step) gives all counters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.frames import aside
from millrace.functions.arrays import let
from millrace.plans.registry import Registry

#: Fixed value: the default phrases of the boilerplate step.
BOILERPLATE = (
    "conditions générales",
    "politique de confidentialité",
    "tous droits réservés",
    "accepter les cookies",
    "javascript est désactivé",
    "veuillez activer javascript",
    "lorem ipsum",
)


@dataclass(frozen=True)
class Step:
    """``keep`` is evaluated after ``rewrite`` (new columns from the old ones; ``old`` texts are in __before).

    ``mark``, where there is one, is evaluated before both and is __mark to them.
    """

    name: str
    keep: Callable[[], Column]
    rewrite: dict[str, Callable[[], Column]] = field(default_factory=dict)
    mark: Callable[[], Column] | None = None


FILTERS: Registry[Step] = Registry("filter")
_text = lambda: F.col("text")


@FILTERS.register("normalize")
def normalize(*, unify_apostrophes: bool = True) -> Step:
    return Step("normalize", lambda: _text() != "", {"text": lambda: T.normalize(_text(), unify_apostrophes=unify_apostrophes)})


@FILTERS.register("word_count")
def word_count(*, min_words: int = 50, max_words: int = 100_000) -> Step:
    return Step("word_count", lambda: T.word_figures(_text())["words"].between(min_words, max_words))


@FILTERS.register("mean_word_length")
def mean_word_length(*, lo: float = 3.0, hi: float = 10.0) -> Step:
    def keep() -> Column:
        of = T.word_figures(_text())
        return F.when(of["words"] > 0, (of["chars"] / of["words"]).between(lo, hi)).otherwise(False)

    return Step("mean_word_length", keep)


@FILTERS.register("alpha_ratio")
def alpha_ratio(*, min_ratio: float = 0.75) -> Step:
    def keep() -> Column:
        of = T.word_figures(_text())
        return F.when(of["words"] > 0, of["lettered"] / of["words"] >= min_ratio).otherwise(False)

    return Step("alpha_ratio", keep)


@FILTERS.register("symbol_ratio")
def symbol_ratio(*, max_ratio: float = 0.1, symbols: str = "#…") -> Step:
    def keep() -> Column:
        n = T.word_figures(_text())["words"]
        count = F.lit(0)
        for s in [*symbols, "..."]:
            count = count + (F.length(_text()) - F.length(F.replace(_text(), F.lit(s), F.lit("")))) / len(s)
        return F.when(n > 0, count / n <= max_ratio).otherwise(False)

    return Step("symbol_ratio", keep)


@FILTERS.register("stopword_density")
def stopword_density(*, lang: str = "fr", min_density: float = 0.05) -> Step:
    return Step("stopword_density", lambda: T.with_language_scores(_text(), lambda s: s[lang] >= min_density))


@FILTERS.register("language_is")
def language_is(*, lang: str = "fr", min_score: float = 0.05, margin: float = 1.2) -> Step:
    def judged(scores: dict[str, Column]) -> Column:
        others = [s for k, s in scores.items() if k != lang]
        best = F.greatest(*others) if len(others) > 1 else others[0]
        return (scores[lang] >= min_score) & (scores[lang] >= margin * best)

    # Judged once: the new language carries the verdict for keep().
    mark = lambda: T.with_language_scores(_text(), lambda s: F.when(judged(s), F.lit(lang)))
    return Step("language_is", lambda: F.col("__mark").isNotNull(), {"lang": lambda: F.coalesce("__mark", "lang")}, mark)


@FILTERS.register("duplicate_lines")
def duplicate_lines(*, max_ratio: float = 0.3, min_length: int = 10) -> Step:
    def keep() -> Column:
        lines = F.filter(F.transform(F.split(_text(), "\n"), T.strip), lambda x: F.length(x) >= min_length)
        return let(lines, lambda x: (F.size(x) < 4) | (1 - F.size(F.array_distinct(x)) / F.size(x) <= max_ratio))

    return Step("duplicate_lines", keep)


@FILTERS.register("repeated_ngrams")
def repeated_ngrams(*, n: int = 10, max_ratio: float = 0.2) -> Step:
    """Grams are compared by 64-bit hashes within a text, in Arrow batches."""
    weights = np.random.default_rng(n).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)

    def top(t: str) -> tuple[int, int]:
        """The words of a text, and how often its most frequent gram occurs (0 where there are fewer than two grams' words)."""
        w = T.split(t)
        if len(w) < 2 * n:
            return len(w), 0
        known: dict[str, int] = {}
        ids = np.array([known.setdefault(x, len(known)) for x in w], dtype=np.uint64)
        grams = sum(ids[k : len(w) - n + 1 + k] * weights[k] for k in range(n))
        grams.sort()
        starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        return len(w), int(np.diff(np.append(starts, len(grams))).max())

    def run(x: pa.Array) -> pa.Array:
        rows = [None if t is None else top(t) for t in x.to_pylist()]
        return pa.array([None if r is None else r[0] < 2 * n or r[1] * n / r[0] <= max_ratio for r in rows], pa.bool_())

    return Step("repeated_ngrams", lambda: F.arrow_udf(run, "boolean")(F.lower(_text())))


@FILTERS.register("boilerplate")
def boilerplate(*, terms: tuple[str, ...] = BOILERPLATE, max_hits: int = 1) -> Step:
    """Counts the different terms that occur, not their occurrences."""

    def keep() -> Column:
        return let(F.lower(_text()), lambda t: sum((F.contains(t, F.lit(x.lower())).cast("int") for x in terms), F.lit(0)) <= max_hits)

    return Step("boilerplate", keep)


@FILTERS.register("drop_short_lines")
def drop_short_lines(*, min_words: int = 3, keep_ratio: float = 0.5) -> Step:
    """Drops lines of few words (blank ones stay); rejects a text that loses more than its share of characters."""

    def cut(t: str) -> str:
        counted = ((line, len(T.split(line))) for line in t.split("\n"))
        return T.normalized("\n".join(line for line, n in counted if n >= min_words or n == 0))

    return Step("drop_short_lines", lambda: (_text() != "") & (F.length(_text()) >= keep_ratio * F.length("__before")), {"text": lambda: T.mapped(cut)(_text())})


@FILTERS.register("detect_lang")
def detect_lang(*, min_score: float = 0.0) -> Step:
    def judged(scores: dict[str, Column]) -> Column:
        return F.when(F.greatest(*scores.values()) < min_score, F.col("lang")).otherwise(T.detect_language(scores))

    return Step("detect_lang", lambda: F.lit(True), {"lang": lambda: T.with_language_scores(_text(), judged)})


def build(specs: list[dict]) -> list[Step]:
    """Steps from ``{"name": ..., **params}``; an unknown name raises with those that exist."""
    return [FILTERS.build(spec) for spec in specs]


def _once(df: DataFrame, **new: Column) -> DataFrame:
    """``df`` with new columns that are computed once a row: Spark merges projections and would write out a rewritten
    text wherever a later step mentions it, but leaves what a generator gives alone.
    """
    taken = {c.lower() for c in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], F.inline(F.array(F.struct(*[v.alias(c) for c, v in new.items()]))))


def apply(docs: DataFrame, steps: list[Step]) -> DataFrame:
    """``docs`` with ``reject_step``: the first step that rejects the row, null if it passes all.

    A null text is rejected by the first step that looks at it. Rows keep their columns, but for a ``reject_step`` of before; ``text`` and ``lang`` are as
    the last step that saw the row left them.
    """
    docs, back = aside(docs, "__mark", "__before")
    names = [*docs.columns, *(["reject_step"] if "reject_step" not in docs.columns else [])]
    out = docs.withColumn("reject_step", F.lit(None).cast("string"))
    alive = F.col("reject_step").isNull()
    # Steps up to the next one that rewrites are one WHEN, which stops at the first branch that holds: rows alive only are looked at.
    told = F.when(~alive, F.col("reject_step"))
    for step in steps:
        if step.mark or step.rewrite:
            out = _once(out, reject_step=told)
            told = F.when(~alive, F.col("reject_step"))
        if step.mark:
            out = _once(out, __mark=F.when(alive, step.mark()))
        if step.rewrite:
            out = _once(out.withColumn("__before", F.col("text")), **{c: F.when(alive, f()).otherwise(F.col(c)) for c, f in step.rewrite.items()})
        told = told.when(~F.coalesce(step.keep(), F.lit(False)), F.lit(step.name))
        if step.mark or step.rewrite:
            out = _once(out, reject_step=told).drop("__before", "__mark")
            told = F.when(~alive, F.col("reject_step"))
    return back(_once(out, reject_step=told).select(*[F.col(f"`{c}`") for c in names]))


def clean(docs: DataFrame, steps: list[Step]) -> DataFrame:
    return apply(docs, steps).where(F.col("reject_step").isNull()).drop("reject_step")


def rejections(applied: DataFrame) -> DataFrame:
    """Counts by (source, step): source is the row's own; step null counts the rows kept."""
    return applied.groupBy("source", "reject_step").agg(F.count(F.lit(1)).alias("n"))


def summary(applied: DataFrame) -> DataFrame:
    """By source and overall (null source): seen, kept, keep_rate and ``rejected``, a map of the counts by step."""
    by_step = applied.groupBy("source", "reject_step").agg(F.count(F.lit(1)).alias("n"))
    # A source that is null itself is told from the overall row by ``overall``.
    leveled = by_step.select(F.explode(F.array(F.struct(F.lit(False).alias("overall"), "source"), F.struct(F.lit(True).alias("overall"), F.lit(None).cast("string").alias("source")))).alias("g"), "reject_step", "n")
    counted = leveled.groupBy("g.overall", "g.source", "reject_step").agg(F.sum("n").alias("n"))
    entries = F.collect_list(F.when(F.col("reject_step").isNotNull(), F.struct("reject_step", "n")))
    out = counted.groupBy("overall", "source").agg(F.sum("n").alias("seen"), F.coalesce(F.sum(F.when(F.col("reject_step").isNull(), F.col("n"))), F.lit(0)).alias("kept"), F.map_from_entries(F.sort_array(entries)).alias("rejected"))
    return out.withColumn("keep_rate", F.when(F.col("seen") > 0, F.col("kept") / F.col("seen")).otherwise(0.0))
