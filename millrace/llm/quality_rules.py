"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean expression that is true for a text to reject, with an expression for its cost on that text: how
many characters and words its functions go over, weighted by ``NANOSECONDS``. Both are evaluated in one aggregation over a sample,
which gives each rule's cost and selectivity (rejected share); rules then run in the order of rejection per cost, and a
text that one rule rejects is not looked at by the later ones (``CASE WHEN`` evaluates its branches in turn). The order changes
the work, never the verdict: a text is kept if no rule rejects it. Costs are counted, not timed, and the sample is drawn by a
hash of the ids over all rows, so reruns give the same order.

A text is cut into words once, whatever the number of rules that use them.

Defined results: a null text is the empty text; it has no words and is rejected as too short. Ties and repeated rows
are judged row by row. Columns of the input are untouched, whatever their names. An empty table has no costs and no
rejections, and the rules stay in the order of their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
#: Rows of the sample on which the order of the rules is estimated (about as many); it never changes a verdict.
SAMPLE_ROWS = 2000
#: The cost model: what a character (windows: a word) costs a function, measured once on 10,000 texts of 2.5 kB.
NANOSECONDS = {"row": 100.0, "replace": 0.7, "split": 5.7, "count": 6.5, "remove": 17.4, "backtrack": 23.3, "window": 360.0}


@dataclass(frozen=True)
class Parts:
    """What rules look at: a text (not null), its words, and measures that are known already."""

    text: Column
    words: Column
    known: dict[str, Column] = field(default_factory=dict)

    def measure(self, f: Callable[[Parts], Column]) -> Column:
        return self.known.get(f.__name__, f(self))

    def per_character(self, function: str, *measures: Callable[[Parts], Column]) -> Column:
        """The cost of going over the text; next to nothing where it was for ``measures`` that are known."""
        free = bool(measures) and all(m.__name__ in self.known for m in measures)
        return F.lit(NANOSECONDS["row"]) + F.lit(0.0 if free else NANOSECONDS[function]) * F.length(self.text)

    def per_word(self, function: str, *measures: Callable[[Parts], Column]) -> Column:
        free = bool(measures) and all(m.__name__ in self.known for m in measures)
        return F.lit(NANOSECONDS["row"]) + F.lit(0.0 if free else NANOSECONDS[function]) * F.size(self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    reject: Callable[[Parts], Column]
    cost: Callable[[Parts], Column]


def n_words(p: Parts) -> Column:
    return F.size(p.words).cast("long")


def word_chars(p: Parts) -> Column:
    text = p.text
    for space in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(""))
    return F.length(text).cast("long")


def n_symbols(p: Parts) -> Column:
    return F.regexp_count(p.text, F.lit(SYMBOLS)).cast("long")


def n_dup_lines(p: Parts) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(p.text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return common.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(p: Parts) -> Column:
    """Words in 8-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Only texts with a repeated hash pay for
    the sort that finds which windows repeat; the covered words are the union of their spans.
    """
    windows = common.rolling(F.transform(p.words, lambda w: F.xxhash64(w)), WINDOW, F.xxhash64)

    def covered(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s, x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        repeats = common.let(ordered, lambda s: F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["p"]))
        spans = common.let(F.sort_array(repeats), lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    return common.let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))).cast("long")


def n_stuttered(p: Parts) -> Column:
    """Words that equal the word before them (counted as words whose next word is equal)."""
    return F.regexp_count(p.text, F.lit(r"(?<!\S)(\S++)(?=\s++\1(?!\S))")).cast("long")


def n_shouted(p: Parts) -> Column:
    return (F.octet_length(p.text) - F.octet_length(F.replace(p.text, F.lit("!"), F.lit("")))).cast("long")


def base_rules() -> list[Rule]:
    return [
        Rule("too_short", lambda p: p.measure(n_words) < MIN_WORDS, lambda p: F.lit(NANOSECONDS["row"])),
        Rule("repeated_windows", lambda p: 100 * p.measure(n_repeat_words) > 30 * p.measure(n_words), lambda p: p.per_word("window", n_repeat_words)),
    ]


def method_rules() -> list[Rule]:
    """Rules on the share of symbols, shouting, stuttering and repeated lines, and on the mean length of words."""

    def repeated_lines(p: Parts) -> Column:
        dups = p.measure(n_dup_lines)
        return (dups >= 4) & (10 * dups > 6 * F.size(F.split(p.text, "\n")))

    def word_length(p: Parts) -> Column:
        chars, n = p.measure(word_chars), p.measure(n_words)
        return (chars < 2 * n) | (chars > 25 * n)

    return [
        Rule("symbols", lambda p: 10 * p.measure(n_symbols) > 3 * p.measure(n_words), lambda p: p.per_character("count", n_symbols)),
        Rule("shouting", lambda p: 10 * n_shouted(p) > 3 * p.measure(n_words), lambda p: p.per_character("replace")),
        Rule("stutter", lambda p: 10 * n_stuttered(p) > 3 * p.measure(n_words), lambda p: p.per_character("backtrack")),
        Rule("duplicate_lines", repeated_lines, lambda p: p.per_character("split", n_dup_lines)),
        Rule("word_length", word_length, lambda p: p.per_character("remove", word_chars)),
    ]


def over_parts(text: Column, body: Callable[[Parts], Column]) -> Column:
    """``body`` of a text's parts, the text cut into words once; a null text is the empty one."""
    # Bound as values of a lambda: Spark neither pushes them apart nor cuts the words again for each rule.
    both = F.struct(F.coalesce(text.cast("string"), F.lit("")).alias("t"), common.words(text.cast("string")).alias("w"))
    return common.let(both, lambda x: body(Parts(x["t"], x["w"])))


def estimate(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, measures: tuple[Callable[[Parts], Column], ...] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, nanoseconds, rejected share) of each rule over a sample of ``docs``, with ``measures`` known.

    The sample is drawn by a hash of the row's id (of its text where there is no doc_id) over all rows: rows that share
    it are in or out together. It is aggregated where it is read; only sums reach the driver.
    """
    n = docs.count()
    of = F.col("doc_id").cast("string") if "doc_id" in docs.columns else F.col(text).cast("string")
    drawn = docs.where(F.pmod(F.xxhash64(of, F.lit("rules")), F.lit(1 << 30)) < F.lit((1 << 30) * min(1.0, sample_rows / max(1, n))))

    def judged(p: Parts) -> Column:
        p = Parts(p.text, p.words, {m.__name__: m(p) for m in measures})
        return F.array(*[F.struct(r.reject(p).cast("double").alias("hit"), r.cost(p).alias("cost")) for r in rules])

    rows = drawn.select(over_parts(F.col(text), judged).alias("x"))
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[i][c]) for i in range(len(rules)) for c in ("cost", "hit")]).first()
    total = max(1, sums[0])
    return [(r, (sums[1 + 2 * i] or 0.0) / total, (sums[2 + 2 * i] or 0.0) / total) for i, r in enumerate(rules)]


def ordered(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, measures: tuple[Callable[[Parts], Column], ...] = ()) -> list[Rule]:
    """The rules by rejection per cost, the highest first; of equal ones the cheaper, then by name."""
    found = estimate(docs, rules, text, sample_rows, measures)
    return [r for r, cost, share in sorted(found, key=lambda x: (-x[2] / max(1.0, x[1]), x[1], x[0].name))]


def cascade(rules: list[Rule], p: Parts) -> Column:
    """The name of the first rule that rejects, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        out = out.when(rule.reject(p), F.lit(rule.name))
    return out


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they were."""
    rules = ordered(docs, base_rules() + method_rules(), text)
    return docs.where(over_parts(F.col(text), lambda p: cascade(rules, p)).isNull())


BASE = (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)


def verdicts(docs: DataFrame) -> DataFrame:
    """A row per document: the base measures, and whether the cascade keeps it.

    The measures are results of every row, so they are taken first; the cascade of the other rules finds them known, and
    its order is that of the costs with them known.
    """
    rules = ordered(docs.select("doc_id", "text"), method_rules(), measures=BASE)

    def judged(p: Parts) -> Column:
        def rest(m: Column) -> Column:
            known = {f.__name__: m[f.__name__] for f in BASE}
            failed = (known["n_words"] < MIN_WORDS) | (100 * known["n_repeat_words"] > 30 * known["n_words"])
            rule = F.when(failed, F.lit("base")).otherwise(cascade(rules, Parts(p.text, p.words, known)))
            return F.struct(*[known[f.__name__].alias(f.__name__) for f in BASE], failed.alias("base_failed"), rule.isNull().alias("kept"), rule.alias("reject_rule"))

        return common.let(F.struct(*[f(p).alias(f.__name__) for f in BASE]), rest)

    return docs.select("doc_id", over_parts(F.col("text"), judged).alias("x")).select("doc_id", "x.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The name of the rule depends on the measured order; only the verdict is a result.
    return verdicts(common.table(spark, sf_dir, "documents")).drop("reject_rule")


#: The same result for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), m AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')) ELSE [] END AS g
  FROM d
), x AS (
  SELECT doc_id, unnest(g) AS gram, unnest(range(len(g))) AS p, unnest(list_transform(g, lambda _: t)) AS t FROM m
), c AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, t, gram) AS n FROM x
), s AS (
  SELECT doc_id, least(8, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 8)) AS k FROM c WHERE n > 1
), r AS (
  SELECT doc_id, sum(k)::BIGINT AS n_repeat_words FROM s GROUP BY doc_id
), f AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(t, '!')) AS bangs, len(string_split(t, chr(10))) AS n_lines,
    CASE WHEN len(w) > 1 THEN len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) ELSE 0 END AS stutter
  FROM m LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * bangs > 3 * n_words OR 10 * stutter > 3 * n_words
    OR (n_dup_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines)
    OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""
