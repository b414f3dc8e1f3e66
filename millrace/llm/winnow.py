"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ten consecutive words of a benchmark item, or the whole of a shorter item. Both sides hash their k-grams of
words (k is half the window) and take, for every window of a text, the smallest k-gram hash in it. It is a fingerprint
of the text, noted only where it changes from one window to the next, with the places of the windows it stands for:
that leaves about two of seven places. Equal windows have equal smallest hashes, so every shared window is found by joining
fingerprints, which guarantees every shared span of ten words or more. A joined fingerprint is then extended left and
right over all windows it stands for, and these are compared with the benchmark's word by word; windows that occur one
after the other add up to the whole shared span, and its words are hit. Hashes decide only which windows are compared.

Only places and fingerprints are joined; the benchmark's are broadcast while their counted number stays within
``BROADCAST_FINGERPRINTS`` and joined by a shuffle beyond; so are its windows for the comparison (``BROADCAST_WINDOWS``).
Windows that many items share are one row there, so no pairs of places are made. The texts are read a second time for
the extension, but only those with a joined fingerprint are cut into words again.

Defined results: null and empty texts have no words and no hits; null, empty and repeated items are allowed (repeated
ids count once); each row of documents gets a row, repeated rows too.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_FINGERPRINTS = 1_000_000
#: Windows of words, about 70 bytes each.
BROADCAST_WINDOWS = 100_000


def folded(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the faster lower()."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def fingerprints(h: Column, length: int) -> Column:
    """array<struct<a, b, fp>>: the windows from place a to place b have fp as the smallest hash of their k-grams.

    Neighbouring windows mostly share their smallest hash, so a text of n words has about 2 n / (length - k + 2) entries.
    """
    k = max(1, length // 2)
    least = common.rolling(common.rolling(h, k, F.xxhash64), length - k + 1, F.least)

    def runs(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        entry = lambda s: F.transform(s, lambda a, j: F.struct(a.alias("a"), (F.coalesce(F.get(s, j + 1), F.size(m)) - 1).alias("b"), F.get(m, a).alias("fp")))
        return F.when(F.size(m) > 0, common.let(starts, entry)).otherwise(F.array().cast("array<struct<a:int,b:int,fp:bigint>>"))

    return common.let(least, runs)


def _windows(w: Column, length: Column, a: Column, b: Column) -> Column:
    """array<struct<len, s, window>>: the words of the windows at the places from a to b, joined by spaces."""
    return F.transform(F.sequence(a, b), lambda s: F.struct(length.alias("len"), s.alias("s"), F.array_join(F.slice(w, s + 1, length), " ").alias("window")))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(len, window, item_id) of every window of the items, each once; and their fingerprints (len, fp), each once."""
    cut = benchmark.select("item_id", common.words(folded(F.col("text")), BREAKS).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(WINDOW))
    windows = cut.select("item_id", F.explode(_windows(F.col("w"), length, F.lit(0), F.size("w") - length)).alias("x"))
    parts = []
    for n in range(1, WINDOW + 1):
        part = cut.where(F.size("w") >= WINDOW if n == WINDOW else F.size("w") == n)
        parts.append(part.select(F.lit(n).alias("len"), F.explode(fingerprints(hashes(F.col("w")), n)).alias("x")))
    prints = parts[0]
    for part in parts[1:]:
        prints = prints.unionByName(part)
    return windows.select("x.len", "x.window", "item_id").distinct(), prints.select("len", "x.fp").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, __key, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``."""
    bench, prints = (common.materialize(t, tag) for t, tag in zip(benchmark_windows(benchmark.select("item_id", "text")), ("bench-windows", "bench-prints"), strict=True))
    lengths = sorted(r[0] for r in prints.select("len").distinct().collect())  # ten values at most
    n = prints.count()

    hashed = docs.select("doc_id", common.row_key().alias("__key"), hashes(common.words(folded(F.col("text")), BREAKS)).alias("h"))
    # An entry of length 0 stands for the document itself, so that one pass over the texts gives words and fingerprints.
    entry = lambda length, x: F.struct(F.lit(length).alias("len"), x["a"].alias("a"), x["b"].alias("b"), x["fp"].alias("fp"))
    itself = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.size("h").cast("long").alias("fp"))
    listed = lambda length: F.transform(fingerprints(F.col("h"), length), lambda x: entry(length, x))
    sets = F.concat(F.array(entry(0, itself)), *map(listed, lengths))
    spread = hashed.select("doc_id", "__key", F.explode(sets).alias("r")).select("doc_id", "__key", "r.*")
    if n <= BROADCAST_FINGERPRINTS:
        # One pass: the documents' own entries pass the broadcast join unmatched.
        marked = spread.join(F.broadcast(prints.withColumn("known", F.lit(True))), ["len", "fp"], "left")
        met = marked.where("len = 0 or known").select(spread.columns)
    else:
        met = spread.where("len = 0").unionByName(spread.where("len > 0").join(prints, ["len", "fp"], "left_semi").select(spread.columns))
    met = common.materialize(met, "winnow-met")
    own = met.where("len = 0").select("doc_id", "__key", F.col("fp").alias("n_words"))

    # Extension: from every joined fingerprint left and right over the windows that it stands for, word by word.
    at = met.where("len > 0").groupBy("__key").agg(F.collect_set(F.struct("len", "a", "b")).alias("at"))
    at = common.materialize(at, "winnow-at")
    # Only keys are broadcast, 8 bytes a row; the places meet the few texts' words in a shuffled join.
    keys = common.small(at.select("__key"), at.count())
    texts = docs.select(common.row_key().alias("__key"), "text").join(keys, "__key", "left_semi")
    again = texts.select("__key", common.words(folded(F.col("text")), BREAKS).alias("w")).dropDuplicates(["__key"]).join(at.hint("merge"), "__key")
    grown = F.flatten(F.transform("at", lambda x: _windows(F.col("w"), x["len"], x["a"], x["b"])))
    whole = common.materialize(bench.select("len", "window").distinct(), "bench-texts")
    small = common.small(whole, whole.count(), BROADCAST_WINDOWS)
    hits = common.materialize(again.select("__key", F.explode(grown).alias("x")).select("__key", "x.*").join(small, ["len", "window"], "left_semi"), "winnow-hits")

    spans = hits.groupBy("__key").agg(F.sort_array(F.collect_set(F.struct("s", (F.col("s") + F.col("len")).alias("e")))).alias("spans"))
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n")),
        lambda a: a["n"],
    )
    covered = spans.select("__key", union.cast("long").alias("n_hit"))
    items = hits.select("__key", "len", "window").distinct().join(bench, ["len", "window"]).select("__key", F.col("item_id").cast("string").alias("item")).distinct()
    listed = items.groupBy("__key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    found = covered.join(listed, "__key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return own.join(found, "__key", "left").select(
        "doc_id",
        "__key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns as they were, whatever their names."""
    bad = common.materialize(contamination(docs, benchmark).where("contaminated").select("__key").distinct(), "winnow-bad")
    key = common.unused(docs, "__key")
    gone = common.small(bad, bad.count()).withColumnRenamed("__key", key)
    return docs.withColumn(key, common.row_key()).join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return contamination(docs.select("doc_id", "text"), benchmark).drop("__key")


#: The same result for DuckDB.
SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w), 10) - 10 + 2), lambda i: array_to_string(w[i:i+9], ' '))) AS g FROM b WHERE len(w) > 0
), n AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n.n, unnest(range(1, len(w) - n.n + 2)) AS s, unnest(list_transform(range(1, len(w) - n.n + 2), lambda i: array_to_string(w[i:i+n.n-1], ' '))) AS g FROM w, n WHERE len(w) >= n.n
), h AS (SELECT DISTINCT doc_id, s, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id
), i AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
