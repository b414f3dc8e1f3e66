"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of rows of a hashed table: one for the word, and one for each of its beginnings of
``PREFIXES`` letters that is shorter than the word, so that inflected forms share what they have in common. Filters one, two and three words wide slide over the embeddings,
each filter's largest response in the whole text is kept, and a logistic unit on these maxima gives the score.
In training a part (``DROPOUT``) of the rows is left out at random, so that
no score hangs on a single row. Every bucket that the rows learned from use has an embedding, however rare it is.

:func:`fit` learns from every labelled row. Spark deals the rows to blocks of about ``BLOCK_ROWS`` by a hash of their ids, the one shuffle of texts; in each of ``ROUNDS`` rounds
every block takes its share of the steps from the common model, in numpy with Adam, and Spark averages what the blocks
have changed (a row of the table over the blocks that moved it). Over the rounds a block goes over all of its rows at least once.
Changes are summed as whole numbers, so reruns agree. The driver gets the averages, at most ``BUCKETS`` rows however many documents there are.

Thresholds are calibrated by language on rows that the training has not seen (every fifth, by a hash of the id), by counts of all their logits in steps of 1 / ``GRID``;
the logit is shifted by its language's threshold, so that 0.5 is the threshold everywhere. The language of a text is
guessed from its words (a naive Bayes table over the same buckets, counted over all rows that are trained on);
the ``lang`` column is no input of a score. A language's threshold is drawn towards the common one by how few calibration
rows it has: m rows of the rarer label weigh against ``SHRINK`` rows of all languages, so every language with rows of both labels has its own.

Filters are applied to the different words of a batch; scoring a place is looking up and adding.

:func:`train` does the same with rows in memory, as one block; :func:`sample` draws up to ``SAMPLE_PER_LABEL`` documents of either label for it.
The query uses neither.

Defined results: null and empty texts, and all texts where nothing is labelled or only one label occurs, get the score
0 words give (0.0 if nothing was learned); repeated rows get a row each, and an id is learned from once for each of its labels.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.plans.storage import remove

from . import common

WORD = re.compile(r"\w+")
BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6, 7)
ROWS = 1 + len(PREFIXES)
DROPOUT = 0.5
DIMENSIONS = 12
FILTERS = 8
WIDTHS = (1, 2, 3)
PAD = 4  # empty places after each text: a filter sees some of them, and never another text
STEPS = 1200
BATCH = 48
PACE = 0.3  # of the embeddings, in units of the largest step's root mean square
DECAY = 1e-4
SAMPLE_PER_LABEL = 1500
CALIBRATION = 5  # every fifth row calibrates instead of training
SHRINK = 12
BLOCK_ROWS = 16_000  # about so many rows, or bytes of text, are learned from by one task between two averages
BLOCK_BYTES = 64 << 20
ROUNDS = 4
LABELS_ABROAD = 500_000  # most labels that go to every executor to be joined; more are shuffled with the texts
FIXED = 1 << 20  # changes are summed in units of 1 / FIXED
GRID = 1024
DIFFERENT_WORDS = 100_000  # that a task counts before it hands its counts on
PLACES = 1 << 22  # the same for words in all


def buckets(word: str) -> list[int]:
    """The word's bucket and those of its beginnings; -1 for a beginning that is not shorter than the word."""
    parts = [word, *("\0" + word[:n] if n < len(word) else "" for n in PREFIXES)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS if x else -1 for x in parts]


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


CRC = _crc_table()
SHORT = 32  # bytes; longer words are few, and take buckets()


def buckets_of(words: list[str]) -> np.ndarray:
    """:func:`buckets` of many words, a row each, byte by byte for all of them at once."""
    raws = [w.encode("utf-8", "replace") for w in words]
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    out = np.full((len(raws), ROWS), -1, np.int64)
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = buckets(words[i])
    at = np.flatnonzero(lengths <= SHORT)
    at = at[np.argsort(-lengths[at], kind="stable")]  # the longest first, so those that have a byte more are a slice
    if not len(at):
        return out
    lengths = lengths[at]
    n = int(lengths[0])
    flat = np.frombuffer(b"".join([raws[i].ljust(n + 1, b"\0") for i in at.tolist()]), np.uint8).reshape(len(at), n + 1)
    begins = (flat & 0xC0) != 0x80  # bytes at which a letter begins
    total = begins.sum(axis=1) - (n + 1 - lengths)
    letters = np.zeros(len(at), np.int64)
    whole = np.full(len(at), 0xFFFFFFFF, np.uint32)
    start = np.full(len(at), CRC[255] ^ np.uint32(0x00FFFFFF), np.uint32)  # after the \0 before a beginning
    short = np.full((len(at), ROWS), -1, np.int64)
    for j in range(n):
        live = int(np.searchsorted(-lengths, -j))
        byte = flat[:live, j]
        whole[:live] = CRC[whole[:live].astype(np.uint8) ^ byte] ^ (whole[:live] >> 8)
        if j >= 4 * PREFIXES[-1]:
            continue
        start[:live] = CRC[start[:live].astype(np.uint8) ^ byte] ^ (start[:live] >> 8)
        letters[:live] += begins[:live, j]
        for k, m in enumerate(PREFIXES, 1):
            if m <= j + 1 <= 4 * m:
                here = np.flatnonzero(begins[:live, j + 1] & (letters[:live] == m) & (total[:live] > m))
                short[here, k] = (start[here] ^ np.uint32(0xFFFFFFFF)) % BUCKETS
    short[:, 0] = (whole ^ np.uint32(0xFFFFFFFF)) % BUCKETS
    out[at] = short
    return out


@dataclass
class Batch:
    """Texts as places: ``ROWS`` buckets per place (compact numbers, 0 for none), and where each text starts."""

    unique: np.ndarray  # different words x ROWS; row 0 is the empty place
    places: np.ndarray  # rows of ``unique``
    starts: np.ndarray
    ends: np.ndarray  # at least one place each, an empty one if need be


class Numbers(dict):
    """Numbers from 1, in the order in which keys are first asked for."""

    def __missing__(self, key: str) -> int:
        k = self[key] = len(self) + 1
        return k


class Words:
    """Numbers different words as it meets them; 0 is the empty place."""

    def __init__(self, number: np.ndarray) -> None:
        self._number, self._seen = number, Numbers()

    def ids(self, text: str | None) -> list[int]:
        seen = self._seen
        return [seen[w] for w in WORD.findall((text or "").lower())]

    def rows(self) -> np.ndarray:
        """Compact numbers of the buckets of each word."""
        at = np.concatenate([np.full((1, ROWS), -1), buckets_of(list(self._seen))])
        return np.where(at < 0, 0, self._number[at])


def joined(texts: list[np.ndarray] | list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of word numbers one after the other, ``PAD`` empty places after each, and where each starts and ends."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + PAD)])
    places = np.zeros(starts[-1], np.int32)
    for t, a in zip(texts, starts, strict=False):
        places[a : a + len(t)] = t
    return places, starts[:-1], starts[:-1] + np.maximum(lengths, 1)


def batch(texts: list[str | None], number: np.ndarray) -> Batch:
    known = Words(number)
    places, starts, ends = joined([known.ids(t) for t in texts])
    return Batch(known.rows(), places, starts, ends)


@dataclass
class Model:
    number: np.ndarray  # bucket to compact number, 0 where it has no embedding
    embeddings: np.ndarray
    filters: list[np.ndarray]  # by width: width x DIMENSIONS x FILTERS
    weights: np.ndarray
    bias: float
    languages: list[str] = field(default_factory=list)
    language_table: np.ndarray | None = None  # compact numbers x languages
    shifts: np.ndarray | None = None  # by language, the last for none
    learned: bool = False

    def maxima(self, b: Batch, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's largest response per text; with ``places``, also where it is."""
        n = len(b.places) - max(WIDTHS) + 1
        cuts = np.stack([b.starts, b.ends], axis=1).ravel()
        words = self.embeddings[b.unique].sum(axis=1)
        out, at = [], []
        for group in self.filters:
            r = None
            for k, kernel in enumerate(group):
                part = (words @ kernel.astype(np.float32)).take(b.places[k : n + k], axis=0)
                r = part if r is None else np.add(r, part, out=r)
            top = np.maximum.reduceat(r, cuts, axis=0)[::2]
            out.append(top)
            if places:
                at.append(np.array([r[s:e].argmax(axis=0) + s for s, e in zip(b.starts, b.ends, strict=True)]))
        return np.concatenate(out, axis=1), at

    def guessed(self, b: Batch) -> np.ndarray:
        """The language's index of each text; the number of languages where no word tells."""
        if self.language_table is None or not self.languages:
            return np.zeros(len(b.starts), np.int64)
        by_word = self.language_table[b.unique].sum(axis=1)
        total = np.add.reduceat(by_word.take(b.places, axis=0), b.starts, axis=0)
        return np.where(total.any(axis=1), total.argmax(axis=1), len(self.languages))

    def logits(self, b: Batch) -> np.ndarray:
        top, _ = self.maxima(b)
        return np.maximum(top, 0).astype(np.float64) @ self.weights + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.learned:
            return np.zeros(len(texts))
        b = batch(texts, self.number)
        z = self.logits(b) - self.shifts[self.guessed(b)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def untrained(kept: np.ndarray, seed: int) -> Model:
    """A model with an embedding for each of the buckets ``kept``, before its first step."""
    rng = np.random.default_rng(seed)
    number = np.zeros(BUCKETS, np.int32)
    number[kept] = np.arange(1, len(kept) + 1)
    # Next to nothing at first: a word that training has hardly moved has hardly a response.
    embeddings = rng.normal(0, 0.01, (len(kept) + 1, DIMENSIONS)).astype(np.float32)
    embeddings[0] = 0
    filters = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)) for w in WIDTHS]
    # Half of the filters speak for toxicity from the start, half against.
    return Model(number, embeddings, filters, rng.choice([-0.5, 1.0], FILTERS * len(WIDTHS)), 0.0)


def train(rows: list[tuple[str, int, str | None]], counts: dict[int, int] | None = None, seed: int = 11) -> Model:
    """From (text, label, language) rows in memory; ``counts`` are the labels' counts in the corpus."""
    rows = sorted(rows, key=lambda r: (r[1], r[2] or "", r[0]))
    rows = [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]
    counts = counts or {k: sum(r[1] == k for r in rows) for k in (0, 1)}
    held, used = rows[::CALIBRATION], [r for i, r in enumerate(rows) if i % CALIBRATION]
    languages = sorted({r[2] for r in used if r[2]})
    kept, seen = _gathered(list(_word_counts(((r[0], r[2]) for r in used), languages)), len(languages))
    model = untrained(kept, seed)
    if len({r[1] for r in used}) < 2:
        return model
    model.learned = True
    known = Words(model.number)
    by_label: list[list[np.ndarray]] = [[], []]
    for text, label, _ in used:
        by_label[label].append(np.array(known.ids(text), dtype=np.int32))
    learn(model, known.rows(), by_label, 0, 1, [seed, 1])
    _languages(model, languages, seen)
    if held:
        b = batch([r[0] for r in held], model.number)
        y = np.array([r[1] for r in held])
        drawn = {k: max(1, sum(r[1] == k for r in rows)) for k in (0, 1)}
        weight = np.where(y == 1, counts.get(1, 1) / drawn[1], counts.get(0, 1) / drawn[0])
        _calibrate(model, model.logits(b), model.guessed(b), y, np.ones(len(y)), weight)
    return model


def learn(model: Model, table: np.ndarray, by_label: list[list[np.ndarray]], part: int, parts: int, seed: list[int]) -> None:
    """Steps of one of ``parts`` parts of the training, in place.

    ``table`` has the compact numbers of each word's buckets, ``by_label`` each row's words. A batch has as many rows of
    either label, each label's in an order of its own that goes on from part to part; all parts together go over every row.
    """
    rng = np.random.default_rng(seed[:-1])
    orders = [rng.permutation(len(x)) for x in by_label]
    rng = np.random.default_rng([*seed, part])
    half = BATCH // 2
    steps = max(STEPS, -(-max(map(len, by_label)) // half))
    bias = np.array([model.bias])
    params = [*model.filters, model.weights, bias]
    first, second = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params]
    moved = np.zeros(1)
    y = np.repeat([k for k in (0, 1) if by_label[k]], half)
    begin = steps * part // parts
    for step in range(begin + 1, steps * (part + 1) // parts + 1):
        turn = (step - 1) * half + np.arange(half)
        texts = [by_label[k][i] for k in (0, 1) if by_label[k] for i in orders[k][turn % len(orders[k])]]
        places, starts, ends = joined(texts)
        used, places = np.unique(places, return_inverse=True)
        b = Batch(table[used], places, starts, ends)
        b.unique[rng.random(b.unique.shape) < DROPOUT] = 0
        top, at = model.maxima(b, places=True)
        f = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(f @ model.weights + model.bias, -30, 30)))
        g = (p - y) / len(y)
        back = np.outer(g, model.weights) * (top > 0)
        at_rows, pulls, d_filters = [], [], []
        for j, group in enumerate(model.filters):
            pulled, d = back[:, j * FILTERS : (j + 1) * FILTERS], np.zeros(group.shape)
            for k in range(len(group)):
                ids = b.unique[b.places[at[j] + k]]  # texts x filters x ROWS
                e = model.embeddings[ids].sum(axis=2)
                d[k] = np.einsum("bf,bfd->df", pulled, e)
                pull = pulled[:, :, None] * group[k].T[None]
                at_rows.append(ids.reshape(-1, ROWS))
                pulls.append(pull.reshape(-1, DIMENSIONS))
            d_filters.append(d)
        rate = min(1.0, 2 * (1 - step / (steps + 1)))
        _step(model.embeddings, moved, np.concatenate(at_rows), np.concatenate(pulls), rate * PACE)
        grads = [*d_filters, f.T @ g + DECAY * model.weights, np.array([g.sum()])]
        t = step - begin
        for i, (param, grad) in enumerate(zip(params, grads, strict=True)):
            first[i] += 0.1 * (grad - first[i])
            second[i] += 0.01 * (grad * grad - second[i])
            param -= rate * 0.02 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-5)
        model.bias = float(bias[0])


def _step(embeddings: np.ndarray, moved: np.ndarray, at: np.ndarray, pulls: np.ndarray, pace: float) -> None:
    """A step against the gradient for the rows that a batch used, by one scale for all rows: a row that few texts use moves little."""
    rows, back = np.unique(at, return_inverse=True)
    d = np.zeros((len(rows), DIMENSIONS))
    for side in range(ROWS):
        np.add.at(d, back.reshape(at.shape)[:, side], pulls)
    moved[0] = moved[0] * 0.95 + 0.05 * float((d * d).sum(axis=1).max())
    d *= pace / (math.sqrt(moved[0]) + 1e-8)
    d[rows == 0] = 0
    embeddings[rows] -= d.astype(np.float32)


def _word_counts(rows: Iterator[tuple[str, str | None]], languages: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, how often each occurs in each language and, last, where there is none) of (text, language) rows, whenever ``DIFFERENT_WORDS`` or ``PLACES`` are met."""
    place = {lang: k for k, lang in enumerate(languages)}
    seen, ids, n_ids = Numbers(), [[] for _ in range(len(languages) + 1)], 0

    def found() -> tuple[np.ndarray, np.ndarray]:
        at = buckets_of(list(seen))
        kept, row = np.unique(at[at >= 0], return_inverse=True)
        counts = np.zeros((len(kept), len(ids)), np.int64)
        for k, own in enumerate(ids):
            if own:
                n = np.bincount(np.concatenate(own), minlength=len(seen) + 1)[1:]
                counts[:, k] = np.bincount(row, np.repeat(n, ROWS)[at.ravel() >= 0], len(kept))
        return kept, counts

    for text, lang in rows:
        own = np.array([seen[w] for w in WORD.findall(text.lower())], np.int32)
        ids[place.get(lang, len(languages))].append(own)
        n_ids += len(own)
        if len(seen) > DIFFERENT_WORDS or n_ids > PLACES:
            yield found()
            seen, ids, n_ids = Numbers(), [[] for _ in ids], 0
    yield found()


def _gathered(parts: list[tuple[np.ndarray, np.ndarray]], n_languages: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all parts, and their counts by language summed up."""
    kept, row = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    seen = np.zeros((len(kept), n_languages + 1), np.int64)
    np.add.at(seen, row, np.concatenate([n for _, n in parts]))
    return kept, seen


def _languages(model: Model, languages: list[str], seen: np.ndarray) -> None:
    """``seen``: of each embedding how often it occurs in each language, and (not used) where there is none."""
    model.languages = languages
    counted = np.zeros((len(model.embeddings), max(1, len(languages))))
    counted[1:, : len(languages)] = seen[:, : len(languages)]
    p = (counted + 0.5) / (counted + 0.5).sum(axis=0)
    table = np.log(p / p.mean(axis=1, keepdims=True)).astype(np.float32)
    table[0] = 0
    model.language_table = table


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of least weighted error; of equal ones the middle of the widest gap."""
    z, row = np.unique(z, return_inverse=True)
    missed = np.concatenate([[0], np.cumsum(np.bincount(row, weight * (y == 1), len(z)))])
    alarms = (weight * (y == 0)).sum() - np.concatenate([[0], np.cumsum(np.bincount(row, weight * (y == 0), len(z)))])
    error = missed + alarms
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    gaps = np.diff(edges)
    best = max(np.flatnonzero(error <= error.min() + 1e-12), key=lambda i: gaps[i])
    return float((edges[best] + edges[best + 1]) / 2)


def _calibrate(model: Model, z: np.ndarray, lang: np.ndarray, y: np.ndarray, n: np.ndarray, weight: np.ndarray) -> None:
    """Thresholds from logits, guessed languages and labels, each of ``n`` rows that together weigh ``weight``."""
    model.shifts = np.zeros(len(model.languages) + 1)
    if len(set(y.tolist())) < 2:
        return
    model.shifts[:] = _threshold(z, y, weight)
    for k in range(len(model.languages)):
        own = lang == k
        rarer = min(n[own & (y == 0)].sum(), n[own & (y == 1)].sum())
        if rarer:
            share = rarer / (rarer + SHRINK)
            model.shifts[k] += share * (_threshold(z[own], y[own], weight[own]) - model.shifts[k])


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, marks) of the ids that may be learned from, those whose crc32 is not divisible by 5; marks are 1 for label 0, 2 for label 1, 3 for both."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (common.id_crc() % 5 != 0))
    return common.materialize(known.groupBy("doc_id").agg(F.bit_or(F.col("label") + 1).alias("marks")), "toxic-labels")


def _each_label() -> Column:
    """A row for each label of ``marks``."""
    return F.explode(F.expr("filter(array(0, 1), label -> (marks & (label + 1)) > 0)")).alias("label")


def _drawn(df: DataFrame) -> DataFrame:
    """With ``draw``, a hash of the id, and ``calibrates``."""
    hashed = lambda use: F.xxhash64(F.col("doc_id").cast("string"), F.lit(use))
    return df.withColumns({"calibrates": F.pmod(hashed("calibrates"), F.lit(CALIBRATION)) == 0, "draw": hashed("block")})


def _dealt(docs: DataFrame, known: DataFrame, n_known: int, block: Column, parts: int) -> DataFrame:
    """(block, label, text, lang, calibrates, draw) of the rows of ``known``, once for each id and label, in the order of block and draw.

    Texts are shuffled once, by block. An id lies in one block: of its rows the smallest text is taken there. If there are too many labels
    for a broadcast, they are dealt with the texts, as rows before those of their id.
    """
    met = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null")
    order = ["block", "draw", "doc_id"]
    if n_known <= LABELS_ABROAD:
        met = _drawn(met.join(F.broadcast(known), "doc_id")).withColumn("block", block).repartition(parts, "block").sortWithinPartitions(*order, "text", "lang")
        met = met.withColumn("nth", F.row_number().over(W.partitionBy(*order).orderBy("text", "lang"))).where("nth = 1")
    else:
        known = known.select(F.col("doc_id").cast(met.schema["doc_id"].dataType), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.col("marks").alias("before"))
        met = met.where(F.col("doc_id").isNotNull() & (common.id_crc() % 5 != 0)).withColumn("before", F.lit(None).cast("int"))
        met = _drawn(met.unionByName(known)).withColumn("block", block).repartition(parts, "block").sortWithinPartitions(*order, "text", "lang")
        met = met.withColumn("marks", F.lag("before").over(W.partitionBy(*order).orderBy("text", "lang"))).where("marks is not null")
    return met.select("block", _each_label(), "text", "lang", "calibrates", "draw")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, text, lang, calibrates, draw) of every labelled document that may be learned from, once for each of its labels; ``draw`` is a hash of the id.

    Only rows whose crc32 of the id is not divisible by 5 are learned from. Of an id's rows the smallest text counts.
    """
    known = _known(labels)
    return _dealt(docs, known, known.count(), F.pmod("draw", F.lit(64)), 64).drop("block")


def fit(docs: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """A model of every labelled row: its words, its steps and its thresholds come from all of them (see above)."""
    spark = docs.sparkSession
    known = _known(labels)
    n_known = known.count()
    lengths = docs.select("doc_id", F.octet_length(F.col("text").cast("string")).alias("b")).where("b is not null")
    lengths = _drawn(lengths.join(common.small(known, n_known, LABELS_ABROAD), "doc_id").groupBy("doc_id", "marks").agg(F.max("b").alias("b")))
    sizes = {r["label"]: (r["n"], r["b"]) for r in lengths.where("not calibrates").select(_each_label(), "b").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).collect()}  # two rows
    if len(sizes) < 2:
        remove(spark, known.table_path)
        return untrained(np.zeros(0, np.int64), seed)
    n_blocks = max(-(-sum(n for n, _ in sizes.values()) // block_rows), -(-sum(b for _, b in sizes.values()) // BLOCK_BYTES), 1)
    # Calibrating rows go to smaller blocks of their own, behind the others.
    block = F.when(F.col("calibrates"), n_blocks + F.pmod("draw", F.lit(3 * n_blocks))).otherwise(F.pmod("draw", F.lit(n_blocks)))
    rows = common.materialize(_dealt(docs, known, n_known, block, 4 * n_blocks).select("block", "label", "text", "lang"), "toxic-blocks", compression="zstd")
    blocks = rows.where(F.col("block") < n_blocks)
    languages = sorted(r[0] for r in blocks.where("lang <> ''").select("lang").distinct().collect())
    kept, seen = _counted(blocks, languages)
    model = untrained(kept, seed)
    model.learned = True
    for k in range(rounds if n_blocks > 1 else 1):
        _averaged(spark, blocks, model, k, rounds if n_blocks > 1 else 1, seed)
    _languages(model, languages, seen)
    _calibrate(model, *_logit_counts(rows.where(F.col("block") >= n_blocks), model))
    for done in (rows, known):
        remove(spark, done.table_path)
    return model


def _counted(blocks: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all texts, and how often each occurs in each language and where there is none."""
    names = [f"n{k}" for k in range(len(languages) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, seen in _word_counts((r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), languages):
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), *map(pa.array, seen.T.copy())], ["bucket", *names])

    counts = blocks.select("text", "lang").mapInArrow(run, "bucket int, " + ", ".join(f"{n} bigint" for n in names))
    found = counts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # at most BUCKETS rows
    order = np.argsort(found["bucket"].to_numpy())
    return found["bucket"].to_numpy()[order].astype(np.int64), np.stack([found[n].to_numpy() for n in names], axis=1)[order]


def _dense(model: Model) -> np.ndarray:
    """Filters, weights and bias as rows of ``DIMENSIONS`` numbers."""
    flat = np.concatenate([*(x.ravel() for x in model.filters), model.weights, [model.bias]])
    return np.append(flat, np.zeros(-len(flat) % DIMENSIONS)).reshape(-1, DIMENSIONS)


def _set_dense(model: Model, rows: np.ndarray) -> None:
    flat, at = rows.ravel(), 0
    for x in [*model.filters, model.weights]:
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    model.bias = float(flat[at])


def _averaged(spark: SparkSession, blocks: DataFrame, model: Model, part: int, parts: int, seed: int) -> None:
    """One round, in place: every block's steps from the model, and the means of what the blocks have changed."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS bounds it
    names = [f"d{k}" for k in range(DIMENSIONS)]

    def changes(block: int, known: Words, by_label: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        own = Model(start.number, start.embeddings.copy(), [x.copy() for x in start.filters], start.weights.copy(), start.bias)
        learn(own, known.rows(), by_label, part, parts, [seed, int(block)])
        # Rows before 0 are the filters, weights and bias.
        dense = _dense(own) - _dense(start)
        at = np.flatnonzero((own.embeddings != start.embeddings).any(axis=1))
        for k in range(0, len(at) + 1, 1 << 14):
            some = at[k : k + (1 << 14)]
            row, d = some, own.embeddings[some].astype(np.float64) - start.embeddings[some]
            if not k:
                row, d = np.concatenate([np.arange(-len(dense), 0), row]), np.concatenate([dense, d])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), *map(pa.array, np.rint(d * FIXED).astype(np.int64).T.copy())], ["row", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, by_label = None, Words(shared.value.number), [[], []]
        for b in batches:
            for own, label, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if own != block:
                    if block is not None:
                        yield from changes(block, known, by_label)
                    block, known, by_label = own, Words(shared.value.number), [[], []]
                by_label[label].append(np.array(known.ids(text), dtype=np.int32))
        if block is not None:
            yield from changes(block, known, by_label)

    moved = blocks.select("block", "label", "text").mapInArrow(run, "row int, " + ", ".join(f"{n} bigint" for n in names))
    # Sums of whole numbers: the same in any order.
    means = moved.groupBy("row").agg(*[(F.sum(n) / F.count(F.lit(1)) / F.lit(float(FIXED))).cast("float").alias(n) for n in names]).toArrow()  # at most BUCKETS rows and the filters
    row, d = means["row"].to_numpy(), np.stack([means[n].to_numpy() for n in names], axis=1)
    dense = _dense(model)
    dense[row[row < 0] + len(dense)] += d[row < 0]
    _set_dense(model, dense)
    model.embeddings[row[row >= 0]] += d[row >= 0]
    shared.destroy()  # its file at the driver too, which unpersist() leaves


def _logit_counts(rows: DataFrame, model: Model) -> tuple[np.ndarray, ...]:
    """Different (logit in steps of 1 / GRID, guessed language, label) of all rows, and how many rows have them, twice."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for a in range(0, r.num_rows, 256):
                b = batch(r.column(0).slice(a, 256).to_pylist(), shared.value.number)
                cell = np.rint(np.clip(shared.value.logits(b), -30, 30) * GRID)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(shared.value.guessed(b).astype(np.int32)), r.column(1).slice(a, 256)], ["z", "lang", "y"])

    found = rows.select("text", "label").mapInArrow(run, "z int, lang int, y int").groupBy("z", "lang", "y").agg(F.count(F.lit(1)).alias("n")).toArrow()  # GRID and the languages bound it
    shared.destroy()
    n = found["n"].to_numpy().astype(np.float64)
    return found["z"].to_numpy() / GRID, found["lang"].to_numpy(), found["y"].to_numpy(), n, n


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[list[tuple[str, int, str | None]], dict[int, int]]:
    """((text, label, lang) of up to ``per_label`` documents of either label, the labels' counts in the corpus), for :func:`train`.

    Only rows whose crc32 of the id is not divisible by 5 are learned from.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (common.id_crc() % 5 != 0))
    counts = {r[0]: r[1] for r in known.groupBy("label").agg(F.count(F.lit(1))).collect()}  # two rows
    return common.labelled_sample(docs.select("doc_id", "text", "lang"), known, per_label), counts


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                s = shared.value.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held_out = common.id_crc() % 5 == 0
    return docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return score(docs.select("doc_id", "text"), fit(docs, labels))
