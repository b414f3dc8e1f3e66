"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of a fixed-length window, each filter's largest response in the window
is kept, and a softmax over these maxima gives the languages. A filter of width w is w tables of 256 rows (one per
byte), so a response is a sum of w looked-up rows and a ReLU. The network is trained in numpy, with Adam, on windows of a bounded
sample of labelled documents; the whole text of every document is then cut into windows, and a document's answer is
the mean of its windows' log-probabilities.

``SAMPLE_PER_LANGUAGE`` bounds the sample: up to that many documents of each language, whole, chosen by a hash of their
ids over all rows; ``common.SAMPLE_DOCUMENTS`` and ``common.SAMPLE_BYTES`` bound it over all languages, however many there
are. Language counts and the choice cover every row.

Defined results: a null text, or one without any letter, is ``und`` with score 0; so is every text where there is
nothing to learn from (empty tables, no language). Rows with a null language are never learned from; an id that many
rows repeat is learned from once in each language. Ties go to the first language by code point. Repeated rows get a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_PER_LANGUAGE = 600
STEPS = 400
BATCH = 128
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]
    tables: list[list[np.ndarray]]  # by width, then by offset: 256 x FILTERS
    weights: np.ndarray  # pooled features x languages
    bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's largest response per window (rectified), and where it was."""
        n = len(windows)
        out, at = [], []
        for tables in self.tables:
            reach = WINDOW - len(tables) + 1
            r = tables[0][windows[:, :reach]]
            for k, t in enumerate(tables[1:], 1):
                r += t[windows[:, k : k + reach]]
            where = r.argmax(axis=1)
            out.append(np.take_along_axis(r, where[:, None, :], axis=1)[:, 0, :])
            at.append(where)
        return np.maximum(np.concatenate(out, axis=1), 0) if n else np.zeros((0, FILTERS * len(WIDTHS)), np.float32), at

    def features(self, windows: np.ndarray) -> np.ndarray:
        """As pooled(), for many windows: without the places, in blocks that stay in the cache."""
        out = np.empty((len(windows), FILTERS * len(WIDTHS)), np.float32)
        for a in range(0, len(windows), 64):
            part = windows[a : a + 64]
            for j, tables in enumerate(self.tables):
                reach = WINDOW - len(tables) + 1
                r = tables[0].take(part[:, :reach], axis=0)
                for k, t in enumerate(tables[1:], 1):
                    r += t.take(part[:, k : k + reach], axis=0)
                r.max(axis=1, out=out[a : a + 64, j * FILTERS : (j + 1) * FILTERS])
        return np.maximum(out, 0, out=out)

    def log_probabilities(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each padded with zeros, and how many each text has (one at least)."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], dtype=np.int64)
    flat = b"".join(t.ljust(int(c) * WINDOW, b"\0") for t, c in zip(texts, counts, strict=True))
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), counts


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (text, language) rows; the same rows in any order give the same model."""
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    rows = sorted(rows, key=lambda x: (x[1], x[0]))
    x, counts = windows_of([text.encode("utf-8", "replace") for text, _ in rows])
    starts = np.cumsum(counts) - counts
    place = {lang: k for k, lang in enumerate(languages)}
    y = np.array([place[lang] for _, lang in rows], dtype=np.int64)
    tables = [[rng.normal(0, 0.1, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
    for t in (t for group in tables for t in group):
        t[0] = 0  # padding answers to nothing
    model = Model(languages, tables, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), max(1, len(languages)))).astype(np.float32), np.zeros(max(1, len(languages)), np.float32))
    if len(languages) < 2:
        return model
    params = [t for group in tables for t in group] + [model.weights, model.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    # Languages are drawn evenly, so that a rare one counts as much as a frequent one; so are a language's documents,
    # and a document's windows, wherever in the text they are. Rows are ordered by language.
    sizes = np.bincount(y, minlength=len(languages))
    edges = np.cumsum(sizes) - sizes
    for step in range(1, STEPS + 1):
        k = rng.integers(0, len(languages), BATCH)
        document = edges[k] + (rng.random(BATCH) * sizes[k]).astype(np.int64)
        pick = starts[document] + (rng.random(BATCH) * counts[document]).astype(np.int64)
        f, at = model.pooled(x[pick])
        p = np.exp(model.log_probabilities(f))
        p[np.arange(BATCH), k] -= 1
        p /= BATCH
        grads = []
        back = (p @ model.weights.T) * (f > 0)
        for j, group in enumerate(tables):
            part, where = back[:, j * FILTERS : (j + 1) * FILTERS], at[j]
            for offset in range(len(group)):
                g = np.zeros((256, FILTERS), np.float32)
                np.add.at(g, (np.take_along_axis(x[pick], where + offset, axis=1), np.arange(FILTERS)[None, :]), part)
                g[0] = 0
                grads.append(g)
        grads += [f.T @ p, p.sum(axis=0)]
        rate = 0.01 * min(1, 2 * (1 - step / (STEPS + 1)))
        for i, (param, g) in enumerate(zip(params, grads, strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            param -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model.languages else []
    for a in range(0, len(known), 256):
        part = known[a : a + 256]
        windows, counts = windows_of([texts[i].encode("utf-8", "replace") for i in part])
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(model.log_probabilities(model.features(windows)), starts, axis=0) / counts[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for i, row in zip(part, p, strict=True):
            k = int(row.argmax())
            langs[i], scores[i] = model.languages[k], float(row[k])
    return langs, scores


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text, lang) of up to ``per_language`` documents of each language, chosen by a hash of their ids over all rows."""
    rows = docs.select("doc_id", "text", "lang", F.col("lang").cast("string").alias("label")).where(F.col("text").isNotNull())
    return [(text, label) for text, label, _ in common.labelled_sample(rows, rows, per_language)]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 150 kB, and 200 bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                langs, scores = predict(shared.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held_out = common.id_crc() % 4 == 2
    return docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(sample(docs.where(common.id_crc() % 4 != 2)))
    return identify(docs.select("doc_id", "text"), model)
