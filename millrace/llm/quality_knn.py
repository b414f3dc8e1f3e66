"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are pairs of neighbouring byte classes (64 classes, 4096 pairs), plus terms for how often words, lines and
neighbouring words repeat. Weighted term vectors are projected to ``DIMENSIONS`` latent dimensions, the
leading right singular vectors of the sample's matrix. The labelled vectors are broadcast; every document's cosines
with all of them are computed in blocks, and its ``NEIGHBOURS`` nearest vote with their labels, weighted by similarity.

The labelled vectors are a bounded sample: up to ``SAMPLE_PER_LABEL`` documents of either label, chosen by a hash of
the id over all labelled rows (see :func:`common.labelled_sample`). So the broadcast is about 1 MB whatever the corpus.

Defined results: null and empty texts have the zero vector, no neighbour, and the sample's share of label 1 as their
score; so has every text where nothing is labelled (then 0.5). A document with several labels counts once for each;
one whose id or label is repeated counts once. Labels whose document is missing, or null, are not used. Repeated rows
get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLASSES = 64
PAIRS = CLASSES * CLASSES
#: Repetition of words, of lines and of neighbouring words, each in STEPS steps.
STEPS = 8
TERMS = PAIRS + 3 * STEPS
REPEAT_WEIGHT = 0.5
DIMENSIONS = 48
NEIGHBOURS = 15
SAMPLE_PER_LABEL = 1500
THRESHOLD = 0.3
BLOCK = 256


def _classes() -> np.ndarray:
    """Byte to class: letters without case and a class for upper case, one for digits, one for each mark, 12 for the rest."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            out[b] = 1 + b - 97
        elif "A" <= c <= "Z":
            out[b] = 27
        elif "0" <= c <= "9":
            out[b] = 28
        elif b >= 128:
            out[b] = 52 + b % 12
        elif b > 32:
            out[b] = 29 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".find(c) % 22
        else:
            out[b] = 51 if c == "\n" else 0
    return out


CLASS = _classes()


def _repetition(raw: bytes) -> tuple[float, float, float]:
    """Shares of words, of lines and of neighbouring words that repeat."""
    w = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(1, len(w)), max(1, len(lines))
    # Of a long text many words repeat anyway: the expected number of different words grows like n ** 0.8.
    different = len(set(w)) / n**0.8 if w else 1.0
    return max(0.0, 1 - different), 1 - len(set(lines)) / m if lines else 0.0, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n


def term_vectors(texts: list[str | None]) -> np.ndarray:
    """Rows of unit length (or zero): damped counts of pairs, and the repetition terms with a fixed weight."""
    raws = [(t or "").encode("utf-8", "replace") for t in texts]
    out = np.zeros((len(raws), TERMS), np.float32)
    for row, raw in zip(out, raws, strict=True):
        if len(raw) > 1:
            c = CLASS[np.frombuffer(raw, np.uint8)]
            counts = np.bincount(c[:-1] * CLASSES + c[1:], minlength=PAIRS)
            row[:PAIRS] = np.sqrt(counts)
            row[:PAIRS] /= np.linalg.norm(row[:PAIRS])
            for k, share in enumerate(_repetition(raw)):
                # A share fills its steps up from the left, so near shares are near vectors.
                level = np.clip(share * STEPS - np.arange(STEPS), 0, 1)
                row[PAIRS + k * STEPS : PAIRS + (k + 1) * STEPS] = REPEAT_WEIGHT * level
            row /= np.linalg.norm(row)
    return out


@dataclass
class Model:
    mean: np.ndarray
    projection: np.ndarray  # TERMS x DIMENSIONS
    vectors: np.ndarray  # labelled, of unit length
    labels: np.ndarray
    prior: float

    def latent(self, terms: np.ndarray) -> np.ndarray:
        v = (terms - self.mean) @ self.projection
        v[~terms.any(axis=1)] = 0
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for a in range(0, len(texts), BLOCK):
            terms = term_vectors(texts[a : a + BLOCK])
            empty = ~terms.any(axis=1)
            if not len(self.labels):
                out[a : a + BLOCK] = self.prior
                continue
            cosine = self.latent(terms) @ self.vectors.T
            k = min(NEIGHBOURS, len(self.labels))
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 4
            total = weight.sum(axis=1)
            score = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[a : a + BLOCK] = np.where(empty | (total <= 0), self.prior, score)
        return np.clip(out, 0, 1)


def train(rows: list[tuple[str, int]]) -> Model:
    """From (text, label) rows; their order doesn't matter."""
    rows = sorted(rows, key=lambda x: (x[1], x[0]))
    labels = np.array([x[1] for x in rows], dtype=np.float64)
    terms = term_vectors([x[0] for x in rows])
    mean = terms.mean(axis=0) if len(rows) else np.zeros(TERMS, np.float32)
    centred = terms - mean
    # Leading right singular vectors, from the smaller of the two Gram matrices.
    if len(rows) > 1:
        if len(rows) < TERMS:
            values, left = np.linalg.eigh((centred @ centred.T).astype(np.float64))
            keep = [i for i in np.argsort(-values)[:DIMENSIONS] if values[i] > 1e-9]
            projection = centred.T @ (left[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        else:
            values, right = np.linalg.eigh((centred.T @ centred).astype(np.float64))
            projection = right[:, np.argsort(-values)[:DIMENSIONS]].astype(np.float32)
    else:
        projection = np.zeros((TERMS, 1), np.float32)
    model = Model(mean.astype(np.float32), projection.astype(np.float32), np.zeros((0, 1), np.float32), labels, float(labels.mean()) if len(rows) else 0.5)
    model.vectors = model.latent(terms) if len(rows) else np.zeros((0, projection.shape[1]), np.float32)
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> list[tuple[str, int]]:
    """(text, label) of up to ``per_label`` documents of either label, chosen by a hash of the id over all rows.

    Only rows whose crc32 of the id is not divisible by 5 are learned from.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (common.id_crc() % 5 != 0))
    return [(text, y) for text, y, _ in common.labelled_sample(docs.select("doc_id", "text", F.lit(None).alias("lang")), known, per_label)]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 4 * BLOCK):
                part = b.slice(a, 4 * BLOCK)
                s = shared.value.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held_out = common.id_crc() % 5 == 0
    return docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(sample(docs, labels, "quality", SAMPLE_PER_LABEL))
    return score(docs.select("doc_id", "text"), model)
