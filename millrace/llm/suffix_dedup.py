"""Repeated byte strings across a corpus: every byte that a string of ``length`` bytes covers which also starts earlier is removed.

Prefix doubling ranks suffixes by longer and longer prefixes: pairs of a position's rank and the rank of what follows are
sorted, equal pairs share the next rank, and positions that have become unique drop out. Here it runs over sampled suffixes,
since a row for each byte and round would be dozens of times the corpus:

1. In a task, ranks of prefixes double from one byte to 32 and 64 as 64-bit names. Each window of ``length`` bytes has
   one anchor, its smallest name of 32 bytes (the leftmost of equals); windows alike have the same anchor at the same
   place, so only anchors whose names occur twice can have repeated windows. About one byte in 35 is an anchor.
2. Spark sorts the anchors by (name, name of the hull), the hull being all bytes of the windows of an anchor. Names that
   occur once drop out. Anchors with one hull repeat in all their windows, and all but the first go.
3. Anchors of one name with several hulls go through rounds: their windows are cut into cells, the bytes that all windows
   of a cell share (its core, longer in each round, at last the window itself) and its hull are ranked over all documents,
   and again what is unique drops out, what has one hull is settled, and what has several is cut further.

Cores and hulls are named by 128 bits in all. No group is gathered: each step counts by key with partial sums and joins back.

Defined results: documents are ordered by doc_id, null last, rows of one id by a hash of their texts; rows alike in id and
text are one document, each with its result; a null text has no bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 100
#: Bytes that a task looks at together; longer texts are cut with an overlap.
BUFFER = 2 << 20
#: Bits for a window's distance from its anchor.
BITS = 7
MASK = (1 << BITS) - 1


def _sizes(length: int) -> tuple[int, int]:
    """Bytes of an anchor's name, and how many places in a window it may begin at."""
    name = -(-length * 8 // 25)
    if not 8 <= length or length - name > MASK:
        raise ValueError(f"length {length} is not between 8 and 186")
    return name, length - name + 1


def _keyed(docs: DataFrame) -> DataFrame:
    """The two keys of a document, in its order, and its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("k1"), F.xxhash64(text).alias("k2"), F.col("doc_id"), text.cast("binary").alias("bytes"))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """k1, k2 and removed: the ranges (start, end) of bytes to remove, which may overlap; documents without are left out."""
    _, places = _sizes(length)
    texts = _keyed(docs)
    schema = "name bigint, hull bigint, k1 bigint, k2 bigint, at bigint"
    anchors = common.materialize(texts.select("k1", "k2", "bytes").mapInArrow(lambda b: _anchors(b, length), schema), "suffix-anchors")
    counted = anchors.groupBy("name").agg(F.count("*").alias("n"), (F.min("hull") < F.max("hull")).alias("several")).where("n > 1")
    # Written first, so that both sides of the join are shuffled for it alone and a hot name can be split.
    counted = common.materialize(counted.select("name", "several"), "suffix-names")
    again = anchors.join(counted.hint("shuffle_hash"), "name")
    again = common.materialize(again, "suffix-again", instead_of=anchors)
    where = F.struct("k1", "k2", "at")
    leaders = again.groupBy("name", "hull").agg(F.min(where).alias("first"), F.count("*").alias("n"), F.first("several").alias("several"))
    leaders = common.materialize(leaders, "suffix-leaders")
    later = again.join(leaders.where("n > 1").select("name", "hull", "first"), ["name", "hull"]).where(where > F.col("first"))
    near, far = F.col("at").bitwiseAND(F.lit(MASK << BITS)) / (1 << BITS), F.col("at").bitwiseAND(F.lit(MASK))
    place = {"m": F.shiftright("at", 2 * BITS), "near": near.cast("int"), "far": far.cast("int")}
    removed = [later.select("k1", "k2", *[c.alias(n) for n, c in place.items()])]

    # What is left has several hulls: its bytes are cut from the texts once.
    wanted = leaders.where("several").select("first.*").groupBy("k1", "k2").agg(F.collect_list(F.struct(*[c.alias(n) for n, c in place.items()])).alias("cells"))
    cut = F.transform("cells", lambda c: F.struct(c["m"].alias("m"), c["near"].alias("near"), c["far"].alias("far"), F.substring(F.col("bytes"), (c["m"] - c["far"] + 1).cast("int"), c["far"] - c["near"] + length).alias("hull")))
    cells = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", F.explode(cut).alias("c")).select("k1", "k2", "c.*")
    cells = cells.dropDuplicates(["k1", "k2", "m", "near"])
    width = places
    while width > 1:
        width = -(-width // 3)
        cells = common.materialize(_cut(cells, width, length), "suffix-cells")
        core = cells.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min("h").alias("h1"), F.max("h").alias("h2"), F.min(F.struct("k1", "k2", "m")).alias("first")).where("n > 1")
        core = common.materialize(core.select("c1", "c2", "first", (F.col("h1") < F.col("h2")).alias("several")), "suffix-cores")
        met = cells.join(core, ["c1", "c2"])
        met = common.materialize(met.where(F.col("several") | (F.struct("k1", "k2", "m") > F.col("first"))).drop("c1", "c2", "h", "first"), "suffix-met", instead_of=cells)
        removed.append(met.where(~F.col("several")).select("k1", "k2", "m", "near", "far"))
        cells = met.where("several").drop("several")
    out = removed[0]
    for more in removed[1:]:
        out = out.unionByName(more)
    start, end = F.col("m") - F.col("far"), F.col("m") - F.col("near") + length
    return out.groupBy("k1", "k2").agg(F.collect_list(F.struct(start.alias("start"), end.alias("end"))).alias("removed"))


def _cut(cells: DataFrame, width: int, length: int) -> DataFrame:
    """Cells of ``width`` places, each with its hull, the names of its core (c1, c2) and of its hull (h).

    Places are counted back from the anchor; cells are aligned, so that the same windows meet in the same cell.
    """
    number = F.explode(F.sequence((F.col("near") / width).cast("int"), (F.col("far") / width).cast("int")))
    parts = cells.withColumn("cell", number)
    low = F.greatest(F.col("cell") * width, F.col("near"))
    high = F.least(F.col("cell") * width + width - 1, F.col("far"))
    parts = parts.select("k1", "k2", "m", low.alias("near"), high.alias("far"), "cell", F.substring(F.col("hull"), F.col("far") - high + 1, high - low + length).alias("hull"))
    core = F.substring(F.col("hull"), F.col("far") - F.col("cell") * width + 1, F.lit(length + 1 - width))
    name = lambda seed: F.xxhash64(F.lit(seed), core, "cell")
    return parts.select("k1", "k2", "m", "near", "far", "hull", name(1).alias("c1"), name(2).alias("c2"), F.xxhash64("hull", "near", "far").alias("h"))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of the joined strings from the names of their two parts."""
    out = a * np.uint64(0x9E3779B97F4A7C15)
    out ^= b + (b >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _longer(names: np.ndarray, size: int, wanted: int) -> np.ndarray:
    """Names of strings of ``wanted`` bytes from those of ``size`` bytes, by doubling."""
    while size < wanted:
        step = min(size, wanted - size)
        names = _mixed(names[:-step], names[step:])
        size += step
    return names


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The anchors of all windows of ``length`` bytes: name, name of the hull, document and place."""
    for batch in batches:
        k1, k2, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        pieces: list[tuple[int, int, bytes]] = []
        size = 0
        for i in range(len(texts)):
            text = memoryview(texts[i].as_buffer())
            for start in range(0, max(0, len(text) - length + 1), BUFFER):
                pieces.append((i, start, text[start : start + BUFFER + length - 1]))
                size += len(pieces[-1][2])
                if size >= BUFFER:
                    yield _of_pieces(pieces, k1, k2, length)
                    pieces, size = [], 0
        if pieces:
            yield _of_pieces(pieces, k1, k2, length)


def _of_pieces(pieces: list[tuple[int, int, memoryview]], k1: np.ndarray, k2: np.ndarray, length: int) -> pa.RecordBatch:
    size, places = _sizes(length)
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    ends = np.cumsum([len(p[2]) for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), np.diff(ends, prepend=0))
    single = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA0761D6478BD642F)
    names = _longer(_mixed(single, single)[data], 1, size)
    wide = _longer(names, size, 2 * size)
    # The smallest name in each window, by doubling; its place rides in the low bits, so that the leftmost of equals wins.
    places_of = np.uint64((1 << 23) - 1)
    low = (names & ~places_of) | np.arange(len(names), dtype=np.uint64)
    reach = 1
    while reach < places:
        step = min(reach, places - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    starts = np.flatnonzero(np.arange(len(low)) + length <= ends[piece[: len(low)]])
    anchor = (low[starts] & places_of).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first, last, anchor = starts[at], starts[np.append(at[1:], len(starts)) - 1], anchor[at]
    near, far = anchor - last, anchor - first
    tail = last + length - 2 * size
    hull = _mixed(_mixed(wide[first], wide[np.minimum(first + 2 * size, tail)]), _mixed(wide[tail], ((near << BITS) | far).astype(np.uint64)))
    own = piece[first]
    begins = np.array([p[1] for p in pieces]) - (ends - [len(p[2]) for p in pieces])
    of = np.array([p[0] for p in pieces])[own]
    packed = ((anchor + begins[own]) << (2 * BITS)) | (near << BITS) | far
    columns = [names[anchor].view(np.int64), hull.view(np.int64), k1[of], k2[of], packed]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["name", "hull", "k1", "k2", "at"])


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs``."""
    joined = _keyed(docs).join(spans(docs, length), ["k1", "k2"], "left")
    start, end = (F.coalesce(F.col(f"removed.{c}"), F.expr("array()").cast("array<bigint>")) for c in ("start", "end"))
    schema = "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.select(F.col("doc_id").cast("bigint").alias("doc_id"), "bytes", start.alias("start"), end.alias("end")).mapInArrow(_removed, schema)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        rows = []
        for i in range(len(texts)):
            text = texts[i].as_py()
            start, end = (np.asarray(batch.column(c)[i].values, np.int64) for c in (2, 3))
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(end[order])
            opens = np.flatnonzero(np.append(True, start[1:] > reach[:-1])) if len(start) else np.zeros(0, np.int64)
            begin, stop = start[opens], reach[np.append(opens[1:], len(start)) - 1] if len(opens) else start
            kept = b"".join(text[a:b] for a, b in zip(np.append(0, stop), np.append(begin, len(text)), strict=True))
            rows.append((kept, len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest()))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents")).drop("kept")


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, n, q, substr(h, 2 * q + 1, 2198) AS c FROM (SELECT *, unnest(range(0, greatest(n - 99, 0), 1000)) AS q FROM d)),
w AS (SELECT doc_id, q + i AS p, md5(c[2 * i + 1 : 2 * i + 200]) AS k FROM (SELECT doc_id, q, c, unnest(range(least(1000, n - 99 - q))) AS i FROM c)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM r)),
s AS (SELECT doc_id, span, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY ALL),
k AS (
  SELECT s.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s) s JOIN d USING (doc_id) GROUP BY s.doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
