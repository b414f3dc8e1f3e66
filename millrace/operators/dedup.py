"""Exact and near deduplication in document order.

``docs`` has ``doc_id`` and ``text``; the order is ``order`` (columns, default doc_id). Exact: the first document of a
fingerprint stays. Near: documents are taken in order, and one is dropped if it shares a band key with a document kept
before; only kept documents register their keys. That is the first maximal independent set in document order of the
graph of shared keys. Its connected components are found first; most are small and solved in order inside a task, and only giant ones
are decided in rounds over (document, key) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.frames import columns, small, unused
from millrace.operators.components import components
from millrace.plans.storage import materialize

#: The base of the shingle hash and the modulus of the permutations.
SHINGLE_BASE = 0x01000193
MERSENNE_61 = (1 << 61) - 1


def exact(docs: DataFrame, *order: str) -> DataFrame:
    """``docs`` with ``exact_copy``: whether an earlier document has the same fingerprint.

    Only fingerprints and orders are compared; counts and minima are aggregated before the shuffle, so a fingerprint that
    many documents share costs no large task. Texts meet their verdict by the order's columns, and are not shuffled while
    the copies are few. Of rows that are equal in fingerprint and order one stays, whichever; null texts are copies of each other.
    """
    keys = list(order) or ["doc_id"]
    fp, at, digest, hit = (unused(docs, f"__{x}") for x in ("fp", "at", "digest", "hit"))
    # Fingerprints are costly, so rows meet their verdict by a hash of the text as it is.
    marked = docs.withColumns({at: F.struct(*keys), digest: F.xxhash64("text")})
    counted = marked.groupBy(F.coalesce(T.fingerprint(F.col("text")), F.lit("")).alias(fp), at, digest).agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "fingerprints")  # read twice: for the first of each, and for those that are not it
    first = counted.groupBy(fp).agg(F.min(F.struct(at, digest)).alias("first"))
    judged = counted.join(first, fp).select(at, digest, "n", (F.struct(at, digest) == F.col("first")).alias("is_first"))
    judged = materialize(judged.where("not is_first or n > 1"), "copies")
    n_copies, n_tied = judged.agg(F.count_if(~F.col("is_first")), F.count_if("is_first")).first()
    copies = judged.where("not is_first").select(at, digest, F.lit(True).alias(hit))
    out = marked.join(small(copies, n_copies), [at, digest], "left").withColumn("exact_copy", F.coalesce(F.col(hit), F.lit(False)))
    shown = [*columns(docs), F.col("exact_copy")]
    if not n_tied:
        return out.select(*shown)
    # Rows that repeat in full: all of them but one are copies.
    again = small(judged.where("is_first").select(at, digest), n_tied)
    tied = materialize(out.join(again, [at, digest], "left_semi").withColumn(hit, F.monotonically_increasing_id()), "tied")
    one = tied.groupBy(at, digest).agg(F.min(hit).alias("one"))
    chosen = tied.join(one, [at, digest]).withColumn("exact_copy", F.col(hit) != F.col("one"))
    return out.join(again, [at, digest], "left_anti").select(*shown).unionByName(chosen.select(*shown))


def lsh_threshold(bands: int, rows: int) -> float:
    """The similarity from which a pair probably shares a band."""
    return (1 / bands) ** (1 / rows)


def word_hashes(text: Column, max_words: int | None = None) -> Column:
    """crc32 of the words, lower-cased; of the first ``max_words``, where a bound is asked for."""
    words = T.words(F.lower(text))
    return F.transform(words if max_words is None else F.slice(words, 1, max_words), lambda w: F.crc32(w.cast("binary")))


def shingle_hashes(hashes: Column, size: int = 5) -> Column:
    """Polynomial hashes of runs of ``size`` word hashes, modulo 2^32."""
    low = F.lit(0xFFFFFFFF)

    def combine(a: Column, b: Column) -> Column:
        return (a * F.lit(SHINGLE_BASE) + b).bitwiseAND(low)

    # Horner's rule from left to right: each pass appends one word to every run.
    def grow(cur: Column, k: int) -> Column:
        if k == size:
            return cur
        return grow(F.transform(cur, lambda x, i: combine(x, F.get(hashes, i + k))), k + 1)

    return F.slice(grow(hashes, 1), F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(0)))


def coefficients(permutations: int, seed: int) -> np.ndarray:
    """Two rows of 32-bit numbers; the first is odd, so never zero."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(1, 1 << 32, permutations, dtype=np.uint64) | 1, rng.integers(0, 1 << 32, permutations, dtype=np.uint64)])


def _residues(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2^61 - 1, by folding the high bits onto the low ones instead of dividing."""
    p = np.uint64(MERSENNE_61)
    x = (x & p) + (x >> np.uint64(61))
    return np.where(x >= p, x - p, x)


def _minima(h: np.ndarray, c: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The least (a * h + b) modulo 2^61 - 1 of each permutation; ``room`` is two blocks that are written over."""
    p, least = np.uint64(MERSENNE_61), np.full(c.shape[1], MERSENNE_61, np.uint64)
    for a in range(0, len(h), room.shape[2]):
        part = h[a : a + room.shape[2]]
        x, high = room[0, :, : len(part)], room[1, :, : len(part)]
        np.multiply(c[0][:, None], part[None], out=x)
        np.add(x, c[1][:, None], out=x)
        np.right_shift(x, np.uint64(61), out=high)
        np.bitwise_and(x, p, out=x)
        np.add(x, high, out=x)
        # A sum beyond the modulus is next to never there.
        least = np.minimum(least, (_residues(x) if x.max() >= p else x).min(axis=1))
    return least


def _shingles(w: np.ndarray, size: int) -> np.ndarray:
    """What :func:`shingle_hashes` gives of word hashes, for all places at once."""
    n = max(0, len(w) - size + 1)
    h = w[:n]
    for k in range(1, size):
        h = (h * np.uint64(SHINGLE_BASE) + w[k : n + k]) & np.uint64(0xFFFFFFFF)
    return h


def band_keys(docs: DataFrame, *, bands: int = 16, rows: int = 8, shingle_size: int = 5, max_words: int | None = None, seed: int = 1337, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carry`` and ``keys``: a hash per band of the MinHash signature; no keys for texts shorter than a shingle."""
    c = coefficients(bands * rows, seed)
    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in ("doc_id", *carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty((2, bands * rows, 512), np.uint64)
        for b in batches:
            listed = b.column(b.num_columns - 1)
            at, values = listed.offsets.to_numpy(), listed.values.to_numpy(zero_copy_only=False).astype(np.uint64)
            hashes = [np.unique(_shingles(values[a:z], shingle_size)) for a, z in zip(at[:-1], at[1:], strict=True)]
            signed = [_minima(h, c, room) for h in hashes if len(h)]
            ends = np.cumsum([0, *(bands * rows if len(h) else 0 for h in hashes)])
            flat = np.concatenate([np.empty(0, np.uint64), *signed]).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], keys], ["doc_id", *carry, "signature"])

    hashed = docs.select("doc_id", *carry, F.coalesce(word_hashes(F.col("text"), max_words), F.array().cast("array<bigint>")).alias("w"))
    signed = hashed.mapInArrow(run, f"{kinds}, signature array<bigint>")
    parts = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))
    return signed.select("doc_id", *carry, F.when(F.size("signature") > 0, parts).otherwise(F.array().cast("array<bigint>")).alias("keys"))


#: Rows (document, key) of a component up to which one task takes its documents in order, and rows of such a task.
COMPONENT_ROWS, TASK_ROWS = 1_000_000, 200_000


def greedy(keys: DataFrame, *, component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """doc_id of the documents to drop; ``keys`` has doc_id, ``ord`` (unique, orderable) and ``keys``.

    Documents that share keys, directly or through others, are a component; verdicts of one don't depend on another. Those of
    up to ``component_rows`` rows are dealt to tasks whole, and a task takes its documents in order, with the keys
    met so far. Larger ones stay distributed, and are decided in rounds (:func:`in_rounds`).
    """
    pairs = materialize(keys.select("doc_id", "ord", F.explode(F.array_distinct("keys")).alias("key")), "greedy-pairs")
    shared = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("least")).where("n > 1")
    # Documents without a shared key are kept at once and decide nothing.
    pairs = materialize(pairs.join(shared.select("key", "least"), "key"), "greedy-shared")
    found = components(pairs.select(F.col("ord").alias("a"), F.col("least").alias("b")))
    placed = pairs.join(found.withColumnRenamed("node", "ord"), "ord")
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    placed = materialize(placed.join(sizes.select("root", (F.col("n") > component_rows).alias("giant")), "root"), "greedy-placed")
    n_rows, n_giant = placed.agg(F.count(F.lit(1)), F.count_if("giant")).first()
    kind = keys.schema["doc_id"].dataType.simpleString()
    tasks = max(1, -(-n_rows // TASK_ROWS))
    small_ones = placed.where("not giant").withColumn("task", F.pmod(F.xxhash64("root"), F.lit(tasks)))
    rank = F.struct("ord", "key")
    dropped = small_ones.groupBy("task").agg(F.sort_array(F.collect_list(rank)).alias("rows")).select("rows").mapInArrow(_in_order, f"doc_id {keys.schema['ord'].dataType.simpleString()}")
    # Who is dropped shares a key, so ids are read from the table; ``keys`` would be made a second time.
    ids = pairs.select("doc_id", "ord").distinct()
    dropped = dropped.withColumnRenamed("doc_id", "ord")
    if n_giant:
        giant = in_rounds(placed.where("giant").select(F.col("ord").alias("doc_id"), "ord", "key", "least"))
        dropped = dropped.unionByName(giant.withColumnRenamed("doc_id", "ord"))
    return ids.join(dropped, "ord", "left_semi").select(F.col("doc_id").cast(kind).alias("doc_id"))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to drop among rows (ord, key) sorted by ord: those that share a key with one kept before."""
    for batch in batches:
        rows = batch.column(0)
        for i in range(len(rows)):
            of = rows[i].values
            place, key = of.field("ord"), of.field("key").to_numpy()
            # Rows of a document lie together; where does each begin?
            same = [np.asarray(pc.equal(f[1:], f[:-1]).fill_null(False)) | np.asarray(pc.and_(pc.is_null(f[1:]), pc.is_null(f[:-1]))) for f in _flat(place)]
            begins = np.append(0, np.flatnonzero(~np.logical_and.reduce(same)) + 1) if len(place) > 1 else np.zeros(min(1, len(place)), np.int64)
            met: set[int] = set()
            dropped = []
            for a, z in zip(begins, np.append(begins[1:], len(key)), strict=True):
                own = key[a:z].tolist()
                if met.isdisjoint(own):
                    met.update(own)
                else:
                    dropped.append(a)
            yield pa.RecordBatch.from_arrays([place.take(pa.array(dropped, pa.int64()))], ["doc_id"])


def _flat(values: pa.Array) -> list[pa.Array]:
    """The fields of a struct, or the values themselves."""
    return values.flatten() if pa.types.is_struct(values.type) else [values]


def in_rounds(open_: DataFrame) -> DataFrame:
    """doc_id to drop among rows (doc_id, ord, key, least) of shared keys, however many documents hang together.

    Each round a document that is the first open one of all its keys is kept, and the open ones that share a key with
    it are dropped; the smallest open one always is kept, so the rounds end. Decided documents leave the table, and so
    do keys that only one open document is left with: rounds shrink, and a long chain of shared keys costs many rounds of few rows.
    """
    dropped = open_.select("doc_id").where("false")
    open_ = materialize(open_, "greedy")
    while not open_.isEmpty():
        first = open_.groupBy("doc_id").agg(F.bool_and(F.col("least") == F.col("ord")).alias("first")).where("first").select("doc_id")
        kept = open_.join(first, "doc_id", "left_semi").select("key").distinct()
        gone = materialize(open_.join(kept, "key", "left_semi").select("doc_id").distinct().join(first, "doc_id", "left_anti"), "dropped")
        dropped = dropped.unionByName(gone)
        left = open_.join(gone.unionByName(first), "doc_id", "left_anti").select("doc_id", "ord", "key")
        # A key of one open document decides nothing more; a document that has no other key left is kept.
        still = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("least")).where("n > 1")
        open_ = materialize(left.join(still.select("key", "least"), "key"), "greedy", instead_of=open_)
    return dropped


def row_place(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart and puts them in order where ids are null or repeated: the id, then 128 bits of the text."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def deduplicate(docs: DataFrame, *, near: bool = True, **params: int) -> DataFrame:
    """``docs`` with ``verdict``: kept, exact or near. Exact copies are found first and take no part in the second step.

    Documents come in the order of doc_id, null first; rows of one id in that of a hash of their texts.
    """
    marked = exact(docs)
    if not near:
        return marked.withColumn("verdict", F.when(F.col("exact_copy"), "exact").otherwise("kept")).drop("exact_copy")
    at, hit = unused(marked, "__at"), unused(marked, "__hit")
    marked = materialize(marked, "exact")
    keys = band_keys(marked.where("not exact_copy").select(row_place().alias("doc_id"), "text"), **params)
    dropped = greedy(keys.withColumn("ord", F.col("doc_id"))).select(F.col("doc_id").alias(at), F.lit(True).alias(hit))
    verdict = F.when(F.col("exact_copy"), F.lit("exact")).when(F.col(hit), F.lit("near")).otherwise(F.lit("kept"))
    return marked.withColumn(at, row_place()).join(dropped, at, "left").withColumn("verdict", verdict).select(*columns(docs), "verdict")


def stats(verdicts: DataFrame) -> DataFrame:
    """seen, exact, near, kept and removal_rate."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("exact", "near", "kept")]
    return verdicts.agg(F.count(F.lit(1)).alias("seen"), *counts).withColumn("removal_rate", F.when(F.col("seen") > 0, 1 - F.col("kept") / F.col("seen")).otherwise(0.0))
