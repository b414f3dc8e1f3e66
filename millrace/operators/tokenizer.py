"""Pre-tokenisation, byte-level BPE training and encoding, and fertility."""

from __future__ import annotations

import heapq
import json
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import tokens
from millrace.plans.storage import materialize
from millrace.sources import sinks

#: Elided words that keep their apostrophe, the longest first.
ELISIONS = ("aujourd", "quelqu", "lorsqu", "puisqu", "quoiqu", "presqu", "jusqu", "entr", "qu", "l", "d", "j", "n", "m", "t", "s", "c")
#: The parts of the patterns.
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
LETTERS, OTHERS, SPACES = r" ?\p{L}+", r" ?[^\s\p{L}\p{N}]+", r"\s+(?!\S)|\s+"
PATTERNS = {
    "gpt2": "|".join((SUFFIXES, LETTERS, r" ?\p{N}+", OTHERS, SPACES)),
    "french": "|".join((f"(?i:{SUFFIXES})", f" ?(?i:{'|'.join(ELISIONS)})'", LETTERS, r" ?\p{N}{1,3}", OTHERS, SPACES)),
    "french_longnum": "|".join((f"(?i:{SUFFIXES})", f" ?(?i:{'|'.join(ELISIONS)})'", LETTERS, r" ?\p{N}+", OTHERS, SPACES)),
}
#: Special tokens.
EOT, PAD, RESERVED = 0, 1, 16
SPECIALS = 2 + RESERVED


def pattern(name: str) -> str:
    """A named pattern, or ``name`` itself as one; blank raises."""
    if not name.strip():
        raise ValueError("the pattern is blank")
    return PATTERNS.get(name, name)


def pieces(text: Column, name: str = "french") -> Column:
    """The pieces of a text in order; joined again they are the text."""
    return F.regexp_extract_all(text, F.lit(f"(?U)({pattern(name)})"), F.lit(1))


def frequencies(docs: DataFrame, name: str = "french") -> DataFrame:
    """How often each piece occurs: (piece, n)."""
    return docs.select(F.explode(pieces(F.col("text"), name)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


#: Rows of different token runs that the driver takes at a time in training.
RUNS = 1_000_000


def train(counts: DataFrame, *, vocab_size: int, min_frequency: int = 2, max_runs: int = RUNS, passes: list[int] | None = None) -> list[tuple[int, int]]:
    """Merges of a byte-level BPE, the most frequent pair first, the smaller pair of equal ones.

    Pieces stay distributed. A pass counts pairs where the pieces are and takes those that occur at least some number of
    times; it cuts every piece into its runs of such pairs and sums up equal runs, of which the driver gets at most
    ``max_runs``. A pair that a merge makes is no more frequent than the pairs it came from, so all pairs of at least that
    number, made now or later, lie within runs, and the merges among them are exact: the driver makes them all, and then the
    pieces are rewritten, once for the pass. The number is chosen so that the runs fit; at worst a pass is one merge.
    ``passes``, if given, gets the merges after each pass. Ids: specials, then 256 bytes, then one per merge.
    """
    raw = F.encode("piece", "UTF-8")
    # Bytes as numbers: two hex digits each.
    ids = F.transform(F.sequence(F.lit(0), F.octet_length("piece") - 1), lambda i: F.conv(F.substr(F.hex(raw), i * 2 + 1, F.lit(2)), 16, 10).cast("int") + SPECIALS)
    rows = materialize(counts.where(F.octet_length("piece") > 1).select(ids.alias("ids"), F.col("n").cast("bigint").alias("n")), "bpe")
    wanted = vocab_size - SPECIALS - 256
    merges: list[tuple[int, int]] = []
    n_pairs = 1 << 16
    while len(merges) < wanted:
        pairs = F.zip_with(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        weights = rows.select(F.explode(pairs).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("w")).where(F.col("w") >= min_frequency)
        best = [(r["w"], r["p"]["a"], r["p"]["b"]) for r in weights.orderBy(F.desc("w"), "p.a", "p.b").limit((1 << 16) + 1).collect()]
        if not best:
            break
        while True:
            found, least = _frequent(best, n_pairs, min_frequency)
            if len(found) == 1:
                more, n_pairs = [best[0][1:]], 4 * n_pairs
                break
            runs = materialize(_runs(rows, found), "bpe-runs")
            if runs.count() <= max_runs:
                more = _merge_runs([(r["ids"], r["n"]) for r in runs.toLocalIterator()], least, len(merges), wanted)
                n_pairs = min(1 << 16, 4 * n_pairs)
                break
            n_pairs = max(1, min(n_pairs, len(found)) // 4)
        ranks = {pair: len(merges) + i for i, pair in enumerate(more)}
        merges += more
        rows = materialize(_rewritten(rows, ranks), "bpe", instead_of=rows)
        if passes is not None:
            passes.append(len(merges))
    return merges


def _frequent(best: list[tuple[int, int, int]], n: int, min_frequency: int) -> tuple[list[tuple[int, int]], int]:
    """Of pairs by falling weight the first n or so, and the weight from which they are all that there are."""
    if n >= len(best) and len(best) <= 1 << 16:
        return [p[1:] for p in best], min_frequency
    least = best[min(n, len(best) - 1)][0] + 1  # equal ones stay together
    kept = [p[1:] for p in best if p[0] >= least]
    return (kept or [best[0][1:]]), least


def _runs(rows: DataFrame, found: list[tuple[int, int]]) -> DataFrame:
    """(ids, n): the longest runs of ``found`` pairs in the pieces, equal ones summed up."""
    wanted = np.sort(np.array([a << 32 | b for a, b in found], np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(0), batch.column(1).to_numpy()
            ids, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            lengths = np.diff(ends)
            ids = ids[ends[0] : ends[-1]]
            piece = np.repeat(np.arange(len(n)), lengths)
            pair = ids[:-1].astype(np.int64) << 32 | ids[1:]
            at = np.searchsorted(wanted, pair)
            joined = (wanted[np.minimum(at, len(wanted) - 1)] == pair) & (piece[:-1] == piece[1:])
            starts = np.flatnonzero(np.append(True, ~joined))  # runs, of one token too
            sizes = np.diff(np.append(starts, len(ids)))
            long = sizes > 1
            keep = np.repeat(long, sizes)
            offsets = np.append(0, np.cumsum(sizes[long])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[keep], pa.int32())), pa.array(n[piece[starts[long]]], pa.int64())], ["ids", "n"])

    return rows.mapInArrow(cut, "ids array<int>, n bigint").groupBy("ids").agg(F.sum("n").alias("n"))


def _merge_runs(rows: list[tuple[list[int], int]], least: int, done: int, wanted: int) -> list[tuple[int, int]]:
    """The next merges while the best pair has at least the weight ``least``; ``done`` were made before."""
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    weight: Counter = Counter()
    for k, (ids, m) in enumerate(rows):
        for pair in zip(ids, ids[1:], strict=False):
            weight[pair] += m
            where[pair].add(k)
    heap = [(-w, p) for p, w in weight.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int]] = []
    while heap and done + len(merges) < wanted:
        w, pair = heapq.heappop(heap)
        if -w != weight.get(pair, 0):
            continue  # an old entry
        if -w < least:
            break
        new = SPECIALS + 256 + done + len(merges)
        merges.append(pair)
        touched = set()
        for k in where.pop(pair):
            ids, m = rows[k]
            for old in zip(ids, ids[1:], strict=False):
                weight[old] -= m
                touched.add(old)
            ids = merged(ids, pair, new)
            rows[k] = (ids, m)
            for fresh in zip(ids, ids[1:], strict=False):
                weight[fresh] += m
                where[fresh].add(k)
                touched.add(fresh)
        weight.pop(pair, None)
        for p in touched - {pair}:
            if weight[p] > 0:
                heapq.heappush(heap, (-weight[p], p))
    return merges


def _rewritten(rows: DataFrame, ranks: dict[tuple[int, int], int]) -> DataFrame:
    """The pieces after the merges of ``ranks``; those that are one token now have no pair any more and go."""

    def rewrite(x: pa.Array) -> pa.Array:
        return pa.array([joined(ids, ranks) for ids in x.to_pylist()], pa.list_(pa.int32()))

    return rows.select(F.arrow_udf(rewrite, "array<int>")("ids").alias("ids"), "n").where(F.size("ids") > 1)


def joined(ids: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """``ids`` after all merges, the one of the lowest rank first, from left to right: ranks start at the first merge of all.

    Neighbours are linked and candidates wait in a heap, so a long piece costs n log n whatever the number of merges.
    """
    heap = [r << 32 | i for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (r := ranks.get(pair)) is not None]
    if not heap:
        return ids
    heapq.heapify(heap)
    at: list[int | None] = list(ids)
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    end = len(ids)
    while heap:
        got = heapq.heappop(heap)
        r, i = got >> 32, got & 0xFFFFFFFF
        j = after[i]
        if at[i] is None or j == end or ranks.get((at[i], at[j])) != r:
            continue  # one of the two has been merged meanwhile
        at[i], at[j] = SPECIALS + 256 + r, None
        k = after[i] = after[j]
        if k != end:
            before[k] = i
            if (x := ranks.get((at[i], at[k]))) is not None:
                heapq.heappush(heap, x << 32 | i)
        h = before[i]
        if h >= 0 and (x := ranks.get((at[h], at[i]))) is not None:
            heapq.heappush(heap, x << 32 | h)
    return [x for x in at if x is not None]


def merged(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    out, i = [], 0
    while i < len(ids):
        if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


class Codec:
    """Encodes with a pattern and merges; what it has encoded it decodes to the same bytes."""

    def __init__(self, merges: list[tuple[int, int]], name: str = "french") -> None:
        self.merges, self.name = [tuple(m) for m in merges], name
        self.rank = {m: i for i, m in enumerate(self.merges)}
        self._known: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        got = self._known.get(piece)
        if got is None:
            got = joined([SPECIALS + b for b in piece.encode()], self.rank)
            if len(self._known) < 200_000 and len(piece) < 200:
                self._known[piece] = got
        return got

    def encode(self, found: list[str]) -> list[int]:
        return [i for p in found for i in self.piece(p)]

    def decode(self, ids: list[int]) -> str:
        def spread(i: int) -> bytes:
            if i < SPECIALS:
                return b""
            if i < SPECIALS + 256:
                return bytes([i - SPECIALS])
            a, b = self.merges[i - SPECIALS - 256]
            return spread(a) + spread(b)

        return b"".join(map(spread, ids)).decode("utf-8", "replace")

    def to_json(self) -> str:
        return json.dumps({"pattern": self.name, "merges": self.merges})

    @classmethod
    def from_json(cls, raw: str) -> Codec:
        got = json.loads(raw)
        return cls(got["merges"], got["pattern"])


def encoded(texts: pa.Array, codec: Codec, tail: list[int]) -> pa.Array:
    """Ids of texts that are lists of pieces, each with ``tail``: only one text's pieces are Python's at a time, and ids take four bytes."""
    flat, ends = array("i"), [0]
    for found in texts:
        for p in found.as_py() or []:
            flat.extend(codec.piece(p))
        flat.extend(tail)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))


def encode(docs: DataFrame, codec: Codec, *, add_eot: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array<int>): the pieces are cut on the JVM and looked up in Arrow batches."""
    tail = [EOT] if add_eot else []

    def ids(x: pa.Array) -> pa.Array:
        return encoded(x, codec, tail)

    return docs.withColumn("ids", F.arrow_udf(ids, "array<int>")(pieces(F.coalesce(F.col("text"), F.lit("")), codec.name)))


def decode(rows: DataFrame, codec: Codec) -> DataFrame:
    def back(x: pa.Array) -> pa.Array:
        return pa.array([codec.decode(i.as_py() or []) for i in x], pa.string())

    return rows.withColumn("text", F.arrow_udf(back, "string")("ids"))


def measure(docs: DataFrame, n_tokens: Column, *by: str) -> DataFrame:
    """Additive counts (tokens, words, chars, documents), by group and, with ``by``, overall (null group)."""
    sized = docs.select(*by, n_tokens.cast("bigint").alias("t"), T.n_words(F.col("text")).cast("bigint").alias("w"), F.length("text").cast("bigint").alias("c"))
    grouped = sized.rollup(*by) if by else sized.groupBy()
    return grouped.agg(F.sum("t").alias("tokens"), F.sum("w").alias("words"), F.sum("c").alias("chars"), F.count(F.lit(1)).alias("documents"))


def fertility(counts: DataFrame) -> DataFrame:
    """Ratios of summed counts; 0 where there is nothing to divide by."""
    ratio = lambda a, b, d: F.when(F.col(b) > 0, F.bround(F.col(a) / F.col(b), d)).otherwise(0.0)
    return counts.withColumn("fertility", ratio("tokens", "words", 4)).withColumn("chars_per_token", ratio("chars", "tokens", 3))


def compare(counts: DataFrame, baseline: str) -> DataFrame:
    """Rows (tokenizer, group, tokens, ...) with the share of tokens saved against the baseline's overall count."""
    base = counts.where((F.col("tokenizer") == baseline) & F.col("grp").isNull()).select(F.lit(1).alias("k"), F.col("tokens").alias("base"))
    overall = counts.where(F.col("grp").isNull()).withColumn("k", F.lit(1)).join(F.broadcast(base), "k").drop("k")
    return overall.withColumn("tokens_saved", F.bround(1 - F.col("tokens") / F.col("base"), 4)).drop("base")


def service_ids() -> list[int]:
    """Ids that stand for no text: the end of a text, padding and those in reserve."""
    return list(range(SPECIALS))


def tokenize_corpus(docs: DataFrame, codec: Codec, path: str, *, order: str = "doc_id", tokens_per_shard: int = 100_000_000) -> DataFrame:
    """Encode documents, each with an end of text, pack them in order and write their shards; the statistics of what is there."""
    encoded = materialize(encode(docs, codec).select(F.col(order), "ids"), "encoded")
    sinks.write_tokens(tokens.in_shards(tokens.pack(encoded, order=order), tokens_per_shard), path)
    return tokens.stats(docs.sparkSession.read.parquet(path))


def baselines(docs: DataFrame, *by: str) -> DataFrame:
    """Counts of tokenizers that need no vocabulary: white-space words, characters, and pieces of the gpt2 pattern."""
    text = F.col("text")
    counters = {"words": T.n_words(text), "chars": F.length(text), "gpt2 pieces": F.regexp_count(text, F.lit(f"(?U){pattern('gpt2')}"))}
    out = None
    for name, n in counters.items():
        part = measure(docs, n, *by).withColumn("tokenizer", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def comparison(counts: DataFrame, baseline: str) -> DataFrame:
    """Overall fertility by tokenizer, the best first, with the share of tokens saved against the baseline."""
    rows = compare(counts.withColumn("grp", F.lit(None).cast("string")) if "grp" not in counts.columns else counts, baseline)
    return fertility(rows).select("tokenizer", "tokens", "fertility", "chars_per_token", "tokens_saved").orderBy("fertility", "tokenizer")
