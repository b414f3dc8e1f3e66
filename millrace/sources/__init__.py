"""Document sources: each gives id, text, source, lang, meta (map of strings) and ord (the order within the source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval
from millrace.plans import storage
from millrace.plans.registry import Registry
from millrace.sources import zstd_lines

SOURCES: Registry[DataFrame] = Registry("source")
#: Fields that may hold a row's text or its id, the first non-empty string wins.
TEXT_FIELDS = ("text", "content", "raw_content", "code", "complete_text")
ID_FIELDS = ("id", "_id", "url", "path", "repo_name")
SCHEMA = "id string, text string, source string, lang string, meta map<string,string>"


def shaped(rows: DataFrame, label: str, key: Column, text: Column, lang: Column | str, meta: Column | None = None, order: Column | None = None) -> DataFrame:
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.select(
        F.concat(F.lit(f"{label}:"), key.cast("string")).alias("id"),
        text.alias("text"),
        F.lit(label).alias("source"),
        (F.lit(lang) if isinstance(lang, str) else lang).alias("lang"),
        (none if meta is None else meta).alias("meta"),
        (key.cast("string") if order is None else order).alias("ord"),
    )


def first_text(rows: DataFrame, fields: tuple[str, ...]) -> Column:
    """The first of the fields that exists, is a string and is not empty."""
    kinds = dict(rows.dtypes)
    found = [F.nullif(F.col(f"`{f}`"), F.lit("")) for f in fields if kinds.get(f) == "string"]
    return F.coalesce(*found, F.lit(None).cast("string"))


def limited(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows in order, where a limit is asked for."""
    return rows if limit is None else rows.orderBy("ord").limit(limit)


@SOURCES.register("table", "huggingface", "hf")
def table(spark: SparkSession, *, label: str, dataset: str, format: str = "parquet", lang: str = "unknown", limit: int | None = None, seed: int | None = 1337, text_field: str | None = None, keep_meta: tuple[str, ...] = ()) -> DataFrame:
    """A dataset of rows with a text field to be found; in the order of a hash of the id unless ``seed`` is None.

    Rows without a text are left out; no row at all raises.
    """
    rows = spark.read.format(format).load(dataset)
    text = first_text(rows, (text_field,) if text_field else TEXT_FIELDS)
    key = F.coalesce(first_text(rows, ID_FIELDS), *([F.col("doc_id").cast("string")] if "doc_id" in rows.columns else []), F.sha2(text.cast("binary"), 256))
    meta = F.map_from_arrays(F.array(*[F.lit(c) for c in keep_meta]).cast("array<string>"), F.array(*[F.col(f"`{c}`").cast("string") for c in keep_meta]).cast("array<string>"))
    order = key if seed is None else F.concat(F.hex(F.xxhash64(key, F.lit(seed))), F.lit(":"), key)
    out = limited(shaped(rows, label, key, text, lang, meta, order).where("text is not null"), limit)
    if out.isEmpty():
        raise ValueError(f"source {label!r} gave no document: {dataset}")
    return out


def _files(spark: SparkSession, root: str, pattern: str, encoding: str = "UTF-8") -> DataFrame:
    """(path relative to the root, value) of whole files; ``encoding`` is one that Spark decodes."""
    name = F.col("_metadata.file_path")
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if encoding.upper() == "UTF-8":
        rows = found.text(root, wholetext=True)
    else:
        rows = found.format("binaryFile").load(root).withColumn("value", F.decode("content", encoding))
    base = root.rstrip("/").split("://")[-1].replace("file:", "")
    return rows.select("value", F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), rf"^.*?\Q{base}\E/", "").alias("path"))


def hash_split(path: Column, fraction: float) -> Column:
    """Whether a path belongs to validation; new paths don't move old ones."""
    return F.pmod(F.conv(F.substring(F.md5(path.cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(10_000)) < F.lit(round(fraction * 10_000))


@SOURCES.register("notes", "obsidian")
def notes(spark: SparkSession, *, label: str, vault: str, lang: str = "fr", exclude: tuple[str, ...] = (".obsidian", ".trash", "Templates"), min_words: int = 30, keep_code: bool = True, split: str = "all", val_fraction: float = 0.15, limit: int | None = None) -> DataFrame:
    """Markdown notes without their markup; paths with an excluded part and short notes are left out."""
    rows = _files(spark, vault, "*.md").where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in exclude])))
    if split != "all":
        held = hash_split(F.col("path"), val_fraction)
        rows = rows.where(held if split == "val" else ~held)
    text = T.strip_markdown(F.col("value"), keep_code=keep_code)
    out = shaped(rows, label, F.col("path"), text, lang, F.create_map(F.lit("path"), F.col("path")))
    return limited(out.where(T.n_words(F.col("text")) >= min_words), limit)


@SOURCES.register("books", "gutenberg")
def books(spark: SparkSession, *, label: str, root: str, pattern: str = "*.txt", lang: str = "fr", target_words: int = 1200, min_words: int = 100, encoding: str = "UTF-8", limit: int | None = None) -> DataFrame:
    """Chunks of books; short chunks are left out but keep their numbers."""
    rows = _files(spark, root, pattern, encoding).withColumn("stem", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    cut = rows.select("stem", F.posexplode(retrieval.book_chunks(T.strip_book_frame(F.col("value")), target_words)).alias("i", "chunk"))
    key = F.concat("stem", F.lit("#"), F.col("i").cast("string"))
    out = shaped(cut, label, key, F.col("chunk"), lang, F.create_map(F.lit("book"), F.col("stem")), F.format_string("%s#%09d", "stem", "i"))
    return limited(out.where(T.n_words(F.col("text")) >= min_words), limit)


@SOURCES.register("files", "local_files")
def files(spark: SparkSession, *, label: str, root: str, pattern: str = "*.txt", lang: str = "unknown", encoding: str = "UTF-8", limit: int | None = None) -> DataFrame:
    """One document per file that is not blank."""
    rows = _files(spark, root, pattern, encoding)
    return limited(shaped(rows, label, F.col("path"), F.col("value"), lang).where(T.strip(F.col("text")) != ""), limit)


@SOURCES.register("shards")
def shards(spark: SparkSession, *, path: str | None = None, artifact: str | None = None, source: str = "corpus", root: str | None = None, label: str | None = None, format: str = "parquet", limit: int | None = None) -> DataFrame:
    """Documents written before; JSON lines that can't be read, or lack id, text or source, are left out.

    Either at ``path``, or in the newest complete corpus under ``root`` that is labelled ``artifact``: its ``source``
    ("corpus" is the assembled mixture, "documents" what went into it).
    """
    if (path is None) == (artifact is None):
        raise ValueError("shards are found by a path or by an artifact's label")
    if path is None:
        path = f"{storage.newest(spark, root or '.', 'corpora', artifact)}/{source}"
    if format == "zstd":
        zstd_lines.register(spark)
        rows = from_json(spark.read.format("zstd_lines").load(path))
    elif format == "json":
        rows = from_json(spark.read.text(path))
    else:
        rows = spark.read.parquet(path)
    rows = rows if label is None else rows.withColumn("source", F.lit(label))
    rows = rows.select("id", "text", "source", F.coalesce("lang", F.lit("unknown")).alias("lang"), "meta", F.col("id").alias("ord"))
    return limited(rows, limit)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metric log in JSON lines: sparse fields, bad lines left out."""
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def instructions(conversations: DataFrame, min_words: int = 3) -> DataFrame:
    """(instruction, output) of user turns and the assistant turns after them; short or empty ones are left out."""
    from pyspark.sql import Window as W

    along = W.partitionBy("conv_id").orderBy("turn")
    pairs = conversations.withColumns({"next_role": F.lead("role").over(along), "output": F.lead("text").over(along)})
    kept = pairs.where((F.col("role") == "user") & (F.col("next_role") == "assistant") & (T.strip(F.col("text")) != "") & (T.n_words(F.col("output")) >= min_words))
    return kept.select("conv_id", "turn", F.col("text").alias("instruction"), "output")


def to_json(docs: DataFrame) -> DataFrame:
    """(value): a JSON object per document, its ``meta`` only where it has entries."""
    fields = [F.col(c) for c in ("id", "text", "source", "lang")]
    return docs.select(F.to_json(F.struct(*fields, F.when(F.size("meta") > 0, F.col("meta")).alias("meta"))).alias("value"))


def from_json(lines: DataFrame) -> DataFrame:
    """Documents of lines (value); a missing lang is ``unknown``, missing meta empty; lines without id, text or source are left out."""
    parsed = lines.select(F.from_json("value", SCHEMA).alias("d")).select("d.*").where("id is not null and text is not null and source is not null")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return parsed.select("id", "text", "source", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("meta", none).alias("meta"))


def peek(docs: DataFrame, n: int = 3, *order: str) -> DataFrame:
    """The first documents in order, for a look."""
    return docs.orderBy(*(order or ("ord",))).limit(n)


def shard_paths(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, bytes) of the files of a folder, without reading them; sort by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"))


def synthetic_tokens(spark: SparkSession, n: int, length: int, *, vocab: int = 64, signal: float = 0.8, seed: int = 1337) -> DataFrame:
    """(i, ids): ``n`` sequences of a Markov chain of order one, a fixture to learn from.

    With probability ``signal`` a token's successor is the one that the seed gives to it, else any token. Every draw is a hash
    of seed, sequence and place, so rows don't depend on the partitions.
    """
    unit = lambda *key: F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30)
    token = lambda *key: F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(vocab)).cast("int")
    places = F.sequence(F.lit(1), F.lit(length - 1)) if length > 1 else F.array().cast("array<int>")

    def step(ids: Column, k: Column) -> Column:
        last = F.element_at(ids, -1)
        return F.array_append(ids, F.when(unit(F.lit("u"), F.col("i"), k) < signal, token(F.lit("next"), last)).otherwise(token(F.lit("any"), F.col("i"), k)))

    rows = spark.range(n).withColumnRenamed("id", "i")
    return rows.select("i", F.aggregate(places, F.array(token(F.lit("first"), F.col("i"))), step).alias("ids"))
