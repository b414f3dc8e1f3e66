"""More queries of the registry: formats, dedup and tokenizers at size, stored indexes, streams with state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import streaming
from millrace.operators import dedup, evaluation, mixture, novelty, retrieval, search_index, tokenizer, tokens
from millrace.plans.storage import Artifact, materialize, shared_dir
from millrace.queries import _PLANNED, _RANKED, _TERMS, _WHOLE_PIECES, _WORDS, ORACLE_SQL, _ids, _plan, docs, query, table
from millrace.sources import SOURCES, sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("snk_zstd_shards", "SELECT 'd:' || doc_id AS id, md5(text) AS digest, source, coalesce(lang, 'unknown') AS lang, doc_id::VARCHAR AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def snk_zstd_shards(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as zstd JSON lines, in shards that rotate on compressed bytes, and read again."""
    shaped = docs(spark, d).select(F.concat(F.lit("d:"), F.col("doc_id")).alias("id"), "text", "source", "lang", F.create_map(F.lit("n"), F.col("doc_id").cast("string")).alias("meta"))
    path = _folder(spark, "zstd")
    sinks.write_shards(shaped, path, format="zstd", max_bytes=16 << 20)
    back = SOURCES.get("shards")(spark, path=path, format="zstd")
    return back.select("id", F.md5(F.col("text").cast("binary")).alias("digest"), "source", "lang", F.col("meta")["n"].alias("n"))


def _bands_sql(bands: int, rows: int, size: int, seed: int) -> str:
    """SQL of each document's bands (doc_id, band, key) of MinHash over runs of ``size`` words: two documents share a key if all minima of a band agree."""
    a, b = dedup.coefficients(bands * rows, seed).tolist()
    return f"""
words AS (SELECT doc_id, regexp_extract_all(lower(text), '\\S+') AS w FROM documents),
crc AS (
  SELECT w, xor(4294967295, list_reduce(list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT),
    lambda c, x: list_reduce(range(8), lambda c2, i: CASE WHEN c2 & 1 = 1 THEN xor(c2 >> 1, 3988292384) ELSE c2 >> 1 END, xor(c, x)), 4294967295::BIGINT)) AS h
  FROM (SELECT DISTINCT unnest(w) AS w FROM words)
),
hashed AS (SELECT doc_id, i, h FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words) JOIN crc USING (w)),
shingles AS (
  SELECT DISTINCT doc_id, {"((" * (size - 1)}h{"".join(f" * {dedup.SHINGLE_BASE} + lead(h, {k}) OVER d) & 4294967295)" for k in range(1, size))} AS h
  FROM hashed WINDOW d AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(h, {size - 1}) OVER d IS NOT NULL
),
least AS (
  SELECT doc_id, j, min((a::UBIGINT * h::UBIGINT + b::UBIGINT) % {dedup.MERSENNE_61}::UBIGINT) AS m
  FROM shingles, (SELECT unnest({a}) AS a, unnest({b}) AS b, unnest(range({bands * rows})) AS j) GROUP BY doc_id, j
),
bands AS (SELECT doc_id, (j // {rows})::INT AS band, string_agg(m::VARCHAR, ',' ORDER BY j) AS key FROM least GROUP BY ALL)"""


_VERDICTS = f"""
WITH RECURSIVE {_bands_sql(16, 8, 5, 1337)},
exact AS (
  SELECT doc_id, row_number() OVER (PARTITION BY md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) ORDER BY doc_id) > 1 AS copy FROM documents
),
own AS (SELECT bands.* FROM bands JOIN exact USING (doc_id) WHERE NOT copy),
shared AS (SELECT * FROM own QUALIFY count(*) OVER (PARTITION BY band, key) > 1),
asked AS MATERIALIZED (SELECT doc_id, list(hash(band, key)) AS keys, row_number() OVER (ORDER BY doc_id) AS i FROM shared GROUP BY doc_id),
fold(i, doc_id, met, near) AS (
  SELECT 0::BIGINT, NULL::BIGINT, []::UBIGINT[], false
  UNION ALL
  SELECT asked.i, asked.doc_id, CASE WHEN list_has_any(met, keys) THEN met ELSE list_concat(met, keys) END, list_has_any(met, keys) FROM fold JOIN asked ON asked.i = fold.i + 1
),
verdicts AS (SELECT doc_id, CASE WHEN copy THEN 'exact' WHEN coalesce(near, false) THEN 'near' ELSE 'kept' END AS verdict FROM exact LEFT JOIN fold USING (doc_id))
"""
ORACLE_SQL["ded_near"] = _VERDICTS + "SELECT doc_id, verdict FROM verdicts"
ORACLE_SQL["ded_stats"] = _VERDICTS + (
    "SELECT count(*) AS seen, count(*) FILTER (verdict = 'exact') AS exact, count(*) FILTER (verdict = 'near') AS near, count(*) FILTER (verdict = 'kept') AS kept, "
    "1 - count(*) FILTER (verdict = 'kept')::DOUBLE / count(*) AS removal_rate FROM verdicts"
)


@query("ded_band_classes", f"WITH {_bands_sql(16, 8, 5, 1337)} SELECT doc_id, band, min(doc_id) OVER (PARTITION BY band, key) AS first_id FROM bands")
def ded_band_classes(spark: SparkSession, d: str) -> DataFrame:
    """The bands of every document, each named by the first document that has it too."""
    keys = dedup.band_keys(docs(spark, d, "doc_id", "text")).select("doc_id", F.posexplode("keys").alias("band", "key"))
    keys = materialize(keys, "bands")
    return keys.join(keys.groupBy("key").agg(F.min("doc_id").alias("first_id")), "key").select("doc_id", "band", "first_id")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), retrieval.terms(F.col("text")).alias("terms"))


@query("rag_stored_search", _RANKED + "SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3")
def rag_stored_search(spark: SparkSession, d: str) -> DataFrame:
    """The index is stored, and grows by a language at a time; blocks are skipped by their bounds."""
    passages, path = docs(spark, d).withColumnRenamed("doc_id", "id").select("id", "text", F.coalesce("lang", F.lit("")).alias("lang")), _folder(spark, "index")
    languages = [r[0] for r in passages.select("lang").distinct().orderBy("lang").collect()]
    for k, lang in enumerate(languages):
        sinks.write_index(passages.where(F.col("lang") == lang).drop("lang"), path, mode="append" if k else "overwrite")
    return search_index.search(spark, path, _asked(spark, d)).withColumn("score", F.round("score", 6))


_TITLED = f"list_concat({_TERMS}, list_concat({_TERMS.replace('(text)', '(coalesce(source, chr(32)))')}, {_TERMS.replace('(text)', '(coalesce(source, chr(32)))')}))"


@query("rag_titled_search", _RANKED.replace(f"doc_id AS id, {_TERMS} AS t FROM documents", f"doc_id AS id, {_TITLED} AS t FROM documents") + "SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5")
def rag_titled_search(spark: SparkSession, d: str) -> DataFrame:
    """As above with the source as a document's title, which counts twice."""
    passages, path = docs(spark, d).select(F.col("doc_id").alias("id"), "text", F.col("source").alias("title")), _folder(spark, "index")
    sinks.write_index(passages, path)
    return search_index.search(spark, path, _asked(spark, d), k=5).withColumn("score", F.round("score", 6))


_STREAMED = f"""
WITH RECURSIVE {_bands_sql(16, 8, 5, 1337)},
own AS (SELECT doc_id, band, key FROM bands UNION ALL SELECT doc_id, -1, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) FROM documents),
shared AS (SELECT * FROM own QUALIFY count(*) OVER (PARTITION BY band, key) > 1),
asked AS MATERIALIZED (SELECT doc_id, list(hash(band, key)) AS keys, row_number() OVER (ORDER BY coalesce(any_value(lang), ''), doc_id) AS i FROM shared JOIN documents USING (doc_id) GROUP BY doc_id),
fold(i, doc_id, met, near) AS (
  SELECT 0::BIGINT, NULL::BIGINT, []::UBIGINT[], false
  UNION ALL
  SELECT asked.i, asked.doc_id, CASE WHEN list_has_any(met, keys) THEN met ELSE list_concat(met, keys) END, list_has_any(met, keys) FROM fold JOIN asked ON asked.i = fold.i + 1
)
SELECT doc_id, md5(text) AS digest FROM documents LEFT JOIN fold USING (doc_id) WHERE NOT coalesce(near, false)
"""


@query("str_near_unique", _STREAMED)
def str_near_unique(spark: SparkSession, d: str) -> DataFrame:
    """Documents arrive one language after another; each batch keeps what is no copy, exact or near, of what was kept before."""
    rows, path = docs(spark, d).withColumn("lang", F.coalesce("lang", F.lit(""))), _folder(spark, "stream")
    for k, lang in enumerate(r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()):
        rows.where(F.col("lang") == lang).select("doc_id", "text").write.parquet(f"{path}/in/part={k}")
        arrived = spark.readStream.schema("doc_id bigint, text string").option("recursiveFileLookup", "true").parquet(f"{path}/in")
        streaming.near_unique(arrived, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("doc_id bigint, text string").parquet(f"{path}/out/batch=*/docs").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def _pattern_sql(name: str) -> str:
    """The pieces of a pattern in SQL, blank ones and leading spaces included."""
    return _WHOLE_PIECES.format(pattern=tokenizer.PATTERNS[name].replace(r"\s+(?!\S)|", "").replace("'", "''"))


@query("tok_pieces_whole", f"SELECT doc_id, {', '.join(f'md5(array_to_string({_pattern_sql(n)}, chr(2))) AS {n}' for n in tokenizer.PATTERNS)} FROM documents")
def tok_pieces_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every text, white space too, under all patterns."""
    digest = lambda n: F.md5(F.array_join(tokenizer.pieces(F.col("text"), n), "\x02").cast("binary")).alias(n)
    return docs(spark, d, "doc_id", "text").select("doc_id", *[digest(n) for n in tokenizer.PATTERNS])


@query(
    "tok_bpe_merges",
    f"""WITH RECURSIVE counts AS (SELECT piece, count(*) AS n FROM (SELECT unnest({_pattern_sql("french")}) AS piece FROM documents) GROUP BY piece),
start AS (
  SELECT array_to_string(list_transform(range(0, octet_length(encode(piece))), lambda i: chr(('0x' || substr(hex(encode(piece)), 2 * i + 1, 2))::INT + 1018)), '') AS s, n
  FROM counts WHERE octet_length(encode(piece)) > 1
),
r(k, s, n, p) AS (
  SELECT 0, s, n, NULL::VARCHAR FROM start
  UNION ALL
  SELECT k + 1, replace(s, best.p, chr(1274 + k)), n, best.p
  FROM r, (SELECT p FROM (SELECT unnest(list_transform(range(1, length(s)), lambda i: s[i:i + 1])) AS p, n FROM r) GROUP BY p ORDER BY sum(n) DESC, p LIMIT 1) AS best
  WHERE k < 60
)
SELECT DISTINCT k - 1 AS rank, unicode(p[1]) - 1000 AS a, unicode(p[2]) - 1000 AS b FROM r WHERE k > 0""",
)
def tok_bpe_merges(spark: SparkSession, d: str) -> DataFrame:
    """The first merges of a vocabulary trained on all documents, in order."""
    merges = tokenizer.train(tokenizer.frequencies(docs(spark, d, "text")), vocab_size=tokenizer.SPECIALS + 256 + 60)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, a int, b int")


@query(
    "tok_shards",
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, len({_WORDS}) AS n, coalesce(sum(len({_WORDS})) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents),
r(number, start) AS (SELECT 0, min(start) FROM d WHERE n > 0 UNION ALL SELECT number + 1, (SELECT min(d.start) FROM d WHERE d.n > 0 AND d.start >= r.start + 5000) FROM r WHERE r.start IS NOT NULL)
SELECT doc_id, d.start, coalesce((SELECT max(number) FROM r WHERE r.start <= d.start), 0)::INT AS shard FROM d""",
)
def tok_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards of a token store that each end with the document that fills them."""
    return tokens.in_shards(tokens.pack(_ids(spark, d)), 5000).select("doc_id", "start", "shard")


@query(
    "nov_existing",
    """WITH f AS (SELECT DISTINCT source, md5(text[1:400]) AS fp FROM documents WHERE text IS NOT NULL), mine AS (SELECT DISTINCT md5(text[1:400]) AS fp FROM documents WHERE text IS NOT NULL AND lang = 'en')
SELECT source AS artifact, round_even(count(mine.fp)::DOUBLE / (SELECT count(*) FROM mine), 4) AS overlap FROM f LEFT JOIN mine USING (fp) WHERE source IS NOT NULL GROUP BY source""",
)
def nov_existing(spark: SparkSession, d: str) -> DataFrame:
    """How much of the English documents each source's artifact has, told by the fingerprints beside it."""
    rows, root = docs(spark, d), _folder(spark, "artifacts")
    for source in [r[0] for r in rows.where("source is not null").select("source").distinct().collect()]:
        artifact = Artifact(spark, root, "corpora", source, {"source": source})
        novelty.remember(artifact, artifact.write("corpus", rows.where(F.col("source") == source)))
        artifact.commit()
    found = novelty.compare_to_existing(rows.where("lang = 'en'"), root)
    return found.select(F.regexp_replace("artifact", "-[0-9a-f]{8}$", "").alias("artifact"), "overlap")


@query(
    "mix_draw",
    rf"""{_PLANNED}, e AS (SELECT doc_id, source, floor(len({_WORDS}) * 1.45::DOUBLE)::BIGINT AS est FROM documents),
r AS (SELECT *, coalesce(sum(est) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(est) OVER (PARTITION BY source) AS total FROM e),
taken AS (SELECT * FROM (SELECT *, unnest(range(CASE WHEN total > 0 THEN ceil(take / total)::BIGINT ELSE 1 END)) AS k FROM r JOIN p USING (source)) WHERE before + k * total < take),
clocks AS (SELECT *, sum(-ln((('0x' || substr(md5('7:' || source || ':' || k || ':' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (take - before - k * total)::DOUBLE) OVER (PARTITION BY source ORDER BY k, doc_id) AS position FROM taken)
SELECT doc_id, source, k AS pass_no, row_number() OVER (ORDER BY position) AS place FROM clocks""",
)
def mix_draw(spark: SparkSession, d: str) -> DataFrame:
    """The planned corpus in the order of drawing its sources by the budgets that are left."""
    taken = mixture.assemble(docs(spark, d, "doc_id", "text", "source"), _plan(spark, d), seed=7, drawn=True)
    one = taken.select("doc_id", "source", "pass_no", "position").withColumn("all", F.lit(0)).withColumn("n", F.lit(1))
    return mixture.running(one, ["all"], ["position"], "n", "before").select("doc_id", "source", "pass_no", (F.col("before") + 1).alias("place"))


@query(
    "evl_kneser_ney",
    f"""WITH t AS (SELECT source, {_pattern_sql("french")} AS t FROM documents), p AS (SELECT source, unnest(t[1:len(t) - 1]) AS prev, unnest(t[2:]) AS tok FROM t WHERE len(t) > 1),
c AS (SELECT prev, tok, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT prev, sum(n) AS m, count(*) AS kinds FROM c GROUP BY prev), f AS (SELECT tok, count(*) AS follows FROM c GROUP BY tok),
l AS (SELECT prev, tok, -ln((n - 0.75::DOUBLE) / m + 0.75::DOUBLE * kinds / m * follows / (SELECT count(*) FROM c)) AS loss FROM c JOIN b USING (prev) JOIN f USING (tok))
SELECT source, count(*) AS n_tokens, round(sum(loss) / count(*), 6) AS loss FROM p JOIN l USING (prev, tok) GROUP BY ROLLUP (source)""",
)
def evl_kneser_ney(spark: SparkSession, d: str) -> DataFrame:
    """Loss of the pieces of all texts under a Kneser-Ney model of the corpus, by source and overall."""
    pairs = evaluation.token_pairs(docs(spark, d, "text", "source"), tokenizer.pieces(F.coalesce("text", F.lit(""))), "source")
    lost = evaluation.kneser_ney_losses(pairs, "source").withColumn("n_chars", F.lit(0)).withColumn("n_documents", F.lit(0))
    return evaluation.scores(lost, "source").select("source", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.round("loss", 6).alias("loss"))
