"""Every query over the tables with the SQL that gives the same rows. A document stands for a chunk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import scoring, text
from corpusmill.operators import evaluation, maintenance, retrieval
from corpusmill.sources.shared import spread, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
PATH = "concat(source, '/', CAST(doc_id AS VARCHAR), '.txt')"
#: CTEs of the oracle: a document's terms, its length, the statistics and the BM25 score of each benchmark query.
TERMS = rf"""terms AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{Nd}}]+'), lambda x: x NOT IN ({STOP}))) AS term FROM documents),
postings AS (SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY ALL),
dl AS (SELECT doc_id, count(*) AS dl FROM terms GROUP BY doc_id),
stats AS (SELECT count(*) AS n, sum(dl) AS total FROM dl)"""
BM25 = rf"""{TERMS},
qt AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+'), lambda x: x NOT IN ({STOP}))) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS weight FROM qt GROUP BY ALL),
vocabulary AS (SELECT DISTINCT term AS word FROM postings),
words AS (SELECT term, term AS word FROM (SELECT DISTINCT term FROM q) UNION ALL
  SELECT term, word FROM (SELECT DISTINCT term FROM q WHERE strlen(term) < 4 AND term NOT IN (SELECT word FROM vocabulary)) JOIN vocabulary ON starts_with(word, term)),
found AS (SELECT words.term, doc_id, sum(tf) AS tf FROM words JOIN postings ON postings.term = words.word GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM found GROUP BY term),
scored AS (SELECT item_id, doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))), 9) AS score
  FROM q JOIN found USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored),
hits AS (SELECT * FROM ranked WHERE rank <= 60)"""
KNN = """q AS (SELECT vec_id AS query_id, label AS wanted, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, wanted, vec_id AS chunk_id, label, round(list_cosine_similarity(v, embedding::DOUBLE[]), 9) AS score FROM q, embeddings WHERE len(v) = len(embedding)),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 60)"""
NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL where there is one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("file_path", path)


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return _vectors(spark, sf_dir).filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


@query("SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS content_hash, count(*) AS n FROM documents GROUP BY 2")
def content_dedup(spark, sf_dir):
    keyed = content_hash(spark, sf_dir)
    return keyed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {TERMS} SELECT term, doc_id, tf FROM postings")
def postings_build(spark, sf_dir):
    return retrieval.postings(_documents(spark, sf_dir), chunk_id="doc_id").withColumnRenamed("chunk_id", "doc_id")


@query(f"WITH {TERMS} SELECT n AS n_chunks, CAST(coalesce(total, 0) AS BIGINT) AS total_len FROM stats")
def corpus_stats(spark, sf_dir):
    return retrieval.corpus_stats(retrieval.lengths(_documents(spark, sf_dir), chunk_id="doc_id"))


def _index(chunks: DataFrame) -> retrieval.TextIndex:
    """The index of chunks, written once and read by what follows."""
    return retrieval.build_index(chunks, lambda name, rows: written(rows, name))


def _bm25_hits(spark, sf_dir):
    chunks = _documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.bm25(_benchmark(spark, sf_dir), _index(chunks))


@query(f"WITH {BM25} SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM hits")
def bm25_batch(spark, sf_dir):
    return _bm25_hits(spark, sf_dir).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {BM25}, best AS (SELECT item_id, source, doc_id, score, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS n FROM hits JOIN documents USING (doc_id)),
cut AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM best WHERE n = 1)
SELECT item_id, source, doc_id, round(share, 6) AS score FROM (SELECT *, score / max(score) OVER (PARTITION BY item_id) AS share FROM cut WHERE r <= 5) WHERE share >= 0.5""")
def collapse_normalise_threshold(spark, sf_dir):
    hits = _bm25_hits(spark, sf_dir).join(_documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    kept = retrieval.threshold(retrieval.normalise_scores(retrieval.collapse_by_document(hits, 5, "source")), 0.5)
    return kept.select(F.col("query_id").alias("item_id"), "source", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {KNN} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM hits")
def knn_batch(spark, sf_dir):
    hits = retrieval.knn(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {KNN}, other AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank FROM hits),
parts AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS part FROM hits UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) FROM other)
SELECT query_id, chunk_id, round(sum(part), 6) AS score FROM parts GROUP BY ALL""")
def rrf_fusion(spark, sf_dir):
    hits = retrieval.knn(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir))
    reversed_order = retrieval.rerank_ranks(hits.withColumn("score", -F.col("score")))
    return retrieval.rrf([hits, reversed_order]).withColumn("score", F.round("score", 6))


@query(f"""WITH {KNN}, need AS (SELECT query_id, count(*) AS n FROM q JOIN embeddings e ON e.label = q.wanted GROUP BY 1),
found AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS hit, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS gain FROM hits WHERE label = wanted GROUP BY 1)
SELECT query_id, round(coalesce(hit, 0) / n, 6) AS recall, round(coalesce(hit, 0) / 10.0::DOUBLE, 6) AS precision, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
round(coalesce(gain / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM need LEFT JOIN found USING (query_id)""")
def eval_metrics(spark, sf_dir):
    asked, vectors = _vector_queries(spark, sf_dir), _vectors(spark, sf_dir)
    return evaluation.label_metrics(retrieval.knn(asked, vectors), asked, vectors)


@query("SELECT doc_id FROM documents WHERE source LIKE 's%' AND lang = 'en'")
def filter_source_tags(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumns({"file_type": F.lit("Text"), "tags": F.array("lang")})
    return docs.filter(retrieval.matches_filter(source="s", kind="text", tags=("en",))).select("doc_id")


@query(f"""WITH w AS (SELECT doc_id, {NORM} AS norm, list_filter(string_split({NORM}, ' '), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS t FROM w) WHERE strlen(t) > 3 GROUP BY ALL) GROUP BY doc_id),
p AS (SELECT doc_id, CASE WHEN {" OR ".join(f"contains(norm, '{p}')" for p in scoring.PHRASES)} THEN 1.0::DOUBLE ELSE 0 END AS i,
 CASE WHEN len(ws) < 6 THEN 0 ELSE least(1.0::DOUBLE, 2.0::DOUBLE * (len(ws) - len(list_distinct(ws))) / len(ws)) END AS r,
 CASE WHEN len(ws) < 6 OR coalesce(most, 0) < 2 THEN 0 ELSE least(1.0::DOUBLE, (most - 1) / 5.0::DOUBLE) END AS s FROM w LEFT JOIN c USING (doc_id)),
t AS (SELECT doc_id, least(1.0::DOUBLE, 0.5::DOUBLE * i + 0.25::DOUBLE * r + 0.25::DOUBLE * s) AS score FROM p)
SELECT doc_id, round(score, 6) AS score, CASE WHEN score >= 0.7::DOUBLE THEN 'quarantine' WHEN score >= 0.4::DOUBLE THEN 'suspicious' ELSE 'clean' END AS level FROM t""")
def poison_score(spark, sf_dir):
    return scoring.poison_scores(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.round("score", 6).alias("score"), "level")


@query(f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split({NORM}, ' '), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 16))::UBIGINT AS h, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) AS s FROM c, (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY ALL),
f AS (SELECT doc_id, CAST(sum(CASE WHEN s > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << i::HUGEINT END ELSE 0 END) AS BIGINT) AS fingerprint FROM v GROUP BY doc_id)
SELECT doc_id, fingerprint FROM documents LEFT JOIN f USING (doc_id)""")
def simhash_fingerprint(spark, sf_dir):
    return scoring.simhash(_documents(spark, sf_dir), "doc_id")


@query(f"""WITH d AS (SELECT {PATH} AS file_path, sha256(text) AS now FROM documents WHERE lang <> 'de'),
s AS (SELECT {PATH} AS file_path, sha256(CASE WHEN lang = 'fr' THEN upper(lang) ELSE text END) AS was FROM documents WHERE lang <> 'es')
SELECT file_path, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'deleted' WHEN now = was THEN 'unchanged' ELSE 'modified' END AS status FROM d FULL JOIN s USING (file_path)""")
def scan_diff(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    disk = docs.filter("lang <> 'de'").select("file_path", text.content_hash(F.col("text")).alias("content_hash"))
    was = F.when(F.col("lang") == "fr", F.upper("lang")).otherwise(F.col("text"))
    return maintenance.scan_diff(disk, docs.filter("lang <> 'es'").select("file_path", text.content_hash(was).alias("content_hash")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_embeddings(spark, sf_dir):
    chunks = _documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"))
    return maintenance.pending(chunks, _vectors(spark, sf_dir)).withColumnRenamed("chunk_id", "doc_id")


@query("SELECT '' AS model, '' AS convention, CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n FROM embeddings GROUP BY 3")
def embedding_profile(spark, sf_dir):
    return maintenance.embedding_profile(_vectors(spark, sf_dir))


@query(f"SELECT doc_id, CAST(ceil(len(list_filter(string_split({NORM}, ' '), lambda x: x <> '')) * 1.3::DOUBLE) AS INTEGER) AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.token_estimate(F.coalesce("text", F.lit(""))).alias("n_tokens"))


@query(f"""WITH {BM25}, cut AS (SELECT item_id, doc_id, score, rank FROM hits WHERE rank <= 5)
SELECT item_id AS query_id, doc_id AS chunk_id, doc_id AS document_id, round(CASE WHEN best > 0 THEN score / best ELSE score END, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM cut)""")
def keyword_retrieve(spark, sf_dir):
    """The flagship: the benchmark's passages against all documents, filter to threshold."""
    docs = _documents(spark, sf_dir)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text", "file_path")
    hits = retrieval.retrieve(_benchmark(spark, sf_dir), chunks, None, None, retrieval.Request(mode="keyword"), index=_index(chunks))
    return hits.select("query_id", "chunk_id", "document_id", "score", F.col("rank").cast("int").alias("rank"))
