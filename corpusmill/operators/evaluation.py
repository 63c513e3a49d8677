"""Retrieval quality over ranked hits and relevance labels, for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_metrics(hits: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, precision, mrr, ndcg) of ``hits`` (query_id, chunk_id, rank) against ``labels`` (query_id, chunk_id).

    Queries without labels are left out; precision divides by k; the reciprocal rank looks at the whole list.
    """
    wanted = labels.select("query_id", "chunk_id").distinct()
    need = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return _metrics(need, hits.join(wanted, ["query_id", "chunk_id"], "left_semi"), k)


def label_metrics(hits: DataFrame, asked: DataFrame, labelled: DataFrame, k: int = 10) -> DataFrame:
    """``query_metrics`` where the chunks of a query's label are the relevant ones: ``asked`` (query_id, label), ``labelled`` (chunk_id, label).

    A chunk and a query have one label each. Labels are counted and hits looked up, so pairs of a query and a relevant chunk are never formed.
    """
    asked, labelled = asked.select("query_id", "label").distinct(), labelled.select("chunk_id", "label").distinct()
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    right = hits.join(asked, "query_id").join(labelled, ["chunk_id", "label"], "left_semi")
    return _metrics(asked.join(sizes, "label").select("query_id", "n"), right, k)


def _metrics(need: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The metrics from how many chunks each query needs (query_id, n) and its relevant hits (query_id, rank)."""
    close = F.col("rank") <= k
    found = right.groupBy("query_id").agg(
        F.sum(F.when(close, 1).otherwise(0)).alias("hit"),
        F.min("rank").alias("first"),
        F.sum(F.when(close, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    hit = F.coalesce("hit", F.lit(0))
    return need.join(found, "query_id", "left").select(
        "query_id",
        F.round(hit / F.col("n"), 6).alias("recall"),
        F.round(hit / F.lit(float(k)), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("gain") / ideal, F.lit(0.0)), 6).alias("ndcg"),
    )


def gate(before: float, now: float, tolerance: float = 0.02) -> bool:
    """Whether recall at 10 fell by no more than the tolerance."""
    return before - now <= tolerance


def resolved_labels(golden: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels that exist (query_id, chunk_id), and per query what was dropped: (query_id, n_labels, n_stale, skipped).

    ``golden`` has id and relevant. A query without labels, or whose labels are all gone, is skipped.
    """
    labels = golden.select(F.col("id").alias("query_id"), F.explode_outer("relevant").alias("chunk_id")).distinct()
    known = chunks.select("chunk_id").distinct().withColumn("_known", F.lit(True))
    marked = labels.join(known, "chunk_id", "left")
    counts = marked.groupBy("query_id").agg(F.count("chunk_id").alias("n_labels"), F.count(F.when(F.col("chunk_id").isNotNull() & F.col("_known").isNull(), 1)).alias("n_stale"))
    return marked.filter("_known").select("query_id", "chunk_id"), counts.withColumn("skipped", F.col("n_labels") == F.col("n_stale"))


def evaluate_run(hits: DataFrame, golden: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """One row: n_queries, n_scored, n_skipped, n_stale and the means of recall, precision, mrr and ndcg over scored queries."""
    labels, counts = resolved_labels(golden, chunks)
    scored = query_metrics(hits, labels, k)
    means = scored.agg(F.count(F.lit(1)).alias("n_scored"), *(F.round(F.avg(m), 6).alias(m) for m in ("recall", "precision", "mrr", "ndcg")))
    totals = counts.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum(F.col("skipped").cast("long")), F.lit(0)).alias("n_skipped"), F.coalesce(F.sum("n_stale"), F.lit(0)).alias("n_stale"))
    return totals.crossJoin(F.broadcast(means))  # one row by one row


def benchmark_golden(qrels: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, relevant): the chunks of every judged document of a query, whatever the grade. ``chunks`` has chunk_id and the benchmark's doc_id."""
    met = qrels.select("query_id", "doc_id").distinct().join(chunks.select("chunk_id", "doc_id"), "doc_id")
    return met.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant"))


def label_sheet(chunks: DataFrame, documents: DataFrame, n: int = 80) -> DataFrame:
    """What a person who writes labels needs: (chunk_id, file_path, preview of the first line)."""
    from corpusmill.functions.text import preview

    first = F.substring_index(F.trim("content"), "\n", 1)
    return chunks.join(documents.select("document_id", "file_path"), "document_id").select("chunk_id", "file_path", preview(first, n).alias("preview"))
