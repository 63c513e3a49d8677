"""The text index of a vault: segments of postings that are added and merged by size, tombstones for what was deleted, statistics that add up over both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import BODY, Fields, TextIndex, corpus_stats, counted_terms, term_frequencies
from corpusmill.sources.shared import written
from corpusmill.sources.vault import Change, Vault

#: Share of the indexed chunks that tombstones may come to before the segments that hold dead postings are written anew.
PURGE = 0.2
#: Chunks, with all their terms, that a file of a merged segment holds.
CHUNKS_A_FILE = 20_000


def _count(change: Change, postings: DataFrame, sign: int) -> None:
    """Adds a segment's terms to the vocabulary and its chunks to the statistics, or takes them off."""
    n, total = corpus_stats(postings.filter("dl > 0")).first()
    change.append("vocabulary", term_frequencies(postings).withColumn("df", sign * F.col("df")))
    was = change.facts.get("text", [0, 0])
    change.put("text", [was[0] + sign * n, was[1] + sign * total])


def add(change: Change, chunks: DataFrame, fields: Fields = BODY) -> None:
    """Indexes new chunks (chunk_id and the fields) as one more segment; nothing else is written."""
    born = counted_terms(chunks, fields).withColumn("born", F.lit(change.version))
    _count(change, change.append("postings", born), 1)


def remove(change: Change, chunks: DataFrame, fields: Fields = BODY) -> None:
    """Takes chunks (chunk_id and the fields as they were indexed) off the index: a tombstone each, and their terms off the counts.

    A tombstone hides the postings that are older than it, so a chunk that comes back later is found.
    """
    if not change.rows("postings"):
        return
    _count(change, written(counted_terms(chunks, fields), "leaving"), -1)
    change.append("tombstones", chunks.select("chunk_id", F.lit(change.version).alias("died")))
    if change.rows("tombstones") > PURGE * max(1, change.facts["text"][0]):
        purge(change)


def _dead(postings: DataFrame, tombstones: DataFrame, how: str) -> DataFrame:
    gone = tombstones.groupBy("chunk_id").agg(F.max("died").alias("died")).withColumnRenamed("chunk_id", "gone")
    return postings.join(gone, (postings["chunk_id"] == gone["gone"]) & (postings["born"] < gone["died"]), how)


def purge(change: Change) -> None:
    """Writes the segments that hold dead postings without them, and drops the tombstones."""
    stones, postings = change.read("tombstones"), change.read("postings")
    dead = _dead(postings, stones, "left_semi").select("chunk_id", "born").distinct()
    change.delete("postings", ["chunk_id", "born"], dead)
    change.replace("tombstones", stones.limit(0))


def compact(change: Change) -> None:
    """Merges segments of about one size."""
    change.compact("postings", rows_a_file=CHUNKS_A_FILE)
    change.compact("vocabulary", lambda rows: rows.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0"))
    change.compact("tombstones")


def open_index(vault: Vault) -> TextIndex | None:
    """The index as of the vault's version; None before anything was indexed."""
    found = vault.at().manifest()
    if "postings" not in found.tables:
        return None
    table = lambda name: vault.frame(found.tables[name])
    postings = table("postings")
    if "tombstones" in found.tables and found.tables["tombstones"].rows:
        postings = _dead(postings, table("tombstones"), "left_anti")
    stats = vault.spark.createDataFrame([tuple(found.facts["text"])], "n_chunks long, total_len long")
    return TextIndex(postings.drop("born"), table("vocabulary"), stats)
