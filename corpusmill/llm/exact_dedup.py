"""Exact deduplication as a stateful stream: disk-backed keyed state without expiry, full bytes checked on hits. JVM-side only."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import ascii_lower, body, located, new_path, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of 32-byte digests or of two-number locators that may be broadcast: 100 bytes each in a hash table, so 50 MB; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


@contextmanager
def _state_settings(spark: SparkSession):
    """State on disk with bounded native memory; the session's own settings come back afterwards."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # many stores with little in each: room is taken as it is needed
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def normalised(text: str | Column = "text") -> Column:
    """What equality is judged on: null as empty, A-Z lower-cased, nothing else."""
    return ascii_lower(body(text))


def update_state(spark: SparkSession, spool: str, state: str, max_bytes: int = 1 << 30) -> None:
    """Streams digest records that ``spool`` has gained since the last call into the state at ``state``.

    Micro-batches of ``max_bytes`` are summed per task before the shuffle, so a digest that holds a
    third of all rows arrives as one row from each task. There is no watermark: state never expires.
    """
    schema = spark.read.parquet(spool).schema
    records = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(spool)
    groups = records.groupBy("digest").agg(F.max(F.struct("doc_id", "f", "r")).alias("keep"), F.count(F.lit(1)).alias("n"))
    with _state_settings(spark):
        query = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The state as a table: digest, keep (doc_id and locator of the row that stays), n."""
    with _state_settings(spark):
        rows = spark.read.format("statestore").load(state)
        keep, n = rows.schema["value"].dataType.names
        return written(rows.select("key.digest", F.col(f"value.{keep}").alias("keep"), F.col(f"value.{n}").alias("n")), "state")


def _small(rows: DataFrame, n: int) -> DataFrame:
    """Marks a side of checked size for broadcast; a larger one is shuffled."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def group_located(rows: DataFrame, digest_bytes: int = 32, max_bytes: int = 1 << 30) -> DataFrame:
    """Every row of ``located`` documents (f, r, doc_id, text) with its locator, text_sha256 and the group of equal texts: keep (doc_id, f, r) and n.

    Digests and locators are spooled, streamed through the state, and every text whose digest hit
    is compared in full with the others of that digest: least and greatest text per digest, found
    per task before the shuffle, differ if and only if the digest lied. Such digests are regrouped
    by text. Texts that hit nothing are never shuffled while the hits are few enough to broadcast.
    """
    spark = rows.sparkSession
    key = lambda sha: F.substring(sha, 1, digest_bytes)
    spool = new_path(spark, "digests")
    sha = F.unhex(F.sha2(F.encode(normalised(), "UTF-8"), 256))
    rows.select("doc_id", sha.alias("sha"), "f", "r").withColumn("digest", key(F.col("sha"))).write.parquet(spool)
    state_path = new_path(spark, "dedup-state")
    update_state(spark, spool, state_path, max_bytes)
    state = read_state(spark, state_path)
    records = spark.read.parquet(spool)
    hits = state.filter("n > 1").select("digest")
    texts = rows.select(normalised().alias("norm"), "doc_id", "f", "r").withColumn("digest", key(F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256))))
    hit_texts = texts.join(_small(hits, hits.count()), "digest")
    lied = written(hit_texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select("digest"), "collisions")
    n_lied = lied.count()
    grouped = records.join(state, "digest")
    if n_lied:
        doubtful = texts.join(_small(lied, n_lied), "digest")
        exact = doubtful.groupBy("norm").agg(F.max(F.struct("doc_id", "f", "r")).alias("keep"), F.count(F.lit(1)).alias("n"))
        regrouped = doubtful.join(exact, "norm").select("f", "r", "keep", "n")
        sure = grouped.join(lied, "digest", "left_anti")
        grouped = sure.unionByName(records.join(lied, "digest", "left_semi").join(regrouped, ["f", "r"]))
    return grouped.select("doc_id", "f", "r", "keep", "n", F.lower(F.hex("sha")).alias("text_sha256"))


def _stays() -> Column:
    return (F.col("f") == F.col("keep.f")) & (F.col("r") == F.col("keep.r"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Whole ``located`` rows, unpacked, but for those at the locators of ``gone``."""
    gone = written(gone.select("f", "r"), "gone")
    return rows.join(_small(gone, gone.count()), ["f", "r"], "left_anti").select("row.*")


def dedup_report(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: of equal texts the row with the largest doc_id stays.

    Null doc_ids are smallest; of rows that repeat a doc_id and text the last by locator stays, and
    exactly one of a group is kept. Null text equals empty text. A very long text is hashed in
    place and compared whole. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    rows = located(docs.select("doc_id", "text"), ["doc_id", "text"])
    return group_located(rows, **settings).select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), _stays().alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **settings) -> DataFrame:
    """The documents without the copies that go, all columns kept, whatever their names.

    Nulls, empty and repeated rows are as in ``dedup_report``: one row of each group of equal texts
    stays as it was. An empty table stays empty.
    """
    rows = located(docs)
    return without(rows, group_located(rows.select("f", "r", "row.doc_id", "row.text"), **settings).filter(~_stays()))


DEDUP_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
