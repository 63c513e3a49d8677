"""Streaming ingest: new files and rows become chunks, verdicts, fingerprints and index segments, one version of the vault a batch; vectors follow by way of the queue."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, TypeVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions import chunking, embedding, redaction, scoring
from corpusmill.functions.text import document_identity, token_estimate
from corpusmill.operators import enrichment, maintenance, retrieval, segments
from corpusmill.sources import files, readers
from corpusmill.sources.files import OWN_FOLDER
from corpusmill.sources.shared import written
from corpusmill.sources.vault import Change, ConflictError, Vault
from corpusmill.streaming import queue

if TYPE_CHECKING:
    from corpusmill.protocols import Captioner, Detector, Enricher

T = TypeVar("T")


class CircuitOpenError(RuntimeError):
    """The embedder failed too often; it is asked again after a while."""


@dataclass
class CircuitBreaker:
    """Lets calls through until ``failures`` in a row fail, then none for ``wait`` seconds, then one; its outcome decides."""

    failures: int = 5
    wait: float = 30.0
    clock: Callable[[], float] = time.monotonic
    _count: int = 0
    _opened: float | None = None
    _probing: bool = False

    def call(self, f: Callable, *args):
        if self._opened is not None:
            if self._probing or self.clock() - self._opened < self.wait:
                raise CircuitOpenError("the embedder is not asked for now")
            self._probing = True
        try:
            out = f(*args)
        except Exception:
            self._count += 1
            if self._probing or self._count >= self.failures:
                self._opened, self._count = self.clock(), 0
            self._probing = False
            raise
        self._count, self._opened, self._probing = 0, None, False
        return out


@dataclass
class GuardedEmbedder:
    """An embedder behind a breaker; each worker has its own."""

    inner: embedding.Embedder
    breaker: CircuitBreaker = field(default_factory=CircuitBreaker)

    @property
    def model(self) -> str:
        return self.inner.model

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        return self.breaker.call(self.inner.embed, texts)


def documents_of(parsed: DataFrame) -> DataFrame:
    """Parsed files with their identity; files that weren't read are left out."""
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return parsed.filter("status = 'ok'").withColumn("metadata", meta).withColumn("document_id", document_identity(F.col("text"), F.col("mime"), F.col("metadata")))


def chunks_of(documents: DataFrame, splitter: chunking.Splitter | None = None, redacting: bool = False, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Chunks with identity, links, breadcrumb, page and verdict. Redaction comes before splitting and moves the headings along."""
    rows = redaction.redact(documents) if redacting else documents
    chunks = chunking.linked(chunking.identified(chunking.chunk_documents(rows, splitter)))
    if "page_offsets" in documents.columns:
        chunks = chunks.join(documents.select("document_id", "page_offsets"), "document_id").withColumn("page_number", chunking.page_of(F.col("start_char_idx"), F.coalesce("page_offsets", F.array().cast("array<int>")))).drop("page_offsets")
    return judge(chunks) if judge is not None else scoring.poison_scores(chunks, "content")


@dataclass(frozen=True)
class Settings:
    """How files become rows of a vault."""

    embedder: embedding.Embedder | None = None
    prefixer: embedding.Prefixer | None = None
    splitter: chunking.Splitter | None = None
    redacting: bool = False
    phrases: tuple[str, ...] = scoring.PHRASES
    suspicious: float = scoring.SUSPICIOUS
    quarantine: float = scoring.QUARANTINE
    fields: retrieval.Fields = retrieval.BODY
    enricher: Enricher | None = None
    captioner: Captioner | None = None
    detector: Detector | None = None

    def judge(self, chunks: DataFrame) -> DataFrame:
        """Chunks with their verdicts: by the detector that was put in, else by phrases and repetition."""
        return self.detector.detect(chunks, "content") if self.detector is not None else scoring.poison_scores(chunks, "content", self.phrases, self.suspicious, self.quarantine)


def field_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, title, heading, text): what the index has of a chunk, of its document's title and of the headings above it."""
    title = F.col("title") if "title" in documents.columns else F.lit(None).cast("string").alias("title")
    heading = F.array_join("section_context", " ") if "section_context" in chunks.columns else F.lit(None).cast("string")
    said = chunks.select("chunk_id", "document_id", heading.alias("heading"), F.col("content").alias("text"))
    return said.join(documents.select("document_id", title), "document_id", "left").drop("document_id")


def _indexed(chunks: DataFrame, documents: DataFrame, fields: retrieval.Fields) -> DataFrame:
    return chunks.select("chunk_id", F.col("content").alias("text")) if fields == retrieval.BODY else field_rows(chunks, documents)


def _follow_up(change: Change, chunks: DataFrame, documents: DataFrame, settings: Settings) -> None:
    """What new chunks bring with them: fingerprints, a segment of the index, a place in the queue."""
    keyed = chunks.select(F.struct("chunk_id", "token_count").alias("k"), "content")
    change.append("fingerprints", scoring.simhash(keyed, "k", "content").select("k.chunk_id", "k.token_count", "fingerprint"))
    segments.add(change, _indexed(chunks, documents, settings.fields), settings.fields)
    if settings.embedder is not None:
        queue.enqueue(change, chunks, settings.embedder.model)
    for table in ("documents", "chunks", "fingerprints", "images"):
        change.compact(table)
    segments.compact(change)


def enrich(change: Change, settings: Settings) -> dict[str, int]:
    """Tags, summaries and captions that are missing: by document and model, by image digest and model. Run again it does what failed, and nothing twice.

    A caption becomes a chunk of its own, which is indexed and embedded like others.
    """
    counts = {"captions": 0, "enriched": 0, "failed": 0}
    images, chunks = change.read("images"), change.read("chunks")
    if settings.captioner is not None and images is not None:
        known = change.read("captions")
        new = enrichment.captions_of(images, settings.captioner, known)
        change.append("captions", new)
        kind = chunks.filter("kind = 'caption'") if "kind" in chunks.columns else chunks.limit(0)
        bare = images.join(kind.select("document_id"), "document_id", "left_anti")
        said = change.read("captions").filter(F.col("model") == settings.captioner.model)
        made = enrichment.caption_chunks(bare, chunks, said).withColumn("token_count", token_estimate(F.col("content")))
        made = written(settings.judge(made), "captioned")
        counts["captions"] = made.count()
        if counts["captions"]:
            added, documents = change.append("chunks", made), change.read("documents")
            _follow_up(change, added, documents, settings)
            more = documents.join(added.select("document_id"), "document_id", "left_semi").withColumn("chunk_count", F.col("chunk_count") + 1)
            change.merge("documents", "document_id", more)
            chunks = change.read("chunks")
    if settings.enricher is not None and chunks is not None:
        have = change.read("enrichments")
        if have is not None:
            done = have.filter((F.col("enrichment.status") != "failed") & (F.col("enrichment.model") == settings.enricher.model))
            chunks = chunks.join(done.select("document_id"), "document_id", "left_anti")
        made = written(enrichment.enrich(chunks, settings.enricher), "enriched")
        for r in made.groupBy("enrichment.status").agg(F.count(F.lit(1)).alias("n")).collect():
            counts["failed" if r["status"] == "failed" else "enriched"] += r["n"]
        if have is None:
            change.append("enrichments", made)
        else:
            change.merge("enrichments", "document_id", made)
            change.compact("enrichments")
    return counts


def _after(vault: Vault, settings: Settings) -> None:
    """The stages that follow a version with new files, each idempotent and a version of its own."""
    if settings.enricher is not None or settings.captioner is not None:
        committed(vault, lambda change: enrich(change, settings))
    if settings.embedder is not None:
        queue.drain(vault, settings.embedder, settings.prefixer)


def take(change: Change, files: DataFrame, settings: Settings) -> dict[str, int]:
    """Adds a batch of files (path, content) to a change: counts of new, skipped, unsupported and failed files. Content that is stored already is skipped."""
    parsed = written(readers.parse_files(files), "parsed")
    counts = {r["status"]: r["n"] for r in parsed.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    fresh, have = documents_of(parsed), change.read("documents")
    fresh = written(maintenance.new_content(fresh, fresh.limit(0) if have is None else have), "fresh")
    new = fresh.count()
    if new:
        made = chunks_of(fresh, settings.splitter, settings.redacting, settings.judge)
        chunks = change.append("chunks", made)
        sizes = chunks.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        stored = fresh.drop("images", "error").join(sizes, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
        documents = change.append("documents", stored)
        change.append("images", enrichment.images_of(fresh))
        _follow_up(change, chunks, documents, settings)
    return {"new": new, "skipped": counts.get("ok", 0) - new, "unsupported": counts.get("unsupported", 0), "errors": counts.get("error", 0)}


def drop(change: Change, gone: DataFrame, settings: Settings) -> int:
    """Takes documents (document_id) out of all tables and off the index; returns how many."""
    documents, chunks = change.read("documents"), change.read("chunks")
    if documents is None:
        return 0
    lost = written(documents.join(gone.select("document_id").distinct(), "document_id", "left_semi"), "lost")
    n = lost.count()
    if n:
        said = written(chunks.join(lost.select("document_id"), "document_id", "left_semi"), "lost-chunks")
        segments.remove(change, _indexed(said, lost, settings.fields), settings.fields)
        have = change.read("embeddings")
        if have is not None:
            queue.count_profile(change, have.join(said.select("chunk_id"), "chunk_id", "left_semi"), -1)
        for table in ("embeddings", "fingerprints", "queue"):
            change.delete(table, "chunk_id", said)
        for table in ("chunks", "images", "enrichments", "documents"):
            change.delete(table, "document_id", lost)
    return n


def committed(vault: Vault, make: Callable[[Change], T], tries: int = 5) -> T:
    """One change, made anew on what another writer left when that was first."""
    for left in reversed(range(tries)):
        try:
            with vault.change() as change:
                out = make(change)
            return out
        except ConflictError:
            if not left:
                raise
    raise ValueError("at least one try is needed")


def ingest_batch(vault: Vault, files: DataFrame, settings: Settings | None = None) -> dict[str, int]:
    """Takes a batch of files (path, content) into a vault as one version, then embeds what waits for it.

    A batch that is run again after a failure finds what it had stored, and skips it.
    """
    settings = settings or Settings()
    counts = committed(vault, lambda change: take(change, files, settings))
    _after(vault, settings)
    return counts


def watch(spark: SparkSession, root: str, vault: Vault, checkpoint: str, interval: str | None = None, settings: Settings | None = None) -> StreamingQuery:
    """Takes files into a vault as they appear under ``root``, every ``interval`` or, without one, once for all that are there.

    A file source doesn't see changes and deletions; ``follow`` does.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(~F.col("path").contains(f"/{OWN_FOLDER}/"))

    def batch(rows: DataFrame, _: int) -> None:
        ingest_batch(vault, rows.select("path", "content"), settings)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


LISTING = "path string, modified timestamp, length long, content_hash string"


def scan_once(vault: Vault, root: str, glob: str = "*", settings: Settings | None = None, settle: float = 0.0) -> dict[str, int]:
    """Holds the files under ``root`` against the last listing; what is new, modified or gone becomes one version.

    The listing is a table of the vault, so a restart goes on from it. Only files whose time or length changed are read; those
    whose content is as before are only listed anew. A file that changed less than ``settle`` seconds ago waits for a later scan.
    """
    settings = settings or Settings()
    spark = vault.spark
    fs, at = vault._fs(root)
    below = fs.makeQualified(at).toString().rstrip("/") + "/"
    present = written(files.walk(spark, root, glob).select("path", F.col("modificationTime").alias("modified"), "length"), "listing")
    seen = present.filter(F.col("modified") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(settle)))) if settle else present

    def make(change: Change) -> dict[str, int]:
        listed, documents = change.read("listing"), change.read("documents")
        listed = spark.createDataFrame([], LISTING) if listed is None else listed
        was = listed.filter(F.col("path").startswith(below))
        if documents is not None:
            # what came in by other ways was never listed
            taken = documents.filter(F.col("file_path").startswith(below)).select(F.col("file_path").alias("path"), F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("long").alias("length"), "content_hash")
            was = was.unionByName(taken.join(was.select("path"), "path", "left_anti"))
        was = written(was, "was")
        touched = seen.join(was, ["path", "modified", "length"], "left_anti").select("path", "modified", "length")
        content = files.walk(spark, root, glob).select("path", "content").join(touched.select("path"), "path", "left_semi")
        hashed = content.select("path", F.sha2("content", 256).alias("content_hash")).join(touched, "path")
        status = F.when(F.col("before").isNull(), "new").when(F.col("before") == F.col("content_hash"), "same").otherwise("modified")
        found = written(hashed.join(was.select("path", F.col("content_hash").alias("before")), "path", "left").withColumn("status", status), "found")
        gone = written(was.join(present.select("path"), "path", "left_anti").select("path"), "gone")
        counts = {r["status"]: r["n"] for r in found.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        deleted = gone.count()
        if not counts and not deleted:
            return {"new": 0, "skipped": 0, "unsupported": 0, "errors": 0, "modified": 0, "deleted": 0}
        paths = written(gone.unionByName(found.filter("status = 'modified'").select("path")), "replaced")
        wanted = found.filter("status IN ('new', 'modified')").select("path")
        if documents is not None and deleted + counts.get("modified", 0):
            lost = written(documents.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("document_id", "content_hash"), "lost")
            drop(change, lost, settings)
            # another file with what went was skipped as its copy, and brings it in again
            copies = was.join(paths, "path", "left_anti").join(lost.select("content_hash").distinct(), "content_hash", "left_semi").select("path")
            wanted = wanted.unionByName(copies).distinct()
        counted = take(change, files.walk(spark, root, glob).select("path", "content").join(wanted, "path", "left_semi"), settings)
        others = listed.join(gone, "path", "left_anti").join(found.select("path"), "path", "left_anti")
        change.replace("listing", others.unionByName(found.select("path", "modified", "length", "content_hash")))
        skipped = counted["skipped"] + counts.get("same", 0)
        return counted | {"skipped": skipped, "modified": counts.get("modified", 0), "deleted": deleted}

    out = committed(vault, make)
    _after(vault, settings)
    return out


def follow(spark: SparkSession, root: str, vault: Vault, checkpoint: str, interval: str = "60 seconds", glob: str = "*", settings: Settings | None = None, settle: float = 0.5) -> StreamingQuery:
    """Scans for new, changed and deleted files every ``interval``, until it is stopped; each scan that finds any is a version."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _rows, _n: scan_once(vault, root, glob, settings, settle) and None).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def drain(vault: Vault, embedder: embedding.Embedder, prefixer: embedding.Prefixer | None = None) -> int:
    """Embeds all chunks that have no vector of this model, also those that were taken in without an embedder; returns how many."""
    committed(vault, lambda change: queue.enqueue_missing(change, embedder.model))
    return queue.drain(vault, embedder, prefixer)


def sync(vault: Vault, root: str, settings: Settings | None = None) -> dict[str, int]:
    """A full scan: what is new is taken in, what changed replaces what it was, what is gone is deleted, all in one version."""
    return scan_once(vault, root, settings=settings)


def remove(vault: Vault, gone: DataFrame, settings: Settings | None = None) -> int:
    """Deletes documents (document_id) with all that hangs on them as one version."""
    return committed(vault, lambda change: drop(change, gone, settings or Settings()))


def reprocess(vault: Vault, prefix: str, rows: DataFrame, settings: Settings | None = None) -> dict[str, int]:
    """Deletes all documents under a path and takes the files in again, as one version."""
    settings = settings or Settings()

    def make(change: Change) -> dict[str, int]:
        drop(change, change.read("documents").filter(F.col("file_path").startswith(prefix)), settings)
        return take(change, rows.filter(F.col("path").startswith(prefix)), settings)

    counts = committed(vault, make)
    _after(vault, settings)
    return counts
