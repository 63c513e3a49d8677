"""A durable queue of chunks that wait for vectors: rows of a vault's table with model, status and attempts, worked off in steps that are versions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.embedding import BATCH, Embedder, Prefixer
from corpusmill.operators import maintenance
from corpusmill.sources.shared import written
from corpusmill.sources.vault import Change, Vault

SCHEMA = "chunk_id string, model string, status string, attempts int, reason string"
#: Chunks that one task embeds, in calls of BATCH, and chunks whose vectors are committed at once.
PER_TASK, STEP = 2048, 200_000


class PermanentEmbedError(ValueError):
    """The embedder will never take this text; it isn't asked for it again."""


def enqueue(change: Change, ids: DataFrame, model: str) -> None:
    """Adds chunks as pending."""
    change.append("queue", ids.select("chunk_id", F.lit(model).alias("model"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit("").alias("reason")))


def enqueue_missing(change: Change, model: str) -> None:
    """Adds every chunk that neither has a vector of ``model`` nor waits for one: after a change of model, or for chunks that were taken in without an embedder."""
    ids = change.read("chunks").select("chunk_id")
    for table in ("embeddings", "queue"):
        have = change.read(table)
        ids = ids if have is None else ids.join(have.filter(F.col("model") == model).select("chunk_id"), "chunk_id", "left_anti")
    enqueue(change, ids.distinct(), model)


def embed_outcomes(work: DataFrame, embedder: Embedder, prefixer: Prefixer | None = None) -> DataFrame:
    """(chunk_id, attempts, vector, status, reason) of rows (chunk_id, attempts, content): calls of BATCH texts over the borders of documents.

    A call that fails leaves its chunks pending with one attempt more. Where the embedder says that it will never take a
    text, the texts of that call go one by one, and those that are refused fail for good.
    """
    prefixer = prefixer or Prefixer(embedder.model)
    source = work.select("chunk_id", "attempts", prefixer.apply(F.coalesce("content", F.lit("")), "document").alias("text"))

    def tried(texts: list[str]) -> list[tuple]:
        try:
            return [(v, "done", "") for v in embedder.embed(texts)]
        except PermanentEmbedError as error:
            return [(None, "failed", str(error))] if len(texts) == 1 else [r for t in texts for r in tried([t])]
        except Exception as error:  # noqa: BLE001 - whatever it is, the chunks are asked for again
            return [(None, "pending", f"{type(error).__name__}: {error}")] * len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [r for at in range(0, len(texts), BATCH) for r in tried(texts[at : at + BATCH])]
            made = [pa.array([r[0] for r in found], pa.list_(pa.float32())), pa.array([r[1] for r in found], pa.string()), pa.array([r[2] for r in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("attempts"), *made], names=["chunk_id", "attempts", "vector", "status", "reason"])

    return source.mapInArrow(run, "chunk_id string, attempts int, vector array<float>, status string, reason string")


def count_profile(change: Change, vectors: DataFrame, sign: int = 1) -> None:
    """Keeps what kinds of vectors there are, and how many, with the version, so that no query counts them."""
    counts = {tuple(k): n for *k, n in change.facts.get("profile", [])}
    for r in maintenance.embedding_profile(vectors).collect():
        key = (r["model"], r["convention"], r["dim"])
        counts[key] = counts.get(key, 0) + sign * r["n"]
    change.put("profile", [[*k, n] for k, n in sorted(counts.items()) if n > 0])


def profile_of(facts: dict, model: str | None = None) -> maintenance.Profile:
    """The kinds of vectors that a vault holds, of one model where it is given."""
    counts: tuple[dict, dict, dict] = ({}, {}, {})
    for name, convention, dim, n in facts.get("profile", []):
        if model in (None, name):
            for into, key in zip(counts, (name, dim, convention), strict=True):
                into[key] = into.get(key, 0) + n
    return maintenance.Profile(*counts)


def _step(vault: Vault, embedder: Embedder, prefixer: Prefixer, steps: int, at: int) -> int:
    """Works off one share of what is pending for the embedder's model, as one version; returns how many vectors it made."""
    with vault.change() as change:
        queue = change.read("queue")
        mine = (F.col("model") == embedder.model) & (F.col("status") == "pending") & (F.pmod(F.xxhash64("chunk_id"), F.lit(steps)) == at)
        # what was deleted since has no content and leaves the queue
        work = written(queue.filter(mine).select("chunk_id", "attempts").dropDuplicates(["chunk_id"]).join(change.read("chunks").select("chunk_id", "content"), "chunk_id"), "to-embed")
        have = change.read("embeddings")
        if have is not None:
            work = work.join(have.filter(F.col("model") == embedder.model).select("chunk_id"), "chunk_id", "left_anti")
        tasks = max(1, -(-work.count() // PER_TASK))
        done = written(embed_outcomes(work.repartition(tasks), embedder, prefixer), "embedded")
        vectors = done.filter("status = 'done'").select("chunk_id", F.lit(embedder.model).alias("model"), F.lit(prefixer.resolved()[0]).alias("convention"), "vector")
        made = vectors.count()
        if made:
            count_profile(change, change.append("embeddings", vectors))
            change.compact("embeddings")
        left = done.filter("status <> 'done'").select("chunk_id", F.lit(embedder.model).alias("model"), "status", (F.col("attempts") + 1).alias("attempts"), "reason")
        change.replace("queue", queue.filter(~mine).unionByName(left))
        change.facts.setdefault("model", embedder.model)
    return made


def drain(vault: Vault, embedder: Embedder, prefixer: Prefixer | None = None, retry_failed: bool = False) -> int:
    """Embeds what is pending for the embedder's model, each chunk once at most; returns how many vectors it made.

    Every step is a version, so what a crash leaves undone is still pending, and what was done isn't done again.
    """
    if "queue" not in vault.tables():
        return 0
    if retry_failed:
        with vault.change() as change:
            again = (F.col("model") == embedder.model) & (F.col("status") == "failed")
            change.replace("queue", change.read("queue").withColumn("status", F.when(again, "pending").otherwise(F.col("status"))))
    pending = vault.read("queue").filter((F.col("model") == embedder.model) & (F.col("status") == "pending")).count()
    steps = -(-pending // STEP)
    return sum(_step(vault, embedder, prefixer or Prefixer(embedder.model), steps, at) for at in range(steps))


def queue_counts(vault: Vault, model: str | None = None) -> dict[str, int]:
    """Chunks by status, of one model or of all."""
    if "queue" not in vault.tables():
        return {}
    rows = vault.read("queue").filter(F.lit(True) if model is None else F.col("model") == model)
    return {r["status"]: r["n"] for r in rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}


def migrate(vault: Vault, embedder: Embedder, prefixer: Prefixer | None = None, version: str = "") -> dict[str, int]:
    """Moves a vault to the embedder's model: queries see the old vectors until all chunks have new ones, and from one version to the next only those.

    It may be stopped anywhere and called again: vectors of the new model that are there stay, and the switch, the baseline
    of the drift check included, comes with the drop of all others. While chunks are pending or failed there is no switch.
    """
    prefixer = prefixer or Prefixer(embedder.model)
    with vault.change() as change:
        enqueue_missing(change, embedder.model)
        change.put("migrating", embedder.model)
    made = drain(vault, embedder, prefixer)
    counts = queue_counts(vault, embedder.model)
    if not counts:
        with vault.change() as change:
            kept = change.read("embeddings").filter(F.col("model") == embedder.model)
            change.replace("embeddings", kept)
            change.put("profile", [])
            count_profile(change, change.read("embeddings"))
            dims = [p[2] for p in change.facts["profile"]]
            change.replace("queue", change.read("queue").filter(F.col("model") == embedder.model))
            change.put("model", embedder.model)
            change.put("migrating", None)
            change.put("baseline", asdict(maintenance.Kind(embedder.model, dims[0] if dims else 0, prefixer.resolved()[0], version)))
    return {"embedded": made, "pending": counts.get("pending", 0), "failed": counts.get("failed", 0)}
