"""Corpus maintenance: what changed, what is pending, deletes, listings, profiles, drift, plans, quarantine and threat sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import scoring

# Upper bounds in seconds of the latency histograms' buckets.
QUERY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5)
INGEST_BUCKETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1, 5)


def scan_diff(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_path, status) from a full outer join of two (file_path, content_hash) tables."""
    both = disk.select("file_path", F.col("content_hash").alias("now")).join(stored.select("file_path", F.col("content_hash").alias("was")), "file_path", "full_outer")
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("was"), "unchanged").otherwise("modified")
    return both.select("file_path", status.alias("status"))


def new_content(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows whose content is not stored yet, one of each content: the one with the least path."""
    first = Window.partitionBy("content_hash").orderBy("file_path")
    fresh = rows.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def pending(chunks: DataFrame, embeddings: DataFrame, model: str | None = None) -> DataFrame:
    """Chunks without a vector, or without one of ``model``."""
    have = embeddings.filter(F.col("model") == model) if model else embeddings
    return chunks.join(have.select("chunk_id"), "chunk_id", "left_anti")


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``documents``, ``chunks`` and all tables by chunk_id without the documents in ``gone`` (document_id); fingerprints and verdicts go with their chunks."""
    ids = gone.select("document_id").distinct()
    lost = tables["chunks"].join(ids, "document_id", "left_semi").select("chunk_id")
    return {name: rows.join(ids, "document_id", "left_anti") if "document_id" in rows.columns else rows.join(lost, "chunk_id", "left_anti") for name, rows in tables.items()}


def files_listing(documents: DataFrame) -> DataFrame:
    """(file_path, file_type, chunk_count, status) by path; the sort is by range, not in one task."""
    return documents.select("file_path", "file_type", "chunk_count", "status").orderBy("file_path")


def dirs_rollup(documents: DataFrame) -> DataFrame:
    """(dir, n_files, n_chunks) by directory of ``file_path``; one partial aggregation."""
    directory = F.regexp_extract("file_path", r"\A(.*)/[^/]*\z", 1)
    return documents.groupBy(directory.alias("dir")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("chunk_count").cast("long").alias("n_chunks"))


def status_counts(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, classes: DataFrame | None = None, queue: DataFrame | None = None) -> DataFrame:
    """One row of counts, each table read once: documents, enriched, chunks, suspicious, quarantined, embeddings, pending, with fingerprint classes copies, and with a queue what failed and what was tried again."""
    count = lambda when: F.count(F.when(when, 1))
    enriched = count(F.col("enrichment.status") == "enriched") if "enrichment" in documents.columns else F.lit(0).cast("long")
    level = F.col("level") if "level" in chunks.columns else F.lit("clean")
    docs = documents.agg(F.count(F.lit(1)).alias("documents"), enriched.alias("enriched"))
    parts = chunks.agg(F.count(F.lit(1)).alias("chunks"), count(level == "suspicious").alias("suspicious"), count(level == "quarantine").alias("quarantined"))
    vectors = embeddings.agg(F.count_distinct("chunk_id").alias("embeddings"))
    left = pending(chunks.select("chunk_id"), embeddings).agg(F.count(F.lit(1)).alias("pending"))
    out = docs.crossJoin(F.broadcast(parts)).crossJoin(F.broadcast(vectors)).crossJoin(F.broadcast(left))  # single rows
    if queue is not None:
        out = out.crossJoin(F.broadcast(queue.agg(count(F.col("status") == "failed").alias("failed"), count((F.col("status") == "pending") & (F.col("attempts") > 0)).alias("retrying"))))
    return out if classes is None else out.crossJoin(F.broadcast(classes.filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("near_copies"))))


def embedding_profile(vectors: DataFrame) -> DataFrame:
    """(model, convention, dim, n) of the stored vectors; what a table lacks is empty."""
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in vectors.columns else F.lit("").alias(c) for c in ("model", "convention")]
    return vectors.select(*named, F.size("vector").alias("dim")).groupBy("model", "convention", "dim").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Profile:
    """Counts by model, dimension and convention, with the commonest of each; of equal counts the smallest."""

    models: dict[str, int]
    dims: dict[int, int]
    conventions: dict[str, int]

    @property
    def total(self) -> int:
        return sum(self.models.values())

    @property
    def consistent(self) -> bool:
        return max(map(len, (self.models, self.dims, self.conventions))) <= 1

    def majority(self) -> tuple[str, int, str]:
        first = lambda d, none: min(d, key=lambda k: (-d[k], k)) if d else none
        return first(self.models, ""), first(self.dims, 0), first(self.conventions, "")


def corpus_profile(vectors: DataFrame) -> Profile:
    """A row for each kind of vector reaches the driver: as many as there are models, conventions and lengths."""
    counts: tuple[dict, dict, dict] = ({}, {}, {})
    for r in embedding_profile(vectors).collect():
        for into, key in zip(counts, (r["model"], r["dim"], r["convention"]), strict=True):
            into[key] = into.get(key, 0) + r["n"]
    return Profile(*counts)


class MismatchError(ValueError):
    """Queries would be compared with vectors of another kind."""


def guard(profile: Profile, model: str, dim: int, convention: str) -> None:
    """Raises unless the corpus is empty or its vectors are of one convention, and of the query's kind."""
    if not profile.total:
        return
    most = profile.majority()
    if len(profile.conventions) > 1:
        raise MismatchError(f"vectors of {len(profile.conventions)} conventions; embed the corpus again")
    for name, have, want in (("convention", most[2], convention), ("model", most[0], model), ("dimension", most[1], dim)):
        if have != want:
            raise MismatchError(f"{name} of the corpus is {have!r}, of the query {want!r}")


@dataclass(frozen=True)
class Kind:
    """What vectors were made with; an empty or zero field is unknown."""

    model: str = ""
    dim: int = 0
    convention: str = ""
    version: str = ""


def drift(baseline: Kind | None, live: Kind, profile: Profile | None = None) -> tuple[str, list[str], Kind | None]:
    """(verdict, reasons, baseline): ``n/a``, ``clean``, ``hard-drift``, ``version-warning`` or ``unknown``.

    Without a baseline one is made from what most stored vectors have. Model, length and convention
    come first; the server's version is compared only where both are known.
    """
    if baseline is None:
        if profile is None or not profile.total:
            return "n/a", [], None
        baseline = Kind(*profile.majority(), live.version)
    reasons = [f"{name}: {was} vs {now}" for name, was, now in (("model", baseline.model, live.model), ("dim", baseline.dim, live.dim)) if was and now and was != now]
    if baseline.convention != live.convention:
        reasons.append(f"convention: {baseline.convention!r} vs {live.convention!r}")
    if reasons:
        return "hard-drift", reasons, baseline
    known = [v not in ("", "unknown") for v in (baseline.version, live.version)]
    if all(known) and baseline.version != live.version:
        return "version-warning", [f"version: {baseline.version} vs {live.version}"], baseline
    return ("unknown" if live.version == "unknown" and baseline.version else "clean"), [], baseline


def ready(verdict: str) -> bool:
    """Whether queries may be served: not while vectors are of another kind."""
    return verdict != "hard-drift"


def baseline_frame(spark: SparkSession, baseline: Kind) -> DataFrame:
    """A baseline as a row, to be stored."""
    return spark.createDataFrame([tuple(asdict(baseline).values())], "model string, dim int, convention string, version string")


def embeddings_per_model(vectors: DataFrame) -> DataFrame:
    """(model, n), rows without a model left out."""
    return vectors.filter("model <> ''").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def migration_plan(vectors: DataFrame, target: str) -> DataFrame:
    """(model, n, stale) by model: what a change to ``target`` would embed again. Reads only."""
    return embeddings_per_model(vectors).withColumn("stale", F.col("model") != target)


def quarantine_list(chunks: DataFrame, levels: tuple[str, ...] = ("suspicious", "quarantine")) -> DataFrame:
    """Flagged chunks, the worst first."""
    return chunks.filter(F.col("level").isin(*levels)).orderBy(F.col("score").desc(), "chunk_id")


def release(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks in ``ids`` are released, which a rescan doesn't undo."""
    named = ids.select("chunk_id").distinct().withColumn("_named", F.lit(True))
    return chunks.join(named, "chunk_id", "left").withColumn("level", F.when(F.col("_named"), "released").otherwise(F.col("level"))).drop("_named")


def reset(chunks: DataFrame, ids: DataFrame, suspicious: float = scoring.SUSPICIOUS, quarantine: float = scoring.QUARANTINE) -> DataFrame:
    """The chunks in ``ids`` get the level of their stored score again."""
    named = ids.select("chunk_id").distinct().withColumn("_named", F.lit(True))
    return chunks.join(named, "chunk_id", "left").withColumn("level", F.when(F.col("_named"), scoring.level_of(F.col("score"), suspicious, quarantine)).otherwise(F.col("level"))).drop("_named")


VERDICT = ("score", "level", "matched_phrases", "instruction", "repetition", "stuffing")


def rescan(chunks: DataFrame, phrases: tuple[str, ...] = scoring.PHRASES, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Chunks scored and labelled anew with ``phrases``, or by ``judge``; what was released keeps what it had."""
    kept, judged = chunks.columns, [c for c in VERDICT if c in chunks.columns]
    was = chunks.withColumn("before", F.struct(*judged)) if judged else chunks
    now = scoring.poison_scores(was, "content", phrases) if judge is None else judge(was)
    fresh = F.coalesce(F.col("before.level"), F.lit("")) != "released"
    return now.select(*(F.when(fresh, F.col(c)).otherwise(F.col(f"before.{c}")).alias(c) if c in judged else c for c in kept))


def relabelled(was: DataFrame, now: DataFrame) -> DataFrame:
    """The rows of ``now`` whose verdict differs from that in ``was``."""
    before = was.select("chunk_id", *(F.col(c).alias(f"was_{c}") for c in ("score", "level", "matched_phrases")))
    moved = (F.round("score", 9) != F.round("was_score", 9)) | ~F.col("level").eqNullSafe(F.col("was_level")) | ~F.col("matched_phrases").eqNullSafe(F.col("was_matched_phrases"))
    return now.join(before, "chunk_id").filter(moved).select(*now.columns)


@dataclass(frozen=True)
class ThreatSource:
    """A list of phrases from elsewhere. Fetching it is the caller's."""

    id: str
    phrases: tuple[str, ...]
    enabled: bool = True
    origin: str = ""
    version: str = ""


@dataclass
class ThreatSources:
    """The lists of a corpus; ``phrases`` is what a rescan takes: the built-in ones and those of enabled lists, each once, in order."""

    sources: dict[str, ThreatSource] = field(default_factory=dict)

    def put(self, source: ThreatSource) -> None:
        self.sources[source.id] = source

    def enable(self, id: str, on: bool = True) -> None:
        self.sources[id] = ThreatSource(**{**asdict(self.sources[id]), "enabled": on})

    def remove(self, id: str) -> None:
        del self.sources[id]

    def phrases(self) -> tuple[str, ...]:
        own = {p.strip().lower() for s in self.sources.values() if s.enabled for p in s.phrases if p.strip()}
        return tuple(sorted({*scoring.PHRASES, *own}))


def to_enrich(documents: DataFrame) -> DataFrame:
    """Documents whose enrichment is missing or didn't succeed."""
    return documents.filter(F.coalesce(F.col("enrichment.status"), F.lit("")) != "enriched")


def latency_histogram(durations: DataFrame, seconds: str = "seconds", bounds: tuple[float, ...] = QUERY_BUCKETS) -> DataFrame:
    """(le, n): durations in each bucket, by its upper bound; what is above the last has an infinite one. Empty buckets are left out."""
    le = F.lit(float("inf"))
    for bound in reversed(bounds):
        le = F.when(F.col(seconds) <= bound, float(bound)).otherwise(le)
    return durations.groupBy(le.alias("le")).agg(F.count(F.lit(1)).alias("n"))
