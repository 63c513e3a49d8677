"""A corpus by name: ingest, index, query, evaluate and maintain, over the versions of a vault's tables."""

from __future__ import annotations

import hashlib
import time
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.config import Config
from corpusmill.functions import chunking, embedding
from corpusmill.operators import evaluation, maintenance, near, retrieval, segments, vector_index
from corpusmill.operators.rerank import Reranker
from corpusmill.protocols import Captioner, Detector, Enricher, QueryClassifier, QueryTransformer, VectorIndex
from corpusmill.sources import events, files
from corpusmill.sources.vault import Vault
from corpusmill.streaming import ingest, queue


class Corpus:
    """The tables of one vault and what is done with them.

    Every query reads one version of the vault from start to end, whoever wrote it; results are kept by
    version, so any writer's change makes them stale. ``index`` replaces the vector scan, ``transformer`` rewrites queries, and ``classifier`` says how many results they ask for.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, config: Config | None = None, embedder: embedding.Embedder | None = None, reranker: Reranker | None = None, *, index: VectorIndex | None = None, enricher: Enricher | None = None, captioner: Captioner | None = None, detector: Detector | None = None, transformer: QueryTransformer | None = None, classifier: QueryClassifier | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        self.vault = Vault(spark, root, name)
        self.embedder, self.reranker = embedder or embedding.embedder_of(self.config.embedding_model), reranker
        self.vectors, self.transformer, self.classifier = index, transformer, classifier
        self.enricher, self.captioner, self.detector = enricher, captioner, detector
        self.threats = maintenance.ThreatSources()
        self.results = retrieval.ResultCache(self.config.cached_results)
        self.query_vectors = retrieval.ResultCache(self.config.cached_vectors)
        self.events = events.EventLog(spark, self.vault.path("_events"))

    def settings(self) -> ingest.Settings:
        c = self.config
        fields = retrieval.FIELDS if c.field_weights else retrieval.BODY
        return ingest.Settings(self.embedder, self.prefixer(), chunking.Splitter(c.chunk_size, c.chunk_overlap, c.chunk_least), c.redacting, self.threats.phrases(), c.suspicious, c.quarantine, fields, self.enricher, self.captioner, self.detector)

    def prefixer(self) -> embedding.Prefixer:
        c = self.config
        return embedding.Prefixer(self.embedder.model, c.prefixes_off, c.query_prefix, c.document_prefix)

    def _noted(self, op: str, path: str, start: float, counts: dict[str, int]) -> dict[str, int]:
        self.events.write(type="ingest", op=op, path=path, seconds=time.perf_counter() - start, status="ok", **{k: counts[k] for k in ("new", "skipped", "errors") if k in counts})
        return counts

    def ingest(self, root: str, glob: str = "*") -> dict[str, int]:
        start = time.perf_counter()
        return self._noted("ingest", root, start, ingest.ingest_batch(self.vault, files.walk(self.spark, root, glob).select("path", "content"), self.settings()))

    def sync(self, root: str) -> dict[str, int]:
        """What is new, changed or gone under ``root`` since the last scan, as one version."""
        start = time.perf_counter()
        return self._noted("sync", root, start, ingest.sync(self.vault, root, self.settings()))

    def follow(self, root: str, checkpoint: str) -> StreamingQuery:
        """Scans for changes every ``watch_interval``."""
        return ingest.follow(self.spark, root, self.vault, checkpoint, self.config.watch_interval, settings=self.settings())

    def reprocess(self, prefix: str, root: str) -> dict[str, int]:
        start = time.perf_counter()
        return self._noted("reprocess", prefix, start, ingest.reprocess(self.vault, prefix, files.walk(self.spark, root).select("path", "content"), self.settings()))

    def remove(self, prefix: str) -> int:
        start = time.perf_counter()
        gone = ingest.remove(self.vault, self.vault.read("documents").filter(F.col("file_path").startswith(prefix)), self.settings())
        self.events.write(type="delete", op="remove", path=prefix, seconds=time.perf_counter() - start, status="ok", new=-gone)
        return gone

    def documents(self, view: Vault | None = None) -> DataFrame:
        """Documents, with the tags of an enricher beside their own, and its summary."""
        view = view or self.vault.at()
        documents = view.read("documents")
        if "enrichments" not in view.tables():
            return documents
        own = F.coalesce("tags", F.array().cast("array<string>"))
        joined = documents.join(view.read("enrichments"), "document_id", "left")
        made = F.coalesce("enrichment.tags", F.array().cast("array<string>"))
        return joined.withColumn("tags", F.array_distinct(F.concat(own, made))).withColumn("summary", F.col("enrichment.summary"))

    def chunks(self, view: Vault | None = None) -> DataFrame:
        """Chunks with what filters name."""
        view = view or self.vault.at()
        documents = self.documents(view).select("document_id", "file_path", "file_type", "tags")
        return view.read("chunks").withColumn("text", F.col("content")).join(documents, "document_id")

    def reenrich(self) -> dict[str, int]:
        """Fills in tags, summaries and captions that are missing or failed; chunks that exist aren't embedded again."""
        settings = self.settings()
        counts = ingest.committed(self.vault, lambda change: ingest.enrich(change, settings))
        queue.drain(self.vault, self.embedder, self.prefixer())
        return counts

    def _vectors_of(self, queries: DataFrame) -> DataFrame:
        return embedding.embed_rows(queries, self.embedder, "query_id", "query", "query", self.prefixer()).select("query_id", "vector")

    def _vector_of(self, query: DataFrame, text: str) -> DataFrame:
        """The vector of one query, from the cache where this model and its prefixes made it before."""
        key = (self.prefixer(), text)
        vector = self.query_vectors.get(key)
        if vector is None:
            vector = self._vectors_of(query).first()["vector"]
            self.query_vectors.put(key, vector)
        return self.spark.createDataFrame([("q", vector)], "query_id string, vector array<float>")

    def _request(self, request: retrieval.Request | None) -> retrieval.Request:
        c = self.config
        return request or retrieval.Request(pool=c.pool_size, rrf_k=c.rrf_k, adaptive=c.adaptive, retry=c.retry, default_k=c.default_k, most_k=c.most_k)

    def search(self, queries: DataFrame, request: retrieval.Request | None = None, asked: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """Hits of a batch of queries (query_id, query), with text, path and, where asked for, neighbours, all of one version.

        Only vectors of the model that is in use are searched; while a vault is moved to another, that is the old one.
        """
        view, request = self.vault.at(version), self._request(request)
        facts = view.facts()
        if self.transformer is not None:
            queries = queries.withColumn("query", self.transformer.transform(F.col("query")))
        queries, chunks = retrieval.normalised_queries(queries), self.chunks(view)
        vectors = siblings = None
        if request.mode != "keyword":
            model = facts.get("model")
            asked = asked if asked is not None else self._vectors_of(queries)
            first = asked.first()
            maintenance.guard(queue.profile_of(facts, model), self.embedder.model, len(first["vector"]) if first else 0, self.prefixer().resolved()[0])
            vectors = view.read("embeddings").filter(F.col("model") == model).select("chunk_id", "vector")
        if request.dedup:
            siblings = lambda hits: near.hit_siblings(hits, view.read("fingerprints"), self.config.near_bits)
        index = segments.open_index(view) if request.mode != "semantic" else None
        nearest = self.vectors or (vector_index.open_vectors(view, facts.get("model", "")) if vectors is not None else None)
        hits = retrieval.retrieve(queries, chunks, vectors, asked, request, index=index, reranker=self.reranker, siblings=siblings, vector_index=nearest, classifier=self.classifier)
        return retrieval.assemble(hits, view.read("chunks"), self.documents(view), request.context)

    def query(self, text: str, request: retrieval.Request | None = None) -> list[dict]:
        """The hits of one query, from the cache where nothing changed since."""
        start, version = time.perf_counter(), self.vault.version()
        key = (text, request, version, self.threats.phrases(), hashlib.sha256(repr(sorted(asdict(self.config).items())).encode()).hexdigest())
        found, status = self.results.get(key), "cached"
        if found is None:
            status = "ok"
            one = self.spark.createDataFrame([("q", text)], "query_id string, query string")
            vector = None
            if self.transformer is None and (request is None or request.mode != "keyword"):
                vector = self._vector_of(retrieval.normalised_queries(one), text)
            rows = self.search(one, request, vector, version).orderBy("rank").collect()
            found = [r.asDict(recursive=True) for r in rows]
            if not any(r.get("rerank_failed") for r in found):
                self.results.put(key, found)
        asked = self._request(request)
        self.events.write(type="query", query_hash=hashlib.sha256(text.encode()).hexdigest(), mode=asked.mode, k=asked.k, hits=len(found), status=status, seconds=time.perf_counter() - start)
        return found

    def evaluate(self, golden: DataFrame, request: retrieval.Request | None = None, k: int = 10) -> DataFrame:
        """Means over the golden queries (id, query, relevant)."""
        asked = golden.select(F.col("id").alias("query_id"), "query")
        hits = self.search(asked, replace(request or retrieval.Request(), k=max(k, (request or retrieval.Request()).k)))
        return evaluation.evaluate_run(hits, golden, self.vault.read("chunks"), k)

    def status(self) -> DataFrame:
        v = self.vault.at()
        have = v.tables()
        vectors = v.read("embeddings") if "embeddings" in have else self.spark.createDataFrame([], "chunk_id string")
        waiting = v.read("queue") if "queue" in have else self.spark.createDataFrame([], queue.SCHEMA)
        return maintenance.status_counts(self.documents(v), v.read("chunks"), vectors, near.fingerprint_classes(v.read("fingerprints")), waiting)

    def drain(self) -> int:
        """Embeds what waits for it or has no vector."""
        return ingest.drain(self.vault, self.embedder, self.prefixer())

    def cluster(self) -> None:
        """Writes the vectors by cluster; queries read those in place of all until vectors change."""
        ingest.committed(self.vault, lambda change: vector_index.store_index(change, change.facts["model"]))

    def migrate(self, embedder: embedding.Embedder, version: str = "") -> dict[str, int]:
        """Moves the corpus to another embedder; once all chunks have its vectors queries use it. Called again after a stop, it goes on."""
        prefixer = replace(self.prefixer(), model=embedder.model)
        counts = queue.migrate(self.vault, embedder, prefixer, version)
        if not counts["pending"] + counts["failed"]:
            self.embedder = embedder
        return counts

    def _judged(self, make) -> int:
        """Stores new verdicts: only rows whose verdict differs, and the parts that hold them, are written."""

        def merge(change) -> int:
            was = change.read("chunks")
            moved = maintenance.relabelled(was, make(was))
            n = moved.count()
            if n:
                change.merge("chunks", "chunk_id", moved)
            return n

        return ingest.committed(self.vault, merge)

    def release(self, ids: DataFrame) -> int:
        """Lets flagged chunks (chunk_id) into results, whatever later scans say; returns how many changed."""
        return self._judged(lambda chunks: maintenance.release(chunks, ids))

    def reset(self, ids: DataFrame) -> int:
        """Chunks (chunk_id) get the level of their score again."""
        return self._judged(lambda chunks: maintenance.reset(chunks, ids, self.config.suspicious, self.config.quarantine))

    def rescan(self) -> int:
        """Judges all chunks under the phrases and thresholds that hold now; returns how many changed."""
        settings = self.settings()
        return self._judged(lambda chunks: maintenance.rescan(chunks, judge=settings.judge))

    def drift(self, baseline: maintenance.Kind | None = None, version: str = "") -> tuple[str, list[str], maintenance.Kind | None]:
        """Holds the embedder against the stored baseline, or the one given, or what most vectors have; a baseline that is made on the way is stored."""
        probe, facts = len(self.embedder.embed(["probe"])[0]), self.vault.facts()
        live = maintenance.Kind(self.embedder.model, probe, self.prefixer().resolved()[0], version)
        stored = maintenance.Kind(**facts["baseline"]) if facts.get("baseline") else None
        found = maintenance.drift(baseline or stored, live, queue.profile_of(facts))
        if found[2] is not None and stored is None and baseline is None:
            ingest.committed(self.vault, lambda change: change.put("baseline", asdict(found[2])))
        return found

    def health(self, version: str = "") -> dict:
        """Whether the tables can be read, the embedder answers, and queries may be served; and the backlog."""
        try:
            tables = self.vault.tables()
        except Exception:  # noqa: BLE001 - whatever keeps the vault from being read
            return {"ok": False, "storage": False, "embedder": False, "ready": False, "drift": "n/a", "queue": {}}
        try:
            verdict, reachable = self.drift(version=version)[0], True
        except Exception:  # noqa: BLE001 - an embedder that can't be asked
            verdict, reachable = "unknown", False
        return {"ok": True, "storage": True, "embedder": reachable, "ready": maintenance.ready(verdict), "drift": verdict, "queue": queue.queue_counts(self.vault) if "queue" in tables else {}}
