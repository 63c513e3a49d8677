"""Exact nearest vectors from clusters: each is written once with its range of angles, and a query reads only clusters that can hold one of its best."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import top
from corpusmill.sources.shared import written
from corpusmill.sources.vault import Change, Vault

#: Rows that centroids are chosen from, and how many centroids there may be: all rows are then assigned, whatever these are.
SAMPLE, CENTROIDS = 20_000, 1024
#: Slack of bounds, above what rounding to nine digits and double precision lose.
SLACK = 1e-7
CLUSTERS = "dim int, cluster int, centroid array<double>, n long, low double, high double"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def choose_centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit vectors: members of the sample far from one another, moved to the mean of what is nearest a few times."""
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    found, away = [sample[0]], angles(sample, sample[:1])[:, 0]
    for _ in range(min(k, len(sample)) - 1):
        found.append(sample[int(away.argmax())])
        away = np.minimum(away, angles(sample, found[-1][None])[:, 0])
    centers = np.array(found)
    for _ in range(rounds):
        home = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, sample)
        centers = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centers)
    return centers


def cluster_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dim, cluster, angle, chunk_id, vector) for every row with a vector, in order of cluster and angle, and the centroids by dim and cluster; zeros are cluster -1.

    Files are cut by range, so a cluster of any size is spread over as many as it fills. Centroids are fitted on a bounded sample; they change what is read, never what is found.
    """
    rows = vectors.filter("vector IS NOT NULL").select("chunk_id", "vector", F.size("vector").alias("dim"))
    centers: dict[int, np.ndarray] = {}
    for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():
        share = min(1.0, SAMPLE / r["n"])
        drawn = rows.filter(F.col("dim") == r["dim"]).filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("vector").limit(2 * SAMPLE).collect()
        sample = unit(np.array([x["vector"] for x in drawn], dtype=np.float64).reshape(len(drawn), r["dim"]))
        centers[r["dim"]] = choose_centroids(sample, max(1, min(CENTROIDS, int(r["n"] ** 0.5))))
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x, c = unit(np.stack(part["vector"].to_numpy()).astype(np.float64)), shared.value[dim]
                home, angle = np.full(len(x), -1), np.zeros(len(x))
                some = np.linalg.norm(x, axis=1) > 0
                if some.any() and len(c):
                    near = angles(x[some], c)
                    home[some], angle[some] = near.argmin(axis=1), near.min(axis=1)
                yield part.assign(cluster=home, angle=angle)[["dim", "cluster", "angle", "chunk_id", "vector"]]

    kind = rows.schema["chunk_id"].dataType.simpleString()
    made = rows.mapInPandas(assign, f"dim int, cluster int, angle double, chunk_id {kind}, vector array<float>")
    made = written(made, "assigned").repartitionByRange("dim", "cluster", "angle", "chunk_id").sortWithinPartitions("dim", "cluster", "angle")
    # the centroids go on as rows
    table = [(int(d), i, c.tolist()) for d, m in centers.items() for i, c in enumerate(m)] + [(int(d), -1, [0.0] * int(d)) for d in centers]
    names = vectors.sparkSession.createDataFrame(table, "dim int, cluster int, centroid array<double>")
    return written(made, "clustered"), names


def cluster_table(clustered: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row a cluster: its centroid, how many vectors it has and between which angles they lie."""
    sizes = clustered.groupBy("dim", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    return centroids.join(sizes, ["dim", "cluster"]).select("dim", "cluster", "centroid", "n", "low", "high")


@dataclass
class ClusteredVectors:
    """A vector index over ``clustered`` rows and the table of clusters. ``read`` counts the vectors of clusters that the last search read, each once a pass."""

    clustered: DataFrame
    clusters: DataFrame
    max_queries: int = 10_000
    read: int = field(default=0)

    @classmethod
    def build(cls, vectors: DataFrame) -> ClusteredVectors:
        clustered, centroids = cluster_vectors(vectors)
        return cls(clustered, written(cluster_table(clustered, centroids), "clusters"))

    def _scored(self, wanted: dict[int, tuple], pool: int, q_type: str, id_type: str) -> DataFrame:
        """The best of each query in the clusters that are wanted: by length of vector (names, units, mask of queries by clusters)."""
        shared = self.clustered.sparkSession.sparkContext.broadcast(wanted)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for (dim, cluster), rows in batch.groupby(["dim", "cluster"]):
                    names, units, mask = shared.value[dim]
                    asked = np.flatnonzero(mask[:, cluster + 1])
                    x, ids = unit(np.stack(rows["vector"].to_numpy()).astype(np.float64)).T, rows["chunk_id"].to_numpy()
                    for at in range(0, len(asked), 256):
                        some = asked[at : at + 256]
                        scores = np.round(units[some] @ x, 9) + 0.0
                        best = np.stack([np.lexsort((ids, -line))[:pool] for line in scores])
                        yield pd.DataFrame({"query_id": np.repeat(names[some], best.shape[1]), "chunk_id": ids[best].ravel(), "score": np.take_along_axis(scores, best, axis=1).ravel()})

        pick = F.lit(False)
        for dim, (_, _, mask) in wanted.items():
            pick = pick | ((F.col("dim") == dim) & F.col("cluster").isin([int(c) - 1 for c in np.flatnonzero(mask.any(axis=0))]))
        found = self.clustered.filter(pick).select("dim", "cluster", "chunk_id", "vector").mapInPandas(run, f"query_id {q_type}, chunk_id {id_type}, score double")
        out = written(top(found, pool), "cluster-hits")
        shared.destroy()
        return out

    def search(self, queries: DataFrame, pool: int) -> DataFrame:
        """(query_id, chunk_id, score, rank) as a scan of all vectors gives them.

        First the clusters nearest to a query until they hold ``pool`` vectors: the least of their best is a floor. Then all others whose
        bound reaches it: a vector at angle b of a centroid that lies at angle a of the query is |a - b| away at least.
        """
        tables: dict[int, list] = {}
        for r in self.clusters.collect():
            tables.setdefault(r["dim"], []).append(r)
        q_type, id_type = queries.schema["query_id"].dataType.simpleString(), self.clustered.schema["chunk_id"].dataType.simpleString()
        rows, found = queries.select("query_id", "vector").repartition("query_id").toLocalIterator(), None
        self.read = 0
        while (listed := list(islice(rows, self.max_queries))) or found is None:
            first, bounds, sizes = {}, {}, {}
            for dim, clusters in tables.items():
                mine = [r for r in listed if r["vector"] is not None and len(r["vector"]) == dim]
                if not mine:
                    continue
                places = np.array([c["cluster"] + 1 for c in clusters])
                low, high, n = (np.array([c[k] for c in clusters]) for k in ("low", "high", "n"))
                units, centers = unit(np.array([r["vector"] for r in mine], dtype=np.float64)), np.array([c["centroid"] for c in clusters])
                away = angles(units, centers)
                bound = np.cos(np.maximum(0.0, np.maximum(low - away, away - high)))
                # zeros, and all vectors to a query of zeros, score 0
                bound[:, places == 0] = 0.0
                bound[np.linalg.norm(units, axis=1) == 0] = 0.0
                order = np.argsort(-bound, axis=1, kind="stable")
                seen = np.cumsum(n[order], axis=1) - n[order] < pool
                mask = np.zeros((len(mine), int(places.max()) + 1), dtype=bool)
                mask[np.arange(len(mine))[:, None], places[order]] = seen
                first[dim] = (np.array([r["query_id"] for r in mine], dtype=object), units, mask)
                bounds[dim], sizes[dim] = (places, bound), (places, n)
            near = self._scored(first, pool, q_type, id_type)
            floors = {r["query_id"]: r["score"] for r in near.filter(F.col("rank") == pool).select("query_id", "score").toLocalIterator()}
            second = {}
            for dim, (names, units, mask) in first.items():
                places, bound = bounds[dim]
                floor = np.array([floors.get(q, -2.0) for q in names])
                more = np.zeros_like(mask)
                more[:, places] = bound >= floor[:, None] - SLACK
                second[dim] = (names, units, more & ~mask)
                for m in (mask, second[dim][2]):
                    self.read += int(sizes[dim][1][m.any(axis=0)[places]].sum())
            both = near.drop("rank").unionByName(self._scored(second, pool, q_type, id_type).drop("rank"))
            part = top(both, pool)
            found = part if found is None else found.unionByName(part)
        return found


def store_index(change: Change, model: str) -> None:
    """Clusters the vectors of a model into two tables of the vault; the index holds until vectors change."""
    vectors = change.read("embeddings").filter(F.col("model") == model).select("chunk_id", "vector")
    clustered, centroids = cluster_vectors(vectors)
    change.replace("clustered", clustered)
    change.replace("clusters", cluster_table(clustered, centroids))
    change.put("clustered", [model, [p.path for p in change.tables["embeddings"].parts]])


def open_vectors(vault: Vault, model: str) -> ClusteredVectors | None:
    """The stored index, where it has all vectors of this version."""
    found = vault.at().manifest()
    if found.facts.get("clustered") != [model, [p.path for p in found.tables["embeddings"].parts]]:
        return None
    return ClusteredVectors(vault.frame(found.tables["clustered"]), vault.frame(found.tables["clusters"]))
