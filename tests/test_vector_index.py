"""The clustered vector index against a scan of all vectors."""

import numpy as np
import pytest

from corpusmill.corpus import Corpus
from corpusmill.operators import retrieval, vector_index


@pytest.fixture(scope="module")
def tables(spark):
    """Groups around 30 directions, equal vectors, zeros, nulls, and some of another length."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 16))
    rows = [(i, (centers[i % 30] + rng.normal(scale=0.05, size=16)).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(70)] + [(6000 + i, [0.0] * 16) for i in range(5)] + [(6100, None), (6200, [1.0, 2.0]), (6201, [2.0, 1.0])]
    asked = [(i, rows[i * 37][1]) for i in range(20)] + [(90, [0.0] * 16), (91, [1.0, 0.5]), (92, None), (93, (-centers[0]).tolist()), (94, [1.0, 2.0, 3.0])]
    return spark.createDataFrame(rows, "chunk_id long, vector array<float>").repartition(4), spark.createDataFrame(asked, "query_id long, vector array<float>")


def listed(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize(("pool", "block"), [(1, 10_000), (60, 10_000), (60, 7)])
def test_equals_a_scan(tables, pool, block):
    vectors, asked = tables
    index = vector_index.ClusteredVectors.build(vectors)
    index.max_queries = block
    assert listed(index.search(asked, pool)) == listed(retrieval.knn(asked, vectors, pool))


def test_reads_few_vectors_where_they_lie_in_groups(tables):
    vectors, asked = tables
    index = vector_index.ClusteredVectors.build(vectors)
    few = asked.filter("query_id < 3")
    assert listed(index.search(few, 20)) == listed(retrieval.knn(few, vectors, 20))
    assert 60 <= index.read < 700 and index.clusters.agg({"n": "sum"}).first()[0] == 3077


def test_no_queries_and_no_vectors(tables):
    vectors, asked = tables
    assert vector_index.ClusteredVectors.build(vectors).search(asked.limit(0), 5).count() == 0
    assert vector_index.ClusteredVectors.build(vectors.limit(0)).search(asked, 5).count() == 0


def test_a_corpus_keeps_its_clusters_until_vectors_change(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, said in enumerate(("cats purr on sofas", "dogs bark at night", "fish swim in ponds", "birds sing at dawn")):
        (source / f"{i}.txt").write_text(said)
    corpus = Corpus(spark, str(tmp_path / "v"), "c")
    corpus.ingest(str(source))
    ask = retrieval.Request(mode="semantic", k=4)
    before = corpus.query("dogs at night", ask)
    corpus.cluster()
    assert vector_index.open_vectors(corpus.vault, corpus.embedder.model) is not None and corpus.query("dogs at night", ask) == before
    (source / "4.txt").write_text("dogs sleep at night")
    corpus.ingest(str(source))
    assert vector_index.open_vectors(corpus.vault, corpus.embedder.model) is None and len(corpus.query("dogs at night", retrieval.Request(mode="semantic", k=5))) == 5
