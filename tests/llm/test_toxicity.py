"""The toxicity machine: pairs that no sum of weights tells apart, labels that are held out, texts of every kind."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, score double, toxic int, features string, label int"


def out_of_fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def write(spark, path, rows, labels):
    spark.createDataFrame([(*r, "en", "s", 0.5, 1, "f", 0) for r in rows], DOCS).repartition(3).write.parquet(f"{path}/d")
    spark.createDataFrame([(*r, 1, "t") for r in labels], "doc_id long, toxic int, quality int, text string").write.parquet(f"{path}/l")
    return spark.read.parquet(f"{path}/d"), spark.read.parquet(f"{path}/l")


def measured(scored, labels):
    rows = scored.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("y")), "doc_id").filter("held_out AND y IS NOT NULL").collect()
    p, y = np.array([r["predicted"] for r in rows]), np.array([r["y"] for r in rows])
    return (p[y == 1] == 1).mean(), (p[y == 0] == 0).mean(), len(rows)


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    """Toxic only where an insult meets a group; either alone is as common among clean texts."""
    rng = random.Random(3)
    words = [f"plain{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(2400):
        kind = i % 4
        said = rng.sample(words, 12) + ["vermin"] * (kind in (0, 1)) + ["migrants"] * (kind in (0, 2))
        rng.shuffle(said)
        rows.append((i, " ".join(said)))
        labels.append((i, int(kind == 0)))
    rows += [(9001, None), (9002, ""), (9003, "..."), (9004, "vermin migrants " + "plain1 " * 60000), (None, "vermin migrants"), rows[0], rows[0]]
    return write(spark, tmp_path_factory.mktemp("pairs"), rows, labels + [(0, None), (None, 1), (7777, 1)])


def test_pairs_are_learned(pairs):
    docs, labels = pairs
    scored = toxicity.score_toxicity(docs, labels)
    recall, clean, n = measured(scored, labels)
    assert n > 400 and recall > 0.97 and clean > 0.97
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == out_of_fold(r["doc_id"]) for r in rows)
    of = {r["doc_id"]: r["score"] for r in rows}
    assert of[9001] == of[9002] == of[9003] < 0.5 < of[9004]
    assert len({r["score"] for r in rows if r["doc_id"] == 0}) == 1


def test_beginnings_of_words_are_terms(spark, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ra", "lo", "mi") for b in range(60)]
    rows = [(i, " ".join([*rng.sample(words, 20), *([f"Skunk{rng.randrange(10**6)}", f"skunk{rng.randrange(10**6)}"] if i % 5 == 1 else [])])) for i in range(1500)]
    docs, labels = write(spark, tmp_path, rows, [(i, int(i % 5 == 1)) for i in range(1500)])
    recall, clean, _ = measured(toxicity.score_toxicity(docs, labels), labels)
    assert recall > 0.97 and clean > 0.97


def test_held_out_labels_change_nothing(pairs):
    docs, labels = pairs
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs.select("doc_id", "text"), x.select("doc_id", "toxic"), rows_per_class=300, rounds=10) for x in (labels, other))
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.vectors == b.vectors).all() and (a.buckets == b.buckets).all()


def test_the_sample_is_bounded(pairs):
    docs, labels = pairs
    sample, counts = toxicity.training_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), 100)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert counts[0] > 1000 and all(60 < n < 150 for n in sizes.values())
    assert not sample.filter(toxicity.held_out(F.col("doc_id"))).count() and sample.count() == sample.select("doc_id").distinct().count()


def test_one_class_and_empty_tables(pairs):
    docs, labels = pairs
    only = toxicity.score_toxicity(docs, labels.filter("toxic = 0"))
    assert only.select("score").distinct().count() == 1 and only.filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == docs.count()


def test_terms_by_hand():
    doc, bucket = toxicity.term_buckets(["Abcd  abcd!", "", "Éa", "abcd", "x" * 20000])
    by = [sorted(bucket[doc == i].tolist()) for i in range(5)]
    # a word of four bytes has two beginnings, one of three its own length
    assert len(by[0]) == 6 and by[1] == [] and len(by[2]) == 2 and by[0] == sorted(by[3] * 2) and len(by[4]) == 7


def test_scores_are_sums_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(5), -0.3, rng.normal(size=5), rng.normal(size=(5, 3)))
    found = m.scores(2, np.array([0, 0, 0]), np.array([1, 3, 4]))
    z = m.bias + m.weights[[1, 3, 4]].sum() + sum(m.vectors[a] @ m.vectors[b] for a, b in ((1, 3), (1, 4), (3, 4)))
    assert np.allclose(found, [1 / (1 + np.exp(-z)), 1 / (1 + np.exp(0.3))])
