"""Toxicity: a factorization machine over hashed words and word beginnings, fitted on a bounded sample of labelled rows, scores every text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import body, written

#: Rows of each class that are learned from, as expected: a hash of doc_id draws them with one probability a class.
ROWS_PER_CLASS = 6000
#: Buckets that terms are hashed to, and of those how many the machine may have, taken by their likelihood ratio from LEAST_RATIO on.
BUCKETS, FEATURES, LEAST_RATIO = 1 << 22, 4096, 25.0
#: Lengths in bytes of the word beginnings that are terms beside the word.
BEGINNINGS = range(3, 9)
#: Bytes of text that are hashed at once; a longer text goes alone and whole.
AT_ONCE = 1 << 20
BASE, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Bytes that make words: digits, small letters and all beyond ASCII.
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of doc_id as text is divisible by 5. A null doc_id has no label and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def term_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, bucket) of every term of lower-cased texts, repeats kept: each word, and its first bytes for each of BEGINNINGS that it has."""
    said = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join([*said, b""]), dtype=np.uint8)
    inside = IN_WORD[data]
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    ends = np.flatnonzero(~inside & before)
    doc = np.searchsorted(np.cumsum([len(s) + 1 for s in said]), starts, "right")
    size = ends - starts
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()), BASE)])
    owner = np.repeat(np.arange(len(starts)), size)
    letters = np.flatnonzero(inside)
    weighed = (data[letters].astype(np.uint64) + np.uint64(1)) * powers[letters - starts[owner]]
    first = np.cumsum(size) - size
    sums = np.add.reduceat(weighed, first)
    docs, keys = [doc], [sums * SPREAD]
    for n in BEGINNINGS:
        long = np.flatnonzero(size >= n)
        part = np.zeros(len(long), dtype=np.uint64)
        for j in range(n):
            part += weighed[first[long] + j]
        docs.append(doc[long])
        keys.append((part + np.uint64(n)) * SPREAD ^ np.uint64(n))
    mixed = np.concatenate(keys)
    return np.concatenate(docs), ((mixed ^ (mixed >> np.uint64(29))) * SPREAD >> np.uint64(42)).astype(np.int64)


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) in runs of about AT_ONCE bytes."""
    low, size, run = 0, 0, []
    for at, text in enumerate(texts):
        run.append(text.as_py())
        size += len(run[-1])
        if size >= AT_ONCE:
            yield low, run
            low, size, run = at + 1, 0, []
    if run:
        yield low, run


@dataclass(frozen=True)
class Machine:
    """A logistic factorization machine over whether terms are there: bias, a weight for each feature, and vectors whose products weigh pairs of features."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def places(self) -> np.ndarray:
        """The feature of each bucket, -1 for those that are none."""
        out = np.full(BUCKETS, -1, dtype=np.int32)
        out[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return out

    def scores(self, n: int, doc: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Probabilities of n texts from their (text, feature) pairs, each pair once."""
        linear = np.bincount(doc, weights=self.weights[feature], minlength=n)
        pairs = np.zeros(n)
        for v in self.vectors.T:
            pairs += np.bincount(doc, weights=v[feature], minlength=n) ** 2 - np.bincount(doc, weights=v[feature] ** 2, minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -60, 60)))


def features_of(places: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), each pair once, in order."""
    doc, bucket = term_buckets(texts)
    feature = places[bucket]
    known = feature >= 0
    width = int(places.max()) + 1
    return np.divmod(np.unique(doc[known] * max(1, width) + feature[known]), max(1, width))


def training_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """((doc_id, text, toxic), labelled rows by class): labelled rows that aren't held out, of each class ``rows_per_class`` expected, drawn by a hash of doc_id.

    Of repeated labels one that says 1 is enough, and of rows with one doc_id the greatest text is taken, summed up per task before the shuffle.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).filter(~held_out(F.col("doc_id")))
    known = written(known, "labels")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = known.filter(F.greatest(*(F.when(F.col("toxic") == c, draw < rows_per_class / max(1, counts.get(c, 0))) for c in (0, 1))))
    # twice the rows that are asked for at most, but for chance; their ids are some bytes each
    rows = docs.select("doc_id", body().alias("text")).join(F.broadcast(drawn), "doc_id")
    return written(rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "toxicity-sample"), counts


def term_table(sample: DataFrame) -> DataFrame:
    """(bucket, clean, toxic): in how many texts of each class a bucket's terms occur. Counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, BUCKETS), dtype=np.int32)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for low, texts in _groups(batch.column("text")):
                doc, bucket = term_buckets(texts)
                doc, bucket = np.divmod(np.unique(doc * BUCKETS + bucket), BUCKETS)
                for c in (0, 1):
                    found[c] += np.bincount(bucket[toxic[low + doc] == c], minlength=BUCKETS).astype(np.int32)
        at = np.flatnonzero(found.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, found[0][at], found[1][at])], names=["bucket", "clean", "toxic"])

    counted = sample.select("text", "toxic").mapInArrow(run, "bucket long, clean long, toxic long")
    return counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def likelihood_ratio(a: Column, b: Column, n: int, m: int) -> Column:
    """Twice the log-likelihood ratio of a term in ``a`` of n texts of one class and ``b`` of m of the other against one rate for both."""
    cell = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    share, rest = (a + b) / float(n + m), (n + m - a - b) / float(n + m)
    return 2 * (cell(a, share * n) + cell(b, share * m) + cell(n - a, rest * n) + cell(m - b, rest * m))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, factors: int = 8, rounds: int = 100) -> Machine:
    """Learns from ``training_sample``: the buckets that tell the classes apart best become features, and a factorization machine is fitted to which of them each text has.

    Classes are drawn alike, and the bias is moved back to the odds that labels have. The sample is bounded,
    so one task holds it in order of doc_id and the sums come out alike in every run. With one class alone every text has its rate.
    """
    sample, counts = training_sample(docs, labels, rows_per_class)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, m = sizes.get(0, 0), sizes.get(1, 0)
    odds = math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
    nothing = Machine(np.empty(0, dtype=np.int64), odds, np.zeros(0), np.zeros((0, 1)))
    if not n or not m:
        return nothing
    ratio = likelihood_ratio(F.col("clean"), F.col("toxic"), n, m)
    chosen = term_table(sample).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.col("ratio").desc(), "bucket").limit(FEATURES)
    buckets = np.array([r["bucket"] for r in chosen.select("bucket").collect()], dtype=np.int64)
    if not len(buckets):
        return nothing
    places = sample.sparkSession.sparkContext.broadcast(buckets)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Machine(places.value, 0.0, np.zeros(0), np.zeros((0, 1))).places()
        for batch in batches:
            terms = []
            for _, texts in _groups(batch.column("text")):
                doc, feature = features_of(table, texts)
                terms += [list(map(str, x.tolist())) for x in np.split(feature, np.searchsorted(doc, np.arange(1, len(texts))))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(terms, pa.list_(pa.string()))], names=["doc_id", "label", "terms"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = written(sample.select("doc_id", "toxic", "text").mapInArrow(present, f"doc_id {kind}, label int, terms array<string>"), "toxicity-features")
    vectorizer = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(buckets))], "terms", "features").setBinary(True)
    learned = vectorizer.transform(rows).select("features", F.col("label").cast("double").alias("label"), "doc_id").coalesce(1).sortWithinPartitions("doc_id")
    model = FMClassifier(factorSize=factors, maxIter=rounds, stepSize=0.1, regParam=1e-4, initStd=0.05, tol=1e-5, seed=7).fit(learned)
    places.destroy()
    return Machine(buckets, model.intercept + odds - math.log((m + 0.5) / (n + 0.5)), np.array(model.linear.toArray()), np.array(model.factors.toArray()))


def score_texts(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row. One narrow pass over whole texts; the machine that is broadcast has FEATURES rows at most."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), body().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        places = fitted.places()
        for batch in batches:
            scores = np.concatenate([np.empty(0), *(fitted.scores(len(texts), *features_of(places, texts)) for _, texts in _groups(batch.column("text")))])
            scores = np.round(scores, 9)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score from 0 to 1, and predicted, 1 from 0.5 on.

    The score is of the text alone. Null and empty texts have no terms and score as the bias says; long texts
    are read whole; each repeated row has its own score; rows without doc_id are scored and not learned from. Without
    labels of both classes all texts score alike. An empty table gives no rows. Other columns are not read.
    """
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "toxic")
    return score_texts(docs, fit(docs, labels))
