"""Ranked lexical search: the kth impact of a term is a floor below an item's kth score; terms that can't reach it are pruned, what is left makes candidates, which are scored exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from corpusmill.llm.common import body, written

#: Bytes that end a term become blanks, A-Z become a-z; bytes of code points above 7F stay, so a term is what ``bytes.split`` leaves.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms of items, each once an item, that are searched for in one pass: what is broadcast is some tens of bytes for each. More items make more passes.
BLOCK_TERMS = 50_000
#: Pairs of a document and an item that are worked on at once in a task, and places in its table of sums.
PAIRS, SUMS = 1_000_000, 4_000_000


@dataclass(frozen=True)
class Ranking:
    """Term weights are ``floor(scale * ln((2N + 2) / (2df + 1)))``; a term that occurs ``tf`` times in a document of relative length ``m`` (in hundredths) counts ``weight * (unit * tf div (1000 * tf + saturation * m))``."""

    k: int = 50
    scale: int = 1000
    unit: int = 1_000_000_000
    saturation: int = 20
    length_share: int = 50

    def weight(self, n: int, df: int) -> int:
        return math.floor(self.scale * math.log((2 * n + 2) / (2 * df + 1)))

    def impacts(self, weights: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
        m = 100 - self.length_share + (self.length_share * n * documents) // max(1, length)
        return weights * ((self.unit * tf) // (1000 * tf + self.saturation * m))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] ... starts[i] + counts[i] - 1`` of all i, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


@dataclass
class Plan:
    """Items of one block by number, and their terms: those that can lift a document to the floor, by term, and the others, by item."""

    weights: np.ndarray
    floor: np.ndarray
    rest: np.ndarray
    by_term: tuple[np.ndarray, np.ndarray]
    by_item: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, items: np.ndarray, terms: np.ndarray, weights: np.ndarray, most: np.ndarray, kth: np.ndarray, n_items: int) -> Plan:
        """From (item, term) pairs, each term's greatest impact and its kth.

        As many documents as are asked for reach a term's kth impact with that term alone, so the
        greatest of an item's is a floor below its kth score. Terms in order of their greatest impact, the
        smallest first, are pruned while all up to them together stay below the floor: a document with no other term of the item is not among its best.
        """
        floor = np.zeros(n_items, dtype=np.int64)
        np.maximum.at(floor, items, kth[terms])
        order = np.lexsort((terms, most[terms], items))
        items, terms = items[order], terms[order]
        sums = np.cumsum(most[terms])
        first = np.searchsorted(items, np.arange(n_items))
        before = np.where(first > 0, sums[first - 1], 0)
        pruned = sums - before[items] < floor[items]
        rest = np.zeros(n_items, dtype=np.int64)
        np.add.at(rest, items[pruned], most[terms[pruned]])
        at = np.flatnonzero(~pruned)
        at = at[np.argsort(terms[at], kind="stable")]
        starts = lambda keys, n: np.searchsorted(keys, np.arange(n + 1))
        return cls(weights, floor, rest, (starts(terms[at], len(weights)), items[at]), (starts(items[pruned], n_items), terms[pruned]))


class Best:
    """The k best (score, document) of each item so far; of equal scores the smaller document, one without id last."""

    def __init__(self, k: int) -> None:
        self.k, self.item, self.score, self.doc, self.none = k, *(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, none: np.ndarray, floor: np.ndarray) -> None:
        """Takes scores in, and lifts ``floor`` to the kth of each item that has as many."""
        item, score, doc, none = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.none, none)))
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        stays = place < self.k
        order, full = order[stays], place[stays] == self.k - 1
        self.item, self.score, self.doc, self.none = item[stays], score[order], doc[order], none[order]
        floor[self.item[full]] = np.maximum(floor[self.item[full]], self.score[full])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) with each term of an item once; rows that share an id are one item with the terms of all."""
    rows = items.select("item_id", body().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t.as_py().encode()))) for t in batch.column("text")]
            ids = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(ids, pa.int64())), pa.array([t for f in found for t in f], pa.binary())], names=["item_id", "term"])

    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term binary").distinct()


def _blocks(pairs: DataFrame, most: int) -> Iterator[tuple[list, np.ndarray, list[bytes]]]:
    """(item ids, item number of each pair, its term) of whole items, up to ``most`` pairs unless one item has more. The driver holds one block."""
    ids, numbers, terms, seen = [], [], [], None
    for row in pairs.orderBy("item_id", "term").toLocalIterator():
        if seen is None or row["item_id"] != seen[0]:
            if len(terms) >= most:
                yield ids, np.array(numbers, dtype=np.int64), terms
                ids, numbers, terms = [], [], []
            seen = (row["item_id"],)
            ids.append(row["item_id"])
        numbers.append(len(ids) - 1)
        terms.append(bytes(row["term"]))
    if terms:
        yield ids, np.array(numbers, dtype=np.int64), terms


def index_documents(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(doc_id, n, terms, tfs): how many terms a document has, and which of the vocabulary how often, by number in order. One narrow pass; documents without terms are left out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary.value)}.get
        for batch in batches:
            lengths, terms, tfs, sizes = [], [], [], [0]
            for text in batch.column("text"):
                found = terms_of(text.as_py().encode())
                lengths.append(len(found))
                known = np.fromiter((x for x in map(number, found) if x is not None), dtype=np.int32)
                at, n = np.unique(known, return_counts=True)
                terms.append(at)
                tfs.append(n.astype(np.int32))
                sizes.append(sizes[-1] + len(at))
            flat = lambda x: pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *x]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), flat(terms), flat(tfs)], names=["doc_id", "n", "terms", "tfs"]).filter(pa.array(np.array(lengths) > 0))

    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n by document; and by posting the document's place in the batch, term and frequency."""
    terms = batch.column("terms")
    sizes = np.diff(terms.offsets.to_numpy())
    n = batch.column("n").to_numpy()
    return n, np.repeat(np.arange(len(n)), sizes), terms.flatten().to_numpy().astype(np.int64), batch.column("tfs").flatten().to_numpy().astype(np.int64)


def term_impacts(index: DataFrame, weights: Broadcast, documents: int, length: int, rule: Ranking) -> DataFrame:
    """(term, most, kth): each term's greatest impact and its kth, 0 where fewer documents have it. A task passes on k of a term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, impact = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            n, doc, t, tf = _postings(batch)
            term, impact = np.concatenate([term, t]), np.concatenate([impact, rule.impacts(weights.value[t], tf, n[doc], documents, length)])
            order = np.lexsort((-impact, term))
            term = term[order]
            stays = np.arange(len(term)) - np.searchsorted(term, term) < rule.k
            term, impact = term[stays], impact[order][stays]
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(impact, pa.int64())], names=["term", "impact"])

    few = index.select("n", "terms", "tfs").mapInArrow(run, "term long, impact long")
    ranked = few.withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy(F.col("impact").desc())))
    return ranked.groupBy("term").agg(F.max("impact").alias("most"), F.coalesce(F.max(F.when(F.col("_n") == rule.k, F.col("impact"))), F.lit(0)).alias("kth"))


def score_candidates(index: DataFrame, plan: Broadcast, documents: int, length: int, rule: Ranking) -> DataFrame:
    """(item, doc_id, score) of each task's k best documents for every item, ties in order of doc_id.

    Documents meet items by the terms that aren't pruned. What these and the greatest impacts of the
    pruned ones together leave below the item's floor goes; the others get their pruned terms looked up and
    so their exact score. The floor rises with the kth score that the task has seen, as of all documents the kth is no lower.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        floor, best = p.floor.copy(), Best(rule.k)
        starts, owners = p.by_term
        their, pruned = p.by_item
        n_items, n_terms = len(floor), len(p.weights)
        for batch in batches:
            ids = batch.column("doc_id")
            none, ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            n, doc, term, tf = _postings(batch)
            impact = rule.impacts(p.weights[term], tf, n[doc], documents, length)
            met = starts[term + 1] - starts[term]
            # runs of whole documents that make few pairs
            work = np.cumsum(np.bincount(doc, weights=met, minlength=len(n)))
            low = 0
            while low < len(n):
                high = int(np.searchsorted(work, (work[low - 1] if low else 0) + PAIRS, "right"))
                high = max(low + 1, min(high, low + max(1, SUMS // n_items), len(n)))
                a, b = np.searchsorted(doc, [low, high])
                at, value, key = doc[a:b] - low, impact[a:b], (doc[a:b] - low) * n_terms + term[a:b]
                pairs = _spans(starts[term[a:b]], met[a:b])
                sums = np.zeros((high - low) * n_items, dtype=np.int64)
                np.add.at(sums, np.repeat(at, met[a:b]) * n_items + owners[pairs], np.repeat(value, met[a:b]))
                found = np.flatnonzero(sums)
                item = found % n_items
                found = found[sums[found] + p.rest[item] >= floor[item]]
                for part in np.array_split(found, max(1, -(-len(found) // PAIRS))):
                    d, item = part // n_items, part % n_items
                    more = their[item + 1] - their[item]
                    # a pair with very many pruned terms is one task's array, as its item is one row
                    wanted = np.repeat(d, more) * n_terms + pruned[_spans(their[item], more)]
                    place = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
                    hit = key[place] == wanted if len(key) else np.zeros(len(wanted), dtype=bool)
                    score = sums[part].copy()
                    np.add.at(score, np.repeat(np.arange(len(part)), more)[hit], value[place[hit]])
                    good = score >= np.maximum(floor[item], 1)
                    best.add(item[good], score[good], ids[low + d[good]], none[low + d[good]], floor)
                low = high
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), pa.array(best.doc, pa.int64(), mask=best.none), pa.array(best.score, pa.int64())], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def _search_block(docs: DataFrame, ids: list, numbers: np.ndarray, terms: list[bytes], id_type: DataType, rule: Ranking) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted(set(terms))
    place = {t: i for i, t in enumerate(vocabulary)}
    shared = [spark.sparkContext.broadcast(vocabulary)]
    index = written(index_documents(docs, shared[0]), "term-index")
    documents, length = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    # a row for each term of the block
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]
    weights = np.array([rule.weight(documents, x) for x in df.tolist()], dtype=np.int64)
    shared.append(spark.sparkContext.broadcast(weights))
    impacts = written(term_impacts(index, shared[1], documents, length, rule), "term-impacts")
    most, kth = np.zeros(len(vocabulary), dtype=np.int64), np.zeros(len(vocabulary), dtype=np.int64)
    for r in impacts.toLocalIterator():
        most[r["term"]], kth[r["term"]] = r["most"], r["kth"]
    pairs = np.array([place[t] for t in terms], dtype=np.int64)
    shared.append(spark.sparkContext.broadcast(Plan.of(numbers, pairs, weights, most, kth, len(ids))))
    few = score_candidates(index, shared[2], documents, length, rule)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rule.k)
    names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {id_type.simpleString()}")
    found = written(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    for each in shared:
        each.destroy()
    return found


def search_documents(docs: DataFrame, items: DataFrame, rule: Ranking | None = None) -> DataFrame:
    """Each item's k documents of the highest score above 0: item_id, rank, doc_id, score; equal scores go by ascending doc_id, null last.

    ``docs`` has an integer doc_id and text, ``items`` item_id and text. Null and empty texts have no
    terms and meet nothing. Rows of items with one id are one item with the terms of all, null ids
    included. Every row of documents is one of its own, so repeated rows all rank. Either table empty gives no rows.
    Long texts are read whole; other columns, whatever their names, are not read. Items go in blocks of bounded size, each with an index of its terms alone.
    """
    rule = rule or Ranking()
    id_type = items.schema["item_id"].dataType
    found = None
    for ids, numbers, terms in _blocks(item_terms(items), BLOCK_TERMS):
        part = _search_block(docs, ids, numbers, terms, id_type, rule)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")


SEARCH_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT r, doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
x AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 50
"""
