"""Ranked lexical search against a scorer that reads every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import ranked_search

DOCS = "doc_id long, text string, n long, score long, rank int, item int, terms string, tfs string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=50):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out, asked = {}, {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, want in asked.items():
        found = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in want if t in c)
            if score:
                found.append((score, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out[item] = [(i, s) for s, i in found[:k]]
    return {i: found for i, found in out.items() if found}


def ranked(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["item_id"], [])) + 1
        out[r["item_id"]].append((r["doc_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(150)] + ["Ünit", "éa", "x1", "數據", "ÀB"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    said = lambda n: " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(vocabulary, weight, k=n))
    rows = [(i, said(rng.choice((3, 20, 20, 60)))) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(900, 990)] + [rows[3], rows[3], (None, rows[3][1]), (None, None), (995, None), (996, ""), (997, " .,;\t\n"), (998, "w1;w2--w3" * 30000)]
    items = [(i, said(12)) for i in range(30)] + [(30, rows[7][1]), (31, None), (32, ""), (33, "never seen words"), (5, "w149 w148"), (None, "éa x1"), (34, "w0"), (35, "w0 w0 W0 w3")]
    path = tmp_path_factory.mktemp("search")
    spark.createDataFrame([(*r, 1, 2, 3, 4, "t", "f") for r in rows], DOCS).repartition(5).write.parquet(f"{path}/d")
    spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, doc_id long").repartition(2).write.parquet(f"{path}/i")
    return spark.read.parquet(f"{path}/d"), spark.read.parquet(f"{path}/i"), rows, items


def test_every_item_against_brute_force(tables):
    docs, items, rows, asked = tables
    assert ranked(ranked_search.search_documents(docs, items)) == brute(rows, asked)


@pytest.mark.parametrize("k", [1, 3])
def test_few_best_in_many_blocks_and_small_steps(tables, monkeypatch, k):
    docs, items, rows, asked = tables
    for name, value in (("BLOCK_TERMS", 60), ("PAIRS", 40), ("SUMS", 30)):
        monkeypatch.setattr(ranked_search, name, value)
    assert ranked(ranked_search.search_documents(docs, items, ranked_search.Ranking(k=k))) == brute(rows, asked, k)


def test_empty_tables(tables):
    docs, items, _, _ = tables
    assert ranked_search.search_documents(docs.limit(0), items).count() == 0
    assert ranked_search.search_documents(docs, items.limit(0)).count() == 0


def test_floors_prune_common_terms_and_nothing_that_counts():
    """Term 0 is in every document and weighs little: it alone can't reach the floor that the kth impact of term 2 sets."""
    most, kth = np.array([10, 40, 100]), np.array([9, 5, 60])
    plan = ranked_search.Plan.of(np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 0, 1]), np.array([1, 2, 3]), most, kth, 2)
    assert plan.floor.tolist() == [60, 9]
    # of item 0 terms 0 and 1 sum to 50; of item 1 term 0 may reach the floor of 9 by itself
    assert plan.rest.tolist() == [50, 0]
    assert plan.by_item[1].tolist() == [0, 1] and sorted(plan.by_term[1].tolist()) == [0, 1, 1]
    tie = ranked_search.Plan.of(np.array([0, 0]), np.array([0, 1]), np.array([1, 1]), np.array([60, 60]), np.array([60, 60]), 1)
    assert tie.rest.tolist() == [0]


def test_best_keeps_ties_in_order():
    best, floor = ranked_search.Best(2), np.zeros(2, dtype=np.int64)
    best.add(np.array([0, 0, 0, 1]), np.array([5, 5, 5, 2]), np.array([9, 0, 4, 1]), np.array([False, True, False, False]), floor)
    assert best.doc.tolist() == [4, 9, 1] and floor.tolist() == [5, 0]


def test_pruning_leaves_few_candidates(spark, tables):
    """The tasks pass on k documents an item at most, and score fewer pairs than there are."""
    docs, items, rows, asked = tables
    out = ranked_search.search_documents(docs, items, ranked_search.Ranking(k=2))
    assert out.groupBy("item_id").count().agg({"count": "max"}).first()[0] <= 2
