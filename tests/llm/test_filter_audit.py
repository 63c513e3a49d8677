"""The filter interaction audit against a chain that is run filter by filter."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import filter_audit

DOCS = "doc_id long, text string, source string, n long, mask int, part string, good long, digest string"
LABELS = "doc_id long, quality int, toxic int, n long, part string"
LONG = " ".join(f"w{i}" for i in range(220))
TEXTS = [None, "", " \n\t ", LONG, LONG + " # A", LONG.upper(), "x " * 300, "X " * 300, "x $ " * 150, LONG + " é", "one two", LONG, "", LONG.upper(), "word " * 9000]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [(i, t, ("a", "b", None, "")[i % 4]) for i, t in enumerate(TEXTS * 3)]
    rows += [rows[3], rows[3], (None, LONG, "a"), (None, LONG, "a"), (None, "only without id", "b"), (None, "only without id", None), (None, None, None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 40, 2)] + [(4, 1, 0), (4, None, None), (None, 1, 1), (999, 1, 1)]
    path = tmp_path_factory.mktemp("audit")
    spark.createDataFrame([(*r, 1, 2, "p", 3, "d") for r in rows], DOCS).repartition(3).write.parquet(f"{path}/d")
    spark.createDataFrame([(*r, 7, "q") for r in labels], LABELS).write.parquet(f"{path}/l")
    return spark.read.parquet(f"{path}/d"), spark.read.parquet(f"{path}/l"), rows, labels


def fails(rows):
    """For each row the letters of the filters that it fails, one rule after another over plain Python strings."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        bad["E"] = t in least and (i is None or i > least[t])
        out.append({k for k, v in bad.items() if v})
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found, bad = {}, fails(rows)
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, bad[at]) for at, (i, _, s) in enumerate(rows) if (s or "") == part]
        weight = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                weight[f] += len(gone)
                failing = sum(f in b for _, b in mine)
                found[part, "".join(order), k + 1] = [len(left), len(gone), failing - len(gone), sum(b == {f} for _, b in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f]
        for key in found:
            if key[0] == part:
                found[key][-1] = weight[found[key][-1]]
    return found


def test_every_order_against_a_chain_that_is_run(tables):
    docs, labels, rows, marks = tables
    out = filter_audit.filter_audit(docs, labels)
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in out.collect()}
    assert got == brute(rows, marks) and len(got) == 3 * 600


def test_an_empty_table_has_no_parts(tables):
    docs, labels, _, _ = tables
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit.filter_audit(docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_other_filters_make_other_masks(tables):
    docs, labels, rows, _ = tables
    two = {"X": lambda text, words: F.size(words) == 0, "Y": lambda text, words: text.contains("é")}
    out = filter_audit.filter_audit(docs, labels, two)
    assert out.count() == 3 * 6 * 3
    bare = sum(not (t or "").split() for _, t, _ in rows)
    assert out.filter("filter_order LIKE 'X%' AND step = 1").groupBy().sum("removed").first()[0] == 2 * bare


def test_large_groups_of_copies_meet_by_document(spark, tables, tmp_path):
    """A third of the rows share a text: what is joined is dealt by digest and doc_id together, and rows without id are counted first."""
    spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE string(id) END AS text", "'s' AS source").write.parquet(f"{tmp_path}/d")
    cells = filter_audit.mask_cells(spark.read.parquet(f"{tmp_path}/d"), tables[1])
    assert {r["mask"]: r["n"] for r in cells.collect()} == {1: 2001, 17: 999}
