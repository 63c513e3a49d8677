"""Filter interaction audit: what each filter of a chain removes in every order, from histograms of failure masks. JVM-side only."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import body, written

#: A filter says of a text and its words whether the document fails.
Filter = Callable[[Column, Column], Column]

#: Filters that look at one text. The last bit of a mask is for copies, which only the whole table can tell.
FILTERS: dict[str, Filter] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))) > 2 * F.char_length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
COPIES = "E"


def failure_masks(docs: DataFrame, filters: dict[str, Filter] | None = None, part: str = "source") -> DataFrame:
    """(doc_id, part, digest, mask): one bit for each filter that fails, the first filter's the lowest. One narrow pass over the texts."""
    text = body()
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    bits = [F.when(fails(text, words), 1 << at).otherwise(0) for at, fails in enumerate((filters or FILTERS).values())]
    return docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] | None = None, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by their failure mask, copies included: 2 to the number of filters at most for each part.

    Texts are read once and leave their digest. Its group gives the least doc_id with the text, summed
    per task before the shuffle; a document that isn't found under (digest, least doc_id) is a copy, so a
    group of copies, however large, is dealt out by doc_id. Rows without doc_id are counted by text
    before they meet that table: each is a copy of any that has one, but not of another without.
    """
    bit = 1 << len(filters or FILTERS)
    rows = written(failure_masks(docs, filters, part), "failure-masks")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.filter("doc_id IS NOT NULL").join(least.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copied = F.col("mask") + F.when(F.col("first"), 0).otherwise(bit)
    named = known.groupBy("part", copied.alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    alone = rows.filter("doc_id IS NULL").groupBy("digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(least, "digest", "left")
    nameless = alone.groupBy("part", (F.col("mask") + F.when(F.col("doc_id").isNull(), 0).otherwise(bit)).alias("mask")).agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return named.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def order_report(cells: DataFrame, letters: str) -> DataFrame:
    """Each part's report for every order of the filters, one row a step, from its cells alone.

    For each set of filters a part has the number of documents that pass all of it. What a step keeps,
    removes or would have removed are differences of two of these numbers; a filter's removals over all
    orders weigh each set before it by the orders that begin with that set.
    """
    sets, every = range(1 << len(letters)), (1 << len(letters)) - 1
    passing = lambda c, s: F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c))), F.lit(0)).cast("long")
    tables = cells.groupBy("part").agg(*(F.array(*(passing(c, s) for s in sets)).alias(c) for c in ("n", "good", "toxic")))
    steps = [{"filter_order": "".join(order), "step": at + 1, "place": letters.index(f), "bit": 1 << letters.index(f), "before": sum(1 << letters.index(x) for x in order[:at])} for order in permutations(letters) for at, f in enumerate(order)]
    # one literal, which is folded, in place of as many expressions as there are steps
    literal = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, place: int, bit: int, before: int>>")
    # orders that begin with a set, then the filter: how often its removal after that set counts, as the weights of both passing numbers
    orders = lambda s: factorial(s.bit_count()) * factorial(len(letters) - 1 - s.bit_count())
    weigh = [[-orders(s ^ 1 << at) if s >> at & 1 else orders(s) for s in sets] for at in range(len(letters))]
    shapley = F.array(*(F.aggregate(F.zip_with("n", F.lit(w), lambda x, y: x * y), F.lit(0).cast("long"), lambda x, y: x + y) for w in weigh))
    met = tables.withColumn("weights", shapley).select("part", "n", "good", "toxic", "weights", F.explode(literal).alias("at")).select("*", "at.*")
    before, after, bit = F.col("before"), F.col("before").bitwiseOR(F.col("bit")), F.col("bit")
    of = lambda c, s: F.col(c)[s]
    removed = of("n", before) - of("n", after)
    failing = of("n", F.lit(0)) - of("n", bit)
    unique = of("n", F.lit(every).bitwiseXOR(bit)) - of("n", F.lit(every))
    lost = {f"{c}_lost": of(c, before) - of(c, after) for c in ("good", "toxic")}
    mine = F.col("weights")[F.col("place")]
    return met.select("part", "filter_order", "step", of("n", after).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"), unique.alias("unique_fails"), *(v.alias(k) for k, v in lost.items()), mine.alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] | None = None, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty; a null part is the empty one. A document is a copy when a smaller doc_id has
    its text; rows that share doc_id and text are copies of each other in neither direction, and rows
    without doc_id come after all that have one. Of repeated labels one that says 1 is enough;
    a null label says nothing. An empty table has no parts and no rows. Other columns are not read.
    """
    return order_report(mask_cells(docs.select("doc_id", "text", part), labels.select("doc_id", "quality", "toxic"), filters, part), "".join(filters or FILTERS) + COPIES)


FILTER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g'))) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': least IS NOT NULL AND (w.doc_id IS NULL OR w.doc_id > least)} AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT o, k, o[k] AS f, string_split(o[1:k - 1], '') AS earlier, list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: y <> o[k]) AS others FROM orders, unnest(range(1, 6)) AS u(k)),
s AS (SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, f, n, good, toxic, fails[f] AS bad, len(list_filter(earlier, lambda y: y <> '' AND fails[y])) > 0 AS gone, len(list_filter(others, lambda y: fails[y])) = 0 AS alone FROM steps, c),
r AS (SELECT part, filter_order, step, f, CAST(sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN bad AND alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
