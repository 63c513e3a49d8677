"""Merkle fixity audit of WARC replicas: each replica has a tree of its own, and only mismatching branches are read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import columns_named, written

CRLF = "\r\n"
#: A page's records are dealt to so many buckets by the first two digits of their hashes, so a page that most records share is many leaves.
BUCKET_DIGITS = 2
#: Mismatching nodes whose numbers are pushed into the scan of the level below; beyond it the scan reads their range.
PUSHED_NODES = 256


def warc_record(uri: Column, html: Column) -> Column:
    """A response record: header fields, blank line, payload, two line ends. Null reads as empty."""
    payload = F.coalesce(html, F.lit(""))
    head = [F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit(f"{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF * 2)]
    return F.concat(*head, payload, F.lit(CRLF * 2))


def record_hashes(pages: DataFrame) -> DataFrame:
    """(page_id, bucket, url, hash, length, n): the distinct records with how often each occurs, counted per task before the shuffle."""
    page_id, url, html = columns_named(["page_id", "url", "html"])
    record = warc_record(url, html)
    digest = F.sha2(F.encode(F.concat(F.lit("record:"), record), "UTF-8"), 256)
    hashed = pages.select(page_id.cast("long").alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), digest.alias("hash"), F.octet_length(record).cast("long").alias("length"))
    counted = hashed.groupBy("page_id", "url", "hash", "length").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("page_id", F.substring("hash", 1, BUCKET_DIGITS).alias("bucket"), "url", "hash", "length", "n")


@dataclass
class Tree:
    """A replica's records and the levels of nodes (node, bucket, hash, length) above them.

    The leaves are buckets of a page's records. Above them stands the page, then aligned ranges
    of ``2 ** shift`` times as many pages at each level, so a record that one replica lacks moves no
    node of the other. Pages without an id are a branch of their own at each level.
    """

    records: DataFrame
    levels: list[DataFrame] = field(default_factory=list)
    shift: int = 8

    def root(self) -> str:
        """The hash over the nodes of the top level: two ranges at most and the pages without an id."""
        top = self.levels[-1].orderBy(F.col("node").asc_nulls_last()).collect()
        return "|".join(f"{r['node'] is None}:{r['length']}:{r['hash']}" for r in top)


def _store(nodes: DataFrame, name: str) -> DataFrame:
    """Writes nodes by range, so that a scan for a few of them skips what lies elsewhere."""
    return written(nodes.repartitionByRange("node", "bucket").sortWithinPartitions("node", "bucket"), name)


def _parents(nodes: DataFrame, shift: int) -> DataFrame:
    """Hashes the children of each node in order: the place of a child, the range of offsets it takes up, and its hash.

    Offsets count from the node's own start, so a record that grows changes its own branch only. A
    node has 2 ** shift children at most, a page as many as there are buckets.
    """
    child = F.struct(F.col("node").alias("at"), "bucket", "length", "hash")
    kept = nodes.select((F.shiftright("node", shift) if shift else F.col("node")).alias("node"), child.alias("child"))
    grouped = kept.groupBy("node").agg(F.array_sort(F.collect_list("child")).alias("children"), F.sum("child.length").alias("length"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("said"))

    def step(s: Column, c: Column) -> Column:
        end = s["end"] + c["length"]
        place = F.concat_ws(":", F.coalesce(c["at"].cast("string"), F.lit("none")), c["bucket"], s["end"].cast("string"), end.cast("string"), c["hash"])
        return F.struct(end.alias("end"), F.concat(s["said"], place, F.lit(",")).alias("said"))

    said = F.aggregate("children", start, step)["said"]
    return grouped.select("node", F.lit("").alias("bucket"), F.sha2(F.concat(F.lit("range:"), said), 256).alias("hash"), "length")


def build_tree(pages: DataFrame, name: str, bounds: tuple[int, int] | None = None, shift: int = 8) -> Tree:
    """The tree of a replica from its own records and their order; ``bounds`` (least and greatest id) fixes its height."""
    records = written(record_hashes(pages).repartitionByRange("page_id", "bucket").sortWithinPartitions("page_id", "bucket", "hash"), f"{name}-records")
    low, high = bounds if bounds is not None else id_bounds(records)
    # a leaf's hash is over the sums of its records' hashes, 64 bits at a time, so that equal and hot records are summed before the shuffle
    limbs = [F.sum(F.conv(F.substring("hash", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") * F.col("n")).alias(f"x{i}") for i in range(4)]
    summed = records.groupBy(F.col("page_id").alias("node"), "bucket").agg(F.sum("n").alias("n"), F.sum(F.col("length") * F.col("n")).alias("length"), *limbs)
    digest = F.sha2(F.concat_ws(":", F.lit("leaf"), F.col("n").cast("string"), *(F.col(f"x{i}").cast("string") for i in range(4))), 256)
    tree = Tree(records, [_store(summed.select("node", "bucket", digest.alias("hash"), "length"), f"{name}-leaves")], shift)
    tree.levels.append(_store(_parents(tree.levels[-1], 0), f"{name}-pages"))
    while high - low > 1:
        # a 2 ** shift-th of the pages or fewer
        tree.levels.append(written(_parents(tree.levels[-1], shift), f"{name}-ranges"))
        low, high = low >> shift, high >> shift
    return tree


def id_bounds(pages: DataFrame) -> tuple[int, int]:
    """The least and the greatest page_id; (0, 0) where there is none."""
    low, high = pages.agg(F.min(F.col("page_id").cast("long")), F.max(F.col("page_id").cast("long"))).first()
    return (low, high) if low is not None else (0, 0)


def _under(nodes: DataFrame, bad: DataFrame, shift: int) -> DataFrame:
    """Those of ``nodes`` whose parent is in ``bad``. What the scan can skip is named in a filter that Parquet sees."""
    few = [r["node"] for r in bad.select("node").limit(PUSHED_NODES + 1).collect()]
    numbers = [n for n in few if n is not None]
    if len(few) <= PUSHED_NODES:
        ranges = F.lit(False)
        for n in numbers:
            ranges = ranges | F.col("node").between(n << shift, ((n + 1) << shift) - 1)
        pushed = nodes.filter(ranges | F.col("node").isNull() if len(numbers) < len(few) else ranges)
    else:
        low, high = bad.agg(F.min("node"), F.max("node")).first()
        pushed = nodes.filter(F.col("node").isNull() | F.col("node").between(low << shift, ((high + 1) << shift) - 1))
    parent = F.shiftright("node", shift) if shift else F.col("node")
    return pushed.withColumn("up", parent).alias("c").join(bad.select(F.col("node").alias("up")).distinct().alias("b"), F.col("c.up").eqNullSafe(F.col("b.up")), "left_semi").drop("up")


def descend(primary: Tree, replica: Tree) -> tuple[DataFrame | None, list[int]]:
    """(node, bucket) of the leaves that differ, and how many nodes were compared at each level from the top.

    Equal roots end it: nothing below is read. Otherwise each level reads the children of the
    nodes that differ one level up, in both trees, and nothing else.
    """
    if primary.root() == replica.root():
        return None, []
    bad, compared = None, []
    heights = range(len(primary.levels) - 1, -1, -1)
    for height in heights:
        a, b = primary.levels[height], replica.levels[height]
        if bad is not None:
            shift = 0 if height == 0 else primary.shift
            a, b = _under(a, bad, shift), _under(b, bad, shift)
        a, b = a.alias("a"), b.alias("b")
        same = F.col("a.node").eqNullSafe(F.col("b.node")) & (F.col("a.bucket") == F.col("b.bucket"))
        both = a.join(b, same, "full_outer").select(F.coalesce("a.node", "b.node").alias("node"), F.coalesce("a.bucket", "b.bucket").alias("bucket"), (F.col("a.hash").eqNullSafe(F.col("b.hash")) & F.col("a.length").eqNullSafe(F.col("b.length"))).alias("equal"))
        both = written(both, "compared")
        compared.append(both.count())
        bad = both.filter("NOT equal").select("node", "bucket")
    return bad, compared


def _suspects(records: DataFrame, bad: DataFrame) -> DataFrame:
    """The records of the leaves that differ."""
    leaves = bad.select(F.col("node").alias("page"), F.col("bucket").alias("part")).alias("b")
    few = bad.select("node").distinct().limit(PUSHED_NODES + 1).collect()
    if len(few) <= PUSHED_NODES:
        numbers = [r["node"] for r in few if r["node"] is not None]
        records = records.filter(F.col("page_id").isin(numbers) | F.col("page_id").isNull() if len(numbers) < len(few) else F.col("page_id").isin(numbers))
    return records.join(leaves, F.col("page_id").eqNullSafe(F.col("b.page")) & (records["bucket"] == F.col("b.part")), "left_semi")


def damage(primary: Tree, replica: Tree, bad: DataFrame) -> DataFrame:
    """(page_id, url, hash, length, status, first, n): copies ``first`` to ``first + n - 1`` of a record, counted from 0, with what is wrong of them.

    Only the leaves that differ are compared record by record. Records of one page and url that
    either replica has more of are paired by hash: a pair is ``corrupt``, what is left over is
    ``missing`` from the replica or ``extra`` in it.
    """
    key = ["page_id", "url", "hash", "length"]
    sides = [_suspects(t.records, bad).select(*key, F.when(F.lit(own), F.col("n")).otherwise(0).alias("a"), F.when(F.lit(own), 0).otherwise(F.col("n")).alias("b")) for t, own in ((primary, True), (replica, False))]
    counted = sides[0].unionByName(sides[1]).groupBy(*key).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a <> b")
    surplus = counted.select(*key, F.least("a", "b").alias("shared"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("a"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("b"))
    page = Window.partitionBy("page_id", "url")
    before = page.orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = surplus.select("*", F.least(F.sum("a").over(page), F.sum("b").over(page)).alias("pairs"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "ab"))
    paired = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("pairs") - F.col(f"{c}_before")))
    said = F.array(
        F.struct(F.lit("corrupt").alias("status"), F.col("shared").alias("first"), paired("a").alias("n")),
        F.struct(F.lit("missing").alias("status"), (F.col("shared") + paired("a")).alias("first"), (F.col("a") - paired("a")).alias("n")),
        F.struct(F.lit("extra").alias("status"), (F.col("shared") + paired("b")).alias("first"), (F.col("b") - paired("b")).alias("n")),
    )
    return placed.select(*key, F.explode(said).alias("s")).select(*key, "s.status", "s.first", "s.n").filter("n > 0")


def _places(records: DataFrame, records_per_file: int) -> DataFrame:
    """Adds warc_file, and the leaf and offset of each record's first copy in it; a file holds a range of page ids, and pages without an id have one more.

    Sums by (page, bucket) come first and are run up within a file, so a page that most records share is no single task's.
    """
    filed = records.withColumn("warc_file", F.floor(F.col("page_id") / F.lit(records_per_file)).cast("long"))
    part = ["warc_file", "page_id", "bucket"]
    sums = filed.groupBy(*part).agg(F.sum("n").alias("rows"), F.sum(F.col("length") * F.col("n")).alias("bytes"))
    above = Window.partitionBy("warc_file").orderBy("page_id", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*part, *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("rows", "bytes")))
    within = Window.partitionBy(*part).orderBy("hash", "url").rowsBetween(Window.unboundedPreceding, -1)
    ordered = filed.select("*", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("length") * F.col("n")).over(within), F.lit(0)).alias("bytes"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in part]
    placed = ordered.alias("r").join(starts.alias("s"), same)
    return placed.select(*(F.col(f"r.{c}").alias(c) for c in records.columns), F.col("r.warc_file").alias("warc_file"), (F.col("rows") + F.col("rows_above")).alias("leaf"), (F.col("bytes") + F.col("bytes_above")).alias("offset"))


def audit(primary: DataFrame, replica: DataFrame, records_per_file: int = 4096, shift: int = 8) -> DataFrame:
    """Every record with its file, place, length, hash and what the replica has of it: ok, corrupt, missing or extra.

    Each replica's bytes are read once, and its tree is built from its own records; replicas meet at
    their roots, and below only where nodes differ. Equal roots: every record is ok, and no leaf of
    one is held against the other. In a file records stand by page, then by hash.

    Null pages are empty payloads and null urls empty; pages without an id are in a file without a
    number; repeated rows are records of their own, counted as one with a number of copies until the
    result; a very long page is hashed whole; a record that only the replica has follows with no
    place. Two empty tables give no rows. Other columns, whatever their names, are not read.
    """
    key = ["page_id", "url", "html"]
    both = [df.select(*columns_named(key)) for df in (primary, replica)]
    ends = [id_bounds(df) for df in both]
    bounds = (min(e[0] for e in ends), max(e[1] for e in ends))
    a, b = (build_tree(df, name, bounds, shift) for df, name in zip(both, ("primary", "replica"), strict=True))
    placed = _places(a.records, records_per_file)
    bad, _ = descend(a, b)
    identity = ["page_id", "url", "hash", "length"]
    if bad is None:
        marked = placed.withColumn("wrong", F.lit(None).cast("array<struct<status:string,first:bigint,n:bigint>>"))
        extra = None
    else:
        found = written(damage(a, b, bad), "damage")
        wrong = found.filter("status <> 'extra'").groupBy(*identity).agg(F.collect_list(F.struct("status", "first", "n")).alias("wrong"))
        same = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in identity]
        marked = placed.alias("p").join(wrong.alias("w"), same, "left").select("p.*", "w.wrong")
        extra = found.filter("status = 'extra'").select("page_id", F.lit(None).cast("long").alias("warc_file"), F.lit(None).cast("long").alias("leaf"), F.lit(None).cast("long").alias("offset"), "length", F.col("hash").alias("record_sha256"), "status", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).drop("copy")
    copies = marked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    hit = F.filter("wrong", lambda w: F.col("copy").between(w["first"], w["first"] + w["n"] - 1))
    rows = copies.select("page_id", "warc_file", (F.col("leaf") + F.col("copy")).alias("leaf"), (F.col("offset") + F.col("copy") * F.col("length")).alias("offset"), "length", F.col("hash").alias("record_sha256"), F.coalesce(F.get(hit, F.lit(0))["status"], F.lit("ok")).alias("status"))
    return rows.unionByName(extra) if extra is not None else rows


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica with known damage by page_id, for audits: of each 997 ids one payload is altered and one record lost."""
    hit = lambda n: F.coalesce(F.pmod("page_id", F.lit(997)) == n, F.lit(False))
    return pages.filter(~hit(6)).withColumn("html", F.when(hit(5), F.concat(F.coalesce("html", F.lit("")), F.lit("?"))).otherwise(F.col("html")))


FIXITY_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, CAST(floor(page_id / 4096.0) AS BIGINT) AS f FROM pages),
q AS (SELECT page_id, url, CASE WHEN page_id % 997 = 5 THEN html || '?' ELSE html END AS html FROM p WHERE page_id % 997 <> 6),
crlf AS (SELECT chr(13) || chr(10) AS e),
r AS (SELECT page_id, url, f, 'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || url || e || 'Content-Length: ' || strlen(html) || e || e || html || e || e AS rec FROM p, crlf),
s AS (SELECT page_id, url, 'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || url || e || 'Content-Length: ' || strlen(html) || e || e || html || e || e AS rec FROM q, crlf),
h AS (SELECT *, sha256('record:' || rec) AS hash FROM r)
SELECT h.page_id, f AS warc_file, row_number() OVER w - 1 AS leaf, CAST(coalesce(sum(strlen(h.rec)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, CAST(strlen(h.rec) AS BIGINT) AS length,
  hash AS record_sha256, CASE WHEN s.rec IS NULL THEN 'missing' WHEN s.rec <> h.rec THEN 'corrupt' ELSE 'ok' END AS status
FROM h LEFT JOIN s ON s.page_id = h.page_id AND s.url = h.url WINDOW w AS (PARTITION BY f ORDER BY h.page_id, hash)
"""
