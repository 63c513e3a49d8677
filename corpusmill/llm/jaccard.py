"""N-gram Jaccard join: signature cells choose pivots, triangle-inequality windows replicate what lies near a boundary, crowded windows fall into Voronoi regions recursively, and what no pivot divides is joined by its rarest shingles; exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import body, located, written
from corpusmill.llm.components import connected_components
from corpusmill.llm.exact_dedup import without
from corpusmill.llm.passages import MULTIPLIER, WordHasher, gram_hashes, mixed

#: Nodes and their locators, three numbers each, that may be broadcast: 100 bytes in a hash table, so 50 MB; beyond it the texts are shuffled to them.
BROADCAST_NODES = 500_000
#: Members of a region that meet in one task, and shingles that they have together; a larger region is split by new pivots.
REGION_ROWS, REGION_SHINGLES = 1024, 2_000_000
#: Pivots that a crowded region gets, and how often regions are split.
PIVOTS, DEPTH = 8, 4
#: A region is split where no part has more than this share of it and all parts together, members that stand in several included, no more than so many times its members.
LARGEST, TOGETHER = 0.75, 1.5
#: Bytes of a cell's key that are kept: strangers that share one by chance share too few to be held against each other.
CELL_BYTES = 6
#: Buckets of a region's table of how often its shingles occur, which orders them; any order is exact, a good one makes few pairs.
SKETCH = 1 << 14


@dataclass(frozen=True)
class Rule:
    """Two texts link when ``den`` * intersection >= ``num`` * union of their sets of distinct ``gram``-word shingles."""

    gram: int = 3
    num: int = 90
    den: int = 100
    #: Equal classes that linked sets have beyond the first: this many, and half as many as may differ.
    #: More of them make more and smaller parts, but tell strangers with a common passage from near copies.
    spare: int = 3

    @property
    def radius(self) -> float:
        return 1 - self.num / self.den

    def linked(self, shared: int, a: int, b: int) -> bool:
        return self.den * shared >= self.num * (a + b - shared)


def shingles(words: list[bytes], hasher: WordHasher, gram: int) -> np.ndarray:
    """The distinct shingle hashes in order; a text with fewer words is one shingle, one without words has none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(gram_hashes(hasher(words), min(gram, len(words))) + np.uint64(len(words) < gram))


def words_of(text: bytes) -> list[bytes]:
    """``bytes.lower`` folds A-Z only, and ``bytes.split`` splits where words end."""
    return text.lower().split()


def _pressed(texts: DataFrame) -> DataFrame:
    """(node, text) with each text compressed: what is joined to pairs and regions moves as a third of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([press.compress(t.as_py().encode()) for t in batch.column("text")], pa.binary())], names=["node", "text"])

    return texts.select("node", "text").mapInArrow(run, "node long, text binary")


@lru_cache(maxsize=8)
def size_buckets(rule: Rule) -> list[tuple[int, int, int, int]]:
    """(least size, greatest size, classes, spare classes) of the size regions, each half as large again as the one before.

    Sets that link differ in at most (a + b)(den - num) / (den + num) elements, so of one class
    more than that, a pair has an equal class at least. Sets so small that this bound is 0 link only when equal.
    """
    bound = lambda total: total * (rule.den - rule.num) // (rule.den + rule.num)
    low, out = next(s for s in range(1, 1 << 20) if bound(s + s * rule.den // rule.num) >= 1), []
    while low < 1 << 31:
        high = max(low + 1, low * 3 // 2)
        differ = bound(high - 1 + (high - 1) * rule.den // rule.num)
        spare = rule.spare + differ // 2
        out.append((low, high - 1, differ + 1 + spare, spare))
        low = high
    return out


def cells_of(found: np.ndarray, rule: Rule) -> tuple[np.ndarray, int]:
    """Keys of the cells a set falls in, its part in each class of its size region; a number that the
    shared cells of any linked pair exceed.

    The sizes' own distance, 1 - min/max, never exceeds the Jaccard distance: by the triangle
    inequality a set also belongs to the region below when it lies within the radius of it.
    Empty parts say nothing; only a set with more empty parts than ``spare`` must show them, and
    then so must every set that links with it through empty parts alone. Parts that are empty and
    not shown come off the number: at least ``spare`` + 1 classes are equal, so many of them at most
    by emptiness; of a set that shows its empty parts the other may hide up to ``spare``.
    """
    n, keys, least = len(found), [], None
    for at, (low, high, classes, spare) in enumerate(size_buckets(rule)):
        if n < low:
            break
        if n > high and n * rule.num > high * rule.den:
            continue
        seed = np.uint64((at + 1) * MULTIPLIER & 0xFFFFFFFFFFFFFFFF)
        scattered = mixed(found ^ seed)
        part = (scattered >> np.uint64(16)) % np.uint64(classes)
        order = np.argsort(part, kind="stable")
        sorted_part = part[order]
        starts = np.flatnonzero(np.r_[True, sorted_part[1:] != sorted_part[:-1]])
        sums = np.add.reduceat(scattered[order], starts)
        keys.append(mixed(mixed(sums + seed) + sorted_part[starts]))
        hidden = classes - len(starts)
        need = max(0, spare - hidden)
        least = need if least is None else min(least, need)
        if hidden > spare:
            empty = np.setdiff1d(np.arange(classes, dtype=np.uint64), sorted_part[starts])
            keys.append(mixed(mixed(np.uint64(7) + seed + empty) + empty))
    return np.unique(np.concatenate(keys)).view(np.int64) if keys else np.empty(0, dtype=np.int64), least or 0


def packed(keys: np.ndarray) -> bytes:
    """The first CELL_BYTES of each key, one after another."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :CELL_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    found = np.zeros((len(data) // CELL_BYTES, 8), dtype=np.uint8)
    found[:, :CELL_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, CELL_BYTES)
    return found.reshape(-1).view(np.int64)


def _cells(nodes: DataFrame) -> DataFrame:
    """(node, cell): a row for each cell of a node; two that the kept bytes don't tell apart stay two, as cells are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [unpacked(c.as_py()) for c in batch.column("cells")]
            names = np.repeat(batch.column("node").to_numpy(), [len(c) for c in cells])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *cells]), pa.int64())], names=["node", "cell"])

    return nodes.select("node", "cells").mapInArrow(run, "node long, cell long")


def _sets(rows: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, f, r, n, s1, s2, cells, need): size, 128-bit digest and packed cells of each row's set, and what ``cells_of`` says of them."""
    kept = rows.select("doc_id", "f", "r", body().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sizes, first, second, cells, needs = [], [], [], [], []
            for text in batch.column("text"):
                found = shingles(words_of(text.as_py().encode()), hasher, rule.gram)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                sizes.append(len(found))
                first.append(int.from_bytes(digest[:8], "little", signed=True))
                second.append(int.from_bytes(digest[8:], "little", signed=True))
                keys, need = cells_of(found, rule)
                cells.append(packed(keys))
                needs.append(need)
            made = [pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(cells, pa.binary()), pa.array(needs, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "f", "r")), *made], names=["doc_id", "f", "r", "n", "s1", "s2", "cells", "need"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, f long, r long, n long, s1 long, s2 long, cells binary, need int")


def candidate_regions(nodes: DataFrame) -> DataFrame:
    """(pivot, node): nodes with the pivots of their shared cells. Linked nodes have a pivot in common.

    Linked nodes share more than ``need`` cells of either, so a node with no more shared cells links
    with nothing and goes. A cell's pivot is its member that has most company over all its cells,
    which in a group of near copies is the one nearest to the common text, so most cells of a group
    have one pivot. A node leaves the regions that hold fewest of its cells while those it leaves sum
    to half its ``need`` at most: two linked nodes leave no more than the greater ``need`` together,
    so a cell that they share keeps both. Passages common to many texts so cost little.
    """
    # one shuffle of the cells serves both the count and the join: both sides read the same columns of it
    cells = _cells(nodes).repartition("cell")
    counted = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("_first"), F.max("node").alias("_last")).filter("_first < _last")
    shared = written(cells.join(counted.select("cell", "n"), "cell"), "cells")
    company = shared.groupBy("node").agg(F.count(F.lit(1)).alias("_cells"), F.sum("n").alias("score"))
    busy = company.join(nodes.select("node", "need"), "node").filter("_cells > need").select("node", "score", "need")
    scored = shared.select("node", "cell").join(busy, "node")
    pivots = scored.groupBy("cell").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell", (-F.col("best.minus")).alias("pivot"))
    held = scored.join(pivots, "cell").filter("pivot <> node").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("held"), F.first("need").alias("need"))
    fewest = Window.partitionBy("node").orderBy("held", "pivot").rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn("left", F.sum("held").over(fewest)).filter("left > floor(need / 2)").select("pivot", "node")


def _measured(pairs: DataFrame, rule: Rule) -> DataFrame:
    """(region, pivot, node, distance, linked, size) for rows with both texts. A pivot's set is kept while its rows last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last, mine, unpress = WordHasher(), None, np.empty(0, dtype=np.uint64), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            pivots, distances, links, sizes = batch.column("pivot").to_pylist(), [], [], []
            for at, text in enumerate(batch.column("text")):
                if pivots[at] != last:
                    last, mine = pivots[at], shingles(words_of(unpress(batch.column("pivot_text")[at].as_py())), hasher, rule.gram)
                found = shingles(words_of(unpress(text.as_py())), hasher, rule.gram)
                shared = len(np.intersect1d(mine, found, assume_unique=True))
                distances.append(1 - shared / max(1, len(mine) + len(found) - shared))
                links.append(rule.linked(shared, len(mine), len(found)))
                sizes.append(len(found))
            made = [pa.array(distances, pa.float64()), pa.array(links, pa.bool_()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("region", "pivot", "node")), *made], names=["region", "pivot", "node", "distance", "linked", "size"])

    return pairs.select("region", "pivot", "pivot_text", "node", "text").mapInArrow(run, "region long, pivot long, node long, distance double, linked boolean, size long")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of a pivot and a node with both texts."""
    return pairs.join(texts, "node").join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")


def region_links(nodes: list[int], sets: list[np.ndarray], label: list[int], guest: list[bool], rule: Rule) -> list[tuple[int, int]]:
    """Links between members of one region, no more than join them up: a link inside a found component is left out.

    An index from shingle to members counts intersections. Two members with one label are linked
    through its pivot already (-1 is none), and two guests meet in their own window.
    """
    if len(nodes) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    values, owner = every[order], owner[order]
    label_, guest_ = np.array(label), np.array(guest, dtype=bool)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i, found in enumerate(sets):
        a, b = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
        spread = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        shared = np.bincount(owner[spread], minlength=len(sets))
        fits = rule.den * shared >= rule.num * (sizes + len(found) - shared)
        fits[: i + 1] = False
        fits &= ~((label_ == label_[i]) & (label_ >= 0)) & ~(guest_ & guest_[i])
        for j in np.flatnonzero(fits).tolist():
            if root(i) != root(j):
                parent[root(j)] = root(i)
                links.append((nodes[i], nodes[j]))
    return links


def _pivot_windows(measured: DataFrame, rule: Rule) -> DataFrame:
    """(region, node, label, guest, size): windows of one radius by the distance from the pivot; ``label`` is the pivot where it links, else -1.

    Only regions with a member beyond the radius have links other than through the pivot. By the
    triangle inequality a link joins members of one window or of neighbours, so each also stands
    as guest in the next.
    """
    far = written(measured.filter(~F.col("linked")).groupBy("pivot").agg(F.min("distance").alias("least")), "far")
    width = rule.radius + 1e-9
    held = measured.join(far, "pivot").filter(~F.col("linked") | (F.col("distance") >= F.col("least") - width))
    home = F.floor(F.col("distance") / width).cast("int")
    label = F.when(F.col("linked"), F.col("pivot")).otherwise(F.lit(-1)).alias("label")
    stands = held.select("pivot", "node", label, "size", F.posexplode(F.array(home, home + 1)).alias("guest", "window"))
    return stands.select(F.xxhash64("pivot", "window").alias("region"), "node", "label", (F.col("guest") == 1).alias("guest"), "size")


def _set_of(pressed: bytes, hasher: WordHasher, unpress: Callable[[bytes], bytes], rule: Rule) -> np.ndarray:
    return shingles(words_of(unpress(pressed)), hasher, rule.gram)


def _in_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Members (region, node, ..., blocks) of crowded regions with their texts, each in the block that it has in its region: so many rows and shingles as a task may hold."""
    return members.join(texts, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _to_blocks(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of a region for each of its blocks. Columns are named anew, as what they are grouped with has some of the same."""
    dealt = rows.join(regions.select("region", "blocks"), "region").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return dealt.select(*(F.col(c).alias(c) for c in dealt.columns))


def _voronoi(crowded: DataFrame, regions: DataFrame, texts: DataFrame, rule: Rule, depth: int) -> tuple[DataFrame, DataFrame]:
    """(members, links) of crowded regions (region, node, label, guest, size, blocks) held against new pivots.

    Each region draws up to PIVOTS of its members by a hash. A text is read once, beside all pivots of its region: ``cells``
    are the pivots whose Voronoi region it goes to or visits. It goes to the nearest pivot, and as a visitor
    to every other that is at most twice the radius further: if x and y link and y's
    nearest pivot is q, then d(x, q) <= d(y, q) + r <= d(y, p) + r <= d(x, p) + 2r for x's own pivot p.
    A member that links with a new pivot and had no label takes it as its label.
    """
    draw = F.xxhash64("node", F.lit(depth))
    pivots = crowded.groupBy("region", F.pmod(draw, F.lit(PIVOTS)).alias("part")).agg(F.min_by("node", draw).alias("node")).select("region", "node")
    beside = _to_blocks(pivots.join(texts, "node"), regions)

    def measure(rows: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        hasher, unpress = WordHasher(), zstandard.ZstdDecompressor().decompress
        drawn = drawn.sort_values("node")
        names, sets = drawn["node"].to_numpy(), [_set_of(t, hasher, unpress, rule) for t in drawn["text"]]
        cells, linked = [], []
        for pressed in rows["text"]:
            mine = _set_of(pressed, hasher, unpress, rule)
            shared = [len(np.intersect1d(mine, other, assume_unique=True)) for other in sets]
            away = np.array([1 - n / max(1, len(mine) + len(other) - n) for n, other in zip(shared, sets, strict=True)])
            cells.append(names[away <= away.min() + 2 * rule.radius + 1e-9].tolist())
            linked.append([p for n, other, p in zip(shared, sets, names.tolist(), strict=True) if rule.linked(n, len(mine), len(other))])
        out = rows[["region", "node", "label", "guest", "size", "blocks"]].copy()
        out["label"] = [was if was >= 0 or not found else found[0] for was, found in zip(rows["label"], linked, strict=True)]
        return out.assign(**{name: pd.Series(lists, index=out.index, dtype=object) for name, lists in (("cells", cells), ("linked", linked))})

    met = _in_blocks(crowded, texts).groupBy("region", "block").cogroup(beside.groupBy("region", "block"))
    held = written(met.applyInPandas(measure, "region long, node long, label long, guest boolean, size long, blocks int, cells array<long>, linked array<long>"), "voronoi")
    return held, held.select(F.explode("linked").alias("a"), F.col("node").alias("b")).filter("a <> b")


def _bounded_regions(regions: DataFrame, texts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(small, undivided, links): regions whose members can meet in one task, those that no pivots divide, and links with the pivots that were tried.

    How the parts of a split would come out is counted before any member is written for each of them, so
    a region whose members lie within reach of all pivots stays as it is, once.
    """
    regions, small, undivided, links = written(regions, "windows"), None, None, []
    columns = ["region", "node", "label", "guest", "size"]
    add = lambda found, more: more if found is None else found.unionByName(more)
    for depth in range(DEPTH + 1):
        # written, so that the joins below can be split at a hot region
        sizes = regions.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.min("guest").alias("empty")).filter("n > 1 AND NOT empty")
        sizes = written(sizes.select("region", "n", F.ceil(F.greatest(F.col("n") / REGION_ROWS, F.col("weight") / REGION_SHINGLES)).cast("int").alias("blocks")), "sizes")
        known = regions.select(*columns).join(sizes, "region")
        small = add(small, known.filter("blocks = 1").select(*columns))
        crowded, large = known.filter("blocks > 1").drop("n"), sizes.filter("blocks > 1")
        if not large.limit(1).count():
            break
        if depth == DEPTH:
            undivided = add(undivided, crowded)
            break
        held, more = _voronoi(crowded, large, texts, rule, depth)
        links.append(more)
        parts = held.select("region", F.explode("cells").alias("cell")).groupBy("region", "cell").agg(F.count(F.lit(1)).alias("part"))
        reach = parts.groupBy("region").agg(F.max("part").alias("most"), F.sum("part").alias("all")).join(large, "region")
        fate = written(reach.select("region", ((F.col("most") <= LARGEST * F.col("n")) & (F.col("all") <= TOGETHER * F.col("n"))).alias("splits")), "reach")
        told = held.drop("linked").join(fate, "region")
        undivided = add(undivided, told.filter("NOT splits").select(*columns, "blocks"))
        cells = told.filter("splits").select("region", F.explode("cells").alias("cell"), "node", "label", "guest", "size")
        regions = written(cells.withColumn("region", F.xxhash64("region", "cell", F.lit(depth))).select(*columns), "split")
    return small, undivided, links


def _rare_pairs(members: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(pivot, node): pairs of members of a region that share one of their rarest shingles, where a link between them must show; each pair once.

    With all shingles in one order, the first that linked sets share stands so early in both that what
    follows can still hold their intersection: it is looked for among the first of each set only, and of
    the smaller set among still fewer. The order is by how often a region's shingles occur, counted for
    all its members in a table of SKETCH places, so shingles of a common text stand last and make no pairs.
    """
    members = written(members, "undivided")
    regions = members.select("region", "blocks").distinct()
    dealt = _in_blocks(members, texts)

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hasher, unpress = WordHasher(), zstandard.ZstdDecompressor().decompress
        found = np.zeros(SKETCH, dtype=np.int64)
        for pressed in rows["text"]:
            found += np.bincount((_set_of(pressed, hasher, unpress, rule) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(found)
        return pd.DataFrame({"region": key[0], "bucket": at, "n": found[at]})

    counted = dealt.groupBy("region", "block").applyInPandas(count, "region long, bucket int, n long").groupBy("region", "bucket").agg(F.sum("n").alias("n"))
    tables = written(counted.groupBy("region").agg(F.collect_list(F.struct("bucket", "n")).alias("often")), "shingle-counts")

    def rarest(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        hasher, unpress = WordHasher(), zstandard.ZstdDecompressor().decompress
        often, parts = np.zeros(SKETCH, dtype=np.int64), []
        for pair in (p for listed in table["often"] for p in listed):
            often[pair["bucket"]] = pair["n"]
        for region, node, label, guest, pressed in rows[["region", "node", "label", "guest", "text"]].itertuples(index=False):
            found = _set_of(pressed, hasher, unpress, rule)
            size = len(found)
            first = size - -(-rule.num * size // rule.den) + 1
            order = np.lexsort((found, often[(found % np.uint64(SKETCH)).astype(np.int64)]))[:first]
            parts.append(pd.DataFrame({"region": region, "token": found[order].view(np.int64), "node": node, "label": label, "guest": guest, "size": size, "place": np.arange(len(order))}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("region", "token", "node", "label", "guest", "size", "place")})

    met = dealt.groupBy("region", "block").cogroup(_to_blocks(tables, regions).groupBy("region", "block"))
    tokens = written(met.applyInPandas(rarest, "region long, token long, node long, label long, guest boolean, size long, place int"), "rarest")
    x, y = (tokens.select("region", "token", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "label", "guest", "size", "place"))) for side in "xy")
    total = rule.num + rule.den
    # of two sets the smaller, of equal sizes the one with the smaller node
    y = y.filter(total * (F.col("size_y") - F.col("place_y")) >= 2 * rule.num * F.col("size_y"))
    ordered = (F.col("size_y") < F.col("size_x")) | ((F.col("size_y") == F.col("size_x")) & (F.col("node_y") < F.col("node_x")))
    room = total * F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) >= rule.num * (F.col("size_x") + F.col("size_y"))
    apart = ~((F.col("label_x") == F.col("label_y")) & (F.col("label_x") >= 0)) & ~(F.col("guest_x") & F.col("guest_y"))
    met = x.join(y, ["region", "token"]).filter(ordered & room & apart)
    return met.select(F.col("node_y").alias("pivot"), F.col("node_x").alias("node")).distinct()


def _remaining_links(measured: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links between members of a region other than through its pivot: all members of a small region meet in a task, of an undivided one those that share a rare shingle."""
    small, undivided, links = _bounded_regions(_pivot_windows(measured, rule), texts, rule)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        hasher, unpress = WordHasher(), zstandard.ZstdDecompressor().decompress
        rows = rows.sort_values(["node", "guest"])
        sets = [_set_of(t, hasher, unpress, rule) for t in rows["text"]]
        return pd.DataFrame(region_links(rows["node"].tolist(), sets, *(rows[c].tolist() for c in ("label", "guest")), rule), columns=["a", "b"], dtype="int64")

    found = small.join(texts, "node").groupBy("region").applyInPandas(join, "a long, b long")
    for more in links:
        found = found.unionByName(more)
    if undivided is not None:
        pairs = written(_rare_pairs(undivided, texts, rule), "rare-pairs")
        held = _measured(_with_texts(pairs.withColumn("region", F.col("pivot")), texts), rule)
        found = found.unionByName(held.filter("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    return found


def link_documents(rows: DataFrame, rule: Rule) -> DataFrame:
    """Every row of ``located`` documents: doc_id, f, r, n_shingles, first (locator order within its class) and ``component``."""
    table = written(_sets(rows, rule).withColumn("id", F.monotonically_increasing_id()), "shingle-sets")
    # rows with equal sets are one node; the empty set is a node for each row
    class_key = [F.col("s1"), F.col("s2"), F.when(F.col("n") == 0, F.col("id")).alias("alone")]
    classes = table.select(*class_key, "id").groupBy("s1", "s2", "alone").agg(F.min("id").alias("node"))
    member = table.select("doc_id", "f", "r", "n", "id", *class_key).alias("t").join(classes.alias("c"), (F.col("t.s1") == F.col("c.s1")) & (F.col("t.s2") == F.col("c.s2")) & F.col("t.alone").eqNullSafe(F.col("c.alone")))
    member = written(member.select("t.doc_id", "f", "r", "n", "id", "node"), "members")
    nodes = table.filter("length(cells) > 0").groupBy("s1", "s2").agg(F.min_by("cells", "id").alias("cells"), F.min("need").alias("need"), F.min("id").alias("node")).select("node", "cells", "need")
    regions = written(candidate_regions(nodes), "regions")
    wanted = written(regions.select(F.explode(F.array("pivot", "node")).alias("node")).distinct().join(member.filter("id = node").select("node", "f", "r"), "node"), "wanted")
    small = wanted.count() <= BROADCAST_NODES
    texts = written(_pressed(rows.select("f", "r", body().alias("text")).join(F.broadcast(wanted) if small else wanted, ["f", "r"])), "candidates")
    measured = written(_measured(_with_texts(regions.withColumn("region", F.col("pivot")), texts), rule), "distances")
    links = measured.filter("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")).unionByName(_remaining_links(measured, texts, rule))
    found = connected_components(links)
    placed = member.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = written(placed, "placed")
    # written, so that the join can be split at a large component
    least = written(placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("first")), "firsts")
    return placed.join(least, "component").select("doc_id", "f", "r", F.col("n").alias("n_shingles"), (F.col("id") == F.col("first.id")).alias("stays"), F.col("first.doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Null and empty texts have no shingles and link with nothing; rows with equal sets link; null
    doc_ids come last, so a component of nulls has a null id; repeated rows each give a row; an empty
    table gives none. A very long text is read whole, and texts meet in tasks of bounded bytes.
    Other columns, whatever their names, are not read.
    """
    return link_documents(located(docs.select("doc_id", "text"), ["doc_id", "text"]), rule or Rule()).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The documents with the smallest doc_id of each component, all columns kept, whatever their names.

    Nulls, empty and repeated rows are as in ``jaccard_components``: texts without words all stay,
    and of repeated rows one. An empty table stays empty.
    """
    rows = located(docs)
    return without(rows, link_documents(rows.select("f", "r", "row.doc_id", "row.text"), rule or Rule()).filter("NOT stays"))
