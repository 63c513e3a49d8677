"""Sequence packing: Martello-Toth reduction on the histogram of lengths, then best fit."""

from __future__ import annotations

import bisect
import json
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.bpe import byte_symbols
from corpusmill.llm.common import written

#: Pieces that one task numbers at most on average, of those of one length.
BUCKET_ROWS = 200_000
# Fixed value: the splitting pattern of byte-level BPE files whose pre-tokenizer is ByteLevel with use_regex, with
# possessive repeats: a run that is taken whole never has to be given back.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@dataclass
class Interval:
    """Items of one size, ranks ``first`` to ``first + count - 1``: ``each`` in a sequence, from ``offset``, in sequences from ``sequence`` on."""

    first: int
    count: int
    each: int
    sequence: int
    offset: int


@dataclass
class _Group:
    """``count`` sequences with the same contents: (size, items, rank of the first item)."""

    count: int
    free: int
    parts: list[tuple[int, int, int]] = field(default_factory=list)


def reduce_instance(left: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Martello-Toth reduction: fixes sets that dominate every other set with their largest item.

    ``left`` maps sizes to counts and shrinks in place. From the largest size j down, with r the
    room beside j: an item of exactly r dominates all that could stand there; with room for no
    other item j stands alone; with room for only one more, the largest that fits dominates; with
    room for only two more, the pair (a, b) does when a is the largest that fits, b the largest
    that fits with it, and no item of at most r/2 exceeds b. Returns (sizes, how often).
    """
    fixed: list[tuple[list[int], int]] = []

    def fix(sizes: list[int], times: int) -> None:
        fixed.append((sizes, times))
        for s in sizes:
            left[s] -= times
            if not left[s]:
                del left[s]

    def least_sum(n: int, without: int) -> int | None:
        """The sum of the n smallest items beside one of size ``without``."""
        total = 0
        for s in sorted(left):
            take = min(n, left[s] - (s == without))
            total, n = total + take * s, n - take
            if not n:
                return total
        return None

    for j in sorted(left, reverse=True):
        room = capacity - j
        while left.get(j):
            if room > 0 and room in left and (room != j or left[j] > 1):
                fix([j, room], left[j] // 2 if room == j else min(left[j], left[room]))
                continue
            one, two, three = (least_sum(n, j) for n in (1, 2, 3))
            fits = sorted(s for s in left if s <= room and (s != j or left[j] > 1))
            if one is None or one > room:
                fix([j], left[j])
            elif two is None or two > room:
                k = fits[-1]
                fix([j, k], left[j] // 2 if k == j else min(left[j], left[k]))
            elif three is None or three > room:
                a = fits[-1]
                seconds = [s for s in fits if s <= room - a and left[s] > (s == a) + (s == j)]
                halves = [s for s in fits if s <= room // 2]
                if seconds and (not halves or seconds[-1] >= halves[-1]):
                    fix([j, a, seconds[-1]], 1)
                else:
                    break
            else:
                break
    return fixed


def pack_histogram(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[Interval]], int, int]:
    """Plans the packing of ``histogram`` (size to count): intervals by size, sequences used, items fixed by the reduction.

    Equal items and equal sequences are handled by count, so the work depends on the capacity,
    which bounds the histogram, and not on the number of items.
    """
    left, used = dict(histogram), dict.fromkeys(histogram, 0)
    groups: list[_Group] = []
    n_fixed = 0

    def take(size: int, n: int) -> int:
        used[size] += n
        return used[size] - n

    for sizes, times in reduce_instance(left, capacity):
        n_fixed += times * len(sizes)
        group = _Group(times, capacity - sum(sizes))
        for size in sorted(set(sizes), reverse=True):
            each = sizes.count(size)
            group.parts.append((size, each, take(size, times * each)))
        groups.append(group)
    by_room: dict[int, list[_Group]] = {}
    rooms: list[int] = []

    def put(group: _Group) -> None:
        if group.free not in by_room:
            by_room[group.free] = []
            bisect.insort(rooms, group.free)
        by_room[group.free].append(group)

    for group in groups:
        if group.free:
            put(group)
    done = [g for g in groups if not g.free]
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                group = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, group = capacity, _Group(-(-n // (capacity // size)), capacity)
            each = min(room // size, n)
            full = min(group.count, n // each)
            if full < group.count:
                put(rest := _Group(group.count - full, room, []))
                # the first item of the rest follows those that stay with the full sequences
                rest.parts = [(s, e, first + full * e) for s, e, first in group.parts]
            group.count, group.free = full, room - each * size
            group.parts = [*group.parts, (size, each, take(size, each * full))]
            n -= each * full
            if group.free:
                put(group)
            else:
                done.append(group)
    plan: dict[int, list[Interval]] = {s: [] for s in histogram}
    sequence = 0
    for group in [*done, *(g for r in rooms for g in by_room[r])]:
        offset = 0
        if not group.parts:
            continue
        for size, each, first in group.parts:
            plan[size].append(Interval(first, each * group.count, each, sequence, offset))
            offset += size * each
        sequence += group.count
    for intervals in plan.values():
        intervals.sort(key=lambda i: i.first)
    return plan, sequence, n_fixed


class ByteEncoder:
    """Token ids as the tokenizers library gives them, by the merges of the same file.

    Texts with a special token in them go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte_of = {c: b for b, c in byte_symbols().items()}
        vocabulary = {bytes(byte_of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.merges = tiktoken.Encoding("merges", pat_str=PIECES, mergeable_ranks=vocabulary, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null reads as empty."""
        text = text or ""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return array("I", self.merges.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> ByteEncoder:
    """The encoder of a Python worker: loaded once, it serves all tasks that the worker runs."""
    return ByteEncoder(path)


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: (doc_id, piece, start, length, ids_crc32). The first piece of a long document takes the remainder."""
    kept = docs.select("doc_id", "text")
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in batches:
            counts, sums = [], []
            for text in batch.column("text"):
                ids = encoder.encode(text.as_py()) + end
                n = len(ids) // 4
                cuts = range(n % capacity or capacity, n + 1, capacity)
                counts.append(n)
                sums += [zlib.crc32(ids[4 * max(0, c - capacity) : 4 * c]) for c in cuts]
            n = np.array(counts, dtype=np.int64)
            per = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), per)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            first = (n % capacity)[row]
            first[first == 0] = capacity
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            made = [piece.astype(np.int32), start, np.where(piece == 0, first, capacity), np.array(sums, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *map(pa.array, made)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return kept.mapInArrow(run, schema)


def place(numbered: DataFrame, plan: dict[int, list[Interval]]) -> DataFrame:
    """Turns (length, rank within that length) into (sequence_id, offset) by the plan, whose size the capacity bounds."""
    tables = {s: tuple(np.array([getattr(i, k) for i in v], dtype=np.int64) for k in ("first", "each", "sequence", "offset")) for s, v in plan.items()}
    names = [c for c in numbered.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                first, each, start, base = tables[int(size)]
                which = np.searchsorted(first, ranks[rows], side="right") - 1
                at = ranks[rows] - first[which]
                sequence[rows] = start[which] + at // each[which]
                offset[rows] = base[which] + at % each[which] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "_rank")
    return numbered.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the greatest of Martello and Toth's bounds over all thresholds.

    For a threshold t, items above capacity - t stand alone, those above half take a sequence each,
    and the items from t to half must go beside those up to capacity - t or into further sequences.
    """
    sizes = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    best = 0
    for t in [0, *(int(s) for s in sizes if 2 * s <= capacity)]:
        alone = int(counts[sizes > capacity - t].sum())
        large = (sizes <= capacity - t) & (2 * sizes > capacity)
        small = (sizes >= t) & (2 * sizes <= capacity)
        n_large = int(counts[large].sum())
        room = n_large * capacity - int((sizes * counts)[large].sum())
        best = max(best, alone + n_large + max(0, -(-(int((sizes * counts)[small].sum()) - room) // capacity)))
    return best


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens; one row per piece.

    Texts are encoded once and only small rows are shuffled. What reaches the driver is the
    histogram of lengths, at most ``capacity`` rows. Ranks within a length are counted per (length,
    bucket of the document); there are so many buckets that one holds ``bucket_rows`` pieces on
    average, so a length that most pieces share is split over as many tasks as its pieces need.
    Null and empty texts are a piece of the end token alone; repeated rows are packed each; null
    doc_ids stay null; an empty table gives no rows; a very long text is encoded whole, in memory
    proportional to it; other columns, whatever their names, are not read.
    """
    pieces = written(tokenized_pieces(docs, path, capacity, end_id), "pieces")
    buckets = max(64, -(-pieces.count() // bucket_rows))
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = written(pieces.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan, _, _ = pack_histogram(histogram, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_at", F.row_number().over(within) - 1)
    # the pieces are dealt by these two columns already, so only the starts move; they are broadcast where Spark finds them small
    numbered = ranked.join(starts, ["length", "_bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_start") + F.col("_at")).alias("_rank"))
    return place(numbered, plan)
