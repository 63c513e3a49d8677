"""Substring deduplication: recurring passages are confirmed, compiled into sharded word automata, and located in all documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import body, located, written

#: Entries of each worker's cache of word hashes.
CACHE_ENTRIES = 500_000
#: Odd multiplier of the rolling hash; any odd number with well-spread bits does.
MULTIPLIER = 0x9E3779B97F4A7C15
#: Documents that share an anchor before its passages are dealt to twice as many salts.
SALT_ROWS = 256
#: Words of a document whose anchors belong to one shard; bounds the passages of an automaton.
PART_WORDS = 256
#: Bytes that are hashed or held as words at once.
SLICE_BYTES = 1 << 20
#: Bytes that end a word.
BLANKS = b" \t\n\v\f\r"


class WordHasher:
    """64-bit hashes of words, the same in every process."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word, so that the least of several values is a fair draw."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(MULTIPLIER)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        total = total * np.uint64(MULTIPLIER) + hashes[i : i + count]
    return mixed(total)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the multiplier and of its inverse, modulo 2**64."""
    up, down = (np.full(n, m, dtype=np.uint64) for m in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A spread number for each byte; 0 for those that end a word."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
    values[list(BLANKS)] = 0
    return values


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of every word, with no object for a word.

    A word's hash is the sum of its bytes' numbers times powers of their places, taken from running
    sums over a slice. Slices end at a blank, so only a word longer than a slice makes a longer one.
    """
    hashes, starts, at = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], 0
    raw, values = np.frombuffer(text, dtype=np.uint8), _byte_values()
    while at < len(raw):
        end = min(at + SLICE_BYTES, len(raw))
        while end < len(raw) and values[raw[end]]:
            ahead = np.flatnonzero(values[raw[end : end + SLICE_BYTES]] == 0)
            end += int(ahead[0]) if len(ahead) else min(SLICE_BYTES, len(raw) - end)
        part = values[raw[at:end]]
        edges = np.flatnonzero(np.diff(part != 0, prepend=False, append=False))
        first, last = edges[::2], edges[1::2]
        up, down = _powers(max(SLICE_BYTES, 1 << (len(part) - 1).bit_length()) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part * up[: len(part)])])
        hashes.append(mixed((sums[last] - sums[first]) * down[first]))
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of every window: the least hash among the grams inside it. Equal windows have equal anchors.

    Neighbouring windows mostly share theirs, so a text has about 2 / (window - gram + 2) distinct
    anchors a word, which is what is shuffled in place of all windows.
    """
    grams = gram_hashes(hashes, gram)
    count = len(hashes) - window + 1
    if count <= 0:
        return np.empty(0, dtype=np.int64)
    least = grams[:count].copy()
    for i in range(1, window - gram + 1):
        np.minimum(least, grams[i : i + count], out=least)
    return least.view(np.int64)


def anchors_of_texts(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct anchors of each text: (text number, anchor, word where the first window with it starts)."""
    joined = b"\n".join(texts)
    hashes, starts = word_hashes(joined)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    of = np.searchsorted(begins, starts, side="right") - 1
    found = anchors(hashes, window, gram)
    inside = np.flatnonzero(of[: len(found)] == of[window - 1 :])
    if not len(inside):
        return (np.empty(0, dtype=np.int64),) * 3
    text, anchor = of[inside], found[inside]
    at = inside - np.searchsorted(of, text)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    text, anchor, at = text[new], anchor[new], at[new]
    order = np.lexsort((at, anchor, text))
    text, anchor, at = text[order], anchor[order], at[order]
    first = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]
    return text[first], anchor[first], at[first]


def order_key(doc_id: str | Column = "doc_id") -> Column:
    """doc_id as an order; null comes after every id."""
    return F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit((1 << 63) - 1))


def _in_slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Numbers of first texts and the texts, in lists that end once they hold SLICE_BYTES."""
    part, size, first = [], 0, 0
    for at, text in enumerate(texts):
        part.append(text.as_py().encode())
        size += len(part[-1])
        if size >= SLICE_BYTES:
            yield first, part
            part, size, first = [], 0, at + 1
    if part:
        yield first, part


def _document_anchors(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, f, r, k, part) for the distinct anchors of each row's text; ``part`` says whereabouts in the text the first one stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, r, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("f", "r", "k"))
            for first, part in _in_slices(batch.column("text")):
                row, anchor, at = anchors_of_texts(part, window, gram)
                row = row + first
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(f[row]), pa.array(r[row]), pa.array(k[row]), pa.array((at // PART_WORDS).astype(np.int32))], names=["h", "f", "r", "k", "part"])

    return texts.select("f", "r", "k", "text").mapInArrow(run, "h long, f long, r long, k long, part int")


def _pressed(texts: DataFrame) -> DataFrame:
    """(f, r, k, doc_id, z): texts compressed one by one, so that a shuffle of them carries a third of the bytes."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([press.compress(t.as_py().encode()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("f", "r", "k", "doc_id")), z], names=["f", "r", "k", "doc_id", "z"])

    return texts.select("f", "r", "k", "doc_id", "text").mapInArrow(run, f"f long, r long, k long, doc_id {kind}, z binary")


def _runs(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """Maximal runs of windows whose anchors recur and have the same owner, part and level, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        names = ["owner", "part", "level", "f", "r", "k", "start", "words"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            f, r, k = (batch.column(c).to_pylist() for c in ("f", "r", "k"))
            size = 0
            for at, z in enumerate(batch.column("z")):
                if not batch.column("recurring")[at].is_valid:
                    continue
                text = unpress.decompress(z.as_py())
                mine = anchors(word_hashes(text)[0], window, gram)
                listed = batch.column("recurring")[at].values
                known, owners, parts, levels = (listed.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                order = np.argsort(known)
                known = known[order]
                where = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                hit = known[where] == mine
                owner, part, level = (np.where(hit, column[order][where], 0) for column in (owners, parts, levels))
                changes = np.zeros(len(mine), dtype=bool)
                for column in (owner, part, level, hit):
                    changes[1:] |= column[1:] != column[:-1]
                cuts = np.flatnonzero(changes)
                words = text.split()
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mine)], strict=True):
                    if b > a and hit[a]:
                        rows.append((int(owner[a]), int(part[a]), int(level[a]), f[at], r[at], k[at], a, b" ".join(words[a : b + window - 1]).decode()))
                        size += len(rows[-1][-1])
                if size >= SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return candidates.select("f", "r", "k", "doc_id", "z", "recurring").mapInArrow(run, "owner long, part int, level int, f long, r long, k long, start int, words string")


class PassageAutomaton:
    """Aho-Corasick over words: windows of passages with the least key that has them, found wherever they recur.

    Passages come by key. What is new waits in ``pending`` and is compiled with the rest once it
    is half as much as what the machine holds, so the work of compiling stays proportional.
    """

    def __init__(self, window: int) -> None:
        self.window, self.ids, self.keys = window, {}, []
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.pending: dict[tuple[int, ...], int] = {}

    def _compile(self) -> None:
        for ids, key in self.pending.items():
            self.machine.add_word(ids, len(self.keys))
            self.keys.append(key)
        self.machine.make_automaton()
        self.pending = {}

    def stream(self, words: list[bytes], key: int) -> tuple[list[int], list[int], list[int]]:
        """Where windows start that a smaller key has, that this key has from another row, and that none has so far; these are kept under ``key``."""
        if len(self.pending) > len(self.keys) // 2:
            self._compile()
        number = self.ids.setdefault
        ids = tuple([number(w, len(self.ids) + 1) for w in words])
        first = {end - self.window + 1: self.keys[at] for end, at in self.machine.iter(ids)} if self.keys else {}
        smaller, same, new = [], [], []
        for i in range(len(ids) - self.window + 1):
            seen = first.get(i)
            if seen is None:
                seen = self.pending.get(passage := ids[i : i + self.window])
                if seen is None:
                    self.pending[passage] = key
            (new if seen is None else smaller if seen < key else same).append(i)
        return smaller, same, new


def _located(dealt: DataFrame, window: int) -> DataFrame:
    """Streams each shard's passages, by key, through the shard's automaton.

    Returns (f, r, start, length) of covered words, with ``open`` null, and where salts split a
    shard, the windows that this salt can't decide, with their text in ``open`` and the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, automaton = None, PassageAutomaton(window)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            shard, level, salt, owner, owns, f, r, k, start = (batch.column(c).to_pylist() for c in ("shard", "level", "salt", "owner", "owns", "f", "r", "k", "start"))
            for at, text in enumerate(batch.column("words")):
                if (now := (shard[at], level[at], salt[at])) != group:
                    group, automaton = now, PassageAutomaton(window)
                words = text.as_py().encode().split()
                smaller, same, new = automaton.stream(words, k[at])
                if level[at] and not owns[at]:
                    # another row of the least key tells other salts only what this one has not heard yet
                    rows += [(f[at], r[at], k[at], start[at] + i, window, b" ".join(words[i : i + window]).decode()) for i in (new if k[at] == owner[at] else sorted([*same, *new]))]
                begin = end = None
                for i in [*smaller, None]:
                    if i is not None and end is not None and i <= end:
                        end = i + window
                        continue
                    if end is not None:
                        rows.append((f[at], r[at], k[at], start[at] + begin, end - begin, None))
                    begin, end = i, None if i is None else i + window
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["f", "r", "k", "start", "length", "open"])

    return dealt.select("shard", "level", "salt", "owner", "owns", "f", "r", "k", "start", "words").mapInArrow(run, "f long, r long, k long, start int, length int, open string")


def _cut(joined: DataFrame, names: list[str]) -> DataFrame:
    """Drops covered words: doc_id, n_words, n_removed, kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            totals, removed, kept = [], [], []
            for z, spans in zip(batch.column("z"), batch.column("spans"), strict=True):
                words = unpress.decompress(z.as_py()).split()
                gone = 0
                if spans.is_valid:
                    stays = np.ones(len(words), dtype=bool)
                    for span in spans.as_py():
                        stays[span["start"] : span["start"] + span["length"]] = False
                    gone = len(words) - int(stays.sum())
                totals.append(len(words))
                removed.append(gone)
                text = b" ".join([words[i] for i in np.flatnonzero(stays)] if gone else words)
                kept.append({"kept_text": text.decode, "kept_sha256": hashlib.sha256(text).hexdigest})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), *(pa.array([made[n]() for made in kept], pa.string()) for n in names)], names=["doc_id", "n_words", "n_removed", *names])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.select("f", "r", "k", "doc_id", "z", "spans").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, " + ", ".join(f"{n} string" for n in names))


def _repeated(texts: DataFrame) -> DataFrame:
    """(f, r, again) of rows whose key an earlier row has: all but one row of each key. Only keys are read, and where each is its own row nothing comes out."""
    keys = texts.select("f", "r", "k")
    often = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    rows = written(keys.join(often, "k"), "repeated-keys")
    first = written(rows.groupBy("k").agg(F.min(F.struct("f", "r")).alias("first")), "first-rows")
    return written(rows.join(first, "k").filter("struct(f, r) <> first").select("f", "r", F.lit(True).alias("again")), "repeated-rows")


def covered_spans(texts: DataFrame, pressed: DataFrame, window: int, gram: int) -> DataFrame:
    """Word spans to remove by row: (f, r, spans).

    1. Anchors that occur in two rows or more are confirmed, each with the least key that has it,
       its owner; every recurring window has a confirmed anchor.
    2. Documents emit the runs of windows around confirmed anchors. A run goes to the shard of its
       owner and of the part of the text where its anchors stand first, so a shard holds passages of
       PART_WORDS words at most of the owner. Anchors of many documents have a level, and level l
       deals them to 2**l salts, each with the owner's run: that of one row, however many rows share the owner's key.
    3. Each shard streams its runs by key past an automaton of the passages before them.
    4. What salts leave open is decided by the least key that has the window, whose whole text is compared.
    """
    found = _document_anchors(texts, window, gram)
    counted = found.groupBy("h").agg(F.min("k").alias("owner"), F.min("part").alias("part"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / SALT_ROWS))).cast("int")
    confirmed = counted.select("h", "owner", "part", level.alias("level"))
    recurring = found.select("h", "f", "r").join(confirmed, "h").groupBy("f", "r").agg(F.collect_list(F.struct("h", "owner", "part", "level")).alias("recurring"))
    # a left join here as in remove_passages, so that both read one exchange of the texts
    runs = _runs(pressed.join(recurring, ["f", "r"], "left"), window, gram)
    runs = runs.join(_repeated(texts), ["f", "r"], "left").withColumn("owns", (F.col("k") == F.col("owner")) & F.col("again").isNull())
    salts = F.call_function("shiftleft", F.lit(1), F.col("level"))
    salt = F.explode(F.when(F.col("owns"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("f", "r"), salts).cast("int"))))
    dealt = runs.select(F.xxhash64("owner", "part").alias("shard"), "level", salt.alias("salt"), "owner", "owns", "f", "r", "k", "start", "words")
    ordered = dealt.repartition("shard", "level", "salt").sortWithinPartitions("shard", "level", "salt", "k", "f", "r", "start")
    # of a window that is left open each salt has one row of its least key at most; covered words stay by themselves
    apart = F.when(F.col("open").isNull(), F.xxhash64("f", "r", "start"))
    marked = _located(ordered, window).withColumn("least", F.min("k").over(Window.partitionBy("open", apart)))
    covered = marked.filter("open IS NULL OR least < k")
    return covered.groupBy("f", "r").agg(F.collect_list(F.struct("start", "length")).alias("spans"))


def remove_passages(docs: DataFrame, window: int = 13, gram: int = 6, returns: tuple[str, ...] = ("kept_text",)) -> DataFrame:
    """Removes each word inside a ``window`` of words that also starts in a document with a smaller doc_id.

    One row per row of ``docs``: doc_id, n_words, n_removed and the kept words joined by one space
    (``kept_text``) or their digest (``kept_sha256``). Windows are judged on the input. Rows are told
    apart by where they are stored, and their order is that of doc_id: rows with the same doc_id
    don't remove one another's words, each is judged on its own text; a null doc_id comes after every
    id. Null text reads as empty; texts shorter than a window lose nothing; an empty table gives no
    rows. A very long text is worked on whole, in memory proportional to it, and its passages go to
    many shards. Other columns, whatever their names, are not read.

    Shuffled: the distinct anchors of each document twice, compressed texts once (the same exchange
    serves both joins), and the candidate runs.
    """
    rows = located(docs.select("doc_id", "text"), ["doc_id", "text"])
    texts = rows.select("f", "r", "doc_id", order_key().alias("k"), body().alias("text"))
    pressed = _pressed(texts)
    return _cut(pressed.join(covered_spans(texts, pressed, window, gram), ["f", "r"], "left"), list(returns))


PASSAGES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, k, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
hit AS (SELECT r, i FROM (SELECT r, k, i, min(k) OVER (PARTITION BY g) AS m FROM win) WHERE m < k),
cov AS (SELECT DISTINCT r, i + j AS i FROM hit, unnest(range(0, 13)) AS o(j)),
word AS (SELECT r, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN cov USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
