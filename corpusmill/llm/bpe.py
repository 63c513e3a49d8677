"""Byte-pair encoding with a contiguous array of part boundaries and adjacent ranks."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words of at most so many bytes are merged side by side; above the last a word takes a heap. All apply the same merges.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128)
#: Entries of each generation of a worker's chunk cache, the length of what goes in, and characters worked on at once.
CACHE_ENTRIES, CACHE_LENGTH, SLICE_CHARS = 200_000, 64, 1_000_000
#: Texts of only these characters are in normal form C, have no white space in dispute, and lower-case one by one.
PLAIN = re.compile(r"[\x09-\x0D\x20-\x7E\xA1-įı-ňŊ-ſ‐-‧]*")


@lru_cache(maxsize=4)
def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


def joined(entries: Iterable[tuple[bytes, str]]) -> tuple[bytes, str]:
    """Ids and decoded text of entries in a row; what has no ids adds no blank."""
    columns = [*zip(*entries, strict=True)]
    return (b"".join(columns[0]), " ".join(filter(None, columns[1]))) if columns else (b"", "")


class WordBpe:
    """Encodes and decodes with the vocabulary file of a word-end BPE tokenizer (lower case, white space dropped).

    ``path`` names a public tokenizer file; normaliser, splitting pattern, merges and vocabulary are read from it.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.path, self.end = path, model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocabulary | self.special).items()}
        pairs = [tuple(pair if isinstance(pair, list) else pair.split(" ")) for pair in model["merges"]]
        self.none = len(pairs)
        vocabulary, self.size = self.vocabulary, max(self.vocabulary.values()) + 1
        left, right = (np.array([vocabulary[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        #: ranks of pairs by (left id, right id), in the order of the keys; what each merge makes
        self.keys, self.key_ranks = keys[order], order
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        stand_in = byte_symbols()
        self.inner = np.array([vocabulary[stand_in[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocabulary[stand_in[b] + self.end] for b in range(256)], dtype=np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._library = None
        #: chunk to its ids and their decoded text; the older generation goes when the younger is full
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts; ``none`` where a pair has no merge or a side is missing (below 0)."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.key_ranks[at], self.none)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and how many each word has. Words of about one length are merged side by side, one row of the arrays each."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        parts = [np.empty(0, dtype=np.int64)]
        count, order, low = np.zeros(len(words), dtype=np.int64), [np.empty(0, dtype=np.int64)], 0
        for high in WIDTHS:
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                found = self._merge_rows([words[i] for i in rows], sizes[rows])
                filled = found >= 0
                parts.append(found[filled])
                count[rows] = filled.sum(axis=1)
                order.append(rows)
            low = high
        for i in np.flatnonzero(sizes > low):
            parts.append(self._merge_long(words[i]))
            count[i] = len(parts[-1])
            order.append(np.array([i]))
        flat, order = np.concatenate(parts), np.concatenate(order)
        if len(parts) > 2:
            # groups of lengths come one after the other; back to the order of the words
            starts = np.zeros(len(words), dtype=np.int64)
            starts[order] = np.cumsum(count[order]) - count[order]
            ends = np.cumsum(count)
            flat = flat[np.repeat(starts - (ends - count), count) + np.arange(len(flat))]
        return flat, count

    def _merge_rows(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """The contiguous rank array: each row holds its parts in order, then -1, and the ranks of neighbours.

        Every step scans a row for the least rank, leftmost first, deletes that boundary, so that
        what is behind moves up by one place, and refreshes the ranks on either side of the new
        part. A row without a merge left is done.
        """
        width = int(sizes.max())
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        parts = np.full((len(words), width + 1), -1, dtype=np.int64)
        parts[np.arange(width + 1) < sizes[:, None]] = self.inner[raw]
        rows = np.arange(len(words))
        parts[rows, sizes - 1] = self.final[raw[np.cumsum(sizes) - 1]]
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        out = np.full_like(parts, -1)
        while len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            going = least != self.none
            if not going.all():
                out[rows[~going], : width + 1] = parts[~going]
                rows, parts, ranks, at, least = rows[going], parts[going], ranks[going], at[going], least[going]
                if not len(rows):
                    break
            lane, made, behind = np.arange(len(rows)), self.made[least], np.arange(width)
            parts = np.take_along_axis(parts, behind + (behind > at[:, None]), axis=1)
            parts[lane, at] = made
            behind = behind[:-1]
            ranks = np.take_along_axis(ranks, behind + (behind >= at[:, None]), axis=1)
            width -= 1
            if not width:
                out[rows, :1] = parts
                break
            behind = np.flatnonzero(at < width)
            ranks[behind, at[behind]] = self.rank(made[behind], parts[behind, at[behind] + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.rank(parts[before, at[before] - 1], made[before])
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges in n log n: a heap of (rank, place) with stale entries skipped."""
        raw = np.frombuffer(word, dtype=np.uint8)
        ids = self.inner[raw]
        ids[-1] = self.final[raw[-1]]
        first = self.rank(ids[:-1], ids[1:])
        parts = ids.tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current = [*first.tolist(), self.none]
        heap = [(r, i) for i, r in enumerate(current) if r != self.none]
        heapq.heapify(heap)
        ranks = self.pair_ranks
        gone = [False] * n

        def refresh(i: int) -> None:
            if i < 0:
                return
            j = after[i]
            current[i] = ranks.get((parts[i], parts[j]), self.none) if j < n else self.none
            if current[i] != self.none:
                heapq.heappush(heap, (current[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if gone[i] or current[i] != r:
                continue
            j = after[i]
            parts[i], gone[j] = int(self.made[r]), True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            refresh(before[i])
            refresh(i)
        return np.array([p for p, out in zip(parts, gone, strict=True) if not out], dtype=np.int64)

    @cached_property
    def pair_ranks(self) -> dict[tuple[int, int], int]:
        return {(int(k) // self.size, int(k) % self.size): int(r) for k, r in zip(self.keys, self.key_ranks, strict=True)}

    def _entries(self, words: list[bytes]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each word."""
        flat, count = self.merge_all(words)
        raw, strings = flat.astype("<u4").tobytes(), [*map(self.strings.__getitem__, flat.tolist())]
        ends = np.cumsum(count).tolist()
        return [(raw[4 * a : 4 * b], strings[a] if b - a == 1 else " ".join(strings[a:b])) for a, b in zip([0, *ends], ends, strict=False)]

    def _chunks(self, wanted: list[str]) -> dict[str, tuple[bytes, str]]:
        """Ids and decoded text of lower-cased runs without white space; words that recur in them are merged once."""
        words: dict[str, int] = {}
        number, findall = words.setdefault, self.pieces.findall
        split = [[number(p, len(words)) for p in findall(c)] for c in wanted]
        entries = self._entries([w.encode() for w in words])
        return {c: entries[at[0]] if len(at) == 1 else joined(entries[i] for i in at) for c, at in zip(wanted, split, strict=True)}

    def _other(self, text: str) -> tuple[bytes, str]:
        """Texts beyond PLAIN: the library's own normaliser and splitter give the words, the merges are ours."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        normal = self._library.normalizer.normalize_str(text)
        back = {c: b for b, c in byte_symbols().items()}
        return joined(self._entries([bytes(back[c] for c in piece) for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(normal) if piece]))

    def code_all(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each whole text its ids, as little-endian unsigned 32-bit integers, and what ``decode`` makes of them. Null reads as empty.

        What the cache lacks of all texts together is merged at once; the rest are lookups.
        """
        if len(self.young) > CACHE_ENTRIES:
            self.young, self.old = {}, self.young
        get, missing, out = self.young.get, set(), []
        for text in texts:
            parts = self._special_split.split(text) if text and self._special_split and "<|" in text else [text or ""]
            coded = []
            for p in filter(None, parts):
                if p in self.special:
                    coded.append(([p], [(np.array([self.special[p]], dtype="<u4").tobytes(), p)]))
                elif PLAIN.fullmatch(p):
                    chunks = p.lower().split()
                    entries = [*map(get, chunks)]
                    if None in entries:
                        missing.update([c for c, e in zip(chunks, entries, strict=True) if e is None])
                    coded.append((chunks, entries))
                else:
                    coded.append(([p], [self._other(p)]))
            out.append(coded)
        found = {c: e for c in missing if (e := self.old.get(c)) is not None}
        found |= self._chunks([c for c in missing if c not in found])
        self.young.update((c, e) for c, e in found.items() if len(c) <= CACHE_LENGTH)
        return [joined(found[c] if e is None else e for chunks, entries in coded for c, e in zip(chunks, entries, strict=True)) for coded in out]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.code_all([text])[0][0], dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so the tokens' strings are joined by one space; special ones stay, unknown ids are left out."""
        found = map(self.strings.get, ids)
        return " ".join([s for s in found if s is not None])


@lru_cache(maxsize=2)
def _codec(path: str) -> WordBpe:
    """One codec for each worker, kept from task to task."""
    return WordBpe(path)


def slices(texts: Iterable[str | None], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Texts in order, in lists that end once they hold ``chars`` characters; bounds what is worked on at once, but for a single long text."""
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every whole text; one row per document.

    A narrow map without shuffle; each worker holds one Arrow batch, the vocabulary and a bounded
    cache. A very long text is worked on whole, in memory proportional to it. Null and empty texts
    have no ids; repeated rows each give a row; an empty table gives no rows; other columns, whatever
    their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for part in slices(t.as_py() for t in batch.column("text")):
                for ids, decoded in codec.code_all(part):
                    counts.append(len(ids) // 4)
                    ids_digests.append(hashlib.sha256(ids).hexdigest())
                    text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
