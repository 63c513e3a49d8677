"""Splitting documents into chunks, with links between neighbours and the headings they stand under."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.batches import slices
from corpusmill.functions.text import chunk_identity

# Model tokens for each word, and what ends a sentence.
TOKENS_PER_WORD = 1.3
TERMINATORS = (".", "!", "?", "。", "！", "？")
WORD = re.compile(rb"[^ \n\r\t]+")
SPAN = "array<struct<level:int,text:string,offset:int>>"
EDIT = "array<struct<pos:int,removed:int,inserted:int>>"


def tokens_of(n_words: int) -> int:
    """Estimated tokens of so many words, rounded up."""
    return -int(-n_words * TOKENS_PER_WORD // 1)


@dataclass(frozen=True)
class Splitter:
    """Target, overlap and least size of a chunk, in estimated tokens."""

    size: int = 512
    overlap: int = 50
    least: int = 50

    def words(self) -> tuple[int, int, int]:
        """The same in words: (most in a chunk, shared with the next, fewest before a paragraph ends one)."""
        most = max(1, int(self.size / TOKENS_PER_WORD))
        shared = int(self.overlap / TOKENS_PER_WORD)
        return most, most // 4 if shared >= most else shared, int(self.least / TOKENS_PER_WORD)

    def ranges(self, n: int, paragraphs: list[int], sentences: list[int]) -> list[tuple[int, int]]:
        """Word ranges of the chunks of ``n`` words; the lists hold the last words of paragraphs and sentences, in order.

        A chunk ends with the first paragraph of enough words. Without one it ends with the last
        sentence in its second half, or when it is full, and the next one repeats its last words.
        """
        most, shared, fewest = self.words()
        out, at = [], 0
        while n - at > most:
            first = bisect_left(paragraphs, at + max(fewest - 1, 0))
            if first < len(paragraphs) and paragraphs[first] < at + most:
                end = after = paragraphs[first] + 1
            else:
                last = bisect_left(sentences, at + most) - 1
                end = sentences[last] + 1 if last >= 0 and sentences[last] >= at + most // 2 else at + most
                after = end - shared if end - shared > at else end
            out.append((at, end))
            at = after
        return [*out, (at, n)] if n > at else out

    def split(self, text: str) -> list[tuple[str, int, int, int]]:
        """(text, start, end, tokens) of each chunk, offsets in bytes. Words are joined by one space.

        A last chunk of fewer tokens than ``least`` is appended to the one before, words that both hold included.
        """
        raw = text.encode()
        spans = [m.span() for m in WORD.finditer(raw)]
        words = [raw[a:b] for a, b in spans]
        ends = tuple(t.encode() for t in TERMINATORS)
        paragraphs = [i for i, (a, b) in enumerate(zip(spans, spans[1:], strict=False)) if raw.count(b"\n", a[1], b[0]) > 1]
        whole = set(paragraphs)
        sentences = [i for i, w in enumerate(words) if i in whole or w.endswith(ends)]
        if words and (not sentences or sentences[-1] != len(words) - 1):
            sentences.append(len(words) - 1)
        made = [(b" ".join(words[a:b]).decode(), spans[a][0], spans[b - 1][1], tokens_of(b - a)) for a, b in self.ranges(len(words), paragraphs, sentences)]
        if len(made) > 1 and made[-1][3] < self.least:
            (before, start, _, _), (tail, _, end, _) = made[-2:]
            joined = f"{before} {tail}"
            made[-2:] = [(joined, start, end, tokens_of(len(joined.split())))]
        return made


def translate_offset(offset: int, edits: list[tuple[int, int, int]]) -> int:
    """Where an offset of the original lies after ``edits`` (position, removed, inserted), in order; each is held against the offset as shifted so far."""
    for position, removed, inserted in edits:
        if position >= offset:
            break
        offset += inserted - removed
    return offset


def breadcrumb(spans: list[tuple[int, str, int]], start: int, edits: list[tuple[int, int, int]] = ()) -> list[str]:
    """The headings (level, text, offset) that a chunk from ``start`` on stands under, outermost first."""
    open_: list[tuple[int, str]] = []
    for at, level, title in sorted((translate_offset(o, edits), level, title) for level, title, o in spans):
        if at > start:
            break
        open_ = [h for h in open_ if h[0] < level] + [(level, title)]
    return [title for _, title in open_]


def chunk_documents(docs: DataFrame, splitter: Splitter | None = None) -> DataFrame:
    """(document_id, mime, chunk_index, total_chunks, content, start_char_idx, end_char_idx, token_count, section_context).

    ``docs`` has document_id, text, and optionally mime, ``heading_spans`` and ``edits``. A narrow map:
    each row's chunks come from that row. Null, empty and blank texts have no chunks.
    """
    splitter = splitter or Splitter()
    given = set(docs.columns)
    optional = {"mime": "string", "heading_spans": SPAN, "edits": EDIT}
    rows = docs.select("document_id", F.coalesce("text", F.lit("")).alias("text"), *((F.col(c) if c in given else F.lit(None).cast(t).alias(c)) for c, t in optional.items()))
    kind = rows.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            mimes, texts, spans, edits = (batch.column(c) for c in ("mime", "text", "heading_spans", "edits"))
            ids = batch.column("document_id")
            for at, text in enumerate(texts):
                made = splitter.split(text.as_py())
                heads = [(s["level"], s["text"], s["offset"]) for s in spans[at].as_py() or ()]
                shifts = [(e["pos"], e["removed"], e["inserted"]) for e in edits[at].as_py() or ()]
                for i, (content, start, end, tokens) in enumerate(made):
                    out.append((at, mimes[at].as_py(), i, len(made), content, start, end, tokens, breadcrumb(heads, start, shifts)))
            columns = [*zip(*out, strict=True)] or [()] * 9
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names=NAMES)

    return rows.mapInArrow(run, f"document_id {kind}, mime string, chunk_index int, total_chunks int, content string, start_char_idx int, end_char_idx int, token_count int, section_context array<string>")


NAMES = ["document_id", "mime", "chunk_index", "total_chunks", "content", "start_char_idx", "end_char_idx", "token_count", "section_context"]


def identified(chunks: DataFrame) -> DataFrame:
    """Adds ``chunk_id``, the content address of a chunk: its text, type, document and place. No shuffle."""
    return chunks.withColumn("chunk_id", chunk_identity(F.col("content"), F.coalesce("mime", F.lit("")), F.col("document_id").cast("string"), F.col("chunk_index")))


def linked(chunks: DataFrame) -> DataFrame:
    """Adds ``previous_chunk_id`` and ``next_chunk_id`` within the document."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    return chunks.withColumns({"previous_chunk_id": F.lag("chunk_id").over(order), "next_chunk_id": F.lead("chunk_id").over(order)})


def page_of(start: Column, page_offsets: Column) -> Column:
    """The page, from 1, on which an offset lies: how many pages begin at or before it."""
    return F.size(F.filter(page_offsets, lambda o: o <= start))
