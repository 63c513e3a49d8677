"""Embedders: the protocol, instruction prefixes by model and role, and a deterministic one that needs no network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Part of a model's name, its convention, the prefix of queries and that of documents; the first that fits holds.
CONVENTIONS = (
    ("nomic-embed-text", "nomic", "search_query: ", "search_document: "),
    ("nomic-embed", "nomic", "search_query: ", "search_document: "),
    ("multilingual-e5", "e5", "query: ", "passage: "),
    ("e5-", "e5", "query: ", "passage: "),
    ("bge-", "bge", "Represent this sentence for searching relevant passages: ", ""),
)
# Offset basis and prime of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Letters and decimal digits; other numerals end a token.
TOKEN = regex.compile(r"[\p{L}\p{Nd}]+")
BATCH = 32
#: Vectors that a worker holds before it passes them on.
PASSED_ON = 32 * BATCH


class Embedder(Protocol):
    """Turns texts into vectors of one length. It is pickled to the workers, so it opens connections lazily."""

    model: str

    def embed(self, texts: list[str]) -> list[np.ndarray]: ...


@dataclass(frozen=True)
class Prefixer:
    """Instruction prefixes of a model; an override wins for its role and makes the convention ``custom``."""

    model: str
    off: bool = False
    query_override: str = ""
    document_override: str = ""

    def resolved(self) -> tuple[str, str, str]:
        """(convention, query prefix, document prefix)."""
        known = [] if self.off else [c[1:] for c in CONVENTIONS if c[0] in self.model.lower()]
        name, query, document = known[0] if known else ("", "", "")
        if self.query_override or self.document_override:
            name = "custom"
        return name, self.query_override or query, self.document_override or document

    def apply(self, text: Column, role: str) -> Column:
        """The text with its prefix, which is not put twice."""
        prefix = self.resolved()[1 if role == "query" else 2]
        return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text)) if prefix else text


def fnv1a(data: bytes) -> int:
    h = FNV_BASIS
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


class _Buckets(dict):
    """The two buckets of each token as it stands in a text, computed when they are first asked for; starts anew when it is full."""

    def __init__(self, dimensions: int, entries: int) -> None:
        self.dimensions, self.entries = dimensions, entries

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= self.entries:
            self.clear()
        low = token.lower() if token.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in token)
        h = fnv1a(low.encode())
        found = self[token] = ((h & 0xFFFFFFFF) % self.dimensions, (h >> 32) % self.dimensions)
        return found


class HashingEmbedder:
    """Feature hashing: each token adds one to two of 256 buckets, named by the halves of its hash; then unit length.

    The buckets of a token are computed once a worker; the cache starts anew when it is full.
    """

    model = "deterministic-hash-256"
    dimensions = 256
    cache_entries = 200_000

    def __init__(self) -> None:
        self._buckets = _Buckets(self.dimensions, self.cache_entries)

    def __getstate__(self) -> dict:
        return {}

    def __setstate__(self, _: dict) -> None:
        self.__init__()

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        out, buckets = [], self._buckets
        for text in texts:
            at = [b for t in TOKEN.findall(text) for b in buckets[t]]
            counts = np.bincount(at, minlength=self.dimensions).astype(np.float64) if at else np.zeros(self.dimensions)
            norm = np.sqrt((counts**2).sum())
            out.append((counts / norm if norm else counts).astype(np.float32))
        return out


#: Embedders by the name of their model, which a setting may name; others are added by whoever has them.
EMBEDDERS: dict[str, type] = {HashingEmbedder.model: HashingEmbedder}


def embedder_of(model: str) -> Embedder:
    if model not in EMBEDDERS:
        raise KeyError(f"no embedder is registered for {model}")
    return EMBEDDERS[model]()


def embed_rows(rows: DataFrame, embedder: Embedder, key: str, text: str, role: str = "document", prefixer: Prefixer | None = None) -> DataFrame:
    """(key, model, convention, vector) for each row, in batches of 32 texts. Null reads as empty. A narrow map."""
    prefixer = prefixer or Prefixer(embedder.model)
    source = rows.select(F.col(key).alias("key"), prefixer.apply(F.coalesce(F.col(text), F.lit("")), role).alias("text"))
    kind, convention, model = source.schema["key"].dataType.simpleString(), prefixer.resolved()[0], embedder.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PASSED_ON):
                part = batch.slice(low, PASSED_ON)
                n, texts = part.num_rows, part.column("text")
                vectors = [v for at in range(0, n, BATCH) for v in embedder.embed(texts.slice(at, BATCH).to_pylist())]
                made = [pa.array([model] * n, pa.string()), pa.array([convention] * n, pa.string()), pa.array(vectors, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column("key"), *made], names=[key, "model", "convention", "vector"])

    return source.mapInArrow(run, f"{key} {kind}, model string, convention string, vector array<float>")


def embed_missing(chunks: DataFrame, stored: DataFrame, embedder: Embedder, prefixer: Prefixer | None = None) -> DataFrame:
    """Vectors of the chunks that have none from this model; what is stored is not computed again."""
    have = stored.filter(F.col("model") == embedder.model).select("chunk_id")
    return embed_rows(chunks.join(have, "chunk_id", "left_anti"), embedder, "chunk_id", "content", prefixer=prefixer)
