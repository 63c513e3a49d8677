"""What can be put in place of a part: structural types, met by any object with these methods."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame

from corpusmill.functions.embedding import Embedder
from corpusmill.operators.rerank import Reranker
from corpusmill.sources.readers import Parsed


class FileReader(Protocol):
    """From a file's bytes to what is in it."""

    def __call__(self, raw: bytes) -> Parsed: ...


class VectorIndex(Protocol):
    """Nearest vectors of a batch of queries: those of another length are skipped, equal scores go by id, and many may ask at once."""

    def search(self, queries: DataFrame, pool: int) -> DataFrame: ...


class QueryTransformer(Protocol):
    """From a query as typed to the one that is searched."""

    def transform(self, query: Column) -> Column: ...


class QueryClassifier(Protocol):
    """How many results a query's words ask for; 0 for no opinion."""

    def depth(self, query: Column) -> Column: ...


class Detector(Protocol):
    """Adds score, level and matched phrases to rows with a text column."""

    def detect(self, rows: DataFrame, text: str) -> DataFrame: ...


class Enricher(Protocol):
    """Tags and a summary for the beginning of a document; pickled to the workers."""

    model: str

    def enrich(self, text: str) -> tuple[list[str], str]: ...


class Captioner(Protocol):
    """What an image shows, in words; pickled to the workers."""

    model: str

    def caption(self, image: bytes) -> str: ...


Searcher = Callable[[DataFrame, int], DataFrame]

__all__ = ["Captioner", "Detector", "Embedder", "Enricher", "FileReader", "QueryClassifier", "QueryTransformer", "Reranker", "Searcher", "VectorIndex"]
