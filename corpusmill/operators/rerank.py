"""Reranking: an injected scorer over a bounded pool of candidates, with a fall-back order and one retry."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import top

#: Candidates of a query that are scored at most, the retry's wider pool included.
MAX_POOL = 200


class Reranker(Protocol):
    """Scores candidates of a query, one number each, in order."""

    def score(self, query: str, candidates: list[str]) -> list[float]: ...


def parse_scores(answer: str, n: int) -> list[float]:
    """n scores from a list with commas, as shares of the largest, or of 1 where that is larger. What isn't a number counts 0.5."""
    fields = (answer.strip().split(",") + [""] * n)[:n]
    numbers = [float(m[0]) if (m := re.match(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", f.strip())) else None for f in fields]
    largest = max([1.0, *(v for v in numbers if v is not None)])
    return [0.5 if v is None else v / largest for v in numbers]


@dataclass(frozen=True)
class PromptedReranker:
    """Asks a text model for a list of scores; ``ask`` takes the prompt and gives the answer."""

    ask: Callable[[str], str]

    def score(self, query: str, candidates: list[str]) -> list[float]:
        listed = "\n".join(f"{i}. {c}" for i, c in enumerate(candidates))
        return parse_scores(self.ask(f"Rate each passage from 0 to 9 for the query, as a list with commas.\nQuery: {query}\n{listed}"), len(candidates))


@dataclass(frozen=True)
class OverlapReranker:
    """A scorer without a model: the share of the query's words that a passage has. For tests and as a baseline."""

    def score(self, query: str, candidates: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(c.lower().split())) / max(1, len(words)) for c in candidates]


def rerank(hits: DataFrame, queries: DataFrame, reranker: Reranker, k: int, pool: int = 60, retry: bool = False) -> DataFrame:
    """The best k of each query by the reranker, with ``rerank_failed``.

    ``hits`` has query_id, chunk_id, content, rank and score. The first max(pool, k) candidates are
    scored, MAX_POOL at most; ties keep their order. A scorer that raises or gives another number
    of scores leaves the given order and says so; with ``retry`` it is asked once more with twice
    as many candidates first. The pool bounds what one query has in a task.
    """
    size, wide = min(max(pool, k), MAX_POOL), min(2 * max(pool, k), MAX_POOL)
    asked = top(hits, wide if retry else size).join(queries.select("query_id", "query"), "query_id")
    columns = [c for c in hits.columns if c not in ("rank", "score")]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema if f.name in columns)

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        failed = True
        for n in dict.fromkeys((size, wide) if retry else (size,)):
            part = rows.head(n)
            try:
                scores = reranker.score(part["query"].iloc[0], part["content"].fillna("").tolist())
            except Exception:  # noqa: BLE001 - whatever a scorer raises, the given order stands
                continue
            if len(scores) == len(part):
                rows, failed = part.assign(score=[float(s) for s in scores]).sort_values(["score", "rank"], ascending=[False, True]), False
                break
        rows = rows.head(k).assign(rerank_failed=failed)
        return rows.assign(rank=range(1, len(rows) + 1))[[*columns, "score", "rank", "rerank_failed"]]

    return asked.withColumn("score", F.col("score").cast("double")).groupBy("query_id").applyInPandas(order, f"{fields}, score double, rank int, rerank_failed boolean")
