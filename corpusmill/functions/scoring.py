"""Chunk scores by narrow maps: prompt-injection signals and SimHash fingerprints."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions.batches import slices
from corpusmill.functions.text import collapse, fields

# Phrases that count as an instruction.
PHRASES = (
    "ignore previous instructions", "ignore all previous instructions", "ignore the above", "ignore above instructions", "ignore the user",
    "disregard previous instructions", "disregard the above", "disregard all previous", "disregard prior instructions",
    "forget previous instructions", "forget your instructions", "forget all prior",
    "override your instructions", "override previous instructions", "override the system",
    "stop following your instructions", "do not follow your instructions", "new instructions follow",
    "reveal your system prompt", "reveal your instructions", "reveal the system prompt", "show your system prompt",
    "print your system prompt", "output your system prompt", "append your system prompt", "exfiltrate the",
    "jailbreak", "enable developer mode", "enter developer mode", "dan mode",
)
QUARANTINE, SUSPICIOUS = 0.70, 0.40


ADDED = ("matched_phrases", "instruction", "repetition", "stuffing", "score", "level")


def poison_scores(rows: DataFrame, text: str = "text", phrases: tuple[str, ...] = PHRASES, suspicious: float = SUSPICIOUS, quarantine: float = QUARANTINE) -> DataFrame:
    """Adds matched_phrases, instruction, repetition, stuffing, score and level. Null and blank texts score 0 and are clean.

    Columns of these names are replaced; all others stay, whatever their names. A collapsed text is read once, in Arrow
    batches: the phrases that it holds, in the order of the list, the number of its words, of
    its different ones, and how often the commonest long one occurs go on.
    """
    others = ["`" + c.replace("`", "``") + "`" for c in rows.columns if c not in ADDED]
    kept = rows.select(F.struct(*others).alias("row"), collapse(F.coalesce(F.col(text), F.lit(""))).alias("norm")) if others else rows.select(F.struct(F.lit(1).alias("x")).alias("row"), collapse(F.coalesce(F.col(text), F.lit(""))).alias("norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "norm"):
            found, words, different, most = [], [], [], []
            for norm in batch.column("norm").to_pylist():
                found.append([p for p in phrases if p in norm])
                counts = Counter(norm.split(" ")) if norm else {}
                words.append(counts.total() if norm else 0)
                different.append(len(counts))
                most.append(max((n for w, n in counts.items() if n > 1 and len(w.encode()) > 3), default=1))
            made = [pa.array(found, pa.list_(pa.string())), *(pa.array(x, pa.int32()) for x in (words, different, most))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", "found", "n", "different", "most"])

    counted = kept.mapInArrow(run, StructType([*kept.select("row").schema.fields, *StructType.fromDDL("found array<string>, n int, different int, most int").fields]))
    n, few = F.col("n"), F.col("n") < 6
    repetition = F.when(few, 0.0).otherwise(F.least(F.lit(1.0), 2.0 * (n - F.col("different")) / n))
    stuffing = F.when(few | (F.col("most") < 2), 0.0).otherwise(F.least(F.lit(1.0), (F.col("most") - 1) / 5.0))
    instruction = F.when(F.size("found") > 0, 1.0).otherwise(0.0)
    scored = counted.select("row", "found", instruction.alias("instruction"), repetition.alias("repetition"), stuffing.alias("stuffing"))
    score = F.least(F.lit(1.0), 0.5 * F.col("instruction") + 0.25 * F.col("repetition") + 0.25 * F.col("stuffing"))
    whole = scored.select("row", F.col("found").alias("matched_phrases"), "instruction", "repetition", "stuffing", score.alias("score"))
    own = [F.col("row." + c).alias(c[1:-1].replace("``", "`")) for c in others]
    return whole.select(*own, "matched_phrases", "instruction", "repetition", "stuffing", "score", level_of(F.col("score"), suspicious, quarantine).alias("level"))


def level_of(score: Column, suspicious: float = SUSPICIOUS, quarantine: float = QUARANTINE) -> Column:
    return F.when(score >= quarantine, "quarantine").when(score >= suspicious, "suspicious").otherwise("clean")


#: Words whose signs are added up at once; each has 64 of them.
VOTES = 200_000


def simhash(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, fingerprint): 64 signed sums over the words of a text, one bit each; null for a text without words.

    A narrow map, so rows that share a key have each their own. A batch's different words are hashed once, and their signs added up text by text.
    """
    kept = rows.select(F.col(key).alias("key"), fields(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            ends = np.cumsum(np.diff(words.offsets.to_numpy()))
            every = words.flatten().dictionary_encode()
            codes = every.indices.to_numpy()
            digests = b"".join(sha256(w.as_py().encode()).digest()[:8] for w in every.dictionary)
            hashes = np.frombuffer(digests, dtype=">u8").astype(np.uint64)
            sums = np.zeros((len(ends), 64), dtype=np.int64)
            for low in range(0, len(codes), VOTES):
                part = codes[low : low + VOTES]
                owner = np.searchsorted(ends, np.arange(low, low + len(part)), "right")
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                signs = ((hashes[part][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int8) * np.int8(2) - np.int8(1)
                sums[owner[first]] += np.add.reduceat(signs, first, axis=0, dtype=np.int64)
            prints = ((sums > 0) * powers).sum(axis=1, dtype=np.uint64).view(np.int64)
            empty = np.diff(np.r_[0, ends]) == 0
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(prints, pa.int64(), mask=empty)], names=["key", "fingerprint"])

    kind = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(run, f"key {kind}, fingerprint long").withColumnRenamed("key", key)
