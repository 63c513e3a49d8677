"""Near copies by SimHash: fingerprints that differ in a few bits, found by an equi-join on groups of equal blocks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of which one at least covers only equal bits of two fingerprints within ``distance``.

    Of ``blocks`` blocks, ``blocks - distance`` at least are equal. More blocks make more masks with
    more bits each, so fewer strangers meet: 4 blocks give 4 masks of 16 bits for a distance of 3, 5
    give 10 of 25, 6 give 20 of 32.
    """
    if not 0 <= distance < blocks <= BITS:
        raise ValueError("more blocks than bits that may differ are needed")
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")


def fingerprint_classes(prints: DataFrame, key: str = "chunk_id", least_tokens: int = 8) -> DataFrame:
    """(fingerprint, representative, n): rows with one fingerprint are a class, however many they are; too short ones are left out."""
    kept = prints.filter("fingerprint IS NOT NULL")
    if "token_count" in prints.columns:
        kept = kept.filter(F.col("token_count") >= least_tokens)
    return kept.groupBy("fingerprint").agg(F.min(key).alias("representative"), F.count(F.lit(1)).alias("n"))


def near_pairs(classes: DataFrame, distance: int = 3, blocks: int = 5) -> DataFrame:
    """(a, b, hamming, similarity) for representatives a < b of classes within ``distance`` bits.

    A pair that shares several masks is made at the first of them only, so nothing needs to be made
    distinct. Exact for any data; equal fingerprints never meet one another.
    """
    masks = block_masks(distance, blocks)
    keyed = classes.select("fingerprint", "representative", F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(_signed(m)) for m in masks))).alias("mask", "value"))
    left, right = (keyed.select("mask", "value", F.col("fingerprint").alias(f"f{s}"), F.col("representative").alias(s)) for s in "ab")
    met = left.join(right, ["mask", "value"]).filter("a < b")
    differ = F.col("fa").bitwiseXOR(F.col("fb"))
    earlier = [F.when((F.col("mask") > i) & (differ.bitwiseAND(_signed(m)) == 0), True).otherwise(False) for i, m in enumerate(masks[:-1])]
    hamming = F.bit_count(differ)
    return met.filter((hamming <= distance) & ~reduce(lambda x, y: x | y, earlier, F.lit(False))).select("a", "b", hamming.cast("int").alias("hamming"), (1 - hamming / BITS).alias("similarity"))


def hit_siblings(hits: DataFrame, prints: DataFrame, distance: int = 3, key: str = "chunk_id") -> DataFrame:
    """(query_id, chunk_id, sibling_id, similarity): hits of one query that are near copies of each other.

    Only the fingerprints of hits are compared, so a class of any size costs what it has among the hits of a query, which the pool bounds.
    """
    mine = prints.join(hits.select(F.col("chunk_id").alias(key)).distinct(), key)
    classes = fingerprint_classes(mine, key)
    named = mine.join(classes.select("fingerprint", "representative"), "fingerprint").select(F.col(key).alias("chunk_id"), "representative")
    pairs = near_pairs(classes, distance)
    both = pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    both = both.unionByName(classes.select(F.col("representative").alias("a"), F.col("representative").alias("b"), F.lit(1.0).alias("similarity")))
    own = hits.select("query_id", "chunk_id").join(named, "chunk_id")
    near = own.join(both, own["representative"] == both["a"]).select("query_id", "chunk_id", F.col("b").alias("representative"), "similarity")
    other = own.select("query_id", F.col("chunk_id").alias("sibling_id"), "representative")
    return near.join(other, ["query_id", "representative"]).filter("chunk_id <> sibling_id").select("query_id", "chunk_id", "sibling_id", "similarity")
