"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), the component being its least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links stand still.
    The least neighbour is found per task before the shuffle and written, so that the join that follows
    reads two plain exchanges, which adaptive execution splits at a hot node. Every step is written to
    the shared folder, so a lost executor costs one step.
    """
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = written(both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        large = written(large, "large-star")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("m"), F.explode(F.array("u", "v")).alias("u")).filter("m < u").select(F.col("m").alias("v"), "u").distinct()
        edges = written(small, "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
