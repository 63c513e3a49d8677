"""Many rows with one id or none: work stays in proportion to rows."""

import random

from pyspark.sql import functions as F

from corpusmill.llm import passages, sharding


def test_passages_of_many_rows_without_ids(spark, monkeypatch, tmp_path):
    """20 000 null rows that share a passage: the runs that are dealt out grow with the rows, not with rows times salts."""
    dealt, located = [], passages._located
    monkeypatch.setattr(passages, "_located", lambda rows, window: located(dealt.append(rows.count()) or rows, window))
    shared = " ".join(f"s{i}" for i in range(20))
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id"), F.lit(shared), F.concat(F.lit("c"), "id")).alias("text"))
    rows.write.parquet(f"{tmp_path}/null")
    out = passages.remove_passages(spark.read.parquet(f"{tmp_path}/null"), returns=("kept_sha256",))
    assert out.agg(F.sum("n_removed"), F.count(F.lit(1))).first() == (0, 20_000) and dealt[0] < 3 * 20_000
    # one row with an id takes the passage from all of them
    one = spark.createDataFrame([(7, shared)], "doc_id long, text string")
    rows.unionByName(one).write.parquet(f"{tmp_path}/one")
    out = passages.remove_passages(spark.read.parquet(f"{tmp_path}/one"), returns=("kept_sha256",))
    assert out.agg(F.sum("n_removed")).first()[0] == 20 * 20_000


def test_rows_of_one_key_with_other_texts_tell_all_salts(spark, monkeypatch, tmp_path):
    """Passages that only some rows of the least key have are taken from larger keys in every salt."""
    monkeypatch.setattr(passages, "SALT_ROWS", 2)
    rng = random.Random(6)
    say = lambda c: " ".join(f"{c}{i}" for i in range(16))
    rows = [(1, f"{say(f'p{i % 5}')} x{i}") for i in range(40)] + [(i, f"y{i} {say(f'p{rng.randrange(5)}')} z{i}") for i in range(2, 300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d")
    out = passages.remove_passages(spark.read.parquet(f"{tmp_path}/d"), returns=("kept_sha256",)).collect()
    assert all(r.n_removed == (0 if r.doc_id == 1 else 16) for r in out) and len(out) == len(rows)


def test_equal_rows_fall_into_all_buckets(spark, tmp_path):
    spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same").alias("text")).repartition(3).write.parquet(f"{tmp_path}/d")
    out = sharding.shard_documents(spark.read.parquet(f"{tmp_path}/d"), 8, 100)
    assert out.select("shard").distinct().count() == 1
    slots = sorted(r.slot for r in out.select("slot").collect())
    assert slots == list(range(5000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_index" in plan
