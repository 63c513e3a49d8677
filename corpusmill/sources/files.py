"""Sources and sinks: directories, golden query files, retrieval benchmarks and audit logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.sources.events import EVENT
from corpusmill.sources.shared import written

#: What a corpus keeps beside the files it was made of is never read as a file.
OWN_FOLDER = ".corpusmill"


def walk(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files under ``root`` whose names match; the corpus's own folder and files without a byte are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob or "*").load(root)
    return files.filter(~F.col("path").contains(f"/{OWN_FOLDER}/"))


def golden_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, relevant) from JSON lines; blank lines and those that begin with ``#`` are skipped.

    Raises when there is none, an id is empty or repeated, or a query or a label is empty.
    """
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    rows = lines.select(F.from_json("value", "id string, query string, relevant array<string>").alias("g")).select("g.*")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    wrong = blank(F.col("id")) | blank(F.col("query")) | F.coalesce(F.exists("relevant", lambda r: blank(r)), F.lit(False))
    n, ids, bad = rows.agg(F.count(F.lit(1)), F.count_distinct("id"), F.coalesce(F.sum(wrong.cast("int")), F.lit(0))).first()
    if not n or bad or ids != n:
        raise ValueError(f"{path}: {n} queries, {n - ids} repeated ids, {bad} with an empty id, query or label")
    return rows.withColumn("relevant", F.coalesce("relevant", F.array().cast("array<string>")))


@dataclass
class Benchmark:
    """corpus (doc_id, title, text, line), queries (query_id, query) and qrels (query_id, doc_id, grade)."""

    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def read_benchmark(spark: SparkSession, root: str, split: str = "") -> Benchmark:
    """An unpacked benchmark: corpus.jsonl, queries.jsonl, qrels/<split>.tsv with a head line; a missing grade is 1.

    Without a split it is ``dev`` where the folder's name says msmarco, whose test labels are not public, and ``test`` elsewhere.
    """
    split = split or ("dev" if "msmarco" in root.rstrip("/").rsplit("/", 1)[-1] else "test")
    corpus = spark.read.schema("_id string, title string, text string").json(f"{root}/corpus.jsonl").withColumnRenamed("_id", "doc_id").withColumn("line", F.monotonically_increasing_id())
    queries = spark.read.schema("_id string, text string").json(f"{root}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    qrels = spark.read.csv(f"{root}/qrels/{split}.tsv", sep="\t", header=True, schema="query_id string, doc_id string, grade int", enforceSchema=True)
    return Benchmark(corpus, queries, qrels.withColumn("grade", F.coalesce("grade", F.lit(1))))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``number``, from 0 on in the order of columns. Sorted by range and counted by partition, so no task has all rows."""
    placed = written(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    parts = placed.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # a row for each partition
    before = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.col("_id").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + within).drop("_id", "_part", "_before")


def subsample(bench: Benchmark, max_queries: int, stride: int) -> Benchmark:
    """Evenly spaced queries by id, all documents relevant to them, and every ``stride``-th of the rest in the order of the file (by id where there was none)."""
    judged = numbered(bench.queries.join(bench.qrels.select("query_id").distinct(), "query_id", "left_semi"), "query_id")
    step = max(1, judged.count() // max(1, max_queries))
    queries = judged.filter((F.col("number") % step == 0) & (F.col("number") < step * max_queries)).drop("number")
    qrels = bench.qrels.join(queries.select("query_id"), "query_id", "left_semi")
    relevant = qrels.select("doc_id").distinct()
    columns = [c for c in bench.corpus.columns if c != "line"]
    others = numbered(bench.corpus.join(relevant, "doc_id", "left_anti"), "line" if "line" in bench.corpus.columns else "doc_id")
    kept = bench.corpus.join(relevant, "doc_id", "left_semi").select(*columns).unionByName(others.filter((F.col("number") + 1) % stride == 0).select(*columns))
    return Benchmark(kept, queries, qrels)


def rendered(hits: DataFrame, form: str = "json") -> DataFrame:
    """(query_id, line): a hit as JSON, or as one line of text with its rank, score, source and a preview."""
    if form == "json":
        return hits.select("query_id", F.to_json(F.struct(*[c for c in hits.columns if c != "query_id"])).alias("line"))
    line = F.concat_ws("  ", F.concat(F.col("rank").cast("string"), F.lit(".")), F.format_number("score", 4), "file_path", F.substring(F.regexp_replace("content", r"\s+", " "), 1, 160))
    return hits.select("query_id", line.alias("line"))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit events from JSON lines; lines that don't parse are left out."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def audit_tail(events: DataFrame, kind: str | None = None, since: Column | None = None, n: int = 50) -> DataFrame:
    """The last n events, of one type and from a time on where they are given. Spark keeps n rows a task."""
    wanted = F.lit(True)
    wanted = wanted & (F.col("type") == kind) if kind else wanted
    wanted = wanted & (F.col("ts") >= since) if since is not None else wanted
    return events.filter(wanted).orderBy(F.col("ts").desc()).limit(n)
