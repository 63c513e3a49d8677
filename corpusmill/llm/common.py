"""Helpers that several operators share: word rules, ASCII case folding, row locators; tables in the shared folder come from the library."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.shared import new_path, shared_dir, written

__all__ = ["ascii_lower", "body", "columns_named", "located", "new_path", "shared_dir", "words", "written"]

#: Code points that separate words: space and \t \n \v \f \r. ``bytes.split()`` has the same rule.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def body(text: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure-ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text as an array, JVM-side."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def columns_named(names: list[str]) -> list[Column]:
    """Columns by their whole names, which may hold dots and backticks."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def _is_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of a file: projections and filters of a relation, and nothing else."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def located(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with their locator: ``f``, a 64-bit hash of the file's path, and ``r``, the row in it.

    With ``columns`` these follow by their names (none may be f or r); without, the whole row is packed
    into the struct ``row``, so that no name can clash. Among a million files the chance that two
    paths have one hash is 3 in 10**8. Rows that don't come straight from Parquet are written to the shared folder first.
    """
    kept = columns_named(columns) if columns else [F.struct(*columns_named(docs.columns)).alias("row")]

    def read(df: DataFrame) -> DataFrame:
        where = df.metadataColumn("_metadata")
        return df.select(F.xxhash64(where["file_path"]).alias("f"), where["row_index"].alias("r"), *kept)

    if _is_scan(docs):
        try:
            return read(docs)
        except AnalysisException:
            pass
    path = new_path(docs.sparkSession, "content")
    docs.write.parquet(path)
    return read(docs.sparkSession.read.schema(docs.schema).parquet(path))
