"""Tables in the folder that driver and executors share: results that several plans read, written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back.

    Unlike executor-local storage, the copy outlives any executor. The files stay until the
    owner of ``spark.checkpoint.dir`` clears it, as checkpoints do.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes a core that a table in few files may have to be dealt out.
SPREAD = 64 << 20


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """The rows of a small table in few files, dealt out to all cores: one file with one row group would otherwise be one task. Larger tables, and those in many files, stay as they lie."""
    session = df.sparkSession
    cores = least or session.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    size = sum(session._jvm.org.apache.hadoop.fs.Path(f).getFileSystem(session._jsc.hadoopConfiguration()).getFileStatus(session._jvm.org.apache.hadoop.fs.Path(f)).getLen() for f in files)
    return df.repartition(cores) if size <= SPREAD * cores else df
