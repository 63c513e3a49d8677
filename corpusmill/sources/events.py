"""The log of what a corpus did: JSON lines in files that are only added, the oldest dropped when there are too many."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of an event; ``seconds`` is how long it took.
EVENT = "ts timestamp, type string, query_hash string, mode string, k int, hits int, status string, op string, path string, new int, skipped int, errors int, seconds double, transport string, detail string"


class EventLog:
    """Writes events to ``folder``: a file for every ``per_file`` events or when it is flushed, the newest ``files`` of them kept. Queries are logged by their digest, never by their words."""

    def __init__(self, spark: SparkSession, folder: str, per_file: int = 1000, files: int = 1000) -> None:
        self.spark, self.folder, self.per_file, self.files = spark, folder, per_file, files
        self._waiting: list[str] = []

    def write(self, **event: object) -> None:
        self._waiting.append(json.dumps({"ts": datetime.now(UTC).isoformat(), "transport": "api", **event}))
        if len(self._waiting) >= self.per_file:
            self.flush()

    def flush(self) -> None:
        """Puts what waits into a file of its own; a name that is renamed into place is whole."""
        if not self._waiting:
            return
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        name = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}.jsonl"
        draft = jvm.org.apache.hadoop.fs.Path(at, f"_{name}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(("\n".join(self._waiting) + "\n").encode()))
        finally:
            out.close()
        fs.rename(draft, jvm.org.apache.hadoop.fs.Path(at, name))
        self._waiting = []
        for old in sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".jsonl"))[: -self.files]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(at, old), False)

    def read(self) -> DataFrame:
        """All events that are kept; lines that don't parse are left out."""
        self.flush()
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(self.folder)

    def durations(self, kind: str) -> DataFrame:
        """(seconds) of events of one type, for ``maintenance.latency_histogram``."""
        return self.read().filter((F.col("type") == kind) & F.col("seconds").isNotNull()).select("seconds")
