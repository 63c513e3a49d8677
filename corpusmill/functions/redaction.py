"""Redaction of secrets and personal data: one pass over all patterns, with findings and edits."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The built-in kinds in order. \w and \d are ASCII; cards must pass the check digit.
PATTERNS = (
    ("aws-key", r"AKIA[0-9A-Z]{16}"),
    ("github-token", r"gh[opsu]_[A-Za-z0-9]{36}"),
    ("private-key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("credit-card", r"\b(?:\d[ -]?){13,19}\b"),
)
CHECKED = "credit-card"


def luhn(number: str) -> bool:
    """13 to 19 digits, blanks and dashes aside, whose check digit is right."""
    digits = number.replace(" ", "").replace("-", "")
    if not (digits.isascii() and digits.isdigit() and 13 <= len(digits) <= 19):
        return False
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def parse_patterns(lines: Iterable[str]) -> tuple[tuple[str, str], ...]:
    """Own patterns, ``type<TAB>regex`` a line; ``#`` begins a comment, lines without a tab are skipped, a bad regex raises."""
    out = []
    for line in lines:
        kind, tab, pattern = line.rstrip("\n").partition("\t")
        if tab and not line.startswith("#"):
            re.compile(pattern)
            out.append((kind, pattern))
    return tuple(out)


class Redactor:
    """Replaces every match of the patterns by ``[REDACTED:type]``.

    Of overlapping matches the one that begins first stays, then the shorter. A cheap test of what
    a pattern needs to match at all goes before it, so plain text costs little.
    """

    def __init__(self, extra: tuple[tuple[str, str], ...] = ()) -> None:
        self.patterns = [(kind, re.compile(pattern, re.ASCII)) for kind, pattern in (*PATTERNS, *extra)]

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) of what is replaced, in code points."""
        needs = {"aws-key": "AKIA", "github-token": "gh", "private-key": "-----BEGIN", "email": "@"}
        own = len(PATTERNS)
        # what holds for a built-in kind says nothing of an own pattern of that name
        asked = [(order, kind, p) for order, (kind, p) in enumerate(self.patterns) if order >= own or needs.get(kind, "") in text]
        found = sorted((*m.span(), order, kind) for order, kind, p in asked for m in p.finditer(text) if order >= own or kind != CHECKED or luhn(m[0]))
        kept: list[tuple[int, int, str]] = []
        for start, end, _, kind in found:
            if not kept or start >= kept[-1][1]:
                kept.append((start, end, kind))
        return kept

    def apply(self, text: str | None) -> tuple[str | None, dict[str, int], list[tuple[int, int, int]]]:
        """The redacted text, findings by type, and edits (position, removed, inserted) in bytes of the original."""
        kept = self.matches(text) if text else []
        if not kept:
            return text, {}, []
        parts, edits, at, size = [], [], 0, 0
        for start, end, kind in kept:
            mark = f"[REDACTED:{kind}]"
            size += len(text[at:start].encode())
            removed = len(text[start:end].encode())
            edits.append((size, removed, len(mark)))
            parts += [text[at:start], mark]
            at, size = end, size + removed
        return "".join([*parts, text[at:]]), dict(sorted(Counter(k for _, _, k in kept).items())), edits


def redact(docs: DataFrame, extra: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The rows with ``text`` redacted, ``findings`` (type to count) and ``edits``. A narrow map; null stays null."""
    made = "text string, findings map<string,int>, edits array<struct<pos:int,removed:int,inserted:int>>"
    kept = docs.drop("findings", "edits")
    others = [c for c in kept.columns if c != "text"]
    rows = kept.select("text", F.struct(*others).alias("row")) if others else kept.select("text", F.struct(F.lit(1).alias("x")).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redactor = Redactor(extra)
        for batch in batches:
            done = [redactor.apply(t.as_py()) for t in batch.column("text")]
            findings = pa.array([list(f.items()) for _, f, _ in done], pa.map_(pa.string(), pa.int32()))
            edits = pa.array([[{"pos": p, "removed": r, "inserted": i} for p, r, i in e] for _, _, e in done], pa.list_(pa.struct([("pos", pa.int32()), ("removed", pa.int32()), ("inserted", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in done], pa.string()), findings, edits, batch.column("row")], names=["text", "findings", "edits", "row"])

    out = rows.mapInArrow(run, f"{made}, row {rows.schema['row'].dataType.simpleString()}")
    return out.select(*("text" if c == "text" else F.col("row")[c].alias(c) for c in kept.columns), "findings", "edits")


def findings_totals(redacted: DataFrame) -> DataFrame:
    """(type, n) over all rows; never the text that was found. One partial aggregation."""
    return redacted.select(F.explode("findings").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("n"))
