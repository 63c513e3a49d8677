"""Secret scans: three fixed patterns plus sliding-window entropy over candidate strings."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: The fixed patterns of the contract; the group's or match's least length follows each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: A maximal run of MIN_HEX or more is what HEX finds and keeps; shorter runs are never visited.
LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_token", "entropy_base64")


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one character class: runs of ``alphabet`` of ``window`` characters or more.

    A window is a hit when its entropy reaches ``bits`` and it has a character of each of ``needs``.
    Hits inside a match of one of ``allow`` are harmless in this class.
    """

    kind: str
    alphabet: str
    window: int
    bits: float
    needs: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()


DIGITS, SMALL, CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A random window falls short of the most its length allows by about 0.1 bits for each pair of equal characters
#: in 20, of which letters and digits have three: nine of ten reach 3.8. Of 32 random base64 characters most reach
#: 4.4, of 24 random hexadecimal digits 3.3. Prose and identifiers have less, or lack a class. Words of a
#: link's path form long runs only where a slash may stand in them, so links are harmless in that class alone.
CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", 24, 3.0, (DIGITS, "abcdefABCDEF")),
    CharacterClass("entropy_token", "A-Za-z0-9+_=-", 20, 3.8, (DIGITS, SMALL, CAPITAL)),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", 32, 4.25, (DIGITS, SMALL, CAPITAL), (r"https?://\S+",)),
)
#: Entropy hits inside a match of one of these are known to be harmless: identifiers, digests with a name, inline data, sample keys.
ALLOW = (
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"(?:sha(?:1|224|256|384|512)|md5|blake2[bs])[-:=_][A-Za-z0-9+/=]+",
    r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+",
    r"[A-Za-z0-9+/_=-]*EXAMPLE[A-Za-z0-9+/_=-]*",
)


def entropy_spans(run: str, rule: CharacterClass) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``run`` that are hits; each step updates two counts.

    The sum of c*log2(c) over the window's counts is kept, so a step costs the same for any window.
    Candidates are linear in their length whatever their length is.
    """
    size = rule.window
    if len(run) < size:
        return []
    weight = [0.0] + [c * math.log2(c) for c in range(1, size + 2)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    member = {c: tuple(c in need for need in rule.needs) for c in set(run)}
    have = [0] * len(rule.needs)
    limit = math.log2(size) - rule.bits
    for at, char in enumerate(run):
        n = counts.get(char, 0)
        counts[char] = n + 1
        total += weight[n + 1] - weight[n]
        for k, yes in enumerate(member[char]):
            have[k] += yes
        if at >= size:
            old = run[at - size]
            n = counts[old]
            counts[old] = n - 1
            total += weight[n - 1] - weight[n]
            for k, yes in enumerate(member[old]):
                have[k] -= yes
        # entropy = log2(size) - total / size
        if at >= size - 1 and total / size <= limit + 1e-9 and all(have):
            start = at - size + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((start, at + 1))
    return spans


@dataclass
class SecretScanner:
    """Finds spans ``(start, end, kind)`` in code points, ends exclusive."""

    classes: tuple[CharacterClass, ...] = CLASSES
    allow: tuple[str, ...] = ALLOW
    _runs: list[re.Pattern] = field(init=False)
    _allow: list[re.Pattern | None] = field(init=False)

    def __post_init__(self) -> None:
        # a run is tried where it begins and nowhere inside
        self._runs = [re.compile(f"(?<![{c.alphabet}])[{c.alphabet}]{{{c.window},}}") for c in self.classes]
        self._allow = [re.compile("|".join(f"(?:{p})" for p in c.allow + self.allow)) if c.allow + self.allow else None for c in self.classes]

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """The contract's spans: leftmost and non-overlapping within a kind; short ones are dropped after matching."""
        found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
        return found

    def entropy(self, text: str) -> list[tuple[int, int, str]]:
        """High-entropy spans outside the allow-list."""
        found = []
        for rule, runs, allow in zip(self.classes, self._runs, self._allow, strict=True):
            hits = [(m.start() + a, m.start() + b, rule.kind) for m in runs.finditer(text) for a, b in entropy_spans(m[0], rule)]
            if hits and allow is not None:
                # matches don't overlap, so only the last that begins before a hit can hold it
                allowed = [m.span() for m in allow.finditer(text)]
                before = [bisect.bisect_right(allowed, (start, len(text))) - 1 for start, _, _ in hits]
                hits = [h for h, at in zip(hits, before, strict=True) if at < 0 or allowed[at][1] < h[1]]
            found += hits
        return found

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans and all spans, each by start and then by kind as KINDS lists them. Null reads as empty."""
        text = text or ""
        by = lambda s: (s[0], KINDS.index(s[2]) if s[2] in KINDS else len(KINDS), s[2], s[1])
        base = sorted(self.base(text), key=by)
        return base, sorted(base + self.entropy(text), key=by)

    def redact(self, text: str | None) -> str | None:
        """The text with every merged span replaced by ``[SECRET]``; null stays null."""
        if not text or not (spans := self.scan(text)[1]):
            return text
        parts, at = [], 0
        for start, end, _ in spans:
            if start >= at:
                parts += [text[at:start], "[SECRET]"]
            at = max(at, end)
        return "".join([*parts, text[at:]])


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end`` joined by commas."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, scanner: SecretScanner | None = None) -> DataFrame:
    """One row per document with its counts, the digest of its base spans, and all spans.

    A narrow map over (doc_id, text): no shuffle, and memory holds one Arrow batch. Null and empty
    texts have no spans; repeated rows each give a row; a very long text takes time in proportion to
    its length; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    scanner = scanner or SecretScanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[list[int], ...] = ([], [], [])
            digests, spans = [], []
            for text in batch.column("text"):
                base, every = scanner.scan(text.as_py())
                for column, kind in zip(counts, KINDS, strict=False):
                    column.append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                spans.append(join_spans(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, scanner: SecretScanner | None = None) -> DataFrame:
    """The documents with secrets replaced, all columns kept; ``n_chars`` follows the text where there is one.

    Null and empty texts stay as they are; repeated rows stay; an empty table stays empty; other
    columns pass through, whatever their names.
    """
    scanner = scanner or SecretScanner()
    # by place, as names may hold dots
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    numbered = docs.toDF(*names.values())
    text, n_chars = names["text"], names.get("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(text)
            after = [scanner.redact(t.as_py()) for t in before]
            columns = {text: pa.array(after, before.type)}
            if n_chars is not None:
                sizes = batch.column(n_chars)
                columns[n_chars] = pa.array([size.as_py() if new == was.as_py() else len(new) for size, was, new in zip(sizes, before, after, strict=True)], sizes.type)
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
