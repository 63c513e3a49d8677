"""Readers: from a file's bytes to text, metadata and headings. One registry, run inside a single map over a binary source."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Embeds with these endings are files; others are notes.
MEDIA = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".webp", ".pdf")
# The XML namespaces of word-processing documents and their core properties.
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DUBLIN = "{http://purl.org/dc/elements/1.1/}"
#: Bytes that an archive's member may have when unpacked.
MEMBER_BYTES = 256 << 20
#: Images of a document and bytes of one that are kept for captions.
MAX_IMAGES, IMAGE_BYTES = 32, 2 << 20


@dataclass
class Parsed:
    """What a reader gives: text, type, metadata, headings (level, text, byte offset), tags, page offsets and images (page, bytes)."""

    text: str
    mime: str
    kind: str
    metadata: dict[str, str] = field(default_factory=dict)
    headings: list[tuple[int, str, int]] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    page_offsets: list[int] = field(default_factory=list)
    images: list[tuple[int, bytes]] = field(default_factory=list)


Reader = Callable[[bytes], Parsed]


def text_headings(text: str) -> list[tuple[int, str, int]]:
    """Headings of plain text: underlined lines, lines in capitals, short lines that end with a colon."""
    lines = text.split("\n")
    out, offset = [], 0
    for line, below in zip(lines, [*lines[1:], ""], strict=True):
        title = line.strip()
        rule = below.rstrip("\r")
        size = len(title.encode())
        if title:
            capitals = title.upper() == title != title.lower() and not any(c.islower() for c in title) and any(c.isupper() for c in title)
            if len(rule) > 2 and set(rule) in ({"="}, {"-"}):
                out.append((1 if rule[0] == "=" else 2, title, offset))
            elif 3 <= size <= 80 and capitals and title[-1] not in ".,;:!?":
                out.append((1, title, offset))
            elif 2 <= size <= 60 and title[-1] == ":" and any(c.isalpha() for c in title):
                out.append((2, title, offset))
        offset += len(line.encode()) + 1
    return out


def read_text(raw: bytes) -> Parsed:
    """Text as it is. A table of comma-separated values is text too."""
    text = raw.decode("utf-8", "replace")
    lines = len(text.removesuffix("\n").split("\n")) if text else 0
    return Parsed(text, "text/plain", "text", {"encoding": "utf-8", "line_count": str(lines), "char_count": str(len(raw))}, text_headings(text))


def frontmatter(text: str) -> tuple[dict[str, str], str]:
    """Key and value lines of a leading block between ``---`` lines, values as they stand, and the rest."""
    if not text.startswith("---\n"):
        return {}, text
    block, fence, rest = text[4:].partition("\n---\n")
    if not fence:
        return {}, text
    pairs = (line.partition(":") for line in block.split("\n"))
    return {k.strip(): v.strip() for k, colon, v in pairs if colon}, rest


def resolve_links(text: str) -> tuple[str, list[str]]:
    """Wiki links as what a reader sees of them, and the notes that are embedded."""
    notes: list[str] = []

    def shown(inner: str) -> str:
        target, bar, alias = inner.strip().partition("|")
        return alias.strip() if bar else target.partition("#")[0].strip()

    def embed(m: re.Match) -> str:
        inner = m[1].strip()
        if inner.lower().endswith(MEDIA):
            return inner
        notes.append(re.split(r"[|#]", inner, maxsplit=1)[0].strip())
        return shown(inner)

    text = re.sub(r"!\[\[([^\]]+)\]\]", embed, text)
    return re.sub(r"\[\[([^\]]+)\]\]", lambda m: shown(m[1]), text), notes


def plain_line(line: str) -> str:
    """A line without marks of emphasis and code; an underscore that stands alone becomes a blank."""
    return re.sub(r"\*\*|__|`|\*", "", line).replace("_", " ")


def strip_markdown(text: str) -> tuple[str, list[tuple[int, str, int]]]:
    """Text without marks, and its headings with their byte offsets in it. Fenced lines stay as they are."""
    out: list[str] = []
    heads: list[tuple[int, str, int]] = []
    fenced, offset = False, 0
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
            continue
        title = bare.lstrip("#")
        level = len(bare) - len(title)
        if fenced:
            kept = line
        elif level and title.strip():
            kept = plain_line(title.strip())
            heads.append((level, kept, offset))
        else:
            kept = plain_line(bare.lstrip("#> ") if bare[:1] in ("#", ">") and bare else bare)
        out.append(kept + "\n")
        offset += len(kept.encode()) + 1
    return "".join(out).strip(), heads


def read_markdown(raw: bytes) -> Parsed:
    """Front matter, then links, then marks."""
    meta, rest = frontmatter(raw.decode("utf-8", "replace"))
    linked, notes = resolve_links(rest)
    text, heads = strip_markdown(linked)
    meta = dict(meta) | {"format": "markdown"}
    if heads:
        meta["headings"] = "[" + " ".join(h[1] for h in heads) + "]"
    if notes:
        meta["transcludes"] = "[" + " ".join(notes) + "]"
    tags = [t for t in meta.get("tags", "").split(",") if t]
    return Parsed(text, "text/markdown", "markdown", meta, heads, tags)


def _member(archive: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        with archive.open(name) as file:
            data = file.read(MEMBER_BYTES + 1)
    except KeyError:
        return None
    if len(data) > MEMBER_BYTES:
        raise ValueError(f"{name} is larger than {MEMBER_BYTES} bytes")
    if b"<!ENTITY" in data[:4096]:
        raise ValueError(f"{name} declares entities")
    return data


def read_docx(raw: bytes) -> Parsed:
    """Paragraphs a line each; heading styles give levels, and core properties title and author."""
    archive = zipfile.ZipFile(io.BytesIO(raw))
    body = _member(archive, "word/document.xml")
    if body is None:
        raise ValueError("not a word-processing document")
    lines, heads, offset = [], [], 0
    for paragraph in ElementTree.fromstring(body).iter(f"{WORD_NS}p"):
        said = []
        for node in paragraph.iter():
            if node.tag == f"{WORD_NS}t":
                said.append(node.text or "")
            elif node.tag in (f"{WORD_NS}br", f"{WORD_NS}tab"):
                said.append(" ")
        line = "".join(said)
        style = next((s.get(f"{WORD_NS}val", "") for s in paragraph.iter(f"{WORD_NS}pStyle")), "")
        level = {"title": 1, "subtitle": 2}.get(style.lower()) or (int(m[1]) if (m := re.fullmatch(r"[Hh]eading\s*([1-9])", style)) else 0)
        if level and line.strip():
            heads.append((level, line.strip(), offset))
        lines.append(line)
        offset += len(line.encode()) + 1
    meta = {}
    core = _member(archive, "docProps/core.xml")
    if core is not None:
        tree = ElementTree.fromstring(core)
        for name, key in (("title", "title"), ("creator", "author")):
            node = tree.find(f".//{DUBLIN}{name}")
            if node is not None and node.text:
                meta[key] = node.text
    return Parsed("\n".join(lines), "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx", meta, heads)


def image_size(raw: bytes) -> tuple[int, int]:
    """Width and height from the header of a PNG or JPEG file."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", raw[16:24])
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 9 < len(raw):
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
            return width, height
        at += 2 + size
    raise ValueError("no size in the header")


def read_image(mime: str) -> Reader:
    """An image has no text; what it shows may be captioned later."""

    def read(raw: bytes) -> Parsed:
        width, height = image_size(raw)
        return Parsed("", mime, "image", {"width": str(width), "height": str(height), "ocr": "deferred"}, images=[(1, raw)] if len(raw) <= IMAGE_BYTES else [])

    return read


PDF_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)


@dataclass
class Fragment:
    """A shown string with where it begins and the size of its letters."""

    x: float
    y: float
    size: float
    text: str


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + ("0" if len(re.sub(rb"\s", b"", token[1:-1])) % 2 else ""))
    else:
        escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else b"" if m[1].strip() == b"" else escapes.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def positioned_text(stream: bytes) -> list[Fragment]:
    """Strings that a page's content shows, in order, with their positions. Text that is turned is left out."""
    out: list[Fragment] = []
    stack: list = []
    x = y = line_x = line_y = leading = 0.0
    size, scale, turned, listed = 12.0, 1.0, False, None

    def show(text: str) -> None:
        nonlocal x
        if text and not turned:
            out.append(Fragment(x, y, size * scale, text))
        x += len(text) * size * scale / 2

    def newline(dx: float, dy: float) -> None:
        nonlocal x, y, line_x, line_y
        line_x, line_y = line_x + dx * scale, line_y + dy * scale
        x, y = line_x, line_y

    for token in PDF_TOKEN.findall(stream):
        if token[:1] in b"(<":
            (listed if listed is not None else stack).append(_pdf_string(token))
        elif token == b"[":
            listed = []
        elif token == b"]":
            stack, listed = [*stack, listed or []], None
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            (listed if listed is not None else stack).append(float(token))
        elif token[:1] == b"/":
            stack.append(token)
        else:
            numbers = [v for v in stack if isinstance(v, float)]
            if token == b"BT":
                x = y = line_x = line_y = 0.0
                scale, turned = 1.0, False
            elif token == b"Tf" and numbers:
                size = abs(numbers[-1]) or size
            elif token == b"TL" and numbers:
                leading = numbers[-1]
            elif token == b"Tm" and len(numbers) >= 6:
                a, b, c, _, line_x, line_y = numbers[-6:]
                x, y, scale, turned = line_x, line_y, abs(a) or 1.0, abs(b) > 1e-6 or abs(c) > 1e-6
            elif token in (b"Td", b"TD") and len(numbers) >= 2:
                leading = -numbers[-1] if token == b"TD" else leading
                newline(*numbers[-2:])
            elif token == b"T*":
                newline(0, -leading)
            elif token in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], str):
                if token != b"Tj":
                    newline(0, -leading)
                show(stack[-1])
            elif token == b"TJ" and stack and isinstance(stack[-1], list):
                show("".join(v if isinstance(v, str) else " " if v < -200 else "" for v in stack[-1]))
            stack = []
    return out


def fragment_lines(fragments: list[Fragment]) -> list[tuple[float, str]]:
    """(letter size, text) of the lines that fragments make up, from the top: pieces at one height, left to right."""
    lines: list[list[Fragment]] = []
    for f in sorted(fragments, key=lambda f: (-f.y, f.x)):
        if lines and abs(lines[-1][0].y - f.y) <= f.size / 3:
            lines[-1].append(f)
        else:
            lines.append([f])
    return [(max(f.size for f in line), " ".join(f.text.strip() for f in sorted(line, key=lambda f: f.x)).strip()) for line in lines]


def size_headings(lines: list[tuple[float, str]]) -> list[int]:
    """Lines whose letters are clearly larger than the text's: above the median by six tenths of what the largest exceed it, if by 15 % at all."""
    sizes = sorted(s for s, _ in lines)
    if not sizes:
        return []
    middle, largest = sizes[(len(sizes) - 1) // 2], sizes[-1]
    if largest <= 1.15 * middle:
        return []
    return [i for i, (s, t) in enumerate(lines) if t and s >= middle + 0.6 * (largest - middle)]


def grid_table(fragments: list[Fragment]) -> list[list[str]] | None:
    """Rows of cells where the fragments of a page form a grid: three rows or more at an even pitch, and 3 to 12 columns that rows share."""
    if len(fragments) < 4:
        return None
    size = sorted(f.size for f in fragments)
    if size[-1] > 3 * size[0]:
        return None
    height = size[len(size) // 2]
    rows: list[list[Fragment]] = []
    for f in sorted(fragments, key=lambda f: (-f.y, f.x)):
        if rows and abs(rows[-1][0].y - f.y) <= height / 3:
            rows[-1].append(f)
        else:
            rows.append([f])
    gaps = [a[0].y - b[0].y for a, b in zip(rows, rows[1:], strict=False)]
    if len(rows) < 3 or max(gaps) > 1.5 * min(gaps):
        return None
    anchors: list[list[float]] = []
    for x in sorted(f.x for f in fragments):
        if anchors and x - anchors[-1][0] <= 3 * height:
            anchors[-1].append(x)
        else:
            anchors.append([x])
    if not 3 <= len(anchors) <= 12 or sum(len(a) > 1 for a in anchors) < 2:
        return None
    left = [min(a) for a in anchors]
    table = []
    for row in rows:
        cells = [""] * len(left)
        for f in row:
            at = max(i for i, x in enumerate(left) if x <= f.x + 1e-6)
            cells[at] = f"{cells[at]} {f.text.strip()}".strip()
        table.append(cells)
    filled = [c for row in table for c in row if c]
    if len(filled) < 0.4 * len(table) * len(left) or max(map(len, filled)) > 200 or sum(map(len, filled)) / len(filled) > 15 + height:
        return None
    return table


def table_markdown(table: list[list[str]]) -> str:
    """A grid as a Markdown table, its first row the head."""
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in table]
    return "\n".join([lines[0], "|" + " --- |" * len(table[0]), *lines[1:]])


def continued(before: list[list[str]], after: list[list[str]]) -> bool:
    """Whether a table goes on from one page to the next: as many columns, three at least. A head that is repeated is dropped by ``merge_tables``."""
    return len(before[0]) == len(after[0]) >= 3


def merge_tables(pages: list[tuple[int, list[list[str]]]]) -> list[tuple[int, list[list[str]]]]:
    """Tables by page, those that go on over consecutive pages joined under the first's page."""
    out: list[tuple[int, int, list[list[str]]]] = []
    for page, table in pages:
        if out and out[-1][1] == page - 1 and continued(out[-1][2], table):
            first, _, rows = out[-1]
            out[-1] = (first, page, rows + (table[1:] if table[0] == rows[0] else table))
        else:
            out.append((page, page, table))
    return [(first, rows) for first, _, rows in out]


def _pdf_streams(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(dictionary, unpacked data) of the streams of a file, in order."""
    for m in re.finditer(rb"<<(?P<dict>(?:(?!stream\r?\n).)*?)>>\s*stream\r?\n(?P<data>.*?)\r?\n?endstream", raw, re.S):
        data = m["data"]
        if b"/FlateDecode" in m["dict"] and b"/Image" not in m["dict"]:
            try:
                unpacking = zlib.decompressobj()
                data = unpacking.decompress(data, MEMBER_BYTES)
            except zlib.error:
                continue
            if unpacking.unconsumed_tail:
                raise ValueError(f"a stream unpacks to more than {MEMBER_BYTES} bytes")
        yield m["dict"], data


def read_pdf(raw: bytes) -> Parsed:
    """Pages of uncompressed or deflated content in file order: lines, tables as Markdown, headings by bookmarks or letter size, images.

    Object streams, encryption and fonts with their own encodings are beyond it; a reader with a full
    parser can be registered in its place.
    """
    if raw[:5] != b"%PDF-":
        raise ValueError("not a PDF file")
    meta, tags, parts, heads, offsets, images = {}, [], [], [], [], []
    for key, name in ((b"Title", "title"), (b"Author", "author"), (b"Subject", "subject"), (b"Keywords", "keywords")):
        info = re.search(rb"/Info\s+(\d+)\s+(\d+)\s+R", raw)
        block = re.search(rb"(?s)\b%s\s+%s\s+obj(.*?)endobj" % (info[1], info[2]), raw) if info else None
        if block and (m := re.search(rb"/%s\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)" % key, block[1])):
            meta[name] = _pdf_string(m[1])
    tags = [t.strip() for t in meta.pop("keywords", "").split(",") if t.strip()]
    marks = [_pdf_string(m[1]) for m in re.finditer(rb"/Title\s*(\((?:\\.|[^\\()])*\))[^>]*?/(?:Parent|Dest|Next|Prev)", raw, re.S)]
    pages: list[list[Fragment]] = []
    for kind, data in _pdf_streams(raw):
        if b"/Image" in kind:
            if b"/DCTDecode" in kind and len(data) <= IMAGE_BYTES and len(images) < MAX_IMAGES:
                images.append((max(1, len(pages)), data))
        elif b"BT" in data and (found := positioned_text(data)):
            pages.append(found)
    grids = {number: table for number, table in enumerate(map(grid_table, pages), 1) if table}
    tables, tabled = dict(merge_tables(list(grids.items()))), set(grids)
    offset = 0
    for number, fragments in enumerate(pages, 1):
        offsets.append(offset)
        lines = [(0.0, line) for line in table_markdown(tables[number]).split("\n")] if number in tables else [] if number in tabled else fragment_lines(fragments)
        large = set(size_headings(lines)) if not marks and number not in tabled else set()
        for i, (_, line) in enumerate(lines):
            if i in large or line in marks:
                heads.append((1, line, offset))
            parts.append(line)
            offset += len(line.encode()) + 1
    return Parsed("\n".join(parts), "application/pdf", "pdf", meta, heads, tags, offsets, images)


def shown_strings(content: bytes) -> str:
    """The older way over a page's content: all plain strings, then all those in arrays, whatever their place."""
    plain = re.findall(rb"(\((?:\\.|[^\\()])*\))\s*Tj", content)
    arrays = re.findall(rb"\[(.*?)\]\s*TJ", content, re.S)
    return " ".join([*map(_pdf_string, plain), *("".join(map(_pdf_string, re.findall(rb"\((?:\\.|[^\\()])*\)", a))) for a in arrays)])


REGISTRY: dict[str, Reader] = {
    ".txt": read_text, ".log": read_text, ".csv": read_text, ".md": read_markdown, ".markdown": read_markdown,
    ".docx": read_docx, ".pdf": read_pdf, ".jpg": read_image("image/jpeg"), ".jpeg": read_image("image/jpeg"), ".png": read_image("image/png"),
}
PARSED = "file_path string, file_name string, file_type string, mime string, text string, metadata map<string,string>, tags array<string>, heading_spans array<struct<level:int,text:string,offset:int>>, page_offsets array<int>, images array<struct<page:int,data:binary>>, content_hash string, file_size long, status string, error string"


def parse_files(files: DataFrame, registry: dict[str, Reader] | None = None) -> DataFrame:
    """Parses ``files`` (path, content), a row each; the schema is ``PARSED``.

    The ending, in lower case, names the reader. ``status`` is ``ok``, ``unsupported`` for an
    unknown ending, or ``error`` with the reason: a file that can't be read never stops the others.
    """
    registry = registry or REGISTRY
    schema = pa.schema([("file_path", pa.string()), ("file_name", pa.string()), ("file_type", pa.string()), ("mime", pa.string()), ("text", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("tags", pa.list_(pa.string())), ("heading_spans", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("offset", pa.int32())]))), ("page_offsets", pa.list_(pa.int32())), ("images", pa.list_(pa.struct([("page", pa.int32()), ("data", pa.binary())]))), ("status", pa.string()), ("error", pa.string())])

    def parse(path: str, raw: bytes) -> dict:
        name = path.rsplit("/", 1)[-1]
        ending = "." + name.rsplit(".", 1)[1].lower() if "." in name else ""
        row = {"file_path": path, "file_name": name, "file_type": ending[1:], "mime": None, "text": None, "metadata": None, "tags": None, "heading_spans": None, "page_offsets": None, "images": None, "status": "unsupported", "error": None}
        if ending in registry:
            try:
                p = registry[ending](raw)
            except Exception as error:  # noqa: BLE001 - any fault of a file is that file's status
                return row | {"status": "error", "error": f"{type(error).__name__}: {error}"}
            row |= {"file_type": p.kind, "mime": p.mime, "text": p.text, "metadata": list(p.metadata.items()), "tags": p.tags, "page_offsets": p.page_offsets, "status": "ok"}
            row |= {"heading_spans": [{"level": v, "text": t, "offset": o} for v, t, o in p.headings], "images": [{"page": n, "data": d} for n, d in p.images]}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(p.as_py(), c.as_py() or b"") for p, c in zip(batch.column("path"), batch.column("content"), strict=True)]
            made = pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.RecordBatch.from_arrays([*made.columns[:10], batch.column("content_hash"), batch.column("size"), *made.columns[10:]], names=[*schema.names[:10], "content_hash", "file_size", *schema.names[10:]])

    hashed = files.select("path", "content", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("size"))
    return hashed.mapInArrow(run, PARSED)
