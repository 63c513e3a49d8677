"""Column expressions for text: normalising, tokens, identity, fingerprints. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the index leaves out.
STOPWORDS = ("the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "is", "are", "was", "were", "be", "been", "with", "as", "at", "by", "this", "that", "it", "from")
TOKEN_PATTERN = r"[\p{L}\p{Nd}]+"
SPACE = r"(?U)\s+"


def collapse(text: Column) -> Column:
    """Lower case, every run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def fields(text: Column) -> Column:
    """White-space separated words of the collapsed text; none for a blank one."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Index terms: lower-cased runs of letters and digits without stopwords, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0)), lambda t: ~t.isin(*STOPWORDS))


def token_estimate(text: Column) -> Column:
    """Model tokens by rule of thumb: 1.3 for each word, rounded up."""
    return F.ceil(F.size(fields(text)) * F.lit(1.3)).cast("int")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def generate_id(content: Column, mime: Column, metadata: Column) -> Column:
    """Content address: digest of content, type and ``key=value`` pairs by key, run together."""
    pairs = F.transform(F.array_sort(F.map_keys(metadata)), lambda k: F.concat(k, F.lit("="), metadata[k]))
    return F.sha2(F.concat(content, mime, F.array_join(pairs, "")), 256)


def document_identity(content: Column, mime: Column, metadata: Column, transient: tuple[str, ...] = ("heading_spans", "images", "page_offsets")) -> Column:
    """The content address of what a reader gave, without the metadata that only the way in needs."""
    return generate_id(content, mime, F.map_filter(metadata, lambda k, _: ~k.isin(*transient)))


def chunk_identity(content: Column, mime: Column, document_id: Column, index: Column) -> Column:
    """The content address of a chunk: text, type, document and place."""
    return generate_id(content, mime, F.create_map(F.lit("doc"), document_id, F.lit("idx"), index.cast("string")))


def text_metadata(text: Column) -> Column:
    """What the plain-text reader notes of a file: bytes, encoding, lines."""
    lines = F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")))
    return F.create_map(F.lit("char_count"), F.octet_length(text).cast("string"), F.lit("encoding"), F.lit("utf-8"), F.lit("line_count"), lines.cast("string"))


def preview(text: Column, n: int = 160) -> Column:
    """One line of at most n bytes, with an ellipsis where it is cut; a character that the cut would split goes whole."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(line, "UTF-8"), 1, n).cast("string")), "\uFFFD+$", "")
    return F.when(F.octet_length(line) > n, F.concat(cut, F.lit("…"))).otherwise(line)


def luhn_valid(number: Column) -> Column:
    """Card numbers of 13 to 19 digits, blanks and dashes ignored, that pass the check digit."""
    digits = F.regexp_replace(number, "[ -]", "")
    return F.coalesce(digits.rlike(r"\A[0-9]{13,19}\z") & F.call_function("luhn_check", digits), F.lit(False))


def word_hash(word: Column) -> Column:
    """The first 64 bits of the word's SHA-256, as a signed number."""
    return F.conv(F.substring(F.sha2(word, 256), 1, 16), 16, -10).cast("long")


def normalise_tags(tags: Column, limit: int = 5) -> Column:
    """Lower case, blanks to dashes, outer punctuation off, no repeats, at most ``limit``."""
    clean = F.transform(tags, lambda t: F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), r"\s+", "-"), r"^[.,;:!?\"'#-]+|[.,;:!?\"'#-]+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: t != "")), 1, limit)


def tag_union(front: Column, auto: Column) -> Column:
    """Tags of the front matter, split at commas and not trimmed, and those that were generated."""
    return F.array_distinct(F.concat(F.filter(F.split(F.coalesce(front, F.lit("")), ","), lambda t: t != ""), F.coalesce(auto, F.array().cast("array<string>"))))
