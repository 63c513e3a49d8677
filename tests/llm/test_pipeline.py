"""The pipeline as a whole against a brute-force version, and each stage's contract."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from test_operators import brute_components, brute_quality, fold
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm import quality, secrets

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def distance(counts, shares):
    n, m, total = sum(counts), sum(shares), 0.0
    for a, b in zip(counts, shares, strict=True):
        p, q = a / n, b / m
        total += sum(x * math.log2(2 * x / (p + q)) / 2 for x in (p, q) if x)
    return math.sqrt(max(total, 0))


def brute_kept(text, lang):
    text = text or ""
    n_words, word_chars, _, _, _, failed = brute_quality(text)
    if failed:
        return False
    if len(text) >= 100:
        letters, digits, points = len(regex.findall(r"\p{L}", text)), len(re.findall("[0-9]", text)), sum(c in ".,;:!?'\"()-" for c in text)
        classes = (letters, len(text) - word_chars, digits, points, word_chars - letters - digits - points)
        if distance(classes, quality.REFERENCES[lang].classes if lang in quality.REFERENCES else quality.ANY_CLASSES) > 0.25:
            return False
    if lang in quality.REFERENCES:
        listed, found = quality.REFERENCES[lang].words, Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
        counts, shares = [found[w] for w in listed], list(listed.values())
        if n_words >= 100 and distance([*counts, n_words - sum(counts)], [*shares, 1000 - sum(shares)]) > 0.28:
            return False
        if n_words >= 200 and (not sum(counts) or distance(counts, shares) > 0.55):
            return False
    return True


def brute_pipeline(rows):
    """(doc_id, piece, start, length, crc) of what is left of (doc_id, text, lang)."""
    rows = [r for r in rows if brute_kept(r[1], r[2])]
    last = {}
    for r in rows:
        last[fold(r[1])] = max(last.get(fold(r[1]), r), r, key=lambda x: x[0])
    rows = list(last.values())
    first = {c for _, _, c in brute_components(rows, corpus_pipeline.NEAR)}
    scanner, library = secrets.SecretScanner(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for doc_id, text, _ in (r for r in rows if r[0] in first):
        ids = np.array([*library.encode(scanner.redact(text), add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


def test_run_equals_brute_force(spark, documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    out = corpus_pipeline.run(spark, TABLES).collect()
    want = brute_pipeline(rows)
    assert len(want) < len(rows) * 3 and Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 1024


def test_stages_keep_the_columns_of_documents(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, TABLES)
        assert after.columns == documents.columns, name
        docs = after


def test_stages_take_an_empty_table(spark, documents):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), TABLES).count() == 0, name
