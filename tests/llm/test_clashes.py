"""Operators over tables whose further columns have the names that plans like to use inside."""

import ast
import inspect

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpusmill.llm as llm
from corpusmill.llm import bpe, chat, exact_dedup, fixity, jaccard, packing, passages, quality, secrets, sharding

MODULES = (bpe, chat, exact_dedup, fixity, jaccard, packing, passages, quality, secrets, sharding, llm.common, llm.components)
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def scratch_names():
    """Every string in the operators' sources that could name a column and isn't one that they return or read."""
    found = set()
    for module in MODULES:
        for node in ast.walk(ast.parse(inspect.getsource(module))):
            if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.isidentifier():
                found.add(node.value)
    taken = {"doc_id", "text", "lang", "source", "n_chars", "conv_id", "turn", "role", "page_id", "url", "html", "_metadata"}
    return sorted(found - taken)


NAMES = [*scratch_names(), "a.b", "with `tick`", "_metadata"]


def widened(spark, tmp_path_factory, rows, schema, drop=()):
    """The rows with a further column for each name, stored as Parquet. The values tell if one is overwritten."""
    seen, names = {c.split()[0].lower() for c in schema.split(", ")}, []
    for n in NAMES:
        if n.lower() not in seen and n not in drop:
            seen.add(n.lower())
            names.append(n)
    path = str(tmp_path_factory.mktemp("wide") / "t.parquet")
    df = spark.createDataFrame(rows, schema)
    df.select("*", *(F.concat(F.lit(f"{i}:"), F.col(df.columns[0]).cast("string")).alias(n) for i, n in enumerate(names))).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    said = "the cat of the house and the dog to a tree in the park is that it was for on " * 4
    texts = [None, "", said, said.upper(), said + "more", "password = abcdefgh123", "one two", None, said]
    rows = [(i if i != 4 else None, t, "en", "s", 1) for i, t in enumerate(texts)]
    return widened(spark, tmp_path_factory, rows, "doc_id long, text string, lang string, source string, n_chars long")


def plain(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def bag(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


REPORTS = {
    "shards": sharding.shard_documents,
    "secrets": secrets.scan_secrets,
    "bpe": lambda d: bpe.encode_documents(d, WORDS),
    "components": jaccard.jaccard_components,
    "dedup": exact_dedup.dedup_report,
    "packing": lambda d: packing.pack_documents(d, BYTES, capacity=32).drop("sequence_id", "offset"),
    "passages": passages.remove_passages,
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports_read_no_other_column(docs, name):
    wide, narrow = REPORTS[name](docs), REPORTS[name](plain(docs))
    assert wide.columns == narrow.columns
    # what depends on where rows are stored is not compared
    columns = [c for c in wide.columns if c not in ("slot", "kept")]
    assert bag(wide, columns) == bag(narrow, columns)


MADE = ("kept", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "common_distance", "base_failed")
KEEPERS = {
    "copies": exact_dedup.drop_copies,
    "near copies": jaccard.drop_near_copies,
    "redacted": secrets.redact_secrets,
    "rules": quality.score_quality,
}


@pytest.mark.parametrize("name", KEEPERS)
def test_other_columns_pass_unchanged(docs, name):
    out = KEEPERS[name](docs)
    columns = [c for c in docs.columns if c in out.columns]
    assert name == "rules" or out.columns == docs.columns
    others = ["`" + c.replace("`", "``") + "`" for c in columns if c not in ("text", "n_chars", "doc_id", "lang", "source") and (name != "rules" or c not in MADE)]
    before = {tuple(r) for r in docs.select("doc_id", *others).collect()}
    after = [tuple(r) for r in out.select("doc_id", *others).collect()]
    assert after and set(after) <= before
    want = KEEPERS[name](plain(docs))
    assert sorted(map(repr, (r.doc_id for r in want.collect()))) == sorted(repr(r[0]) for r in after)


def test_rules_replace_columns_of_their_results(docs):
    out = quality.score_quality(docs)
    assert {r.n_words for r in out.collect()} == {r.n_words for r in quality.score_quality(plain(docs)).collect()}


def test_chat_and_fixity(spark, tmp_path_factory):
    talk = widened(spark, tmp_path_factory, [(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, 0, None, "x")], "conv_id long, turn long, role string, text string", drop=("parts",))
    wide = chat.conversation_digests(talk)
    assert bag(wide, wide.columns) == bag(chat.conversation_digests(talk.select("conv_id", "turn", "role", "text")), wide.columns)
    pages = widened(spark, tmp_path_factory, [(i, f"u{i}", None if i == 3 else "x" * i) for i in range(12)] + [(5, "u5", "x"), (None, None, None)], "page_id long, url string, html string")
    wide = fixity.audit(pages, fixity.damaged_copy(pages), 4, 2)
    narrow = pages.select("page_id", "url", "html")
    assert bag(wide, wide.columns) == bag(fixity.audit(narrow, fixity.damaged_copy(narrow), 4, 2), wide.columns)
