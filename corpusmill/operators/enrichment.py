"""Tags, summaries and captions by injected models; what a model can't do is noted and stops nothing."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.chunking import identified
from corpusmill.functions.text import normalise_tags
from corpusmill.sources.shared import written

if TYPE_CHECKING:
    from corpusmill.protocols import Captioner, Enricher

#: Bytes of a document that are gathered, and of those what a model reads.
GATHERED, READ = 8000, 4000


def enrich(chunks: DataFrame, enricher: Enricher) -> DataFrame:
    """(document_id, enrichment) with tags, summary, model and status, from the beginning of each document, captions first.

    Only what lies within the first bytes of a document is gathered, so a long one costs no more than a short one.
    """
    kind = F.col("kind") if "kind" in chunks.columns else F.lit(None).cast("string")
    captioned = F.coalesce(kind == "caption", F.lit(False))
    place = F.struct((~captioned).alias("late"), "chunk_index", F.substring("content", 1, GATHERED).alias("content"))
    # a chunk that begins beyond what is gathered adds nothing, however small chunks are
    early = chunks.filter(captioned | (F.col("start_char_idx") < GATHERED)) if "start_char_idx" in chunks.columns else chunks
    texts = early.groupBy("document_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda p: p["content"]), "\n"), 1, GATHERED).alias("text"))
    model = enricher.model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                said = text.encode()[:READ].decode(errors="ignore").strip()
                if not said:
                    rows.append(([], "", "nothing-to-enrich"))
                    continue
                try:
                    rows.append((*enricher.enrich(said), "enriched"))
                except Exception:  # noqa: BLE001 - a model's fault is that document's status
                    rows.append(([], "", "failed"))
            yield pd.DataFrame({"document_id": batch["document_id"], "tags": [r[0] for r in rows], "summary": [r[1] for r in rows], "status": [r[2] for r in rows]})

    kind = texts.schema["document_id"].dataType.simpleString()
    made = texts.mapInPandas(run, f"document_id {kind}, tags array<string>, summary string, status string")
    return made.select("document_id", F.struct(normalise_tags(F.col("tags")).alias("tags"), "summary", F.lit(model).alias("model"), F.current_timestamp().alias("generated_at"), "status").alias("enrichment"))


def images_of(documents: DataFrame) -> DataFrame:
    """(document_id, mime, page, data, sha): a row for each image of documents with an ``images`` column."""
    images = documents.select("document_id", "mime", F.explode("images").alias("image"))
    return images.select("document_id", "mime", "image.page", "image.data", F.sha2("image.data", 256).alias("sha"))


def captions_of(images: DataFrame, captioner: Captioner, known: DataFrame | None = None) -> DataFrame:
    """(sha, caption, model) of images that ``known`` has no caption of this model for, each digest once. What can't be described is left out, and asked for again next time."""
    model = captioner.model
    asked = images.dropDuplicates(["sha"]).select("sha", "data")
    asked = asked.join(known.filter(F.col("model") == model).select("sha"), "sha", "left_anti") if known is not None else asked

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for data in batch["data"]:
                try:
                    said.append(captioner.caption(bytes(data)).strip())
                except Exception:  # noqa: BLE001 - an image without a caption is left out
                    said.append("")
            yield pd.DataFrame({"sha": batch["sha"], "caption": said, "model": model})

    return asked.mapInPandas(run, "sha string, caption string, model string").filter("caption <> ''")


def caption_chunks(images: DataFrame, chunks: DataFrame, captions: DataFrame) -> DataFrame:
    """A chunk of kind ``caption`` for each document with images that have captions (sha, caption), after its last chunk."""
    lines = images.join(captions.select("sha", "caption"), "sha").groupBy("document_id", "mime").agg(F.array_sort(F.collect_list(F.struct("page", F.concat(F.lit("Figure on page "), F.col("page").cast("string"), F.lit(": "), F.col("caption")).alias("line")))).alias("lines"))
    sizes = chunks.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_index"))
    made = lines.join(sizes, "document_id", "left").withColumn("chunk_index", F.coalesce("chunk_index", F.lit(0)))
    return identified(made.select("document_id", "mime", "chunk_index", F.lit("caption").alias("kind"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content")))


def caption_images(documents: DataFrame, chunks: DataFrame, captioner: Captioner, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(caption chunks, cache): a chunk for each document with images that a model could describe.

    An image is asked for once, by its digest; ``cache`` (sha, caption, model) answers for those of before.
    """
    images = images_of(documents)
    new = written(captions_of(images, captioner, cache), "captions")
    every = new if cache is None else cache.filter(F.col("model") == captioner.model).select("sha", "caption", "model").unionByName(new)
    return caption_chunks(images, chunks, every), every
