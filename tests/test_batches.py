"""What a worker makes of a batch at once is bounded by bytes of text, whatever the batch holds."""

import pyarrow as pa
import pytest

from corpusmill.functions import batches, chunking, scoring


def test_slices_keep_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(batches, "SLICE", 10)
    texts = ["a" * 4, "b" * 5, "é" * 5, None, "", "c" * 30, "d", "e" * 9, "f"]
    whole = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(9))], names=["text", "n"])
    parts = [p.column("text").to_pylist() for p in batches.slices(iter([whole.slice(0, 0), whole.slice(0, 6), whole.slice(6)]), "text")]
    assert [t for p in parts for t in p] == texts
    assert parts == [["a" * 4, "b" * 5], ["é" * 5, None, ""], ["c" * 30], ["d", "e" * 9], ["f"]]


@pytest.mark.parametrize("call, column", [(lambda d: chunking.chunk_documents(d), "text"), (lambda d: scoring.poison_scores(d), "norm")])
def test_workers_take_batches_in_slices(spark, monkeypatch, call, column):
    """The function that Spark gets is run here on one large batch; it passes on many."""
    seen = []
    frame = type(spark.range(0))
    own = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *a, **b: (seen.append((run, self.columns)), own(self, run, *a, **b))[1])
    call(spark.createDataFrame([(1, "x")], "document_id long, text string"))
    run, columns = seen[0]
    text = pa.array(["word " * 2000 + "end."] * 500)
    made = {"row": pa.array([{"x": 1}] * 500), "document_id": pa.array(range(500)), "mime": pa.nulls(500, pa.string()), "heading_spans": pa.nulls(500, pa.list_(pa.string())), "edits": pa.nulls(500, pa.list_(pa.string()))}
    given = pa.RecordBatch.from_arrays([text if c == column else made[c] for c in columns], names=columns)
    assert len(list(run(iter([given])))) >= 4
