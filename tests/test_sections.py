"""Chunkers hold one slice of a batch at a time."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import types as T

from groundline.operators import sections as S


class Rows:
    """A stand-in for a DataFrame that keeps the function given to mapInArrow."""

    columns = ["doc_id", "text"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def made(texts):
    rows = Rows()
    S._chunked(rows, "text", lambda t: S.windows(t, 500, 100))
    return rows.run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=Rows.columns)]))


def test_a_long_batch_is_cut_in_slices(spark):
    texts = ["some words. " * 300] * 3000 + [None, ""]
    out, rows = made(texts), 0
    tracemalloc.start()
    for b in out:
        rows += b.num_rows
        assert b.nbytes < 4 << 20
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 20 << 20


def test_slices_keep_every_chunk_in_order(spark):
    texts = ["", None, "x" * 3_000_000, "a b. " * 400, "é" * 700, "last"]
    got = [(i, c) for b in made(texts) for i, cs in zip(b.column(b.schema.names.index("doc_id")).to_pylist(), b.column(b.schema.names.index("chunks")).to_pylist()) for c in cs]
    want = [(i, {"text": t, "start": s, "end": e}) for i, x in enumerate(texts) for t, s, e in S.windows(x or "", 500, 100)]
    assert got == want
