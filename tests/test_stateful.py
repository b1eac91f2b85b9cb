"""Versions kept as state: equal to batches, across restarts, without reading history."""

from pyspark.sql import functions as F

from groundline.operators.lineage import fingerprint, ingest
from groundline.streaming.stateful import ingest_with_state

BATCHES = [
    [("a.md", "1", "one"), ("b.md", "2", "one"), ("a.md", "3", "two"), ("c.md", "4", None)],
    [("a.md", "5", "one"), ("a.md", "6", "three"), ("d.md", "7", "three"), ("b.md", "8", "four")],
    [("b.md", "9", "five"), ("b.md", "91", "six"), ("c.md", "92", ""), ("a.md", "93", "six")],
]


def test_state_equals_batches_across_restarts(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    schema, known, want = "filename string, seq string, text string", None, []
    for rows in BATCHES:
        df = spark.createDataFrame(rows, schema).withColumn("content_hash", fingerprint(F.coalesce("text", F.lit(""))))
        got = ingest(df.drop("text"), known)
        want += [tuple(r) for r in got.select("filename", "seq", "content_hash", "status", "version").collect()]
        kept = got.where("version is not null").select("filename", "version", "content_hash")
        known = kept if known is None else known.unionByName(kept)
        df.drop("text").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # the second run finds nothing new
            stream = spark.readStream.schema("filename string, seq string, content_hash string").parquet(f"{tmp_path}/in")
            out = ingest_with_state(stream, f"{tmp_path}/table", f"{tmp_path}/mark")
            assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
