"""Ingest of arriving files as a stream: each micro-batch is one versioned batch."""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundline.operators.lineage import fingerprint, ingest
from groundline.sources.tables import fs_path

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (filename, seq, content, content_hash) of files that arrive."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.{[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN],[tT][xX][tT]}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("filename"), name.alias("seq"), "content", fingerprint(F.col("content")).alias("content_hash"))


def ingest_stream(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each batch's status rows to the Parquet folder `table`; versions go on from
    what other batches kept there. Rows stand under the stream's id, which its checkpoint
    keeps, and the batch's number: a batch that is run again replaces its own rows, and a
    new checkpoint adds to what older ones left."""
    spark = stream.sparkSession
    held: list[StreamingQuery] = []
    begun = Event()

    def batch(df: DataFrame, number: int) -> None:
        begun.wait(60)
        known, run = None, held[0].id
        fs, at = fs_path(spark, table)
        if fs.exists(at):
            kept = spark.read.option("basePath", table).parquet(table).where(~((F.col("stream") == run) & (F.col("batch") == number)) & F.col("version").isNotNull())
            known = kept.select("filename", "version", "content_hash")
        ingest(df, known).drop("content").write.mode("overwrite").parquet(f"{table}/stream={run}/batch={number}")

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    held.append(out.trigger(availableNow=True).start() if once else out.start())
    begun.set()
    return held[0]
