"""Job 1: keep a keyword index up to date with a folder of documents that grows.

    spark-submit jobs/index_documents.py --documents PATH --out PATH --checkpoint PATH [--config FILE]

A file stream takes the Parquet files that have come since the last run and ends when
there are none left. Each batch becomes one segment of the index, under the batch's
number: a batch that is run again after a crash replaces its own segment, and a run
without new files changes nothing. A document that comes again replaces its older text.
`out` and `checkpoint` belong together.
"""

from __future__ import annotations

import sys
from argparse import ArgumentParser
from dataclasses import dataclass
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession

from groundline.operators.index import Bm25Index
from jobs.common import command, log


@dataclass(frozen=True)
class Settings:
    key: str = "doc_id"
    text: str = "text"
    #: Files that one batch takes at most; 0 for all there are.
    files_per_batch: int = 0


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, cfg: Settings = Settings()) -> Bm25Index:
    """Take what is new in `documents` into the index in `out`. Rows without a key are
    left out, since they couldn't be replaced; null text is an empty one."""
    documents = documents.rstrip("/")
    schema = spark.read.parquet(documents).schema
    glob = f"{documents[:-1]}[{documents[-1]}]"  # a file stream takes a single file only by a pattern
    source = spark.readStream.schema(schema)
    if cfg.files_per_batch:
        source = source.option("maxFilesPerTrigger", cfg.files_per_batch)
    index = Bm25Index(spark, out, cfg.key)

    def batch(df: DataFrame, number: int) -> None:
        later = [s["segment"] for s in index.segments() if s["segment"] > number]
        if later:
            raise ValueError(f"{out} has segments {later}, which this checkpoint has not written: they don't belong together")
        n = df.count()
        index.append(df.select(cfg.key, cfg.text), cfg.text, segment=number)
        told = index.segments()[-1]
        log.info("batch %d: read %d rows of %s, wrote segment %d: %d chunks more, %d replaced", number, n, documents, number, told["n"], told["dead"])

    stream = source.parquet(glob).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
    seen = index.segments()
    log.info("%s: %d segments, %d documents", out, len(seen), sum(s["n"] for s in seen))
    return index


if __name__ == "__main__":
    p = ArgumentParser("index_documents", description=__doc__)
    for name in ("documents", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    command(p, Settings, Path(__file__).with_suffix(".json"), run)
