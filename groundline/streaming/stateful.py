"""Versions of arriving files kept as state: what a batch costs doesn't grow with history.

Two stateful steps, one a query each: by content, which file brought it first; by file
name, how many contents it has had. Each keeps one small value a key in the stream's
state store, so earlier rows are never read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FIRSTS = "filename string, seq string, content_hash string, kept boolean"
STATUS = "filename string, seq string, content_hash string, status string, version long"


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("seq", kind="stable")


class First(StatefulProcessor):
    """Of rows of one content the first that ever came is kept."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        d = _sorted(rows)
        kept = pd.Series(False, index=range(len(d)))
        if not self.seen.exists():
            kept[0] = True
            self.seen.update((True,))
        yield pd.DataFrame({"filename": d["filename"].values, "seq": d["seq"].values, "content_hash": d["content_hash"].values, "kept": kept.values})

    def close(self) -> None:
        pass


class Versions(StatefulProcessor):
    """Kept rows of one file name count on from its last version."""

    def init(self, handle) -> None:
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        d = _sorted(rows)
        last = self.version.get()[0] if self.version.exists() else 0
        numbers = last + d["kept"].astype("int64").cumsum()
        status = ["DUPLICATE_IGNORED" if not k else "UPDATED_NEW_VERSION" if v > 1 else "CREATED" for k, v in zip(d["kept"], numbers)]
        if d["kept"].any():
            self.version.update((int(numbers.iloc[-1]),))
        version = numbers.where(d["kept"]).astype("Int64")
        yield pd.DataFrame({"filename": d["filename"].values, "seq": d["seq"].values, "content_hash": d["content_hash"].values, "status": status, "version": version.values})

    def close(self) -> None:
        pass


def _run(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest_with_state(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Take what has come of `stream` (filename, seq, content_hash, ...) and give all
    status rows so far, (filename, seq, content_hash, status, version), from `table`.

    What `lineage.ingest` says of the same batches. Rows of one batch are in order of
    `seq`. The file sinks and checkpoints of both steps make a run that is cut short go
    on where it was. Sets the state store that these steps need, and sets it back."""
    spark: SparkSession = stream.sparkSession
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        rows = stream.selectExpr("filename", "string(seq) AS seq", "content_hash")
        firsts = rows.groupBy("content_hash").transformWithStateInPandas(First(), FIRSTS, "Append", "None")
        _run(firsts, f"{table}/firsts", f"{checkpoint}/firsts")
        told = spark.readStream.schema(FIRSTS).parquet(f"{table}/firsts").groupBy("filename").transformWithStateInPandas(Versions(), STATUS, "Append", "None")
        _run(told, f"{table}/status", f"{checkpoint}/status")
    finally:
        if was is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, was)
    return spark.read.schema(STATUS).parquet(f"{table}/status")
