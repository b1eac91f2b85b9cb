"""What the operators of this subpackage share: tables in the shared folder,
connected components, and Arrow batch sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.session import prepare

#: Rows and bytes of an Arrow batch handed to Python, so that long texts and packed blocks stay bounded.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20
_own: list[str] = []


def tuned(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches; put the package on the workers' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of
    our own where the session has none (tests on one machine)."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="groundline-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fs_path(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = fs_path(spark, path)
    fs.delete(p, True)


class Table:
    """A DataFrame written once in the shared folder; it outlives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return Table(df, name).df


def as_arrow(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest
    node reachable.

    Alternating large-star and small-star rounds: each round is two shuffles on node
    ids, the number of rounds grows with the logarithm of a component's diameter.
    Each round's edges are written to the shared folder and the one before removed;
    nothing but a count and a checksum reaches the driver. The least neighbours are
    written before they are joined, so both sides of that join are plain shuffles and a
    hub's rows can be dealt to several tasks. Self-loops are kept as nodes of their own;
    nulls are dropped. Empty input gives an empty result.
    """
    seen = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    now = Table(
        seen.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    loops = seen.where("a = b").select(F.col("a").alias("node")).distinct()
    mark = None
    while True:
        e = now.df
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = Table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = (
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
            .join(least.df, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        lows = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(lows, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(lows.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        then = Table(small, "edges")
        got = then.df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        now.drop()
        least.drop()
        now = then
        if tuple(got) == mark:
            break
        mark = tuple(got)
    e = now.df
    found = e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        e.select("lo", "lo").distinct()
    )
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(alone)
