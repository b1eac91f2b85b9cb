"""Content fingerprints, exact duplicates and versions of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fingerprint(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def ingest(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Status and version of arriving files (filename, seq, content_hash).

    A content seen before, in any file, is DUPLICATE_IGNORED; a new content of a known
    name is UPDATED_NEW_VERSION; else CREATED. `known` (filename, version,
    content_hash) is what earlier batches kept. Two windows: by content, then by name.
    """
    first = F.row_number().over(W.partitionBy("content_hash").orderBy("seq"))
    seen = files.withColumn("_n", first)
    base: Column = F.lit(0)
    old: Column = F.lit(False)
    if known is not None:
        hashes = known.select("content_hash", F.lit(True).alias("_old")).distinct()
        tops = known.groupBy("filename").agg(F.max("version").alias("_base"))
        seen = seen.join(hashes, "content_hash", "left").join(tops, "filename", "left")
        base, old = F.coalesce("_base", F.lit(0)), F.coalesce("_old", F.lit(False))
    seen = seen.withColumn("_kept", (F.col("_n") == 1) & ~old)
    earlier = F.sum(F.col("_kept").cast("int")).over(W.partitionBy("filename").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    version = (base + earlier).cast("long")
    status = F.when(~F.col("_kept"), "DUPLICATE_IGNORED").when(version > 1, "UPDATED_NEW_VERSION").otherwise("CREATED")
    return seen.select(*files.columns, status.alias("status"), F.when(F.col("_kept"), version).alias("version"))


def duplicates(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, first_id, is_duplicate) of (key, content_hash): the smallest key of each content."""
    firsts = rows.groupBy("content_hash").agg(F.min(key).alias("first_id"))
    return rows.join(firsts, "content_hash").select(key, "first_id", (F.col(key) != F.col("first_id")).alias("is_duplicate"))


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"))


def active(versions: DataFrame) -> DataFrame:
    """The newest version of each filename."""
    newest = F.row_number().over(W.partitionBy("filename").orderBy(F.desc("version")))
    return versions.where("version is not null").withColumn("_n", newest).where("_n = 1").drop("_n")
