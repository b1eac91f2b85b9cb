"""From raw documents to packed training sequences: the five stages of the pipeline.

Each takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last return the columns of `docs` as
they were. Operators see the columns they need and one that holds all others, so no name
of an input column can clash with theirs. Rows are told by a number of their own, never
by doc_id, which may be null or repeated; null, empty and blank texts have a rule in each
stage. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, materialize, tuned
from .langid import UNKNOWN, fit, with_language
from .mixing import mix
from .packing import pack_documents
from .quality import classify
from .simhash import near_duplicates

#: A text whose best language gets less than this is rejected.
LEAST_SCORE = 0.5
_USED = ("doc_id", "text", "lang", "source")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def _aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """`docs` with all but the used columns in one struct, and how to get them back."""
    rest = [c for c in docs.columns if c not in _USED]
    held = [F.struct(*(docs[c] for c in rest)).alias("rest")] if rest else []
    back = [F.col(c) if c in _USED else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return docs.select(*(c for c in docs.columns if c in _USED), *held), back


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """As _aside, with `row`, a number of each row; written, so that it stays the same."""
    some, back = _aside(docs)
    return Table(some.withColumn("row", F.monotonically_increasing_id()), "rows").df, back


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier keeps. Null, empty and blank texts go."""
    some, back = _aside(docs)
    return classify(some, trusted_ids(spark, sf_dir), keep_text=True).where("kept").select(*back)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose language is told; lang itself stays as it was. Texts that are
    null or have no letters go."""
    tuned(spark)
    some, back = _aside(docs)
    seen = with_language(some, fit(docs))
    return seen.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies one row, that with the smallest doc_id; of rows
    that share it, or have none, the first. Null and empty texts are one group."""
    tuned(spark)
    rows, back = _numbered(docs)
    groups = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = rows.select("row", "doc_id").join(groups, "row").groupBy("component_id").agg(F.min_by("row", order).alias("row"))
    return rows.join(first, "row", "left_semi").select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, or up to three times. Null and
    empty texts have size zero, and are taken or left like any other."""
    tuned(spark)
    rows, back = _numbered(docs)
    taken = mix(rows, uid="row").where("copies > 0").select(F.col("uid").alias("row"), "copies")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.join(taken, "row").withColumn("copies", again).select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences; a null or empty text is a
    piece of the end id alone."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learned models, fingerprints and tokenizers are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
