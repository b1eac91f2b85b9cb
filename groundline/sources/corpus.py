"""Reading and writing corpus files, manifests, questions, histories and traces."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.operators.lineage import fingerprint
from groundline.sources.tables import fs_path

EXTENSIONS = ("pdf", "md", "markdown", "txt")
QUESTIONS = (
    "question_id string, category string, question string, expected_answer string, should_abstain boolean, "
    "expected_abstention_reason string, golden_doc_filenames array<string>, golden_passage_keywords array<string>, "
    "conflicting_source_pairs array<array<string>>"
)
SCANNED = "filename string, file_type string, content binary, content_hash string, source_type string, seq string"
HISTORY = "query string, decision string, answer string, target string, timestamp double"


def scan(spark: SparkSession, folder: str, source_type: str = "corpus") -> DataFrame:
    """(filename, file_type, content, content_hash, source_type, seq) of a folder's files
    in order of name; sub-folders are not entered. Endings count in any case. A folder
    that isn't there has no files."""
    fs, at = fs_path(spark, folder)
    if not fs.exists(at):
        return spark.createDataFrame([], SCANNED)
    anycase = lambda e: "".join(f"[{c}{c.upper()}]" for c in e)
    pattern = "*.{" + ",".join(map(anycase, EXTENSIONS)) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = file_type(name)
    return files.select(
        name.alias("filename"), kind.alias("file_type"), "content", fingerprint(F.col("content")).alias("content_hash"),
        F.lit(source_type).alias("source_type"), name.alias("seq"),
    )


def save_upload(spark: SparkSession, folder: str, filename: str, content: bytes) -> str:
    """Land one uploaded file in `folder`, over one of its name; its path. Names hold no folders."""
    if not filename or "/" in filename or filename in (".", ".."):
        raise ValueError(f"{filename!r} is no file name")
    fs, at = fs_path(spark, f"{folder}/{filename}")
    out = fs.create(at, True)
    out.write(content)
    out.close()
    return at.toString()


def totals(docs: DataFrame, secs: DataFrame) -> DataFrame:
    """(documents, sections, characters) of (doc_id, text) and their sections: one row."""
    n = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("characters"))
    return n.join(F.broadcast(secs.agg(F.count("*").alias("sections")))).select("documents", "sections", "characters")


def with_origin(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates with source_type of their file, `corpus` where none is told, and the
    badge that shows it."""
    kinds = stored.groupBy("filename").agg(F.max("source_type").alias("source_type"))
    out = candidates.join(kinds, "filename", "left").withColumn("source_type", F.coalesce("source_type", F.lit("corpus")))
    return out.withColumn("badge", F.when(F.col("source_type") == "uploaded", "User Upload").otherwise("Corpus Library"))


def shown_candidates(candidates: DataFrame) -> DataFrame:
    """The columns of candidates that an answer shows."""
    return candidates.select(
        "query_id", "chunk_id", F.col("filename").alias("doc_filename"), "page_number", "section_title", "rank", F.bround("score", 4).alias("score"),
        "method_scores", "method_ranks", "text", F.col("prefix").alias("context_prefix"),
    )


def shown_citations(verified: DataFrame) -> DataFrame:
    """The columns of checked citations that a trace keeps; claims to 120 characters."""
    return verified.select(
        "query_id", "claim_no", "cite_no", F.col("filename").alias("doc_filename"), F.col("page_number").alias("page"),
        F.col("section_title").alias("section"), "chunk_id", F.col("alignment").alias("alignment_score"), F.col("faithful").alias("is_faithful"),
        F.substring("claim_text", 1, 120).alias("claim"),
    )


def file_type(name):
    n = F.lower(name)
    return F.when(n.endswith(".pdf"), "pdf").when(n.endswith(".md") | n.endswith(".markdown"), "markdown").otherwise("text")


def decoded(files: DataFrame) -> DataFrame:
    """Text files with `text`: UTF-8 with replacement, line ends as line feeds."""
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    return files.where("file_type <> 'pdf'").withColumn("text", F.regexp_replace(raw, "\r\n?", "\n"))


def pdf_pages(files: DataFrame, extract: Callable[[bytes], Iterator[str]] | None = None) -> DataFrame:
    """(filename, page_number, text) of PDF files; `extract` gives a file's page texts,
    by default with pypdf, which has to be installed where it runs."""
    import pandas as pd

    def pages(content: bytes) -> Iterator[str]:
        import io

        from pypdf import PdfReader

        return ((p.extract_text() or "") for p in PdfReader(io.BytesIO(content)).pages)

    read = extract or pages

    def run(it):
        for d in it:
            yield pd.DataFrame([(f, i + 1, t) for f, c in zip(d["filename"], d["content"], strict=True) for i, t in enumerate(read(c))], columns=["filename", "page_number", "text"])

    raw = files.where("file_type = 'pdf'").select("filename", "content").mapInPandas(run, "filename string, page_number long, text string")
    clean = F.replace(F.replace(F.col("text"), F.lit("\x00"), F.lit("")), F.lit("&amp;"), F.lit("&"))
    return raw.withColumn("text", F.regexp_replace(clean, r"(?U)^\s+|\s+$", ""))


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def save_manifest(docs: DataFrame, path: str, mode: str = "append") -> None:
    """One write per batch, not one per file."""
    docs.write.mode(mode).json(path)


def load_manifest(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def recent_history(history: DataFrame, n: int = 8) -> DataFrame:
    return history.orderBy(F.desc("timestamp")).limit(n)


def missing_files(corpus: DataFrame, stored: DataFrame) -> DataFrame:
    return corpus.join(stored, "filename", "left_anti")


def load_history(spark: SparkSession, path: str) -> DataFrame:
    fs, at = fs_path(spark, path)
    return spark.read.schema(HISTORY).json(path) if fs.exists(at) else spark.createDataFrame([], HISTORY)


def traces(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, trace): a JSON document a query with its decision and candidates."""
    shown = F.struct("rank", "chunk_id", F.bround("score", 4).alias("score"), F.concat(F.substring("text", 1, 100), F.lit("...")).alias("snippet"))
    listed = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("candidates"))
    all_ = results.join(listed, "query_id", "left")
    return all_.select("query_id", F.to_json(F.struct("question", "decision", "reason", "confidence", "answer", "candidates")).alias("trace"))


def save_traces(rows: DataFrame, path: str, stages: dict[str, float]) -> DataFrame:
    """Append traces, each with a trace_id, the time, and the milliseconds of its batch's
    stages; what was written."""
    took = F.create_map(*(F.lit(x) for kv in stages.items() for x in kv)) if stages else F.lit(None).cast("map<string,double>")
    batch = str(uuid.uuid4())
    out = rows.select(
        F.uuid().alias("trace_id"), F.lit(batch).alias("batch"), F.current_timestamp().alias("timestamp"), took.alias("stage_ms"),
        F.lit(float(sum(stages.values()))).alias("total_ms"), "query_id", "trace",
    )
    out.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path).where(F.col("batch") == batch)


def trace_by_id(spark: SparkSession, path: str, trace_id: str) -> DataFrame:
    """One trace's row, or none."""
    return spark.read.parquet(path).where(F.col("trace_id") == trace_id)


def save_metrics(metrics: DataFrame, failures: DataFrame, path: str) -> str:
    """Write an ablation's metrics and failure cases as JSON; its rows as a Markdown table."""
    metrics.write.mode("overwrite").json(f"{path}/ablation_metrics")
    failures.write.mode("overwrite").json(f"{path}/all_failures")
    rows = metrics.collect()  # one a configuration
    head = f"| {' | '.join(metrics.columns)} |\n|{' --- |' * len(metrics.columns)}"
    return "\n".join([head, *(f"| {' | '.join(map(str, r))} |" for r in rows)])
