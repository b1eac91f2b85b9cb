"""Job 2: answer a table of questions from a table of documents, or refuse.

    spark-submit jobs/answer_questions.py --documents PATH --questions PATH --out PATH [--index PATH] [--config FILE]

Each question gets its best documents by keywords, the gate's decision with its reason,
and the key sentences with their citations where the gate lets it be answered. The rows
are written by decision. A run writes the whole table anew, so it may be repeated. With
`--index` an index that job 1 keeps is asked; without, the postings of the questions' own
terms are made, which is far less than an index that is asked once.
"""

from __future__ import annotations

import sys
from argparse import ArgumentParser
from dataclasses import dataclass
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.config import Config
from groundline.operators import answers, ranking
from groundline.operators.index import Bm25Index, unique
from groundline.sources.tables import written
from jobs.common import command, log


@dataclass(frozen=True)
class Settings:
    doc_key: str = "doc_id"
    file_column: str = "source"
    question_key: str = "item_id"
    text: str = "text"
    top_k: int = 5
    weak_threshold: float = 8.0


def run(spark: SparkSession, documents: str, questions: str, out: str, cfg: Settings = Settings(), index: str | None = None) -> DataFrame:
    """Write (query_id, decision, reason, confidence, best_doc, best_score, answer) to
    `out`/answers, by decision, and read it back. A refused question has a null answer,
    one without candidates also null best_doc and best_score."""
    docs = spark.read.parquet(documents)
    asked = spark.read.parquet(questions).select(F.col(cfg.question_key).alias("query_id"), F.coalesce(F.col(cfg.text), F.lit("")).alias("question"))
    text = docs.select(F.col(cfg.doc_key).alias("doc_id"), F.col(cfg.file_column).alias("filename"), cfg.text)
    if index:
        held = Bm25Index(spark, index, cfg.doc_key)
        n, scored = sum(s["n"] for s in held.segments()), held.score(asked, k=cfg.top_k).withColumnRenamed(cfg.doc_key, "doc_id")
    else:
        one = unique(docs, cfg.doc_key, cfg.text).withColumnRenamed(cfg.doc_key, "doc_id")
        n, scored = one.count(), ranking.bm25(one, asked, text="_text", k=cfg.top_k)
    scored = scored.withColumn("score", F.round("score", 9))  # sums differ in their last digits by the order of their terms
    ranked = written(ranking.top(scored, cfg.top_k), "ranked")  # few narrow rows, which are sent to the texts
    found = (
        ranked.join(text.withColumnRenamed(cfg.text, "text"), "doc_id").join(asked, "query_id")
        .withColumn("chunk_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
        .withColumn("page_number", F.lit(1)).withColumn("section_title", F.lit("Main"))
    )
    found = written(found, "candidates")
    rules = Config(weak_threshold=cfg.weak_threshold)
    decided = answers.gate(asked, found, rules).select("query_id", "decision", "reason", "confidence")
    best = found.where("rank = 1").select("query_id", F.col("doc_id").alias("best_doc"), F.col("score").alias("best_score"))
    rows = decided.join(best, "query_id", "left").join(answers.build_answers(found, rules), "query_id", "left")
    told = rows.withColumn("answer", F.when(F.col("decision") == "ANSWER", F.col("answer")))
    told.write.mode("overwrite").partitionBy("decision").parquet(f"{out}/answers")
    read = spark.read.parquet(f"{out}/answers")
    for r in read.groupBy("decision").count().collect():  # two decisions
        log.info("%s: %d of the questions of %s, over %d documents of %s", r["decision"], r["count"], questions, n, index or documents)
    return read


if __name__ == "__main__":
    p = ArgumentParser("answer_questions", description=__doc__)
    for name in ("documents", "questions", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--index")
    command(p, Settings, Path(__file__).with_suffix(".json"), run)
