"""The jobs as queries: each is run twice into a new folder, and its output read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline import queries as Q
from groundline.session import prepare
from groundline.sources.tables import new_path
from jobs import answer_questions, index_documents


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    at = new_path(spark, "job1")
    for _ in range(2):
        index = index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/checkpoint")
    return index.postings().select("doc_id", "term", "tf", "dl")


def job2_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    at = new_path(spark, "job2")
    for _ in range(2):
        out = answer_questions.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", at)
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("query_id", "decision", "reason", r("confidence"), "best_doc", r("best_score"), "answer")


QUERIES = {f.__name__: f for f in (job1_index_documents, job2_answer_questions)}

ORACLES = {
    "job1_index_documents": f"""
WITH {Q.DOCS}, {Q.TF} SELECT doc_id, term, tf::BIGINT AS tf, len(tokens)::BIGINT AS dl FROM tf JOIN toks USING (doc_id)
""",
    "job2_answer_questions": f"""
WITH {Q.GATE}, {Q.KEYS}, {Q.TOLD}
SELECT query_id, decision, reason, round(confidence, 6) AS confidence, c.doc_id AS best_doc, round(c.score, 6) AS best_score,
  CASE WHEN decision = 'ANSWER' THEN answer END AS answer
FROM gd LEFT JOIN (FROM cand WHERE rank = 1) c USING (query_id) LEFT JOIN an USING (query_id)
""",
}
