"""Metrics of retrieval, citations and abstention over labelled questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevant(filename: Column, text: Column, files: Column, keywords: Column) -> Column:
    """Whether a chunk is of a golden file (part of its name, if any is asked for) and
    holds two fifths of the golden keywords, one at least (if any is asked for)."""
    named = (F.size(files) == 0) | F.exists(files, lambda g: F.contains(F.lower(filename), F.lower(g)))
    hits = F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k))))
    return named & ((F.size(keywords) == 0) | (hits >= F.greatest(F.lit(1.0), F.size(keywords) * 0.4)))


def rank_metrics(labelled: DataFrame) -> DataFrame:
    """(query_id, first_hit, recall_1, recall_3, recall_5, rr_5, ndcg_5) of candidates
    (query_id, rank, relevant); only ranks up to five count. nDCG takes one relevant
    chunk as the ideal and stops at 1."""
    hit = F.when(F.col("relevant") & (F.col("rank") <= 5), F.col("rank"))
    by = labelled.groupBy("query_id").agg(F.min(hit).alias("first_hit"), F.sum(1 / F.log2(hit + 1)).alias("dcg"))
    at = lambda k: F.coalesce((F.col("first_hit") <= k).cast("long"), F.lit(0).cast("long"))
    return by.select(
        "query_id", F.col("first_hit").cast("long"), *(at(k).alias(f"recall_{k}") for k in (1, 3, 5)),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("rr_5"), F.coalesce(F.least(F.lit(1.0), "dcg"), F.lit(0.0)).alias("ndcg_5"),
    )


def abstention(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates of (should_abstain, abstained); F1 comes from the
    rounded precision and recall."""
    s, a = F.col("should_abstain"), F.col("abstained")
    n = pairs.groupBy(*(by or [])).agg(
        *(F.count_if(x).alias(k) for k, x in (("tp", s & a), ("fp", ~s & a), ("tn", ~s & ~a), ("fn", s & ~a)))
    )
    share = lambda x, y: F.when(y > 0, F.bround(x / F.greatest(y, F.lit(1)), 4)).otherwise(0.0)
    c = F.col
    out = n.select(
        "*", share(c("tp") + c("tn"), c("tp") + c("fp") + c("tn") + c("fn")).alias("accuracy"),
        share(c("tp"), c("tp") + c("fp")).alias("precision"), share(c("tp"), c("tp") + c("fn")).alias("recall"),
    )
    both = c("precision") + c("recall")
    return out.withColumn("f1", F.when(both > 0, F.bround(2 * c("precision") * c("recall") / F.when(both > 0, both), 4)).otherwise(0.0))


def failure(should_abstain: Column, abstained: Column, hit: Column) -> Column:
    """What went wrong with a question, if anything."""
    return (
        F.when(should_abstain & ~abstained, "FAILED_TO_ABSTAIN")
        .when(~should_abstain & abstained, "FALSE_ABSTAIN")
        .when(~should_abstain & ~hit, "RETRIEVAL_MISS")
    )


def category_counts(questions: DataFrame, by: str = "category") -> DataFrame:
    """(category, n)."""
    return questions.groupBy(F.col(by).alias("category")).agg(F.count("*").alias("n"))


def mean_cost(rows: DataFrame, by: list[str], latency: Column, used: Column) -> DataFrame:
    """Mean latency to two places and mean tokens to one, by `by`."""
    return rows.groupBy(*by).agg(F.round(F.avg(latency), 2).alias("avg_latency"), F.round(F.avg(used.cast("double")), 1).alias("avg_tokens"))


def evaluate(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All metrics of (should_abstain, abstained, recall_*, rr_5, ndcg_5,
    citation_precision, citation_coverage, prompt_tokens, completion_tokens), grouped by
    `by`. Retrieval counts answerable questions, citations those that were answered."""
    s, a = F.col("should_abstain"), F.col("abstained")
    mean = lambda c, on: F.avg(F.when(on, F.col(c)))
    timed = [F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms")] if "latency_ms" in results.columns else []
    rest = results.groupBy(*(by or [])).agg(
        F.count("*").alias("total_questions"),
        *(F.bround(F.coalesce(mean(c, ~s), F.lit(0.0)), 4).alias(n) for c, n in (("recall_1", "recall_at_1"), ("recall_3", "recall_at_3"), ("recall_5", "recall_at_5"), ("rr_5", "mrr_at_5"), ("ndcg_5", "ndcg_at_5"))),
        *(F.bround(F.coalesce(mean(c, ~s & ~a), F.lit(1.0)), 4).alias(c) for c in ("citation_precision", "citation_coverage")),
        F.bround(F.avg(F.col("prompt_tokens") + F.col("completion_tokens")), 1).alias("avg_tokens"),
        *timed,
    )
    gate = abstention(results, by).select(*(by or []), *(F.col(c).alias(f"abstention_{c}") for c in ("accuracy", "precision", "recall", "f1")))
    return rest.join(gate, by) if by else rest.join(F.broadcast(gate))  # one row each
