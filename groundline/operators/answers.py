"""The gate before an answer, the answer itself, and the check of its citations.

Candidates are (query_id, question, rank, chunk_id, doc_id, filename, page_number,
section_title, text, score) and, after reranking, reranker_prob.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundline.config import Config
from groundline.functions.text import CITATION, METRICS, OPPOSITES, contained, key_sentences, numbers, strip, tokens, words

C = Config()
NOTHING = "The passages that were found have no sentence to quote."


def _ordered(value: Column, glue: str) -> Column:
    """Aggregate: values joined in rank order; nulls left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda x: x["v"]), glue)


def missing_evidence(candidates: DataFrame, cfg: Config = C) -> DataFrame:
    """(query_id, overlap, missing, missing_terms) from each query's first chunks."""
    some = candidates.where(F.col("rank") <= cfg.evidence_chunks).groupBy("query_id").agg(
        F.first("question").alias("question"), _ordered(F.lower("text"), " ").alias("pool")
    )
    asked = some.select("query_id", "pool", tokens(F.col("question"), 3).alias("kw"))
    found = contained(F.col("kw"), F.col("pool"))
    ratio = F.when(F.size("kw") == 0, 1.0).otherwise(F.size(found) / F.greatest(F.size("kw"), F.lit(1)))
    out = asked.select("query_id", ratio.alias("overlap"), F.filter("kw", lambda t: ~F.contains(F.col("pool"), t)).alias("lost"))
    missing = F.col("overlap") < cfg.missing_overlap
    return out.select("query_id", "overlap", missing.alias("missing"), F.when(missing, F.array_join(F.slice("lost", 1, 4), ", ")).alias("missing_terms"))


def conflicts(candidates: DataFrame, cfg: Config = C) -> DataFrame:
    """The first contradicting pair of each query's leading candidates, at most one row
    a query: (query_id, rank_a, rank_b, chunk_a, chunk_b, polarity, metric).

    Words, numbers and flags are worked out once a candidate; pairs are six a query at
    most."""
    t = F.lower("text")
    flags = lambda ws: F.array(*(F.contains(t, F.lit(w)) for w in ws))
    one = candidates.where(F.col("rank") <= cfg.conflict_pool).select(
        "query_id", "rank", "chunk_id", "doc_id", "filename", F.array_distinct(tokens(F.col("text"), 3)).alias("kw"),
        numbers(F.col("text")).alias("nums"), flags([p for p, _ in OPPOSITES]).alias("pos"), flags([n for _, n in OPPOSITES]).alias("neg"),
        flags(METRICS).alias("metrics"),
    )
    a, b = (one.select("query_id", *(F.col(c).alias(f"{c}_{s}") for c in one.columns[1:])) for s in "ab")
    pairs = a.join(b, "query_id").where(
        (F.col("rank_a") < F.col("rank_b")) & ~((F.col("filename_a") == F.col("filename_b")) & (F.col("doc_id_a") == F.col("doc_id_b")))
    )
    names = F.array(*(F.lit(f"{p}/{n}") for p, n in OPPOSITES))
    opposed = F.filter(
        F.transform(F.arrays_zip("pos_a", "neg_a", "pos_b", "neg_b", names.alias("name")), lambda z: F.when((z["pos_a"] & z["neg_b"]) | (z["neg_a"] & z["pos_b"]), z["name"])),
        lambda x: x.isNotNull(),
    )
    polarity = F.when(F.size(F.array_intersect("kw_a", "kw_b")) >= 3, F.try_element_at(opposed, F.lit(1)))
    shared = F.filter(
        F.transform(F.arrays_zip("metrics_a", "metrics_b", F.array(*map(F.lit, METRICS)).alias("name")), lambda z: F.when(z["metrics_a"] & z["metrics_b"], z["name"])),
        lambda x: x.isNotNull(),
    )
    differ = (F.size("nums_a") > 0) & (F.size("nums_b") > 0) & (F.array_sort("nums_a") != F.array_sort("nums_b"))
    metric = F.when(differ, F.try_element_at(shared, F.lit(1)))
    hits = pairs.select("query_id", "rank_a", "rank_b", F.col("chunk_id_a").alias("chunk_a"), F.col("chunk_id_b").alias("chunk_b"), polarity.alias("polarity"), metric.alias("metric"))
    first = F.row_number().over(W.partitionBy("query_id").orderBy("rank_a", "rank_b"))
    return hits.where("polarity is not null or metric is not null").withColumn("_n", first).where("_n = 1").drop("_n")


def _strength(candidates: DataFrame) -> Column:
    return F.coalesce("reranker_prob", "score") if "reranker_prob" in candidates.columns else F.col("score")


def weak_evidence(candidates: DataFrame, cfg: Config = C) -> DataFrame:
    """(query_id, top_score, weak) from each query's first candidate."""
    return candidates.where("rank = 1").select("query_id", _strength(candidates).alias("top_score"), (_strength(candidates) < cfg.weak_threshold).alias("weak"))


def gate(queries: DataFrame, candidates: DataFrame, cfg: Config = C) -> DataFrame:
    """(query_id, decision, reason, confidence, rationale, chunk_a, chunk_b) of every
    query: nothing found, then missing, then conflicting, then weak, else answered."""
    m, c, w = missing_evidence(candidates, cfg), conflicts(candidates, cfg), weak_evidence(candidates, cfg)
    all_ = queries.select("query_id").join(m, "query_id", "left").join(c, "query_id", "left").join(w, "query_id", "left")
    none, missing, conflict, weak = F.col("overlap").isNull(), F.col("missing"), F.col("chunk_a").isNotNull(), F.col("weak")

    def pick(*values) -> Column:
        x = F.when(none, values[0]).when(missing, values[1]).when(conflict, values[2]).when(weak, values[3])
        return x.otherwise(values[4])

    lit = F.lit
    return all_.select(
        "query_id",
        F.when(none | missing | conflict | weak, "ABSTAIN").otherwise("ANSWER").alias("decision"),
        pick(*map(lit, ("missing_evidence", "missing_evidence", "conflicting_evidence", "weak_evidence", "sufficient_evidence"))).alias("reason"),
        pick(lit(0.0), F.col("overlap"), lit(0.45), F.col("top_score"), F.col("top_score")).alias("confidence"),
        pick(
            lit("No candidate matched the query."),
            F.concat(lit("Missing evidence for: "), "missing_terms"),
            F.concat(lit("Contradictory sources: "), F.concat_ws("; ", "polarity", "metric")),
            F.concat(lit("Weak evidence: "), F.format_string("%.3f", "top_score")),
            F.concat(lit("Sufficient evidence: "), F.format_string("%.3f", "top_score")),
        ).alias("rationale"),
        F.when(~none & ~missing, F.col("chunk_a")).alias("chunk_a"),
        F.when(~none & ~missing, F.col("chunk_b")).alias("chunk_b"),
    )


def build_answers(candidates: DataFrame, cfg: Config = C) -> DataFrame:
    """(query_id, answer): key sentences of the first chunks, each with its citation."""
    tag = F.concat(
        F.lit("[Doc: "), "filename", F.lit(", p. "), F.col("page_number").cast("string"), F.lit(", § "), "section_title", F.lit(" | chunk: "), "chunk_id", F.lit("]")
    )
    said = key_sentences(F.col("text"), F.col("question"))
    part = F.when(F.length(said) > 0, F.concat(said, F.lit(" "), tag))
    made = candidates.where(F.col("rank") <= cfg.evidence_chunks).groupBy("query_id").agg(_ordered(part, "\n\n").alias("answer"))
    return made.select("query_id", F.when(F.col("answer") == "", NOTHING).otherwise(F.col("answer")).alias("answer"))


def claims(answers: DataFrame) -> DataFrame:
    """(query_id, claim_no, claim): an answer's lines without bullets and lead-ins; the
    whole answer where none is left."""
    lines = F.filter(F.transform(F.split("answer", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), strip), lambda x: (x != "") & ~x.startswith("Based on"))
    bare = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^[•\-\*]\s*", ""))), lambda x: x != "")
    listed = F.when(F.size(bare) > 0, bare).otherwise(F.array(strip(F.col("answer"))))
    rows = answers.select("query_id", F.posexplode(listed).alias("claim_no", "claim"))
    return rows.withColumn("claim_no", (F.col("claim_no") + 1).cast("long"))


def citations(lines: DataFrame) -> DataFrame:
    """(query_id, claim_no, cite_no, claim_text, cited_file, page, section, cited_chunk)
    of every citation tag in (query_id, claim_no, claim)."""
    group = lambda i: F.regexp_extract_all("claim", F.lit(CITATION), F.lit(i))
    z = F.arrays_zip(*(group(i).alias(n) for i, n in ((1, "f"), (2, "p"), (3, "s"), (4, "c"))))
    rows = lines.select("query_id", "claim_no", strip(F.regexp_replace("claim", CITATION, "")).alias("claim_text"), F.posexplode(z).alias("n", "z"))
    or_ = lambda c, d: F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(d))
    return rows.select(
        "query_id", "claim_no", (F.col("n") + 1).cast("long").alias("cite_no"), "claim_text", strip(F.col("z.f")).alias("cited_file"),
        or_(F.col("z.p"), "1").cast("long").alias("page"), or_(F.col("z.s"), "General").alias("section"), F.col("z.c").alias("cited_chunk"),
    )


def verify(answers: DataFrame, candidates: DataFrame, cfg: Config = C) -> DataFrame:
    """Citations with the chunk each one points to, how much of its claim that chunk
    holds, and whether that is enough. A chunk is found by id, else by file name."""
    cites = citations(claims(answers))
    pool = candidates.where(F.col("rank") <= cfg.evidence_chunks).select(
        "query_id", "rank", "chunk_id", "filename", "page_number", "section_title", "text"
    )
    by_id = pool.select("query_id", F.col("chunk_id").alias("cited_chunk"), F.struct("*").alias("i"))
    by_id = by_id.groupBy("query_id", "cited_chunk").agg(F.max_by("i", "i.rank").alias("i"))
    by_name = pool.groupBy("query_id", F.lower("filename").alias("_f")).agg(F.min_by(F.struct("*"), "rank").alias("f"))
    hit = cites.withColumn("_f", F.lower("cited_file")).join(by_id, ["query_id", "cited_chunk"], "left").join(by_name, ["query_id", "_f"], "left").withColumn("t", F.coalesce("i", "f"))
    kw = tokens(F.col("claim_text"))
    score = F.when(F.col("t").isNull(), 0.0).when(F.size(kw) == 0, 1.0).otherwise(F.size(contained(kw, F.lower("t.text"))) / F.greatest(F.size(kw), F.lit(1)))
    snippet = F.concat(strip(F.substring("t.text", 1, 120)), F.when(F.length("t.text") > 120, "...").otherwise(""))
    return hit.select(
        "query_id", "claim_no", "cite_no", "claim_text", F.coalesce("t.chunk_id", "cited_chunk").alias("chunk_id"),
        F.coalesce("t.filename", "cited_file").alias("filename"), F.coalesce(F.col("t.page_number").cast("long"), "page").alias("page_number"),
        F.coalesce("t.section_title", "section").alias("section_title"), F.coalesce(snippet, F.lit("")).alias("snippet"),
        F.bround(score, 3).alias("alignment"), (F.col("t").isNotNull() & (score >= cfg.faithful_at)).alias("faithful"),
    )


def citation_metrics(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """(query_id, citation_precision, citation_coverage)."""
    lines = claims(answers).groupBy("query_id").agg(F.count("*").alias("claims"))
    found = verified.groupBy("query_id").agg(F.avg(F.col("faithful").cast("double")).alias("p"), F.countDistinct("claim_no").alias("cited"))
    return lines.join(found, "query_id", "left").select(
        "query_id",
        F.coalesce(F.bround("p", 3), F.lit(0.0)).alias("citation_precision"),
        F.bround(F.coalesce("cited", F.lit(0)) / F.col("claims"), 3).alias("citation_coverage"),
    )


def generate(
    queries: DataFrame, candidates: DataFrame, cfg: Config = C, decide: Callable[[DataFrame, DataFrame, Config], DataFrame] = gate,
    stage: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> DataFrame:
    """One row a query: decision, answer or refusal, citation metrics, token counts.
    `decide` may be any gate that gives what `gate` gives; `stage` is given the tables of
    the steps `gate` and `citations`, and what it gives goes on."""
    decided = stage("gate", decide(queries, candidates, cfg))
    answered = candidates.join(decided.where("decision = 'ANSWER'").select("query_id"), "query_id", "left_semi")
    said = build_answers(answered, cfg)
    checked = stage("citations", said.join(citation_metrics(said, verify(said, answered, cfg)), "query_id", "left"))
    read = answered.where(F.col("rank") <= cfg.evidence_chunks).groupBy("query_id").agg(F.sum(words(F.col("text"))).alias("read"))
    all_ = queries.select("query_id", "question").join(decided, "query_id").join(checked, "query_id", "left").join(read, "query_id", "left")
    answer = F.coalesce("answer", F.concat(F.lit("Cannot answer: "), "rationale"))
    return all_.select(
        "query_id", "question", "decision", "reason", "confidence", answer.alias("answer"),
        F.coalesce("citation_precision", F.lit(1.0)).alias("citation_precision"), F.coalesce("citation_coverage", F.lit(1.0)).alias("citation_coverage"),
        (words(F.col("question")) + F.when(F.col("decision") == "ABSTAIN", 50).otherwise(F.coalesce("read", F.lit(0)))).cast("long").alias("prompt_tokens"),
        words(answer).cast("long").alias("completion_tokens"),
    )
