"""More queries with their SQL: stored vectors, irregular outlines, configurations of the whole flow.

`groundline.queries` has the parts of SQL that these share, and the registry.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from groundline import queries as Q
from groundline.config import Config
from groundline.operators import answers as A
from groundline.operators import lineage as L
from groundline.operators import ranking as R
from groundline.operators import sections as S
from groundline.operators.vectors import DenseIndex, hashed_embedder
from groundline.plans.engine import chunk_files, measured
from groundline.queries import query, read
from groundline.sources import corpus
from groundline.sources.tables import new_path, written
from groundline.streaming.stateful import ingest_with_state


# vectors in a stored index
@query(Q.ORACLES["dense_topk"])
def dense_index_topk(spark, sf_dir):
    """The same five, blocks that can't hold them left out."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    q = e.join(asked, "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    found = DenseIndex.build(e, new_path(spark, "vectors")).top(q, 5)
    return R.top(found, 5).select("query_id", F.col("rank").cast("long"), "doc_id", F.round("score", 6).alias("score"))


@query("""WITH g AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, first_value(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings),
s AS (SELECT q.label AS query_id, v.vec_id AS doc_id, list_inner_product(q.e, v.f) AS score FROM (SELECT label, arg_min(e, vec_id) AS e FROM g GROUP BY label) q, g v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::BIGINT AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 20""")
def dense_index_ties(spark, sf_dir):
    """Every vector in place of the first of its label: thousands are equal, ids decide."""
    e = read(spark, sf_dir, "embeddings")
    firsts = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    same = e.select("vec_id", "label").join(firsts, "label").select(F.col("vec_id").alias("doc_id"), "embedding")
    found = DenseIndex.build(same, new_path(spark, "vectors")).top(firsts.select(F.col("label").alias("query_id"), "embedding"), 20)
    return R.top(found, 20).select("query_id", F.col("rank").cast("long"), "doc_id", F.round("score", 6).alias("score"))


DIM = 64


def _hashed(table: str, key: str) -> str:
    """Rows (id, p, x): the places of each text's vector that aren't zero, unit length."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""(SELECT id, p, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY id)), 0) AS x FROM (SELECT id, ('0x' || h[1:8])::BIGINT % {DIM} AS p, sum(sqrt(n) * CASE WHEN ('0x' || h[9:9])::INT < 8 THEN 1 ELSE -1 END) AS x
  FROM (SELECT id, md5(w) AS h, count(*)::DOUBLE AS n FROM (SELECT {key} AS id, unnest(regexp_extract_all({low}, '[a-z0-9_]+')) AS w FROM {table}) WHERE NOT list_contains({Q.STOP}, w) GROUP BY ALL) GROUP BY ALL))"""


@query(f"""WITH d AS {_hashed('documents', 'doc_id')}, q AS {_hashed('benchmark', 'item_id')},
s AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.x * d.x) AS score FROM q JOIN d USING (p) GROUP BY ALL),
every AS (SELECT item_id AS query_id, documents.doc_id, coalesce(score, 0) AS score FROM benchmark, documents LEFT JOIN s ON s.query_id = item_id AND s.doc_id = documents.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM every)
SELECT query_id, rank::BIGINT AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def embed_and_rank(spark, sf_dir):
    """Texts become vectors by the engine's own embedder, are stored, and are asked by questions."""
    load = hashed_embedder(DIM)
    docs = R.embed(read(spark, sf_dir, "documents"), load, "doc_id", "text")
    asked = R.embed(Q._questions(spark, sf_dir), load, "query_id", "question")
    found = DenseIndex.build(docs, new_path(spark, "vectors")).top(asked, 5)
    return R.top(found, 5).select("query_id", F.col("rank").cast("long"), "doc_id", F.round("score", 6).alias("score"))


# outlines of any nesting: each line of a document a heading, its level by its length and place
@query("""WITH RECURSIVE ln AS (SELECT doc_id, i, ls[i + 1] AS l, 1 + ((length(ls[i + 1]) * 7 + i * i) % 6) AS lev FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
pt AS (SELECT doc_id, i, lev, 'h' || i AS t, length(repeat('#', lev::INT) || ' h' || i || chr(10) || 'x' || l || chr(10)) AS n FROM ln),
pl AS (SELECT *, 5 + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM pt),
st AS (
  SELECT doc_id, i, [{'lev': lev, 't': t}] AS stack FROM pt WHERE i = 0
  UNION ALL SELECT pt.doc_id, pt.i, list_append(list_filter(stack, lambda x: x.lev < pt.lev), {'lev': pt.lev, 't': pt.t}) FROM st JOIN pt ON pt.doc_id = st.doc_id AND pt.i = st.i + 1)
SELECT doc_id, i::BIGINT AS ordinal, lev::BIGINT AS level, t AS title, array_to_string(list_transform(stack, lambda x: x.t), ' > ') AS path, s::BIGINT AS "start", (s + n)::BIGINT AS "end"
FROM pl JOIN st USING (doc_id, i)""")
def md_outline(spark, sf_dir):
    line = lambda x, i: F.concat(F.repeat(F.lit("#"), (1 + (F.length(x) * 7 + i * i) % 6).cast("int")), F.lit(" h"), i.cast("string"), F.lit("\nx"), x, F.lit("\n"))
    text = F.concat(F.lit("lead\n"), F.array_join(F.transform(F.split("text", "\n", -1), line), ""))
    found = S.sections(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "markdown")
    return found.withColumn("path", F.array_join("path", " > "))


# files cut to chunks with their ids: every document a file of its own, in its second version
@query(f"""WITH {Q.CHUNKS} SELECT 'd ' || doc_id || '.txt' AS filename, chunk_index::BIGINT AS chunk_index, 'Main' AS section_title, 1::BIGINT AS page_number, part AS full_text,
  'chk_fix_d-' || doc_id || '-txt_' || sha256('d ' || doc_id || '.txt' || chr(10) || '2')[1:12] || '_' || lpad(chunk_index::VARCHAR, greatest(3, length(chunk_index::VARCHAR))::INT, '0') AS chunk_id FROM fx""")
def file_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("d "), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = d.select(name.alias("filename"), F.lit("text").alias("file_type"), F.col("text").cast("binary").alias("content"), F.lit(2).cast("long").alias("version"))
    return chunk_files(files, "fixed").select("filename", "chunk_index", "section_title", "page_number", "full_text", "chunk_id")


# headings as page texts have them: numbered ones, and lines of capitals
@query("""WITH p AS (SELECT page_id AS doc_id, '(lead)' || chr(10) AS a, '1.2. Part ' || page_id || ' of many' AS h, chr(10) || '(' || url || ')' || chr(10) AS b, 'RESULTS ' || (page_id % 97) || ':' AS g, chr(10) || '(the end)' AS c FROM pages)
SELECT doc_id, 0::BIGINT AS ordinal, 1::BIGINT AS level, h AS title, h AS path, length(a)::BIGINT AS "start", length(a || h || b)::BIGINT AS "end" FROM p
UNION ALL SELECT doc_id, 1, 1, g, g, length(a || h || b), length(a || h || b || g || c) FROM p""")
def pdf_sections(spark, sf_dir):
    n = F.col("page_id")
    text = F.concat(F.lit("(lead)\n1.2. Part "), n.cast("string"), F.lit(" of many\n("), "url", F.lit(")\nRESULTS "), (n % 97).cast("string"), F.lit(":\n(the end)"))
    return S.sections(read(spark, sf_dir, "pages").select(n.alias("doc_id"), text.alias("text")), "pdf").withColumn("path", F.array_join("path", " > "))


# arrivals that meet what earlier batches kept
@query(f"WITH {Q.LINEAGE} SELECT filename, seq, content_hash, status, coalesce(version, 0)::BIGINT AS version FROM lin")
def lineage_of_batches(spark, sf_dir):
    """As `version_lineage`, a third of the languages at a time: hashes and versions of
    earlier batches are joined. Batches are in order of arrival, so `seq` is ranked so."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("filename"), F.col("doc_id").alias("seq"), L.fingerprint(F.col("text")).alias("content_hash"))
    edges = docs.agg(F.percentile_approx("seq", [0.3, 0.6])).first()[0]
    known, out = None, None
    for low, high in zip((None, *edges), (*edges, None)):
        batch = docs.where((F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else F.col("seq") <= high))
        got = written(L.ingest(batch, known), "batch")
        kept = got.where("version is not null").select("filename", "version", "content_hash")
        known = kept if known is None else known.unionByName(kept)
        out = got if out is None else out.unionByName(got)
    return out.withColumn("version", F.coalesce("version", F.lit(0).cast("long")))


@query(f"WITH {Q.LINEAGE} SELECT filename, seq, content_hash, status, coalesce(version, 0)::BIGINT AS version FROM lin")
def lineage_of_stream(spark, sf_dir):
    """As `version_lineage`, by a stream that keeps its state; a second run finds nothing new."""
    path, at = f"{sf_dir}/documents.parquet", new_path(spark, "stream")
    schema = read(spark, sf_dir, "documents").schema
    for _ in range(2):
        docs = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a stream takes a single file by a pattern
        rows = docs.select(F.col("source").alias("filename"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("seq"), L.fingerprint(F.col("text")).alias("content_hash"))
        out = ingest_with_state(rows, f"{at}/table", f"{at}/checkpoint")
    return out.select("filename", F.col("seq").cast("long").alias("seq"), "content_hash", "status", F.coalesce("version", F.lit(0).cast("long")).alias("version"))


# what is said: answers, refusals and their sizes
RATIONALE = """CASE WHEN none THEN 'No candidate matched the query.' WHEN missing THEN 'Missing evidence for: ' || array_to_string(lost[1:4], ', ') WHEN conflict THEN 'Contradictory sources: ' || concat_ws('; ', polarity, metric)
    WHEN weak THEN printf('Weak evidence: %.3f', top) ELSE printf('Sufficient evidence: %.3f', top) END"""


def said_sql(items: str) -> str:
    """Result rows of the questions in `items`, from cand, ga, gd, an, ve and cm."""
    return f"""
cn AS (SELECT query_id, count(*) AS n FROM cm GROUP BY query_id),
vf AS (SELECT query_id, avg((score >= 0.3 AND t IS NOT NULL)::INT::DOUBLE) AS p, count(DISTINCT claim_no) AS c FROM ve GROUP BY query_id),
rd AS (SELECT query_id, sum({Q.WORDS.format('text')}) AS read FROM cand WHERE rank <= 3 GROUP BY query_id),
sd AS (SELECT ga.query_id, gd.decision, b.text AS question, CASE WHEN gd.decision = 'ANSWER' THEN an.answer ELSE 'Cannot answer: ' || {RATIONALE} END AS answer,
  CASE WHEN gd.decision = 'ANSWER' THEN coalesce(round_even(vf.p, 3), 0.0) ELSE 1.0 END AS citation_precision,
  CASE WHEN gd.decision = 'ANSWER' THEN round_even(coalesce(vf.c, 0)::DOUBLE / cn.n, 3) ELSE 1.0 END AS citation_coverage, coalesce(read, 0) AS read
  FROM ga JOIN gd USING (query_id) JOIN {items} b ON b.item_id = ga.query_id LEFT JOIN mi ON mi.query_id = ga.query_id LEFT JOIN co ON co.query_id = ga.query_id
  LEFT JOIN an ON an.query_id = ga.query_id LEFT JOIN cn ON cn.query_id = ga.query_id LEFT JOIN vf ON vf.query_id = ga.query_id LEFT JOIN rd ON rd.query_id = ga.query_id),
sz AS (SELECT *, {Q.WORDS.format('question')} + CASE WHEN decision = 'ABSTAIN' THEN 50 ELSE read END AS prompt_tokens, {Q.WORDS.format('answer')} AS completion_tokens FROM sd)
"""


LATER = f"{Q.KEYS}, {Q.TOLD}, {Q.VERIFY.replace(Q.ANSWER + ',', '')}"


@query(f"""WITH {Q.GATE}, {LATER}, {said_sql('benchmark')}
SELECT query_id, decision, answer, citation_precision, citation_coverage, prompt_tokens::BIGINT AS prompt_tokens, completion_tokens::BIGINT AS completion_tokens FROM sz""")
def generate_answers(spark, sf_dir):
    got = A.generate(Q._questions(spark, sf_dir), Q._candidates(spark, sf_dir), Q.CFG)
    return got.select("query_id", "decision", "answer", "citation_precision", "citation_coverage", "prompt_tokens", "completion_tokens")


@query(rf"""WITH {Q.CAND},
lo AS (SELECT query_id, max(rank) AS r FROM cand WHERE rank <= 3 GROUP BY query_id),
fb AS (SELECT c.query_id, 'Claim ' || regexp_replace(question, '\s+', ' ', 'g') AS said, upper(filename) AS f FROM cand c JOIN lo ON lo.query_id = c.query_id AND c.rank = lo.r),
hit AS (SELECT fb.query_id, said, arg_min(c.chunk_id, c.rank) AS chunk_id, arg_min(lower(c.text), c.rank) AS t FROM fb JOIN cand c ON c.query_id = fb.query_id AND c.rank <= 3 AND lower(c.filename) = lower(fb.f) GROUP BY ALL),
kw AS (SELECT *, {Q.tok('said')} AS kw FROM hit), sc AS (SELECT *, len(list_filter(kw, lambda w: contains(t, w)))::DOUBLE / len(kw) AS score FROM kw)
SELECT query_id, chunk_id, round_even(score, 3) AS alignment, score >= 0.3 AS faithful FROM sc""")
def citation_by_name(spark, sf_dir):
    """Tags that name no chunk there is: the file's name, in any case of letters, finds the first chunk of that file."""
    c = Q._candidates(spark, sf_dir)
    last = c.where("rank <= 3").groupBy("query_id").agg(F.max_by("filename", "rank").alias("f"), F.first("question").alias("question"))
    said = F.concat(F.lit("Claim "), F.regexp_replace("question", r"\s+", " "), F.lit(" [Doc: "), F.upper("f"), F.lit(" | chunk: nowhere]"))
    return A.verify(last.select("query_id", said.alias("answer")), c).select("query_id", "chunk_id", "alignment", "faithful")


# five configurations: four modes over documents, and keywords with reranking over fixed chunks
FIVE = ("bm25", "dense", "hybrid", "hybrid_rerank", "fixed_rerank")


def _reranked(name: str, ranked: str, docs: str) -> str:
    return f"""
l{name} AS (SELECT c.query_id, c.doc_id, c.rank AS pre_rank, list_distinct({Q.tok('b.text')}) AS q, {Q.tok('d.text')} AS t FROM {ranked} c JOIN {docs} d USING (doc_id) JOIN benchmark b ON b.item_id = c.query_id),
p{name} AS (SELECT *, 1 / (1 + exp(-(len(list_intersect(q, t))::DOUBLE / greatest(len(q), 1) * 8 - 4))) AS score FROM l{name}),
r{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, pre_rank) AS rank FROM p{name})
"""


CHUNKED = re.sub(r"\b(toks|st|qt|post|df|scored|bm)\b", r"\1x", Q.BM25.replace("documents", "fdocs"))
_ONES = " UNION ALL ".join(f"SELECT query_id * 8 + {c} AS query_id, query_id AS id, rank, doc_id AS key, {d} AS doc_id, score FROM {t} WHERE rank <= 5" for c, (t, d) in enumerate((("bm", "doc_id"), ("dn", "doc_id"), ("fu", "doc_id"), ("ra", "doc_id"), ("rb", "doc_id // 100000"))))
FIVE_CAND = f"""
{Q.CHUNKS.strip()},
fdocs AS (SELECT doc_id * 100000 + chunk_index AS doc_id, part AS text FROM fx), {Q.FUSED}, {CHUNKED}, {_reranked('a', 'fu', 'documents')}, {_reranked('b', 'bmx', 'fdocs')},
items AS (SELECT item_id * 8 + c AS item_id, text FROM benchmark, range(5) t(c)),
cand AS (SELECT o.query_id, b.text AS question, rank, CASE WHEN o.query_id % 8 = 4 THEN 'fix_' || key ELSE 'doc_' || o.doc_id END AS chunk_id, o.doc_id, d.source AS filename, 1 AS page_number, 'Main' AS section_title,
  coalesce(f.text, d.text) AS text, score FROM ({_ONES}) o JOIN documents d ON d.doc_id = o.doc_id JOIN benchmark b ON b.item_id = o.id LEFT JOIN fdocs f ON o.query_id % 8 = 4 AND f.doc_id = o.key)
"""
FIVE_GATE = Q.GATE.replace(Q.CAND + ", ", "").replace("benchmark", "items").replace("8.0", "0.35")
FIVE_REL = Q.REL.replace(Q.CAND + ",", "").replace("query_id % 3", "(query_id // 8) % 3").replace("AS gold FROM cand)", "AS gold FROM cand JOIN gd USING (query_id) WHERE decision = 'ANSWER' OR rank <= 3)")
_MEAN = lambda c, on, none: f"round_even(coalesce(avg(CASE WHEN {on} THEN {c}::DOUBLE END), {none}), 4)"


FIVE_RESULTS = f"""{FIVE_CAND}, {FIVE_GATE}, {FIVE_REL}, {LATER}, {said_sql('items')},
rs AS (SELECT query_id % 8 AS cfg, (query_id // 8) % 5 = 0 AS s, decision = 'ABSTAIN' AS a, sz.*, rk.* EXCLUDE (query_id) FROM sz LEFT JOIN rk USING (query_id))"""


@query(f"""WITH {FIVE_RESULTS},
{Q.CONFUSED.format(by='cfg,', t='rs', group='GROUP BY cfg').replace('co AS', 'cx AS').replace('FROM co)', 'FROM cx)')}
SELECT {list(FIVE)}[rs.cfg + 1] AS config, count(*)::BIGINT AS total_questions,
  {', '.join(f"{_MEAN(f'coalesce({c}, 0)', 'NOT s', 0)} AS {n}" for c, n in (('recall_1', 'recall_at_1'), ('recall_3', 'recall_at_3'), ('recall_5', 'recall_at_5'), ('rr_5', 'mrr_at_5'), ('ndcg_5', 'ndcg_at_5')))},
  {', '.join(f"{_MEAN(c, 'NOT s AND NOT a', 1)} AS {c}" for c in ('citation_precision', 'citation_coverage'))},
  round_even(avg((prompt_tokens + completion_tokens)::DOUBLE), 1) AS avg_tokens,
  any_value(cr.accuracy) AS abstention_accuracy, any_value(cr.precision) AS abstention_precision, any_value(cr.recall) AS abstention_recall, any_value({Q._F1.format('x')[:-5]}) AS abstention_f1
FROM rs JOIN cr ON cr.cfg = rs.cfg GROUP BY rs.cfg""")
def ablation_five(spark, sf_dir):
    """All metrics of five configurations, measured together."""
    return _five(spark, sf_dir)[0].drop("avg_latency_ms")


@query(f"""WITH {FIVE_RESULTS}, fl AS (SELECT *, CASE WHEN s AND NOT a THEN 'FAILED_TO_ABSTAIN' WHEN NOT s AND a THEN 'FALSE_ABSTAIN' WHEN NOT s AND first_hit IS NULL THEN 'RETRIEVAL_MISS' END AS failure FROM rs)
SELECT {list(FIVE)}[cfg + 1] AS config, query_id // 8 AS query_id, failure, decision FROM fl WHERE failure IS NOT NULL""")
def ablation_failures(spark, sf_dir):
    """What went wrong in each configuration, saved beside the metrics and read back."""
    metrics, rows = _five(spark, sf_dir)
    path = new_path(spark, "ablation")
    corpus.save_metrics(metrics, rows.where("failure is not null").select("config", "query_id", "failure", "decision"), path)
    return spark.read.schema("config string, query_id long, failure string, decision string").json(f"{path}/all_failures")


def _five(spark, sf_dir):
    asked = Q._questions(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("filename"), "text")
    bm = Q._bm25(spark, sf_dir, 20)
    dense = written(Q._dense(spark, sf_dir, 20), "dense")
    fused = written(R.fuse(dense, bm), "fused")
    pieces = written(S.fixed_chunks(docs).select((F.col("doc_id") * 100000 + F.col("chunk_index")).alias("chunk"), "doc_id", "text"), "pieces")
    cut = written(R.top(R.bm25(pieces, asked, key="chunk", k=20), 20, key="chunk"), "cut")

    def shown(ranked, texts, chunk):
        made = ranked.join(texts, "doc_id").join(asked, "query_id").withColumn("chunk_id", chunk)
        return made.withColumn("page_number", F.lit(1)).withColumn("section_title", F.lit("Main"))

    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    logit = R.lexical_logit(F.col("question"), F.col("text"))
    files = docs.select("doc_id", "filename")
    fixed = cut.join(pieces, "chunk").join(files, "doc_id").join(asked, "query_id").withColumn("chunk_id", F.concat(F.lit("fix_"), F.col("chunk").cast("string")))
    fixed = fixed.withColumn("page_number", F.lit(1)).withColumn("section_title", F.lit("Main"))
    found = {
        "bm25": shown(bm.where("rank <= 5"), docs, name),
        "dense": shown(dense.where("rank <= 5"), docs, name),
        "hybrid": shown(fused.where("rank <= 5"), docs, name),
        "hybrid_rerank": R.rerank(shown(fused, docs, name), logit, 5),
        "fixed_rerank": R.rerank(fixed, logit, 5),
    }
    i = F.col("query_id")
    questions = asked.select(
        "query_id", "question", F.lit("all").alias("category"), (i % 5 == 0).alias("should_abstain"),
        F.array(F.when(i % 3 == 0, "src1").otherwise("SRC")).alias("golden_doc_filenames"), F.split("question", " ").alias("golden_passage_keywords"),
    )
    return measured(questions, found, Config())
