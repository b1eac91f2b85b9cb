"""The whole flow: files to chunks to ranked candidates to checked answers."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundline.config import Config
from groundline.operators import answers, evaluation, lineage, ranking, sections
from groundline.operators.index import Bm25Index
from groundline.operators.vectors import DenseIndex, hashed_embedder
from groundline.sources import corpus
from groundline.sources.tables import fs_path, new_path, written

MODES = ("bm25", "dense", "hybrid", "hybrid_rerank")


class Chunker(Protocol):
    """How the sections of documents become chunks. `name` is part of chunk ids."""

    name: str

    def chunks(self, docs: DataFrame, secs: DataFrame, cfg: Config) -> DataFrame:
        """(doc_id, filename, chunk_index, section_title, page_number, start, end, prefix, text, token_count) of
        docs (doc_id, filename, text); page_number may be left out, and is then told from `start`."""


class Structural:
    name = "struct"

    def chunks(self, docs: DataFrame, secs: DataFrame, cfg: Config) -> DataFrame:
        return sections.structural_chunks(docs, secs, cfg.max_section_chars, F.col("page_number"))


class Fixed:
    name = "fix"

    def chunks(self, docs: DataFrame, secs: DataFrame, cfg: Config) -> DataFrame:
        made = sections.chunk_section(sections.fixed_chunks(docs, cfg.chunk_size, cfg.chunk_overlap), secs)
        return made.withColumn("prefix", F.lit("")).join(docs.select("doc_id", "filename"), "doc_id")


STRATEGIES: dict[str, Chunker] = {"structural": Structural(), "fixed": Fixed()}
#: Decides which queries are answered: (queries, candidates, cfg) to what `answers.gate` gives.
Gate = Callable[[DataFrame, DataFrame, Config], DataFrame]


def chunk_ids(chunks: DataFrame, kind: str, cfg: Config = Config()) -> DataFrame:
    """`chunks` with chunk_id: file name, a hash of name and version, and a number of
    three digits or more; or the short form, which collides between files."""
    number = F.format_string("%03d", "chunk_index")
    if cfg.compat_chunk_ids:
        return chunks.withColumn("chunk_id", F.concat(F.lit(f"chk_{kind}_"), F.substring("filename", 1, 6), F.lit("_"), number))
    version = F.col("version").cast("string") if "version" in chunks.columns else F.lit("")
    mark = F.left(F.sha2(F.concat_ws("\n", "filename", version), 256), F.lit(12))
    stem = F.regexp_replace("filename", "[^a-zA-Z0-9_\\-]", "-")
    return chunks.withColumn("chunk_id", F.concat(F.lit(f"chk_{kind}_"), stem, F.lit("_"), mark, F.lit("_"), number))


def chunk_files(files: DataFrame, strategy: str | Chunker = "structural", cfg: Config = Config(), extract: Callable | None = None) -> DataFrame:
    """Chunks of files (filename, file_type, content): doc_id, filename, chunk_index,
    chunk_id, section_title, page_number, start, end, prefix, text, full_text. A strategy
    is a name or a Chunker."""
    if isinstance(strategy, str) and strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {tuple(STRATEGIES)}")
    chunker = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    texts = corpus.decoded(files).select(F.col("filename").alias("doc_id"), "filename", "file_type", "text")
    kinds = [(k, texts.where(F.col("file_type") == k).drop("file_type")) for k in ("markdown", "text")]
    pages = corpus.pdf_pages(files, extract) if extract else None
    out = None
    if pages is not None:
        by = pages.select(F.col("filename").alias("doc_id"), "page_number", "text")
        whole = by.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
        kinds.append(("pdf", whole.select("doc_id", F.col("doc_id").alias("filename"), "text")))
    for kind, docs in kinds:
        secs = sections.sections(docs, kind)
        if kind == "pdf":
            secs = sections.page_of(secs, sections.page_offsets(by))
        else:
            secs = secs.withColumn("page_number", F.lit(1).cast("long"))
        made = chunker.chunks(docs, secs, cfg)
        if "page_number" not in made.columns and kind == "pdf":
            made = sections.page_of(made, sections.page_offsets(by, 1), last=True)
        elif "page_number" not in made.columns:
            made = made.withColumn("page_number", F.lit(1).cast("long"))
        cols = ["doc_id", "filename", "chunk_index", "section_title", "page_number", "start", "end", "prefix", "text", "token_count"]
        out = made.select(*cols) if out is None else out.unionByName(made.select(*cols))
    if "version" in files.columns:
        out = out.join(files.select("filename", "version"), "filename", "left")
    full = F.when(F.col("prefix") != "", F.concat_ws("\n", "prefix", "text")).otherwise(F.col("text"))
    return chunk_ids(out, chunker.name, cfg).withColumn("full_text", full)


def _as_is(name: str, df: DataFrame) -> DataFrame:
    return df


def retrieve(chunks: DataFrame, queries: DataFrame, mode: str = "hybrid_rerank", top_k: int = 5, targets: DataFrame | None = None,
             vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, cfg: Config = Config(),
             index: Bm25Index | None = None, reranker=None, dense: DenseIndex | None = None, embedder: Callable | None = None,
             stage: Callable[[str, DataFrame], DataFrame] = _as_is) -> DataFrame:
    """Candidates of queries (query_id, question), with what each method said of them.

    The modes with vectors take `query_vectors` (query_id, embedding), or embed the
    questions by `embedder`, and rank `vectors` (chunk_id, embedding), or ask a stored
    `dense` index on chunk_id; `index` is a persisted keyword index on chunk_id, else
    postings are made for this batch. An unknown mode gives no candidate. `targets`
    (filename) applies after ranking. `reranker` is a column or a model, by default the
    lexical one. `stage` is given each step's table by name and what it gives goes on."""
    place = chunks.select(F.col("chunk_id").alias("doc_id"), F.col("doc_id").alias("_doc"), "chunk_index")

    def best(scored: DataFrame, k: int) -> DataFrame:
        # only those that may be among the k first, ties included, look up their place
        order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)))
        some = scored.withColumn("_r", F.rank().over(order)).where(F.col("_r") <= k).drop("_r")
        return ranking.top(some.join(place, "doc_id"), k, ties=["_doc", "chunk_index"]).drop("_doc", "chunk_index")

    def keyword(k: int) -> DataFrame:
        scored = index.score(queries, k=k) if index else ranking.bm25(chunks.select("chunk_id", F.col("full_text").alias("text")), queries, key="chunk_id", k=k)
        return stage("bm25", best(scored.withColumnRenamed("chunk_id", "doc_id"), k))

    def vector(k: int) -> DataFrame:
        if (vectors is None and dense is None) or (query_vectors is None and embedder is None):
            raise ValueError(f"mode {mode!r} needs vectors or an index of them, and query_vectors or an embedder")
        asked = query_vectors if query_vectors is not None else ranking.embed(queries, embedder, "query_id", "question")
        if vectors is None:
            scored = dense.top(asked, k).withColumnRenamed("chunk_id", "doc_id")
        else:
            scored = ranking.dense(vectors.select(F.col("chunk_id").alias("doc_id"), "embedding"), asked, k)
        return stage("dense", best(scored, k))

    pool = 4 * top_k if targets is not None else top_k
    if mode == "bm25":
        ranked = keyword(pool).withColumn("bm25_score", F.col("score"))
    elif mode == "dense":
        ranked = vector(pool).withColumn("dense_score", F.col("score"))
    elif mode in ("hybrid", "hybrid_rerank"):
        ranked = stage("fusion", ranking.fuse(vector(cfg.pool), keyword(cfg.pool), cfg.pool, cfg))
    else:
        ranked = queries.select("query_id").where("false").join(place.select("doc_id"), how="cross").withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    if mode in MODES:
        ranked = written(ranked, "ranked")  # few narrow rows, which are sent to the texts
    found = ranked.withColumnRenamed("doc_id", "chunk_id").join(chunks, "chunk_id").join(queries.select("query_id", "question"), "query_id")
    if targets is not None:
        found = ranking.only_targets(found, targets, cfg.pool if mode == "hybrid_rerank" else top_k, key="filename")
    if mode == "hybrid_rerank":
        logit = ranking.lexical_logit(F.col("question"), F.col("full_text")) if reranker is None else reranker
        found = stage("rerank", ranking.rerank(found, logit, top_k, text="full_text"))
    return ranking.with_methods(found.where(F.col("rank") <= top_k))


class Tracer:
    """Milliseconds of a batch's stages. Plans run when they are needed, so a stage is
    timed by writing its table: a few rows a query, which all later stages then read.
    `retrieve` and `generate` are whole; in between stand the steps that a mode has, of
    `bm25`, `dense`, `fusion`, `rerank`, `gate` and `citations`, each without those before."""

    def __init__(self) -> None:
        self.stages: dict[str, float] = {}

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        began = time.monotonic()
        out = written(df, name)
        self.stages[name] = self.stages.get(name, 0.0) + round(1000 * (time.monotonic() - began), 3)
        return out

    def whole(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A stage that times what `make` does too, its steps included."""
        began = time.monotonic()
        out = written(make(), name)
        self.stages[name] = self.stages.get(name, 0.0) + round(1000 * (time.monotonic() - began), 3)
        return out


#: The configurations that are published: a strategy of chunks and a mode each.
CONFIGS = {
    "dense": ("structural", "dense"), "bm25": ("structural", "bm25"), "hybrid": ("structural", "hybrid"),
    "hybrid_rerank": ("structural", "hybrid_rerank"), "hybrid_rerank_fixed": ("fixed", "hybrid_rerank"),
}


@dataclass
class Indexed:
    """Chunks of one strategy, their keyword index and the index of their vectors."""

    chunks: DataFrame
    index: Bm25Index
    dense: DenseIndex


def measured(questions: DataFrame, found: dict[str, DataFrame], cfg: Config = Config(), gate: Gate = answers.gate, tracer: Tracer | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, details) of the candidates of several configurations: one row a
    configuration, and one a configuration and question. All go through gate, answers and
    metrics together, under ids that are pairs of configuration and question id.

    `questions` has query_id, question and the labels that `judge` reads."""
    tracer = tracer or Tracer()

    def pair(config: str) -> Column:
        return F.struct(F.lit(config).alias("config"), F.col("query_id").alias("id"))

    cols = ["query_id", "question", "rank", "chunk_id", "doc_id", "filename", "page_number", "section_title", "text", "score", "reranker_prob"]
    none = F.lit(None).cast("double")
    parts = [
        (got if "reranker_prob" in got.columns else got.withColumn("reranker_prob", none)).select(cols).withColumn("query_id", pair(config)) for config, got in found.items()
    ]
    together = tracer.stage("retrieve", reduce(DataFrame.unionByName, parts))
    labelled = reduce(DataFrame.unionByName, [questions.withColumn("query_id", pair(config)) for config in found])
    results = tracer.stage("generate", answers.generate(labelled.select("query_id", "question"), together, cfg, gate))
    mean = (tracer.stages["retrieve"] + tracer.stages["generate"]) / max(1, results.count())
    marked = judge(labelled.withColumnRenamed("query_id", "question_id"), results.withColumn("latency_ms", F.lit(mean)), together)
    rows = marked.withColumn("config", F.col("query_id.config")).withColumn("query_id", F.col("query_id.id"))
    return evaluation.evaluate(rows, ["config"]), rows


class Engine:
    """Ingest a folder, index it once, and ask tables of questions.

    With `storage` versions are kept there as a manifest and found again by the next
    Engine. `gate` may be any function of the kind `Gate`."""

    def __init__(self, spark: SparkSession, cfg: Config = Config(), storage: str | None = None, gate: Gate = answers.gate, embedder: Callable | None = None):
        self.spark, self.cfg, self.storage, self.gate = spark, cfg, storage, gate
        self.embedder = embedder or hashed_embedder()
        self.versions: DataFrame | None = None
        self.strategy: str | Chunker = "structural"
        self.sets: dict[str, Indexed] = {}
        self.index_version, self.tracer = "v1", Tracer()
        self._open()
        if storage and (fs := fs_path(spark, f"{storage}/index_version"))[0].exists(fs[1]):
            self.index_version = spark.read.parquet(f"{storage}/index_version").first()["index_version"]

    @property
    def _now(self) -> Indexed | None:
        return self.sets.get(self.strategy if isinstance(self.strategy, str) else self.strategy.name)

    @property
    def chunks(self) -> DataFrame | None:
        return self._now and self._now.chunks

    @property
    def index(self) -> Bm25Index | None:
        return self._now and self._now.index

    def _batches(self, name: str) -> set[int]:
        """Numbers of the batches that a table in `storage` has."""
        fs, at = fs_path(self.spark, f"{self.storage}/{name}")
        return {r[0] for r in self.spark.read.option("basePath", str(at)).format("parquet" if name == "versions" else "text").load(str(at)).select("batch").distinct().collect()} if fs.exists(at) else set()

    def _open(self) -> None:
        if self.storage and self._batches("versions"):
            self.versions = self.spark.read.parquet(f"{self.storage}/versions")

    def ingest(self, files: DataFrame) -> DataFrame:
        """Status of each file; keeps the versions.

        With `storage` a batch is one write of versions under the batch's number, and the
        JSON manifest, which has the same rows without contents and with the index's
        version, follows batch by batch: one that a crash left out is made up by the next
        ingest. One writer at a time."""
        known = None if self.versions is None else self.versions.select("filename", "version", "content_hash")
        status = written(lineage.ingest(files, known), "status")
        kept = status.where("version is not null").drop("status")
        if not self.storage:
            self.versions = kept if self.versions is None else self.versions.unionByName(kept)
            return status
        if not kept.isEmpty():
            at = 1 + max(self._batches("versions"), default=-1)
            kept.write.mode("overwrite").parquet(f"{self.storage}/versions/batch={at}")
            self._open()
        for at in sorted(self._batches("versions") - self._batches("manifest")):
            rows = self.versions.where(F.col("batch") == at).drop("content", "batch").withColumn("index_version", F.lit(self.index_version))
            corpus.save_manifest(rows, f"{self.storage}/manifest/batch={at}", "overwrite")
        return status

    def ingest_folder(self, folder: str, source_type: str = "corpus") -> DataFrame:
        return self.ingest(corpus.scan(self.spark, folder, source_type))

    def upload(self, folder: str, filename: str, content: bytes) -> DataFrame:
        """Land an uploaded file in `folder` and ingest it; its status."""
        corpus.save_upload(self.spark, folder, filename, content)
        return self.ingest(corpus.scan(self.spark, folder, "uploaded").where(F.col("filename") == filename))

    def documents(self, active_only: bool = True, upto: int | None = None) -> DataFrame:
        """The newest version of each file, or all; with `storage` also as of batch `upto`."""
        rows = self.versions if upto is None else self.versions.where(F.col("batch") <= upto)
        return lineage.active(rows) if active_only else rows

    def reindex(self, strategy: str | Chunker | None = None, extract: Callable | None = None) -> DataFrame:
        """Chunk the active documents; write their keyword index, and their vectors by the
        engine's embedder as an index too."""
        strategy = strategy or self.strategy
        name = strategy if isinstance(strategy, str) else strategy.name
        chunks = written(chunk_files(self.documents(), strategy, self.cfg, extract), "chunks")
        index = Bm25Index.build(chunks, new_path(self.spark, "index"), "chunk_id", "full_text")
        vectors = ranking.embed(chunks, self.embedder, "chunk_id", "full_text")
        self.sets[name] = Indexed(chunks, index, DenseIndex.build(vectors, new_path(self.spark, "vectors"), "chunk_id"))
        self.strategy = strategy
        return chunks

    def bump_index_version(self, tag: str) -> None:
        """Name the index's version; with `storage` the next Engine finds it."""
        self.index_version = tag
        if self.storage:
            self.spark.createDataFrame([(tag,)], "index_version string").coalesce(1).write.mode("overwrite").parquet(f"{self.storage}/index_version")

    def stats(self) -> dict[str, int | str]:
        name = self.strategy if isinstance(self.strategy, str) else self.strategy.name
        return {"documents": self.documents().count(), "chunks": self.chunks.count(), "strategy": name, "index_version": self.index_version}

    def query(self, queries: DataFrame, mode: str = "bm25", top_k: int = 5, steps: bool = False, **more) -> tuple[DataFrame, DataFrame]:
        """(results, candidates) of a table of questions, each written once; `tracer` has
        the times of both, with `steps` of their steps too, and results carry the batch's
        mean latency."""
        self.tracer = t = Tracer()
        step = t.stage if steps else _as_is
        found = t.whole("retrieve", lambda: self._found(queries, mode, top_k, stage=step, **more))
        results = t.whole("generate", lambda: answers.generate(queries, found, self.cfg, self.gate, step))
        mean = (t.stages["retrieve"] + t.stages["generate"]) / max(1, results.count())
        return results.withColumn("latency_ms", F.lit(mean)), found

    def _found(self, queries: DataFrame, mode: str, top_k: int = 5, strategy: str | None = None, **more) -> DataFrame:
        held = self.sets[strategy] if strategy else self._now
        given = {"index": held.index, "embedder": self.embedder} | ({} if "vectors" in more else {"dense": held.dense}) | more
        return retrieve(held.chunks, queries, mode, top_k, cfg=self.cfg, **given)

    def trace(self, results: DataFrame, found: DataFrame, path: str) -> DataFrame:
        """Append the traces of the last query to `path`; `corpus.trace_by_id` reads one."""
        return corpus.save_traces(corpus.traces(results, found), path, self.tracer.stages)

    def evaluate(self, questions: DataFrame, mode: str = "bm25", top_k: int = 5, **more) -> DataFrame:
        """Metrics of labelled questions. As in the published figures, a refused question
        is judged on its first three candidates."""
        queries = questions.select(F.col("question_id").alias("query_id"), "question")
        results, found = self.query(queries, mode, top_k, **more)
        return evaluation.evaluate(judge(questions, results, found))

    def ablation(self, questions: DataFrame, configs: dict[str, tuple[str, str]] | tuple[str, ...] = CONFIGS, top_k: int = 5, **more) -> tuple[DataFrame, DataFrame]:
        """(metrics, details) of labelled questions in several configurations, each a
        strategy and a mode, or modes of the present strategy. A strategy that isn't
        indexed yet is; the present one stays."""
        was = self.strategy
        if not isinstance(configs, dict):
            configs = {mode: (was if isinstance(was, str) else was.name, mode) for mode in configs}
        for strategy in dict.fromkeys(s for s, _ in configs.values()):
            if strategy not in self.sets:
                self.reindex(strategy)
        self.strategy, self.tracer = was, Tracer()
        asked = questions.withColumnRenamed("question_id", "query_id")
        queries = asked.select("query_id", "question")
        found = {config: self._found(queries, mode, top_k, strategy, **more) for config, (strategy, mode) in configs.items()}
        return measured(asked, found, self.cfg, self.gate, self.tracer)


def judge(questions: DataFrame, results: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a question: labels, rank metrics and failure; `relevant_hit` is null where
    the question should be refused."""
    q = questions.withColumnRenamed("question_id", "query_id")
    shown = candidates.join(results.select("query_id", "decision"), "query_id").where((F.col("decision") == "ANSWER") | (F.col("rank") <= 3))
    rel = evaluation.relevant(F.col("filename"), F.col("text"), F.col("golden_doc_filenames"), F.col("golden_passage_keywords"))
    marked = shown.join(q.select("query_id", "golden_doc_filenames", "golden_passage_keywords"), "query_id").select("query_id", "rank", rel.alias("relevant"))
    by = evaluation.rank_metrics(marked)
    rows = q.select("query_id", "category", "should_abstain").join(results.drop("question"), "query_id").join(by, "query_id", "left")
    rows = rows.fillna(0, ["recall_1", "recall_3", "recall_5", "rr_5", "ndcg_5"]).withColumn("abstained", F.col("decision") == "ABSTAIN")
    hit = F.col("first_hit").isNotNull()
    rows = rows.withColumn("relevant_hit", F.when(~F.col("should_abstain"), hit))
    return rows.withColumn("failure", evaluation.failure(F.col("should_abstain"), F.col("abstained"), hit))
