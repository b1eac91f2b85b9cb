"""Stored vectors, sweeps over intervals, outlines, and configurations measured together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline.operators import ranking as R
from groundline.operators import sections as S
from groundline.operators.vectors import DenseIndex, centers, hashed_embedder
from groundline.plans.engine import CONFIGS, Engine


def brute(v, q, k):
    out = set()
    for i, x in q:
        same = [(j, float(np.dot(x, y))) for j, y in v if y is not None and len(y) == len(x) and all(c is not None and np.isfinite(c) for c in y)]
        for rank, (j, s) in enumerate(sorted(same, key=lambda r: (-round(r[1], 6), r[0]))[:k], 1):
            out.add((i, rank, j, round(s, 5)))
    return out


def shown(found, k):
    return {(r.query_id, r.rank, r.doc_id, round(r.score, 5)) for r in R.top(found, k).collect()}


@pytest.mark.parametrize("k,block,clusters,parts", [(5, 16, 20, 1), (1, 7, 3, 3), (40, 64, 500, 1)])
def test_dense_index_is_exact_and_skips(spark, tmp_path, k, block, clusters, parts):
    rng = np.random.default_rng(7)
    mids = rng.normal(size=(25, 8))
    x = mids[rng.integers(0, 25, 1500)] + 0.05 * rng.normal(size=(1500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = [(i, r.tolist()) for i, r in enumerate(x)] + [(5000 + i, x[3].tolist()) for i in range(60)]
    v += [(9000, None), (9001, []), (9002, [1.0, None]), (9003, [float("nan")] * 8), (9004, [1.0, 2.0]), (9005, [0.0] * 8)]
    q = [(i, x[i * 31].tolist()) for i in range(20)] + [(77, [0.5, 0.5]), (78, [0.0] * 8), (79, x[3].tolist())]
    df = spark.createDataFrame(v, "doc_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([*q, (80, None), (81, [])], "query_id long, embedding array<double>")
    index = DenseIndex.build(df, f"{tmp_path}/v", block=block, clusters=clusters)
    assert shown(index.top(asked, k, send_rows=-(-25 // parts)), k) == brute(v, q, k)
    near = asked.where("query_id < 20")
    assert shown(index.top(near, k), k) == brute(v, q[:20], k)
    if clusters == 20:  # few blocks are near twenty queries
        assert index.blocks_read.count() < 0.8 * index.blocks().count()
    assert index.top(asked.where("false"), k).count() == 0
    assert DenseIndex.build(df.where("false"), f"{tmp_path}/none").top(asked, k).count() == 0


def test_centers_of_few_rows():
    assert len(centers(np.array([[1.0, 2.0]] * 5), 9)) == 1


def test_hashed_vectors(spark):
    rows = [(1, "Apples and pears, apples"), (2, "apples PEARS"), (3, "the of and"), (4, None)]
    got = {r.i: np.array(r.embedding) for r in R.embed(spark.createDataFrame(rows, "i long, t string"), hashed_embedder(32), "i", "t").collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-12 and not got[3].any() and not got[4].any()
    assert got[1] @ got[2] == pytest.approx((2**0.5 + 1) / 3**0.5 / 2**0.5)


# intervals
def test_sweeps_equal_definitions(spark):
    rng = np.random.default_rng(11)
    docs = []
    for d in range(30):
        n = int(rng.integers(1, 400))
        cuts = sorted({0 if d % 2 else int(rng.integers(0, n)), *rng.integers(0, n, int(rng.integers(0, 9))).tolist()})
        docs.append((d, n, list(zip(cuts, [*cuts[1:], n]))))
    secs = [(d, i, f"s{i}", a, b) for d, _, cs in docs for i, (a, b) in enumerate(cs)]
    spans = [(d, k, *sorted(map(int, rng.integers(0, n + 1, 2)))) for d, n, _ in docs for k in range(25)]
    spans += [(99, 0, 3, 5), (None, 0, 1, 2)]
    chunk = spark.createDataFrame([(*s, "text") for s in spans], "doc_id long, chunk_index long, start long, end long, text string").repartition(4)
    sec = spark.createDataFrame(secs, "doc_id long, ordinal long, title string, start long, end long")
    want = {}
    for d, k, s, e in spans:
        hits = [t for x, i, t, a, b in secs if x == d and (a <= s < b or a <= e <= b)]
        want[d, k] = hits[0] if hits else "General"
    got = S.chunk_section(chunk, sec)
    assert {(r.doc_id, r.chunk_index): r.section_title for r in got.collect()} == want and got.count() == len(spans)
    for gap in (0, 1, 2):
        pages = [(d, p + 1, "x" * int(rng.integers(0, 60))) for d in range(30) for p in range(int(rng.integers(1, 9)))]
        off = S.page_offsets(spark.createDataFrame(pages, "doc_id long, page_number long, text string"), gap)
        held = [tuple(r) for r in off.collect()]
        for last in (False, True):
            pick = max if last else min
            want = {(d, k): pick((p for x, p, a, b in held if x == d and a <= s <= b), default=1) for d, k, s, _ in spans}
            assert {(r.doc_id, r.chunk_index): r.page_number for r in S.page_of(chunk, off, last).collect()} == want


def outline(text):
    """Headings by a stack, one line after the other."""
    import re

    heads = [(m.start(), len(m[1]), m[2].strip(), m) for m in re.finditer(r"^(#{1,6})\s+(.+)$", text, re.M)]
    if not heads:
        return [(0, 1, "General", ["General"], 0, len(text))]
    out, stack = [], []
    for i, (at, level, title, _) in enumerate(heads):
        stack = [x for x in stack if x[0] < level] + [(level, title)]
        out.append((i, level, title, [t for _, t in stack], at, heads[i + 1][0] if i + 1 < len(heads) else len(text)))
    return out


def test_outlines_of_any_nesting(spark):
    rng = np.random.default_rng(2)
    texts = ["", "no heading here", "#no blank\n####### seven", "# only", "\n\n###### deep first\n# top\n### skipped\n## back\n###### deepest"]
    for _ in range(30):
        lines = [("#" * int(rng.integers(1, 8)) + " " + f"t{i}" if rng.random() < 0.6 else f"line {i} # not") for i in range(int(rng.integers(1, 60)))]
        texts.append("\n".join(lines))
    texts.append("\n".join("#" * (1 + i * i % 6) + f" h{i}" for i in range(20_000)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in S.sections(df, "markdown").collect():
        got.setdefault(r.doc_id, []).append((r.ordinal, r.level, r.title, r.path, r.start, r.end))
    for i, t in enumerate(texts):
        assert sorted(got[i]) == outline(t), t[:80]


# configurations
def test_five_configurations_of_an_engine(spark, tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    for i in range(6):
        body = "\n\n".join(f"## Part {j}\n\nThe {w} budget of unit {i} grew to {10 * i + j} million in the year." for j, w in enumerate(("energy", "water", "paper")))
        (folder / f"unit{i}.md").write_text(f"# Unit {i}\n\n{body}\n")
    eng = Engine(spark, storage=str(tmp_path / "store"))
    eng.ingest_folder(str(folder))
    eng.reindex()
    schema = "question_id string, category string, question string, should_abstain boolean, golden_doc_filenames array<string>, golden_passage_keywords array<string>"
    asked = spark.createDataFrame(
        [("a\nb", "direct", "What was the energy budget of unit 3", False, ["unit3.md"], ["energy"]), ("c", "none", "Who painted the ceiling of the chapel", True, [], [])], schema
    )
    metrics, rows = eng.ablation(asked)
    got = {r.config: r for r in metrics.collect()}
    assert set(got) == set(CONFIGS) and eng.strategy == "structural" and set(eng.sets) == {"structural", "fixed"}
    assert all(r.total_questions == 2 and r.recall_at_5 in (0.0, 1.0) for r in got.values()) and any(r.recall_at_5 for r in got.values())
    assert {(r.config, r.query_id) for r in rows.collect()} == {(c, q) for c in CONFIGS for q in ("a\nb", "c")}
    queries = asked.select(F.col("question_id").alias("query_id"), "question")
    eng.query(queries, "hybrid_rerank", steps=True)
    assert set(eng.tracer.stages) == {"bm25", "dense", "fusion", "rerank", "retrieve", "gate", "citations", "generate"}
    t = eng.tracer.stages
    assert t["bm25"] + t["dense"] + t["fusion"] + t["rerank"] <= t["retrieve"] and t["gate"] + t["citations"] <= t["generate"]
    eng.bump_index_version("v7")
    assert Engine(spark, storage=str(tmp_path / "store")).index_version == "v7"


def test_batches_of_versions_and_their_manifest(spark, tmp_path):
    folder, store = tmp_path / "corpus", f"{tmp_path}/store"
    folder.mkdir()
    (folder / "a.md").write_text("# One\n\nfirst text")
    (folder / "b.txt").write_text("second text")
    Engine(spark, storage=store).ingest_folder(str(folder))
    (folder / "a.md").write_text("# One\n\nnewer text")
    eng = Engine(spark, storage=store)
    eng.bump_index_version("v2")
    eng.ingest_folder(str(folder))
    eng.ingest_folder(str(folder))  # nothing new, no batch
    told = lambda df: sorted((r.filename, r.version) for r in df.collect())
    assert told(eng.documents()) == [("a.md", 2), ("b.txt", 1)] and told(eng.documents(upto=0)) == [("a.md", 1), ("b.txt", 1)]
    manifest = lambda: {(r.filename, r.version, r.index_version) for r in spark.read.json(f"{store}/manifest").collect()}
    want = {("a.md", 1, "v1"), ("b.txt", 1, "v1"), ("a.md", 2, "v2")}
    assert manifest() == want
    import shutil

    shutil.rmtree(f"{store}/manifest/batch=1")  # as a crash between the two writes would leave it
    again = Engine(spark, storage=store)
    assert told(again.documents()) == told(eng.documents()) and again.index_version == "v2"
    again.ingest_folder(str(folder))
    assert manifest() == want
