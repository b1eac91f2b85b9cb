"""The jobs on copies of the tables: growing input, reruns, and their command lines."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from groundline.operators import ranking as R
from jobs import answer_questions, index_documents
from jobs.common import settings
from jobs.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent


def postings(index):
    return sorted(tuple(r) for r in index.postings().select("doc_id", "term", "tf", "dl").collect())


def test_index_takes_only_what_is_new(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    folder, out, mark = (f"{tmp_path}/{x}" for x in ("documents", "index", "checkpoint"))
    one, two = docs.where("doc_id < 120"), docs.where("doc_id >= 120").union(spark.createDataFrame([(3, "a newer text of document three", "en"), (None, "no id", "en")], docs.schema))
    one.coalesce(1).write.parquet(folder)
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")).limit(20)
    live = one
    for grown in (None, two):
        if grown is not None:
            grown.repartition(3).write.mode("append").parquet(folder)
            live = docs.where("doc_id <> 3").union(grown.where("text = 'a newer text of document three'"))
        index = index_documents.run(spark, folder, out, mark)
        before = [s["segment"] for s in index.segments()]
        got = postings(index)
        assert postings(index_documents.run(spark, folder, out, mark)) == got  # nothing new
        assert [s["segment"] for s in index.segments()] == before
        assert index.stats().first().n == live.count()
        key = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 8)) for r in df.collect())
        assert key(index.score(q)) == key(R.bm25(live, q))
    assert len(before) == 2 and index.segments()[-1]["dead"] == 1
    with pytest.raises(Exception, match="don't belong together"):
        index_documents.run(spark, folder, out, f"{tmp_path}/other")


def test_small_batches_give_the_same_index(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents")
    a, b = (
        index_documents.run(spark, f"{tmp_path}/documents", f"{tmp_path}/{n}", f"{tmp_path}/c{n}", index_documents.Settings(files_per_batch=n)) for n in (0, 1)
    )
    assert len(a.segments()) == 1 and len(b.segments()) == 4 and postings(a) == postings(b)


def test_answers_rerun_and_use_a_kept_index(spark, sf_dir, tmp_path):
    docs, asked = f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet"
    got = [sorted(map(str, answer_questions.run(spark, docs, asked, f"{tmp_path}/out").collect())) for _ in range(2)]
    assert got[0] == got[1] and len(got[0]) == spark.read.parquet(asked).count()
    assert {p for p in os.listdir(f"{tmp_path}/out/answers") if p.startswith("decision=")} <= {"decision=ANSWER", "decision=ABSTAIN"}
    index_documents.run(spark, docs, f"{tmp_path}/kept", f"{tmp_path}/mark")
    again = answer_questions.run(spark, docs, asked, f"{tmp_path}/two", index=f"{tmp_path}/kept")
    assert sorted(map(str, again.collect())) == got[0]


def test_answers_without_rows(spark, tmp_path):
    spark.createDataFrame([(1, None, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(1, "what"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/q")
    got = {r.query_id: r for r in answer_questions.run(spark, f"{tmp_path}/d", f"{tmp_path}/q", f"{tmp_path}/out").collect()}
    assert {(i, r.decision, r.reason, r.best_doc, r.answer) for i, r in got.items()} == {(i, "ABSTAIN", "missing_evidence", None, None) for i in (1, 2)}


def test_answers_build_no_index(spark, tmp_path):
    rows = [(1, "solar panels on the roof give power", "s"), (2, "power of the river", "s"), (None, "solar power", "s"), (3, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(1, "solar power"), (2, "river power")], "item_id long, text string").write.parquet(f"{tmp_path}/q")
    index_documents.run(spark, f"{tmp_path}/d", f"{tmp_path}/kept", f"{tmp_path}/mark")
    got, kept = (sorted(map(str, answer_questions.run(spark, f"{tmp_path}/d", f"{tmp_path}/q", f"{tmp_path}/{o}", index=i).collect())) for o, i in (("a", None), ("b", f"{tmp_path}/kept")))
    assert got == kept and len(got) == 2
    assert os.listdir(f"{tmp_path}/a") == ["answers"]


def test_settings_files():
    for job in (index_documents, answer_questions):
        assert settings(job.Settings, str(Path(job.__file__).with_suffix(".json")))
    with pytest.raises(ValueError):
        settings(index_documents.Settings, _file({"no_such": 1}))


def _file(held):
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False) as f:
        json.dump(held, f)
    return f.name


def test_command_line(sf_dir, tmp_path):
    args = [sys.executable, str(ROOT / "jobs/index_documents.py"), "--documents", f"{sf_dir}/documents.parquet", "--out", f"{tmp_path}/index", "--checkpoint", f"{tmp_path}/mark"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=4 --conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run(args, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote segment 0" in done.stderr and os.path.isdir(f"{tmp_path}/index/postings/segment=0")


def test_jobs_need_no_training_data_package():
    for f in (*ROOT.glob("jobs/*.py"), Path(__file__)):
        lines = [x for x in f.read_text().splitlines() if x.lstrip().startswith(("import ", "from "))]
        assert not any("llm" in x or "corpus_pipeline" in x for x in lines)
    assert set(QUERIES) == set(ORACLES) == {"job1_index_documents", "job2_answer_questions"}
