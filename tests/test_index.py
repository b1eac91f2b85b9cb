"""The keyword index that grows: equal to a rebuild after every change, and blocks left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline.operators import index as I
from groundline.operators import ranking as R
from groundline.operators.index import Bm25Index

WORDS = ["common", "usual", *(f"w{i}" for i in range(40)), *(f"rare{i}" for i in range(300))]


def texts(seed, n, ids):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, len(WORDS) + 1)
    p /= p.sum()
    return [(int(i), " ".join(rng.choice(WORDS, int(rng.integers(1, 60)), p=p))) for i in ids[:n]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    rng = np.random.default_rng(3)
    q = [(i, " ".join(rng.choice(WORDS[:60] + WORDS[-40:], 5))) for i in range(25)] + [(90, "common"), (91, "common rare7 rare7 rare8"), (92, "nowhere at all"), (93, None)]
    return spark.createDataFrame(q, "query_id long, question string").cache()


def key(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 8)) for r in df.collect())


def best(df, k):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in R.top(df, k).collect())


def same(index, spark, live, asked, k=5):
    want = R.bm25(frame(spark, sorted(live.items())), asked)
    assert key(index.score(asked)) == key(want)
    assert best(index.candidates(asked, k), k) == best(want, k)
    n = index.stats().first()
    assert n.n == len(live) and index.chunks().count() == len(live)


def test_every_change_equals_a_rebuild(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BOUNDED", 20)
    monkeypatch.setattr(I, "BLOCK_DOCS", 8)
    monkeypatch.setattr(I, "BUCKET_BYTES", 4000)
    index = Bm25Index(spark, f"{tmp_path}/index")
    assert index.segments() == [] and index.score(asked).count() == 0 and index.candidates(asked, 5).count() == 0
    live = dict(texts(1, 300, range(300))) | {1000: "", 1001: None}
    index.append(frame(spark, list(live.items())))
    same(index, spark, live, asked)
    for change in (dict(texts(2, 150, range(200, 400))), {5: "", 6: "common"}):  # new keys, and keys that are there
        index.append(frame(spark, list(change.items())))
        live |= change
        same(index, spark, live, asked)
    gone = [0, 5, 210, 399, 7777]
    index.delete(frame(spark, [(i, "") for i in gone]))
    live = {k: v for k, v in live.items() if k not in gone}
    same(index, spark, live, asked)
    index.append(frame(spark, [(0, "common common rare7"), (None, "no key")]))  # a deleted key comes again
    live[0] = "common common rare7"
    same(index, spark, live, asked, k=1)
    again = index.segments()[-1]["segment"]
    index.append(frame(spark, [(0, "common common rare7")]), segment=again)  # a segment written twice
    same(index, spark, live, asked)
    whole = index.compact(f"{tmp_path}/compact")
    assert [s["dead"] for s in whole.segments()] == [0]
    same(whole, spark, live, asked)
    same(Bm25Index(spark, f"{tmp_path}/compact"), spark, live, asked, k=400)
    assert sorted(map(tuple, whole.terms().collect())) == sorted(map(tuple, index.terms().collect()))


def test_repeated_keys_in_a_batch_and_empty_batches(spark, asked, tmp_path):
    index = Bm25Index(spark, f"{tmp_path}/index")
    index.append(frame(spark, []))
    assert index.score(asked).count() == 0 and index.stats().first().n == 0
    index.append(frame(spark, [(1, "common"), (1, "usual common"), (2, None)]))
    same(index, spark, {1: "usual common", 2: None}, asked)
    index.delete(frame(spark, []))
    same(index, spark, {1: "usual common", 2: None}, asked)


def test_blocks_below_the_bar_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_DOCS", 32)
    rows = [(i, "common usual " + " ".join(f"x{(i * 7 + j) % 900}" for j in range(2 + i % 97))) for i in range(4000)]
    rows += [(10_000 + i, "common usual") for i in range(12)]
    docs = frame(spark, rows)
    index = Bm25Index.build(docs, f"{tmp_path}/index")
    q = spark.createDataFrame([(1, "common usual"), (2, "common x5")], "query_id long, question string")
    assert best(index.candidates(q, 5), 5) == best(R.bm25(docs, q), 5)
    every = index.postings().where(F.col("term").isin("common", "usual", "x5")).count()
    assert every > 8000 and index.rows_read.count() < every / 2


def test_a_term_that_stands_everywhere_fills_many_files(spark, tmp_path):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("common").alias("text"))
        index = Bm25Index.build(docs, f"{tmp_path}/index")
        files = index.postings().where("term = 'common'").select(F.input_file_name().alias("f")).distinct().count()
        assert files >= 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dense_keeps_k_on_ties(spark):
    v = spark.range(5000).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding")).repartition(2)
    q = spark.range(300).select(F.col("id").alias("query_id"), F.array(F.lit(0.5), F.lit(0.1)).alias("embedding"))
    size = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))  # other tests make batches smaller
    found = R.dense(v, q, 5).cache()
    assert found.count() <= 300 * 5 * 2 * -(-5000 // size)
    assert {(r.query_id, r.doc_id) for r in R.top(found, 5).collect()} == {(i, j) for i in range(300) for j in range(5)}


def test_a_batch_of_questions_builds_no_index(spark, sf_dir, monkeypatch):
    from groundline import queries as Q

    def no(*args, **more):
        raise AssertionError("an index of all terms, for one batch of questions")

    monkeypatch.setattr(Bm25Index, "append", no)
    n = Q._questions(spark, sf_dir).count()
    assert Q._candidates(spark, sf_dir).count() == 5 * n
    assert Q._fused(spark, sf_dir).where("rank = 1").count() == n
    assert Q.QUERIES["ablation_five"](spark, sf_dir).count() == 5


def test_candidates_are_sent_to_their_texts(spark, sf_dir):
    from groundline import queries as Q

    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan = Q._bm25(spark, sf_dir, 5).join(texts, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_a_bar_keeps_the_k_best_and_leaves_out_others(spark, monkeypatch):
    monkeypatch.setattr(R, "FIRST", 4)
    docs = frame(spark, [*texts(5, 3000, range(3000)), *((5000 + i, "rare7 rare8") for i in range(40)), (None, "rare7"), (9000, None)])
    q = spark.createDataFrame([(1, "common usual w3"), (2, "rare7 rare8"), (3, "rare250"), (4, "nowhere"), (5, None)], "query_id long, question string")
    every = R.bm25(docs, q)
    for k in (1, 5, 20, 5000):
        some = R.bm25(docs, q, k=k)
        assert best(some, k) == best(every, k)
        assert k > 20 or some.count() < every.count() / 4


def test_candidates_read_the_asked_terms_once(spark, tmp_path, monkeypatch):
    docs = frame(spark, texts(6, 2000, range(2000)))
    index = Bm25Index.build(docs, f"{tmp_path}/index")
    kept, write = {}, I.written

    def spy(df, name):
        out = write(df, name)
        kept.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(I, "written", spy)
    q = spark.createDataFrame([(1, "common w3")], "query_id long, question string")
    found = index.candidates(q, 5)
    assert {r.term for r in kept["held"][0].select("term").distinct().collect()} == {"common", "w3"}
    assert len(kept["wanted"]) == 2  # seeds too are cut to their blocks before queries are joined
    assert best(found, 5) == best(R.bm25(docs, q), 5)


def test_tokens_of_plain_and_other_texts(spark):
    from groundline.functions.text import tokens

    rows = [("Plain ASCII-text a.b_c",), ("Größe der Wörter",), ("Kelvin • five",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(tokens(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [["plain", "ascii-text", "a.b_c"], ["der"], ["kelvin", "five"], [], None]


def test_split_tokens_finds_what_the_column_finds(spark):
    from collections import Counter

    from groundline.functions.text import plain, split_tokens, tokens

    rng = np.random.default_rng(11)
    letters = list("ab0_-.AZ  \n,'") + ["the", "can't", "é", "日", "•", "é", "İ", "K"]
    made = ["".join(rng.choice(letters, int(rng.integers(0, 16)))) for _ in range(3000)] + ["", "a-.", "-.ab.-", "été-b cZ-d"]
    rows = spark.createDataFrame([(t,) for t in made], "t string").select(plain(F.col("t")).alias("p"), tokens(F.col("t")).alias("x")).toArrow()
    words, which, row = split_tokens(rows["p"].combine_chunks())
    words, got = words.to_pylist(), [Counter() for _ in made]
    for i, r in zip(which, row, strict=True):
        got[r][words[i]] += 1
    assert got == [Counter(x) for x in rows["x"].to_pylist()]


def test_a_batch_of_questions_moves_no_postings(spark, monkeypatch):
    """Sums of a chunk are made where its text was read: no join, and nothing is dealt anew."""
    docs = frame(spark, texts(8, 2000, range(2000)))
    q = spark.createDataFrame([(i, "common usual w3 rare7") for i in range(300)] + [(None, "w5"), (900, "")], "query_id long, question string")
    found = R.bm25(docs, q, k=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    every = R.bm25(docs, q)
    assert found.count() < every.count() / 20  # two tiles of queries, 3 each that a task puts out, and few more
    with monkeypatch.context() as m:
        m.setattr(R, "SEND_TERMS", 0)  # beyond it rows are joined
        assert best(R.bm25(docs, q, k=3).where("query_id is not null"), 3) == best(found.where("query_id is not null"), 3)
        assert sorted(map(str, R.bm25(docs, q).select("query_id", "doc_id", F.round("score", 8)).collect())) == sorted(map(str, every.select("query_id", "doc_id", F.round("score", 8)).collect()))
    twice = docs.unionByName(docs.limit(50))  # keys that repeat are joined
    some = q.where("query_id < 3")
    asked = R.written(R._asked(some, "query_id", "question"), "asked")
    assert key(R.bm25(twice, some)) == key(R._joined(twice, asked, "doc_id", "text", "query_id", 1.5, 0.75, None))
    nested = some.withColumn("query_id", F.struct(F.lit("a").alias("config"), F.col("query_id").alias("id")))
    assert best(R.bm25(docs, nested, k=3).withColumn("query_id", F.col("query_id.id")), 3) == best(R.bm25(docs, some, k=3), 3)


def test_an_index_scores_all_queries_in_one_product(spark, asked, tmp_path, monkeypatch):
    """With `k` no row is made for a query's term in a chunk; without it only the terms' buckets are read."""
    monkeypatch.setattr(I, "BUCKET_BYTES", 4000)
    index = Bm25Index(spark, f"{tmp_path}/index")
    live = dict(texts(9, 400, range(400)))
    index.append(frame(spark, list(live.items())))
    index.delete(frame(spark, [(i, "") for i in range(50)]))
    index.append(frame(spark, [(7, "common rare7"), (8, "common rare7")]))
    live = {i: t for i, t in live.items() if i >= 50} | {7: "common rare7", 8: "common rare7"}
    want = R.bm25(frame(spark, sorted(live.items())), asked)
    for k in (1, 5, 500):
        some = index.score(asked, k=k)
        assert best(some, k) == best(want, k)
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "weight" not in plan and "Window" not in plan
    assert key(some) == key(want)
    assert index.score(asked.limit(2))._jdf.queryExecution().executedPlan().toString().count("bucket") > 0
    monkeypatch.setattr(R, "SEND_TERMS", 0)  # beyond it rows are joined
    assert best(index.score(asked, k=5), 5) == best(want, 5)
