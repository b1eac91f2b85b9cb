"""Operators 11 and 12 against brute force, and awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundline.llm import importance as I
from groundline.llm import winnowing as Wn
from groundline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, range string, ahead int, key string, hashes int, fit int, at int, score string, mark int, buckets string"
TEXTS = [
    (9, "the quick brown fox jumps over the lazy dog, twice over " * 3),
    (8, None),
    (7, ""),
    (6, "short"),
    (5, "exactly sixteen!"),
    (4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    (4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    (4, "another text under the same id, of more than thirty-one bytes"),
    (2, "Ünïcödé 日本語のテキスト 🙂 and so on and so on " * 9),
    (-3, "x" * 31),
    (None, "no id one, but with enough words to be of some use here"),
    (None, "no id two"),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "en", "r", 1, "k", 2, 3, 4, "s", 5, "b") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def winnowed(text, k, w):
    """By the definition: of each window the least hash, the rightmost of equal ones."""
    raw = text.encode()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64(raw[i : i + k], seed=42).intdigest()) & ~4095 for i in range(max(1, len(raw) - k + 1))]
    picked = {min(((h[i], -i) for i in range(a, min(a + w, len(h))))) for a in range(max(1, len(h) - w + 1))}
    return sorted((-i, x) for x, i in picked)


@pytest.mark.parametrize("k,w,block", [(16, 16, 2048), (16, 16, 7), (3, 5, 11), (1, 1, 4), (5, 23, 64), (8, 2, 100)])
def test_winnow_equals_definition(spark, k, w, block):
    texts = [t for _, t in TEXTS if t is not None] + ["ab" * 90, "é" * 50, "".join(chr(97 + i * i % 7) for i in range(900))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for i, got in df.select("i", Wn.winnow(F.col("text"), k, w, block)).collect():
        assert [tuple(x) for x in got] == winnowed(texts[i], k, w), texts[i][:40]


@pytest.mark.parametrize("ranges", [1, 2, 5, 100])
def test_fingerprints_of_awkward_tables(spark, table, ranges):
    mark = dict(table.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    order = sorted(TEXTS, key=lambda r: (r[0] is None, -(r[0] or 0), mark[r[1]]))
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        want[i, t or "", n or ""] += 1
    got = Counter((r.doc_id, r.text, r.next_text) for r in Wn.fingerprints(table, ranges=ranges).collect())
    assert got == want


def test_edited_likeness_by_brute_force(spark, table):
    mark = dict(table.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    order = sorted(TEXTS, key=lambda r: (r[0] is None, -(r[0] or 0), mark[r[1]]))
    got = Counter(tuple(r)[:3] + (round(r.near_edited, 9), round(r.near_next, 9)) for r in Wn.edited_likeness(table).collect())
    want = Counter()
    like = lambda a, b: len(a & b) / len(a | b)
    of = lambda t: {h for _, h in winnowed(t, Wn.K, Wn.WINDOW)}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(of(t), of(e)), 9), round(like(of(t), of(n)), 9)] += 1
    assert got == want


def test_winnowing_of_one_row_none_and_a_long_text(spark):
    one = spark.createDataFrame([(1, "alone " * 20)], "doc_id long, text string")
    r = Wn.edited_likeness(one).first()
    assert r.near_next == 1.0 and r.n_chars == 120
    assert Wn.edited_likeness(one.where("doc_id > 1")).count() == 0
    long = "".join(chr(97 + (i * 7919 + i // 31) % 26) for i in range(400_000))
    two = spark.createDataFrame([(1, long), (2, long), (3, long[1000:])], "doc_id long, text string")
    got = {r.doc_id: r for r in Wn.edited_likeness(two).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0 and got[3].near_next > 0.95


@pytest.mark.parametrize("k,w,block", [(16, 16, 512), (3, 5, 7), (1, 1, 3), (4, 2, 50)])
def test_splices_equal_whole_texts(spark, k, w, block):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        a, b = ("".join(rng.choice(list("abé"), int(rng.integers(0, 90 if i % 2 else 1500)))) for _ in range(2))
        cut = int(rng.integers(0, len(a) + 1))
        rows.append((i, a, len(a[:cut].encode()), a[:cut] + b))
    df = spark.createDataFrame(rows, "i int, a string, kept int, text string")
    old = Wn.chosen_blocks(F.col("a"), k, w, block)
    new = Wn.fingerprint(Wn.spliced(F.col("blocks"), F.col("kept"), F.col("text"), k, w, block), block)
    for r in df.withColumn("blocks", old).select("text", new.alias("f")).collect():
        assert [tuple(x) for x in r.f] == winnowed(r.text, k, w)


def test_shared_passage_is_always_matched(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, n))
    rows = []
    for i in range(60):
        shared = word(Wn.K + Wn.WINDOW - 1)
        rows.append((i, word(int(rng.integers(0, 99))) + shared + word(40), word(int(rng.integers(0, 99))) + shared + word(9)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    both = F.size(F.array_intersect(Wn.hashes(Wn.chosen_blocks(F.col("a"))), Wn.hashes(Wn.chosen_blocks(F.col("b")))))
    assert df.where(both == 0).count() == 0


# operator 12
@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=12), max_size=6), st.integers(1, 5))
def test_suffix_array_and_lcp(docs, depth):
    ids = np.array([x for d in docs for x in [*d, 0]], np.int32)
    order = I.suffix_array(ids, depth)
    cut = lambda i: tuple([*ids[i : i + depth].tolist(), *[-1] * depth][:depth])
    assert sorted(order.tolist()) == list(range(len(ids)))
    assert [cut(i) for i in order] == sorted(cut(i) for i in range(len(ids)))
    shared = I.lcp(ids, order, depth)
    for j in range(1, len(ids)):
        a, b, n = cut(order[j - 1]), cut(order[j]), 0
        while n < depth and a[n] == b[n] and a[n] > 0:
            n += 1
        assert shared[j] == n


def words(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB é日0-_\n~", max_size=40)), max_size=6), st.integers(1, 4))
def test_buckets_equal_plain_hashing(texts, longest):
    for (n, got), t in zip(I.block_buckets(texts, 97, longest), texts, strict=True):
        assert n == len(words(t))
        assert got.tolist() == [zlib.crc32(f.encode()) % 97 for f in features(t, longest)]


def test_buckets_of_long_texts():
    long = " ".join(f"w{i * i % 977}" for i in range(300_000))
    (n, got), (m, none) = I.block_buckets([long, None], 101, 2)
    assert (n, m, len(none)) == (300_000, 0, 0)
    assert got.tolist() == [zlib.crc32(f.encode()) % 101 for f in features(long, 2)]


def by_hand(docs, target, buckets, longest, least, share):
    of = lambda t: [zlib.crc32(f.encode()) % buckets for f in features(t, longest)]
    s, t = Counter(b for _, x in docs for b in of(x)), Counter(b for _, x in target for b in of(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in of(x))
        out.append([i, len(words(x)), len(of(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest,least,share", [(1, 3, 50), (3, 1, 100), (2, 20, 10)])
def test_resample_by_hand(spark, table, longest, least, share):
    target = [(0, "the lazy dog and the quick fox"), (1, None), (2, "words to be of use")]
    t = spark.createDataFrame([(*r, "x") for r in target], "item_id long, text string, bucket string")
    got = I.resample(table, t, 50, longest, least, share)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(TEXTS, target, 50, longest, least, share)


def test_resample_of_empty_tables(spark, table):
    none = table.where("false")
    t = spark.createDataFrame([], "item_id long, text string")
    assert I.resample(none, t).count() == 0
    got = I.resample(table, t, share=100, least_words=0)
    assert got.count() == len(TEXTS) and got.where("rank is null").count() == 0


def test_ranks_stand_whatever_the_ranges(spark, table):
    t = spark.createDataFrame([(0, "so on and so on")], "item_id long, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted((tuple(r) for r in I.resample(table, t, least_words=0, share=60).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1]


def test_queries_of_whole_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    got = QUERIES["op11_winnowing"](spark, sf_dir).toPandas()
    assert len(got) == n and got.near_edited.between(0, 1).all()
    assert got.near_edited.mean() > 0.25 > got.near_next.mean()
    ranks = QUERIES["op12_importance"](spark, sf_dir).toPandas()
    fit = (ranks.n_features >= 20).sum()
    assert len(ranks) == n and sorted(ranks["rank"].dropna()) == list(range(1, 10 * fit // 100 + 1))
