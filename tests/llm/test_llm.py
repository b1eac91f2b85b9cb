"""Each operator against brute force, exact round trips, and awkward tables."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundline.llm import chat, compaction, gridjoin, langid, mixing, packing, quality, simhash, topk, wavelet
from groundline.llm.common import connected_components, new_path, shared_dir
from groundline.llm.queries import ORACLES, QUERIES
from groundline.llm.tokens import Encoder, vocabulary

LONG = "word " * 60_000
AWKWARD = [
    (0, "The cat sat on the mat and looked around.", "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \t\n ", "de", "b"),
    (4, "The cat sat on the mat and looked around.", "en", "a"),
    (4, "The cat sat on the mat and looked around.", "en", "a"),
    (5, LONG, "en", "b"),
    (6, "12345 !!! ###", "fr", "c"),
    (7, "Ünïcode 日本語 text  with\n\nruns <|endoftext|>", None, "c"),
    (None, "no id here at all", "en", None),
]
SCHEMA = "doc_id long, text string, lang string, source string, size long, kept string, score int, fp string, copies int, uid int"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(*r, 9, "x", 1, "y", 2, 3) for r in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


# tokens and operator 1
def _equal_whole(name, texts):
    """What the encoder gives against the library's plain call on each whole text."""
    ids, ends = _encoder(name).flat(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist())]
    assert got == [_ids(t, name).tolist() for t in texts]


MIXED = "ab^\x01\x00\r Z'.,!9\n\té日́\x85İẛfiШ²=<|~"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=MIXED, max_size=30)), max_size=8))
def test_units_equal_whole_texts(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        _equal_whole(name, texts)


def test_letters_beside_marks_and_added_tokens():
    import unicodedata

    letters = [chr(c) for c in (*range(0x3400), *range(0xA000, 0x12000, 3)) if unicodedata.category(chr(c))[0] in "LMN"]
    rng = np.random.default_rng(4)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        for i in range(0, len(letters), 4000):
            some = letters[i : i + 4000]
            _equal_whole(name, [f"{c}. x{c}, {c}{rng.choice(some)}! BEL{c}," for c in some])
        _equal_whole(name, ["İ.", "BELİ, x", "hello <|endoftext|> world", "a<|startoftext|>b", "<|endoftext|>", None, ""])


def test_units_come_back_from_the_older_generation(monkeypatch):
    from groundline.llm import tokens

    monkeypatch.setattr(tokens, "_LIMIT", 40)
    rng = np.random.default_rng(6)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = Encoder(vocabulary(name), name.startswith("byte"))
        for _ in range(20):
            texts = [" ".join(f"w{chr(97 + int(k) % 26)}{chr(65 + int(k) % 13)}," for k in rng.integers(0, 99, 30)) for _ in range(4)]
            assert enc.flat(pa.array(texts))[0].tolist() == [x for t in texts for x in _ids(t, name).tolist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500))
def test_wavelet_matrix(ids):
    a = np.array(ids, "<u4")
    _, lengths, m = wavelet.unpack(wavelet.pack([1], [len(a)], a))
    assert m.decode().tolist() == ids and lengths.tolist() == [len(ids)]
    for t in {0, 7, 41, *ids[:3]}:
        assert m.count(t) == ids.count(t)
        assert m.positions(t) == [i for i, x in enumerate(ids) if x == t]
        assert m.rank(t, len(ids) // 2) == ids[: len(ids) // 2].count(t)
        assert m.select(t, ids.count(t)) == -1
    for i in range(0, len(ids), 97):
        assert m.access(i) == ids[i]


@functools.cache
def _tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


@functools.cache
def _encoder(name):
    return Encoder(vocabulary(name), name.startswith("byte"))


def _ids(text, name="byte_bpe_50k.json"):
    return np.array([*_tokenizer(name).encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def _expect_files(docs):
    at, out = 0, []
    for d, t in sorted(docs, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = _ids(t)
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_op1_files(spark, sf_dir, awkward, empty):
    got = rows(QUERIES["op1_wavelet_files"](spark, sf_dir))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(got) == _expect_files(docs)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(rows(wavelet.token_files(spark, awkward)), key=key) == sorted(_expect_files([r[:2] for r in AWKWARD]), key=key)
    assert rows(wavelet.token_files(spark, empty)) == []


def test_op1_small_shards(spark, awkward):
    path = new_path(spark, "ids")
    wavelet.write_ids(awkward, path, vocabulary("byte_bpe_50k.json"), shard_ids=20)
    assert spark.read.parquet(path).count() > 4
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(rows(wavelet.read_ids(spark, path)), key=key) == sorted(_expect_files([r[:2] for r in AWKWARD]), key=key)


# operator 2
def _top(vectors, k=5, every=50):
    out = []
    ok = [(i, v) for i, v in vectors if i is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    for a, (q, x) in enumerate(ok):
        if q % every == 0:
            s = [
                (-sum(math.floor(256 * float(p)) * math.floor(256 * float(r)) for p, r in zip(x, y)), c)
                for b, (c, y) in enumerate(ok)
                if a != b and len(x) == len(y)
            ]
            out += [(q, n + 1, c, -z) for n, (z, c) in enumerate(sorted(s)[:k])]
    return sorted(out)


def test_op2_awkward(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=3).round(2).tolist()) for i in range(120)]
    vectors += [(50, vectors[50][1]), (200, vectors[7][1]), (201, None), (250, [float("nan"), 1.0, 0.0]), (251, [None, 1.0, 2.0])]
    vectors += [(300, [1.0, 2.0]), (301, []), (None, [1.0, 2.0, 3.0]), *[(400 + i, vectors[0][1]) for i in range(9)]]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in vectors], "vec_id long, embedding array<double>, score int, tile string")
    assert sorted(rows(topk.top_k(df.repartition(5)))) == _top(vectors)
    assert rows(topk.top_k(df.limit(0))) == []


def test_op2_large_components_stay_exact():
    q = (np.array([1]), np.array([0]), np.array([[2.0**30, 1.0]]))
    c = (np.array([2, 3]), np.array([5, 6]), np.array([[2.0**31, 1.0], [2.0**31, 2.0]]))
    r, k, s = topk.top_of_tile(q, c, 1)
    assert (r.tolist(), k.tolist(), s.tolist()) == ([0], [1], [2**61 + 2])


def test_op2_beyond_doubles_and_longs(spark):
    big = [(0, [1e30, 1.0]), (50, [1e308, -1.0]), (1, [1e5, 2.0]), (2, [-1e30, 1.0]), (3, [0.0, 3.0]), (4, [1.7e308, 0.0])]
    got = rows(topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>")))
    low, high = -(1 << 63), (1 << 63) - 1
    whole = lambda v: [int(x) * 256 if abs(x) >= 1 << 53 else math.floor(256 * x) for x in v]
    for q in (0, 50):
        s = sorted((-min(max(sum(a * b for a, b in zip(whole(dict(big)[q]), whole(v))), low), high), i) for i, v in big if i != q)
        assert sorted(r[1:] for r in got if r[0] == q) == [(n + 1, i, -z) for n, (z, i) in enumerate(s[:5])]


def test_op2_many_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 8)
    rng = np.random.default_rng(2)
    vectors = [(i, rng.integers(-2, 3, 2).astype(float).tolist()) for i in range(400)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(6)
    assert sorted(rows(topk.top_k(df))) == _top(vectors)


# operator 3
def _kneser_ney(counts, order, asked):
    """Plain dictionaries, straight from the definition."""
    level = {order: {g: c for g, c in counts.items() if len(g) == order and c}}
    for k in range(order - 1, 0, -1):
        level[k] = dict(Counter(g[1:] for g in level[k + 1]))
        level[k] |= {g: c for g, c in counts.items() if len(g) == k and g[0] == quality.BOS and c}
    cut = {}
    for k, c in level.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 0.75, 3 - 4 * y * n[4] / n[3] if n[3] else 1.0]
        cut[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]

    def p(g):
        if not g:
            return 1 / (len(level[1]) + 1)
        k = len(g)
        own = {x: c for x, c in level[k].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p(g[1:])
        free = sum(cut[k][min(c, 3) - 1] for c in own.values())
        c = own.get(g, 0)
        return (c - cut[k][min(c, 3) - 1] if c else 0) / total + free / total * p(g[1:])

    return {g: math.log(p(g)) for g in asked}


def test_op3_probabilities(spark):
    trusted, other = "the cat sat on the mat the hat that fat cat".split(), "zebra cat !!! the".split()
    counts, asked = Counter(), set()
    for w in trusted:
        counts.update(quality.events(w, 3))
    for w in trusted + other:
        asked |= set(quality.events(w, 3))
    df = spark.createDataFrame([(g, counts[g]) for g in asked], "gram string, c long")
    got = dict(rows(quality.probabilities(df, 3)))
    want = _kneser_ney(counts, 3, asked)
    assert got.keys() == want.keys()
    assert all(abs(got[g] - want[g]) < 1e-9 for g in want)
    # a history's probabilities sum to one over the known symbols and one unknown
    symbols = sorted({g[-1] for g in counts} | {quality.EOS})
    sums = _kneser_ney(counts, 3, {"th" + s for s in symbols} | {"th☃"})
    assert abs(sum(math.exp(x) for x in sums.values()) - 1) < 1e-6


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=12), max_size=6), st.booleans())
def test_op3_grams_of_many_words(words, wide):
    words = words + ["".join(map(chr, range(0x4E00, 0x4E00 + 9000)))] * wide
    names, of, owner = quality.grams_of(words)
    assert [(names[i], words[o]) for i, o in zip(of, owner)] == [(g, w) for w in words for g in quality.events(w)]
    assert len(set(names)) == len(names)


def test_op3_keeps_trusted_and_rejects_marks(spark, awkward, empty):
    good = [(i, f"the small house number {'abcdefgh'[i % 8]} stands on the green hill by the sea", "en") for i in range(100)]
    bad = [(100 + i, "th### sm&&& hou$$$ nu%%% xq!! zv!! " * 3, "en") for i in range(5)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    ids = spark.range(0, 60).select(F.col("id").alias("doc_id"))
    for send in (10**6, 0):  # broadcast, and the joined way beyond its bound
        got = {r.doc_id: r.kept for r in quality.classify(docs, ids, send_rows=send).collect()}
        assert got == {i: i < 100 for i in range(105)}
    with pytest.raises(ValueError):
        quality.classify(awkward, ids, keep_text=True)
    assert quality.classify(awkward.drop("kept"), ids, keep_text=True).count() == len(AWKWARD)
    kept = {r.doc_id: r.kept for r in quality.classify(awkward, ids).collect()}
    assert [kept[i] for i in (1, 2, 3)] == [False] * 3
    assert rows(quality.classify(empty, ids)) == []
    assert quality.classify(awkward, ids.limit(0)).where("kept").count() == len(AWKWARD) - 3


def _quantile(values, q):
    v = sorted(round(x / quality.GRAIN) for x in values)
    return v[math.ceil(q * len(v) - 1e-9) - 1] * quality.GRAIN


def test_op3_against_plain_python(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdé"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, int(rng.integers(5, 30)))) for _ in range(120)] + ["zzz qqq xxx", "ab " * 40, "", None, " \n", words[0]]
    docs = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    ids = spark.range(0, 90).select(F.col("id").alias("doc_id"))
    trust = {r.doc_id: (r._trusted, r._calibrate) for r in quality.with_trust(df, ids).collect()}
    assert {sum(x) for d, x in trust.items() if d < 90} == {1} and not any(any(x) for d, x in trust.items() if d >= 90)
    plain = {d: " ".join((t or "").split()) for d, t, _ in docs}
    counts = Counter(g for d, t in plain.items() if t and trust[d][0] for g in quality.events(t))
    logp = _kneser_ney(counts, quality.ORDER, {g for t in plain.values() if t for g in quality.events(t)})
    n = {d: len(t) + 1 if t else 0 for d, t in plain.items()}
    loss = {d: -sum(logp[g] for g in quality.events(t)) / n[d] for d, t in plain.items() if t}

    def again(t):
        seen, total, w = {}, 0.0, t.split()
        for i, pair in enumerate(zip(w, w[1:])):
            total += 1 / (i - seen[pair]) if pair in seen else 0
            seen[pair] = i
        return total / (len(w) + quality.REPEAT_MORE)

    short = lambda d: quality.SHORT / math.sqrt(n[d])
    lang = {d: x or "" for d, _, x in docs}
    kept, limit = {}, {}
    for d in plain:
        own = [c for c in loss if trust[c][1] and lang[c] == lang[d]]
        high, mid = (_quantile([loss[c] - short(c) for c in own], q) for q in (quality.HIGH, quality.MID))
        most = max(quality.REPEAT_LEAST, quality.REPEAT_MARGIN * _quantile([again(plain[c]) for c in own], quality.HIGH))
        if n[d]:
            limit[d] = high + max(quality.LEAST, quality.MARGIN * (high - mid)) + short(d)
        kept[d] = d in loss and loss[d] <= limit[d] and again(plain[d]) <= most
    got = {r.doc_id: r for r in quality.classify(df, ids).collect()}
    assert {d: r.kept for d, r in got.items()} == kept and 0 < sum(kept.values()) < len(docs) - 4
    for d, r in got.items():
        assert r.perplexity is None if d not in loss else r.perplexity == pytest.approx(math.exp(loss[d]), rel=1e-9)
        assert d not in loss or r.limit == pytest.approx(math.exp(limit[d]), rel=1e-9)


def test_op3_joined_way_keeps_every_column(spark, monkeypatch):
    texts = [f"a plain line of words, number {i}" for i in range(40)] + [None, "", "###"]
    docs = [(None if i % 9 == 4 else 2**60 + i, t, "en", (2**60 + 2 * i + 1, None if i % 2 else f"s{i}"), [i, None], None if i % 3 else i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, rest struct<big:long,s:string>, xs array<long>, maybe long")
    ids = df.where("doc_id is not null and doc_id % 2 = 1").select("doc_id")
    monkeypatch.setattr(quality, "BLOCK_DOCS", 7)
    one, two = (sorted(rows(quality.classify(df, ids, send_rows=n, keep_text=True)), key=str) for n in (10**6, 0))
    assert one == two and sorted((r[:-1] for r in two), key=str) == sorted([(i, t, x, tuple(s), a, m) for i, t, x, s, a, m in docs], key=str)
    assert sum(r[-1] for r in two) > 30


def test_op3_rejects_repeated_words(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(200)]
    good = [" ".join(rng.choice(words, 80)) for _ in range(200)]
    bad = [" ".join([w] * 80) for w in words[:10]]  # one word
    bad += [" ".join(w for w in words[i : i + 8] for _ in range(10)) for i in range(10)]  # one after another
    bad += [" ".join(words[i : i + 8] * 10) for i in range(10)]  # a phrase
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    ids = spark.range(0, 150).select(F.col("id").alias("doc_id"))
    for send in (10**6, 0):
        kept = {r.doc_id: r.kept for r in quality.classify(docs, ids, send_rows=send).collect()}
        assert not any(kept[i] for i in range(200, 230))
        assert sum(kept[i] for i in range(200)) > 190


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab é日", max_size=40), max_size=6), st.integers(1, 9))
def test_op3_grams_run_across_tokens_and_pieces(texts, piece):
    got = [(names[i], o) for names, of, owner in quality.grams_of_texts(texts, piece=piece) for i, o in zip(of, owner)]
    assert got == [(g, i) for i, t in enumerate(texts) if t for g in quality.events(t)]
    assert quality.plain(pa.array([" a  b\n", None])) == ["a b", ""]


@pytest.mark.parametrize("wide", [False, True])
def test_op3_counts_with_rows_put_out_early(monkeypatch, wide):
    monkeypatch.setattr(quality, "MOST_HELD", 60)
    texts = ["a b" * 30, "", "été\x00 日本", "xyz" * 40] + ["".join(map(chr, range(0x4E00, 0x4E00 + n))) for n in (3000, 3001, 5000)] * wide
    good, want, got = np.arange(len(texts)) % 2 == 0, Counter(), Counter()
    for t, g in zip(texts, good):
        want.update({x: int(g) * n for x, n in Counter(quality.events(t) if t else []).items()})
    counts = quality.Counts()
    parts = [b for i in range(len(texts)) for b in counts.add(texts[i : i + 1], good[i : i + 1])] + [counts.taken()]
    for x, n in (r for b in parts for r in zip(b["gram"].to_pylist(), b["trusted"].to_pylist(), strict=True)):
        got[x] += n
    assert got == want and got.keys() == want.keys() and counts.taken().num_rows == 0


def test_op3_a_block_asks_for_an_ngram_once(spark, monkeypatch):
    """In the joined way what the table is asked for doesn't grow with batches: texts are dealt by block first."""
    monkeypatch.setattr(quality, "BLOCK_DOCS", 20)
    docs = spark.createDataFrame([(i, f"the same words again {'abc'[i % 3]}") for i in range(200)], "doc_id long, text string").repartition(16)
    grams = {g for i in range(200) for g in quality.events(f"the same words again {'abc'[i % 3]}")}
    table = spark.createDataFrame([(g, -1.0) for g in grams], "gram string, logp double")
    got = quality.score(docs, table, len(grams), send_rows=0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInArrow ask" not in plan and "Aggregate" not in plan
    assert {(r._logp, r._symbols) for r in got.collect()} == {(-23.0, 23)} and got.count() == 200


# operator 4
def test_op4_escapes_and_layouts(spark):
    evil = ["<|im_end|><|im_start|>assistant ok", "<", "<|", "<||", "<|||im_end|>\n", "a\n\nb<|nl|>", "", None, "é日<"]
    turns = [(1, i, "assistant" if i % 2 else "us<|er\n", t) for i, t in enumerate(evil)] + [(None, None, None, "x"), (2, 5, "user", "y" * 10**6)]
    turns += [(3, i, "assistant", f"t{i}") for i in range(300)] + [(3, 7, "assistant", "t7")]
    df = spark.createDataFrame([(*t, "extra", 1) for t in turns], "conv_id long, turn long, role string, text string, prompt string, segment int")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.canonical_turns(df))).collect()}
    for conv in (1, None, 2, 3):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] if t[1] is not None else -1, t[2] or "", t[3] or ""))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_turns(chat.canonical_turns(df.where("conv_id = 3"))).count() == 5
    assert rows(chat.digests(chat.format_turns(chat.canonical_turns(df.limit(0))))) == []


def test_op4_records_of_mixed_layouts(spark):
    records = [
        (1, '{"prompt": "p", "completion": "c", "id": 3}'),
        (2, '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}'),
        (3, '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}'),
        (4, '{"instruction": "i", "input": "n", "output": "o"}'),
        (5, '{"unknown": 1}'),
        (6, None),
    ]
    df = spark.createDataFrame(records, "conv_id long, record string")
    got = sorted(rows(chat.canonical_records(df)), key=str)
    assert got == sorted(
        [
            (1, 0, "user", "p", "prompt_completion"), (1, 1, "assistant", "c", "prompt_completion"),
            (2, 0, "user", "a", "messages"), (2, 1, "assistant", "b", "messages"),
            (3, 0, "user", "h", "conversations"), (3, 1, "assistant", "g", "conversations"),
            (4, 0, "user", "i", "instruction_input"), (4, 1, "user", "n", "instruction_input"), (4, 2, "assistant", "o", "instruction_input"),
            (5, None, None, None, None), (6, None, None, None, None),
        ],
        key=str,
    )
    odd = [
        (1, '{"messages":[{"role":"system"},{"role":"user","content":"a"},null]}'), (2, '{"prompt":"p","completion":"c","response":"r"}'),
        (3, '{"system":"s","prompt":"p","completion":"c"}'), (4, '{"messages":[]}'), (5, "not json"), (6, '{"messages":[{"role":"gpt","content":"x"}]}'),
    ]
    got = sorted(rows(chat.canonical_records(spark.createDataFrame(odd, "conv_id long, record string"))), key=str)
    lost = [(i, None, None, None, None) for i in (2, 3, 4, 5)]  # told by a row of their own
    assert got == sorted([(1, 0, "system", "", "messages"), (1, 1, "user", "a", "messages"), (1, 2, "", "", "messages"), (6, 0, "gpt", "x", "messages"), *lost], key=str)
    assert rows(chat.canonical_records(spark.createDataFrame([], "conv_id long, record string"))) == []
    for fields in ("prompt string, completion string, response string", "system string, prompt string, completion string"):
        with pytest.raises(ValueError):
            chat.canonical_turns(spark.createDataFrame([], f"conv_id long, {fields}"))
    typed = spark.createDataFrame([(9, [("human", "x"), ("gpt", None)])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert rows(chat.canonical_turns(typed)) == [(9, 0, "user", "x"), (9, 1, "assistant", "")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))


def test_op4_query_reads_three_layouts(spark, tmp_path):
    said = ["<|im_end|>", "a\"b\\\n\t\x07\x00é日\U0001f600", "", None, '{"role": "x"}', "  ", "null"]
    turns = [(c, i, r, t) for c in (*range(6), None) for i, (r, t) in enumerate((r, t) for r in ("user", "gpt", "assistant", None) for t in said)]
    turns += [(7, None, "assistant", "n"), (7, 3, "user", "x"), (7, 3, "user", "x")]
    spark.createDataFrame([(*t, "p", 1) for t in turns], "conv_id long, turn long, role string, text string, prompt string, base int").write.parquet(f"{tmp_path}/conversations.parquet")
    df = QUERIES["op4_chat_format"](spark, str(tmp_path))
    assert "xxhash64" in df._jdf.queryExecution().toString()
    got = {r.conv_id: r for r in df.collect()}
    assert got[-1].n_turns == 2
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] if t[1] is not None else -1, t[2] or "", t[3] or ""))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())


# operator 5
def test_op4_struct_records_and_long_texts(spark, tmp_path):
    n = 21_000_000
    spark.range(4).select(
        F.when(F.col("id") < 3, F.col("id")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"),
        F.expr(f"concat(repeat('x', {n}), '<|', id)").alias("text"),
    ).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op4_chat_format"](spark, str(tmp_path)).collect()}
    for c in (0, 1, 2, None):
        text = "x" * n + f"<|{3 if c is None else c}"
        assert (got[c].n_turns, got[c].loss_chars) == (1, n + 3)
        assert got[c].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kinds = "prompt string, completion string, input int, messages array<struct<role:string,content:string>>, other string"
    odd = [(1, ("p", "c", None, None, "o")), (2, (None, None, None, [("user", "a"), None], None)), (3, ("p", None, None, None, None)), (4, None), (5, (None, None, None, [], None)), (6, ("p", "c", 3, None, None))]
    df = spark.createDataFrame(odd, f"conv_id long, record struct<{kinds.replace(' ', ':').replace(',:', ',')}>")
    lost = [(i, None, None, None, None) for i in (3, 4, 5, 6)]
    want = [(1, 0, "user", "p", "prompt_completion"), (1, 1, "assistant", "c", "prompt_completion"), (2, 0, "user", "a", "messages"), (2, 1, "", "", "messages"), *lost]
    assert sorted(rows(chat.canonical_records(df)), key=str) == sorted(want, key=str)


def test_op4_many_rows_of_one_turn(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    parts = chat.format_turns(df)
    assert parts.agg(F.max("n_turns")).first()[0] == chat.PART
    r = chat.digests(parts).first()
    loss = "".join(sorted(str(i) for i in range(20_000)))
    assert (r.n_turns, r.loss_sha256) == (20_000, hashlib.sha256(loss.encode()).hexdigest())


def test_op5_plan():
    s = [compaction.Shard(f"{i}", 10) for i in range(9)] + [compaction.Shard("big", 1000), compaction.Shard("mid", 100)]
    plan = compaction.plan_merges(s, target=40, fan_in=4)
    assert [len(r) for r in plan] == [4, 4]
    assert compaction.plan_merges(s[:3], target=1000, fan_in=4) == []


def test_op5_store(spark, awkward, empty):
    store = compaction.ShardStore(spark, new_path(spark, "store"), awkward.schema)
    for _ in range(5):
        store.append(awkward.coalesce(1), rows=4)
    before = len(store.manifest()[1])
    version = store.compact(target=1 << 20, fan_in=4)
    assert before == 15 and len(store.manifest()[1]) < 5 and version > 5
    key = lambda r: str(tuple(r))
    assert sorted(map(key, store.read().collect())) == sorted(map(key, awkward.collect() * 5))
    with pytest.raises(FileExistsError):
        store.commit(version - 1, [])
    assert all(len(store.read(v).collect()) == 50 for v in store.versions()) and len(store.versions()) == compaction.KEEP
    other = compaction.ShardStore(spark, store.root)  # a second writer commits first
    plain = store.commit
    store.commit = lambda seen, shards: (setattr(store, "commit", plain), other.append(awkward.limit(1)), plain(seen, shards))[2]
    store.append(awkward.limit(2).select(*reversed(awkward.columns)))
    assert store.read().count() == 53
    with pytest.raises(ValueError):
        store.append(awkward.withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError):
        store.append(awkward.drop("lang"))
    assert rows(compaction.compact_table(empty, new_path(spark, "store"))) == []


# operator 6
def _near(vectors, cosine):
    ok = [(i, np.array(v, float), l) for i, v, l in vectors if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    parent = {i: i for i, *_ in vectors}
    links = Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x, l) in enumerate(ok):
        for j, y, m in ok[:a]:
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, links[i], find(i), find(i) == i) for i, *_ in vectors)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_op6_awkward(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    vectors = [(i, (centres[i % 12] * (1 + i % 3) + rng.normal(size=6) * 0.25).tolist(), i % 2) for i in range(300)]
    vectors += [(300 + i, vectors[0][1], 0) for i in range(40)]
    vectors += [(400, None, 1), (401, [0.0] * 6, 1), (402, [float("nan")] * 6, 1), (403, [None] * 6, 1), (404, vectors[1][1], None)]
    vectors += [(405, [], 1), (406, [1.0, 0.0], 1), (407, [2.0, 0.0], 1), (408, [1e300] * 6, 1), (409, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 0), (410, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame([(*v, "c", 1) for v in vectors], "vec_id long, embedding array<double>, label int, dim string, links int")
    got = gridjoin.near_vectors(df.repartition(4), block=block, sample=64)
    assert sorted(rows(got)) == _near(vectors, 0.93)
    assert rows(gridjoin.near_vectors(df.limit(0))) == []


@pytest.mark.parametrize("dims", [1, 2, 6])
def test_op6_principal_dimensions(spark, dims):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 5))
    vectors = [(i, (centres[i % 9] + rng.normal(size=5) * 0.25).tolist(), i % 2) for i in range(150)] + [(200, [1.0, 0.1], 1), (201, [1.0, 0.0], 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    assert sorted(rows(gridjoin.near_vectors(df, dims=dims, block=16))) == _near(vectors, 0.93)


# operator 7
def test_op7_targets(spark):
    sizes = [("a", 100, 1), ("b", 1000, 1), ("c", 1000, 1), ("d", 0, 1), (None, 900, 1)]
    df = spark.createDataFrame(sizes, "source string, source_size long, units long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    # weights a 5, b 2, c 1, d 5, null 2: a and d stop at 300 and 0, the rest share 2700 by 2, 1, 2
    assert got == pytest.approx({"a": 300, "b": 1080, "c": 540, "d": 0, None: 1080})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.floats(0.05, 0.95), st.integers(0, 99))
def test_op7_flight_keeps_totals(sizes, prob, seed):
    x, p = np.array(sizes), np.full(len(sizes), prob)
    out = mixing.flight(x, p, seed, land=False)
    assert ((out >= 0) & (out <= 1)).all() and ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-5)
    assert (out * x).sum() == pytest.approx((p * x).sum(), abs=1e-4)
    assert set(mixing.flight(x, p, seed, land=True)) <= {0.0, 1.0}


def test_op7_mix(spark, sf_dir, awkward, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = mixing.mix(docs, block=16).toPandas()
    b = mixing.mix(docs.repartition(7), block=16).toPandas()
    key = ["doc_id"]
    pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True))
    by = a.groupby("source").agg(t=("target", "first"), k=("taken", "sum"), m=("size", "max"))
    assert ((by.k - by.t).abs() <= by.m).all()
    assert (a.taken <= 3 * a["size"]).all() and abs(by.t.sum() - a["size"].sum()) < 1e-3
    got = mixing.mix(awkward).collect()
    assert len(got) == len(AWKWARD) and {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert rows(mixing.mix(empty)) == []


def test_op7_copies_by_definition(spark, sf_dir, awkward):
    """Targets by plain loops; each document floor(r) or floor(r) + 1 times; totals of a source near r times its own."""
    for table in (spark.read.parquet(f"{sf_dir}/documents.parquet"), awkward):
        docs = [(r.source, len(re.findall("[^\x20\x09-\x0D]+", r.text or ""))) for r in table.collect()]
        names = sorted({n for n, _ in docs if n is not None}) + ([None] if any(n is None for n, _ in docs) else [])
        own = {n: sum(k for m, k in docs if m == n) for n in names}
        weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
        goal, full = {}, set()
        while True:
            left, over = sum(own.values()) - sum(3 * own[n] for n in full), sum(weight[n] for n in names if n not in full)
            goal = {n: 3 * own[n] if n in full else left * weight[n] / over for n in names}
            more = {n for n in names if goal[n] > 3 * own[n] + 1e-9} - full
            if not more:
                break
            full |= more
        got = mixing.mix(table).collect()
        assert {r.source: r.target for r in got} == pytest.approx(goal)
        for n in names:
            mine = [r for r in got if r.source == n]
            ratio = goal[n] / own[n] if own[n] else 0
            if own[n]:
                assert {r.copies for r in mine if r.size} <= {math.floor(ratio + 1e-9), math.floor(ratio + 1e-9) + 1}
                assert all(r.taken == r.copies * r.size and r.copies <= 3 for r in mine)
                assert abs(sum(r.taken for r in mine) - goal[n]) <= max(r.size for r in mine)
                assert abs(sum(r.copies for r in mine) - ratio * len(mine)) <= 18  # landing and turned units


# operator 8
def test_op8_languages(spark, sf_dir, awkward, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    want = got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)
    assert (got.held_out == want).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()
    out = {r.doc_id: r for r in langid.identify(awkward).collect()}
    assert {out[i].lang_pred for i in (1, 2, 3, 6)} == {"und"} and out[1].score == 0 and out[None].held_out is False
    assert rows(langid.identify(empty)) == []
    blind = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(blind).collect()} == {"und"}


def test_op8_against_plain_python(spark):
    rng = np.random.default_rng(9)
    words = {"a": ["hut", "hat", "Xé", "mm"], "b": ["rot", "hut", "ßu", "kk"], "c": ["zi"]}
    docs = [(i, " ".join(rng.choice(words[x], 6)) + rng.choice([" zzhat!", " 12", " qq"]), x) for i in range(60) for x in [rng.choice(list("abbac"))]]
    docs += [(99, None, "a"), (98, "12", "b"), (97, "hut", None)]
    train = [(t or "", x) for d, t, x in docs if x and zlib.crc32(str(d).encode()) % 3 != 1]
    langs = sorted({x for _, x in train})
    split = lambda t: [w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()]
    units = [{x: Counter() for x in langs} for _ in range(langid.LONGEST + 1)]
    for t, x in train:
        for w in split(t):
            units[0][x][w] += 1
            for n in range(1, langid.LONGEST + 1):
                units[n][x].update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))

    def rate(kind, unit):
        known = {u for c in units[kind].values() for u in c}
        if unit in known:
            return [math.log((units[kind][x][unit] + 0.5) / (units[kind][x].total() + 0.5 * (len(known) + 1))) for x in langs]

    def word(w):
        if got := rate(0, w):
            return got
        for n in range(langid.LONGEST, 0, -1):
            if got := [r for i in range(len(w) + 3 - n) if (r := rate(n, f" {w} "[i : i + n]))]:
                return [sum(c) / len(got) for c in zip(*got)]
        return [0.0] * len(langs)

    for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect():
        ws = split({d: t for d, t, _ in docs}[r.doc_id])
        if not ws:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        mean = [sum(c) / len(ws) * min(len(ws), langid.EVIDENCE) for c in zip(*map(word, ws))]
        p = [math.exp(m - max(mean)) for m in mean]
        assert r.lang_pred == langs[p.index(max(p))] and r.score == pytest.approx(max(p) / sum(p), rel=1e-4)


def test_op8_learns_from_rows_of_one_id(spark):
    en = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.expr("concat('the house number ', id, ' stands by the sea')").alias("text"), F.lit("en").alias("lang"))
    de = spark.range(600).select((F.col("id") + 100).alias("doc_id"), F.expr("concat('das Haus Nummer ', id, ' steht am Meer')").alias("text"), F.lit("de").alias("lang"))
    for i in (7, 8, 9, 12):
        both = en.withColumn("doc_id", F.lit(i).cast("long")).union(de)
        got = {(r.lang, r.lang_pred) for r in langid.with_language(both, langid.fit(both, 100)).select("lang", "lang_pred").distinct().collect()}
        assert got == {("en", "en"), ("de", "de")}, i


def test_op8_backoff():
    m = langid.Model.of(["a", "b"], [{"hut": np.array([9, 1])}, {"x": np.array([0, 5])}, {}, {"hat": np.array([4, 0])}, {}])
    assert m.word("hut") == [0] and m.word("hats") == [2] and m.word("xq") == [1] and m.word("qqq") == []
    langs, score = langid.Scorer(m).predict(["hut", "xx", None, "qqq 12", "HUT,hut"])
    assert langs == ["a", "b", "und", "a", "a"] and score[2] == 0 and score[3] == 0.5


# operator 9
def _check_packing(got, docs, capacity=2048):
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    want = Counter()
    for d, t in docs:
        ids = _ids(t, "word_bpe_49k.json")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[d, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    return len(at)


def test_op9_packing(spark, sf_dir, awkward, empty):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op9_best_fit"](spark, sf_dir).collect()
    assert _check_packing(got, docs) <= math.ceil(sum(r.length for r in got) / 2048) + 2
    _check_packing(packing.pack_documents(awkward).collect(), [r[:2] for r in AWKWARD])
    assert rows(packing.pack_documents(empty)) == []


def test_op9_rounds_merge_groups(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 700, 3000).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    got = packing.pack(items, 2048, group_items=100).collect()
    assert len({r.bin for r in got}) <= math.ceil(sum(sizes) / 2048) * 1.02 + 1
    room = Counter()
    for r in got:
        room[r.bin] += sizes[r.item]
    assert max(room.values()) <= 2048
    assert len(packing.pack(items.withColumn("size", F.lit(1500)), 2048, group_items=100).select("bin").distinct().collect()) == 3000


# operator 10
def _plain_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _classes(docs):
    fps = [(d, _plain_fp(t)) for d, t in docs]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(fps)), key=str)


def test_op10_classes(spark, sf_dir, awkward, empty):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(rows(QUERIES["op10_simhash"](spark, sf_dir)), key=str) == _classes(docs)
    assert sorted(rows(simhash.near_duplicates(awkward)), key=str) == _classes([r[:2] for r in AWKWARD])
    assert rows(simhash.near_duplicates(empty)) == []
    odd = ["A B\x0bC\x0cD", "a b\x85c d", "É é x", "a", "A b"]
    assert [simhash.fingerprint(t) for t in odd] == [_plain_fp(t) for t in odd]


@pytest.mark.parametrize("dense", [False, True])
def test_op10_tree_finds_all(spark, dense):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 3 if dense else 900, dtype=np.uint64)
    near = [b ^ np.uint64(sum({1 << int(k) for k in rng.integers(0, 64 if not dense else 12, 2)})) for b in base for _ in range(900 if dense else 3)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    want = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3) if i < j]

    def groups(pairs):
        parent = list(range(len(fps)))
        for a, b in pairs:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        out = []
        for i in range(len(fps)):
            while parent[i] != i:
                i = parent[i]
            out.append(i)
        return out

    at = {int(x): i for i, x in enumerate(fps)}
    old, simhash.LEAF = simhash.LEAF, 64
    try:
        a, b = simhash.near_pairs(fps)
    finally:
        simhash.LEAF = old
    assert groups([(at[int(x)], at[int(y)]) for x, y in zip(a, b)]) == groups(want)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = [(at[r.a % (1 << 64)], at[r.b % (1 << 64)]) for r in simhash.link_fingerprints(df, shard=200).collect()]
    assert groups(links) == groups(want)
    if dense:  # close fingerprints overfill shards, which are divided
        dealt = simhash.divided(simhash.shards(df, shard=10), 10)
        assert dealt.where("b > 0").count() > 0
        links = [(at[r.a % (1 << 64)], at[r.b % (1 << 64)]) for r in simhash.link_fingerprints(df, shard=10).collect()]
        assert groups(links) == groups(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 60), (60, 100), (7, 7), (200, 200), (None, 3), (300, 299), (299, 298)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {i: 0 for i in range(51)} | {60: 60, 100: 60, 200: 200, 298: 298, 299: 298, 300: 298}
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"))) == []


# pipeline
def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, texts = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, now, sf_dir)
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        before = [r.doc_id for r in now.select("doc_id").collect()]
        assert set(ids) <= set(before) and ids
        if name == "near_dedup":
            first = {c: d for d, _, c in _classes([(d, texts[d]) for d in before])}
            assert sorted(ids) == sorted(first)
        now = spark.createDataFrame(out.collect(), docs.schema)
    final = p.run(spark, sf_dir).collect()
    _check_packing(final, [(r.doc_id, r.text) for r in now.collect()])


def test_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as p

    names = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int, lang_pred string, _id long, row long, rest string, uid int, copies long, `copy of row` int"
    rng = np.random.default_rng(10)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80)]
    say = lambda: " ".join(rng.choice(words, 40))
    table = [(i, say(), "en", f"s{i % 3}") for i in range(60)] + [*AWKWARD, AWKWARD[0], AWKWARD[-1]]
    same = say()
    table += [(None, say(), "en", None) for _ in range(8)] + [(None, same, "en", None)] * 3 + [(70, say(), "en", "s1") for _ in range(6)] + [(71, same, None, "s2")] * 3
    full = [(*r, k, "x", 1, "mine", 5, 6, "y", 7, 8, 9) for k, r in enumerate(table)]
    docs = spark.createDataFrame(full, names).repartition(5)
    spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    bag = lambda df: Counter(map(tuple, df.collect()))
    whole = Counter(full)
    for name, stage in p.STAGES:
        got = stage(spark, docs, str(tmp_path))
        none = stage(spark, docs.limit(0), str(tmp_path)).collect()
        assert none == []
        if name == "packing":
            _check_packing(got.collect(), [r[:2] for r in full])
            continue
        assert got.columns == docs.columns
        out = bag(got)
        assert set(out) <= set(whole) and sum(out.values()) > 40
        if name in ("quality", "language"):
            assert all(out[r] in (0, whole[r]) for r in whole)
            letters = lambda t: any(c.isalpha() for c in t or "")
            assert not any((not (r[1] or "").strip()) if name == "quality" else not letters(r[1]) for r in out)
            assert all(out[r] for r in full[:60])
        if name == "near_dedup":
            first = {}
            for k, (_, _, c) in enumerate(_by_row([r[1] for r in full])):
                d = full[k][0]
                first.setdefault(c, []).append((d is None, d if d is not None else 0, k))
            assert sorted(str(min(v)[:2]) for v in first.values()) == sorted(str((r[0] is None, r[0] or 0)) for r in out.elements())
            assert all(n == 1 for n in out.values())
        if name == "mixing":
            assert all(n <= 3 * whole[r] for r, n in out.items())
            taken, size = Counter(), Counter()
            for r in out.elements():
                taken[r[3]] += len((r[1] or "").split())
            for r in full:
                size[r[3]] += len((r[1] or "").split())
            want = {r.source: (r.target, r.m) for r in mixing.mix(docs).groupBy("source").agg(F.max("target").alias("target"), F.max("size").alias("m")).collect()}
            assert all(abs(taken[s] - t) <= m for s, (t, m) in want.items())


def _by_row(texts):
    """Row number, fingerprint and class of each text."""
    return sorted(_classes(list(enumerate(texts))), key=lambda r: r[0])


def test_registry(spark):
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 13
    assert shared_dir(spark) == shared_dir(spark)
