"""Operator 3: quality classifier, an interpolated modified Kneser-Ney n-gram model.

The model's symbols are characters; a text is one sequence, its runs of white space
taken as one space, with a begin and an end mark, so n-grams run across tokens. Counts
of the trusted texts are aggregated by n-gram. The n-grams that any document asks for
are joined, shard by shard, with those counts and with the counts of their contexts;
the joined chain of orders gives a probability an n-gram. A document's perplexity is
that of all its n-grams. What n-grams of five symbols can't see, the same words over and
over, is measured within the document (`repeats`). It is rejected if either is above its
language's limit, which is taken from quantiles of trusted texts that were held out of
the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, as_arrow, tuned

#: Order; the limit is quantile HIGH plus MARGIN times its distance from quantile MID,
#: LEAST at least, in nats a symbol. One trusted document in HOLD sets limits only.
ORDER, MID, HIGH, MARGIN, LEAST, HOLD = 5, 0.5, 0.99, 0.5, 0.05, 4
#: Short texts vary: a text of n symbols is allowed SHORT / sqrt(n) more.
SHORT = 2.0
#: Largest probability table and list of trusted ids that is sent to every executor; beyond it they are joined.
SEND_ROWS = 1_500_000
#: Beyond it, documents and bytes of text that one block of documents has at most, about.
BLOCK_DOCS, BLOCK_BYTES = 5000, 64 << 20
#: Repeats: the limit is REPEAT_MARGIN times quantile HIGH, REPEAT_LEAST at least; a text counts as REPEAT_MORE tokens longer.
REPEAT_MARGIN, REPEAT_LEAST, REPEAT_MORE = 2.5, 0.01, 20
#: Symbols whose n-grams are numbered at once; longer texts go on in the next piece.
PIECE = 1 << 20
#: Numbers of n-grams that a task holds before it sums them; half as many distinct ones are put out.
MOST_HELD = 2_000_000
#: Quantiles are exact over values rounded to this.
GRAIN = 1e-5
BOS, EOS = "\x02", "\x03"
_GRAMS = pa.schema([("gram", pa.string()), ("trusted", pa.int64())])


def events(token: str, order: int = ORDER) -> list[str]:
    """Each symbol of a token with its history; shorter ones start at the begin mark."""
    s = BOS + token + EOS
    return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]


def grams_of(words: list[str], order: int = ORDER) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct n-grams of `words`, and per symbol which of them it ends and whose
    word it is. What `events` gives, for many words at once."""
    return _numbered([BOS + w + EOS for w in words], np.ones(len(words), np.int64), order)


def _laid(pieces: list[str], skip: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces in one text: that, its code points, each one's place in its piece, the
    places after each piece's first `skip` symbols, and whose piece these are of."""
    text = "".join(pieces)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    place = _places(sizes)
    at = np.flatnonzero(place >= np.repeat(skip, sizes))
    return text, points, place, at, owner[at]


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _keys(symbols: np.ndarray, at: np.ndarray, place: np.ndarray, bits: int, order: int) -> np.ndarray:
    """The n-gram that ends at each of `at` as one number; the last symbol is its lowest `bits`."""
    key = symbols.copy()
    for j in range(1, order):
        key[j:] |= np.where(place[j:] >= j, symbols[:-j] << (bits * j), 0)
    return key[at]


def _strings(text: str, at: np.ndarray, place: np.ndarray, order: int) -> Iterator[str]:
    """The n-gram that ends at each of `at`."""
    return (text[i - h : i + 1] for i, h in zip(at.tolist(), np.minimum(place[at], order - 1).tolist(), strict=True))


def _coded(points: np.ndarray) -> tuple[np.ndarray, int]:
    """A number from 1 for each kind of symbol, by code point, and the bits of the largest."""
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    kinds = np.flatnonzero(seen)
    code = np.zeros(len(seen), np.int64)
    code[kinds] = np.arange(1, len(kinds) + 1)
    return code, int(len(kinds)).bit_length()


def _numbered(pieces: list[str], skip: np.ndarray, order: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The n-grams that end in each piece after its first `skip` symbols."""
    text, points, place, at, owner = _laid(pieces, skip)
    code, bits = _coded(points)
    if bits * order > 63:  # too many kinds of symbols for one number
        names: dict[str, int] = {}
        which = [names.setdefault(g, len(names)) for g in _strings(text, at, place, order)]
        return list(names), np.array(which, np.int64), owner
    coded = pa.array(_keys(code[points], at, place, bits, order)).dictionary_encode()
    which = coded.indices.to_numpy()
    first = np.zeros(len(coded.dictionary), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return list(_strings(text, at[first], place, order)), which, owner


class Counts:
    """Sums of n-grams over many texts, by their numbers; strings are made of the distinct
    ones alone. A symbol keeps its number until `taken`."""

    def __init__(self, order: int = ORDER):
        self.order, self.bits = order, 62 // order
        self._empty()

    def _empty(self) -> None:
        self.code, self.kinds = np.zeros(0x110000, np.int64), np.zeros(1, np.int64)
        self.keys: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.held = 0

    def add(self, texts: list[str], good: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count texts; n-grams of those that are `good` as often as they stand. What has
        to be put out before more can be held."""
        for pieces, skip, of in turns_of(texts, self.order):
            text, points, place, at, owner = _laid(pieces, skip)
            kinds = np.flatnonzero(np.bincount(points))
            if self.held and len(self.kinds) + int((self.code[kinds] == 0).sum()) > 1 << self.bits:
                yield self.taken()
            new = kinds[self.code[kinds] == 0]
            if len(self.kinds) + len(new) > 1 << self.bits:  # too many kinds of symbols for one number
                names, which, owner = _numbered(pieces, skip, self.order)
                sums = np.bincount(which[good[of[owner]]], minlength=len(names))
                yield as_arrow({"gram": names, "trusted": sums.tolist()}, _GRAMS)
                continue
            self.code[new] = len(self.kinds) + np.arange(len(new))
            self.kinds = np.concatenate([self.kinds, new])
            keys = _keys(self.code[points], at, place, self.bits, self.order)
            keys = np.sort((keys << 1) | good[of[owner]])
            self._keep(*_summed(keys >> 1, keys & 1))
            if self.held > MOST_HELD:
                order = np.argsort(keys := np.concatenate(self.keys), kind="stable")
                sums = np.concatenate(self.sums)[order]
                self.keys, self.sums, self.held = [], [], 0
                self._keep(*_summed(keys[order], sums))
                if self.held > MOST_HELD // 2:
                    yield self.taken()

    def _keep(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.keys.append(keys)
        self.sums.append(sums)
        self.held += len(keys)

    def taken(self) -> pa.RecordBatch:
        """(gram, trusted) of what was counted, each n-gram once; nothing is held then."""
        if not self.held:
            return as_arrow({"gram": [], "trusted": []}, _GRAMS)
        order = np.argsort(keys := np.concatenate(self.keys), kind="stable")
        keys, sums = _summed(keys[order], np.concatenate(self.sums)[order])
        codes = np.stack([(keys >> (self.bits * j)) & ((1 << self.bits) - 1) for j in range(self.order - 1, -1, -1)], axis=1)
        points, there = self.kinds[codes], codes > 0
        size = there.astype(np.int32) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        ends = np.concatenate([[0], np.cumsum(size.sum(1))]).astype(np.int32)
        data = points[there].astype("<u4").tobytes().decode("utf-32-le").encode()
        grams = pa.StringArray.from_buffers(len(keys), pa.py_buffer(ends), pa.py_buffer(data))
        self._empty()
        return pa.RecordBatch.from_arrays([grams, pa.array(sums)], schema=_GRAMS)


def _summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of sorted `keys`, and their sums."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(sums, first) if len(first) else sums


class Scores:
    """Log-probabilities of n-grams, looked up many at a time in an open table of their
    numbers; by their strings where symbols are too many for one number."""

    def __init__(self, grams: list[str], logp: np.ndarray, order: int = ORDER):
        points = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4")
        self.order, (self.code, self.bits) = order, _coded(points)
        self.named = dict(zip(grams, logp.tolist())) if self.bits * order > 63 else None
        if self.named is not None:
            return
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        ends = np.cumsum(sizes) - 1
        keys = _keys(self.code[points], ends, _places(sizes), self.bits, order) if len(grams) else np.zeros(0, np.int64)
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.keys, self.logp = np.zeros(1 << (64 - int(self.shift)), np.int64), np.zeros(1 << (64 - int(self.shift)), np.float64)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slot] == 0  # no n-gram has the number 0
            self.keys[slot[free]] = keys[left[free]]
            own = self.keys[slot] == keys[left]
            self.logp[slot[own]] = logp[left[own]]
            left, slot = left[~own], (slot[~own] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, pieces: list[str], skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each symbol after its piece's first `skip`, and its piece."""
        text, points, place, at, owner = _laid(pieces, skip)
        if self.named is not None:
            return np.array([self.named[g] for g in _strings(text, at, place, self.order)], np.float64), owner
        keys = _keys(self.code[points], at, place, self.bits, self.order)
        slot = self._slots(keys)
        miss = np.flatnonzero(self.keys[slot] != keys)
        while len(miss):
            if not self.keys[slot[miss]].all():
                raise KeyError("an n-gram that was not counted")
            slot[miss] = (slot[miss] + 1) & (len(self.keys) - 1)
            miss = miss[self.keys[slot[miss]] != keys[miss]]
        return self.logp[slot], owner


def turns_of(texts: list[str], order: int = ORDER, piece: int = PIECE) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts with their marks in turns of about `piece` symbols: pieces, how many symbols
    of each are history only, and the text of each. A longer text is taken in pieces that
    each begin with the history of their first symbol, so none of its n-grams is lost or
    counted twice."""
    pieces, skip, owner, size = [], [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        s = BOS + text + EOS
        for start in range(1, len(s), piece):
            back = min(start, order - 1)
            pieces.append(s[start - back : start + piece])
            skip.append(back)
            owner.append(i)
            size += len(pieces[-1])
            if size >= piece:
                yield pieces, np.array(skip, np.int64), np.array(owner, np.int64)
                pieces, skip, owner, size = [], [], [], 0
    if pieces:
        yield pieces, np.array(skip, np.int64), np.array(owner, np.int64)


def grams_of_texts(texts: list[str], order: int = ORDER, piece: int = PIECE) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """As grams_of, for texts and in turns of about `piece` symbols."""
    for pieces, skip, owner in turns_of(texts, order, piece):
        names, which, at = _numbered(pieces, skip, order)
        yield names, which, owner[at]


def plain(texts: pa.Array) -> list[str]:
    """Texts with one space between tokens; null is empty."""
    return [" ".join(t.split()) if t else "" for t in texts.to_pylist()]


def repeats(texts: pa.Array) -> np.ndarray:
    """How much a text repeats itself: each pair of neighbouring tokens that came before
    counts one over its distance from the last time, and the sum is divided by the
    tokens. Near 1 for one word over and over, 1 / n for a phrase of n words; it does not
    grow with the length of ordinary text, whose repeats lie far apart."""
    words, which, doc = split_words(texts)
    n = len(texts)
    sizes = np.bincount(doc, minlength=n)
    if len(which) < 3:
        return np.zeros(n)
    at = np.flatnonzero(doc[1:] == doc[:-1])
    pair = which[at].astype(np.int64) * len(words) + which[at + 1]
    order = np.lexsort((pair, doc[at]))  # stable: positions rise within a pair
    pair, own, at = pair[order], doc[at][order], at[order]
    again = np.flatnonzero((pair[1:] == pair[:-1]) & (own[1:] == own[:-1])) + 1
    return np.bincount(own[again], weights=1 / (at[again] - at[again - 1]), minlength=n) / (sizes + REPEAT_MORE)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of texts; per token of each text which it is, and its text."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    words, which = coded.dictionary, coded.indices.to_numpy()
    if (empty := pc.index(words, "").as_py()) >= 0:  # what white space at an end leaves
        on = which != empty
        which, doc = which[on], doc[on]
    return words, which, doc


def gather(docs: DataFrame, trusted: str, order: int = ORDER) -> DataFrame:
    """(gram, c): n-grams of all documents, and their counts in trusted ones.
    Tasks count first; a document's text never moves."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(order)
        for b in it:
            yield from counts.add(plain(b.column(0)), b.column(1).to_numpy(zero_copy_only=False))
        yield counts.taken()

    return (
        docs.select("text", F.col(trusted))
        .mapInArrow(count, "gram string, trusted long")
        .groupBy("gram")
        .agg(F.sum("trusted").alias("c"))
    )


def probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp) of every n-gram in `grams` (gram, c); c is its trusted count.

    Lower orders use continuation counts, n-grams that start at the begin mark their
    counts. Discounts come from counts of counts of each order (a few numbers). Each
    distinct n-gram and suffix is joined once, and takes its suffix's probability from
    the order below; a context or a suffix is shared by no more n-grams than there are
    symbols. An empty model gives the uniform distribution over one symbol: logp 0.
    """
    size, tail, head = F.length("gram"), F.expr("substring(gram, 2)"), F.expr("left(gram, length(gram) - 1)")
    top = Table(grams.where("c > 0").select("gram", "c"), "counts").df
    levels = [top.where(size == order)]
    for k in range(order - 1, 0, -1):
        above = levels[-1]
        lower = above.groupBy(tail.alias("gram")).agg(F.count("*").alias("c"))
        begun = top.where((size == k) & F.col("gram").startswith(BOS))
        levels.append(Table(lower.union(begun), "level").df)
    counts = levels[0]
    for x in levels[1:]:
        counts = counts.union(x)
    counts = Table(counts, "model").df
    seen = {
        (r["k"], r["c"]): r["n"]
        for r in counts.where("c <= 4").groupBy(size.alias("k"), "c").agg(F.count("*").alias("n")).collect()
    }
    cut = {}
    for k in range(1, order + 1):
        n1, n2, n3, n4 = (seen.get((k, i), 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 1.0]
        cut[k] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]
    by = F.create_map(*(x for k, d in cut.items() for x in (F.lit(k), F.array(*map(F.lit, d)))))
    discount = F.element_at(by[size], F.least(F.col("c"), F.lit(3)).cast("int"))
    held = Table(counts.withColumn("d", discount), "model").df
    contexts = held.groupBy(head.alias("context")).agg(F.sum("c").alias("total"), F.sum("d").alias("free"))
    symbols = counts.where(size == 1).count() + 1
    parts = grams.select(
        size.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: F.col("gram").substr(i, size))).alias("part")
    )
    parts = parts.groupBy("part").agg(F.max(F.length("part") == F.col("n")).alias("asked"))
    joined = (
        parts.withColumn("context", F.expr("left(part, length(part) - 1)"))
        .join(held.select(F.col("gram").alias("part"), "c", "d"), "part", "left")
        .join(contexts, "context", "left")
    )
    own = F.coalesce((F.col("c") - F.col("d")) / F.col("total"), F.lit(0.0))
    rest = F.coalesce(F.col("free") / F.col("total"), F.lit(1.0))
    links = Table(joined.select(F.length("part").alias("k"), "part", "asked", own.alias("own"), rest.alias("rest")), "links").df
    level = links.where("k = 1").withColumn("lower", F.lit(1.0 / symbols))
    found: list[DataFrame] = []
    for k in range(1, order + 1):
        if found:
            below = found[-1].select(F.col("part").alias("tail"), F.col("p").alias("lower"))
            level = links.where(F.col("k") == k).withColumn("tail", F.expr("substring(part, 2)")).join(below, "tail")
        p = F.col("own") + F.col("rest") * F.col("lower")
        found.append(Table(level.select("part", "asked", p.alias("p")), "level").df)
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    return every.where("asked").select(F.col("part").alias("gram"), F.log("p").alias("logp"))


def score_texts(table: Scores, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability, number of symbols and repeats of each text."""
    n = len(texts)
    total, size = np.zeros(n), np.zeros(n, np.int64)
    for pieces, skip, owner in turns_of(plain(texts), table.order, PIECE // 2):
        logp, at = table.of(pieces, skip)
        total += np.bincount(owner[at], weights=logp, minlength=n)
        size += np.bincount(owner[at], minlength=n)
    return total, size, repeats(texts)


def score(docs: DataFrame, table: DataFrame, rows: int, order: int = ORDER, send_rows: int = SEND_ROWS) -> DataFrame:
    """All columns of `docs` with _logp, _symbols and _repeats.

    A table of at most `send_rows` rows goes to every executor. A larger one is cut by
    blocks of documents: texts are dealt by block, a block asks for each of its n-grams
    once, however many blocks there are, and what the table has of them meets its texts
    in one group."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    out = T.StructType([*docs.schema, T.StructField("_logp", T.DoubleType()), T.StructField("_symbols", T.LongType()), T.StructField("_repeats", T.DoubleType())])
    if rows <= send_rows:
        got = table.toArrow()
        sent = spark.sparkContext.broadcast(Scores(got["gram"].to_pylist(), got["logp"].to_numpy(), order))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                made = [pa.array(x) for x in score_texts(sent.value, b.column(at))]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "_logp", "_symbols", "_repeats"])

        return docs.mapInArrow(run, out)
    size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // BLOCK_DOCS), -(-size[1] // BLOCK_BYTES))
    dealt = docs.withColumn("_block", F.pmod(F.xxhash64("text", *(c for c in docs.columns if c == "doc_id")), F.lit(blocks)))

    def ask(d: pa.Table) -> pa.Table:
        counts, none = Counts(order), pa.table({"gram": pa.array([], pa.string())})
        found = [b.select(["gram"]) for x in d["text"].chunks for b in counts.add(plain(x), np.zeros(len(x), bool))]
        asked = pa.Table.from_batches([*found, counts.taken().select(["gram"])])
        asked = asked.group_by("gram", use_threads=False).aggregate([]) if found else asked  # what had to be put out early may come again
        return pa.concat_tables([none, asked]).append_column("_block", pa.array(np.full(len(asked), d["_block"][0].as_py(), np.int64)))

    needed = dealt.select("_block", "text").groupBy("_block").applyInArrow(ask, "gram string, _block long").join(table, "gram")

    def meet(d: pa.Table, t: pa.Table) -> pa.Table:
        grams = Scores(t["gram"].to_pylist(), t["logp"].to_numpy(), order)
        made = [score_texts(grams, x) for x in d["text"].chunks]
        for name, parts in zip(("_logp", "_symbols", "_repeats"), zip(*made) if made else [[]] * 3, strict=True):
            d = d.append_column(name, pa.chunked_array([pa.array(x) for x in parts], out_types[name]))
        return d.drop_columns(["_block"])

    out_types = {"_logp": pa.float64(), "_symbols": pa.int64(), "_repeats": pa.float64()}
    return dealt.groupBy("_block").cogroup(needed.groupBy("_block")).applyInArrow(meet, out)


def with_trust(docs: DataFrame, trusted_ids: DataFrame, send_rows: int = SEND_ROWS) -> DataFrame:
    """`docs` with _trusted and _calibrate: whether doc_id is among `trusted_ids`, and
    for which of two uses; equal ids share it. At most `send_rows`
    ids are broadcast; more are joined by shuffling."""
    ids = trusted_ids.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id")).distinct()
    ids = Table(ids.withColumn("_trusted", F.lit(True)), "trusted").df
    side = F.broadcast(ids) if ids.count() <= send_rows else ids
    joined = docs.join(side, docs["doc_id"].cast("long") == F.col("_id"), "left")
    trusted = F.coalesce("_trusted", F.lit(False))
    held = F.pmod(F.xxhash64("_id"), F.lit(HOLD)) == 0
    return joined.select(
        *(docs[c] for c in docs.columns), (trusted & ~held).alias("_trusted"), (trusted & held).alias("_calibrate")
    )


def quantiles(rows: DataFrame, value: Column, at: dict[str, float], by: str = "lang") -> DataFrame:
    """(by, one column a quantile): of all rows, by their values rounded to GRAIN.

    Rounded values are counted first, so a group of any size is a bounded number of
    rows, and the result doesn't depend on how rows are dealt."""
    counts = rows.where(value.isNotNull()).groupBy(by, F.round(value / GRAIN).cast("long").alias("v")).agg(F.count("*").alias("n"))
    run, all_ = F.sum("n").over(W.partitionBy(by).orderBy("v")), F.sum("n").over(W.partitionBy(by))
    placed = counts.select(by, "v", run.alias("run"), all_.alias("all"))
    return placed.groupBy(by).agg(*(F.min(F.when(F.col("run") >= F.col("all") * q, F.col("v") * GRAIN)).alias(name) for name, q in at.items()))


def limits(scored: DataFrame, mid: float = MID, high: float = HIGH, margin: float = MARGIN, short: float = SHORT) -> DataFrame:
    """(lang, limit, most) from the held-out trusted rows of `scored` (lang, _calibrate,
    _logp, _symbols, _repeats), limits of loss and repeats; the row of null lang has those
    of languages without such text."""
    loss = -F.col("_logp") / F.greatest("_symbols", F.lit(1)) - F.lit(short) / F.sqrt(F.greatest("_symbols", F.lit(1)))
    good = scored.where("_calibrate and _symbols > 0").select(F.coalesce("lang", F.lit("")).alias("lang"), loss.alias("loss"), "_repeats")
    good = good.withColumn("lang", F.explode(F.array(F.col("lang"), F.lit(None).cast("string"))))
    q = quantiles(good, F.col("loss"), {"mid": mid, "high": high})
    r = quantiles(good, F.col("_repeats"), {"r": high})
    limit = F.col("high") + F.greatest(F.lit(LEAST), margin * (F.col("high") - F.col("mid")))
    most = F.greatest(F.lit(REPEAT_LEAST), REPEAT_MARGIN * F.col("r"))
    return q.join(r.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l"))).select("lang", limit.alias("limit"), most.alias("most"))


def classify(
    docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, margin: float = MARGIN, send_rows: int = SEND_ROWS, keep_text: bool = False
) -> DataFrame:
    """doc_id, lang, perplexity, limit (a perplexity) and kept; with `keep_text` all
    columns of `docs` and kept. Kept are texts within the limit of perplexity and within
    that of repeats, which has no column.

    Trusted are rows whose doc_id is in `trusted_ids`. Null, empty and blank texts have
    nothing to judge: perplexity null, kept false. Documents with no language, or one
    without trusted text, are held to the limit of that null language or of all trusted
    text. Without any trusted text nothing can be judged and every text is kept.
    Repeated rows are judged each. Empty input: no rows. With `keep_text`, `docs` must
    have no column named kept or beginning with _; else other columns are not read.
    """
    tuned(docs.sparkSession)
    if keep_text and (taken := [c for c in docs.columns if c == "kept" or c.startswith("_")]):
        raise ValueError(f"columns {taken} clash with this operator's own")
    base = with_trust(docs if keep_text else docs.select("doc_id", "text", "lang"), trusted_ids, send_rows)
    grams = Table(gather(base, "_trusted", order), "grams").df
    table = Table(probabilities(grams, order), "table").df
    rows = table.count()
    scored = score(base.drop("_trusted"), table, rows, order, send_rows)
    scored = Table(scored if keep_text else scored.drop("text"), "scores").df
    bounds = Table(limits(scored, margin=margin), "limits").df
    named, rest = bounds.where("lang is not null"), bounds.where("lang is null").select(F.col("limit").alias("_rest"), "most")
    rest_limit, rest_most = rest.first() or [None, None]
    judged = (
        scored.withColumn("_lang", F.coalesce("lang", F.lit("")))
        .join(named.select(F.col("lang").alias("_lang"), F.col("limit").alias("_own"), F.col("most").alias("_most")), "_lang", "left")
        .withColumn("_limit", F.coalesce("_own", F.lit(rest_limit)) + F.lit(SHORT) / F.sqrt(F.greatest("_symbols", F.lit(1))))
        .withColumn("_loss", F.when(F.col("_symbols") > 0, -F.col("_logp") / F.greatest("_symbols", F.lit(1))))
    )
    usual = F.col("_repeats") <= F.coalesce("_most", F.lit(rest_most), F.lit(math.inf))
    kept = F.coalesce((F.col("_loss") <= F.coalesce("_limit", F.lit(math.inf))) & usual, F.lit(False)).alias("kept")
    if keep_text:
        return judged.select(*docs.columns, kept)
    return judged.select("doc_id", "lang", F.exp("_loss").alias("perplexity"), F.exp("_limit").alias("limit"), kept)
