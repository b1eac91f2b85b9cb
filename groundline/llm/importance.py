"""Operator 12: importance resampling toward a target, over hashed word n-grams.

A partition's texts become word ids, block by block. A suffix array over a block's ids,
sorted to the depth of the longest n-gram, puts equal n-grams side by side; its LCP
values bound their runs. Each run's text is hashed once, and the bucket goes back to all
its occurrences. Buckets are kept as they are found, so texts are read once: counting
and scoring read buckets.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, as_arrow, tuned

BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 1, 20, 10, 2024
# Letters A-Z become small; what is neither digit, letter nor beyond ASCII becomes a gap.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of `ids` in order of the `depth` ids that begin there, ranks doubling; what
    is beyond the end counts as least."""
    rank, span = ids.astype(np.int64), 1
    while True:
        order = np.argsort(rank, kind="stable")
        if span >= depth or not len(ids):
            return order
        # a longer span than asked for would part equal n-grams, so the last step overlaps
        step = min(span, depth - span)
        after = np.zeros_like(rank)
        after[: len(rank) - step] = rank[step:] + 1
        order = np.lexsort((after, rank))
        new = np.ones(len(rank), bool)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new) - 1
        span += step


def lcp(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many ids each suffix shares with the one before it, up to `depth`; id 0, which
    ends a document, is shared with none."""
    shared = np.zeros(len(order), np.int64)
    if not len(order):
        return shared
    wide = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    going = np.ones(len(order) - 1, bool)
    for n in range(depth):
        a = wide[order[1:] + n]
        going &= (a == wide[order[:-1] + n]) & (a != 0)
        shared[1:] += going
    return shared


def block_buckets(texts: list[str | None], buckets: int = BUCKETS, longest: int = LONGEST) -> list[tuple[int, np.ndarray]]:
    """(words, buckets of all features) of each text."""
    known: dict[bytes, int] = defaultdict()
    known.default_factory = lambda: len(known) + 1
    parts, sizes = [], []
    for t in texts:
        words = (t or "").encode("utf-8", "replace").translate(_LETTERS).split()
        parts.append(np.fromiter((known[w] for w in words), np.int32, len(words)))
        sizes.append(len(words))
    names = [b"", *known]
    ends = np.cumsum(np.array(sizes, np.int64) + 1) if sizes else np.zeros(0, np.int64)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    for p, e in zip(parts, ends.tolist(), strict=True):
        ids[e - 1 - len(p) : e - 1] = p
    order = suffix_array(ids, longest)
    shared = lcp(ids, order, longest)
    # words from each place to its document's end
    left = np.repeat(ends, np.array(sizes, np.int64) + 1) - 1 - np.arange(len(ids))
    found = []
    for n in range(1, longest + 1):
        here = order[left[order] >= n]
        begins = (shared < n)[left[order] >= n]
        heads = here[begins]
        text = ids[heads[:, None] + np.arange(n)] if len(heads) else np.zeros((0, n), np.int32)
        once = np.fromiter((zlib.crc32(b" ".join([names[w] for w in g])) % buckets for g in text.tolist()), np.int64, len(heads))
        out = np.full(len(ids), -1, np.int64)
        out[here] = once[np.cumsum(begins) - 1] if len(here) else once
        found.append(out)
    made = []
    for size, e in zip(sizes, ends.tolist(), strict=True):
        of = [out[e - 1 - size : e - n] for n, out in enumerate(found, 1) if size >= n]
        made.append((size, np.concatenate(of) if of else np.zeros(0, np.int64)))
    return made


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def featured(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, buckets binary, mark, uid) of (key, text, ...); null
    text has no words. `mark` is a hash of the text."""
    tuned(docs.sparkSession)
    kind = _kind(buckets)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary()), ("mark", pa.int64()), ("uid", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = block_buckets(b.column(1).to_pylist(), buckets, longest)
            n = [len(x) for _, x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([w for w, _ in found], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x.astype(kind).tobytes() for _, x in found], pa.binary()), b.column(2), b.column(3)],
                schema=schema,
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("uid"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary, mark long, uid long")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): each task sums its own, at most `buckets` rows a task are shuffled."""
    kind = _kind(buckets)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in it:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(n)
        yield as_arrow({"bucket": at.tolist(), "n": n[at].tolist()}, pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))

    return features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets, from the counts of the corpus and of the target:
    floor of 1000 times the log of the smoothed ratio of shares."""
    made = (
        raw.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
        .join(raw.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .fillna(0, ["s", "t"])
    )
    both = Table(made, "counts").df
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c, more: (F.col(c) + more).cast("double")
    ratio = d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # sums: one row


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Noise in thousandths, from a hash of seed and id; a null id is empty text."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(features: DataFrame, gains: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Features with weight and score in place of their buckets. The gains, one number a
    bucket, are sent to every task."""
    kind = _kind(buckets)
    table = np.zeros(buckets, np.int64)
    for r in gains.collect():  # `buckets` rows
        table[r["bucket"]] = r["gain"]
    sent = features.sparkSession.sparkContext.broadcast(table)
    at = features.columns.index("buckets")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [int(sent.value[np.frombuffer(x.as_buffer(), kind)].sum()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), pa.array(got, pa.int64())], names=[*(n for n in b.schema.names if n != "buckets"), "weight"])

    rows = features.mapInArrow(run, "doc_id long, n_words long, n_features long, mark long, uid long, weight long")
    return rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, share: int = SHARE) -> DataFrame:
    """`scored` with rank: 1, 2, 3 ... of the `share` percent best among rows of at least
    `least_words` words, else null. Ties go to the smaller id (null last), then by the
    text's hash.

    Rows are dealt by ranges of that order and numbered where they lie; the number of
    rows in the ranges before is added, one row a range."""
    fit = F.col("n_words") >= least_words
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("mark"), F.asc("uid")]
    ranged = scored.withColumn("fit", fit).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = Table(ranged.withColumn("at", F.monotonically_increasing_id()), "ranked").df
    part = F.shiftright("at", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"), F.count_if("fit").alias("fits"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    most = sizes.agg(F.coalesce(F.floor(F.sum("fits") * share / 100), F.lit(0)).alias("most"))
    rows = placed.select("*", part).join(F.broadcast(starts), "part").join(F.broadcast(most))  # one row a range, and one row
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("fit") & (place <= F.col("most")), place).cast("long").alias("rank")
    )


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED, target_key: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document: importance
    of `docs` (doc_id, text, ...) for the target (target_key, text, ...), and the draw.

    Null and empty texts have no features and weigh 0. Repeated rows are scored each. A
    target without words is an even one. Empty tables give an empty table. Texts of any
    length are read whole."""
    seen = Table(featured(docs, buckets, longest), "features").df
    aim = bucket_counts(featured(target, buckets, longest, target_key), buckets)
    gains = bucket_gains(bucket_counts(seen, buckets), aim, buckets)
    return drawn(weighted(seen, gains, buckets, seed), least_words, share)
