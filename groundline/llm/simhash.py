"""Operator 10: SimHash near-duplicates by vantage-point trees.

Distinct fingerprints are dealt to shards by the upper levels of a vantage-point tree
(one vantage point of the data a level): a fingerprint goes to its own side, and one just inside a
boundary also to the outer side, so every pair within the radius meets in a shard.
Each shard is joined with itself by a vantage-point recursion that skips branches by
the triangle bound, and gives links that span its groups instead of all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, connected_components, tuned

RADIUS, SHINGLE, SEED, SHARD = 3, 3, 42, 30_000
#: A shard over FULL times SHARD is divided; at most SEND_ROWS such shards are sent to every executor, more are joined.
FULL, SEND_ROWS = 4, 100_000
LEAF = 1024
#: Levels that fit a shard's number; shards that would need more are divided.
MOST_LEVELS = 60


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """A text's 64-bit SimHash over word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n, digest = len(words), xxhash.xxh64_intdigest
    if n <= width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        line, ends, at = b" ".join(words), [], 0
        for w in words:
            at += len(w)
            ends.append(at)
            at += 1
        starts = [0, *(e + 1 for e in ends[: n - width])]
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    tuned(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _far(a: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ v)


def _brute(p: np.ndarray, q: np.ndarray, radius: int, same: bool, out: list) -> None:
    step = max(1, (1 << 20) // max(1, len(q)))
    for i in range(0, len(p), step):
        rows, cols = np.nonzero(np.bitwise_count(p[i : i + step, None] ^ q[None, :]) <= radius)
        rows += i
        on = rows < cols if same else p[rows] != q[cols]
        rows, cols = rows[on], cols[on]
        if len(rows) > len(p) + len(q):  # a dense block: keep links that span its groups
            rows, cols = _span(rows, cols, len(p), len(q), same)
        out.append((p[rows], q[cols]))


def _span(rows, cols, n, m, same):
    """Of many links a subset that leaves the same groups: each node's link to the
    smallest partner, repeated on group labels."""
    total = n if same else n + m
    b = cols if same else cols + n
    label, chosen = np.arange(total), []
    while True:
        la, lb = label[rows], label[b]
        on = np.flatnonzero(la != lb)
        if not len(on):
            break
        hi, lo = np.maximum(la[on], lb[on]), np.minimum(la[on], lb[on])
        order = np.lexsort((lo, hi))
        first = np.ones(len(order), bool)
        first[1:] = hi[order][1:] != hi[order][:-1]
        pick = order[first]
        chosen.append(on[pick])
        label[hi[pick]] = lo[pick]
        while not np.array_equal(label, label[label]):
            label = label[label]
    keep = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
    return rows[keep], cols[keep]


def _within(s: np.ndarray, radius: int, out: list) -> None:
    if len(s) <= LEAF:
        return _brute(s, s, radius, True, out)
    d = _far(s, s[0])
    mid = int(np.median(d))
    if d.max() <= mid:
        mid = int(d.max()) - 1
    inner = d <= mid
    if mid < 0 or inner.all() or not inner.any():
        return _brute(s, s, radius, True, out)
    _within(s[inner], radius, out)
    _within(s[~inner], radius, out)
    _across(s[inner & (d > mid - radius)], s[~inner & (d <= mid + radius)], radius, out)


def _across(p: np.ndarray, q: np.ndarray, radius: int, out: list) -> None:
    if not len(p) or not len(q):
        return None
    if len(p) * len(q) <= LEAF * LEAF:
        return _brute(p, q, radius, False, out)
    v = (p if len(p) >= len(q) else q)[0]
    a, b = _far(p, v), _far(q, v)
    mid = int(np.median(np.concatenate((a, b))))
    top = max(int(a.max()), int(b.max()))
    mid = min(mid, top - 1)
    pi, qi = a <= mid, b <= mid
    if mid < 0 or not (pi.any() or qi.any()):
        return _brute(p, q, radius, False, out)
    near_p, near_q = (a > mid - radius), (b > mid - radius)
    _across(p[pi], q[qi], radius, out)
    _across(p[~pi], q[~qi], radius, out)
    _across(p[pi & near_p], q[~qi & (b <= mid + radius)], radius, out)
    _across(p[~pi & (a <= mid + radius)], q[qi & near_q], radius, out)


def _joined(out: list) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.uint64) for i in (0, 1))


def near_pairs(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct fingerprints within the radius: all of sparse blocks,
    and in dense ones enough to span their groups."""
    out: list = []
    _within(np.unique(fps), radius, out)
    return _joined(out)


def near_across(p: np.ndarray, q: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """As near_pairs, between two sets that share no fingerprint."""
    out: list = []
    _across(np.unique(p), np.unique(q), radius, out)
    return _joined(out)


def _deeper(codes: Column, sides: Column) -> Column:
    """Shard codes with one more level: each code with each side."""
    return F.flatten(F.transform(codes, lambda c: F.transform(sides, lambda b: 2 * c + b)))


def shards(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(shard, fp): distinct fingerprints dealt by the tree's upper levels.

    Levels are added until a shard has about `shard` rows. A level's vantage point is a
    fingerprint of the data, one of those with the smallest hashes, and its boundary the
    median distance from it, from a count of the 65 distances. Copies made by boundaries
    are about 1.3 a level.
    """
    n = fps.count()
    levels = 0
    while n * 1.3**levels > shard * 2**levels and levels < MOST_LEVELS:
        levels += 1
    code: Column = F.array(F.lit(0).cast("long"))
    points = [r["fp"] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(levels).collect()] if levels else []
    fars = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(v))) for v in points]
    hist: list[dict[int, int]] = [{} for _ in fars]
    if fars:
        dist = fps.select(F.posexplode(F.array(*fars)).alias("level", "d")).groupBy("level", "d").agg(F.count("*").alias("n"))
        for r in dist.collect():  # 65 a level at most
            hist[r["level"]][r["d"]] = r["n"]
    for level, far in enumerate(fars):
        run, mid = 0, 0
        for mid in sorted(hist[level]):  # noqa: B007
            run += hist[level][mid]
            if 2 * run >= n:
                break
        sides = F.when(far > mid, F.array(F.lit(1))).when(far > mid - radius, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        code = _deeper(code, sides)
    return fps.select(F.explode(code).alias("shard"), "fp")


def divided(dealt: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, a, b, own, fp): shards in tasks of bounded size.

    Vantage points don't part fingerprints that lie close together, so one group of near
    copies can overfill a shard. Such a shard is cut into parts of about `shard` rows,
    and each two parts (a, b) meet in a task of their own; `own` is a row's part.
    """
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > FULL * shard)
    full = Table(sizes.select("shard", F.ceil(F.col("n") / F.lit(shard)).alias("parts")), "full").df
    n = full.count()
    if not n:
        zero = F.lit(0).cast("long")
        return dealt.select("shard", zero.alias("a"), zero.alias("b"), zero.alias("own"), "fp")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    rows = dealt.join(F.broadcast(full) if n <= SEND_ROWS else full, "shard", "left")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return rows.select("shard", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp")


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp as signed long)."""

    def join(g: pd.DataFrame) -> pd.DataFrame:
        fp, own = g["fp"].to_numpy(np.int64).view(np.uint64), g["own"].to_numpy()
        first = own == own.min()
        a, b = near_pairs(fp, radius) if first.all() else near_across(fp[first], fp[~first], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = divided(shards(fps, radius, shard), shard)
    return dealt.groupBy("shard", "a", "b").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Equal fingerprints are one node, so copies never become pairs; only nodes with
    links take part in the rounds of connected components. Null or empty texts have
    fingerprint zero and are linked like any other. Repeated rows share their class.
    A null doc_id takes its class's smallest id. Empty input: no rows.
    """
    made = Table(with_fingerprint(docs), "fingerprints").df
    nodes = Table(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes").df
    links = Table(link_fingerprints(nodes.select("fp"), radius), "links").df
    parts = connected_components(links).withColumnRenamed("node", "fp")
    linked = nodes.join(parts, "fp").groupBy("component").agg(F.min("least").alias("first"))
    to = nodes.join(parts, "fp", "left").join(linked, "component", "left").select("fp", F.coalesce("first", "least").alias("component_id"))
    return made.join(to, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
