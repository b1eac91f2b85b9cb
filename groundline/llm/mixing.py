"""Operator 7: mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size takes every document floor(r) times, and of
the rest a balanced sample with probability frac(r). Flights run in blocks of bounded
size within a source: three open units move along the null space of the two
constraints (documents and tokens) until one is decided. A block leaves at most two
units open; they meet in fewer blocks of the next round, down to one landing a source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, tuned

WEIGHTS, MOST, BLOCK = (5, 2, 1), 3, 8192
#: Runs of what is no white space of these six.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, units, target) from (source, source_size, units).

    Weights repeat over sources in code point order, null last. Targets share the sum
    of all sizes by weight; one above `most` times its source's size stops there and
    the excess is shared again by weight. One row a source; each pass is one small job.
    """
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (n % len(weights) + 1).cast("int"))
    rows = Table(sizes.withColumn("w", w), "sources").df
    cap, level, closed = F.col("source_size") * float(most), None, -1
    while True:
        shut = F.lit(False) if level is None else F.col("w") * F.lit(level) > cap
        got = rows.agg(
            F.sum("source_size").alias("total"),
            F.coalesce(F.sum(F.when(shut, cap)), F.lit(0.0)).alias("spent"),
            F.coalesce(F.sum(F.when(~shut, F.col("w"))), F.lit(0.0)).alias("open"),
            F.count(F.when(shut, 1)).alias("closed"),
        ).first()
        if not got["total"] or not got["open"] or got["closed"] == closed:
            break
        closed, level = got["closed"], (got["total"] - got["spent"]) / got["open"]
    target = F.least(F.col("w") * F.lit(float(level or 0.0)), cap)
    return rows.select("source", "source_size", "units", target.alias("target"))


def flight(sizes: np.ndarray, probs: np.ndarray, seed: int, land: bool) -> np.ndarray:
    """Final probabilities: 0 or 1, and up to two in between unless `land`."""
    p = probs.astype(np.float64).copy()
    rng = np.random.default_rng(seed)
    x = sizes.astype(np.float64)
    waiting = iter(np.flatnonzero((p > 0) & (p < 1)).tolist())
    open_: list[int] = []
    draw = iter([0.0][:0])
    while True:
        while len(open_) < 3 and (k := next(waiting, None)) is not None:
            open_.append(k)
        if len(open_) < 3:
            break
        a, b, c = open_
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for k, d in zip(open_, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, -p[k] / d), min(down, (p[k] - 1) / d)
        if (r := next(draw, None)) is None:
            draw = iter(rng.random(1024).tolist())
            r = next(draw)
        move = up if r * (up + down) < down else -down
        for k, d in zip(open_, u, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + move * d))
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        open_ = [k for k in open_ if 0 < p[k] < 1]
    if land and open_:
        want = sum(p[k] * x[k] for k in open_)
        best = min(range(1 << len(open_)), key=lambda m: (abs(sum(x[k] for i, k in enumerate(open_) if m >> i & 1) - want), m))
        for i, k in enumerate(open_):
            p[k] = float(best >> i & 1)
    if land:
        _repair(x, p, float((x * (p - probs)).sum()))
    return p


def _repair(x: np.ndarray, p: np.ndarray, off: float) -> None:
    """Landing decides the last units by rounding; a large one may leave the tokens off
    by much. Units of that block are turned, the best fitting first, while it helps."""
    for _ in range(16):
        gain = np.where(p > 0.5, -x, x)  # what turning a unit adds
        k = int(np.argmin(np.abs(off + gain)))
        if abs(off + gain[k]) >= abs(off):
            return
        off += gain[k]
        p[k] = 1 - p[k]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, uid: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of `docs`; uid
    first, where `uid` is given.

    Null text: size 0. A null source is a source. Repeated rows are units of their own;
    `uid` names a column of unique longs to tell them by, else one is made. Reruns agree:
    blocks and draws depend on doc_id, size and source alone, and on the row's place
    where doc_id is null, so that such rows don't meet in one block. Empty input: no
    rows. Extra columns are not read.

    Rounding the last open units can leave a source's tokens off its target by much of a
    large document. Decided units of that last block are then turned where that brings
    the tokens nearer; document totals and the probabilities of those few units give way.
    """
    tuned(docs.sparkSession)
    own = F.col(uid) if uid else F.monotonically_increasing_id()
    units = Table(
        docs.select(
            own.alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size")
        ),
        "units",
    ).df
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    goal = Table(targets(sizes, weights, most), "targets").df
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    aim = goal.withColumn("whole", F.floor(ratio)).withColumn("prob", ratio - F.floor(ratio))
    both = units.join(aim.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    open_ = both.where("prob > 0").select("uid", "doc_id", "source", "size", "prob")
    decided: list[DataFrame] = []
    turn = 0
    while True:
        if turn:
            n = open_.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "s")
        else:
            n = goal.select(F.col("source").alias("s"), F.col("units").alias("n"))
        dealt = (
            open_.join(n, F.col("source").eqNullSafe(F.col("s")))
            .withColumn("blocks", F.ceil(F.col("n") / F.lit(block)))
            .withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", "uid"), "size", F.lit(turn)), F.col("blocks")))
            .select("uid", "doc_id", "source", "size", "prob", "block", "blocks", F.lit(turn).alias("turn"))
        )

        def fly(g: pd.DataFrame) -> pd.DataFrame:
            turn = int(g["turn"].iloc[0])
            g = g.sort_values(["size", "doc_id", "uid"], ascending=[False, True, True], na_position="first")
            name = g["source"].iloc[0]
            seed = [turn, int(g["block"].iloc[0]), 0 if name is None else 1, *(name or "").encode()]
            p = flight(g["size"].to_numpy(), g["prob"].to_numpy(), seed, int(g["blocks"].iloc[0]) == 1)
            return g.assign(prob=p)[["uid", "doc_id", "source", "size", "prob"]]

        flown = Table(
            dealt.groupBy("source", "block").applyInPandas(fly, "uid long, doc_id long, source string, size long, prob double"), "flown"
        ).df
        decided.append(flown.where("prob = 0 or prob = 1").select("uid", "prob"))
        open_ = flown.where("prob > 0 and prob < 1")
        turn += 1
        if open_.isEmpty():
            break
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    copies = (F.col("whole") + F.coalesce("drawn", F.lit(0.0))).cast("long")
    return (
        both.drop("prob")
        .join(out.withColumnRenamed("prob", "drawn"), "uid", "left")
        .select(*(["uid"] if uid else []), "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    )
