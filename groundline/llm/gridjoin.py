"""Operator 6: near-duplicate vectors by an epsilon grid order join.

Unit vectors of one label are sorted by grid cells of width epsilon on the leading
principal dimensions and cut into blocks. Intervals of the sequence are joined
recursively: an interval with itself, then the intervals of both, down to blocks, and a
pair is skipped with all below it when its bounding boxes are further apart than
epsilon. Pairs of blocks that remain are compared by one product in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, as_arrow, connected_components, tuned
from .simhash import _span

COSINE, DIMS, BLOCK, RUN, SAMPLE = 0.93, 4, 1024, 8, 4096  # RUN: intervals in one of the next level
_BLOCK_DDL = "label long, dim int, block long, lo array<double>, hi array<double>, ids binary, copies binary, rows binary"


def principal(sample: np.ndarray, dims: int) -> np.ndarray:
    """Leading principal directions (columns) of unit vectors; orthonormal, so that
    distances of projections never exceed those of the vectors."""
    if not len(sample):
        return np.zeros((sample.shape[1] if sample.ndim == 2 else 0, 0))
    centred = sample - sample.mean(0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :dims]


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(label, v, id, copies): distinct vectors that may link, with their smallest id."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        vectors.where(x.isNotNull() & F.col(label_col).isNotNull())
        .where(fine & F.exists(x, lambda c: c != 0))
        .groupBy(F.col(label_col).cast("long").alias("label"), F.transform(x, lambda c: c.cast("double") + F.lit(0.0)).alias("v"))
        .agg(F.min(F.col(id_col).cast("long")).alias("id"), F.count("*").alias("copies"))
    )


def _units(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def blocks(distinct: DataFrame, cosine: float, dims: int, sample: int, block: int) -> DataFrame:
    """Rows of packed blocks in epsilon grid order, with their bounding boxes."""
    eps = float(np.sqrt(2 - 2 * cosine))
    by_dim: dict[int, np.ndarray] = {}
    some = distinct.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]  # bounded by `sample`
    for d in {len(v) for v in some}:
        by_dim[d] = principal(_units([v for v in some if len(v) == d]), dims)

    def project(d: int, rows: list) -> np.ndarray:
        axes = by_dim.get(d, np.eye(d)[:, :dims])
        p = _units(rows) @ axes
        return np.pad(p, ((0, 0), (0, dims - p.shape[1])))

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = b.column(1).to_pylist()
            p = np.zeros((len(rows), dims))
            for d in {len(r) for r in rows}:
                on = [i for i, r in enumerate(rows) if len(r) == d]
                p[on] = project(d, [rows[i] for i in on])
            cell = np.floor(p / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([len(r) for r in rows], pa.int32()), *(pa.array(cell[:, k]) for k in range(dims))],
                names=[*b.schema.names, "dim", *(f"c{k}" for k in range(dims))],
            )

    order = ["label", "dim", *(f"c{k}" for k in range(dims)), "id"]
    ddl = "label long, v array<double>, id long, copies long, dim int, " + ", ".join(f"c{k} int" for k in range(dims))
    placed = Table(distinct.select("label", "v", "id", "copies").mapInArrow(cells, ddl), "cells").df

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, key = TaskContext.get().partitionId() << 33, 0, [], None

        def flush() -> pa.RecordBatch:
            p = project(key[1], [h[0] for h in held])
            rows = np.array([h[0] for h in held], "<f8")
            if (narrow := rows.astype("<f4")).astype("<f8").tobytes() == rows.tobytes():
                rows = narrow
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "label": key[0], "dim": key[1], "block": part | seq,
                        "lo": p.min(0).tolist(), "hi": p.max(0).tolist(), "rows": rows.tobytes(),
                        "ids": np.array([h[1] for h in held], "<i8").tobytes(), "copies": np.array([h[2] for h in held], "<i8").tobytes(),
                    }
                ],
                schema=_BLOCKS,
            )

        for b in it:
            for label, v, i, copies, dim in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if held and ((label, dim) != key or len(held) == block):
                    yield flush()
                    held, seq = [], seq + 1
                key = (label, dim)
                held.append((v, i, copies))
        if held:
            yield flush()

    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _BLOCK_DDL)


_BLOCKS = pa.schema(
    [("label", pa.int64()), ("dim", pa.int32()), ("block", pa.int64()), ("lo", pa.list_(pa.float64())),
     ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("copies", pa.binary()), ("rows", pa.binary())]
)
_FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def _near(eps: float):
    """Whether two bounding boxes a_, b_ come within epsilon."""
    gaps = F.zip_with(
        F.zip_with("a_lo", "b_hi", lambda x, y: x - y),
        F.zip_with("b_lo", "a_hi", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= (eps + 1e-9) ** 2


def block_pairs(made: DataFrame, eps: float, dims: int = DIMS) -> DataFrame:
    """Pairs (a, b) of block numbers, a <= b, whose boxes come within epsilon.

    Blocks are numbered along the sequence; RUN to the power k of them are an interval
    of level k. The one interval of the top level meets itself; each level's pairs are
    joined with the intervals below both sides. A level is written, so plans stay small
    and a lost executor costs one level."""
    span = made.agg(F.max(F.col("block") % (1 << 33)), F.max(F.shiftright("block", 33))).first()
    if span[0] is None:
        return made.select(F.col("block").alias("a"), F.col("block").alias("b"))
    wide = 1
    while wide <= span[0]:
        wide *= RUN
    at = F.shiftright("block", 33) * wide + F.col("block") % (1 << 33)  # without gaps beyond one partition's
    box = Table(made.select("label", "dim", "block", at.alias("at"), "lo", "hi"), "boxes").df
    top = 0
    while RUN**top <= (span[1] + 1) * wide:
        top += 1
    arrays = lambda c, f: F.array(*(f(F.col(c)[k]) for k in range(dims))).alias(c)

    def level(k: int) -> DataFrame:
        node = F.floor(F.col("at") / RUN**k).cast("long").alias("node")
        return box.groupBy("label", "dim", node).agg(arrays("lo", F.min), arrays("hi", F.max))

    def side(df: DataFrame, s: str) -> DataFrame:
        over = F.floor(F.col("node") / RUN).cast("long").alias(f"{s}_over")
        return df.select("label", "dim", over, *(F.col(c).alias(f"{s}_{c}") for c in ("node", "lo", "hi")))

    zero = F.lit(0).cast("long")
    pairs = box.select("label", "dim", zero.alias("a_over"), zero.alias("b_over")).distinct()
    for k in reversed(range(top)):
        nodes = level(k)
        met = pairs.join(side(nodes, "a"), ["label", "dim", "a_over"]).join(side(nodes, "b"), ["label", "dim", "b_over"])
        met = met.where((F.col("a_node") <= F.col("b_node")) & _near(eps))
        pairs = Table(met.select("label", "dim", F.col("a_node").alias("a_over"), F.col("b_node").alias("b_over")), "level").df
    names = lambda s: box.select("label", "dim", F.col("at").alias(f"{s}_over"), F.col("block").alias(s))
    return pairs.join(names("a"), ["label", "dim", "a_over"]).join(names("b"), ["label", "dim", "b_over"]).select("a", "b")


def compare(a, b, same: bool, cosine: float) -> list[tuple]:
    """Links of two blocks (ids, copies, rows): per vector its number of links, and
    links that span the groups."""
    (ai, ac, ar), (bi, bc, br) = a, b
    hit = ar @ br.T >= cosine
    if same:
        np.fill_diagonal(hit, False)
    out = []
    rows, cols = np.nonzero(hit)
    for ids, n in ((ai, hit @ bc), *(() if same else ((bi, hit.T @ ac),))):
        on = np.flatnonzero(n)
        out.append((ids[on], n[on], ids[on]))
    if len(rows) > len(ai) + len(bi):
        rows, cols = _span(rows, cols, len(ai), len(bi), same)
    out.append((ai[rows], np.zeros(len(rows), np.int64), bi[cols]))
    return out


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, dims: int = DIMS, block: int = BLOCK, sample: int = SAMPLE,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors`.

    The principal dimensions are fitted on `sample` vectors; they only steer pruning,
    every vector is indexed and compared. Equal vectors of a label are one node with a
    number of copies, and links count copies. Vectors of different length never link.
    Rows that share an id are copies of one node and share its class. A null label, a
    null, zero or empty vector, or one with null or non-finite components: no links.
    Empty input: no rows.
    """
    tuned(vectors.sparkSession)
    eps = float(np.sqrt(2 - 2 * cosine))
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), vec_col, F.col(label_col).cast("long").alias(label_col))
    distinct = Table(usable(rows, id_col, vec_col, label_col), "distinct").df
    made = Table(blocks(distinct, cosine, dims, sample, block), "blocks").df
    pairs = Table(block_pairs(made, eps, dims), "pairs").df
    side = lambda s: made.select(F.col("block").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("dim", "ids", "copies", "rows")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                both = []
                for s in "ab":
                    ids, n = np.frombuffer(r[f"{s}_ids"], "<i8"), np.frombuffer(r[f"{s}_copies"], "<i8")
                    kind = "<f4" if len(r[f"{s}_rows"]) == 4 * len(ids) * r[f"{s}_dim"] else "<f8"
                    m = np.frombuffer(r[f"{s}_rows"], kind).reshape(len(ids), -1)
                    both.append((ids, n, _units(m)))
                for ids, n, to in compare(*both, r["a"] == r["b"], cosine):
                    yield as_arrow({"id": ids, "links": n, "to": to}, _FOUND)

    payload = pairs.join(side("a"), "a").join(side("b"), "b")
    found = Table(payload.mapInArrow(run, "id long, links long, to long"), "found").df
    counts = found.where("links > 0").groupBy(F.col("id").alias("i")).agg(F.sum("links").alias("others"))
    parts = connected_components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    nodes = (
        distinct.join(counts, F.col("id") == F.col("i"), "left")
        .join(parts, F.col("id") == F.col("node"), "left")
        .select(
            F.col("label").alias("_l"),
            F.col("v").alias("_v"),
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    key = F.transform(F.col(vec_col), lambda c: c.cast("double") + F.lit(0.0))
    return (
        rows.withColumn("_k", key)
        .join(nodes, (F.col("_k") == F.col("_v")) & (F.col(label_col) == F.col("_l")), "left")
        .select(
            id_col,
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", id_col).alias("component_id"),
        )
        .withColumn("kept", F.col(id_col) == F.col("component_id"))
    )
