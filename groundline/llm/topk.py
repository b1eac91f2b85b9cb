"""Operator 2: exact top-k search by tiled matrix products.

Vectors are packed where they are scanned into tiles of at most `TILE` rows. Query
tiles meet shard tiles on a shard group, one product a pair; each pair keeps k per
query, tasks and then the final merge reduce these lists. No score leaves a pair that
is not among a query's k best of that tile.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, as_arrow, tuned

TILE, FEW = 4096, 4  # rows of a tile, tiles of a group
_TILES = pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("kind", pa.string()), ("uids", pa.binary()), ("ids", pa.binary()), ("rows", pa.binary())])
_TILE_DDL = "tile long, dim int, kind string, uids binary, ids binary, rows binary"
_HITS = pa.schema([("twig", pa.int64()), ("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _tile(tile: int, dim: int, uids: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((uids, ids))
    if rows.dtype == object:  # beyond doubles
        kind, blob = "int", json.dumps(rows[order].tolist()).encode()
    else:
        kind = "<f4" if not rows.size or np.abs(rows).max() <= 1 << 24 else "<f8"
        blob = rows[order].astype(kind).tobytes()
    made = {"tile": [tile], "dim": [dim], "kind": [kind], "uids": [uids[order].tobytes()], "ids": [ids[order].tobytes()], "rows": [blob]}
    return as_arrow(made, _TILES)


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    if row["kind"] == "int":
        rows = np.array(json.loads(row["rows"]), object)
    else:
        rows = np.frombuffer(row["rows"], row["kind"]).astype(np.float64)
    return np.frombuffer(row["uids"], "<i8"), ids, rows.reshape(len(ids), row["dim"])


def scaled(rows: list[np.ndarray], scale: int) -> np.ndarray:
    """floor(scale * x); as Python's integers where doubles can't hold the product."""
    block = np.stack(rows)
    with np.errstate(over="ignore"):
        made = np.floor(scale * block)
    if np.isfinite(made).all():
        return made
    return np.array([[int(x) * scale if abs(x) >= 1 << 53 else math.floor(scale * x) for x in r] for r in block.tolist()], object)


def pack_tiles(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Tiles of floor(scale * x). Rows whose id or vector is null, or whose vector holds
    null or non-finite components, are left out; an empty vector has dimension 0."""

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        part, uid, seq = TaskContext.get().partitionId() << 33, 0, 0

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal seq
            rows = held.pop(dim)
            seq += 1
            block = scaled([r[2] for r in rows], scale) if dim else np.zeros((len(rows), 0))
            return _tile(part | seq, dim, np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<i8"), block)

        for b in it:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                uid += 1
                if i is None or v is None or None in v:
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all():
                    continue
                held.setdefault(len(x), []).append((part | uid, i, x))
                if len(held[len(x)]) == TILE:
                    yield flush(len(x))
        for dim in list(held):
            yield flush(dim)

    tuned(vectors.sparkSession)
    return vectors.select(F.col(id_col).cast("long"), vec_col).mapInArrow(build, _TILE_DDL)


def _queries(tiles: DataFrame, every: int) -> DataFrame:
    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                uids, ids, rows = _open(row)
                if (on := ids % every == 0).any():
                    yield _tile(row["tile"], row["dim"], uids[on], ids[on], rows[on])

    return tiles.mapInArrow(pick, _TILE_DDL)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every sum stays below 2**53, beyond that
    in Python's integers; what no long holds becomes the nearest one."""
    if q.dtype != object and c.dtype != object:
        most = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) * max(1, q.shape[1])
        if most < 1 << 53:
            return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    low, high = -(1 << 63), (1 << 63) - 1
    made = [[min(max(x, low), high) for x in r] for r in (whole(q) @ whole(c).T).tolist()]
    return np.array(made, np.int64).reshape(len(q), len(c))


def top_of_tile(q, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query of tile q its k best of tile c: query rows, candidate rows, scores."""
    (qu, _, qr), (cu, _, cr) = q, c
    s = _product(qr, cr)
    own = cu[None, :] == qu[:, None]
    ranked = np.where(own, np.iinfo(np.int64).min, s)
    if ranked.shape[1] > k:
        bar = np.partition(ranked, ranked.shape[1] - k, axis=1)[:, -k]
        rows, cols = np.nonzero((ranked >= bar[:, None]) & ~own)
    else:
        rows, cols = np.nonzero(~own)
    order = np.lexsort((cols, ~s[rows, cols], rows))  # candidates stand by vec_id
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep], s[rows[keep], cols[keep]]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; queries are the rows whose
    id is divisible by `every`, candidates all rows but the query's own.

    Ties go to the smaller id. Repeated ids are rows of their own, as queries and as
    candidates. Only vectors of equal length are compared. A score that no long holds is
    given, and ranked, as the nearest long. Empty input: no rows. Extra columns are not
    read.

    Groups of `FEW` shard tiles meet all query tiles; their lists are merged in two
    steps, by query and about the root of the number of groups, then by query.
    """
    made = Table(pack_tiles(vectors, id_col, vec_col), "tiles")
    tiles = made.df
    groups = max(1, -(-tiles.count() // FEW))
    twigs = max(1, math.isqrt(groups))
    shards = tiles.withColumn("g", F.pmod(F.xxhash64("tile"), F.lit(groups)))
    queries = _queries(tiles, every).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"),
        "dim",
        *(F.col(c).alias(f"q_{c}") for c in ("kind", "uids", "ids", "rows")),
    )

    def products(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                q = _open({c: row[f"q_{c}"] for c in ("kind", "uids", "ids", "rows")} | {"dim": row["dim"]})
                c = _open(row)
                for a in range(0, len(q[0]), 1024):
                    part = tuple(x[a : a + 1024] for x in q)
                    rows, cols, scores = top_of_tile(part, c, k)
                    twig = np.full(len(rows), row["g"] % twigs, np.int64)
                    found = (twig, part[0][rows], part[1][rows], c[1][cols], scores)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=_HITS)

    hits = queries.join(shards, ["g", "dim"]).mapInArrow(products, "twig long, uid long, query_id long, vec_id long, score long")
    for by in (["uid", "twig"], ["uid"]):
        best = W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")
