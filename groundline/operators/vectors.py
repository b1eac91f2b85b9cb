"""A stored index of vectors: exact top-k that leaves out blocks which can't hold a result.

Vectors of like direction stand together in blocks; a block knows its center and radius.
By Cauchy-Schwarz no inner product of a block exceeds q·center + |q| radius, so a block
whose bound is below a query's k-th best so far is not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.config import Config
from groundline.functions.text import STOPWORDS
from groundline.operators.ranking import TILE
from groundline.sources.tables import written

C = Config()
#: Vectors of a block; clusters at most, and vectors they are fitted on: both only decide who stands together.
BLOCK, CLUSTERS, SAMPLE = 256, 512, 8192
#: Blocks with this many times k vectors are read first, to learn what a query's k-th score is at least.
SEEDS = 8
SLACK = 2e-6  # scores are compared to six places


def usable(vectors: DataFrame, vector: str = "embedding") -> Column:
    """Whether a vector is there, not empty, and all its components are finite."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, bad), F.lit(False))


def centers(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Centers of `n` clusters or fewer of the sample's rows, by k-means from its first distinct rows."""
    c = np.unique(sample, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(n, len(c))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T - (c * c).sum(1) / 2, axis=1)
        used, at = np.unique(near, return_inverse=True)
        c = np.stack([np.bincount(at, weights=sample[:, d]) for d in range(sample.shape[1])], axis=1) / np.bincount(at)[:, None]
    return c


class DenseIndex:
    """Blocks of vectors in a folder: (block, n, center, radius, ids, rows). The bounds of
    all blocks are looked at for every query; their vectors are read only where needed."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path, key

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "doc_id", vector: str = "embedding", block: int = BLOCK, clusters: int = CLUSTERS, sample: int = SAMPLE) -> "DenseIndex":
        """Write the index of (key, vector), over what `path` held. Null and empty vectors
        and those with null or non-finite components can't be ranked and are left out.
        Clusters are fitted on `sample` vectors and decide only the order of all others."""
        spark = vectors.sparkSession
        v = vectors.where(usable(vectors, vector)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        some = v.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).select("v").collect()  # `sample` rows
        dim = max((len(r[0]) for r in some), default=0)
        own = [r[0] for r in some if len(r[0]) == dim]
        fit = np.array(own, np.float64).reshape(len(own), dim)
        n = min(clusters, max(1, v.count() // (2 * block)))
        c = spark.sparkContext.broadcast(centers(fit, n) if len(fit) else fit)

        def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (c.value * c.value).sum(1) / 2
            for b in it:
                near, then = np.full(b.num_rows, -1), np.full(b.num_rows, -1)
                sizes = np.array(b.column(1).value_lengths())
                own = np.flatnonzero(sizes == dim)
                if len(own) and len(half):
                    m = np.array(b.column(1).take(pa.array(own)).to_pylist(), np.float64)
                    s = m @ c.value.T - half
                    near[own] = s.argmax(1)
                    s[np.arange(len(s)), near[own]] = -np.inf
                    then[own] = s.argmax(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(then, pa.int32()), pa.array(sizes, pa.int32())], names=["id", "v", "near", "then", "dim"])

        kind = vectors.schema[key].dataType
        field = lambda *x: T.StructField(*x)
        placed = v.mapInArrow(place, T.StructType([field("id", kind), field("v", T.ArrayType(T.DoubleType())), *(field(x, T.IntegerType()) for x in ("near", "then", "dim"))]))
        order = ["dim", "near", "then", "id"]

        def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids, rows, last = TaskContext.get().partitionId() << 33, [], [], None

            def out() -> pa.RecordBatch:
                m = np.array(rows, np.float64)
                mid = m.mean(0)
                radius = float(np.sqrt(((m - mid) ** 2).sum(1)).max())
                cols = [[at], [len(ids)], [mid.tolist()], [radius], [ids], [m.ravel().tolist()]]
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, arrow, strict=True)], names=["block", "n", "center", "radius", "ids", "rows"])

            for b in it:
                arrow = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(b.column(0).type), pa.list_(pa.float64())]
                for i, x, near, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                    if ids and (len(ids) == block or (d, near) != last):
                        yield out()
                        at, ids, rows = at + 1, [], []
                    last = (d, near)
                    ids.append(i)
                    rows.append(x)
            if ids:
                yield out()

        packed = T.StructType([field("block", T.LongType()), field("n", T.LongType()), field("center", T.ArrayType(T.DoubleType())), field("radius", T.DoubleType()), field("ids", T.ArrayType(kind)), field("rows", T.ArrayType(T.DoubleType()))])
        placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, packed).write.mode("overwrite").parquet(path)
        return cls(spark, path, key)

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def top(self, queries: DataFrame, k: int, send_rows: int = C.send_rows) -> DataFrame:
        """(query_id, key, score): k best inner products of each query and some others;
        `ranking.top` picks the k best. `queries` has query_id, embedding; unusable ones
        get nothing, and vectors of another length are no candidates. Queries go out in
        groups of at most `send_rows`; `blocks_read` has the blocks that were read."""
        q = written(queries.where(usable(queries)).select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "queries")
        parts = max(1, -(-q.count() // send_rows))
        found, read = None, None
        for i in range(parts):
            one = q if parts == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
            pairs, more = self._group(one, k)
            found = more if found is None else found.unionByName(more)
            read = pairs if read is None else read.unionByName(pairs)
        self.blocks_read = read.select("block").distinct()
        return found

    def _group(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        got = queries.toArrow()  # `send_rows` at most
        ids = got["query_id"].combine_chunks()
        vectors = got["embedding"].to_pylist()
        sent = self.spark.sparkContext.broadcast((ids, vectors))
        kind, key = queries.schema["query_id"].dataType, self.key
        light = self.blocks().select("block", "n", "center", "radius")
        pair = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("most", T.DoubleType())])

        def bounds(bars: np.ndarray | None) -> Callable:
            """(q, block, n, most) of blocks that may reach a query's bar; without bars, of
            as many of a batch's best blocks as hold enough vectors."""

            def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held = _by_size(sent.value[1])
                for b in it:
                    n, radius, sizes = b.column(1).to_numpy(), b.column(3).to_numpy(), np.array(b.column(2).value_lengths())
                    for dim, (at, m) in held.items():
                        own = np.flatnonzero(sizes == dim)
                        if not len(own):
                            continue
                        c = np.array(b.column(2).take(pa.array(own)).to_pylist(), np.float64)
                        for j in range(0, len(at), TILE):
                            part = m[j : j + TILE]
                            most = part @ c.T + np.sqrt((part * part).sum(1))[:, None] * radius[own]
                            if bars is None:
                                order = np.argsort(-most, axis=1, kind="stable")
                                before = np.cumsum(n[own][order], axis=1) - n[own][order]
                                keep = np.zeros_like(most, bool)
                                np.put_along_axis(keep, order, before < SEEDS * k, axis=1)
                            else:
                                keep = most >= bars[at[j : j + TILE]][:, None] - SLACK
                            r, s = np.nonzero(keep)
                            cols = [at[j : j + TILE][r], b.column(0).to_numpy()[own][s], n[own][s], most[r, s]]
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["q", "block", "n", "most"])

            return run

        out = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query_id", kind), T.StructField(key, self.blocks().schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])

        def products(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            for b in it:
                for asked, own, flat in zip(b.column(0), b.column(1), b.column(2), strict=True):
                    q = np.array(asked.as_py(), np.int64)
                    names = own.values
                    m = flat.values.to_numpy().reshape(len(names), -1)
                    order = np.empty(len(names), np.int64)
                    order[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
                    for j in range(0, len(q), TILE):
                        s = np.array([vectors[i] for i in q[j : j + TILE]]) @ m.T
                        best = np.stack([np.lexsort((order, -r))[:k] for r in np.round(s, 6)])
                        at = np.repeat(q[j : j + TILE], best.shape[1])
                        cols = best.ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(at, pa.int32()), ids.take(pa.array(at)), names.take(pa.array(cols)), pa.array(np.take_along_axis(s, best, 1).ravel())],
                            names=["q", "query_id", key, "score"],
                        )

        def score(pairs: DataFrame) -> DataFrame:
            # a block's vectors go once to all queries that ask for it
            asked = pairs.groupBy("block").agg(F.collect_list("q").alias("asked"))
            return self.blocks().select("block", "ids", "rows").join(asked, "block").select("asked", "ids", "rows").mapInArrow(products, out)

        first = light.mapInArrow(bounds(None), pair)
        before = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("most"), "block").rowsBetween(W.unboundedPreceding, -1))
        seeds = written(first.withColumn("_n", F.coalesce(before, F.lit(0))).where(F.col("_n") < SEEDS * k).select("q", "block"), "seeds")
        sown = written(score(seeds), "sown")
        nth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
        bars = np.full(len(vectors), -np.inf)
        for r in sown.withColumn("_n", nth).where(F.col("_n") == k).select("q", "score").collect():  # one row a query of the group
            bars[r["q"]] = r["score"]
        may = written(light.mapInArrow(bounds(bars), pair).select("q", "block"), "may")
        rest = may.join(seeds, ["q", "block"], "left_anti")
        return seeds.unionByName(rest), sown.unionByName(score(rest)).drop("q")


def _by_size(vectors: list[list[float]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by.setdefault(len(v), []).append(i)
    return {d: (np.array(at), np.array([vectors[i] for i in at], np.float64)) for d, at in by.items()}


def hashed_embedder(dim: int = 256) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An embedder for `ranking.embed` that needs no model: each token adds the root of
    its number of occurrences, with a sign, in a place; both come from its MD5."""
    import re

    pattern = re.compile(r"[a-z0-9_]+", re.ASCII)
    stop = frozenset(STOPWORDS)

    def load() -> Callable[[list[str]], np.ndarray]:
        seen: dict[str, tuple[int, float]] = {}

        def place(t: str) -> tuple[int, float]:
            if t not in seen:
                if len(seen) > 1 << 20:
                    seen.clear()
                h = hashlib.md5(t.encode()).hexdigest()
                seen[t] = (int(h[:8], 16) % dim, 1.0 if int(h[8], 16) < 8 else -1.0)
            return seen[t]

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                n: dict[str, int] = {}
                for w in pattern.findall("".join(c.lower() if c.isascii() else c for c in t)):
                    if w not in stop:
                        n[w] = n.get(w, 0) + 1
                for w, m in n.items():
                    p, s = place(w)
                    out[i, p] += s * math.sqrt(m)
            return out

        return encode

    return load
