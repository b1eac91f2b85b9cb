"""Operator 9: best-fit packing by hierarchical residual rounds.

Documents become pieces of at most `capacity` tokens where they are scanned. Each
round deals items to groups of bounded size, packs every group best fit, closes nearly
full bins and passes the underfull ones on, as items, to fewer groups of the next
round. Only numbers move; a bin's place inside a later bin is added up at the end.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, as_arrow, tuned
from .tokens import encoder, vocabulary

CAPACITY, GROUP_ITEMS, NEARLY = 2048, 20_000, 8
_PIECES = pa.schema(
    [("item", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of each (doc_id, text); only documents longer than `capacity`
    are cut. `item` is unique to a row, repeated documents included."""
    tuned(docs.sparkSession)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, item = encoder(tokenizer, False, end_id), TaskContext.get().partitionId() << 40
        for b in it:
            ids, ends = enc.flat(b.column(1))
            raw, out, begin = memoryview(ids).cast("B"), {f.name: [] for f in _PIECES}, 0
            for d, end in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                for k, at in enumerate(range(begin, end, capacity)):
                    to = min(at + capacity, end)
                    for name, x in zip(out, (item, d, k, at - begin, to - at, zlib.crc32(raw[4 * at : 4 * to])), strict=True):
                        out[name].append(x)
                    item += 1
                begin = end
            yield as_arrow(out, _PIECES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "item long, doc_id long, piece long, start long, length long, ids_crc32 long"
    )


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(item, bin, offset) of (item, size), largest first into the fullest bin that
    still takes it; a bin is named by its first item."""
    out, free = [], []  # free: (room, bin) in order
    for size, item in sorted(((s, i) for i, s in items), key=lambda x: (-x[0], x[1])):
        at = bisect_left(free, (size,))
        if at < len(free):
            room, name = free.pop(at)
        else:
            room, name = capacity, item
        out.append((item, name, capacity - room))
        if room > size:
            insort(free, (room - size, name))
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(item, bin, at) for items (item, size), 0 < size <= capacity, item unique.

    A round closes nearly full bins, and those that not even the smallest of what is
    left would fit. Rounds go on until all that is left met in one group, or a round
    joined nothing. Each writes only its moves; they are followed to the last bin at the
    end, from the last round to the first.
    """
    left = Table(items.where(F.col("size") < capacity).select("item", "size"), "left")
    rounds: list[Table] = []
    while (n := left.df.count()) > 1:
        groups, turn = -(-n // group_items), len(rounds)

        def fit(g: pd.DataFrame) -> pd.DataFrame:
            got = best_fit(list(zip(g["item"].tolist(), g["size"].tolist(), strict=True)), capacity)
            size = dict(zip(g["item"], g["size"], strict=True))
            out = pd.DataFrame(got, columns=["item", "to", "offset"])
            return out.assign(size=out["item"].map(size))

        dealt = left.df.groupBy(F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(groups)).alias("g"))
        moved = Table(dealt.applyInPandas(fit, "item long, to long, offset long, size long"), "moved")
        rounds.append(moved)
        left.drop()
        bins = moved.df.groupBy(F.col("to").alias("item")).agg(F.sum("size").alias("size"))
        bins = Table(bins.where(F.col("size") < capacity - NEARLY), "left")
        least = bins.df.agg(F.min("size")).first()[0] or capacity
        left = Table(bins.df.where(F.col("size") + least <= capacity), "left")
        bins.drop()
        if groups == 1 or moved.df.where("item <> to").isEmpty():
            break
    left.drop()
    last = None
    for moved in reversed(rounds):
        step = moved.df.where("item <> to").select("item", "to", "offset")
        if last is not None:
            on = last.select(F.col("item").alias("to"), F.col("to").alias("_to"), F.col("offset").alias("_offset"))
            here = step.join(on, "to", "left").select(
                "item", F.coalesce("_to", "to").alias("to"), (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset")
            )
            step = here.union(last)
        last = Table(step, "moves").df if len(rounds) > 1 else step
    if last is None:
        return items.select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("at"))
    return (
        items.select("item")
        .join(last, "item", "left")
        .select("item", F.coalesce("to", "item").alias("bin"), F.coalesce("offset", F.lit(0).cast("long")).alias("at"))
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset.

    Null or empty text: a piece of the end id alone. Repeated rows and equal doc_ids
    are packed each for itself. Empty input: no rows. Extra columns are not read.
    """
    cut = Table(pieces(docs, tokenizer or vocabulary("word_bpe_49k.json"), capacity), "pieces").df
    placed = pack(cut.select("item", F.col("length").alias("size")), capacity)
    return cut.join(placed, "item").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset")
    )
