"""Operator 1: token ids in wavelet-matrix files.

A shard is a run of documents in doc_id order, at most `SHARD_IDS` ids long unless one
document alone is longer. Its ids, renumbered densely by the shard's own alphabet, are
kept as one bit-plane per bit of the largest code. Rank directories beside the planes
give access, counting and occurrence lookup without undoing the whole shard; every
section of the file is a zstd frame.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_arrow, new_path, tuned
from .tokens import encoder, vocabulary

SHARD_IDS = 4_000_000
_MAGIC = b"GLWM0001"
_RANK = 512  # bits from one entry of a rank directory to the next


class WaveletMatrix:
    """Bit-planes of a sequence of ids, most significant first, with rank and select."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.alphabet, self.zeros, self.planes, self.ranks = n, alphabet, zeros, planes, ranks

    @property
    def levels(self) -> int:
        return len(self.planes)

    @classmethod
    def of(cls, ids: np.ndarray) -> "WaveletMatrix":
        top = int(ids.max()) + 1 if len(ids) else 0
        seen = np.zeros(top, bool)
        seen[ids] = True
        alphabet = np.flatnonzero(seen).astype("<u4")
        code = np.zeros(top, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet), dtype=code.dtype)
        a = code[ids]
        zeros, planes, ranks = [], [], []
        for k in reversed(range(max(0, len(alphabet) - 1).bit_length())):
            one = ((a >> k) & 1).astype(bool)
            a = np.concatenate((np.compress(~one, a), np.compress(one, a)))
            plane = np.packbits(one)
            zeros.append(len(one) - int(np.count_nonzero(one)))
            planes.append(plane)
            ranks.append(_directory(plane))
        return cls(len(ids), alphabet, zeros, planes, ranks)

    def decode(self) -> np.ndarray:
        """All ids in order."""
        v = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in reversed(range(self.levels)):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            w, z = np.empty_like(v), self.zeros[level]
            w[np.flatnonzero(~one)] = v[:z]
            w[np.flatnonzero(one)] = v[z:] | v.dtype.type(1 << (self.levels - 1 - level))
            v = w
        return self.alphabet[v] if self.n else np.zeros(0, "<u4")

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        block, plane = i // _RANK, self.planes[level]
        at = block * (_RANK // 8)
        part = np.unpackbits(plane[at : (i + 7) // 8], count=i - 8 * at) if i > 8 * at else plane[:0]
        return int(self.ranks[level][block]) + int(part.sum())

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, z in enumerate(self.zeros):
            bit = int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1
            ones = self._ones(level, i)
            i = z + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def rank(self, token: int, i: int) -> int:
        """How often an id stands before position i."""
        if (code := self._code(token)) is None:
            return 0
        lo, hi = 0, min(max(i, 0), self.n)
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (z + a, z + b) if code >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of an id's k-th occurrence, from 0; -1 if there are not so many."""
        if (code := self._code(token)) is None or not 0 <= k < self.count(token):
            return -1
        at = 0
        for level, z in enumerate(self.zeros):
            ones = self._ones(level, at)
            at = z + ones if code >> (self.levels - 1 - level) & 1 else at - ones
        at += k
        for level in reversed(range(self.levels)):
            bit = code >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _select(self, level: int, bit: int, k: int) -> int:
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * _RANK, self.n) - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        at = block * (_RANK // 8)
        bits = np.unpackbits(self.planes[level][at : at + _RANK // 8], count=min(_RANK, self.n - 8 * at))
        return 8 * at + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def positions(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def _directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of _RANK bits."""
    step = _RANK // 8
    ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % step))).reshape(-1, step).sum(1, dtype=np.uint32)
    return np.concatenate(([0], np.cumsum(ones, dtype=np.uint32))).astype("<u4")


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One shard's file: head, then frames of documents, alphabet, planes and ranks."""
    m, z = WaveletMatrix.of(ids), zstandard.ZstdCompressor(level=1)
    parts = [
        np.array([d if d is not None else 0 for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], "u1"),
        np.array(lengths, "<u8"),
        m.alphabet,
        np.array(m.zeros, "<u8"),
        *(x for pair in zip(m.planes, m.ranks, strict=True) for x in pair),
    ]
    frames = [z.compress(np.ascontiguousarray(x).tobytes()) for x in parts]
    head = struct.pack("<8sQII", _MAGIC, m.n, len(doc_ids), len(frames))
    return head + struct.pack(f"<{len(frames)}Q", *map(len, frames)) + b"".join(frames)


def unpack(file: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc ids, their lengths in ids, and the matrix of a file."""
    magic, n, _, count = struct.unpack_from("<8sQII", file)
    if magic != _MAGIC:
        raise ValueError("not a wavelet-matrix file")
    sizes = struct.unpack_from(f"<{count}Q", file, 24)
    at, frames, z = 24 + 8 * count, [], zstandard.ZstdDecompressor()
    for size in sizes:
        frames.append(z.decompress(file[at : at + size]))
        at += size
    null = np.frombuffer(frames[1], "u1")
    docs = [None if x else d for d, x in zip(np.frombuffer(frames[0], "<i8").tolist(), null, strict=True)]
    rest = frames[5:]
    m = WaveletMatrix(
        n,
        np.frombuffer(frames[3], "<u4"),
        np.frombuffer(frames[4], "<u8").tolist(),
        [np.frombuffer(x, "u1") for x in rest[0::2]],
        [np.frombuffer(x, "<u4") for x in rest[1::2]],
    )
    return docs, np.frombuffer(frames[2], "<u8"), m


_FILES = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("file", pa.binary())])
_DOCS = pa.schema(
    [("shard", pa.int64()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode (doc_id, text) and write the shards' files under `path`.

    Documents are dealt by ranges of doc_id, so files follow doc_id order; only ids
    and text move. Equal doc_ids stand by text. Null or empty text: the end id alone.
    Null doc_id: before all others. Empty input: no file.
    """
    tuned(docs.sparkSession)

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer, True, end_id), TaskContext.get().partitionId(), 0
        names, lengths, parts, total = [], [], [], 0

        def shard() -> pa.RecordBatch:
            file = pack(names, lengths, np.concatenate(parts))
            return as_arrow({"shard": [part << 32 | seq], "n_docs": [len(names)], "n_ids": [total], "file": [file]}, _FILES)

        for b in it:
            ids, ends = enc.flat(b.column(1))
            docs, at = b.column(0).to_pylist(), 0
            while at < len(docs):  # as many documents as the shard still takes, one at least
                base = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, base + shard_ids - total, "right"))
                if to <= at and names:
                    yield shard()
                    names, lengths, parts, total, seq = [], [], [], 0, seq + 1
                    continue
                to = max(to, at + 1)
                names += docs[at:to]
                lengths += np.diff(ends[at:to], prepend=base).tolist()
                parts.append(ids[base : ends[to - 1]])
                total += int(ends[to - 1]) - base
                at = to
        if names:
            yield shard()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(build, "shard long, n_docs long, n_ids long, file binary")
        .write.option("compression", "none")
        .parquet(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    The running start is a sum over shards (one row of two numbers each), joined back.
    """
    files = spark.read.schema("shard long, n_docs long, n_ids long, file binary").parquet(path)

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for shard, file in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs, lengths, matrix = unpack(file.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                ids = memoryview(matrix.decode().astype("<u4", copy=False)).cast("B")
                starts = (ends - lengths.astype(np.int64)).tolist()
                yield as_arrow(
                    {
                        "shard": [shard] * len(docs),
                        "doc_id": docs,
                        "within": starts,
                        "n_tokens": lengths.tolist(),
                        "ids_crc32": [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts, ends.tolist(), strict=True)],
                    },
                    _DOCS,
                )

    found = files.select("shard", "file").mapInArrow(
        scan, "shard long, doc_id long, within long, n_tokens long, ids_crc32 long"
    )
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = files.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    return found.join(starts, "shard").select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents' ids to the shared folder and read them back."""
    path = new_path(spark, "ids")
    write_ids(docs, path, tokenizer or vocabulary("byte_bpe_50k.json"))
    return read_ids(spark, path)
