"""Operator 11: document fingerprints by winnowing. DataFrame functions only.

Every `k` bytes of a text's UTF-8 are hashed; of each `window` hashes in a row the least
is chosen, the rightmost of equal ones, with its position. Two texts that share
`window + k - 1` bytes then share a chosen hash, whatever stands around them. Texts are
cut into overlapping blocks inside the row, so a long text costs time in proportion to
its length; nothing is exploded and no group is gathered.

The next document is found without one global window: keys drawn by their hash cut all
keys into ranges, and each range also gets the first key of the one after it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, WINDOW, BLOCK = 16, 16, 512
#: Ranges of keys for each shuffle partition. Their number is bounded by this, not by the number of documents.
RANGES = 4
_PLACE = 4095  # the low bits of a hash make room for the place in a block, counted down so that the rightmost is least
_KEY = "struct<missing:int,turned:bigint,mark:bigint>"


def _let(value: Column, body) -> Column:
    """`body(value)`, worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _least(keys: Column, window: int) -> Column:
    """The least of every `window` neighbours: spans grow fourfold, then to the width
    asked for. Fewer keys than a window are one window."""

    def wider(x: Column, *steps: int) -> Column:
        def of(v: Column) -> Column:
            stay = F.slice(v, F.lit(1), F.greatest(F.size(v) - steps[-1], F.lit(1)))
            return F.transform(stay, lambda a, i: F.least(a, *(F.get(v, i + s) for s in steps)))  # nulls beyond the end don't count

        return _let(x, of)

    span = 1
    while span * 4 <= window:
        keys, span = wider(keys, span, 2 * span, 3 * span), span * 4
    while span < window:
        step = min(span, window - span)
        keys, span = wider(keys, step), span + step
    return keys


def chosen_blocks(text: Column, k: int = K, window: int = WINDOW, block: int = BLOCK) -> Column:
    """array<array<bigint>>: of every `block` windows the least hashes, each with its place
    in the block in its low bits, counted down. `text` is a string or its bytes."""
    if block + window - 1 > _PLACE + 1:
        raise ValueError(f"block and window are {block} and {window}, which is more than {_PLACE + 1} places")

    def chosen(piece: Column) -> Column:
        grams = F.sequence(F.lit(0), F.greatest(F.octet_length(piece) - k, F.lit(0)))
        key = lambda i: F.xxhash64(F.substring(piece, i + 1, F.lit(k))).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(F.lit(_PLACE) - i)
        return F.array_distinct(_least(F.transform(grams, key), window))

    def whole(raw: Column) -> Column:
        last = F.greatest(F.octet_length(raw) - (k + window - 1), F.lit(0))  # where the last window begins
        piece = lambda j: F.substring(raw, j * block + 1, F.lit(block + k + window - 2))
        return F.transform(F.sequence(F.lit(0), F.floor(last / block).cast("int")), lambda j: _let(piece(j), chosen))

    return _let(text.cast("binary"), whole)


def fingerprint(blocks: Column, block: int = BLOCK) -> Column:
    """array<struct<position, hash>> of the result of `chosen_blocks`, in order of position."""

    def entry(x: Column, j: Column) -> Column:
        place = j * block + _PLACE - x.bitwiseAND(F.lit(_PLACE))
        return F.struct(place.cast("long").alias("position"), x.bitwiseAND(F.lit(~_PLACE)).alias("hash"))

    def once(found: Column) -> Column:  # neighbouring blocks may choose the same place; places never fall
        return F.filter(found, lambda x, i: (i == 0) | (F.get(found, i - 1)["position"] != x["position"]))

    return _let(F.flatten(F.transform(blocks, lambda b, j: F.transform(b, lambda x: entry(x, j)))), once)


def winnow(text: Column, k: int = K, window: int = WINDOW, block: int = BLOCK) -> Column:
    """array<struct<position, hash>> of a text's chosen hashes, in order of position.

    Positions are in bytes of UTF-8. Hashes are XXH64 (seed 42) without their low twelve
    bits. A text of fewer than k bytes, empty too, has one hash of all of it; null gives
    null. Any length is read whole; `block` doesn't matter for the result."""
    return fingerprint(chosen_blocks(text, k, window, block), block)


def spliced(blocks: Column, kept: Column, text: Column, k: int = K, window: int = WINDOW, block: int = BLOCK) -> Column:
    """`chosen_blocks` of `text`, whose first `kept` bytes are those of the text that
    `blocks` are of: blocks whose windows lie in these stay, the rest is hashed."""
    same = F.greatest(F.floor((kept - (k + window - 1)) / block), F.lit(0)).cast("int")
    rest = lambda n: F.concat(F.slice(blocks, F.lit(1), n), chosen_blocks(F.substring(text.cast("binary"), n * block + 1, F.octet_length(text)), k, window, block))
    return _let(same, rest)


def hashes(blocks: Column) -> Column:
    """The distinct hashes of the result of `chosen_blocks`."""
    return F.array_distinct(F.transform(F.flatten(blocks), lambda x: x.bitwiseAND(F.lit(~_PLACE))))


def digest(fingerprint: Column) -> Column:
    """A fingerprint's positions and hashes as one string of 32 hex digits."""

    def both(f: Column) -> Column:
        half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
        return F.concat(half(f), half(F.lit("again"), f))

    return _let(fingerprint, both)


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of all hashes of two arrays from `hashes`."""
    both = F.size(F.array_intersect(a, b))
    return (both / (F.size(a) + F.size(b) - both)).cast("double")


def _ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """`docs` (doc_id, text) with `range`, and `ahead` on copies of a range's first rows
    that stand behind the range before it; the first range's stand behind the last."""
    key = F.struct(
        F.col("doc_id").isNull().cast("int").alias("missing"),
        F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long").alias("turned"),
        F.xxhash64("text").alias("mark"),
    )
    keyed = docs.select("doc_id", "text", key.alias("key"))
    drawn = F.pmod(F.xxhash64("key"), F.lit(max(1, docs.count() // ranges))) == 0
    got = keyed.agg(F.min("key").alias("least"), F.collect_set(F.when(drawn, F.col("key"))).alias("drawn")).first()
    bounds = sorted({tuple(x) for x in (got["least"], *got["drawn"]) if x is not None})
    step = max(1, int(len(bounds) ** 0.5))

    def array(of: list[tuple]) -> Column:  # one constant, whatever its length
        return F.from_json(F.lit(json.dumps([dict(zip(("missing", "turned", "mark"), b)) for b in of])), f"array<{_KEY}>")

    below = lambda bs: F.size(F.filter(bs, lambda b: b <= F.col("key")))
    block = (below(array(bounds[::step])) - 1) * step
    at = block + below(F.slice(array(bounds), block + 1, F.lit(step)))
    found = keyed.withColumn("range", at)
    first = F.get(array(bounds), F.col("range") - 1) == F.col("key")
    before = F.when(F.col("range") > 1, F.col("range") - 1).otherwise(len(bounds))
    place = lambda r, ahead: F.struct(r.alias("range"), F.lit(ahead).alias("ahead"))
    copies = F.when(first, F.array(place(F.col("range"), False), place(before, True))).otherwise(F.array(place(F.col("range"), False)))
    return found.select("doc_id", "text", "key", F.explode(copies).alias("p")).select("doc_id", "text", "key", "p.range", "p.ahead")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, text, blocks, next_text, next_blocks) of (doc_id, text, ...), where
    blocks are those of `chosen_blocks`, and next is the document with the next smaller
    id, and after the least the greatest.

    Null text is empty. Null ids come last. Rows that share an id stand by a hash of
    their text; equal rows follow one another, each one's next being the row after it. A
    single document is its own next. An empty table gives an empty one. Texts are
    shuffled once. Rows of one id and one text share a range, which a window walks
    through and spills."""
    spark = docs.sparkSession
    n = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = _ranged(plain, n).repartition("range").withColumn("blocks", chosen_blocks(F.col("text"), k, window))
    follow = F.lead(F.struct("text", "blocks")).over(W.partitionBy("range").orderBy("ahead", "key"))
    rows = dealt.withColumn("next", follow).where(~F.col("ahead"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "text", "blocks", F.col("next.text").alias("next_text"), F.col("next.blocks").alias("next_blocks")
    )


def edited_likeness(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each document's fingerprint against that of its edited text, whose last half is
    the next document's beginning, and against the next document's. Rows as in
    `fingerprints`. The edited text keeps the blocks of its unchanged beginning."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    head = F.left("text", F.col("n_chars").cast("int") - half)
    rows = fingerprints(docs, k, window).select(
        "doc_id", "n_chars", F.octet_length(head).alias("kept"), F.concat(head, F.left("next_text", half)).alias("edited"), "blocks", "next_blocks"
    )
    rows = rows.withColumn("edited_blocks", spliced(F.col("blocks"), F.col("kept"), F.col("edited"), k, window))
    rows = rows.select("doc_id", "n_chars", "edited", "blocks", "edited_blocks", *(hashes(F.col(c)).alias(h) for c, h in (("blocks", "own"), ("edited_blocks", "new"), ("next_blocks", "next"))))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(fingerprint(F.col("blocks"))).alias("fingerprint"),
        digest(fingerprint(F.col("edited_blocks"))).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
