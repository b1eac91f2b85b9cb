"""Sections of Markdown, plain text and page text, and chunks of sections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundline.functions.text import strip, words

# What begins a section in each kind of file.
HEADINGS = {
    "markdown": r"(?md)^(#{1,6})\s+(.+)$",
    "text": r"(?md)^(?:={3,}|-{3,})\s*([A-Za-z0-9\s\-]+)\s*(?:={3,}|-{3,})$",
    "pdf": r"(?md)^(?:(?:[0-9]+\.){1,3}\s+[A-Z][\w\s\-,\&;]+|[A-Z][A-Z0-9\s\-,\&;]{3,50}:?)$",
}
ROOT = {"markdown": "General", "text": "Main", "pdf": "General"}


def sections(docs: DataFrame, kind: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, level, title, path, start, end) of each document; keys are unique.

    The heading pattern is applied to the whole text. Offsets are half open, in code
    points. Text before the first heading belongs to no section; without a heading the
    whole text is one section. Headings are rows: their starts are running sums of what
    lies before them, and a path has, of each lower level, the last heading before that
    no heading of a yet lower level has followed. Work grows with the number of headings
    times the levels, and a document of many headings is sorted, not held in one row.
    """
    pattern = HEADINGS[kind]
    t = F.col(text)
    heads = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    marked = docs.select(
        key, F.length(t).alias("n"), heads.alias("heads"),
        F.transform(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(heads)), F.length).alias("gaps"),
    )
    rows = marked.select(key, "n", F.posexplode_outer(F.arrays_zip("heads", "gaps")).alias("ordinal", "h"))
    head, deep = F.col("h.heads"), kind == "markdown"
    if deep:
        level, title = F.length(F.regexp_extract(head, r"^(#+)", 1)), strip(F.regexp_replace(head, r"^#+\s+", ""))
    else:
        level, title = F.lit(1), strip(F.regexp_extract(head, pattern, 1) if kind == "text" else head)
    size = F.coalesce(F.length(head), F.lit(0))
    told = rows.select(
        key, "n", F.coalesce("ordinal", F.lit(0)).cast("long").alias("ordinal"), F.coalesce(level, F.lit(1)).cast("long").alias("level"),
        F.coalesce(title, F.lit(ROOT[kind])).alias("title"), size.alias("size"), (F.coalesce("h.gaps", F.lit(0)) + size).cast("long").alias("step"),
    )
    order = W.partitionBy(key).orderBy("ordinal")
    start = (F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).cast("long")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    own = F.struct("level", "title")
    over = [F.last(F.when(F.col("level") <= n, own), ignorenulls=True).over(before) for n in range(1, 6)] if deep else []
    above = [F.when((F.col("level") > n) & (x["level"] == n), x["title"]) for n, x in enumerate(over, 1)]
    path = F.array_compact(F.array(*above, F.col("title")))
    made = told.select(key, "n", "ordinal", "level", "title", path.alias("path"), start.alias("start"))
    end = F.coalesce(F.lead("start").over(order), F.col("n").cast("long"))
    return made.select(key, "ordinal", "level", "title", "path", "start", end.alias("end"))


def page_offsets(pages: DataFrame, gap: int = 2) -> DataFrame:
    """(doc_id, page_number, start, end) of (doc_id, page_number, text) joined by `gap` characters."""
    before = W.partitionBy("doc_id").orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("text")
    at = F.coalesce(F.sum(size + gap).over(before), F.lit(0)).cast("long")
    return pages.select("doc_id", F.col("page_number").cast("long"), at.alias("start"), (at + size).cast("long").alias("end"))


def swept(points: DataFrame, marks: DataFrame, name: str, at: str, to: str, ahead: bool = False, key: str = "doc_id") -> DataFrame:
    """`points` with `name`: the row of `marks` of the same key with the greatest `to` that
    is at most the point's `at`, or, `ahead`, with the least `to` that is at least it; null
    where there is none. Of marks at one place the last counts, ahead the first, in order
    of `marks`' second column.

    Points and marks are sorted together once a key, and each point takes the mark last
    passed: no pairs are made, and a key of any number of rows is sorted and spilled."""
    rank = marks.columns[1]
    none = lambda df: F.lit(None).cast(df.select(F.struct(*df.columns).alias("x")).schema["x"].dataType)
    row, mark = F.struct(*points.columns), F.struct(*marks.columns)
    both = marks.select(F.col(key).alias("_k"), F.col(to).cast("long").alias("_at"), F.lit(0).alias("_point"), F.col(rank).cast("long").alias("_rank"), mark.alias("_mark"), none(points).alias("_row"))
    both = both.unionByName(points.select(F.col(key).alias("_k"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_point"), F.lit(None).cast("long").alias("_rank"), none(marks).alias("_mark"), row.alias("_row")))
    way = F.desc if ahead else F.asc
    passed = F.last("_mark", ignorenulls=True).over(W.partitionBy("_k").orderBy(way("_at"), "_point", way("_rank")).rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("_mark", passed).where("_row is not null").select("_row.*", F.col("_mark").alias(name))


def page_of(spans: DataFrame, pages: DataFrame, last: bool = False) -> DataFrame:
    """`spans` (doc_id, start, ...) with page_number: the first page (or the last) whose
    closed range holds the start, else 1. Starts and ends of a document's pages don't fall
    from page to page."""
    p = pages.select("doc_id", "page_number", F.col("start").alias("from"), F.col("end").alias("to"))
    found = swept(spans, p, "_page", "start", "from" if last else "to", ahead=not last)
    held = (F.col("_page.from") <= F.col("start")) & (F.col("start") <= F.col("_page.to"))
    return found.withColumn("page_number", F.coalesce(F.when(held, F.col("_page.page_number").cast("long")), F.lit(1).cast("long"))).drop("_page")


# Where a window may end, best first.
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ")


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """Windows of at most `size`, ended after the last of the best separators that lies
    beyond a third; each next one begins `overlap` before the end."""
    at, n = 0, len(text)
    while at < n:
        to = min(at + size, n)
        if to < n:
            cuts = ((text.rfind(s, at + size // 3 + 1, to), len(s)) for s in SEPARATORS)
            to = next((p + k for p, k in cuts if p >= 0), to)
        part = text[at:to].strip()
        if part or n <= size:
            yield part, at, to
        if to == n:
            return
        at = max(at + 1, to - overlap)


def _packed(pieces: Iterator[str], limit: int, glue: str, carry: int) -> Iterator[str]:
    """Join pieces while they fit; a piece that opens a chunk after another counts
    without `carry`."""
    held: list[str] = []
    used = 0
    for p in pieces:
        cost = len(p) + len(glue)
        if used + cost <= limit:
            used += cost
        else:
            if held:
                yield glue.join(held)
            held, used = [], cost - carry
        held.append(p)
    if held:
        yield glue.join(held)


def section_parts(text: str, limit: int) -> Iterator[str]:
    """A section's chunks: paragraphs packed up to `limit`; a longer one by sentences."""
    run: list[str] = []
    # a paragraph over the limit closes the run before it, and the next run counts anew
    for para in [*filter(None, map(str.strip, text.split("\n\n"))), None]:
        if para is not None and len(para) <= limit:
            run.append(para)
            continue
        yield from _packed(iter(run), limit, "\n\n", 2)
        run = []
        if para is not None:
            sentences = (s if s.endswith(".") else s + "." for s in map(str.strip, para.replace(".\n", ". \n").split(". ")) if s)
            yield from _packed(sentences, limit, " ", 1)


_CHUNK_DDL = "array<struct<text:string,start:long,end:long>>"
#: Bytes of text that one Arrow batch of chunks is made from; a longer text has a batch of its own.
SLICE_BYTES = 1 << 20


def slices(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """`b` in runs of rows of about SLICE_BYTES of the text in column `at`."""
    first, held = 0, 0
    for i, n in enumerate(pc.binary_length(b.column(at)).to_pylist()):
        if held and held + (n or 0) > SLICE_BYTES:
            yield b.slice(first, i - first)
            first, held = i, 0
        held += n or 0
    yield b.slice(first)


def _chunked(df: DataFrame, column: str, split) -> DataFrame:
    """`df` with `chunks` in place of the text in `column`, made from it by `split`; one
    pass, in Arrow batches, of which a worker holds the chunks of one slice at a time."""
    from pyspark.sql import types as T

    at = df.columns.index(column)
    names = [c for c in df.columns if c != column]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, at):
                texts, starts, ends, ats = [], [], [], [0]
                for x in b.column(at).to_pylist():
                    for t, s, e in split(x or ""):
                        texts.append(t)
                        starts.append(s)
                        ends.append(e)
                    ats.append(len(texts))
                made = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["text", "start", "end"])
                rest = [c for i, c in enumerate(b.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(ats, pa.int32()), made)], names=[*names, "chunks"])

    kind = T._parse_datatype_string(_CHUNK_DDL)
    return df.mapInArrow(run, T.StructType([*(f for f in df.schema if f.name != column), T.StructField("chunks", kind)]))


def fixed_chunks(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """(doc_id, chunk_index, start, end, text, token_count) of (doc_id, text)."""
    made = _chunked(docs.select("doc_id", "text"), "text", lambda t: windows(t, size, overlap))
    rows = made.select("doc_id", F.posexplode("chunks").alias("chunk_index", "c"))
    return rows.select("doc_id", F.col("chunk_index").cast("long"), "c.start", "c.end", "c.text", words(F.col("c.text")).cast("long").alias("token_count"))


def chunk_section(chunks: DataFrame, secs: DataFrame) -> DataFrame:
    """`chunks` with the title of the first section that holds its start or its end.
    Sections are those of `sections`: each begins where the one before ends."""
    s = secs.select("doc_id", "ordinal", "title", F.col("start").alias("from"), F.col("end").alias("to"))
    found = swept(swept(chunks, s, "_a", "start", "from"), s, "_b", "end", "to", ahead=True)
    a = F.when(F.col("start") < F.col("_a.to"), F.struct("_a.ordinal", "_a.title"))
    b = F.when(F.col("_b.from") <= F.col("end"), F.struct("_b.ordinal", "_b.title"))
    return found.withColumn("section_title", F.coalesce(F.least(a, b)["title"], F.lit("General"))).drop("_a", "_b")


def structural_chunks(docs: DataFrame, secs: DataFrame, limit: int = 800, page: Column | None = None) -> DataFrame:
    """Chunks of sections: (doc_id, chunk_index, section_title, start, end, prefix, text, token_count).

    `docs` has doc_id, filename, text; `secs` what `sections` gives. A section's slice
    is cut before the join goes on, so whole texts are not repeated for long."""
    raw = docs.select("doc_id", "filename", F.col("text").alias("_raw"))
    part = F.expr("substring(_raw, int(start) + 1, int(`end` - start))")
    cut = (
        secs.join(raw, "doc_id")
        .withColumn("_part", part)
        .select("doc_id", "filename", "ordinal", "title", "path", "start", (page if page is not None else F.lit(1)).cast("long").alias("page_number"), "_part")
    )

    def split(x: str) -> Iterator[tuple[str, int, int]]:
        for t in section_parts(x.strip(), limit):
            k = max(0, x.find(t))
            yield t, k, k + len(t)

    made = _chunked(cut, "_part", split)
    rows = made.select("*", F.posexplode("chunks").alias("_k", "c"))
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal", "_k")) - 1
    prefix = F.concat(F.lit("["), "filename", F.lit(" | § "), F.array_join("path", " > "), F.lit(" | Page "), F.col("page_number").cast("string"), F.lit("]"))
    return rows.select(
        "doc_id", "filename", index.cast("long").alias("chunk_index"), F.col("title").alias("section_title"), "page_number",
        (F.col("start") + F.col("c.start")).alias("start"), (F.col("start") + F.col("c.end")).alias("end"),
        prefix.alias("prefix"), "c.text", words(F.col("c.text")).cast("long").alias("token_count"),
    )
