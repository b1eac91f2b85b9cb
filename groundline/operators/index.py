"""A keyword index that grows: immutable segments of postings, and top-k that skips blocks.

A segment holds what one batch added. A key that comes again, or is deleted, is written
down as dead in the segment it stood in; nothing old is rewritten. Document frequencies
and lengths are sums of what each segment added or took, so they stay exact.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundline.config import Config
from groundline.operators import ranking
from groundline.operators.ranking import SLACK
from groundline.sources.tables import written

C = Config()
#: Bytes of text that one bucket of terms is made for.
BUCKET_BYTES = 32 << 20
#: A block: documents of one class of length, about this many; a term is bounded by blocks
#: in a segment where it stands in at least BOUNDED documents, else its postings are few.
BLOCK_DOCS, BOUNDED = 256, 128
#: A query's best blocks with this many times k documents are scored first, to learn what its k-th score is at least.
SEEDS = 4


def gain(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """What a term adds to a score beside its idf; grows with tf, falls with dl."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def unique(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _text) without null keys; of rows of one key the greatest text, null an empty one."""
    one = chunks.where(F.col(key).isNotNull()).select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if not one.groupBy(key).count().where("count > 1").isEmpty():
        one = one.groupBy(key).agg(F.max("_text").alias("_text"))
    return one


class Bm25Index:
    """Postings in a folder, in segments: `append` adds or replaces chunks, `delete`
    takes keys out, `compact` writes what is live to a new folder.

    A segment's tables are written each by one Spark write over that segment's own
    folder, its statistics last: a segment without them isn't there, and one that is
    written again under its number replaces itself. One writer at a time.

    Terms are dealt to buckets, as many as the segment's text asks for; within a segment
    postings are sorted by bucket, term and key and cut into ranges of that order, so a
    term that stands everywhere fills many tasks and files. A query reads only the
    buckets of its terms."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path, key

    @classmethod
    def build(cls, chunks: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> "Bm25Index":
        """An index of one segment, over what `path` held."""
        made = cls(chunks.sparkSession, path, key)
        made.append(chunks, text, segment=0)
        return made

    # tables
    def _find(self, name: str, segments: list[int]) -> DataFrame | None:
        """A table's rows of some segments; None where there is none."""
        return self._read([f"{self.path}/{name}/segment={s}" for s in segments], f"{self.path}/{name}") if segments else None

    def _read(self, paths: list[str], base: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", base).parquet(*paths)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder, no file in it
                raise
            return None

    def segments(self) -> list[dict]:
        """(segment, n, dl, buckets, dead) of every segment: what it added, and how many keys it found dead."""
        rows = self._read([f"{self.path}/stats"], f"{self.path}/stats")
        return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["segment"]) if rows is not None else []  # one row a segment

    def _write(self, df: DataFrame, name: str, segment: int, *by: str) -> None:
        out = df.write.mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(f"{self.path}/{name}/segment={segment}")

    def _live(self, rows: DataFrame, seen: list[dict]) -> DataFrame:
        """`rows` (key, segment, ...) without those that later segments found dead."""
        late = [s["segment"] for s in seen if s["dead"]]
        dead = self._find("dead", late)
        return rows if dead is None else rows.join(dead.select(self.key, F.col("of").alias("segment")), [self.key, "segment"], "left_anti")

    def _rows(self, seen: list[dict]) -> DataFrame | None:
        """Postings as they stand; the term "" stands once for each chunk, in bucket -1."""
        return self._find("postings", [s["segment"] for s in seen if s["adds"]])

    def _docs(self, seen: list[dict]) -> DataFrame | None:
        rows = self._rows(seen)
        return None if rows is None else rows.where("bucket = -1").select(self.key, "dl", "segment")

    def postings(self) -> DataFrame:
        """(key, term, tf, dl, block, segment, bucket) of all live chunks."""
        seen = self.segments()
        return self._live(self._rows(seen), seen).where("bucket >= 0")

    def chunks(self) -> DataFrame:
        """(key, dl, segment) of all live chunks, those without terms too."""
        seen = self.segments()
        return self._live(self._docs(seen), seen)

    def stats(self) -> DataFrame:
        """(n, avgdl): one row."""
        all_ = self.spark.read.parquet(f"{self.path}/stats").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
        return all_.select("n", (F.col("dl") / F.when(F.col("n") > 0, F.col("n"))).cast("double").alias("avgdl"))

    def terms(self, of: DataFrame | None = None) -> DataFrame:
        """(term, df); of those in `of` (term) alone."""
        held = self._find("terms", [s["segment"] for s in self.segments()])
        held = held if of is None else held.join(of, "term", "left_semi")
        return held.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    # changes
    def append(self, chunks: DataFrame, text: str = "text", segment: int | None = None) -> int:
        """Add a batch of chunks (key, text); one whose key is there already replaces it. The
        segment's number. Null keys can't be found again and are left out; of rows of one
        key in a batch one is taken, the greatest text."""
        one = unique(chunks, self.key, text)
        size = one.agg(F.sum(F.octet_length("_text")), F.count("*")).first()
        told = written(ranking.counted(one, self.key, "_text"), "counted")  # dealing by range reads it twice
        parts = max(1, size[1] // (8 * BLOCK_DOCS))  # of each class of length; most documents are of about eight
        kind = F.floor(F.log2(F.col("dl") + 1.0) * 2).cast("long")
        block = (F.shiftleft(kind, 40) + F.pmod(F.xxhash64(self.key), F.lit(parts))).alias("block")
        every = F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(1).alias("tf"))), F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))
        rows = told.select(self.key, "dl", block, F.explode(every).alias("_t")).select(self.key, "dl", "block", "_t.term", F.col("_t.tf").cast("long").alias("tf"))
        return self._add(rows, None, max(1, -(-(size[0] or 0) // BUCKET_BYTES)), segment)

    def delete(self, keys: DataFrame, segment: int | None = None) -> int:
        """Take the chunks of `keys` (key) out; keys that aren't there are passed over."""
        return self._add(None, keys.where(F.col(self.key).isNotNull()).select(self.key).distinct(), 1, segment)

    def _add(self, rows: DataFrame | None, docs: DataFrame | None, buckets: int, segment: int | None) -> int:
        seen = self.segments()
        at = segment if segment is not None else max((s["segment"] for s in seen), default=-1) + 1
        before = [s for s in seen if s["segment"] < at]
        number = "segment long, adds boolean, n long, dl long, buckets int, dead long"
        terms = None
        if rows is not None:
            order = [F.col("bucket"), F.col("term"), F.col(self.key)]
            put = rows.withColumn("bucket", self._bucket(buckets)).repartitionByRange(*order).sortWithinPartitions(*order)
            self._write(put, "postings", at, "bucket")
            held = self._find("postings", [at])
            held = rows.limit(0).withColumn("bucket", F.lit(0)) if held is None else held
            docs, held = held.where("bucket = -1").select(self.key, "dl"), held.where("bucket >= 0")
            terms = written(held.groupBy("term").agg(F.count("*").alias("df")).withColumn("bounded", F.col("df") >= BOUNDED), "terms")
            often = terms.where("bounded").select("term")
            self._write(held.join(often, "term").groupBy("term", "block").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.count("*").alias("n")), "bounds", at)
        gone, lost = 0, None
        old = self._docs(before)
        if old is not None:
            again = self._live(old, before).join(docs.select(self.key), self.key, "left_semi")
            self._write(again.select(self.key, F.col("segment").alias("of"), "dl"), "dead", at)
            dead = self._find("dead", [at])
            gone = dead.count()
            lost = dead.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()["dl"]
            if gone:
                stood = self._rows(before).where("bucket >= 0")
                took = stood.join(dead.select(self.key, F.col("of").alias("segment")), [self.key, "segment"], "left_semi")
                minus = took.groupBy("term").agg((-F.count("*")).alias("df")).withColumn("bounded", F.lit(None).cast("boolean"))
                terms = minus if terms is None else terms.unionByName(minus)
        if terms is None:
            terms = self.spark.createDataFrame([], "term string, df long, bounded boolean")
        self._write(terms.sort("term"), "terms", at)
        added = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first() if rows is not None else {"n": 0, "dl": 0}
        told = (at, rows is not None, added["n"] - gone, added["dl"] - (lost or 0), buckets, gone)
        one = self.spark.createDataFrame([told], number).coalesce(1)
        self._write(one.drop("segment"), "stats", at)
        return at

    def compact(self, path: str) -> "Bm25Index":
        """What is live as one segment of a new index in `path`; texts aren't needed."""
        new = type(self)(self.spark, path, self.key)
        seen = self.segments()
        rows = self._live(self._rows(seen), seen).select(self.key, "dl", "block", "term", "tf")
        new._add(rows, None, sum(s["buckets"] for s in seen if s["adds"]), 0)
        return new

    @staticmethod
    def _bucket(n: int) -> Column:
        return F.when(F.col("term") == "", -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(n))).cast("int")

    # queries
    def _asked(self, queries: DataFrame, query: str, question: str) -> DataFrame:
        """(query, term, weight) of the terms that the index has: their number times idf."""
        asked = ranking._asked(queries, query, question)
        asked = written(asked, "questions")  # whose few terms are sent to those of the index
        found = asked.join(self.terms(asked.select("term").distinct()), "term").join(F.broadcast(self.stats().select("n")))  # one row
        return written(found.select(query, "term", (F.col("qtf") * ranking.idf(F.col("n"), F.col("df"))).alias("weight")), "asked")

    def _held(self, asked: DataFrame) -> DataFrame | None:
        """Live postings of the asked terms, from the buckets of these alone."""
        seen = [s for s in self.segments() if s["adds"]]
        every = asked.select("term").distinct()
        parts = None
        for n in sorted({s["buckets"] for s in seen}):  # few: segments of like size have like numbers
            needed = every.withColumn("bucket", self._bucket(n))
            some = [r[0] for r in needed.select("bucket").distinct().collect()]  # at most n
            rows = self._find("postings", [s["segment"] for s in seen if s["buckets"] == n])
            if rows is not None and some:
                rows = rows.where(F.col("bucket").isin(some)).join(needed, ["bucket", "term"], "left_semi").drop("bucket")
                parts = rows if parts is None else parts.unionByName(rows)
        return None if parts is None else self._live(parts, self.segments())

    def _part(self, k1: float, b: float, tf: str = "tf", dl: str = "dl") -> Column:
        return F.col("weight") * gain(F.col(tf), F.col(dl), F.col("avgdl"), k1, b)

    def _none(self, queries: DataFrame, query: str) -> DataFrame:
        key = self._rows(self.segments())
        kind = key.schema[self.key].dataType.simpleString() if key is not None else "string"
        return queries.select(query).where("false").select(query, F.lit(None).cast(kind).alias(self.key), F.lit(0.0).alias("score"))

    def score(self, queries: DataFrame, query: str = "query_id", question: str = "question", k1: float = C.k1, b: float = C.b, k: int | None = None) -> DataFrame:
        """(query, key, score) of every live chunk that shares a term with a query, or with
        `k` of those that may be among its k best."""
        if not self.segments():
            return self._none(queries, query)
        asked = self._asked(queries, query, question)
        held = self._held(asked)
        if held is None:
            return self._none(queries, query)
        held = held.select(self.key, "term", "tf", "dl")
        if k is not None and ranking.sendable(asked, query):
            # one row a chunk, so that a chunk's postings meet all queries in one product
            terms = asked.select("term").distinct().toArrow()["term"].combine_chunks().cast(pa.string())
            place = self.spark.createDataFrame(pa.table({"term": terms, "place": pa.array(range(len(terms)), pa.int32())}))
            posting = F.struct("place", F.col("tf").cast("int").alias("tf"))
            rows = held.join(F.broadcast(place), "term").groupBy(self.key).agg(F.first("dl").alias("dl"), F.array_sort(F.collect_list(posting)).alias("_p"))
            rows = rows.select(self.key, "dl", F.col("_p.place").alias("terms"), F.col("_p.tf").alias("tfs"))
            got = asked.toArrow()
            of = pc.index_in(got["term"].combine_chunks().cast(pa.string()), value_set=terms).to_numpy()
            return ranking.products(rows, got[query].combine_chunks(), of, got["weight"].to_numpy(), len(terms), self.stats().first()["avgdl"] or 1.0, asked.schema[query].dataType, query, self.key, k1, b, k)
        weights = asked.join(F.broadcast(self.stats().select("avgdl")))  # one row
        held = held if k is None else written(held, "held")
        return ranking.summed(held, written(weights, "weights"), self._part(k1, b), query, self.key, k)

    def candidates(self, queries: DataFrame, k: int, query: str = "query_id", question: str = "question", k1: float = C.k1, b: float = C.b) -> DataFrame:
        """(query, key, score) of every chunk that may be among a query's k best, to six
        places, and of some others; `ranking.top` then picks the same k as from `score`.

        Postings of bounded terms stand in blocks that know their greatest tf and their
        least length, and so what they can add to a query. What a query's other terms and
        its most promising blocks give sets a bar, which its k-th score reaches in any
        case; blocks that stay below it are left out, except for chunks that the other
        terms found and that may still pass it."""
        seen = self.segments()
        if not seen:
            return self._none(queries, query)
        asked = self._asked(queries, query, question)
        held = self._held(asked)
        if held is None:
            return self._none(queries, query)
        held = written(held, "held")  # of the asked terms alone, where each step below would read whole buckets
        adding = [s["segment"] for s in seen if s["adds"]]
        one = F.broadcast(self.stats().select("avgdl"))
        place = ["segment", "block"]
        often = self._find("terms", adding).where("bounded").select("term", "segment").join(asked.select("term").distinct(), "term", "left_semi")
        often = written(often, "often")
        # what each block can add to a query at most
        bound = self._find("bounds", adding).join(asked, "term").join(one).groupBy(query, *place).agg(F.sum(self._part(k1, b, "max_tf", "min_dl")).alias("most"), F.max("n").alias("n"))
        bound = written(bound, "bound")
        # chunks found by terms with few postings: exact for those terms, a lower bound of the whole
        rare = held.join(often, ["term", "segment"], "left_anti").join(asked, "term").join(one)
        low = written(rare.groupBy(query, self.key, *place).agg(F.sum(self._part(k1, b)).alias("score")), "low")
        nth = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score")))
        kth = lambda df: df.withColumn("_n", nth).where(F.col("_n") == k).select(query, F.col("score").alias("bar"))
        before = F.sum("n").over(W.partitionBy(query).orderBy(F.desc("most"), *place).rowsBetween(W.unboundedPreceding, -1))
        seeds = bound.withColumn("_n", F.coalesce(before, F.lit(0))).where(F.col("_n") < SEEDS * k).select(query, *place)
        # few (term, block) are asked for by any query: postings are cut to them before queries are joined
        cut = lambda pairs: held.join(often, ["term", "segment"], "left_semi").join(
            written(pairs.join(asked.select(query, "term"), query).select("term", *place).distinct(), "wanted"), ["term", *place], "left_semi"
        )
        read = lambda rows, pairs, on: (  # noqa: E731  parts of bounded terms in some (query, block) or (query, key)
            rows.join(asked, "term").join(pairs, on, "left_semi").join(one).groupBy(query, self.key, *place).agg(F.sum(self._part(k1, b)).alias("score"))
        )
        seeds = written(seeds, "seeds")
        sown = read(cut(seeds), seeds, [query, *place]).unionByName(low).groupBy(query, self.key).agg(F.sum("score").alias("score"))
        bars = written(kth(sown), "bars")
        may = bound.join(bars, query, "left").where(F.coalesce(F.col("most") >= F.col("bar") - SLACK, F.lit(True)))
        may = written(may.select(query, *place), "may")
        left = low.join(bars, query, "left").join(bound, [query, *place], "left")
        hope = F.coalesce(F.col("score") + F.coalesce("most", F.lit(0.0)) >= F.col("bar") - SLACK, F.lit(True))
        left = written(left.where(hope).select(query, self.key, *place, "score"), "left")
        alone = left.join(may, [query, *place], "left_anti").select(query, self.key)
        rows = self.rows_read = written(cut(may.unionByName(left.select(query, *place))), "read")
        more = read(rows, may, [query, *place]).unionByName(read(rows, alone, [query, self.key]))
        return more.unionByName(left).groupBy(query, self.key).agg(F.sum("score").alias("score"))
