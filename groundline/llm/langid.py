"""Operator 8: language identification by word-first backoff.

A word that training knows scores its log frequency in each language; an unseen word
falls back to the mean over its character n-grams of the longest length of which any
is known. A text's score is the mean over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_arrow, tuned

#: Documents a language that the model is fitted on, and its longest n-grams.
FIT_DOCS, LONGEST = 1000, 4
UNKNOWN, EVIDENCE = "und", 20
_LETTERS = re.compile(r"[^\W\d_]+")
_MEMORY = 400_000
_FIT = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("unit", pa.string()), ("n", pa.int64())])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def grams(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """langs; units: per kind (0 words, n character n-grams) a unit's row in `rows`."""

    langs: list[str]
    units: list[dict[str, int]]
    rows: np.ndarray

    @classmethod
    def of(cls, langs: list[str], counts: list[dict[str, np.ndarray]]) -> "Model":
        """counts: per kind unit -> counts by language; add-half smoothing."""
        units, rows = [], [np.zeros((0, len(langs)), np.float32)]
        start = 0
        for kind in counts:
            units.append({u: start + i for i, u in enumerate(kind)})
            start += len(kind)
            if kind:
                c = np.stack(list(kind.values())).astype(np.float64)
                rows.append(np.log((c + 0.5) / (c.sum(0) + 0.5 * (len(c) + 1))).astype(np.float32))
        return cls(langs, units, np.concatenate(rows))

    def word(self, word: str) -> list[int]:
        """Rows whose mean is a word's score; none if nothing of it is known."""
        if (k := self.units[0].get(word)) is not None:
            return [k]
        for n in range(len(self.units) - 1, 0, -1):
            if got := [k for g in grams(word, n) if (k := self.units[n].get(g)) is not None]:
                return got
        return []


class Scorer:
    """Scores texts; remembers the vectors of tokens between batches."""

    def __init__(self, model: Model):
        self.model, self.memory = model, {}
        self.table = np.zeros((0, len(model.langs) + 1))

    def _learn(self, tokens: set[str]) -> None:
        if len(self.memory) > _MEMORY:
            self.memory, self.table = {}, self.table[:0]
        new = list(tokens.difference(self.memory))
        table = np.zeros((len(new), len(self.model.langs) + 1))
        flat, at, size = [], [], []
        for i, token in enumerate(new):
            words = _LETTERS.findall(token)
            table[i, -1] = len(words)
            for w in words:
                if rows := self.model.word(w):
                    flat.extend(rows)
                    at.append(i)
                    size.append(len(rows))
        if flat:
            starts = np.concatenate(([0], np.cumsum(size[:-1])))
            means = np.add.reduceat(self.model.rows[flat], starts, axis=0) / np.array(size)[:, None]
            np.add.at(table[:, :-1], at, means)
        base = len(self.table)
        self.table = np.concatenate((self.table, table))
        self.memory.update(zip(new, range(base, base + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [(t or "").lower().split() for t in texts]
        self._learn({w for words in split for w in words})
        get, langs, out, scores = self.memory.__getitem__, self.model.langs, [], []
        for words in split:
            s = self.table[list(map(get, words))].sum(0) if words else np.zeros(len(langs) + 1)
            if not langs or not s[-1]:
                out.append(UNKNOWN)
                scores.append(0.0)
                continue
            mean = s[:-1] / s[-1] * min(s[-1], EVIDENCE)
            p = np.exp(mean - mean.max())
            k = int(np.argmax(p))
            out.append(langs[k])
            scores.append(float(p[k] / p.sum()))
        return out, scores


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fit on documents that are not held out and have a language.

    At most about `fit_docs` documents a language are read, chosen by a hash of id and
    text, so that rows that share an id are drawn each by itself; their whole texts count, and every language, word and n-gram in them is learned.
    That sample is the only bound, and with it the model's size.
    """
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = train.groupBy("lang").agg(F.count("*").alias("n")).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model.of([], [{} for _ in range(LONGEST + 1)])
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, fit_docs / r["n"]))))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    some = train.where(draw < share[F.col("lang")]).select("lang", "text")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            by: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(_LETTERS.findall((text or "").lower()))
            for lang, words in by.items():
                for kind in range(LONGEST + 1):
                    c = words
                    if kind:
                        c = Counter()
                        for w, n in words.items():
                            for g in grams(w, kind):
                                c[g] += n
                    yield as_arrow({"lang": [lang] * len(c), "kind": [kind] * len(c), "unit": list(c), "n": list(c.values())}, _FIT)

    rows = (
        some.mapInArrow(count, "lang string, kind int, unit string, n long")
        .groupBy("lang", "kind", "unit")
        .agg(F.sum("n").alias("n"))
        .toArrow()
        .sort_by([("kind", "ascending"), ("unit", "ascending"), ("lang", "ascending")])
    )
    counts: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
    of = {x: i for i, x in enumerate(langs)}
    for lang, kind, unit, n in zip(*(rows[c].to_pylist() for c in ("lang", "kind", "unit", "n")), strict=True):
        held = counts[kind].get(unit)
        if held is None:
            held = counts[kind][unit] = np.zeros(len(langs))
        held[of[lang]] = n
    return Model.of(langs, counts)


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` with lang_pred and score; only `text` is looked at.

    Null texts and texts without letters: `und`, 0. `docs` must have no column of either
    name. Every text is read whole."""
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # as large as its bounded sample makes it
    if taken := {"lang_pred", "score"}.intersection(docs.columns):
        raise ValueError(f"columns {sorted(taken)} would be replaced")
    base = docs
    at = base.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in it:
            langs, scores = scorer.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"]
            )

    return base.mapInArrow(run, T.StructType([*base.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. Repeated rows are scored
    each; a null doc_id is neither held out nor trained on. Empty input: no rows."""
    tuned(docs.sparkSession)
    seen = with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, fit_docs))
    return seen.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
