"""Text expressions: tokens, cleaning, numbers, citation tags. All run in the JVM; for
tables of postings `split_tokens` finds the same tokens in Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words that ranking, gating and citation checks leave out.
STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both
but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had
hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd
i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once
only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such
than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this
those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's
where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours
yourself yourselves
""".split()
# Words of a question that don't count when its key sentences are chosen.
QUESTION_WORDS = "what is the a an of in on at to for with and or are was were be been by from how".split()
# Opposite words, metric words, numbers with units, and a citation tag.
OPPOSITES = [
    ("approved", "rejected"), ("success", "failed"), ("compliant", "non-compliant"), ("decreased", "increased"),
    ("growth", "decline"), ("mandatory", "optional"), ("supported", "unsupported"), ("deprecated", "active"),
    ("true", "false"), ("enabled", "disabled"),
]
METRICS = ["target", "reduction", "emissions", "budget", "revenue", "ebitda", "latency", "sla", "sla limit"]
NUMBER = r"(?i)(\$?[0-9]+(?:\.[0-9]+)?\s*(?:%|billion|million|bn|mn|ms|percent)?)"
CITATION = (
    r"\[Doc:\s*([^,\]]+?)(?:,\s*p\.\s*([0-9]+))?(?:,\s*(?:§|sec|section)?\s*([^\|\]]+?))?\s*\|\s*(?:chunk:\s*)?([a-zA-Z0-9_\-]+)\]"
)


def let(value: Column, body) -> Column:
    """`body(value)` with the value worked out once, wherever the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends, of every kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Number of tokens between white space."""
    return F.regexp_count(c, F.lit(r"\S+"))


def plain(c: Column) -> Column:
    """Lower case in ASCII alone: letters and digits beyond it are Z, everything else
    beyond it a gap."""
    low = F.lower(c)
    mixed = F.regexp_replace(F.regexp_replace(low, r"[^\x00-\x7F\p{L}\p{N}]", " "), r"[^\x00-\x7F]", "Z")
    return F.when(F.octet_length(c) == F.length(c), low).otherwise(mixed)  # of ASCII alone there is nothing to replace


def token_pattern(least: int) -> str:
    return rf"\b[a-z0-9_\-\.]{{{least},}}\b"


def tokens(c: Column, least: int = 2) -> Column:
    """Lower-case tokens of at least `least` word characters, without stop words.

    Letters and digits beyond ASCII count as word characters that end a token, and
    everything else as a gap, so that the JVM, Python and RE2 agree."""
    found = F.regexp_extract_all(plain(c), F.lit(token_pattern(least)), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


# What `plain` leaves of a token, and Z; each other byte is a gap.
_RUNS = bytes(x if chr(x) in "abcdefghijklmnopqrstuvwxyz0123456789_-.Z" else 32 for x in range(256))


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What `tokens` finds in texts that `plain` made (strings, none null), for many at
    once: distinct tokens, and per token, in any order, which it is and its text.

    A run of a token's characters is one token without the dashes and dots at its ends;
    only in runs with a Z, of which each distinct one is looked at once, the pattern
    itself has to tell."""
    texts = texts.cast(pa.string())
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes().translate(_RUNS) if at[-1] > at[0] else b""
    runs = pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(data)), " ")
    row = np.repeat(np.arange(len(texts)), np.diff(runs.offsets.to_numpy()))
    coded = runs.flatten().dictionary_encode()
    which, names = coded.indices.to_numpy(), coded.dictionary
    bare = pc.ascii_trim(names, characters="-.")
    mixed = pc.match_substring(names, "Z").to_numpy(zero_copy_only=False)
    n = (pc.binary_length(bare).to_numpy() >= 2) & ~mixed
    more = [re.findall(token_pattern(2), x) for x in names.filter(pa.array(mixed)).to_pylist()]
    n = n.astype(np.int64)
    n[mixed] = [len(x) for x in more]
    of = np.repeat(np.arange(len(names)), n)  # the run of each token of a distinct run
    found = pc.replace_with_mask(bare.take(pa.array(of)), pa.array(mixed[of]), pa.array([t for x in more for t in x], pa.string()))
    found = found.dictionary_encode()
    token, first, size = found.indices.to_numpy(), np.cumsum(n) - n, n[which]
    on = np.repeat(first[which], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    which, row = token[on], np.repeat(row, size)
    said = ~pc.is_in(found.dictionary, value_set=pa.array(STOPWORDS)).to_numpy(zero_copy_only=False)
    return found.dictionary, which[said[which]], row[said[which]]


def numbers(c: Column) -> Column:
    """Distinct numbers with their units, white space after them included."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(NUMBER), F.lit(1)))


def contained(terms: Column, text: Column) -> Column:
    """Those terms that `text` contains anywhere."""
    return F.filter(terms, lambda t: F.contains(text, t))


def clean(c: Column) -> Column:
    """Without symbols beyond ASCII (bullets stay), runs of white space, and lines of
    five letters or fewer."""
    c = F.regexp_replace(c, r"[^\x00-\x7F▸►•→←↑↓]", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[▸►→←↑↓]", " "), r"\s{2,}", " ")
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: F.length(F.regexp_replace(x, "[^a-zA-Z]", "")) > 5)
    return strip(F.array_join(lines, " "))


def bag(c: Column) -> Column:
    """Distinct lower-case words without punctuation."""
    plain = strip(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""))
    return F.array_distinct(F.filter(F.split(plain, r"(?U)\s+"), lambda w: w != ""))


def key_sentences(text: Column, question: Column, most: int = 2) -> Column:
    """The `most` sentences that share most words with the question, in text order; the
    start of the text where it has no sentence of more than 25 characters."""
    asked = F.array_except(bag(question), F.array(*map(F.lit, QUESTION_WORDS)))
    split = lambda c: F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) > 25)

    def ranked(q: Column, parts: Column) -> Column:
        return F.transform(parts, lambda s, i: F.struct((-F.size(F.array_intersect(q, bag(s)))).alias("o"), i.alias("i"), s.alias("s")))

    def pick(parts: Column, order: Column) -> Column:
        best = F.transform(F.slice(F.array_sort(order), 1, most), lambda x: x["s"])
        kept = let(best, lambda b: F.filter(parts, lambda s: F.array_contains(b, s)))
        return F.array_join(F.slice(kept, 1, most), " ")

    def of(cleaned: Column, parts: Column, q: Column) -> Column:
        return F.when(F.size(parts) == 0, F.substring(cleaned, 1, 300)).otherwise(pick(parts, ranked(q, parts)))

    return let(clean(text), lambda c: let(split(c), lambda p: let(asked, lambda q: of(c, p, q))))
