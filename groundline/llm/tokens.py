"""Token ids of whole texts, through a bounded memory of word units.

Both vocabularies split a text before merging bytes, and never across a lone white
space. A text is therefore cut at those places, each distinct unit is encoded once by
the tokenizers library, and the units' ids are joined. Texts with white space in runs,
or with a string that the vocabulary has as an added token, are encoded whole. The ids
equal those of the library's plain call on the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What sends a text the whole way: white space in runs, at an end, or of other kinds, and the mark of a text's end.
_SPACES = "\\t\\v\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_ODD = f"[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z|[\\x01{_SPACES}]"
_STOP = "\x01"
#: Letters that stay one letter when normalized and lower-cased, so nothing joins them with a mark that follows.
_SAFE = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ɏЀ-ҁҊ-ԯ"
#: Letters that end in a safe one, then ASCII marks other than the apostrophe: never one unit for either vocabulary.
_CUT = re.compile(rf"(\r?[^\W\d_]*[{_SAFE}])([!-&(-/:-@\[-`{{-~]+)\Z")
_PLAIN = re.compile(rf"\r?[{_SAFE}]+\Z")
#: Units of a generation that a worker remembers (two are kept) and their characters; units encoded and words gathered at once.
_LIMIT, _CHARS, _LOT, _WORDS = 600_000, 32 << 20, 200, 200_000
_encoders: dict[tuple[str, int], "Encoder"] = {}


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _large(s: str) -> pa.Scalar:
    return pa.scalar(s, pa.large_string())


class _Rows:
    """Rows of ids of different length, one behind the other; grows by doubling."""

    def __init__(self) -> None:
        self.n, self.used = 0, 0
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append rows; the number of the first."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.n + len(sizes) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        first, at = self.n, self.used
        self.ids[at : at + len(ids)] = ids
        self.sizes[first : first + len(sizes)] = sizes
        self.starts[first : first + len(sizes)] = at + np.cumsum(sizes, dtype=np.int64) - sizes
        self.n, self.used = first + len(sizes), at + len(ids)
        return first

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The ids of `rows`, in their order."""
        n = self.sizes[rows]
        ends = np.cumsum(n, dtype=np.int64)
        return self.ids[np.repeat((self.starts[rows] - (ends - n)).astype(np.int32), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes each byte: printable ones as they are, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(shown)))}


class Encoder:
    """Each text's ids and an end id.

    A unit's first character tells how it stands: after a carriage return it begins a
    text or a line, any other unit follows a space. Where the vocabulary drops white
    space there is no difference. Units are remembered in two generations; when the
    newer is full it becomes the older, and what is met again comes back from there."""

    def __init__(self, path: str, spaces: bool, end_id: int = 0):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.spaces = spaces  # whether white space belongs to the ids
        added = "|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())
        self.odd = (_ODD if spaces else "\\x01") + (f"|{added}" if added else "")
        self.end, self.letters = end_id, _byte_letters()
        self.between, self.comma = ("\n", "\n") if spaces else (" ^ ", "^")
        self.mark = self._encode([self.comma])[0]
        self._open()
        self._open()

    def _open(self) -> None:
        """Begin a generation."""
        if hasattr(self, "memory"):
            self.older, self.older_rows = self.memory, self.rows
        self.memory, self.rows, self.chars = {}, _Rows(), 0
        for unit, ids in ((_STOP, [self.end]), ("\r" if self.spaces else "", []), ("\n", self.mark)):
            self.memory[unit] = self.rows.add(np.array(ids, "<u4"), np.array([len(ids)]))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, units: list[str], texts: list[str]) -> None:
        """Learn units of letters alone: one word to the vocabulary, merged by the model itself."""
        ids, sizes, tokenize, letters = [], [], self.model.tokenize, self.letters
        for t in texts:
            got = tokenize(t.encode().decode("latin-1").translate(letters))
            ids.extend([x.id for x in got])
            sizes.append(len(got))
        first = self.rows.add(np.array(ids, "<u4"), np.array(sizes, np.int32))
        self.memory.update(zip(units, range(first, self.rows.n)))

    def _others(self, units: list[str], texts: list[str]) -> None:
        """Learn any units: many in one text, told apart by an id that none of them has."""
        for i in range(0, len(units), _LOT):
            some, got = texts[i : i + _LOT], None
            if len(self.mark) == 1 and not any(self.comma in t for t in some):
                ids = self._encode([self.between.join(some)])[0]
                at = np.flatnonzero(ids == self.mark[0])
                if len(at) == len(some) - 1:
                    got = np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1
            if got is None:
                each = self._encode(some)
                got = np.concatenate(each), np.array(list(map(len, each)))
            first = self.rows.add(*got)
            self.memory.update(zip(units[i : i + _LOT], range(first, self.rows.n)))

    def _learn(self, new: list[str]) -> None:
        self.chars += sum(map(len, new))
        cut, left, right, plain, other = [], [], [], [], []
        for u in new:
            if m := _CUT.match(u):
                cut.append(u)
                left.append(m[1])
                right.append(m[2])
            elif _PLAIN.match(u) and (self.spaces or u[0] != "\r"):
                plain.append(u)
            else:
                other.append(u)
        text = (lambda u: u[1:] if u[0] == "\r" else " " + u) if self.spaces else str
        if self.spaces:
            self._letters(plain, list(map(text, plain)))
        elif plain:
            low = {u: u.lower() for u in plain}
            need = [x for x in set(low.values()) if x not in self.memory]
            self._letters(need, need)
            self.memory.update((u, self.memory[x]) for u, x in low.items())
        self._others(other, list(map(text, other)))
        if cut:
            self._find(list(set(left)))
            # a mark's row is kept under a name that no unit has, for in a text it would follow a space
            ends = [e for e in set(right) if "\r " + e not in self.memory]
            self._others(["\r " + e for e in ends], ends)
            memory = self.memory
            two = np.array([(memory[a], memory["\r " + b]) for a, b in zip(left, right)], np.int32)
            first = self.rows.add(self.rows.take(two.ravel()), self.rows.sizes[two].sum(1))
            memory.update(zip(cut, range(first, self.rows.n)))

    def _find(self, units: list[str]) -> np.ndarray:
        """The rows of distinct units; those not known are learned."""
        get = self.memory.get
        at = np.array([get(u, -1) for u in units], np.int32)
        if len(miss := np.flatnonzero(at < 0)):
            get = self.older.get
            old = np.array([get(units[i], -1) for i in miss.tolist()], np.int32)
            back = miss[old >= 0]
            first = self.rows.add(self.older_rows.take(old[old >= 0]), self.older_rows.sizes[old[old >= 0]])
            at[back] = np.arange(first, first + len(back))
            self.memory.update(zip([units[i] for i in back.tolist()], range(first, first + len(back))))
            new = miss[old < 0].tolist()
            self._learn([units[i] for i in new])
            at[new] = [self.memory[units[i]] for i in new]
        return at

    def _places(self, units: list[str]) -> np.ndarray:
        if len(self.memory) > _LIMIT or self.chars > _CHARS:
            self._open()
        return self._find(units)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of `texts`, one text behind the other, and where each text's ids end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        whole, size = np.flatnonzero(odd), np.zeros(len(texts), np.int64)
        alone = [np.append(x, np.uint32(self.end)) for x in self._encode(texts.take(pa.array(whole)).to_pylist())]
        size[whole] = list(map(len, alone))
        some = texts.filter(pa.array(~odd)) if len(whole) else texts
        if self.spaces:
            some = pc.binary_join_element_wise(_large("\r"), pc.replace_substring(some, "\n", " \n \r"), _large(""))
        else:
            some = pc.replace_substring(some, "\n", " ")
        split = pc.split_pattern(pc.binary_join_element_wise(some, _large(_STOP), _large(" ")), " ")
        coded = split.values.dictionary_encode()
        rows = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        ends = split.offsets.to_numpy()
        before = np.concatenate(([0], np.cumsum(self.rows.sizes[rows], dtype=np.int64)))[ends - ends[0]]
        size[~odd] = np.diff(before)
        plain = [self.rows.take(rows[i : i + _WORDS]) for i in range(0, len(rows), _WORDS)]
        ids = np.concatenate(plain) if plain else np.zeros(0, "<u4")
        if len(whole):  # put them in their places
            cuts = before[whole - np.arange(len(whole))]
            parts = [x for a, b, own in zip([0, *cuts.tolist()], cuts.tolist(), alone) for x in (ids[a:b], own)]
            ids = np.concatenate([*parts, ids[cuts[-1] :]])
        return ids, np.cumsum(size)


def encoder(path: str, spaces: bool, end_id: int = 0) -> Encoder:
    """One encoder a Python worker."""
    if (path, end_id) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, end_id] = Encoder(path, spaces, end_id)
    return _encoders[path, end_id]
