"""Token ids of the word BPE, unit by unit.

The vocabulary's pre-tokeniser never joins characters across ASCII blanks, so a text's ids are those of its blank-separated
words in order. A word of ASCII and Latin-1 letters is cut further as the pre-tokeniser cuts it, into runs of letters, single
digits and runs of signs. Words in which that could go wrong stay whole: those with an apostrophe (contractions), a control
character, a special string's opening or anything else beyond ASCII. Only the case of ASCII letters in words that are cut is
folded here; the rest is left to the library, as its normaliser composes characters before it folds case. Each worker keeps the ids of the units it has met in
sorted arrays, by a 64-bit hash, and only new units are encoded. Units over LONGEST bytes are encoded wherever they occur.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa

from . import textkit as K

WORD_BPE = "word_bpe_49k.json"
#: Units that a worker remembers before it begins anew; this bounds its memory (about 36 bytes each).
REMEMBERED = 1 << 20
#: Bytes of a unit that is remembered.
LONGEST = 64
#: Signs that the vocabulary splits from a word of letters before them, as one token sequence of their own.
TAIL = b".,!?;:*$%&#|"
#: Bytes of texts that are looked up at a time.
GROUP_BYTES = 4 << 20

_BLANK, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[:32] = _CLASS[127:] = _WHOLE
_CLASS[39] = _WHOLE
_CLASS[list(K.BLANKS)] = _BLANK
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT


def vocabulary_path(name: str = WORD_BPE) -> str:
    return public_tokenizers.path(name)


def vocabulary_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with the case of plain letters folded, the edges of all units of texts that begin at ``off``, and which are runs of letters."""
    kind = _CLASS[buf]
    kind[np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))] = _WHOLE
    # U+00C0 to U+00FF but for the two signs among them: letters that compose with nothing.
    latin = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7))
    kind[latin] = kind[latin + 1] = _LETTER
    word = kind != _BLANK
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    cuts = off[:-1][off[:-1] < len(buf)]
    starts[cuts] = word[cuts]
    # A word with a byte that must not be cut at is whole.
    number = np.cumsum(starts) - 1
    whole = np.zeros(int(number[-1]) + 2, bool)
    whole[number[kind == _WHOLE]] = True
    inside = word & whole[number]
    kind[inside] = _WHOLE
    folded = buf.copy()
    upper = (buf >= 65) & (buf <= 90) & ~inside
    folded[upper] |= 32
    begins = starts.copy()
    begins[1:] |= word[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    ends = np.zeros(len(buf), bool)
    ends[:-1] = word[:-1] & (begins[1:] | ~word[1:])
    ends[-1] = word[-1]
    start = np.flatnonzero(begins)
    return folded, start, np.flatnonzero(ends) + 1, kind[start] == _LETTER


class WordTokens:
    """Ids of texts; what it has encoded once it remembers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        #: Sorted hashes of known units; where each one's ids begin in ``ids``, and how many they are.
        self.keys, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of words of letters, encoded many at a time and cut where a token ends a word."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            made = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[made]) + 1
            if len(ends) == len(part):
                ids.append(made)
                sizes.append(np.diff(ends, prepend=0))
            else:
                for x in self._singly([w.encode() for w in part]):
                    ids.append(x)
                    sizes.append(np.array([len(x)]))
        return np.concatenate(ids), np.concatenate(sizes)

    def _singly(self, units: list[bytes]) -> list[np.ndarray]:
        made = []
        for at in range(0, len(units), 4096):
            made += [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([u.decode() for u in units[at : at + 4096]], add_special_tokens=False)]
        return made

    def _encode(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of any units: letters beyond ASCII many at a time, signs behind them apart, all others one by one."""
        cores: dict[bytes, str] = {}
        for unit in units:
            core = unit.rstrip(TAIL)
            text = core.decode()
            if text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha():
                cores[unit] = text
        letters = list(dict.fromkeys(cores.values()))
        ids, sizes = self._joined(letters)
        known = dict(zip(letters, np.split(ids, np.cumsum(sizes)[:-1]), strict=True)) if letters else {}
        rest = list({u.removeprefix(cores[u].encode()) if u in cores else u for u in units} - {b""})
        made = dict(zip(rest, self._singly(rest), strict=True))
        made[b""] = np.zeros(0, np.uint32)
        return [np.concatenate([known[cores[u]], made[u.removeprefix(cores[u].encode())]]) if u in cores else made[u] for u in units]

    def _learn(self, keys: np.ndarray, units: list[bytes], plain: np.ndarray) -> None:
        """Learns new units, whose keys rise; ``plain`` says which are runs of letters."""
        odd = self._encode([units[i] for i in np.flatnonzero(~plain)])
        ids, sizes = self._joined([units[i].decode() for i in np.flatnonzero(plain)])
        size = np.empty(len(units), np.int64)
        size[plain], size[~plain] = sizes, [len(x) for x in odd]
        begin = np.empty(len(units), np.int64)
        begin[plain] = len(self.ids) + np.cumsum(sizes) - sizes
        begin[~plain] = len(self.ids) + len(ids) + np.cumsum(size[~plain]) - size[~plain]
        self.ids = np.concatenate([self.ids, ids, *odd])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _located(self, chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per unit of the chunk: where its ids begin, how many they are; where each text's units begin; and the array of ids."""
        if not len(chunk.buf):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(chunk.off), np.int64), self.ids
        buf, start, end, letters = _units(chunk.buf, chunk.off)
        first = np.searchsorted(start, chunk.off)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), first, self.ids
        keys, one, code = np.unique(K.spans_hash(K.BLANK_SEPARATED.values[buf], start, end), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        long = (end - start)[one] > LONGEST
        known = self._places(keys)
        new = np.flatnonzero((known < 0) & ~long)
        if len(self.keys) + len(new) > REMEMBERED:
            self._forget()
            new = np.flatnonzero(~long)
        if len(new):
            spots = zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)
            self._learn(keys[new], [raw[a:b] for a, b in spots], letters[one[new]])
            known = self._places(keys)
        begin, size, ids = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), self.ids
        begin[~long], size[~long] = self.begin[known[~long]], self.size[known[~long]]
        begin, size = begin[code], size[code]
        if long.any():
            # By content, not by hash.
            at = np.flatnonzero(end - start > LONGEST)
            units = [raw[start[i] : end[i]] for i in at]
            distinct = list(dict.fromkeys(units))
            made = dict(zip(distinct, self._encode(distinct), strict=True))
            begins = dict(zip(distinct, len(ids) + np.cumsum([0, *(len(made[u]) for u in distinct[:-1])]), strict=True))
            begin[at], size[at] = [begins[u] for u in units], [len(made[u]) for u in units]
            ids = np.concatenate([ids, *made.values()])
        return begin, size, first, ids

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        parts = [np.zeros(0, np.int64)]
        for chunk in K.chunks(texts, GROUP_BYTES):
            _, size, first, _ = self._located(chunk)
            total = np.concatenate([[0], np.cumsum(size)])
            parts.append(total[first[1:]] - total[first[:-1]])
        return np.concatenate(parts)

    def encoded(self, texts: pa.Array, end_id: int):
        """For each run of texts: their ids with end_id behind each text, and where each text's ids begin."""
        for chunk in K.chunks(texts, GROUP_BYTES):
            begin, size, first, ids = self._located(chunk)
            # The end of a text is a unit of one id.
            at = first[1:] + np.arange(len(chunk))
            units = np.ones(len(begin) + len(chunk), bool)
            units[at] = False
            begins, sizes = np.full(len(units), len(ids)), np.ones(len(units), np.int64)
            begins[units], sizes[units] = begin, size
            total = np.concatenate([[0], np.cumsum(sizes)])
            places = np.repeat(begins - total[:-1], sizes) + np.arange(total[-1])
            yield np.append(ids, np.uint32(end_id))[places], total[np.concatenate([[0], at + 1])]


_OPEN: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process and file: what a task has learned serves the next."""
    if path not in _OPEN:
        _OPEN[path] = WordTokens(path)
    return _OPEN[path]


def as_bytes(column) -> list[bytes]:
    """An Arrow text column as bytes objects; a null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
