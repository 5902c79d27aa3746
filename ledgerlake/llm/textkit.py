"""Vectorised words, word hashes and window hashes of Arrow text columns.

A chunk is a run of whole texts of an Arrow batch. Hashes are polynomial over the bytes (or words) modulo 2^64 with odd
multipliers, taken from prefix sums, then mixed; they depend on content alone, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
BLANKS = b" \t\n\x0b\x0c\r"


def _odd_inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, _odd_inverse(base)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            grow = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Rule:
    """Which bytes belong to words, and the value that each byte has in a hash."""

    inside: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(outside: set[int], fold_case: bool) -> "Rule":
        inside = np.array([b not in outside for b in range(256)])
        values = stream(7, 256)
        if fold_case:
            values[65:91] = values[97:123]
        return Rule(inside, values)


#: Words are runs of anything but ASCII blanks.
BLANK_SEPARATED = Rule.of(set(BLANKS), fold_case=False)
BLANK_SEPARATED_FOLDED = Rule.of(set(BLANKS), fold_case=True)
#: Words are runs of ASCII digits, ASCII letters (case folded) and anything beyond ASCII.
ALPHANUMERIC_FOLDED = Rule.of(set(range(128)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)), fold_case=True)


@dataclass
class Chunk:
    """Whole texts lo..hi of a batch: their bytes and the place where each begins."""

    lo: int
    hi: int
    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column in runs of about ``limit`` bytes; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


@dataclass
class Words:
    """The words of a chunk in order. ``first[d] .. first[d+1]`` are those of its text d."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(chunk: Chunk, rule: Rule) -> Words:
    buf, off = chunk.buf, chunk.off
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(off), np.int64), np.zeros(0, np.uint64))
    inside = rule.inside[buf]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = off[:-1][off[:-1] < len(buf)]
    starts[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > 0] - 1
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _BYTE_POWERS.of(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(rule.values[buf] * up[: len(buf)], out=total[1:])
    return Words(s, e, np.searchsorted(s, off), mix((total[e] - total[s]) * down[s]))


def spans_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the word sequence start..end for each pair of places."""
    up, down = _WORD_POWERS.of(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` words inside one text, and where each text's windows begin."""
    per = np.maximum(np.diff(first) - width + 1, 0)
    begin = np.concatenate([[0], np.cumsum(per)])
    return np.arange(begin[-1]) - np.repeat(begin[:-1], per) + np.repeat(first[:-1], per), begin


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` neighbours, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``width`` that begins at one of the starts."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + width, n), -1)
    return np.cumsum(mark[:-1]) > 0
