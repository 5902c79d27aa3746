"""Best-fit packing by the configuration linear program over the histogram of lengths.

Texts become token ids, an end id is added, and longer ones are cut into pieces. Only the histogram of piece lengths (at
most ``capacity`` rows, whatever the corpus) reaches the driver. There full pieces are sequences of their own, and the other
lengths are gathered in classes GRAIN wide, each as large as its mean length (few lengths are a class each). Over the classes the configuration LP (place
every class's pieces in as few sequences as can be) is approached by multiplicative weights: each round prices the best
pattern that fills a sequence with a knapsack dynamic program under the present weights, takes a step of it, and lowers the
weights of the classes it covers. Patterns are averaged over the rounds. The solution is rounded, carrying fractions on
from pattern to pattern; a pattern's classes become lengths that fill the sequence to the last token wherever the histogram still
has them. What is left is solved and rounded again, SOLVES times at most; the last few pieces are packed by exact subset
sums. ``Plan.from_lp`` tells how many sequences came from the LP. The plan is a table of (length, range of ranks) ->
sequence and offset; pieces are ranked within their length by salted numbering and look their place up.

One result row per piece; every text has at least one piece (an empty or null text: the end id alone). Rows that repeat are
packed each on its own, also those without a doc_id. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import number_within
from .scratch import Scratch
from .wordtokens import WORD_BPE, vocabulary_path, word_tokens

NAME = "op5_packing"
CAPACITY = 2048
END_ID = 0
#: Rounds of one solution of the LP, and solutions: of the whole, then of what rounding left.
ROUNDS, SOLVES = 400, 16
#: Width of a class of lengths, and tokens to a unit of the knapsack; each length is a class of its own where there are FEW.
GRAIN, UNIT, FEW = 16, 8, 64
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for batch in batches:
            done = 0
            for ids, off in tokens.encoded(batch.column("text"), end_id):
                n = np.diff(off)
                per = -(-n // capacity)
                text = np.repeat(np.arange(len(n)), per)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
                length = np.minimum(n[text] - piece * capacity, capacity)
                begin = off[text] + piece * capacity
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(done + text)),
                        "piece": pa.array(piece, pa.int32()),
                        "start": pa.array(piece * capacity, pa.int64()),
                        "length": pa.array(length, pa.int32()),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )
                done += len(n)

    return cut


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(vocabulary, capacity, end_id), PIECES)


@dataclass
class Pattern:
    """times sequences, each holding lengths[i] copies[i] times."""

    lengths: list[int]
    copies: list[int]
    times: int


@dataclass
class Plan:
    """Patterns that hold every piece exactly once; the first ``from_lp`` of their sequences came from rounded solutions of the LP."""

    patterns: list[Pattern]
    from_lp: int
    bound: int

    @property
    def sequences(self) -> int:
        return sum(p.times for p in self.patterns)


def _price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """Unbounded knapsack: the most valuable pattern that fills the capacity as far as any does, as {place in sizes: copies}."""
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    took = np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        if k := fits[c]:
            gain = best[c - sizes[:k]] + values[:k]
            i = int(gain.argmax())
            best[c], took[c] = gain[i], i
    found: dict[int, int] = {}
    c = int(np.flatnonzero(np.isfinite(best))[-1])
    while c > 0:
        i = int(took[c])
        found[i] = found.get(i, 0) + 1
        c -= int(sizes[i])
    return found


def configuration_lp(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = 1.0, step: float = 0.25) -> list[tuple[dict[int, int], float]]:
    """Patterns {place in sizes: copies} with fractional times that place no more than the counts.

    Weights begin at size / capacity. A round takes the pattern of the greatest weight as often as places ``step`` of one of
    its sizes, and lowers each covered size's weight by exp(-rate x the share placed). A size that is used up leaves the
    knapsack. Rounds end when nothing is left, or at ``rounds``.
    """
    weights, left = sizes / capacity, counts.astype(float)
    times: dict[tuple, float] = {}
    for _ in range(rounds):
        at = np.flatnonzero(left > 1e-9 * counts)
        found = _price(sizes[at], weights[at], capacity) if len(at) else {}
        if not found:
            break
        where, copies = at[list(found)], np.array(list(found.values()))
        n = min(step * (counts[where] / copies).min(), (left[where] / copies).min())
        left[where] -= n * copies
        weights[where] *= np.exp(-rate * n * copies / counts[where])
        key = tuple(sorted(zip(where.tolist(), copies.tolist(), strict=True)))
        times[key] = times.get(key, 0.0) + n
    return sorted(((dict(k), n) for k, n in times.items()), key=lambda x: -x[1])


def _fill(sizes: list[int], left: list[int], room: int) -> dict[int, int]:
    """Copies of sizes (descending places) that fill the room as far as they can: subset sums as bits of an integer."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    full = 1 << room
    for i, size in enumerate(sizes):
        if size > room or not left[i]:
            continue
        most, n = min(left[i], room // size), 1
        while most > 0:
            n = min(n, most)
            steps.append((i, n, reach))
            reach |= (reach << (size * n)) & mask
            most -= n
            n *= 2
        if reach & full:
            break
    at, found = reach.bit_length() - 1, {}
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            found[i] = found.get(i, 0) + n
            at -= n * sizes[i]
    return found


class _Classes:
    """The lengths that are left, by class."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.grain, self.unit = (1, 1) if len(histogram) <= FEW else (GRAIN, UNIT)
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n

    def sizes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per class with pieces: its number, its size in units (that of its mean length) and its pieces."""
        lengths = np.arange(self.capacity + 1)
        n = np.bincount(lengths // self.grain, self.left).astype(np.int64)
        tokens = np.bincount(lengths // self.grain, self.left * lengths)
        held = np.flatnonzero(n)
        size = np.maximum(np.rint(tokens[held] / n[held] / self.unit).astype(np.int64), 1)
        order = np.argsort(size, kind="stable")
        return held[order], size[order], n[held[order]]

    def _choose(self, classes: list[int], slack: int) -> dict[int, int] | None:
        """A length of each class, the plentiful first and the last one to fill the capacity but for ``slack`` tokens; None if there are none."""
        room, used = self.capacity, {}
        for k, c in enumerate(classes):
            low = c * self.grain
            here = self.left[low : low + self.grain].copy()
            for length, n in used.items():
                if low <= length < low + self.grain:
                    here[length - low] -= n
            fits = np.flatnonzero(here > 0)
            fits = fits[fits + low <= room]
            if not len(fits):
                return None
            last = k == len(classes) - 1
            if k >= len(classes) - 2 and not last:
                # The last but one leaves room that the last can fill exactly, if any does.
                other = classes[-1] * self.grain
                rest = room - low - fits - other
                exact = fits[(rest >= 0) & (rest < self.grain)]
                exact = exact[self.left[other + (room - low - exact - other)] > 0]
                fits = exact if len(exact) else fits
            length = low + int(fits[-1] if last else fits[here[fits].argmax()])
            used[length] = used.get(length, 0) + 1
            room -= length
        if room > slack or any(self.left[x] < n for x, n in used.items()):
            return None
        return used

    def place(self, classes: list[int], times: int, slack: int) -> list[Pattern]:
        """Sequences of a class of each, ``times`` at most; each step uses up a length or ends."""
        made = []
        while times > 0 and (used := self._choose(classes, slack)) is not None:
            n = min(times, *(int(self.left[x]) // k for x, k in used.items()))
            for x, k in used.items():
                self.left[x] -= n * k
            made.append(Pattern(list(used), list(used.values()), n))
            times -= n
        return made


def plan(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> Plan:
    """Patterns that hold every piece exactly once."""
    bound = -(-sum(k * n for k, n in histogram.items()) // capacity)
    made = [Pattern([capacity], [1], histogram[capacity])] if histogram.get(capacity) else []
    rest = _Classes({k: n for k, n in histogram.items() if k < capacity}, capacity)
    slack = 0
    for _ in range(SOLVES if rounds else 0):
        numbers, sizes, counts = rest.sizes()
        carried, before = 0.0, len(made)
        for pattern, times in configuration_lp(sizes, counts, capacity // rest.unit, rounds) if len(sizes) else []:
            carried += times
            if carried >= 1:
                classes = [int(numbers[i]) for i in sorted(pattern, reverse=True) for _ in range(pattern[i])]
                placed = rest.place(classes, int(carried), slack)
                carried -= sum(p.times for p in placed)
                carried = min(carried, 1.0 + times % 1)
                made += placed
        # Full sequences first; where no more can be made, room may be left, and more of it each time.
        slack = min(slack + 1, 2) if len(made) > before and slack <= 2 else min(8 * max(slack, 1), capacity)
    from_lp = sum(p.times for p in made)
    down = [int(x) for x in np.flatnonzero(rest.left)[::-1]]
    left = [int(rest.left[x]) for x in down]
    for i, size in enumerate(down):
        while left[i]:
            left[i] -= 1
            found = _fill(down, left, capacity - size)
            found[i] = found.get(i, 0) + 1
            left[i] += 1
            times = min(left[j] // n for j, n in found.items())
            for j, n in found.items():
                left[j] -= n * times
            made.append(Pattern([down[j] for j in found], list(found.values()), times))
    return Plan(made, from_lp, bound)


@dataclass
class Layout:
    """For each length the ranges of ranks and where they go; at most patterns x lengths rows."""

    low: dict[int, np.ndarray]
    rows: dict[int, np.ndarray]

    @staticmethod
    def of(patterns: list[Pattern]) -> "Layout":
        used: dict[int, int] = {}
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence = 0
        for p in patterns:
            offset = 0
            for length, copies in zip(p.lengths, p.copies, strict=True):
                low = used.get(length, 0)
                found.setdefault(length, []).append((low, sequence, copies, offset))
                used[length] = low + copies * p.times
                offset += length * copies
            sequence += p.times
        rows = {k: np.array(v, dtype=np.int64) for k, v in found.items()}
        return Layout({k: v[:, 0] for k, v in rows.items()}, rows)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            size = int(length[part[0]])
            low, first, copies, begin = self.rows[size][np.searchsorted(self.low[size], rank[part], side="right") - 1].T
            inside = rank[part] - low
            sequence[part], offset[part] = first + inside // copies, begin + inside % copies * size
        return sequence, offset


def _placed(layout):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = layout.value
        for batch in batches:
            sequence, offset = at.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            columns["length"] = columns["length"].cast(pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return placed


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = Scratch(spark, "packing").keep(pieces(docs, vocabulary or vocabulary_path(WORD_BPE), capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    layout = spark.sparkContext.broadcast(Layout.of(plan(histogram, capacity, rounds).patterns))
    ranked = number_within(cut, ["length"], ["doc_id", "piece"], ["doc_id", "piece", "ids_crc32"], "rank")
    return ranked.mapInArrow(_placed(layout), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
