"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores postings of the training texts: one row per segment (a run of texts of about a megabyte) with its
texts' ids and lengths, its sorted terms, and for each term the places where it occurs, counted through the segment. Only
terms that may occur in the test items are stored; a bitmap of fixed size says which, and its false positives merely store
a little more. Test items are hashed by the workers too and come back in blocks of BLOCK_WORDS words, so most benchmarks are
one block; each block is sent to the workers and searched in one pass over the index.

For each distinct window of a block the search starts from the postings of its rarest term in the whole corpus, shifts them to
where the window would begin, and intersects them with the shifted postings of the other terms, rarer ones first. A window is
near where all its terms stand, in any order, in NEAR words of one text: the same postings, with ranges for places.
Candidates are taken SLICE at a time, so a term that is everywhere costs time but no memory. Segments are
searched where they lie: no posting is shuffled, so a term or passage that is everywhere makes no hot key.

Words: A-Z lower-cased, runs of [0-9a-z] and of anything beyond ASCII. Null or wordless texts have no words and no hits; a
wordless item is ignored. A null item id is the empty string. Rows that repeat are judged each by itself, also those
without a key. Other columns are ignored. Empty tables give empty or hitless results. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import Scratch

NAME = "op2_decontamination"
WIDTH = 13
#: Words among which all of a window's words stand where it is near.
NEAR = 26
#: Words of test items in one block; bounds what is sent to the workers at a time (about 50 bytes a word).
BLOCK_WORDS = 1 << 20
#: Candidates (a window and a posting of its rarest term) that are looked at together.
SLICE = 1 << 20
BITMAP_BITS = 24
ITEMS = "item string, words binary"
INDEX = "segment long, doc_ids array<long>, n_words array<int>, terms array<long>, counts array<int>, postings binary"
MATCHES = "segment long, place int, key long, n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>, near_ids array<string>, n_windows long"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("item")
        for chunk in K.chunks(batch.column("text")):
            w = K.words(chunk, K.ALPHANUMERIC_FOLDED)
            some = np.flatnonzero(w.counts())
            data = [w.hash[w.first[d] : w.first[d + 1]].tobytes() for d in some]
            yield pa.RecordBatch.from_pydict({"item": names.take(pa.array(chunk.lo + some)), "words": pa.array(data, pa.binary())})


def hashed_items(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Items that have words: (item, words as 64-bit hashes)."""
    return items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).mapInArrow(_hashed, ITEMS)


def item_blocks(hashed: DataFrame, width: int = WIDTH, words: int = BLOCK_WORDS) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Items in blocks of about ``words`` words. A longer item is cut into parts that share width - 1 words, so no window is lost."""
    names, parts, size = [], [], 0
    for row in hashed.toLocalIterator():
        found = np.frombuffer(row["words"], np.uint64)
        for at in range(0, max(len(found) - width + 1, 1), words):
            part = found[at : at + words + width - 1]
            names.append(row["item"])
            parts.append(part)
            size += len(part)
            if size >= words:
                yield names, parts
                names, parts, size = [], [], 0
    if names:
        yield names, parts


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = _bits(np.unique(np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64)))
        word, first = np.unique(bits >> 6, return_index=True)
        mask = np.bitwise_or.reduceat(np.uint64(1) << (bits & 63).astype(np.uint64), first) if len(bits) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_pydict({"word": pa.array(word), "mask": pa.array(mask.view(np.int64))})


def _bitmap(hashed: DataFrame) -> np.ndarray:
    """2 ** BITMAP_BITS flags, packed: the terms that items have."""
    found = hashed.select("words").mapInArrow(_marked, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2 ** 18 rows
    packed = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    packed[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return packed.view(np.uint8)


def _indexer(bitmap):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bitmap.value, bitorder="little").view(bool)
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("_key")
            for chunk in K.chunks(batch.column("text")):
                w = K.words(chunk, K.ALPHANUMERIC_FOLDED)
                at = np.flatnonzero(wanted[_bits(w.hash)])
                order = at[np.argsort(w.hash[at], kind="stable")]
                terms, counts = np.unique(w.hash[order], return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array([segment], pa.int64()),
                        "doc_ids": pa.array([ids.slice(chunk.lo, len(chunk)).to_pylist()], pa.list_(pa.int64())),
                        "n_words": pa.array([w.counts().astype(np.int32)], pa.list_(pa.int32())),
                        "terms": pa.array([terms.view(np.int64)], pa.list_(pa.int64())),
                        "counts": pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                        "postings": pa.array([order.astype(np.uint32).tobytes()], pa.binary()),
                    }
                )
                segment += 1

    return index


def build_index(docs: DataFrame, hashed: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of the texts, over the terms of the hashed items."""
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(hashed))
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("text"))
    return scratch.keep(rows.mapInArrow(_indexer(sent), INDEX), "index")


@dataclass
class Windows:
    """The distinct windows of a block. Window w has the words codes[start[w] + order[w, k]] (places in ``terms``), rarest first;
    a shorter one repeats its last. Its items are owners[owned[w] : owned[w + 1]]."""

    items: list[str]
    terms: np.ndarray
    codes: np.ndarray
    start: np.ndarray
    width: np.ndarray
    order: np.ndarray
    owners: np.ndarray
    owned: np.ndarray


def _frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the block's terms occurs in the whole corpus."""
    wanted = index.sparkSession.createDataFrame(pa.table({"term": pa.array(terms.view(np.int64))}))
    counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n"))
    found = counts.join(wanted, "term").toArrow()  # at most a block's distinct terms
    n = np.zeros(len(terms), np.int64)
    n[np.searchsorted(terms, found.column("term").to_numpy().view(np.uint64))] = found.column("n").to_numpy()
    return n


def windows_of(block: tuple[list[str], list[np.ndarray]], index: DataFrame, width: int = WIDTH) -> Windows:
    names, parts = block
    hashes, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
    items, name = np.unique(np.array(names, object), return_inverse=True)
    per = np.maximum(sizes - width + 1, 1)
    start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(np.cumsum(sizes) - sizes, per)
    wide, item = np.repeat(np.minimum(sizes, width), per), np.repeat(name, per)
    _, one, content = np.unique(K.spans_hash(hashes, start, start + wide), return_index=True, return_inverse=True)
    pairs = np.unique(content * len(items) + item)
    start, wide = start[one], wide[one]
    terms, codes = np.unique(hashes, return_inverse=True)
    steps = np.minimum(np.arange(width)[None, :], wide[:, None] - 1)
    n = _frequencies(index, terms)[codes]
    order = np.take_along_axis(steps, np.argsort(n[start[:, None] + steps], axis=1, kind="stable"), 1)
    owned = np.searchsorted(pairs // len(items), np.arange(len(one) + 1))
    return Windows(items.tolist(), terms, codes.astype(np.int32), start.astype(np.int32), wide.astype(np.int32), order.astype(np.int16), (pairs % len(items)).astype(np.int32), owned)


class _Segment:
    """A row of the index, opened for the search of a block."""

    def __init__(self, row: dict, block_terms: np.ndarray):
        terms = np.asarray(row["terms"], np.int64).view(np.uint64)
        counts = np.asarray(row["counts"], np.int64)
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        begin = np.cumsum(counts) - counts
        places = np.frombuffer(row["postings"], np.uint32).astype(np.int64)
        #: Per term of the block: where its postings begin, and how many they are.
        self.begin, self.count = np.zeros(len(block_terms), np.int64), np.zeros(len(block_terms), np.int64)
        if len(terms) and len(block_terms):
            at = np.minimum(np.searchsorted(block_terms, terms), len(block_terms) - 1)
            held = block_terms[at] == terms
            self.begin[at[held]], self.count[at[held]] = begin[held], counts[held]
            # Postings as one sorted list: a term's own places, its number in the segment above them.
            self.number = np.full(len(block_terms), -1, np.int64)
            self.number[at[held]] = np.flatnonzero(held)
        self.places = places
        self.postings = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) + places

    def has(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        number = self.number[code]
        key = (number << 32) + place
        at = np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)
        return (number >= 0) & (place >= 0) & (self.postings[at] == key)

    def near(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term occurs at a place from low to high."""
        number = self.number[code]
        at = np.searchsorted(self.postings, (number << 32) + np.maximum(low, 0))
        found = self.postings[np.minimum(at, len(self.postings) - 1)]
        return (number >= 0) & (at < len(self.postings)) & (found >> 32 == number) & ((found & 0xFFFFFFFF) <= high)

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1

    def candidates(self, w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and the places of their rarest term, a bounded number at a time."""
        rarest = w.codes[w.start + w.order[:, 0]]
        asked = np.flatnonzero(self.count[rarest])
        total = np.cumsum(self.count[rarest[asked]])
        at = 0
        while at < len(asked):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, side="right")))
            part = asked[at:end]
            n = self.count[rarest[part]]
            window = np.repeat(part, n)
            inside = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
            yield window, self.places[self.begin[rarest[window]] + inside]
            at = end

    def phrases(self, w: Windows, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that occur word by word in one text: windows and where they begin."""
        start = place - w.order[window, 0]
        for k in range(1, w.order.shape[1]):
            ok = self.has(w.codes[w.start[window] + w.order[window, k]], start + w.order[window, k])
            window, start = window[ok], start[ok]
            if not len(window):
                break
        ok = (start >= 0) & (start + w.width[window] <= self.first[np.minimum(self.text_of(start) + 1, len(self.first) - 1)])
        return window[ok], start[ok]

    def nearby(self, w: Windows, window: np.ndarray, place: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates with all words of the window in ``span`` words of one text: windows and texts."""
        for k in range(1, w.order.shape[1]):
            ok = self.near(w.codes[w.start[window] + w.order[window, k]], place - span + 1, place + span - 1)
            window, place = window[ok], place[ok]
            if not len(window):
                break
        text = self.text_of(place)
        good = np.zeros(len(window), bool)
        for shift in range(-span + 1, 1):
            rest = np.flatnonzero(~good)
            low = np.maximum(place[rest] + shift, self.first[text[rest]])
            high = np.minimum(place[rest] + shift + span, self.first[text[rest] + 1]) - 1
            for k in range(1, w.order.shape[1]):
                ok = self.near(w.codes[w.start[window[rest]] + w.order[window[rest], k]], low, high)
                rest, low, high = rest[ok], low[ok], high[ok]
            good[rest] = True
        return window[good], text[good]


def _merged(start: np.ndarray, end: np.ndarray) -> list[dict[str, int]]:
    """Spans in order, those that overlap or touch made one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    head = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(start[head], reach[np.append(head[1:], len(start)) - 1], strict=True)]


def _by_text(text: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(text, kind="stable")
    return {int(text[part[0]]): part for part in np.split(order, np.flatnonzero(np.diff(text[order])) + 1)} if len(text) else {}


def _searcher(windows, near: int, all_texts: bool):
    def names(w: Windows, window: np.ndarray) -> list[str]:
        owners = [w.owners[w.owned[i] : w.owned[i + 1]] for i in np.unique(window)]
        return [w.items[i] for i in np.unique(np.concatenate(owners))] if owners else []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows | None = windows and windows.value
        none = np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                s = _Segment(row, w.terms if w else none.view(np.uint64))
                found, close = [(none, none)], [(none, none)]
                if w and len(s.postings):
                    for window, place in s.candidates(w):
                        found.append(s.phrases(w, window, place))
                        if near:
                            close.append(np.unique(np.stack(s.nearby(w, window, place, near)), axis=1))
                (window, start), (beside, text) = (tuple(map(np.concatenate, zip(*x, strict=True))) for x in (found, close))
                hits, nears = _by_text(s.text_of(start)), _by_text(text)
                rows = []
                for t in range(len(s.n_words)) if all_texts else sorted(hits.keys() | nears.keys()):
                    h, c = hits.get(t, none), nears.get(t, none)
                    spans = _merged(start[h] - s.first[t], start[h] + w.width[window[h]] - s.first[t]) if len(h) else []
                    rows.append((row["segment"], t, row["doc_ids"][t], int(s.n_words[t]), spans, names(w, window[h]) if len(h) else [], names(w, beside[c]) if len(c) else [], int((w.width[window[h]] == w.order.shape[1]).sum()) if len(h) else 0))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["segment", "place", "key", "n_words", "spans", "item_ids", "near_ids", "n_windows"])

    return search


def matches(index: DataFrame, hashed: DataFrame, scratch: Scratch, width: int = WIDTH, near: int = NEAR) -> DataFrame:
    """Per text: segment, place, key, n_words, spans in which windows of items occur word by word, and the ids of the items with windows
    that occur (item_ids) or are near (near_ids; none where ``near`` is 0); n_windows counts the windows of full width that occur.
    Spans of several blocks may overlap."""
    parts = []
    for block in item_blocks(hashed, width):
        sent = index.sparkSession.sparkContext.broadcast(windows_of(block, index, width))
        parts.append(scratch.keep(index.mapInArrow(_searcher(sent, near, not parts), MATCHES), "matches"))
    if len(parts) < 2:
        return parts[0] if parts else index.mapInArrow(_searcher(None, 0, True), MATCHES)
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "item_ids", "near_ids")]
    return both.groupBy("segment", "place").agg(F.max("key").alias("key"), F.max("n_words").alias("n_words"), F.sum("n_windows").alias("n_windows"), *lists)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", near: int = NEAR) -> DataFrame:
    """Per row of docs: key, n_words, n_hit, n_items, item_ids (sorted strings), n_near, near_ids, spans, n_windows and contaminated."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    hashed = scratch.keep(hashed_items(items), "items")
    index = build_index(docs, hashed, scratch, key, text)
    found = matches(index, hashed, scratch, width, near)
    # Words inside any span, counted once: each span adds what lies beyond the spans before it.
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda at, x: F.struct((at["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], at["end"]))).alias("n"), F.greatest(at["end"], x["end"]).alias("end"))
    spans = F.sort_array("spans")
    n_hit = F.aggregate(spans, state, step, lambda at: at["n"]).cast("long")
    rows = found.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.sort_array(F.array_distinct("item_ids")).alias("item_ids"), F.sort_array(F.array_distinct("near_ids")).alias("near_ids"), spans.alias("spans"), "n_windows")
    return rows.select(
        key,
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
        F.size("near_ids").cast("long").alias("n_near"),
        "near_ids",
        "spans",
        "n_windows",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", "n_near")
