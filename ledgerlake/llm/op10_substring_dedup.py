"""Exact removal of repeated 35-word windows by super-k-mer partitioning.

A window's minimiser is the 10-word run inside it with the least hash (leftmost on ties). Consecutive windows that share a
minimiser are one super-k-mer: a start, a number of windows, the minimiser's hash and a hash of all its words. Equal windows
have equal minimisers, so only super-k-mers whose minimiser occurs twice can hold a repeated window.

1. Each text gives the list of its super-k-mers (about one per 13 words).
2. Minimisers are counted; super-k-mers of those that occur once are done.
3. A super-k-mer whose whole content occurs twice has only repeated windows. Copies of any number thus meet as counts.
4. Where a minimiser has several contents, one super-k-mer of each content travels, as one packed string, to the bucket of its
   minimiser. There its windows are unpacked and sorted, and windows of equal words are counted exactly. The windows of a
   minimiser with HEAVY of all contents are dealt by their own hash instead and added up before they are shuffled.
5. Verdicts go back to all occurrences of a content; the covered words are removed from the texts.

Minimisers, contents and windows that hold a large share of all rows are sent to the rows (``join_listed``), so no key makes one
task. Windows are judged on the input. Words are runs of anything but ASCII blanks, unchanged. Null or wordless texts and texts of
fewer than 35 words lose nothing. Rows that repeat remove each other's windows, also without a doc_id. Other columns are ignored.
An empty table gives an empty result. Windows are compared by 64 bits of hash besides their minimiser's 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as K
from .heavy import HEAVY, join_listed
from .scratch import Scratch
from .wordtokens import as_bytes

NAME = "op10_substring_dedup"
WIDTH = 35
CORE = 10
#: Bits of a place inside a chunk; the bits above order minimisers by hash.
PLACE_BITS = 28
PROFILE = "doc_id long, k1 long, k2 long, row long, n_words long, whole binary, minimisers array<long>, contents array<long>, starts array<int>, sizes array<int>"


def super_kmers(w: K.Words, width: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash, content hash, start in its text, number of windows; and where each text's begin."""
    starts, begin = K.window_starts(w.first, width)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(len(w.first), np.int64)
    at = np.arange(len(w.hash) - core + 1)
    cores = K.spans_hash(w.hash, at, at + core)
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (K.sliding_min((cores & ~place) | at.astype(np.uint64), width - core + 1)[starts] & place).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(fresh)
    sizes = np.diff(np.append(head, len(starts)))
    first = starts[head]
    contents = K.spans_hash(w.hash, first, first + sizes + width - 1)
    text = np.searchsorted(w.first, first, side="right") - 1
    return cores[least[head]], contents, first - w.first[text], sizes, np.searchsorted(head, begin)


def _lists(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values, kind))


def _profile(width: int, core: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for chunk in K.chunks(batch.column("text")):
                w = K.words(chunk, K.BLANK_SEPARATED)
                minimisers, contents, starts, sizes, begin = super_kmers(w, width, core)
                n = len(chunk)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(chunk.lo, n),
                        "k1": batch.column("k1").slice(chunk.lo, n),
                        "k2": batch.column("k2").slice(chunk.lo, n),
                        "row": pa.array(np.arange(row, row + n)),
                        "n_words": pa.array(w.counts()),
                        "whole": pa.array([hashlib.sha256(b" ".join(x.split())).digest() for x in texts[chunk.lo : chunk.hi]], pa.binary()),
                        "minimisers": _lists(minimisers.view(np.int64), begin, pa.int64()),
                        "contents": _lists(contents.view(np.int64), begin, pa.int64()),
                        "starts": _lists(starts.astype(np.int32), begin, pa.int32()),
                        "sizes": _lists(sizes.astype(np.int32), begin, pa.int32()),
                    }
                )
                row += n

    return profile


def _packed(width: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(as_bytes(batch.column("text")), batch.column("asked"), strict=True):
                words, asked = text.split(), asked.as_py()
                yield pa.RecordBatch.from_pydict(
                    {
                        "minimiser": pa.array([a["minimiser"] for a in asked], pa.int64()),
                        "content": pa.array([a["content"] for a in asked], pa.int64()),
                        "n": pa.array([a["n"] for a in asked], pa.int64()),
                        "packed": pa.array([b" ".join(words[a["start"] : a["start"] + a["size"] + width - 1]).decode() for a in asked], pa.string()),
                    }
                )

    return packed


def _without(width: int):
    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept_texts = [], [], []
            for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans"), strict=True):
                words = text.split()
                spans = spans.as_py()
                starts = np.concatenate([np.arange(s["start"], s["start"] + s["size"]) for s in spans])
                gone = K.covered(starts, width, len(words))
                kept = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).digest())
                kept_texts.append(kept.decode())
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "n_removed": pa.array(removed, pa.int64()), "part": pa.array(digests, pa.binary()), "kept_text": pa.array(kept_texts, pa.string())})

    return without


def repeated_windows(docs: DataFrame, scratch: Scratch, width: int = WIDTH, core: int = CORE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of all rows; spans (row, start, size) of repeated windows; and the texts of rows that may hold some, by (k1, k2)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "doc_id", "text")})
    seen = Observation()
    profiles = docs.mapInArrow(_profile(width, core), PROFILE).observe(seen, F.coalesce(F.sum(F.size("minimisers")), F.lit(0)).alias("n"))
    profiles = scratch.keep(profiles, "profiles")
    total = seen.get["n"]
    each = profiles.select("row", F.explode(F.arrays_zip("minimisers", "contents", "starts", "sizes")).alias("s")).select(
        F.col("s.minimisers").alias("minimiser"), F.col("s.contents").alias("content"), "row", F.col("s.starts").alias("start"), F.col("s.sizes").alias("size")
    )
    twice = scratch.keep(each.groupBy("minimiser").agg(F.count("*").alias("n")).where("n > 1"), "minimisers")
    held = scratch.keep(join_listed(each, twice, ["minimiser"], "n", total), "candidates")
    scratch.drop(twice)

    # Equal contents have equal sizes; of the row with the least number any place of the content will do.
    made, seen = held.groupBy("minimiser", "content").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min_by("start", "row").alias("start"), F.first("size").alias("size")), Observation()
    contents = scratch.keep(made.observe(seen, F.count("*").alias("n")), "contents")
    kinds = seen.get["n"]
    several = scratch.keep(contents.groupBy("minimiser").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    crowded = F.broadcast(several.where(F.col("kinds") >= max(2, kinds * HEAVY)).select("minimiser"))  # 1 / HEAVY rows at most
    asked = join_listed(contents, several, ["minimiser"], "kinds", kinds).groupBy("row").agg(F.collect_list(F.struct("minimiser", "content", "n", "start", "size")).alias("asked"))

    rows = held.select("row").distinct().join(profiles.select("row", "k1", "k2"), "row")
    # The list of rows is far smaller than their texts: it is the hashed side, and texts are not sorted.
    wanted = rows.select("k1", "k2").distinct()
    texts = scratch.keep(docs.join(wanted.hint("shuffle_hash"), ["k1", "k2"], "left_semi").select("k1", "k2", "text").dropDuplicates(["k1", "k2"]), "texts")
    scratch.drop()

    travel = asked.join(profiles.select("row", "k1", "k2"), "row").join(texts, ["k1", "k2"]).select("text", "asked").mapInArrow(_packed(width), "minimiser long, content long, n long, packed string")
    travel = scratch.keep(travel, "packed")

    def windows(packed: DataFrame) -> DataFrame:
        hashes = F.transform(F.sequence(F.lit(1), F.size("words") - (width - 1)), lambda i: F.xxhash64(F.slice("words", i, width)))
        return packed.withColumn("words", F.split("packed", " ")).select("minimiser", "content", "n", F.posexplode(hashes).alias("skip", "window"))

    together = F.sum("n").over(Window.partitionBy("minimiser", "window"))
    sorted_there = windows(travel.join(crowded, "minimiser", "left_anti").repartition("minimiser")).withColumn("total", together).where("total > 1")
    apart, seen = windows(travel.join(crowded, "minimiser", "left_semi")), Observation()
    apart = scratch.keep(apart.observe(seen, F.count("*").alias("n")), "crowded")
    counted = scratch.keep(apart.groupBy("minimiser", "window").agg(F.sum("n").alias("total"), F.count("*").alias("places")).where("total > 1").drop("total"), "crowded-windows")
    dealt = join_listed(apart, counted, ["minimiser", "window"], "places", seen.get["n"])
    columns = ["minimiser", "content", "skip"]
    found = sorted_there.select(columns).unionByName(dealt.select(columns)).groupBy("minimiser", "content").agg(F.collect_list("skip").alias("skips"))
    verdicts = contents.select("minimiser", "content", "n").join(found, ["minimiser", "content"], "left").where("n > 1 or skips is not null")
    verdicts = scratch.keep(verdicts.withColumn("rows", F.col("n")), "verdicts")
    scratch.drop(travel, apart, counted, several, contents)
    repeated = join_listed(held, verdicts, ["minimiser", "content"], "rows", total).select(
        "row", F.explode(F.when(F.col("n") > 1, F.array(F.struct("start", "size"))).otherwise(F.transform("skips", lambda x: F.struct((F.col("start") + x).alias("start"), F.lit(1).alias("size"))))).alias("span")
    )
    spans = scratch.keep(repeated.groupBy("row").agg(F.collect_list("span").alias("spans")), "spans")
    scratch.drop(held, verdicts)
    return profiles, spans, texts


def remove_repeats(docs: DataFrame, width: int = WIDTH, core: int = CORE) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and kept_text where words were removed (else null)."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    profiles, spans, texts = repeated_windows(docs, scratch, width, core)
    changed = spans.join(profiles.select("row", "k1", "k2"), "row").join(texts, ["k1", "k2"]).select("row", "text", "spans")
    changed = changed.mapInArrow(_without(width), "row long, n_removed long, part binary, kept_text string")
    return profiles.select("row", "doc_id", "n_words", "whole").join(changed, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.lower(F.hex(F.coalesce("part", "whole"))).alias("kept_sha256"), "kept_text"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
