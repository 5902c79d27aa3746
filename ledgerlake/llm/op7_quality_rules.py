"""Quality rules on tokeniser fertility.

A public piece vocabulary with byte fallback encodes the words of a text one by one, and the rules look at what it makes of
them: characters per token, the share of byte-fallback tokens, and the entropy of the token distribution. Junk lies off the
bulk of its language: runs of symbols and capitals break into short tokens, repetition has little entropy, foreign bytes fall
back. The bands are learned from all rows per language and length (powers of two of the number of tokens): the quartiles of
each measure, widened by a number of quartile ranges. The bands of a length are drawn towards its language's, the more the
fewer rows it has; other languages have no part in them. A base rule (too few words, too much repetition) fails a text whatever its tokens.

One result row per input row. Null texts have no words and fail the base rule. A null language is a language of its own. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import Scratch
from .wordtokens import as_bytes

NAME = "op7_quality_rules"
PIECES = "piece_bpe_32k.model"
REMEMBERED = 300_000
LEAST_WORDS = 50
#: Rows of one length at which its bands lie halfway between the language's and its own quartiles.
HALFWAY = 100
#: Quartile ranges below the lower quartile at which a text is off: in one measure, or in two summed. Above, three times as many.
REACH, TOGETHER = 3.0, 4.0
MEASURES = ("chars_per_token", "byte_share", "entropy")
MEASURED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"

_STARTS = (np.arange(256) & 0xC0) != 0x80
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def in_repeats(w: K.Words, width: int = 3) -> np.ndarray:
    """Per word: whether it stands in a window of three words that its text holds twice or more."""
    starts, begin = K.window_starts(w.first, width)
    if len(starts):
        text = np.repeat(np.arange(len(begin) - 1), np.diff(begin)).astype(np.uint64)
        key = K.mix(K.spans_hash(w.hash, starts, starts + width) + text * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        return K.covered(starts[twice], width, len(w.hash))
    return np.zeros(len(w.hash), bool)


def repeat_words(w: K.Words) -> np.ndarray:
    """Per text: how many of its words stand in repeated windows."""
    return _per_text(in_repeats(w), w.first)


def duplicate_lines(chunk: K.Chunk) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of the text."""
    cut = np.flatnonzero(chunk.buf == 10)
    starts = np.unique(np.concatenate([chunk.off[:-1], cut + 1]))
    starts = starts[starts < len(chunk.buf)]
    ends = np.append(starts[1:], len(chunk.buf))
    text = np.searchsorted(chunk.off, starts, side="right") - 1
    stops = ends - ((ends > starts) & (chunk.buf[ends - 1] == 10) if len(ends) else 0)
    inside = np.concatenate([[0], np.cumsum(K.BLANK_SEPARATED.inside[chunk.buf], dtype=np.int64)])
    worded = inside[stops] > inside[starts]
    starts, stops, text = starts[worded], stops[worded], text[worded]
    key = K.mix(K.spans_hash(K.BLANK_SEPARATED.values[chunk.buf], starts, stops) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(starts) else np.zeros(0, np.uint64)
    _, first = np.unique(key, return_index=True)
    n = len(chunk)
    return np.bincount(text, minlength=n)[:n] - np.bincount(text[first], minlength=n)[:n]


class Fertility:
    """Piece ids of words, remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known: dict[bytes, bytes] = {}

    def learn(self, texts: list[list[bytes]]) -> None:
        new = set().union(*texts) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*texts)
        fresh = list(new)
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            for word, ids in zip(part, self.model.encode([w.decode() for w in part], num_threads=1), strict=True):
                self.known[word] = np.array(ids, np.int32).tobytes()

    def measure(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)
        n = len(ids)
        if not n:
            return 0, 0.0, 0.0, 0.0
        ordered = np.sort(ids)
        counts = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))
        entropy = float(np.log2(n) - (counts * np.log2(counts)).sum() / n)
        return n, chars / n, float(self.is_byte[ids].mean()), entropy


_OPEN: dict[str, Fertility] = {}


def _measure(path: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = _OPEN[path] = _OPEN.get(path) or Fertility(path)
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for chunk in K.chunks(batch.column("text")):
                w, n = K.words(chunk, K.BLANK_SEPARATED), len(chunk)
                chars = _per_text(_STARTS[chunk.buf] & K.BLANK_SEPARATED.inside[chunk.buf], chunk.off)
                part = [x.split() for x in texts[chunk.lo : chunk.hi]]
                fertility.learn(part)
                tokens = list(zip(*(fertility.measure(x, c) for x, c in zip(part, chars.tolist(), strict=True)), strict=True))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(chunk.lo, n),
                        "lang": batch.column("lang").slice(chunk.lo, n),
                        "n_words": pa.array(w.counts(), pa.int64()),
                        "word_chars": pa.array(chars, pa.int64()),
                        "n_symbols": pa.array(_per_text(_SYMBOLS[chunk.buf], chunk.off), pa.int64()),
                        "n_dup_lines": pa.array(duplicate_lines(chunk), pa.int64()),
                        "n_repeat_words": pa.array(repeat_words(w), pa.int64()),
                        "n_tokens": pa.array(tokens[0], pa.int64()),
                        "chars_per_token": pa.array(tokens[1], pa.float64()),
                        "byte_share": pa.array(tokens[2], pa.float64()),
                        "entropy": pa.array(tokens[3], pa.float64()),
                    }
                )

    return measure


def measures(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    return rows.mapInArrow(_measure(vocabulary or public_tokenizers.path(PIECES)), MEASURED)


def with_bands(rows: DataFrame) -> DataFrame:
    """Adds fits: whether the measures lie in the bands of the row's language and length."""
    size = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")
    rows = rows.withColumn("size", size)
    judged = rows.where(F.col("n_words") >= LEAST_WORDS)
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in MEASURES]

    def bands(keys: list[str], name: str) -> DataFrame:
        found = judged.groupBy(*keys).agg(F.count("*").alias("rows"), *quartiles)
        return found.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.struct("rows", *MEASURES).alias(name))

    near, own = bands(["lang", "size"], "near"), bands(["lang"], "own")
    out = rows.join(near, F.col("lang").eqNullSafe(F.col("near_lang")) & (F.col("size") == F.col("near_size")), "left")
    out = out.join(own, F.col("lang").eqNullSafe(F.col("own_lang")), "left")
    share = F.coalesce(F.col("near.rows") / (F.col("near.rows") + HALFWAY), F.lit(0.0))

    def beyond(m: str, upper: bool = False):
        own_band = F.col("own")[m]
        near_band = F.coalesce(F.col("near")[m], own_band)
        band = [own_band[i] + share * (near_band[i] - own_band[i]) for i in range(3)]
        spread = F.greatest(band[2] - band[0], F.lit(0.005) * band[1], F.lit(0.002))
        return ((F.col(m) - band[2]) if upper else (band[0] - F.col(m))) / spread

    short, poor = beyond("chars_per_token"), beyond("entropy")
    off = (short > REACH) | (poor > REACH) | (short + poor > TOGETHER) | (beyond("chars_per_token", True) > 3 * REACH) | (beyond("byte_share", True) > 3 * REACH)
    return out.withColumn("fits", ~F.coalesce(off, F.lit(False))).drop("near", "own", "near_lang", "near_size", "own_lang", "size")


def judge(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row: the base counts, the fertility measures, base_failed and kept."""
    rows = Scratch(docs.sparkSession, "quality-rules").keep(measures(docs, vocabulary), "measures")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return with_bands(rows).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("fits"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)
