"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (-1) or abstain (0) on every text. Only the counts of vote patterns (at most
3 ** labellers rows) reach the driver, where expectation-maximisation of a two-class model estimates each labeller's chance of
each vote in each class and the classes' shares. That gives each pattern a posterior. A logistic scorer over hashed word,
word-shape and word-ending features is fitted to the posteriors of a sample of at most SAMPLE texts (those with the least hash of
their content), and scores every whole text. A text is kept if its score reaches THRESHOLD.

One output row per input row, with all columns of the input (score columns replace columns of the same name). Null and wordless
texts have no features: every labeller abstains and they get the score of the intercept. Rows that repeat score alike. With no
text at all to learn from, everything is scored 1. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .op7_quality_rules import _SYMBOLS, _per_text, duplicate_lines, in_repeats, repeat_words

NAME = "op8_quality_classifier"
#: Texts that the scorer is fitted to, at most.
SAMPLE = 4096
BITS = 14
#: Rejecting takes clear evidence: clean texts are to stay.
THRESHOLD = 0.3
LABELLERS = ("symbols", "capitals", "repetition", "exclamations", "variety", "duplicate_lines", "word_length", "bars", "prose")
#: Features that are added to a text as neutral, so that the shortest texts lean to the intercept.
NEUTRAL = 80
PER_WORD = 4
EXTRA = {"votes": T.StringType(), "posterior": T.DoubleType(), "score": T.DoubleType(), "kept": T.BooleanType()}

_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LOWER = np.isin(np.arange(256), np.arange(97, 123))
_SHAPES = K.stream(21, 256)
_SHAPES[97:123], _SHAPES[65:91], _SHAPES[48:58], _SHAPES[128:] = _SHAPES[97], _SHAPES[65], _SHAPES[48], _SHAPES[97]
_REPEATED = K.stream(22, 2) >> np.uint64(64 - BITS)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def votes(chunk: K.Chunk, w: K.Words) -> np.ndarray:
    """Votes of all labellers, one row per text."""
    n = w.counts()
    buf, off = chunk.buf, chunk.off
    inside = _per_text(K.BLANK_SEPARATED.inside[buf], off)
    upper, lower = _per_text(_UPPER[buf], off), _per_text(_LOWER[buf], off)
    distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)], dtype=np.int64)
    lines = _per_text(buf == 10, off) + 1

    def bad(value: np.ndarray, low: float, high: float, least: int) -> np.ndarray:
        """-1 outside the range; texts of fewer words abstain."""
        return -((n >= least) & ((value < low) | (value > high))).astype(np.int64)

    inf = np.inf
    symbols, capitals, repeated = _share(_per_text(_SYMBOLS[buf], off), n), _share(upper, upper + lower), _share(repeat_words(w), n)
    prose = (n >= 20) & (symbols <= 0.05) & (capitals <= 0.2) & (repeated <= 0.1)
    return np.stack(
        [
            bad(symbols, 0, 0.3, 5),
            bad(capitals, 0, 0.5, 5),
            bad(repeated, 0, 0.7, 20),
            bad(_share(_per_text(buf == 33, off), n), 0, 0.5, 5),
            bad(_share(distinct, np.sqrt(n)), 1.5, inf, 40),
            bad(_share(duplicate_lines(chunk), lines), 0, 0.8, 20),
            bad(_share(inside, n), 2.5, 13, 10),
            bad(_share(_per_text(buf == 124, off), n), 0, 0.2, 5),
            prose.astype(np.int64),
        ],
        axis=1,
    )


def _codes(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ (3 ** np.arange(v.shape[1]))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good per pattern, and chances[class, labeller, vote + 1] of each vote.

    Votes are independent given the class. Begins from "bad if anyone votes bad".
    """
    posterior = np.where((patterns < 0).any(axis=1), 0.05, 0.95)
    chances = np.full((2, patterns.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        share = np.stack([1 - posterior, posterior]) * counts
        for v in (-1, 0, 1):
            chances[:, :, v + 1] = share @ (patterns == v) + 0.01
        chances /= chances.sum(axis=2, keepdims=True)
        prior = share.sum(axis=1) + 0.01
        logs = np.log(prior / prior.sum())[:, None] + sum(np.log(chances[:, j, :][:, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
        fresh = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        moved = np.abs(fresh - posterior).max(initial=0)
        posterior = fresh
        if moved < 1e-9:
            break
    return posterior, chances


def features(chunk: K.Chunk, w: K.Words) -> np.ndarray:
    """Hashed features per word: itself, its shape, its ending, and whether it stands in a repeated run of words."""
    shift = np.uint64(64 - BITS)
    shape = K.spans_hash(_SHAPES[chunk.buf], w.start, w.end)
    ending = K.spans_hash(_SHAPES[chunk.buf], np.maximum(w.start, w.end - 3), w.end)
    return np.stack([w.hash >> shift, shape >> shift, K.mix(ending ^ np.uint64(5)) >> shift, _REPEATED[in_repeats(w).astype(np.int64)]], axis=1).astype(np.int64)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in K.chunks(batch.column("text")):
            code, n = np.unique(_codes(votes(chunk, K.words(chunk, K.BLANK_SEPARATED_FOLDED))), return_counts=True)
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in K.chunks(batch.column("text")):
            w = K.words(chunk, K.BLANK_SEPARATED_FOLDED)
            made, code = features(chunk, w), _codes(votes(chunk, w))
            rows = [np.unique(made[a:b], return_counts=True) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "pattern": pa.array(code, pa.int64()),
                    "at": pa.array([r[0].astype(np.uint16).tobytes() for r in rows], pa.binary()),
                    "n": pa.array([r[1].astype(np.float32).tobytes() for r in rows], pa.binary()),
                }
            )


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on feature shares by Adam over the whole sample."""
    weights, bias = np.zeros(1 << BITS), 0.0
    if not rows:
        return weights, 10.0
    sizes = [len(a) for a, _ in rows]
    at = np.concatenate([a.astype(np.int64) for a, _ in rows])
    share = np.concatenate([n / (n.sum() + NEUTRAL) for _, n in rows]) * 10
    row = np.repeat(np.arange(len(rows)), sizes)
    m, v = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, share * weights[at], len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        g = np.append(np.bincount(at, share * error[row], len(weights)) / len(rows) + decay * weights / len(rows), error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights -= step[:-1]
        bias -= step[-1]
    return weights, float(bias)


def _scored(model, names: list[str]):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, posterior, weights, bias = model.value
        for batch in batches:
            made = {k: [] for k in EXTRA}
            for chunk in K.chunks(batch.column("text")):
                w = K.words(chunk, K.BLANK_SEPARATED_FOLDED)
                v = votes(chunk, w)
                made["votes"].append(np.array(["".join("-0+"[x + 1] for x in r) for r in v.tolist()], dtype=object))
                made["posterior"].append(posterior[np.searchsorted(known, _codes(v))])
                total = np.concatenate([[0.0], np.cumsum(weights[features(chunk, w)].sum(axis=1))])
                z = (total[w.first[1:]] - total[w.first[:-1]]) / (PER_WORD * w.counts() + NEUTRAL) * 10 + bias
                score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                made["score"].append(score)
                made["kept"].append(score >= THRESHOLD)
            joined = {k: np.concatenate(x) if x else np.zeros(0) for k, x in made.items()}
            columns = [batch.column(c) for c in names]
            columns += [pa.array(joined["votes"], pa.string()), pa.array(joined["posterior"], pa.float64()), pa.array(joined["score"], pa.float64()), pa.array(joined["kept"].astype(bool))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *EXTRA])

    return scored


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Known patterns, their posteriors, and the scorer's weights and bias."""
    texts = docs.select("text")
    counted = texts.mapInArrow(_voted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    known, counts = counted.column("pattern").to_numpy(), counted.column("n").to_numpy()
    patterns = known[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    posterior, _ = fit_label_model(patterns, counts.astype(float))
    # The rows with the least hashes: their keys first (16 bytes each, at most `sample`), then their texts.
    marked = texts.where("text is not null").withColumns({"m1": F.xxhash64("text"), "m2": F.xxhash64(F.lit(3), "text")})
    chosen = marked.select("m2", "m1").distinct().orderBy("m2", "m1").limit(sample)
    found = marked.join(F.broadcast(chosen), ["m1", "m2"], "left_semi").dropDuplicates(["m1", "m2"]).select("text").mapInArrow(_sampled, "pattern long, at binary, n binary").toArrow()
    rows = [(np.frombuffer(a, np.uint16), np.frombuffer(n, np.float32)) for a, n in zip(found.column("at").to_pylist(), found.column("n").to_pylist(), strict=True)]
    target = posterior[np.searchsorted(known, found.column("pattern").to_numpy())] if rows else np.zeros(0)
    return known, posterior, *fit_scorer(rows, target)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs with votes, posterior, score and kept."""
    docs = docs.drop(*EXTRA)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in EXTRA.items())])
    return docs.mapInArrow(_scored(model, docs.columns), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
