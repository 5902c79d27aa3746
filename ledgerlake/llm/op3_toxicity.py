"""Toxicity of deobfuscated text.

Restoring is a noisy channel. A character model (trigrams over 64 classes of bytes, counted over every text) says what words
look like; a channel says what writers do to them: digits and signs for letters, letters repeated, letters spaced out or
separated. Words that show such signs become a lattice of readings, and Viterbi search over all states (the last two classes)
takes the cheapest, however long the word is. A word shows signs if, without the signs at its edges, it has a letter and with
it a digit or sign that may stand for one (three characters in all at least), an ASCII letter three times running, or two
separators or more with at most two letters more than those. Three words or more of one letter or sign in a row are read as one
word with blanks in it. All other words are plain and left as they are.

Scoring is learned from a bounded sample of the labelled training rows (TRAINING), copies of a text counting once. A feature is a hash of a restored word, or of its
first 4, 5 or 6 bytes. Features of toxic texts are counted, then counted in clean texts (a bitmap of fixed size says which ones
matter), and those with the strongest log-odds make the model, at most MODEL of them. A logistic function of a text's strongest
evidence and its length is fitted to the training rows, each judged without its own counts, and gives the score.

Labels serve training alone; doc_id only decides who is held out. One result row per input row. Null and empty texts have no
evidence and get the score of that. Rows that repeat score alike. A row whose labels contradict each other counts as toxic.
Without toxic or without clean training rows every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import Scratch

NAME = "op3_toxicity"
FOLDS = 5
#: Features in the model, at most.
MODEL = 1 << 16
#: Labelled texts to learn from, at most, by label: those with the least hashes of their content.
TRAINING = {1: 8192, 0: 16384}
BITMAP_BITS = 24
#: Toxic texts that a feature must occur in, and least log-odds.
LEAST_TEXTS, LEAST_ODDS = 2, 1.5
PREFIXES = (4, 5, 6)
#: Features below which a text is no shorter to the logistic function: few short texts are there to fit it.
SHORT = 200

#: What a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h", "&": "a", "%": "o", "*": "aeiou", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*~ "
#: Costs of the channel, in nats.
KEEP, SWAP, REPEAT, SEPARATE, STAY = 0.0, 0.8, 0.6, 0.3, 7.0

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_SIGN = np.isin(np.arange(256), [ord(c) for c in SIGNS if ord(c) < 128])
_LONG_SIGNS = [np.frombuffer(c.encode(), np.uint8) for c in SIGNS if ord(c) >= 128]
_SEPARATOR = np.isin(np.arange(256), np.frombuffer(b".-_*~", np.uint8))
_EDGE = np.isin(np.arange(256), np.frombuffer(b".,!?;:*#$%&|\"')]}([{~-_", np.uint8))

#: Classes of bytes: 0 is a word's edge, 1-26 are letters, the rest stands for bytes beyond ASCII.
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = 27 + np.arange(128) % 37
CLASSES = 64


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = np.zeros(CLASSES**3, np.int64)
        for chunk in K.chunks(batch.column("text")):
            c = CLASS[chunk.buf]
            c = np.concatenate([[0], c[(c > 0) | (np.concatenate([[1], c[:-1]]) > 0)], [0, 0]])  # runs of edges become one
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})


class CharacterModel:
    """Costs of a class of character after two others, smoothed with shorter contexts."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        bi = tri.sum(axis=0)
        uni = bi.sum(axis=0) + 1
        uni /= uni.sum()
        bi = (bi + 5 * uni) / (bi.sum(axis=1, keepdims=True) + 5)
        self.cost = -np.log((tri + 5 * bi[None]) / (tri.sum(axis=2, keepdims=True) + 5)).astype(np.float32)

    @staticmethod
    def of(docs: DataFrame) -> "CharacterModel":
        found = docs.select("text").mapInArrow(_trigrams, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most 64 ** 3 rows
        counts = np.zeros(CLASSES**3, np.int64)
        counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
        return CharacterModel(counts)


def restore(word: str, model: CharacterModel) -> str:
    """The cheapest reading of a word (which may hold spaces between single letters), in lower case."""
    cost = model.cost
    word = word.lower()
    # Per state the cost so far and the way there: (the way before, what was read).
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for i, c in enumerate(word):
        options = []
        if c.isalpha():
            options.append((c, KEEP))
            if c == before:
                options.append(("", REPEAT))
        else:
            options += [(x, SWAP) for x in SIGNS.get(c, "")]
            if c in SEPARATORS or i == len(word) - 1:
                options.append(("", SEPARATE))
            if c == before:
                options.append(("", REPEAT))
            options.append((c if c.isdigit() else " ", STAY))
        read = [(x, price, [int(CLASS[byte]) for byte in x.encode()]) for x, price in options]
        fresh: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (so_far, way) in states.items():
            for x, price, classes in read:
                at, total = (a, b), so_far + price
                for k in classes:
                    total += float(cost[at[0], at[1], k])
                    at = (at[1], k)
                if at not in fresh or total < fresh[at][0]:
                    fresh[at] = (total, (way, x) if x else way)
        states = fresh
        before = c
    _, way = min(((so_far + float(cost[a, b, 0]), way) for (a, b), (so_far, way) in states.items()), key=lambda s: s[0])
    made = []
    while way is not None:
        way, x = way
        made.append(x)
    return "".join(reversed(made))


def _stripped(buf: np.ndarray, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Words without the signs at their edges; a sign for a letter at the front stays if a letter or sign follows."""
    start, end = w.start.copy(), w.end.copy()
    front = np.isin(np.arange(256), np.frombuffer(b"\"'([{.,;:", np.uint8))
    for edge, place, step, flags in ((end, -1, -1, _EDGE), (start, 0, 1, front)):
        left = np.flatnonzero(end > start)
        while len(left):
            left = left[flags[buf[edge[left] + place]]]
            edge[left] += step
            left = left[end[left] > start[left]]
    return start, end


def suspects(chunk: K.Chunk, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of stripped words; words to restore; and the number of the spaced-out run that a word belongs to (-1: none)."""
    buf = chunk.buf
    start, end = _stripped(buf, w)
    if not len(start):
        return start, end, np.zeros(0, bool), np.zeros(0, np.int64)
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    per = lambda total: total[end] - total[start]
    sign = _SIGN[buf]
    for long in _LONG_SIGNS:
        found = np.ones(max(len(buf) - len(long) + 1, 0), bool)
        for k, byte in enumerate(long):
            found &= buf[k : len(found) + k] == byte
        sign[: len(found)] |= found
    letters, signs, separators = per(sums(LETTERS[buf])), per(sums(sign)), per(sums(_SEPARATOR[buf]))
    triple = np.zeros(len(buf), bool)
    triple[2:] = (buf[2:] == buf[1:-1]) & (buf[2:] == buf[:-2]) & LETTERS[buf[2:]] & (buf[2:] < 128)
    odd = ((letters >= 1) & (signs > 0) & (letters + signs >= 3)) | (per(sums(triple)) > 0) | ((separators >= 2) & (letters >= 3) & (letters <= separators + 2))
    single = ((w.end - w.start == 1) & (LETTERS[buf[w.start]] | _SIGN[buf[w.start]])).astype(np.int64)
    text = np.searchsorted(w.first, np.arange(len(start)), side="right")
    change = np.ones(len(single), bool)
    change[1:] = (single[1:] != single[:-1]) | (text[1:] != text[:-1])
    number = np.cumsum(change) - 1
    run = np.where((single == 1) & (np.bincount(number)[number] >= 3), number, -1)
    return start, end, odd & (run < 0), run


class Restorer:
    """Restores the words of chunks; what it has read once it remembers."""

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def read(self, raw: bytes) -> str:
        if raw not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[raw] = restore(raw.decode("utf-8", "replace"), self.model)
        return self.known[raw]

    def words(self, chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Features of restored words (rows: features of a word) and the text of each."""
        w = K.words(chunk, K.BLANK_SEPARATED_FOLDED)
        start, end, odd, run = suspects(chunk, w)
        text = np.searchsorted(w.first, np.arange(len(start)), side="right") - 1
        plain = ~odd & (run < 0) & (end > start)
        made, of = [_features(chunk.buf, start[plain], end[plain])], [text[plain]]
        raw = chunk.buf.tobytes()
        found: list[tuple[int, str]] = [(int(text[i]), self.read(raw[start[i] : end[i]])) for i in np.flatnonzero(odd)]
        spaced = np.flatnonzero(run >= 0)
        for part in np.split(spaced, np.flatnonzero(np.diff(run[spaced])) + 1) if len(spaced) else []:
            found.append((int(text[part[0]]), self.read(b" ".join(raw[w.start[i] : w.end[i]] for i in part))))
        pieces = [(t, x) for t, made_text in found for x in made_text.split()]
        if pieces:
            again = K.Chunk(0, len(pieces), *_joined([x for _, x in pieces]))
            v = K.words(again, K.BLANK_SEPARATED_FOLDED)
            at = np.searchsorted(v.first, np.arange(len(v.start)), side="right") - 1
            made.append(_features(again.buf, v.start, v.end))
            of.append(np.array([t for t, _ in pieces], np.int64)[at])
        return np.concatenate(made), np.concatenate(of)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [x.encode() for x in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])])


def _features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    values = K.BLANK_SEPARATED_FOLDED.values[buf]
    # A shorter word's prefix is the word itself, so all features exist.
    return np.stack([K.mix(K.spans_hash(values, start, np.minimum(end, start + n)) ^ np.uint64(n)) if n else K.spans_hash(values, start, end) for n in (0, *PREFIXES)], axis=1)


_RESTORERS: dict[str, Restorer] = {}


def _restorer(sent, name: str) -> Restorer:
    if name not in _RESTORERS:
        _RESTORERS.clear()
        _RESTORERS[name] = Restorer(sent.value)
    return _RESTORERS[name]


def _distinct(features: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once per text: features and their texts, by text."""
    flat, text = features.ravel(), np.repeat(of, features.shape[1])
    order = np.lexsort((flat, text))
    flat, text = flat[order], text[order]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
    return flat[fresh], text[fresh]


def _bits(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _counted(sent, name: str, bitmap=None):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(sent, name)
        for batch in batches:
            parts = []
            for chunk in K.chunks(batch.column("text")):
                flat, _ = _distinct(*restorer.words(chunk))
                parts.append(flat if bitmap is None else flat[bitmap.value[_bits(flat)]])
            feature, n = np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(feature.view(np.int64)), "n": pa.array(n, pa.int64())})

    return counted


class Evidence:
    """The model's features in order with their counts in toxic and clean training texts, and the numbers of those texts."""

    def __init__(self, feature: np.ndarray, toxic: np.ndarray, clean: np.ndarray, texts: tuple[int, int]):
        order = np.argsort(feature)
        self.feature, self.toxic, self.clean, self.texts = feature[order], toxic[order].astype(float), clean[order].astype(float), texts

    def odds(self, toxic: np.ndarray, clean: np.ndarray, less: tuple[int, int] = (0, 0)) -> np.ndarray:
        n1, n0 = self.texts[0] - less[0], self.texts[1] - less[1]
        return np.log((np.maximum(toxic - less[0], 0) + 0.5) / (n1 + 1)) - np.log((np.maximum(clean - less[1], 0) + 0.5) / (n0 + 1))

    def strongest(self, flat: np.ndarray, text: np.ndarray, n: int, labels: np.ndarray | None) -> np.ndarray:
        """Per text: the greatest evidence, the second greatest, and the sum of what exceeds 4; without its own label's count."""
        out = np.zeros((n, 3))
        if not len(self.feature):
            return out
        at = np.minimum(np.searchsorted(self.feature, flat), len(self.feature) - 1)
        hit = self.feature[at] == flat
        at, text = at[hit], text[hit]
        odds = self.odds(self.toxic[at], self.clean[at])
        if labels is not None:
            own = labels[text]
            odds = np.where(own == 1, self.odds(self.toxic[at], self.clean[at], (1, 0)), np.where(own == 0, self.odds(self.toxic[at], self.clean[at], (0, 1)), odds))
        order = np.lexsort((-odds, text))
        text, odds = text[order], odds[order]
        first = np.searchsorted(text, np.arange(n + 1))
        full = np.flatnonzero(np.diff(first) > 0)
        out[full, 0] = odds[first[full]]
        two = np.flatnonzero(np.diff(first) > 1)
        out[two, 1] = odds[first[two] + 1]
        out[:, 2] = np.log1p(np.bincount(text, np.maximum(odds - 4, 0), n)[:n])
        return np.maximum(out, 0)


def _strongest(sent, name: str, evidence, weights=None):
    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, e = _restorer(sent, name), evidence.value
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                flat, text = _distinct(*restorer.words(chunk))
                n = len(chunk)
                labels = None if weights is not None else batch.column("label").slice(chunk.lo, n).to_numpy(zero_copy_only=False)
                x = np.column_stack([e.strongest(flat, text, n, labels), np.log(np.maximum(np.bincount(text, minlength=n)[:n], SHORT)), np.ones(n)])
                if weights is None:
                    yield pa.RecordBatch.from_pydict({"x": pa.array(list(x), pa.list_(pa.float64())), "label": pa.array(labels, pa.int32())})
                else:
                    score = 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(chunk.lo, n), "score": pa.array(score)})

    return strongest


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, decay: float = 1e-2) -> np.ndarray:
    """Newton's method; features after the constant are penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], decay)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class ToxicityScorer:
    """Fitted on the labelled rows outside the held-out fold; ``score`` takes any texts."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        self.spark = docs.sparkSession
        send = self.spark.sparkContext.broadcast
        model = CharacterModel.of(docs)
        self.name = uuid.uuid4().hex  # workers keep what they have restored with this model
        self.model = send(model)
        marks = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
        keys = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("m1"), F.xxhash64(F.lit(1), "text").alias("m2"))
        distinct = keys.join(marks, "doc_id").groupBy("m1", "m2").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
        chosen = [distinct.where(F.col("label") == label).orderBy("m1", "m2").limit(n) for label, n in TRAINING.items()]
        # The training rows' keys are at most sum(TRAINING) rows of 20 bytes; texts don't move.
        chosen = Scratch(self.spark, "toxicity").keep(chosen[0].unionByName(chosen[1]).select("doc_id", "m1", "label"), "chosen")
        train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("m1")).select("m1", "label", "text").dropDuplicates(["m1"])
        train = Scratch(self.spark, "toxicity").keep(train, "training")
        sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
        self.evidence = self.weights = None
        if not sizes.get(1) or not sizes.get(0):
            return
        counts = "feature long, n long"
        toxic = train.where("label = 1").select("text").mapInArrow(_counted(self.model, self.name), counts).groupBy("feature").agg(F.sum("n").alias("toxic")).where(F.col("toxic") >= LEAST_TEXTS)
        toxic = Scratch(self.spark, "toxicity").keep(toxic, "toxic")
        bitmap = np.zeros(1 << BITMAP_BITS, bool)
        bits = toxic.select(F.shiftrightunsigned("feature", 64 - BITMAP_BITS).alias("bit")).distinct().toArrow().column("bit")  # at most 2 ** 24 numbers
        bitmap[bits.to_numpy()] = True
        clean = train.where("label = 0").select("text").mapInArrow(_counted(self.model, self.name, send(bitmap)), counts).groupBy("feature").agg(F.sum("n").alias("clean"))
        odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
        kept = toxic.join(clean, "feature", "left").withColumn("clean", F.coalesce("clean", F.lit(0))).where(odds >= LEAST_ODDS)
        kept = kept.orderBy(odds.desc(), "feature").limit(MODEL).toArrow()
        arrays = [kept.column(c).to_numpy() for c in ("feature", "toxic", "clean")]
        self.evidence = send(Evidence(arrays[0].view(np.uint64), arrays[1], arrays[2], (sizes[1], sizes[0])))
        rows = train.select("text", "label").mapInArrow(_strongest(self.model, self.name, self.evidence), "x array<double>, label int").toArrow()
        self.weights = _logistic(np.array(rows.column("x").to_pylist()), rows.column("label").to_numpy().astype(float))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score of every row."""
        rows = docs.select(F.col("doc_id").cast("long"), "text")
        if self.weights is None:
            return rows.select("doc_id", F.lit(0.0).alias("score"))
        return rows.mapInArrow(_strongest(self.model, self.name, self.evidence, self.weights), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = ToxicityScorer(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).score(docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
