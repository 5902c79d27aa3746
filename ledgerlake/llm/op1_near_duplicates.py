"""MinHash near-duplicates by a multi-index Hamming join.

A text's set is its distinct 5-word shingles. Its signature has 48 symbols of 14 bits, one per permutation, in 12 chunks of 4.
Two signatures that differ in at most 23 symbols have, by pigeonhole, a chunk in which at most one symbol differs; so each
chunk is stored under its 4 keys with one symbol masked, and all pairs within 23 symbols share a key. (At similarity 0.75
twelve symbols differ on average and more than 23 in about one pair of ten thousand.) Pairs that share a key are kept if
their whole signatures differ in at most 23 symbols, and are then confirmed on the full sets.

Texts with equal sets are one class from the start, and classes have numbers of their own. Within a bucket no list of all pairs is
made. First every member is tried against the bucket's least member, then against a member of another component in some of its
buckets, and confirmed links are made into components. What then still lies in a bucket with several components is joined by
rare shingles: a set that shares 3/4 with another has one of the other's shingles among its own rarest quarter, so
members meet where those meet, but for pairs of the shingle's largest component, which hold already. All pairs that share a key are
thus confirmed, refuted or already in one component, so the components are those of all pairs, whatever a bucket's size.

One result row per input row. Null and wordless texts have empty sets and stand alone. With fewer than five words the whole
sequence is one shingle. Rows that repeat are one class. Rows that share a doc_id are linked, whatever their texts. Rows without a
doc_id take part by their texts; alone they have no component_id and are not kept. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as K
from .components import components
from .heavy import join_listed
from .scratch import Scratch

NAME = "op1_near_duplicates"
WORDS = 5
SYMBOLS, CHUNK, SYMBOL_BITS = 48, 4, 14
CHUNKS = SYMBOLS // CHUNK
#: One error is allowed in each chunk: (errors + 1) x chunks - 1.
MOST_DIFFERENT = 2 * CHUNKS - 1
#: Symbols stand in lanes of 15 bits, so that a sum of two lanes never reaches the next.
LANE = SYMBOL_BITS + 1
LANES = [((1 << SYMBOL_BITS) - 1) << (LANE * i) for i in range(CHUNK)]
LOW, HIGH = sum(LANES), sum(1 << (LANE * i + SYMBOL_BITS) for i in range(CHUNK))
SHARE = (75, 100)
#: Bits of the bitmaps that bound what two sets share.
BITMAP = 1024
#: Buckets from which a member is tried ahead in one round.
TRIES = 8
SIGNATURE = [f"c{i}" for i in range(CHUNKS)]
SKETCH = "doc_id long, mark long, n_shingles long, s1 long, s2 long, " + ", ".join(f"{c} long" for c in SIGNATURE)

_MULTIPLY = K.stream(11, SYMBOLS) | np.uint64(1)
_CHANGE = K.stream(12, SYMBOLS)


def shingles(chunk: K.Chunk, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a chunk's texts, and where each text's begin."""
    w = K.words(chunk, K.BLANK_SEPARATED_FOLDED)
    n = w.counts()
    per = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(per)])
    start = np.arange(begin[-1]) - np.repeat(begin[:-1], per) + np.repeat(w.first[:-1], per)
    return K.spans_hash(w.hash, start, start + np.repeat(np.minimum(n, k), per)), begin


def signatures(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Per non-empty set 12 longs, each with 4 symbols in lanes."""
    least = np.empty((len(begin), SYMBOLS), np.uint64)
    for j in range(SYMBOLS):
        least[:, j] = np.minimum.reduceat((hashes ^ _CHANGE[j]) * _MULTIPLY[j], begin)
    symbols = (K.mix(least) >> np.uint64(64 - SYMBOL_BITS)).reshape(len(begin), CHUNKS, CHUNK)
    return (symbols << (np.arange(CHUNK, dtype=np.uint64) * np.uint64(LANE))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in K.chunks(batch.column("text")):
            n = len(chunk)
            hashes, begin = shingles(chunk)
            sets = [np.unique(hashes[begin[d] : begin[d + 1]]) for d in range(n)]
            sizes = np.array([len(x) for x in sets])
            full = np.flatnonzero(sizes)
            names = np.frombuffer(b"".join(hashlib.blake2b(sets[d].tobytes(), digest_size=16).digest() for d in full), np.int64).reshape(-1, 2)
            signed = signatures(hashes, begin[full]) if len(full) else np.zeros((0, CHUNKS), np.int64)
            values = np.zeros((n, 2 + CHUNKS), np.int64)
            values[full] = np.concatenate([names, signed], axis=1)
            columns = {c: batch.column(c).slice(chunk.lo, n) for c in ("doc_id", "mark")} | {"n_shingles": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | {c: pa.array(values[:, i], mask=sizes == 0) for i, c in enumerate(("s1", "s2", *SIGNATURE))})


def sketches(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, mark, text): its set's size, a hash of 128 bits and the signature; nulls for an empty set."""
    return docs.select("doc_id", "mark", "text").mapInArrow(_sketch, SKETCH)


def keys() -> Column:
    """All 48 keys of the columns SIGNATURE: each chunk with each one of its symbols masked."""
    made = [F.xxhash64(F.lit(4 * i + j), F.col(c).bitwiseAND(F.lit(LOW ^ lane))) for i, c in enumerate(SIGNATURE) for j, lane in enumerate(LANES)]
    return F.array(*made)


def symbols_apart(a: str, b: str) -> Column:
    """In how many symbols two signatures differ, whose columns have these prefixes."""
    found = None
    for c in SIGNATURE:
        odd = F.bit_count((F.col(a + c).bitwiseXOR(F.col(b + c)) + F.lit(LOW)).bitwiseAND(F.lit(HIGH)))
        found = odd if found is None else found + odd
    return found


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most, whole = SHARE
    known: dict[int, np.ndarray] = {}

    def sets(ids: list[int], texts: pa.Array) -> list[np.ndarray]:
        new = [i for i, x in enumerate(ids) if x not in known]
        for chunk in K.chunks(texts.take(pa.array(new, pa.int64()))):
            hashes, begin = shingles(chunk)
            for d in range(len(chunk)):
                known[ids[new[chunk.lo + d]]] = np.unique(hashes[begin[d] : begin[d + 1]])
        return [known[x] for x in ids]

    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, 64):
            batch = whole_batch.slice(at, 64)
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left, right = sets(a, batch.column("text_a")), sets(b, batch.column("text_b"))
            ok = []
            for x, y in zip(left, right, strict=True):
                if most * max(len(x), len(y)) > whole * min(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(whole * shared >= most * (len(both) - shared))
            known = {k: v for k, v in known.items() if k in (a[-1], b[-1])}
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(ok, pa.bool_())})


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for chunk in K.chunks(batch.column("text")):
            hashes, begin = shingles(chunk)
            sets = [np.unique(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"id": pa.array(np.repeat(ids[chunk.lo : chunk.hi], [len(x) for x in sets])), "shingle": pa.array(np.concatenate(sets).view(np.int64))})


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in K.chunks(batch.column("text")):
            hashes, begin = shingles(chunk)
            bits = np.zeros((len(chunk), BITMAP), bool)
            bits[np.repeat(np.arange(len(chunk)), np.diff(begin)), (hashes % np.uint64(BITMAP)).astype(np.int64)] = True
            longs = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(chunk.lo, len(chunk)), "bits": pa.array(longs.tolist(), pa.list_(pa.int64()))})


def alone(x: str, y: str) -> Column:
    """At least so many elements of x's set are not in y's: the bits that x's bitmap has and y's has not."""
    # Looped rather than written out: a condition of that many terms is too long a method for the JVM to compile.
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, more: n + more)


class NearDuplicates:
    """The steps over one table of documents (columns doc_id and text). Classes have an ``id``; a, b and component are ids too."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "near-duplicates")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")

    def classes(self) -> None:
        """``sketched``: a row per document. ``signed``: a row per distinct set, with the least doc_id and a text that have it."""
        seen = Observation()
        self.sketched = self.scratch.keep(sketches(self.docs).observe(seen, F.count("*").alias("n")), "sketches")
        self.rows = seen.get["n"]
        first = [F.first(c).alias(c) for c in ("n_shingles", *SIGNATURE)]
        sets = self.sketched.where("n_shingles > 0").groupBy("s1", "s2").agg(
            F.min("doc_id").alias("doc"), F.coalesce(F.min_by("mark", "doc_id"), F.min("mark")).alias("doc_mark"), F.count("*").alias("rows"), *first
        )
        self.signed = self.scratch.keep(sets.withColumnRenamed("n_shingles", "n").withColumn("id", F.monotonically_increasing_id()), "classes")

    def same_document(self) -> DataFrame:
        """Links between the classes of rows that share a doc_id."""
        rows = self.sketched.where("doc_id is not null and n_shingles > 0").select("doc_id", "s1", "s2")
        several = rows.groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low < high").select("doc_id")
        held = rows.join(several, "doc_id").distinct().join(self.signed.select("s1", "s2", "id"), ["s1", "s2"]).select("doc_id", "id")
        least = held.groupBy("doc_id").agg(F.min("id").alias("a"))
        return held.join(least, "doc_id").where("a < id").select("a", F.col("id").alias("b"))

    def buckets(self) -> DataFrame:
        """(key, id, least): the members of all buckets with more than one, and the bucket's least member."""
        rows = self.signed.select("id", F.explode(keys()).alias("key"))
        shared = rows.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
        return self.scratch.keep(rows.join(shared, "key"), "buckets")

    def _texts(self, buckets: DataFrame) -> DataFrame:
        """(id, text) of the classes in buckets, from which all later steps read."""
        wanted = self.signed.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "doc", "doc_mark")
        here = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("mark") == F.col("doc_mark"))
        # The list is small beside the texts: it is the hashed side, and texts are not sorted.
        return self.scratch.keep(self.docs.join(wanted.hint("shuffle_hash"), here).select("id", "text").dropDuplicates(["id"]), "texts")

    def _signed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose signatures are near enough."""
        a, b = (self.signed.select(F.col("id").alias(x), *(F.col(c).alias(x + c) for c in SIGNATURE)) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where(symbols_apart("a", "b") <= MOST_DIFFERENT).select("a", "b")

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs with their verdicts on full sets; only texts that take part in a pair are moved."""
        pairs = self.scratch.keep(pairs, f"{name}-pairs")
        involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = self.texts.join(involved, "id", "left_semi")
        a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(b, "b").join(a, "a")
        done = self.scratch.keep(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long, linked boolean"), f"{name}-verdicts")
        self.scratch.drop(pairs)
        return done

    def _split(self, held: DataFrame, found: DataFrame, name: str) -> DataFrame:
        """The rows (key, id, component) of those buckets that still hold more than one component."""
        placed = held.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        return self.scratch.keep(placed.join(several, "key"), name)

    def _advances(self, split: DataFrame, turn: int) -> DataFrame:
        """Pairs of a member with one of another component in its bucket, drawn by hash; from TRIES of its buckets at most.
        They only hasten what ``_across`` would find."""
        lead = split.groupBy("key").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", "key", F.lit(turn))).alias("lead"))
        outside = split.join(lead, "key").where(F.col("component") != F.col("lead.component")).select("id", F.col("lead.id").alias("other"), F.xxhash64("key", F.lit(turn)).alias("draw"))
        nth = F.row_number().over(Window.partitionBy("id").orderBy("draw", "other"))
        return outside.withColumn("nth", nth).where(F.col("nth") <= TRIES).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()

    def _across(self, split: DataFrame) -> DataFrame:
        """All pairs in different components that can be linked and whose signatures are near enough; exact.

        A set of n shingles that is linked with another shares 3/4 n of them at least. Under one order of all shingles the
        two have one in common among the first n - 3/4 n + 1 of each. The order is by number of holders, so these are the
        rarest; those with one holder meet nothing and only use up places. Where the first shingle in common has places p and q
        in sets of n and m, no more than 1 + min(n - p, m - q) are shared, which rules out most pairs of a family.
        """
        most, whole = SHARE
        able = split.select("id", "component").distinct().join(self.signed.select("id", "n"), "id")
        table = self.scratch.keep(self.texts.join(able.select("id"), "id", "left_semi").mapInArrow(_listed, "id long, shingle long"), "shingles")
        holders = table.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1")
        shared = table.join(holders, "shingle").join(able, "id")
        by_rarity = Window.partitionBy("id").orderBy("holders", "shingle")
        n_shared = F.count("*").over(Window.partitionBy("id"))
        shared = shared.withColumn("place", F.col("n") - n_shared + F.row_number().over(by_rarity))
        rare = shared.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * most / whole) + 1)
        bitmaps = self.texts.join(able.select("id"), "id", "left_semi").mapInArrow(_bitmaps, "id long, bits array<long>")
        rare = self.scratch.keep(rare.select("shingle", "id", "component", "n", "place").join(bitmaps, "id"), "rare")
        # Pairs inside a shingle's largest component are never made: of two components one is not the largest.
        by_component = rare.groupBy("shingle", "component").agg(F.count("*").alias("members"))
        largest = by_component.groupBy("shingle").agg(F.max_by("component", F.struct("members", "component")).alias("largest"), F.count("*").alias("components")).where("components > 1").drop("components")
        met = rare.join(largest, "shingle")
        x = met.where("component <> largest").select("shingle", *(F.col(c).alias(f"x_{c}") for c in ("id", "component", "n", "place", "bits")))
        y = met.select("shingle", *(F.col(c).alias(f"y_{c}") for c in ("id", "component", "n", "place", "bits")))
        # A link needs whole * shared >= most * (n + m - shared). Bitmaps rule out the rest of most families: what lies alone in one
        # set is not shared.
        enough = lambda shared: (whole + most) * shared >= most * (F.col("x_n") + F.col("y_n"))
        can_share = 1 + F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
        fits = (F.col("x_component") != F.col("y_component")) & enough(can_share)
        fits = fits & enough(F.col("x_n") - alone("x_bits", "y_bits")) & enough(F.col("y_n") - alone("y_bits", "x_bits"))
        pairs = x.join(y, "shingle").where(fits).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
        made = self.scratch.keep(self._signed(pairs), "across")
        self.scratch.drop(table, rare)
        return made

    def links(self, rounds: int = 1) -> DataFrame:
        """(id, component) of all classes that have a link."""
        buckets = self.buckets()
        self.scratch.drop()
        self.texts = self._texts(buckets)
        self.scratch.drop()
        tried = self.confirm(self._signed(buckets.where("least < id").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()), "first")
        found = components(tried.where("linked").select("a", "b").unionByName(self.same_document()), self.scratch)
        split = self._split(buckets, found, "split")
        self.scratch.drop(buckets)
        for turn in range(rounds):
            if split.isEmpty():
                break
            fresh = self.confirm(self._signed(self._advances(split, turn).join(tried, ["a", "b"], "left_anti")), f"round{turn}")
            tried = tried.unionByName(fresh)
            found = components(fresh.where("linked"), self.scratch, found)
            before, split = split, self._split(split, found, f"split{turn}")
            self.scratch.drop(before)
        if not split.isEmpty():
            last = self.confirm(self._across(split).join(tried, ["a", "b"], "left_anti"), "last")
            found = components(last.where("linked"), self.scratch, found)
        self.scratch.drop(self.texts, split)
        return found

    def find(self, rounds: int = 1) -> DataFrame:
        """Per row of docs: doc_id, mark, n_shingles, group (the component's number; null for an empty set) and component_id."""
        self.classes()
        placed = self.signed.join(self.links(rounds), "id", "left").select("s1", "s2", "doc", "rows", F.coalesce("component", "id").alias("group"))
        least = placed.groupBy("group").agg(F.min("doc").alias("component_id"))
        placed = self.scratch.keep(placed.join(least, "group").select("s1", "s2", "group", "component_id", "rows"), "placed")
        rows = self.sketched.select("doc_id", "mark", "n_shingles", "s1", "s2")
        some, none = rows.where("n_shingles > 0"), rows.where("n_shingles = 0")
        joined = join_listed(some, placed, ["s1", "s2"], "rows", self.rows)
        alone = none.withColumn("group", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
        return joined.unionByName(alone).select("doc_id", "mark", "n_shingles", "group", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, mark (a hash of the text), n_shingles, group, component_id (the least doc_id it is linked with) and kept.

    An empty text whose doc_id another text has too is alone all the same.
    """
    out = NearDuplicates(docs).find()
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mark", "group")
