"""Token counts behind a digest cache.

A text's digest is SHA-256 of its content with runs of ASCII blanks made one space (the vocabulary drops blanks, so this
never changes a count); a tokenizer's digest is SHA-256 of its file. Counts are stored by both. A call joins the digests of
its texts to the stored counts, encodes only the distinct texts that are missing, appends their counts to the cache, and
joins them back. Texts move only once, to meet the list of missing digests, dealt by key and digest so that a group of copies is
spread. Counts of digests that a large share of all rows have are sent to the rows (``join_listed``).

The query keeps its cache in the folder that the setting spark.ledgerlake.tokenCounts names; where that is unset, in a folder
of its own, so that each call counts anew.

One result row per input row. A null text counts as empty and has no tokens. Rows that repeat are counted alike, also those
without a doc_id. Other columns are ignored. An empty table gives an empty result. A digest stored twice (two writers at once)
is read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .heavy import join_listed
from .scratch import Scratch
from .wordtokens import WORD_BPE, vocabulary_digest, vocabulary_path, word_tokens

NAME = "op4_token_counts"
LIMIT = 2048
CACHE_SETTING = "spark.ledgerlake.tokenCounts"
CACHE_SCHEMA = "digest binary, n_tokens long"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " "))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(tokens.counts(batch.column("text")), pa.int64())], ["digest", "n_tokens"])

    return encode


class TokenCountCache:
    """Stored counts in a folder that driver and executors share, one subfolder per tokenizer digest."""

    def __init__(self, spark: SparkSession, folder: str, vocabulary: str):
        self.spark, self.vocabulary = spark, vocabulary
        self.where = f"{folder.rstrip('/')}/tokenizer={vocabulary_digest(vocabulary)}"

    def stored(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.where)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        return self.spark.read.schema(CACHE_SCHEMA).parquet(self.where)

    def count(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Per row of docs: key, n_bytes, n_tokens."""
        docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
        scratch, seen = Scratch(self.spark, "token-counts"), Observation()
        rows = docs.select("_key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("digest"))
        rows = scratch.keep(rows.observe(seen, F.count("*").alias("n")), "digests")
        groups = scratch.keep(rows.groupBy("digest").agg(F.min("_key").alias("_first"), F.count("*").alias("_rows")), "groups")
        missing = groups.select("digest", "_first").join(self.stored().select("digest"), "digest", "left_anti")
        # The list of misses is a small fraction of the texts, so it is the hashed side and texts are not sorted.
        here = docs.withColumn("_digest", content_digest(F.col("text")))
        texts = here.join(missing.hint("shuffle_hash"), F.col("_key").eqNullSafe(F.col("_first")) & (F.col("_digest") == F.col("digest")))
        texts.select("digest", "text").mapInArrow(_encode(self.vocabulary), CACHE_SCHEMA).write.mode("append").parquet(self.where)
        scratch.drop()
        counts = groups.join(self.stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest")
        counts = scratch.keep(counts.select("digest", "n_tokens", "_rows"), "counts")
        counted = join_listed(rows, counts, ["digest"], "_rows", seen.get["n"])
        scratch.drop(groups)
        return counted.select(F.col("_key").alias(key), "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = spark.conf.get(CACHE_SETTING, None) or Scratch(spark, "token-count-cache").root
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = TokenCountCache(spark, folder, vocabulary_path(WORD_BPE)).count(docs)
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
