"""A corpus run in five stages: quality classifier, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents:

- quality: rows that the classifier rejects go;
- lines: later repeats of runs of lines (ten words or three lines) are deleted from texts; rows whose text loses all its lines go;
- near_duplicates: of each group of near-duplicates one row stays, that of the least doc_id (rows without one come last; of rows
  with one doc_id, that whose text has the least hash); rows with empty texts are no group and stay;
- decontamination: rows that hold a benchmark window of 13 words go, and rows with benchmark items on a twentieth of their words;
- packing: the rest becomes sequences of 2048 tokens, one row per piece.

Stages judge rows, not doc_ids: rows that share a doc_id but not a text fare by their texts. Rows alike in both are one row of
a group in near_duplicates and fare alike elsewhere. Any column may be null. Columns beyond those of documents go in the
first stage. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import op1_near_duplicates, op2_decontamination, op5_packing, op8_quality_classifier, op9_line_dedup
from ledgerlake.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL cannot express the classifier, the signatures or the packing; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_quality_classifier.classify(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op9_line_dedup.dedup_lines(docs.select(*COLUMNS)).where("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _without(docs: DataFrame, key: list[str], gone: DataFrame) -> DataFrame:
    """The rows of docs (with the columns of key) that are not listed. The list is short beside the texts: it is the hashed
    side, and texts are not sorted."""
    listed = gone.select(*(F.col(c).alias(f"gone_{c}") for c in key)).distinct().hint("shuffle_hash")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"gone_{c}"))
    return docs.join(listed, same, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = op1_near_duplicates.near_duplicates(docs).where("group is not null").select("doc_id", "mark", "group", "component_id")
    found = Scratch(spark, "pipeline-groups").keep(found, "groups")
    leading = found.where("doc_id <=> component_id").groupBy("group", "doc_id", "mark").agg(F.count("*").alias("rows"))
    first = leading.groupBy("group").agg(F.min("mark").alias("first"))
    leading = leading.join(first, "group")
    gone = found.where("not (doc_id <=> component_id)").select("doc_id", "mark").unionByName(leading.where("mark <> first").select("doc_id", "mark"))
    again = leading.where("mark = first and rows > 1").select("doc_id", "mark")
    key = ["doc_id", "mark"]
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("mark"))
    if again.isEmpty():
        return _without(docs, key, gone).select(*COLUMNS)
    # Rows alike in doc_id and text: one of them stays.
    listed = again.select(*(F.col(c).alias(f"again_{c}") for c in key)).hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("again_doc_id")) & (F.col("mark") == F.col("again_mark"))
    one = docs.join(listed, same, "left_semi").dropDuplicates(key)
    return _without(docs, key, gone.unionByName(again)).unionByName(one).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))
    found = op2_decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row", near=0)
    gone = Scratch(spark, "pipeline-contaminated").keep(found.where("n_windows > 0 or contaminated").select("row"), "rows")
    return _without(docs, ["row"], gone).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
