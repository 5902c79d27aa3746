"""The changelog: rows (key, seq, kind, value), one per write, and the bounds they obey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE, SET = 0, 1
#: Sequence numbers have 56 usable bits; 0 is reserved, so a snapshot at 0 sees nothing.
MAX_SEQ = (1 << 56) - 1
#: A record's key, value and header together.
MAX_RECORD, RECORD_HEADER = 32 << 20, 19
#: What an entry costs in memory besides key and value bytes.
ENTRY_OVERHEAD = 8 + 64

CHANGELOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("kind", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)


class LedgerError(Exception):
    """Base of this library's errors."""


class InvalidRecord(LedgerError):
    """A record breaks a bound: reserved or too large sequence number, unknown kind, tombstone with a value, too large."""


class InvalidBatch(LedgerError):
    """A batch's rows break a bound, or its sequence numbers are not beyond those before or occur twice. Nothing of it was written."""


class SnapshotTooOld(LedgerError):
    """A merge has dropped versions that the snapshot would see."""


class KeyNotFound(LedgerError, KeyError):
    """The key has no live value at the snapshot."""


class StoreClosed(LedgerError):
    """The store was closed."""


class StoreLocked(LedgerError):
    """Another writer committed first, or holds the store."""


class CorruptData(LedgerError):
    """Stored bytes are damaged."""


def changelog(df: DataFrame, key: Column, seq: Column, kind: Column, value: Column) -> DataFrame:
    """Any table as a changelog; a tombstone's value is null."""
    return df.select(
        key.cast("binary").alias("key"), seq.cast("long").alias("seq"), kind.cast("tinyint").alias("kind"), F.when(kind == SET, F.coalesce(value.cast("binary"), F.lit(b""))).alias("value")
    )


def from_events(events: DataFrame) -> DataFrame:
    """One key per user; an error event deletes."""
    return changelog(
        events, F.format_string("user:%06d", F.col("user_id")), F.col("event_id") + 1, F.when(F.col("event_type") == "error", DELETE).otherwise(SET), F.col("props")
    )


def from_pages(pages: DataFrame) -> DataFrame:
    """One key per address; every fetch is a version."""
    return changelog(pages, F.col("url"), F.col("page_id") + 1, F.lit(SET), F.col("html"))


def from_orders(orders: DataFrame) -> DataFrame:
    """One key per customer; a filled order deletes."""
    return changelog(
        orders, F.format_string("cust:%06d", F.col("o_custkey")), F.col("o_orderkey") + 1, F.when(F.col("o_orderstatus") == "F", DELETE).otherwise(SET), F.col("o_orderpriority")
    )


def validated(log: DataFrame) -> DataFrame:
    """The same rows; a row that breaks a bound fails the job when it is read."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + RECORD_HEADER
    wrong = (
        F.when(F.col("seq").isNull() | (F.col("seq") < 1), "sequence number 0 is reserved")
        .when(F.col("seq") > MAX_SEQ, "sequence number beyond 56 bits")
        .when(F.col("kind").isNull() | ~F.col("kind").isin(DELETE, SET), "unknown kind")
        .when((F.col("kind") == DELETE) & F.col("value").isNotNull(), "tombstone with a value")
        .when((F.col("kind") == SET) & F.col("value").isNull(), "write without a value")
        .when(size > MAX_RECORD, "record too large")
    )
    return log.withColumn("seq", F.when(wrong.isNull(), F.col("seq")).otherwise(F.raise_error(wrong).cast("long")))


def entry_cost() -> Column:
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)).cast("long") + ENTRY_OVERHEAD


def text(*columns: str) -> list[Column]:
    """Binary columns as strings, for output."""
    return [F.col(c).cast("string").alias(c) for c in columns]
