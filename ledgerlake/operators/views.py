"""Reads: the newest version of each key at a snapshot, by point, range, prefix and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.keys import prefix_end
from ledgerlake.schema import DELETE, SET

FOUND, DELETED, NOT_FOUND = "Found", "Deleted", "NotFound"


def newest_first() -> list[Column]:
    return [F.desc("seq"), F.desc("kind")]


def bounded(log: DataFrame, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """Keys in [start, end), by unsigned bytes; None is unbounded, an empty end holds nothing. Reaches the Parquet scan."""
    if start is not None:
        log = log.where(F.col("key") >= F.lit(bytes(start)))
    if end is not None:
        log = log.where(F.col("key") < F.lit(bytes(end)))
    return log


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Each key's newest version with seq <= snapshot, tombstones included.

    The snapshot filter lies below the ranking. Each map task passes on one row per key at most (the rank limit is applied
    before the exchange), so a key that holds most rows makes no hot partition.
    """
    if snapshot is not None:
        log = log.where(F.col("seq") <= snapshot)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*newest_first()))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def view(log: DataFrame, snapshot: int | None = None, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """Live rows: the newest versions that are no tombstones."""
    return newest(bounded(log, start, end), snapshot).where(F.col("kind") == SET)


def scan(log: DataFrame, start: bytes | None = None, end: bytes | None = None, limit: int = 0, snapshot: int | None = None) -> DataFrame:
    """(key, value) in key order; limit counts live rows, <= 0 is none."""
    rows = view(log, snapshot, start, end).select("key", "value").orderBy("key")
    return rows.limit(limit) if limit > 0 else rows


def prefix_bounds(prefix: bytes, start: bytes | None = None, end: bytes | None = None) -> tuple[bytes | None, bytes | None]:
    """The part of [start, end) that has the prefix."""
    last = prefix_end(prefix)
    start = max(prefix, start) if start is not None else prefix
    if last is not None and (end is None or last < end):
        end = last
    return start, end


def prefix_scan(log: DataFrame, prefix: bytes, start: bytes | None = None, end: bytes | None = None, limit: int = 0, snapshot: int | None = None) -> DataFrame:
    return scan(log, *prefix_bounds(prefix, start, end), limit=limit, snapshot=snapshot)


def namespaced_scan(log: DataFrame, namespace: bytes, start: bytes = b"", end: bytes | None = None, limit: int = 0, snapshot: int | None = None) -> DataFrame:
    """A prefix scan whose bounds and keys are without the prefix."""
    rows = prefix_scan(log, namespace, namespace + start, None if end is None else namespace + end, limit, snapshot)
    return rows.withColumn("key", F.substring("key", len(namespace) + 1, 1 << 30))


def page(log: DataFrame, limit: int, prefix: bytes = b"", start: bytes | None = None, end: bytes | None = None, snapshot: int | None = None) -> DataFrame:
    """``limit`` rows in key order with ``next``, the key at which the following page starts (null on the last)."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    rows = prefix_scan(log, prefix, start, end, limit + 1, snapshot)
    # At most limit + 1 rows; one task numbers them.
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy("key")))
    following = F.max(F.when(F.col("_n") == limit + 1, F.col("key"))).over(Window.partitionBy())
    return numbered.withColumn("next", following).where(F.col("_n") <= limit).orderBy("key").select("key", "value", "next")


def parse_limit(given: str | None, default: int = 100, most: int = 1000) -> int:
    """A page size from text: absent is the default, larger is cut to the most, anything else must be positive."""
    if given is None or given == "":
        return default
    try:
        limit = int(given)
    except ValueError:
        raise ValueError(f"limit is not a number: {given!r}") from None
    if limit <= 0:
        raise ValueError("limit must be positive")
    return min(limit, most)


def get(log: DataFrame, key: bytes, snapshot: int | None = None) -> DataFrame:
    """The key's live row, or none."""
    return view(log.where(F.col("key") == F.lit(bytes(key))), snapshot).select("key", "value")


def _result(kind: Column) -> Column:
    return F.when(kind == SET, FOUND).when(kind == DELETE, DELETED).otherwise(NOT_FOUND)


def lookup(log: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Per probe key: Found, Deleted or NotFound, and the value. Only versions of probed keys are ranked."""
    wanted = log.join(probes.select("key").distinct(), "key", "left_semi")
    return probes.join(newest(wanted, snapshot), "key", "left").select(*probes.columns, _result(F.col("kind")).alias("result"), F.when(F.col("kind") == SET, F.col("value")).alias("value"))


def lookup_as_of(log: DataFrame, probes: DataFrame) -> DataFrame:
    """Per probe (key, snap): the state of the key at that snapshot.

    Probes and versions are merged in order of sequence number and each probe takes the version before it, so rows are
    never multiplied by probes.
    """
    wanted = log.join(probes.select("key").distinct(), "key", "left_semi")
    versions = wanted.select("key", F.col("seq").alias("at"), F.lit(0).alias("probe"), F.struct("kind", "value").alias("version"))
    asked = probes.select("key", F.col("snap").alias("at"), F.lit(1).alias("probe"), F.lit(None).cast(versions.schema["version"].dataType).alias("version"))
    before = Window.partitionBy("key").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = versions.unionByName(asked).withColumn("version", F.last("version", ignorenulls=True).over(before)).where("probe = 1")
    kind = F.col("version.kind")
    return merged.select("key", F.col("at").alias("snap"), _result(kind).alias("result"), F.when(kind == SET, F.col("version.value")).alias("value"))


def seek(log: DataFrame, key: bytes, seq: int, kind: int = SET) -> DataFrame:
    """The first version at or after (key, seq, kind) in the order key up, seq down, kind down."""
    at, k = F.lit(bytes(key)), F.col("key")
    later = (k > at) | ((k == at) & ((F.col("seq") < seq) | ((F.col("seq") == seq) & (F.col("kind") <= kind))))
    return log.where(later).orderBy("key", *newest_first()).limit(1)


def history(log: DataFrame, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """All versions, keys up and newest first, with their number within the key from 1."""
    number = F.row_number().over(Window.partitionBy("key").orderBy(*newest_first()))
    return bounded(log, start, end).withColumn("version", number).orderBy("key", "version")


def merge(runs: list[DataFrame]) -> DataFrame:
    """The union of runs; a version held by several runs is one."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out.dropDuplicates(["key", "seq", "kind"])


def envelope(rows: DataFrame) -> DataFrame:
    """Values as text where they are valid UTF-8, else as base64; an empty value shows in neither."""
    valid, some = F.is_valid_utf8("value"), F.octet_length("value") > 0
    return rows.select("key", F.when(valid & some, F.col("value").cast("string")).alias("value"), F.when(~valid & some, F.base64("value")).alias("value_b64"))
