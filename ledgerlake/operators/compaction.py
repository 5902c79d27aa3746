"""Garbage collection of versions, and the choice of runs to merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.schema import DELETE

KEPT, DROPPED_VERSION, DROPPED_TOMBSTONE = "kept", "dropped_version", "dropped_tombstone"


def classify(log: DataFrame, bottom: bool, horizon: int | None = None) -> DataFrame:
    """Adds fate. Versions beyond the horizon are kept; of the others a key keeps its newest, unless that is a tombstone and
    the merge holds the oldest run (bottom)."""
    if horizon is None:
        newest_first = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("kind"))
        nth, old = F.row_number().over(newest_first), F.lit(True)
    else:
        old = F.col("seq") <= horizon
        newest_first = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        nth = F.sum(old.cast("int")).over(newest_first)
    fate = F.when(~F.col("_old"), KEPT).when(F.col("_nth") > 1, DROPPED_VERSION)
    if bottom:
        fate = fate.when(F.col("kind") == DELETE, DROPPED_TOMBSTONE)
    return log.withColumn("_nth", nth).withColumn("_old", old).withColumn("fate", fate.otherwise(KEPT)).drop("_nth", "_old")


def compacted(log: DataFrame, bottom: bool, horizon: int | None = None) -> DataFrame:
    """What a merge of these versions writes. Without a horizon each map task passes on one row per key at most."""
    if horizon is None:
        from ledgerlake.operators.views import newest

        rows = newest(log)
        return rows.where(F.col("kind") != DELETE) if bottom else rows
    return classify(log, bottom, horizon).where(F.col("fate") == KEPT).drop("fate")


def survivors(log: DataFrame, bottom: bool, horizon: int | None = None) -> DataFrame:
    """One pass for a merge: per row that is no dropped version its fate (kept or dropped_tombstone) and ``replaced``, the number
    of dropped versions of its key that it stands for."""
    key = Window.partitionBy("key")
    newest_first = key.orderBy(F.desc("seq"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    old = F.lit(True) if horizon is None else F.col("seq") <= horizon
    counted = log.withColumn("_old", old).withColumns({"_nth": F.sum(F.col("_old").cast("int")).over(newest_first), "_all": F.sum(F.col("_old").cast("int")).over(key)})
    dead = F.col("_old") & (F.col("kind") == DELETE) if bottom else F.lit(False)
    rows = counted.where(~F.col("_old") | (F.col("_nth") == 1)).withColumns({"fate": F.when(dead, DROPPED_TOMBSTONE).otherwise(KEPT), "replaced": F.when(F.col("_old"), F.col("_all") - 1).otherwise(0)})
    return rows.drop("_old", "_nth", "_all")


def statistics(log: DataFrame, bottom: bool, horizon: int | None = None) -> DataFrame:
    """One row: input, output, dropped versions and dropped tombstones; the last three add up to the first."""
    count = lambda fate: F.count_if(F.col("fate") == fate)
    return classify(log, bottom, horizon).agg(
        F.count("*").alias("input"), count(KEPT).alias("output"), count(DROPPED_VERSION).alias("dropped_versions"), count(DROPPED_TOMBSTONE).alias("dropped_tombstones")
    )


@dataclass(frozen=True)
class PickOptions:
    """Sizes of a merge: least and most runs, how far sizes may differ from their average, and how many runs are too many."""

    least: int = 4
    most: int = 16
    spread: float = 2.0
    too_many: int = 12

    def normal(self) -> "PickOptions":
        least = self.least if self.least >= 2 else 4
        return PickOptions(least, self.most if self.most > 0 and self.most >= least else max(16, least), self.spread if self.spread > 1 else 2.0, self.too_many if self.too_many > 0 else 12)


def pick(sizes: list[int], options: PickOptions = PickOptions()) -> tuple[int, int] | None:
    """Which neighbours among runs (newest first) to merge, as a half-open range; None if none.

    The longest range of runs that each lie within a factor of the average of the runs before them in the range, the first on
    ties, if it is long enough. Otherwise, with too many runs, the lightest range of the least length.
    """
    o = options.normal()
    ranges = []
    for start in range(len(sizes)):
        total, end = max(sizes[start], 1), start + 1
        while end < len(sizes) and end - start < o.most:
            average, size = total / (end - start), max(sizes[end], 1)
            if not average / o.spread <= size <= average * o.spread:
                break
            total, end = total + size, end + 1
        ranges.append((start, end))
    best = max(ranges, key=lambda r: r[1] - r[0], default=(0, 0))
    if best[1] - best[0] >= o.least:
        return best
    if len(sizes) > o.too_many:
        return min(((s, s + o.least) for s in range(len(sizes) - o.least + 1)), key=lambda r: sum(sizes[r[0] : r[1]]))
    return None
