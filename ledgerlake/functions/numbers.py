"""Numbers for people, percentiles, rates, and gapless sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that rows are numbered in: for each shuffle partition, in all (bounds are part of the plan), and rows a range is worth.
RANGES_A_PARTITION, MOST_RANGES, LEAST_ROWS = 4, 1024, 1024
#: Rows drawn for each range to set its bounds.
DRAWS_A_RANGE = 16


def human_bytes(n: Column) -> Column:
    """Bytes with a binary unit and one decimal from KiB on.

    Rounded as C and Go do: from the exact value, a half to the even decimal. format_string rounds a half up.
    """

    def scaled(power: int, unit: str) -> Column:
        size = n / float(1 << power)
        tenths = F.floor(size) * 10 + F.rint((size - F.floor(size)) * 10).cast("long")  # no bit is lost in the fraction
        return F.format_string(f"%d.%d {unit}", F.floor(tenths / 10), tenths % 10)

    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(10, "KiB")).when(n < 1 << 30, scaled(20, "MiB")).when(n >= 1 << 30, scaled(30, "GiB"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where there is no whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(0.0)


def number_rows(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Numbers rows first, first + 1, ... in a total order, without one task for all.

    Rows are dealt by range, counted per range, and numbered within. The order must be total and the input repeatable.
    The bounds of the ranges are fixed here, by a job over the order's columns: Spark draws bounds of its own anew for each
    reading of a repartitionByRange and merges small partitions as it runs, so rows and counts would not speak of the same ranges.
    """
    dealt = df.withColumn("_part", range_of(df, order))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_row") + (first - 1)).drop("_part", "_base", "_row")


def range_of(df: DataFrame, order: list[str]) -> Column:
    """The number of a row's range, from 0. Bounds come from some drawn rows: they decide how even the ranges are, and any bounds keep the order."""
    keys = df.select(*order)
    n, kinds = keys.count(), [f.dataType for f in keys.schema.fields]
    ranges = min(RANGES_A_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES, n // LEAST_ROWS)
    if ranges < 2:
        return F.lit(0)
    drawn = keys.sample(min(1.0, ranges * DRAWS_A_RANGE / n), seed=1).orderBy(*order).collect() or keys.take(1)
    taken = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)]
    # Sorted again as literals: a time that goes to Python and back need not keep its place.
    bounds = F.sort_array(F.array(*(F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(row, kinds, order, strict=True))) for row in taken)))
    # Bounds not above the key, found by steps of falling powers of two; past the last bound there is none to compare with.
    steps = F.array(*(F.lit(1 << p) for p in reversed(range(len(taken).bit_length()))))
    further = lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.struct(*order), at + step).otherwise(at)
    return F.coalesce(F.aggregate(steps, F.lit(0), further), F.lit(0))


def nearest_rank(df: DataFrame, group: str, value: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """Per group the value at place min(n - 1, n * a // b) of the sorted values, for each share a / b; and the greatest.

    Equal values are counted first, where they lie; only the counts of distinct values are put in order.
    """
    counts = df.groupBy(group, value).agg(F.count("*").alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumns({"_upto": upto, "_n": F.sum("_rows").over(Window.partitionBy(group))})

    def at(a: int, b: int) -> Column:
        place = F.least(F.col("_n") - 1, F.expr(f"_n * {a} div {b}"))
        return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_rows") <= place), F.col(value)))

    return ranked.groupBy(group).agg(F.sum("_rows").alias("n"), *(at(a, b).alias(name) for name, (a, b) in shares.items()), F.max(value).alias("greatest"))


def throughput(n: Column, seconds: Column) -> Column:
    return ratio(n, seconds)
