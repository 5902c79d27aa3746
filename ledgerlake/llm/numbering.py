"""Gapless numbers within groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def salts(spark: SparkSession, least: int = 64) -> int:
    """Into how many parts each group is dealt: grows with the session's shuffle partitions, as the data does."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def number_within(df: DataFrame, groups: list[str], spread: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each value of ``groups``.

    Rows are dealt into salted parts by a hash of ``spread``; each part is numbered by itself and moved up by the sizes
    of the parts before it, so a group that holds most rows is still numbered by many tasks. The table of part sizes
    has at most groups x salts rows. ``df`` must give the same rows each time it is computed.
    """
    n = salts(df.sparkSession)
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*spread, F.lit("part")), F.lit(n)).cast("int"))
    before = Window.partitionBy(*groups).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy(*groups, "_salt").agg(F.count("*").alias("_n"))
        .select(*groups, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(*groups, "_salt").orderBy(*order)
    return (
        dealt.withColumn("_row", F.row_number().over(inside))
        .join(bases, [*groups, "_salt"])
        .withColumn(name, F.col("_base") + F.col("_row") - 1)
        .drop("_salt", "_base", "_row")
    )
