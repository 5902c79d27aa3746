"""A seeded workload of overwrites and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.schema import SET


def writes(spark: SparkSession, keys: int, n: int, value_bytes: int = 100, seed: int = 1) -> DataFrame:
    """n uniform overwrites of ``keys`` keys of 16 bytes, as a changelog."""
    at = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(keys))
    value = F.substring(F.repeat(F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256), value_bytes // 64 + 1), 1, value_bytes)
    return spark.range(n).select(
        F.format_string("user%012d", at).cast("binary").alias("key"), (F.col("id") + 1).alias("seq"), F.lit(SET).cast("tinyint").alias("kind"), value.cast("binary").alias("value")
    )


def reads(spark: SparkSession, keys: int, n: int, misses: float = 0.5, seed: int = 2) -> DataFrame:
    """n probes, of which a share asks for keys that no one wrote."""
    miss = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(misses * 1_000_000)
    at = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(keys))
    return spark.range(n).select("id", F.format_string("user%012d", F.when(miss, at + keys).otherwise(at)).cast("binary").alias("key"))
