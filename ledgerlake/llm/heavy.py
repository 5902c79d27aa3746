"""Joins with a list of keys, some of which may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of all rows from which a key is heavy.
HEAVY = 1 / 1024


def join_listed(rows: DataFrame, listed: DataFrame, keys: list[str], weight: str, total: int, share: float = HEAVY) -> DataFrame:
    """rows joined with ``listed``, which has each key once and in ``weight`` how many of the ``total`` rows have it.

    Keys of ``share`` of all rows or more are 1 / share at most: they are sent to the rows, which stay where they are. The
    rest are joined by shuffle, so no task reads more than that share of one key. Both tables should be stored ones, as
    they are read more than once.
    """
    heavy = F.col(weight) >= max(2, total * share)
    few, many = F.broadcast(listed.where(heavy).drop(weight)), listed.where(~heavy).drop(weight)
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(many, keys))
