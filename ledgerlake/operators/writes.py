"""Writes: versions from batches of puts and deletes, and where a log is cut into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.numbers import number_rows
from ledgerlake.schema import DELETE, SET, entry_cost

#: Sequence numbers that one task folds at a time.
PART = 1 << 18


def puts(rows: DataFrame, order: list[str], first: int) -> DataFrame:
    """Rows (key, value) as SET versions, numbered from first in the given order. An empty value is a value."""
    made = rows.select("key", F.lit(SET).cast("tinyint").alias("kind"), F.coalesce("value", F.lit(b"")).alias("value"), *[c for c in order if c not in ("key", "value")])
    return number_rows(made, order, "seq", first).select("key", "seq", "kind", "value")


def deletes(keys: DataFrame, order: list[str], first: int) -> DataFrame:
    """Keys as tombstones. A key that was never written may be deleted, and takes a number too."""
    made = keys.select("key", F.lit(DELETE).cast("tinyint").alias("kind"), F.lit(None).cast("binary").alias("value"), *[c for c in order if c != "key"])
    return number_rows(made, order, "seq", first).select("key", "seq", "kind", "value")


def flush_threshold(memtable: int = 4 << 20, most: int = 256 << 20) -> int:
    return max(1, min(memtable, most // 2))


def flush_numbers(log: DataFrame, threshold: int, part: int = PART) -> DataFrame:
    """(seq, cost, run): a log cut into runs. The size is tested before each write and starts anew with each run.

    Where a cut lies depends on the cut before it, so the log is folded in three steps. Parts of ``part`` sequence numbers
    find, for every place near their start at which a run could begin, the size that they hand on and the number of cuts
    (at most threshold / 72 places a part). One task follows the sizes from part to part over that list. Then parts are
    cut, each from the size that reaches it.
    """
    rows = log.select(F.floor(F.col("seq") / part).alias("part"), "seq", entry_cost().alias("cost"))

    def entries(key: tuple, of: pd.DataFrame) -> pd.DataFrame:
        cost = of.sort_values("seq")["cost"].to_numpy()
        total, n = np.concatenate([[0], np.cumsum(cost)]), len(cost)
        # A run that begins at row i ends with the row that brings it to the threshold.
        after = np.searchsorted(total, total[:-1] + threshold)
        out, cuts = (total[n] - total).tolist(), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                out[i], cuts[i] = out[after[i]], cuts[after[i]] + 1
        first = min(n, int(np.searchsorted(total, threshold)))
        k = np.arange(first + 1)
        return pd.DataFrame({"part": key[0], "k": k, "before": total[k], "rows": n, "total": int(total[n]), "size": np.array(out)[k], "cuts": np.array(cuts)[k]})

    listed = rows.groupBy("part").applyInPandas(entries, "part long, k long, before long, rows long, total long, size long, cuts long")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, run, reached, handed, at = 0, 0, True, (0, 0), None
        for batch in batches:
            made = []
            for r in batch.itertuples(index=False):
                if r.part != at:
                    size, run = handed
                    made.append((r.part, size, run))
                    # Until a place is found at which the run that comes in is full, it takes the whole part.
                    at, reached, handed = r.part, False, (size + r.total, run)
                if not reached and size + r.before >= threshold and (r.before or size):
                    reached = True
                    handed = (size + r.total, run) if r.k == r.rows else (r.size, run + 1 + r.cuts)
            yield pd.DataFrame(made, columns=["part", "size", "run"])

    reaching = listed.repartition(1).sortWithinPartitions("part", "k").mapInPandas(follow, "part long, size long, run long")

    def cut(key: tuple, of: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("seq")
        size, run, runs = int(come["size"].iloc[0]), int(come["run"].iloc[0]), []
        for cost in of["cost"].tolist():
            if size >= threshold:
                size, run = 0, run + 1
            size += cost
            runs.append(run)
        return of[["seq", "cost"]].assign(run=runs)

    return rows.groupBy("part").cogroup(reaching.groupBy("part")).applyInPandas(cut, "seq long, cost long, run long")


def flush_numbers_by(log: DataFrame, shard: str, threshold: int) -> DataFrame:
    """As flush_numbers, for the log of each shard."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, run, at = 0, 0, None
        for batch in batches:
            runs = []
            for name, cost in zip(batch["shard"].tolist(), batch["cost"].tolist(), strict=True):
                if name != at:
                    size, run, at = 0, 0, name
                elif size >= threshold:
                    size, run = 0, run + 1
                size += cost
                runs.append(run)
            yield batch.assign(run=runs)

    rows = log.select(F.col(shard).cast("string").alias("shard"), "seq", entry_cost().alias("cost"))
    return rows.repartition("shard").sortWithinPartitions("shard", "seq").mapInPandas(cut, "shard string, seq long, cost long, run long")
