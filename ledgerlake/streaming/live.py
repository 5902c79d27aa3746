"""Streams of changes: the live view, ordered application, and rate limits, kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlake.operators.limits import TokenBucket
from ledgerlake.schema import SET


def newest_by_key(changes: DataFrame) -> DataFrame:
    """Each key's newest version; also for streams. The greatest (seq, kind) wins, so late and reordered rows are harmless."""
    order = F.struct("seq", "kind")
    return changes.groupBy("key").agg(F.max(order).alias("_at"), F.max_by("value", order).alias("value")).select("key", F.col("_at.seq").alias("seq"), F.col("_at.kind").alias("kind"), "value")


def keep_view(changes: DataFrame, table: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that keeps each key's newest version in a folder, a new subfolder per batch; the latest whole one counts.

    Only keys of the batch's aggregate are written by Spark's complete mode; a restart continues from the checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number:012d}")

    started = newest_by_key(changes).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return started.trigger(**(trigger or {"availableNow": True})).start()


def read_view(spark, table: str) -> DataFrame:
    """Live rows of the newest batch that a keep_view query has written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in files.listStatus(path))
    whole = [n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{table}/{whole[-1]}").where(F.col("kind") == SET).select("key", "seq", "value")


def apply_in_order(commands: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], trigger: dict | None = None):
    """Hands each batch, sorted by index, to the sink with its number; a batch that is seen again has the same number."""
    ordered = commands.writeStream.foreachBatch(lambda batch, number: sink(batch.repartitionByRange("index").sortWithinPartitions("index"), number))
    return ordered.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rate_limited(requests: DataFrame, rate: float, burst: float, idle_seconds: float | None = None) -> DataFrame:
    """A stream of requests (client, at seconds, id) with allowed and retry_after; a client's bucket is its state.

    With ``idle_seconds`` a bucket that saw no request for so long (take burst / rate or more: it is full again by then) is
    dropped, which bounds the state. That needs a query that keeps running; a query that ends with its input needs none.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        bucket = TokenBucket(rate, burst)
        if state.exists:
            bucket.state[key[0]] = state.get
        verdicts = [bucket.allow(key[0], at) for at in rows["at"].tolist()]
        state.update(bucket.state[key[0]])
        if idle_seconds is not None:
            state.setTimeoutDuration(int(idle_seconds * 1000))
        yield rows.assign(allowed=[v[0] for v in verdicts], retry_after=[v[1] for v in verdicts])[["client", "at", "id", "allowed", "retry_after"]]

    return requests.groupBy("client").applyInPandasWithState(step, "client string, at double, id long, allowed boolean, retry_after double", "tokens double, at double", "append", timeout)
