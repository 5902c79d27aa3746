"""Admission: token buckets per client and a byte budget, over ordered requests."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class TokenBucket:
    """``rate`` tokens a second up to ``burst``; at most ``clients`` clients, beyond which unknown ones are refused."""

    rate: float
    burst: float
    clients: int = 10_000
    state: dict[str, tuple[float, float]] = field(default_factory=dict)

    def allow(self, client: str, now: float) -> tuple[bool, float]:
        """Whether the request passes, and the seconds to wait if not (one at least)."""
        if client not in self.state and len(self.state) >= self.clients:
            full = [c for c, (tokens, at) in self.state.items() if tokens + (now - at) * self.rate >= self.burst]
            for c in full:
                del self.state[c]
            if len(self.state) >= self.clients:
                return False, 1.0
        tokens, at = self.state.get(client, (self.burst, now))
        tokens = min(self.burst, tokens + max(0.0, now - at) * self.rate)
        ok = tokens >= 1
        self.state[client] = (tokens - 1 if ok else tokens, now)
        return ok, 0.0 if ok else max(1.0, (1 - tokens) / self.rate)


def rate_limited(requests: DataFrame, rate: float, burst: float, clients: int | None = None) -> DataFrame:
    """Requests (client, at seconds, id) with allowed and retry_after. Each client's requests are folded in order as a stream.

    With ``clients`` at most so many clients have a bucket at a time. That is one decision after the other over all requests, so
    one task takes them in order then, with ``clients`` buckets in memory; it suits the requests of one server.
    """
    columns = "client string, at double, id long, allowed boolean, retry_after double"

    def fold_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(rate, burst, clients)
        for batch in batches:
            verdicts = [bucket.allow(name, at) for name, at in zip(batch["client"], batch["at"], strict=True)]
            yield batch.assign(allowed=[v[0] for v in verdicts], retry_after=[v[1] for v in verdicts])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, client = None, object()
        for batch in batches:
            verdicts = []
            for name, at in zip(batch["client"], batch["at"], strict=True):
                if name != client:
                    bucket, client = TokenBucket(rate, burst), name
                verdicts.append(bucket.allow(name, at))
            yield batch.assign(allowed=[v[0] for v in verdicts], retry_after=[v[1] for v in verdicts])

    rows = requests.select(F.col("client").cast("string"), F.col("at").cast("double"), F.col("id").cast("long"))
    if clients is not None:
        return rows.repartition(1).sortWithinPartitions("at", "id").mapInPandas(fold_all, columns)
    return rows.repartition("client").sortWithinPartitions("client", "at", "id").mapInPandas(fold, columns)


def within_budget(writes: DataFrame, budget: int, order: str = "seq") -> DataFrame:
    """Writes (namespace, seq, cost) with admitted: a write passes if what was admitted before, in the given order, leaves room;
    refused ones take none."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, at = 0, object()
        for batch in batches:
            admitted = []
            for name, cost in zip(batch["namespace"], batch["cost"].tolist(), strict=True):
                if name != at:
                    used, at = 0, name
                ok = used + cost <= budget
                used += cost if ok else 0
                admitted.append(ok)
            yield batch.assign(admitted=admitted)

    rows = writes.select(F.col("namespace").cast("string"), F.col("seq").cast("long"), F.col("cost").cast("long"), F.col(order).alias("_at"))
    rows = rows.repartition("namespace").sortWithinPartitions("namespace", "_at").drop("_at")
    return rows.mapInPandas(fold, "namespace string, seq long, cost long, admitted boolean")
