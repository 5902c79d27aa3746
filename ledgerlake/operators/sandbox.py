"""A namespace that anyone may write to: size limits, rates per client and over all, and a budget of bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.limits import rate_limited, within_budget
from ledgerlake.schema import SET

OK, TOO_OFTEN, BAD_KEY, BAD_VALUE, FULL = "ok", "too often", "bad key", "bad value", "full"


@dataclass(frozen=True)
class SandboxLimits:
    """Rates are per minute; a client's burst is a third of its rate, the burst of all a sixth of theirs, one at least."""

    prefix: bytes = b"demo/"
    key_bytes: int = 64
    value_bytes: int = 1 << 10
    total_bytes: int = 8 << 20
    entry_bytes: int = 100 + 64
    client_rate: float = 30
    total_rate: float = 600


def admit(requests: DataFrame, limits: SandboxLimits = SandboxLimits()) -> DataFrame:
    """Requests (client, at seconds, id, key, kind, value) with verdict, the first rule that refuses them, and cost.

    In the order of at and id: a client's rate, the rate of all that are left, the key's length, the value's length, and the
    budget, of which refused requests use nothing and deletes use some. The rate of all and the budget are one decision after
    the other, over 24 bytes a request; one task takes them.
    """
    asked = requests.withColumn("id", F.col("id").cast("long"))
    paced = rate_limited(asked.select("client", "at", "id"), limits.client_rate / 60, max(1, limits.client_rate / 3)).where("allowed")
    all_paced = rate_limited(paced.select(F.lit("all").alias("client"), "at", "id"), limits.total_rate / 60, max(1, limits.total_rate / 6)).where("allowed")
    key, value = F.octet_length("key"), F.when(F.col("kind") == SET, F.coalesce(F.octet_length("value"), F.lit(0))).otherwise(0)
    kept = asked.join(all_paced.select("id", F.lit(True).alias("_paced")), "id", "left")
    refused = F.when(F.col("_paced").isNull(), TOO_OFTEN).when(F.col("key").isNull() | (key == 0) | (key > limits.key_bytes), BAD_KEY).when(value > limits.value_bytes, BAD_VALUE)
    sized = kept.withColumns({"_refused": refused, "cost": F.coalesce(key, F.lit(0)) + len(limits.prefix) + value + limits.entry_bytes}).drop("_paced")
    # The budget is claimed in order of time.
    order = F.struct("at", "id")
    claims = sized.where("_refused is null").select(F.lit("all").alias("namespace"), F.col("id").alias("seq"), "cost", order.alias("_order"))
    taken = within_budget(claims, limits.total_bytes, "_order").select(F.col("seq").alias("id"), "admitted")
    out = sized.join(taken, "id", "left").withColumn("verdict", F.coalesce("_refused", F.when(F.col("admitted"), OK).otherwise(FULL)))
    return out.drop("_refused", "admitted")


def admitted_writes(judged: DataFrame, limits: SandboxLimits = SandboxLimits()) -> DataFrame:
    """The admitted requests as writes (key with the namespace's prefix, kind, value), with at and id to number them by."""
    return judged.where(F.col("verdict") == OK).select(F.concat(F.lit(limits.prefix), F.col("key")).alias("key"), "kind", F.when(F.col("kind") == SET, F.coalesce("value", F.lit(b""))).alias("value"), "at", "id")
