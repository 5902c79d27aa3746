"""Runs and manifests as tables: what a run holds, which runs live, and what reads and writes cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.numbers import ratio
from ledgerlake.schema import SET, entry_cost


def describe_runs(log: DataFrame, run: str = "run") -> DataFrame:
    """Per run: num, size, entries, least and greatest seq and key."""
    return log.groupBy(F.col(run).alias("num")).agg(
        F.sum(entry_cost()).alias("size"), F.count("*").alias("entries"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.min("key").alias("smallest"), F.max("key").alias("largest")
    )


def fold_edits(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live runs, state) of manifest edits (version, log_number, next_file, last_seq, added, deleted).

    In an edit deletions come first. A run lives if its latest action is an addition. next_file and last_seq are the greatest
    seen, log_number the latest given.
    """
    gone = edits.select("version", F.lit(0).alias("step"), F.explode("deleted").alias("num"), F.lit(None).cast(edits.schema["added"].dataType.elementType).alias("run"))
    come = edits.select("version", F.lit(1).alias("step"), F.explode("added").alias("run")).select("version", "step", F.col("run.num").alias("num"), "run")
    latest = gone.unionByName(come).groupBy("num").agg(F.max_by(F.struct("step", "run"), F.struct("version", "step")).alias("last"))
    state = edits.agg(F.max_by("log_number", F.when(F.col("log_number").isNotNull(), F.col("version"))).alias("log_number"), F.max("next_file").alias("next_file"), F.max("last_seq").alias("last_seq"))
    return latest.where("last.step = 1").select("last.run.*"), state


def unknown_deletions(edits: DataFrame) -> DataFrame:
    """Deletions (version, num) of runs that were not live then."""
    gone = edits.select("version", F.lit(0).alias("step"), F.explode("deleted").alias("num"))
    come = edits.select("version", F.lit(1).alias("step"), F.explode("added").alias("run")).select("version", "step", F.col("run.num").alias("num"))
    before = F.lag("step").over(Window.partitionBy("num").orderBy("version", "step"))
    return gone.unionByName(come).withColumn("before", before).where("step = 0 and (before is null or before = 0)").select("version", "num")


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("max_seq"), "num")


def orphans(listed: DataFrame, live: DataFrame, log_number: Column | int) -> DataFrame:
    """Files (name, kind, num) that nothing refers to: runs that are not live, unfinished files, logs already flushed."""
    dead = listed.where("kind = 'run'").join(live.select("num"), "num", "left_anti").select("name")
    return dead.unionByName(listed.where("kind = 'temporary'").select("name")).unionByName(listed.where((F.col("kind") == "log") & (F.col("num") < log_number)).select("name"))


def may_hold(probes: DataFrame, runs: DataFrame) -> DataFrame:
    """Probe (key, snap) with each run that its seq and key bounds do not exclude. The list of runs is small by nature: a store
    keeps a dozen; it is broadcast by the session's size limit, and joined on ranges otherwise."""
    inside = (F.col("min_seq") <= F.col("snap")) & (F.col("key") >= F.col("smallest")) & (F.col("key") <= F.col("largest"))
    return probes.join(runs, inside).select("key", "snap", "num", "max_seq")


def probes_until_hit(log: DataFrame, probes: DataFrame, run: str = "run") -> DataFrame:
    """Per probe: runs consulted newest first, up to and including the first that holds a visible version."""
    runs = describe_runs(log, run)
    held = log.join(probes, "key").where("seq <= snap").groupBy("key", "snap").agg(F.max(run).alias("hit"))
    consulted = may_hold(probes, runs).join(held, ["key", "snap"], "left").where("hit is null or num >= hit")
    return probes.join(consulted.groupBy("key", "snap").agg(F.count("*").alias("consulted")), ["key", "snap"], "left").select("key", "snap", F.coalesce("consulted", F.lit(0)).cast("long").alias("consulted"))


def write_amplification(log_bytes: Column, flush_bytes: Column, merge_bytes: Column, user_bytes: Column) -> Column:
    return ratio(log_bytes + flush_bytes + merge_bytes, user_bytes)


def space_amplification(log: DataFrame) -> DataFrame:
    """Bytes of all versions over bytes of live rows."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("kind"))) == 1
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    rows = log.select("kind", newest.alias("newest"), size.alias("size"))
    sums = rows.agg(F.sum("size").alias("stored"), F.coalesce(F.sum(F.when(F.col("newest") & (F.col("kind") == SET), F.col("size"))), F.lit(0)).alias("live"))
    return sums.select("stored", "live", ratio(F.col("stored"), F.col("live")).alias("amplification"))
