"""Replicated logs as tables: folding, commit index, votes, conflicts, convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.schema import DELETE, SET

NOOP = 2
#: Positions of a log that one task folds at a time.
PART = 1 << 14


def fold_log(records: DataFrame, part: int = PART) -> DataFrame:
    """The entries that survive of records (pos, rec, index, term, ...).

    An ENTRY overwrites its index and drops what follows it; TRUNC drops everything from its index, and nothing if the log ends
    before it. So an entry survives if no later record has an index at or below its own. An entry beyond the log's end leaves a
    gap: it starts the log anew, which drops all before it. The end is the last entry's index, or less where a TRUNC since
    then cut below it.
    """
    edits = records.where(F.col("rec").isin("ENTRY", "TRUNC")).withColumn("_part", F.floor(F.col("pos") / part))
    entry = F.col("rec") == "ENTRY"
    end = F.when(entry, F.col("index")).otherwise(F.col("index") - 1)
    # Within a part records are folded in order; ``_turn`` counts the entries up to a record, so the least end of a turn is the log's end there.
    in_order = Window.partitionBy("_part").orderBy("pos")
    turns = edits.withColumn("_turn", F.count_if(entry).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_end", end)
    # What crosses a part's ends is one row a part: the log's end before it, and the least index after it.
    by_turn = turns.groupBy("_part", "_turn").agg(F.min("_end").alias("_end"), F.min("index").alias("_low"))
    sums = by_turn.groupBy("_part").agg(F.max_by("_end", "_turn").alias("_end"), F.max("_turn").alias("_entries"), F.min("_low").alias("_low"))
    over_parts = Window.orderBy("_part")
    sums = sums.withColumn("_era", F.sum(F.when(F.col("_entries") > 0, 1).otherwise(0)).over(over_parts.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    in_era = Window.partitionBy("_era").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_end", F.min("_end").over(in_era))
    around = sums.select("_part", F.lag("_end").over(over_parts).alias("_before"), F.min("_low").over(over_parts.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    placed = turns.join(F.broadcast(around), "_part")
    # The end before a record: the least end of the turn that the record before it is in; of the part before, if there is none.
    least = F.min("_end").over(Window.partitionBy("_part", "_turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = placed.withColumn("_reached", F.when(F.col("_turn") == 0, F.least(least, "_before")).otherwise(least))
    last = F.coalesce(F.lag("_reached").over(in_order), F.col("_before"), F.lit(0))
    gaps = reached.withColumn("_reset", entry & (F.col("index") > last + 1))
    anew = gaps.where("_reset").agg(F.max("pos").alias("_anew"))
    kept = gaps.withColumn("_least", F.least(F.min("index").over(in_order.rowsBetween(1, Window.unboundedFollowing)), F.col("_after"))).join(F.broadcast(anew))  # one row
    alive = entry & (F.col("_least").isNull() | (F.col("_least") > F.col("index"))) & (F.col("_anew").isNull() | (F.col("pos") >= F.col("_anew")))
    return kept.where(alive).select(*records.columns)


def hard_state(records: DataFrame) -> DataFrame:
    """The last (term, voted_for) written."""
    return records.where("rec = 'HARD'").agg(F.max_by("term", "pos").alias("term"), F.max_by("voted_for", "pos").alias("voted_for"))


def commit_index(matches: DataFrame, log: DataFrame) -> DataFrame:
    """Per group (members' match indexes, current term): the highest index on a majority whose entry is of the current term."""
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("match"), "node"))
    n = F.count("*").over(Window.partitionBy("grp"))
    majority = matches.withColumn("_rank", rank).withColumn("_n", n).where("_rank = _n div 2 + 1").select("grp", F.col("match").alias("agreed"), "current_term")
    reached = majority.join(log.select("grp", "index", "term"), "grp").where((F.col("index") <= F.col("agreed")) & (F.col("term") == F.col("current_term")))
    return majority.join(reached.groupBy("grp").agg(F.max("index").alias("commit")), "grp", "left").select("grp", F.coalesce("commit", F.lit(0)).cast("long").alias("commit"))


def grants_vote(term: Column, voted_for: Column, last_term: Column, last_index: Column, candidate: Column, its_term: Column, its_last_term: Column, its_last_index: Column) -> Column:
    """Whether a voter grants: the term is not old, no other got its vote in that term, and the candidate's log is as new."""
    free = (its_term > term) | voted_for.isNull() | (voted_for == candidate)
    return (its_term >= term) & free & (F.struct(its_last_term, its_last_index) >= F.struct(last_term, last_index))


def first_conflict(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """One row: the least index at which two logs (index, term) differ or one ends; null if they are equal."""
    a, b = leader.select("index", F.col("term").alias("a")), follower.select("index", F.col("term").alias("b"))
    return a.join(b, "index", "full").where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.min("index").alias("conflict"))


def conflict_hint(follower: DataFrame, prev_index: int, prev_term: int) -> DataFrame:
    """What a follower answers an append that does not fit: (conflict_index, conflict_term); nulls if it fits.

    A short log answers the index after its last. A wrong term answers that term and its first index.
    """
    facts = follower.agg(F.coalesce(F.max("index"), F.lit(0)).alias("last"), F.max(F.when(F.col("index") == prev_index, F.col("term"))).alias("there"))
    firsts = follower.groupBy(F.col("term").alias("there")).agg(F.min("index").alias("first"))
    fits = (F.lit(prev_index) == 0) | (F.coalesce(F.col("there"), F.lit(-1)) == prev_term)
    return facts.join(firsts, "there", "left").select(
        F.when(fits, None).when(F.col("last") < prev_index, F.col("last") + 1).otherwise(F.col("first")).alias("conflict_index"),
        F.when(fits | (F.col("last") < prev_index), None).otherwise(F.col("there")).alias("conflict_term"),
    )


def committed_changelog(entries: DataFrame, commit: int) -> DataFrame:
    """Committed entries as a changelog. A no-op changes nothing; the entry's index is the seq, so applying twice is harmless."""
    return entries.where((F.col("index") <= commit) & F.col("kind").isin(DELETE, SET)).select("key", F.col("index").alias("seq"), F.col("kind").cast("tinyint").alias("kind"), "value")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two replicas holds, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
