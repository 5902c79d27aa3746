"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import Scratch


def _kept(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """The written table, and what tells whether it has changed: its size and a hash of its rows, observed while writing."""
    seen = Observation()
    mark = F.xxhash64("u", "v")
    kept = scratch.keep(edges.distinct().observe(seen, F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.bit_xor(mark.bitwiseAND(F.lit(0x5555555555555555)) + F.lit(1)).alias("y")), "links")
    return kept, tuple(sorted(seen.get.items()))


def components(links: DataFrame, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """(id, component) for every end of a link (a, b); component is the least id that it reaches. ``known`` are components that
    hold already.

    Each step points nodes at the least neighbour they know; the table of links is written after each, so lineage stays
    short, and stops changing after about log(longest path) steps. Links are never collected.
    """
    given = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if known is not None:
        given = given.unionByName(known.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v")))
    edges, mark = _kept(given, scratch)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        pointed = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after, fresh = _kept(pointed, scratch)
        scratch.drop(edges)
        edges = after
        if fresh == mark:
            break
        mark = fresh
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
