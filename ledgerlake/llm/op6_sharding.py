"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

At each level the children of the node that was reached draw an exponential with their weight as rate, -ln(u) / weight, where
u is a hash of the row's key and the child's path, and the least draw wins; children of other nodes draw nothing. So each child
wins in proportion to its weight, which is the sum of the weights of its shards. A child whose weight changes draws more
or less often below its siblings, and no other draw changes: rows move only into or out of nodes whose weights change, and on
the way down only where those are. A new shard under nodes of its own (as in GROWN) takes rows only into itself; one put into an
old rack would make its rack and region heavier, and rows would move to its siblings there too.

Native DataFrame expressions only. The result is one row per input row. A null text counts as empty. A null key is hashed
as null: all such rows share a shard. An empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import number_within
from .scratch import Scratch

NAME = "op6_sharding"


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


#: Two regions of two racks of two shards.
TREE = tuple(Leaf(f"region{s // 4}", f"rack{s // 2}", s) for s in range(8))
#: The same tree with one more shard, in a region and a rack of its own.
GROWN = (*TREE, Leaf("region2", "rack4", 8))


def _winner(key: Column, children: dict[str, float]) -> Column:
    """The path of the child with the least draw."""

    def draw(path: str) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11)
        return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(children[path]))

    return F.array_min(F.array(*(F.struct(draw(x).alias("draw"), F.lit(x).alias("path")) for x in children)))["path"]


def _descend(key: Column, tree: tuple[Leaf, ...], names: tuple[str, ...] = ()) -> Column:
    """The names from a node (the names so far) down to the shard that the key reaches."""
    level = len(names)
    children: dict[str, list[Leaf]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            children.setdefault((leaf.region, leaf.rack, str(leaf.shard))[level], []).append(leaf)
    path = lambda x: "/".join((*names, x))
    won = _winner(key, {path(x): sum(leaf.weight for leaf in leaves) for x, leaves in children.items()})

    def below(there: Column) -> Column:
        found = F.lit(None).cast("array<string>")
        for x, leaves in children.items():
            rest = F.array(*map(F.lit, (*names, x))) if level == 2 else _descend(key, tuple(leaves), (*names, x))
            found = F.when(there == path(x), rest).otherwise(found)
        return found

    # Bound to a name, so that the winner is drawn once and only its children draw.
    return F.get(F.transform(F.array(won), below), F.lit(0))


def place(key: Column, tree: tuple[Leaf, ...]) -> Column:
    """The struct (region, rack, shard) to which the key descends."""
    return F.get(F.transform(F.array(_descend(key, tree)), lambda x: F.struct(x[0].alias("region"), x[1].alias("rack"), x[2].cast("int").alias("shard"))), F.lit(0))


def shard_of(key: Column, tree: tuple[Leaf, ...]) -> Column:
    return place(key, tree)["shard"]


def shards(docs: DataFrame, tree: tuple[Leaf, ...] = TREE, grown: tuple[Leaf, ...] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, region, rack, shard, slot (0, 1, ... within the shard) and the shard in the grown tree."""
    spark = docs.sparkSession
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    at = place(F.col(key), tree)
    rows = docs.select(
        F.col(key),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        at["region"].alias("region"),
        at["rack"].alias("rack"),
        at["shard"].alias("shard"),
        (shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    rows = Scratch(spark, "shards").keep(rows, "rows")
    return number_within(rows, ["shard"], [key, "text_crc32"], [key, "text_crc32", "size"], "slot")


def write_shards(docs: DataFrame, folder: str, tree: tuple[Leaf, ...] = TREE, key: str = "doc_id") -> None:
    """Writes the rows themselves as Parquet, one folder per shard."""
    docs.withColumn("shard", shard_of(F.col(key), tree)).write.partitionBy("shard").parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), TREE, GROWN)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
