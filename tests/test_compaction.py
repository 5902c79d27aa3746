import random

import pytest

from ledgerlake.operators import compaction, views
from ledgerlake.operators.compaction import PickOptions, pick
from ledgerlake.schema import CHANGELOG, DELETE, SET
from tests.helpers import items, log, show

FRUIT = "fig#4, fig#3, kiwi#12D, kiwi#11D, lime#10, lime#7D, lime#1, pear#6D, plum#9"


@pytest.mark.parametrize(
    ("bottom", "horizon", "out", "counts"),
    [
        (False, None, "fig#4, kiwi#12D, lime#10, pear#6D, plum#9", (9, 5, 4, 0)),
        (True, None, "fig#4, lime#10, plum#9", (9, 3, 4, 2)),
        (True, 8, "fig#4, kiwi#12D, kiwi#11D, lime#10, plum#9", (9, 5, 2, 2)),
        (False, 0, FRUIT, (9, 9, 0, 0)),
    ],
)
def test_what_a_merge_drops(spark, bottom, horizon, out, counts):
    rows = log(spark, FRUIT)
    assert show(compaction.compacted(rows, bottom, horizon)) == items(out)
    assert tuple(compaction.statistics(rows, bottom, horizon).first()) == counts


def model_of_merge(rows, bottom, horizon):
    """What is kept, how many versions and how many tombstones go; key by key."""
    kept, versions, tombstones = [], 0, 0
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: -r[1])
        kept += [r for r in mine if r[1] > horizon]
        old = [r for r in mine if r[1] <= horizon]
        versions += max(len(old) - 1, 0)
        if old and bottom and old[0][2] == DELETE:
            tombstones += 1
        else:
            kept += old[:1]
    return sorted(r[:3] for r in kept), versions, tombstones


@pytest.mark.parametrize("bottom", [True, False])
@pytest.mark.parametrize("horizon", [0, 130, 400])
def test_merges_of_random_logs(spark, bottom, horizon):
    r = random.Random(horizon + bottom)
    rows = [(f"k{r.randrange(40)}".encode(), i + 1, r.choice((DELETE, SET, SET))) for i in range(400)]
    changes = spark.createDataFrame([(bytearray(k), s, kind, None if kind == DELETE else bytearray(b"v")) for k, s, kind in rows], CHANGELOG)
    kept, versions, tombstones = model_of_merge(rows, bottom, horizon)
    assert sorted((bytes(x["key"]), x["seq"], x["kind"]) for x in compaction.compacted(changes, bottom, horizon).collect()) == kept
    assert tuple(compaction.statistics(changes, bottom, horizon).first()) == (400, len(kept), versions, tombstones)
    judged = compaction.survivors(changes, bottom, horizon).collect()
    assert sorted((bytes(x["key"]), x["seq"], x["kind"]) for x in judged if x["fate"] == compaction.KEPT) == kept
    assert sum(x["replaced"] for x in judged) == versions and sum(x["fate"] == compaction.DROPPED_TOMBSTONE for x in judged) == tombstones


def model_of_pick(sizes, o):
    """All ranges whose every run lies near the average of those before it; the longest, else the lightest if there are too many runs."""
    even = lambda s, e: all(sum(max(x, 1) for x in sizes[s:k]) / (k - s) / o.spread <= max(sizes[k], 1) <= sum(max(x, 1) for x in sizes[s:k]) / (k - s) * o.spread for k in range(s + 1, e))
    ranges = [(s, e) for s in range(len(sizes)) for e in range(s + 1, min(len(sizes), s + o.most) + 1) if even(s, e)]
    longest = min(ranges, key=lambda x: (x[0] - x[1], x[0]), default=(0, 0))
    if longest[1] - longest[0] >= o.least:
        return longest
    starts = range(len(sizes) - o.least + 1) if len(sizes) > o.too_many else ()
    return min(((s, s + o.least) for s in starts), key=lambda x: (sum(sizes[x[0] : x[1]]), x[0]), default=None)


def test_pick_against_all_ranges():
    r, found = random.Random(11), set()
    for _ in range(3000):
        sizes = [int(r.choice((3, 30, 300)) ** r.uniform(0.5, 2)) for _ in range(r.randrange(18))]
        o = r.choice((PickOptions(), PickOptions(2, 3, 1.5, 4), PickOptions(3, 6, 4.0, 8)))
        assert pick(sizes, o) == model_of_pick(sizes, o)
        found.add(pick(sizes, o) is None)
    assert found == {True, False} and pick([]) is None


def test_collection_keeps_every_later_read(spark):
    r = random.Random(3)
    rows = [(bytearray(f"k{r.randrange(30)}".encode()), i + 1, DELETE if r.random() < 0.3 else SET) for i in range(600)]
    changes = spark.createDataFrame([(k, s, kind, None if kind == DELETE else bytearray(b"%d" % s)) for k, s, kind in rows], CHANGELOG).cache()
    kept = compaction.compacted(changes, True, 300).cache()
    assert sorted(map(tuple, compaction.compacted(kept, True, 300).collect())) == sorted(map(tuple, kept.collect()))
    for snap in (300, 301, 450, 600):
        assert show(views.view(changes, snap)) == show(views.view(kept, snap))
    changes.unpersist()
    kept.unpersist()
