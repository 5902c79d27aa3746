import random

import pytest

from ledgerlake.operators import metadata
from ledgerlake.plans.store import State, Store, StoreOptions
from ledgerlake.schema import CHANGELOG, DELETE, SET, InvalidBatch, KeyNotFound, LedgerError, SnapshotTooOld, StoreClosed, StoreLocked
from tests.helpers import log

MANUAL = StoreOptions(auto_compact=False)


def test_writes_are_readable_and_durable_at_once(spark, tmp_path):
    s = Store.open(spark, f"{tmp_path}/db", MANUAL)
    assert s.flush() is False and s.scan().isEmpty()
    assert s.put(b"pear", b"green") == 1 and s.put(b"plum", b"blue") == 2
    assert s.get(b"pear") == b"green"
    assert s.put(b"pear", b"yellow") == 3 and s.delete(b"plum") == 4 and s.put(b"void", b"") == 5
    assert s.get(b"pear") == b"yellow" and s.snapshot(2).get(b"plum") == b"blue"
    # No flush and no close: another handle finds every write that returned, and goes on behind the last number.
    again = Store.open(spark, f"{tmp_path}/db", MANUAL)
    assert again.get(b"pear") == b"yellow" and again.get(b"void") == b"" and again.next_seq == 6
    with pytest.raises(KeyNotFound):
        again.get(b"plum")
    assert again.flush() and not again.state.log and again.stats()["runs"] == 1
    again.put(b"plum", b"red")
    assert {bytes(r["key"]): bytes(r["value"]) for r in again.scan().collect()} == {b"pear": b"yellow", b"plum": b"red", b"void": b""}
    assert [bytes(r["key"]) for r in again.scan(limit=1).collect()] == [b"pear"]
    again.close()
    again.close()
    for call in (lambda: again.put(b"x", b"y"), again.flush, again.snapshot, again.refresh):
        with pytest.raises(StoreClosed):
            call()
    assert Store.open(spark, f"{tmp_path}/db").get(b"plum") == b"red"


def test_lookup_over_runs_and_log(spark, tmp_path):
    s = Store.open(spark, f"{tmp_path}/db", MANUAL)
    for spec in ("a#1 b#2 c#3", "x#4 y#5 z#6", "b#7D c#8=new"):
        s.append(log(spark, spec))
        s.flush()
    s.append(log(spark, "d#9"))
    probes = spark.createDataFrame([(b"b",), (b"c",), (b"d",), (b"e",)], "key binary")
    found = {bytes(r["key"]): (r["result"], r["value"] and bytes(r["value"])) for r in s.lookup(probes).collect()}
    assert found == {b"b": ("Deleted", None), b"c": ("Found", b"new"), b"d": ("Found", b"v9"), b"e": ("NotFound", None)}
    # The run x..z lies beyond the probes.
    assert s.stats()["run_probes"] == 2 and s.stats()["runs_skipped"] == 1
    assert {r["result"] for r in s.snapshot(3).lookup(probes).collect()} == {"Found", "NotFound"}
    assert s.lookup(probes.limit(0)).isEmpty()


def test_a_full_log_is_flushed(spark, tmp_path):
    s = Store.open(spark, f"{tmp_path}/db", StoreOptions(auto_compact=False, flush_bytes=300, flush_segments=3))
    for i in range(1, 9):
        s.put(b"k%d" % i, b"v" * (300 if i == 1 else 1))
    stats = s.stats()
    assert stats["flushes"] == stats["runs"] == 3 and stats["log_segments"] == 1 and stats["entries"] == 7
    assert s.scan().count() == 8
    users = sum(2 + (300 if i == 1 else 1) for i in range(1, 9))
    assert stats["user_bytes"] == users and stats["log_bytes"] == users + 8 * 19 and stats["flush_bytes"] == users - 3 + 7 * 72
    assert stats["write_amplification"] == pytest.approx((stats["log_bytes"] + stats["flush_bytes"]) / users)
    assert len(stats) >= 25 and s.space_amplification() == 1.0


def _fruit(spark, store):
    """Five rounds over 30 keys; then a third of them are deleted."""
    for n in range(5):
        store.append(log(spark, " ".join(f"f{i:03d}#{n * 30 + i + 1}=round{n}" for i in range(30))))
        store.flush()
    store.append(log(spark, " ".join(f"f{i:03d}#{151 + i // 3}D" for i in range(0, 30, 3))))
    store.flush()


def test_full_compaction_and_old_snapshots(spark, tmp_path):
    s = Store.open(spark, f"{tmp_path}/db", MANUAL)
    assert s.compact() is False
    _fruit(spark, s)
    assert s.stats()["runs"] == 6 and s.stats()["entries"] == 160
    pinned = s.snapshot(90)
    assert pinned.get(b"f003") == b"round2"
    assert s.compact()
    stats = s.stats()
    assert (stats["runs"], stats["entries"], stats["dropped_tombstones"], stats["dropped_versions"], stats["floor"]) == (1, 20, 10, 130, 160)
    assert s.get(b"f004") == b"round4"
    with pytest.raises(KeyNotFound):
        s.get(b"f003")
    # A snapshot from before the merge is refused, not wrong; one pinned before still reads its version until it is vacuumed.
    with pytest.raises(SnapshotTooOld):
        s.snapshot(90)
    assert pinned.scan().count() == 30 and pinned.get(b"f003") == b"round2"
    assert s.vacuum() == 0
    few = Store(spark, f"{tmp_path}/db", StoreOptions(auto_compact=False, keep_versions=1, orphan_seconds=0))
    assert few.recovered > 0 and few.vacuum() == 0 and few.orphans() == [] and few.get(b"f004") == b"round4"


def test_retained_versions_keep_old_snapshots_right(spark, tmp_path):
    s = Store.open(spark, f"{tmp_path}/db", StoreOptions(auto_compact=False, retain=100))
    _fruit(spark, s)
    want = {seq: {bytes(r["key"]): bytes(r["value"]) for r in s.snapshot(seq).scan().collect()} for seq in (60, 75, 100, 152)}
    assert s.flush_and_compact()
    assert s.stats()["floor"] == 60 and s.stats()["dropped_versions"] == 30 and s.stats()["dropped_tombstones"] == 0
    assert {seq: {bytes(r["key"]): bytes(r["value"]) for r in s.snapshot(seq).scan().collect()} for seq in want} == want
    with pytest.raises(SnapshotTooOld):
        s.snapshot(59)


def test_a_crash_leaves_no_trace(spark, tmp_path, monkeypatch):
    """A writer that dies between writing a run or a segment and committing it: nothing is lost and nothing is in the way."""
    s = Store.open(spark, f"{tmp_path}/db", MANUAL)
    s.append(log(spark, "a#1 b#2"))

    def die(state):
        raise RuntimeError("power cut")

    monkeypatch.setattr(s, "_commit", die)
    with pytest.raises(RuntimeError):
        s.flush()
    with pytest.raises(LedgerError, match="open the store again"):
        s.put(b"c", b"d")
    other = Store.open(spark, f"{tmp_path}/db", MANUAL)
    monkeypatch.setattr(other, "_commit", die)
    with pytest.raises(RuntimeError):
        other.put(b"c", b"lost")
    again = Store.open(spark, f"{tmp_path}/db", MANUAL)
    assert len(again.orphans()) == 2 and again.recovered == 0  # young: they could be another writer's
    assert again.scan().count() == 2 and again.put(b"c", b"kept") == 3 and again.flush()
    last = Store.open(spark, f"{tmp_path}/db", StoreOptions(auto_compact=False, orphan_seconds=0, keep_versions=1))
    assert last.recovered >= 2 and last.orphans() == [] and last.get(b"c") == b"kept"


def test_partial_compaction_keeps_tombstones(spark, tmp_path):
    s = Store.open(spark, f"{tmp_path}/db", MANUAL)
    for spec in ("k#1=ancient", "a#2", "k#3D", "b#4"):
        s.append(log(spark, spec))
        s.flush()
    s._merge(0, 3)
    assert s.stats()["runs"] == 2 and s.stats()["dropped_tombstones"] == 0
    with pytest.raises(KeyNotFound):
        s.get(b"k")
    s.append(log(spark, "a#5D b#6D"))
    s.flush()
    s.compact()
    assert s.stats()["runs"] == 0 and s.scan().isEmpty()


def test_writers_race(spark, tmp_path):
    first = Store.open(spark, f"{tmp_path}/db", MANUAL)
    first.put(b"k", b"first")
    second = Store.open(spark, f"{tmp_path}/db", MANUAL)
    assert second.flush()
    for call in (lambda: first.put(b"k", b"late"), first.flush):
        with pytest.raises(StoreLocked):
            call()
    assert first.orphans() == []
    first.refresh()
    assert first.put(b"k", b"late") == 2 and first.flush() and first.get(b"k") == b"late"
    # A merge that loses is as harmless.
    with pytest.raises(StoreLocked):
        second.compact()
    second.refresh()
    assert second.compact() and second.get(b"k") == b"late" and second.stats()["dropped_versions"] == 1


def test_a_run_that_was_vacuumed_is_not_committed(spark, tmp_path, monkeypatch):
    s = Store.open(spark, f"{tmp_path}/db", MANUAL)
    s.put(b"k", b"v")
    commit = s._commit

    def vacuumed_before(state):
        Store.open(spark, f"{tmp_path}/db", StoreOptions(orphan_seconds=0))
        commit(state)

    monkeypatch.setattr(s, "_commit", vacuumed_before)
    with pytest.raises(LedgerError, match="removed before"):
        s.flush()
    assert Store.open(spark, f"{tmp_path}/db").get(b"k") == b"v"


@pytest.mark.parametrize("spec", ["a#5", "b#6 c#6", "b#4"])
def test_numbers_must_rise_and_occur_once(spark, tmp_path, spec):
    s = Store.open(spark, f"{tmp_path}/db", MANUAL)
    s.append(log(spark, "a#5"))
    with pytest.raises(InvalidBatch):
        s.append(log(spark, spec))
    assert s.orphans() == [] and s.put(b"x", b"y") == 6


def test_a_row_out_of_bounds_fails_its_batch_alone(spark, tmp_path):
    s = Store.open(spark, f"{tmp_path}/db", MANUAL)
    with pytest.raises(InvalidBatch):
        s.append(spark.createDataFrame([(bytearray(b"k"), 1, DELETE, bytearray(b"v"))], CHANGELOG))
    assert s.orphans() == [] and s.put(b"k", b"v") == 1
    with pytest.raises(ValueError):
        StoreOptions(flush_bytes=0)


def test_manifest_state():
    with pytest.raises(LedgerError, match="unknown"):
        State().apply([], {3})


def test_any_split_gives_the_same_view(spark, tmp_path):
    r = random.Random(9)
    s, model, seq = Store.open(spark, f"{tmp_path}/db", StoreOptions()), {}, 0
    for _ in range(6):
        rows = []
        for _ in range(80):
            seq += 1
            key, dead = f"key{r.randrange(60):04d}".encode(), r.random() < 0.25
            rows.append((bytearray(key), seq, DELETE if dead else SET, None if dead else bytearray(b"%d" % seq)))
            model.pop(key, None) if dead else model.__setitem__(key, b"%d" % seq)
        s.append(spark.createDataFrame(rows, CHANGELOG))
        s.flush()
    assert len(s.state.runs) < 6
    assert {bytes(x["key"]): bytes(x["value"]) for x in s.scan().collect()} == model
    assert {bytes(x["key"]) for x in s.scan(b"key0010", b"key0020").collect()} == {k for k in model if b"key0010" <= k < b"key0020"}


def test_edits_fold(spark):
    run = "struct<num:bigint,size:bigint,entries:bigint,min_seq:bigint,max_seq:bigint,smallest:binary,largest:binary>"
    shape = f"version long, log_number long, next_file long, last_seq long, added array<{run}>, deleted array<long>"
    one = lambda num, low, high: (num, 1, 1, low, high, bytearray(b"a"), bytearray(b"z"))
    edits = spark.createDataFrame([(1, 2, 2, 10, [one(1, 1, 10)], []), (2, 4, 4, 20, [one(3, 11, 20)], []), (3, None, 6, None, [one(5, 1, 20)], [1, 3])], shape)
    live, state = metadata.fold_edits(edits)
    assert [r["num"] for r in live.collect()] == [5] and tuple(state.first()) == (4, 6, 20)
    assert metadata.unknown_deletions(edits).isEmpty()
    wrong = spark.createDataFrame([(4, None, None, None, [], [1])], shape)
    assert metadata.unknown_deletions(edits.unionByName(wrong)).first()["num"] == 1
