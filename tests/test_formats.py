import pytest

from ledgerlake.functions import bloom, codecs
from ledgerlake.functions.codecs import Edit, RunMeta
from ledgerlake.functions.numbers import human_bytes
from ledgerlake.plans import registry
from ledgerlake.schema import CorruptData, InvalidRecord
from ledgerlake.sources import wal
from tests.helpers import log, show

PAYLOADS = [bytes([97 + i]) * (i * 7 % 50) for i in range(6)]
LOG = b"".join(map(codecs.encode_frame, PAYLOADS))


def test_crc():
    assert codecs.crc32c(b"123456789") == 0xE3069283


def test_torn_at_every_byte():
    ends = [0]
    for p in PAYLOADS:
        ends.append(ends[-1] + 8 + len(p))
    for cut in range(len(LOG) + 1):
        whole = max(i for i, e in enumerate(ends) if e <= cut)
        found = codecs.replay(LOG[:cut])
        assert found.payloads == PAYLOADS[:whole] and found.valid_bytes == ends[whole] and found.torn_bytes == cut - ends[whole]


def test_damage():
    last = LOG[:-1] + bytes([LOG[-1] ^ 1])
    assert codecs.replay(last).payloads == PAYLOADS[:-1]
    assert codecs.replay(LOG + bytes(100 << 10)).payloads == PAYLOADS
    third = 16 + len(PAYLOADS[0]) + len(PAYLOADS[1])
    for at, value in ((third + 8, 1), (third, 1), (third + 7, 0x7F)):
        with pytest.raises(CorruptData, match="after 2 records"):
            codecs.replay(LOG[:at] + bytes([LOG[at] ^ value]) + LOG[at + 1 :])


def test_records():
    for record in ((1, 1, b"k", b"v"), (2, 0, b"k", None), (3, 1, b"", b"")):
        assert codecs.decode_record(codecs.encode_record(*record)) == record
    for bad in (b"", b"\0" * 8 + b"\1\1k", (1).to_bytes(8, "little") + b"\2\1k", (1).to_bytes(8, "little") + b"\0\1kv", (1).to_bytes(8, "little") + b"\1\5k"):
        with pytest.raises(CorruptData):
            codecs.decode_record(bad)
    with pytest.raises(InvalidRecord):
        codecs.encode_record(0, 1, b"k", b"v")


def test_edits_and_commands():
    edit = Edit(4, 6, 20, (RunMeta(5, 300, 2, 1, 20, b"a", b"z" * 200),), (1, 3))
    assert codecs.decode_edit(codecs.encode_edit(edit)) == edit
    assert codecs.decode_edit(b"") == Edit()
    with pytest.raises(CorruptData, match="unknown tag"):
        codecs.decode_edit(b"\x09\x01")
    assert codecs.decode_command(codecs.encode_command(1, b"k", b"v")) == (1, b"k", b"v")
    for bad in (b"", b"\3\0", b"\1\5k"):
        with pytest.raises(CorruptData):
            codecs.decode_command(bad)


def test_log_files(spark, tmp_path):
    rows = log(spark, "a#1 b#2 a#3D")
    (tmp_path / "000001.log").write_bytes(b"".join(bytes(r["frame"]) for r in wal.frames(rows.coalesce(1)).collect()) + b"\x01\x02")
    (tmp_path / "000002.log").write_bytes(codecs.encode_frame(codecs.encode_record(4, 1, b"c", b"")))
    read = wal.read_logs(spark, str(tmp_path))
    assert show(read) == ["a#1", "a#3D", "b#2", "c#4"]
    assert wal.files_in_order(read).isEmpty()
    (tmp_path / "000003.log").write_bytes(codecs.encode_frame(codecs.encode_record(4, 1, b"c", b"")))
    assert not wal.files_in_order(wal.read_logs(spark, str(tmp_path))).isEmpty()


def test_human_bytes(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1536, 128 << 20, 3 << 30)], "n long")
    assert [r[0] for r in rows.select(human_bytes(rows["n"])).collect()] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "128.0 MiB", "3.0 GiB"]


def test_human_bytes_rounds_halves_to_even(spark):
    shown = {
        1280: "1.2 KiB", 1792: "1.8 KiB", 2304: "2.2 KiB", 1279: "1.2 KiB", 1281: "1.3 KiB", 1048575: "1024.0 KiB", (635 << 20) + (1 << 18): "635.2 MiB",
        (3 << 30) + (1 << 28): "3.2 GiB", (3 << 30) + (3 << 28): "3.8 GiB", 2204885243222871296: "2053459401.5 GiB", 2**63 - 1: "8589934592.0 GiB", -5: "-5 B", None: None,
    }
    rows = spark.createDataFrame([(n,) for n in shown], "n long")
    assert {r[0]: r[1] for r in rows.select("n", human_bytes(rows["n"])).collect()} == shown


def test_every_order_is_shown(spark):
    d = "/root/testdata/sf0.001"
    keys = sorted(r[0] for r in spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey").collect())
    assert sorted(r["o_orderkey"] for r in registry.queries()["human_bytes"](spark, d).collect()) == keys


def test_orders_without_a_price_and_with_negative_keys(spark, tmp_path):
    spark.createDataFrame([(-1, 5000.0), (3, 5000.0), (4, None)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(tuple(r) for r in registry.queries()["human_bytes"](spark, str(tmp_path)).collect()) == [(-1, "1 B"), (3, "76.1 MiB"), (4, None)]


def test_bloom():
    assert round(bloom.bits_per_key(0.01), 3) == 9.585 and bloom.num_hashes(bloom.bits_per_key(0.01)) == 7 and bloom.num_hashes(bloom.bits_per_key(0.001)) == 10
    keys = [b"key-%d" % i for i in range(2000)]
    made = bloom.build(keys + keys[:5])
    assert made == bloom.build(keys)
    assert all(bloom.may_contain(made, k) for k in keys)
    false = sum(bloom.may_contain(made, b"other-%d" % i) for i in range(10_000))
    assert false <= 150
    assert not bloom.may_contain(bloom.build([]), b"x")
    assert bloom.may_contain(b"", b"x") and bloom.may_contain(b"\0\0\x63", b"x")


def test_flush_cuts_do_not_depend_on_parts(spark):
    import random

    from ledgerlake.operators import writes
    from ledgerlake.schema import CHANGELOG

    r = random.Random(5)
    rows = [(bytearray(b"k" * r.randrange(1, 30)), seq, 1, bytearray(b"v" * r.choice((0, 5, 50, 400)))) for seq in sorted(r.sample(range(1, 2000), 500))]
    for threshold in (1, 150, 700, 5_000, 10**6):
        want, size, run = [], 0, 0
        for key, seq, _, value in rows:
            if size >= threshold:
                size, run = 0, run + 1
            cost = len(key) + len(value) + 72
            size += cost
            want.append((seq, cost, run))
        changes = spark.createDataFrame(rows, CHANGELOG)
        for part in (7, 300, 1 << 18):
            assert sorted(map(tuple, writes.flush_numbers(changes, threshold, part).collect())) == want
    assert writes.flush_numbers(changes.limit(0), 10).isEmpty()


def test_filter_hash_has_its_fixed_values():
    """FNV-1a of 64 bits (its published values for nothing and for a) before the finaliser; many keys at once as one by one."""
    from ledgerlake.functions import bloom

    def finished(h):
        for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * m % 2**64
        return h ^ h >> 31

    assert bloom.key_hash(b"") == finished(0xCBF29CE484222325) and bloom.key_hash(b"a") == finished(0xAF63DC4C8601EC8C)
    keys = [b"", b"a", b"ab", b"a" * 256, b"b" * 300, b"\x00\xff"]
    assert bloom.key_hashes(keys).tolist() == [bloom.key_hash(k) for k in keys]
    held = bloom.build(keys)
    assert bloom.may_contain_all(held, keys).all() and bloom.may_contain(held, b"ab")


def test_consensus_log_round_trip(spark, tmp_path):
    """A file of votes, entries and truncations; cut anywhere it has whole records only, and folds to what is left."""
    from ledgerlake.functions import codecs
    from ledgerlake.operators import replication
    from ledgerlake.sources import wal

    made = [("HARD", 3, None, "node-b", None), *(("ENTRY", 3, i, None, b"c" * i) for i in range(1, 6)), ("TRUNC", None, 4, None, None), ("ENTRY", 4, 4, None, b""), ("HARD", 5, None, "", None)]
    shape = "pos long, rec string, term long, `index` long, voted_for string, command binary"
    records = spark.createDataFrame([(n, *r) for n, r in enumerate(made, 1)], shape).coalesce(1)
    frames = [bytes(r["frame"]) for r in wal.consensus_frames(records).collect()]
    data = b"".join(frames)
    ends = [sum(map(len, frames[:n])) for n in range(len(frames) + 1)]
    for at in range(len(data) + 1):
        assert len(codecs.replay_consensus(data[:at])) == max(n for n, end in enumerate(ends) if end <= at)
    damaged = bytearray(data)
    damaged[ends[2] + 10] ^= 1
    with pytest.raises(codecs.CorruptData):
        codecs.replay_consensus(bytes(damaged))
    (tmp_path / "one.raft").write_bytes(data + b"\0" * 100)
    read = wal.read_consensus_logs(spark, f"file://{tmp_path}")
    assert sorted((r["pos"], r["rec"], r["term"], r["index"], r["voted_for"], None if r["command"] is None else bytes(r["command"])) for r in read.collect()) == sorted((n, *r) for n, r in enumerate(made, 1))
    left = replication.fold_log(read).orderBy("index").collect()
    assert [(r["index"], r["term"], bytes(r["command"])) for r in left] == [(1, 3, b"c"), (2, 3, b"cc"), (3, 3, b"ccc"), (4, 4, b"")]
    assert tuple(replication.hard_state(read).first()) == (5, "")


def test_numbers_are_gapless_over_many_partitions(spark):
    from pyspark.sql import functions as F

    from ledgerlake.operators import writes

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    try:
        rows = spark.range(0, 40_000, 1, 16).select(((F.col("id") * 7919) % 40_000).alias("n")).select("n", F.col("n").cast("string").cast("binary").alias("key"), F.repeat(F.sha2(F.col("n").cast("string"), 256), 4).cast("binary").alias("value"))
        made = writes.puts(rows, ["n"], 42).select(F.col("key").cast("string").cast("long"), "seq").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert sorted(tuple(r) for r in made) == [(n, n + 42) for n in range(40_000)]


def test_numbers_follow_any_total_order(spark):
    from datetime import datetime

    from ledgerlake.functions.numbers import number_rows

    rows = [(None if i % 50 == 0 else f"k{i % 7}".encode(), float("nan") if i % 11 == 0 else i % 5 - 2.5, datetime(2020, 1, 1 + i % 28, i % 24), i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "a binary, b double, c timestamp, d long")
    order = ["a", "b", "c", "d"]
    want = [r["d"] for r in df.coalesce(1).sortWithinPartitions(*order).collect()]
    assert [r["d"] for r in sorted(number_rows(df, order, "n").collect(), key=lambda r: r["n"])] == want
    assert sorted(r["n"] for r in number_rows(df, order, "n").collect()) == list(range(1, 20_001))
    for few in (0, 1, 3):
        assert sorted(r["n"] for r in number_rows(df.limit(few), order, "n", 5).collect()) == list(range(5, 5 + few))
