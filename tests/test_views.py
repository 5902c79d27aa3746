import random

import pytest

from ledgerlake.functions.keys import client_key, prefix_end
from ledgerlake.operators import views
from ledgerlake.schema import CHANGELOG, DELETE, SET, validated
from tests.helpers import items, log, show


def test_internal_order(spark):
    spec = "a#9, a#3, a#1D, ab#100, b#2"
    rows = views.history(log(spark, spec)).collect()
    assert [(bytes(r["key"]).decode(), r["seq"]) for r in rows] == [("a", 9), ("a", 3), ("a", 1), ("ab", 100), ("b", 2)]


@pytest.mark.parametrize("snap, result, value", [(9, "NotFound", None), (10, "Found", "v10"), (19, "Found", "v10"), (20, "Found", "v20"), (30, "Deleted", None), (39, "Deleted", None), (40, "Found", "v40")])
def test_snapshot_reads(spark, snap, result, value):
    changes = log(spark, "k#10 k#20 k#30D k#40")
    probes = spark.createDataFrame([(bytearray(b"k"), snap)], "key binary, snap long")
    for found in (views.lookup(changes, probes.select("key"), snap), views.lookup_as_of(changes, probes)):
        row = found.first()
        assert row["result"] == result and (row["value"] is None) == (value is None)
        assert value is None or bytes(row["value"]).decode() == value


def test_empty_value_is_found_and_prefixes_are_distinct(spark):
    rows = spark.createDataFrame([(bytearray(b"a"), 1, SET, bytearray()), (bytearray(b"ab"), 2, SET, bytearray(b"x"))], CHANGELOG)
    assert bytes(views.get(rows, b"a").first()["value"]) == b""
    assert views.get(rows, b"abc").isEmpty()


def test_range_bounds(spark):
    changes = log(spark, "a#1 b#2 c#3 d#4D")
    assert [bytes(r["key"]) for r in views.scan(changes, b"a", b"c").collect()] == [b"a", b"b"]
    assert views.scan(changes, b"a", b"").isEmpty()
    assert views.scan(changes, b"c", b"c").isEmpty()
    assert views.scan(changes).count() == 3
    assert [bytes(r["key"]) for r in views.scan(changes, limit=2).collect()] == [b"a", b"b"]


def test_paging(spark):
    changes = log(spark, " ".join(f"user:{i:02d}#{i + 1}" for i in range(30)) + " user:05#40D other#50 zz#51")
    first = views.page(changes, 10, b"user:").collect()
    assert bytes(first[0]["key"]) == b"user:00" and bytes(first[0]["next"]) == b"user:11" and len(first) == 10
    rest = views.page(changes, 100, b"user:", start=b"user:11").collect()
    assert len(rest) == 19 and rest[0]["next"] is None
    # A start before the prefix is moved to it.
    assert bytes(views.page(changes, 1, b"user:", start=b"a").first()["key"]) == b"user:00"


def test_namespace(spark):
    changes = log(spark, "secret#1 zzz#2 demo/a#3 demo/b#4 demo/c#5")
    assert [bytes(r["key"]) for r in views.namespaced_scan(changes, b"demo/").collect()] == [b"a", b"b", b"c"]


def test_prefix_end():
    assert [prefix_end(p) for p in (b"a", b"a\xff", b"\xff\xff", b"", b"ab\xfe")] == [b"b", b"b", None, None, b"ab\xff"]


def test_limits():
    assert views.parse_limit(None) == 100 and views.parse_limit("7") == 7 and views.parse_limit("5000") == 1000
    for bad in ("0", "-1", "x"):
        with pytest.raises(ValueError):
            views.parse_limit(bad)


def test_client_key():
    assert client_key("1.1.1.1, 2.2.2.2", "9.9.9.9:80") == "2.2.2.2"
    assert client_key("", "9.9.9.9:80") == "9.9.9.9" and client_key(None, "[::1]:80") == "::1"


def test_envelope(spark):
    rows = spark.createDataFrame([(bytearray(b"a"), bytearray(b"x")), (bytearray(b"b"), bytearray(b"\xff\x00")), (bytearray(b"c"), bytearray())], "key binary, value binary")
    assert [(r["value"], r["value_b64"]) for r in views.envelope(rows).orderBy("key").collect()] == [("x", None), (None, "/wA="), (None, None)]


def test_seek(spark):
    changes = log(spark, "a#9 a#3 b#5")
    assert show(views.seek(changes, b"a", 5)) == items("a#3")
    assert show(views.seek(changes, b"a", 2)) == items("b#5")


@pytest.mark.parametrize("bad", [(b"k", 0, SET, b"v"), (b"k", 1 << 56, SET, b"v"), (b"k", 1, DELETE, b"v"), (b"k", 1, 2, b"v")])
def test_bounds(spark, bad):
    key, seq, kind, value = bad
    with pytest.raises(Exception, match="number|kind|tombstone"):
        validated(spark.createDataFrame([(bytearray(key), seq, kind, bytearray(value))], CHANGELOG)).collect()


def test_random_snapshots_match_a_model(spark):
    r = random.Random(5)
    rows = [(bytearray(f"k{r.randrange(40):03d}".encode()), i + 1, DELETE if r.random() < 0.25 else SET) for i in range(2000)]
    changes = spark.createDataFrame([(k, s, kind, None if kind == DELETE else bytearray(str(s).encode())) for k, s, kind in rows], CHANGELOG)
    probes = [(f"k{r.randrange(50):03d}".encode(), r.randrange(2100)) for _ in range(300)]
    found = {(bytes(x["key"]), x["snap"]): (x["result"], x["value"] and bytes(x["value"])) for x in views.lookup_as_of(changes, spark.createDataFrame([(bytearray(k), s) for k, s in probes], "key binary, snap long")).collect()}
    for key, snap in probes:
        seen = [(s, kind) for k, s, kind in rows if bytes(k) == key and s <= snap]
        want = ("NotFound", None) if not seen else ("Deleted", None) if max(seen)[1] == DELETE else ("Found", str(max(seen)[0]).encode())
        assert found[(key, snap)] == want


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    log(spark, "a#1 b#2").write.parquet(f"{tmp_path}/run")
    views.view(spark.read.parquet(f"{tmp_path}/run"), 5, b"a", b"b").explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "LessThanOrEqual(seq,5)" in pushed and "GreaterThanOrEqual(key" in pushed and "WindowGroupLimit" in plan
