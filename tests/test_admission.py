import random

from ledgerlake.operators import limits, replication
from ledgerlake.operators.limits import TokenBucket
from ledgerlake.plans import registry
from ledgerlake.streaming import live
from tests.helpers import log


def test_token_bucket():
    b = TokenBucket(1.0, 2, clients=2)
    assert [b.allow("a", 0)[0] for _ in range(3)] == [True, True, False] and b.allow("a", 0)[1] >= 1
    assert b.allow("a", 1)[0] and b.allow("b", 1)[0]
    assert not b.allow("c", 1)[0] and b.allow("c", 61)[0]


def test_limits_by_client(spark):
    rows = spark.createDataFrame([("a", float(t), i) for i, t in enumerate([0, 0, 0, 1])] + [("b", 0.0, 9)], "client string, at double, id long")
    out = {r["id"]: r["allowed"] for r in limits.rate_limited(rows, 1.0, 2).collect()}
    assert out == {0: True, 1: True, 2: False, 3: True, 9: True}


def test_limits_with_few_clients(spark):
    """One after the other over all clients: a third one waits a second until a bucket is full again."""
    rows = spark.createDataFrame([("a", 0.0, 1), ("b", 0.5, 2), ("c", 0.6, 3), ("a", 0.7, 4), ("c", 9.0, 5)], "client string, at double, id long")
    out = {r["id"]: (r["allowed"], r["retry_after"]) for r in limits.rate_limited(rows, 0.5, 2, clients=2).collect()}
    assert out == {1: (True, 0.0), 2: (True, 0.0), 3: (False, 1.0), 4: (True, 0.0), 5: (True, 0.0)}


def test_budget(spark):
    rows = spark.createDataFrame([("n", i, 164 + (900 if i == 3 else 0)) for i in range(1, 10)], "namespace string, seq long, cost long")
    out = {r["seq"]: r["admitted"] for r in limits.within_budget(rows, 1000).collect()}
    assert sum(out.values()) == 6 and not out[3]


def test_log_suffix_is_overwritten(spark):
    rows = [(1, "ENTRY", 1, 1), (2, "ENTRY", 2, 1), (3, "ENTRY", 3, 1), (4, "TRUNC", 2, None), (5, "ENTRY", 2, 2)]
    kept = replication.fold_log(spark.createDataFrame(rows, "pos long, rec string, `index` long, term long")).orderBy("index").collect()
    assert [(r["index"], r["term"]) for r in kept] == [(1, 1), (2, 2)]
    gap = rows + [(6, "ENTRY", 9, 3), (7, "ENTRY", 10, 3)]
    kept = replication.fold_log(spark.createDataFrame(gap, "pos long, rec string, `index` long, term long")).orderBy("index").collect()
    assert [r["index"] for r in kept] == [9, 10]


def fold(records):
    """Entries (pos, index, term) that survive: a log without gaps, changed record by record."""
    held = {}
    for pos, rec, index, term in sorted(records):
        if rec == "ENTRY" and held and not min(held) <= index <= max(held) + 1:
            held = {}
        held = {i: e for i, e in held.items() if i < index}
        if rec == "ENTRY":
            held[index] = (pos, index, term)
    return sorted(held.values())


RECORDS = "pos long, rec string, `index` long, term long"


def test_truncation_beyond_the_end_and_twice(spark):
    made = lambda spec: [(n, "ENTRY" if x[0] == "e" else "TRUNC", int(x[1:]), 1) for n, x in enumerate(spec.split())]
    for spec, left in (("e1 t9 e9", [9]), ("e1 e2 e3 e4 e5 t2 t4 e4", [4]), ("e1 e2 t9 e3", [1, 2, 3]), ("e5 e6 t3 e3 e4", [3, 4]), ("e4 e5 e2 e3", [2, 3]), ("e1 t1 t1 e1", [1]), ("e1 t1", []), ("t3 e7 e8", [7, 8])):
        assert [e[1] for e in fold(made(spec))] == left
        for part in (1, 2, 100):
            assert [r["index"] for r in replication.fold_log(spark.createDataFrame(made(spec), RECORDS), part).orderBy("index").collect()] == left


def test_log_folds_alike_in_parts(spark):
    for seed in range(4):
        r, rows, last = random.Random(seed), [], 0
        for pos in range(300):
            rec = "TRUNC" if r.random() < 0.3 else "ENTRY"
            index = max(1, last + 1 + r.choice((0, 0, 0, 0, 0, 0, -1, -2, -4, 3 if r.random() < 0.2 else 0)))
            rows.append((pos * 3, rec, index, pos // 10))
            last = index if rec == "ENTRY" else min(last, index - 1)
        records = spark.createDataFrame(rows, RECORDS)
        for part in (1, 7, 100, 10_000):
            assert sorted(map(tuple, replication.fold_log(records, part).select("pos", "index", "term").collect())) == fold(rows)


def test_registered_fold_takes_every_order(spark):
    keys = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey").collect()]
    cut = {8: 20, 9: 5}
    rows = [(k, "TRUNC" if k % 10 in cut else "ENTRY", 4 * (k // 10) + cut.get(k % 10, k % 10 + 1 + (0 if k % 5003 else 6)), k // 10 + 1) for k in keys]
    out = registry.queries()["raft_log_fold"](spark, "/root/testdata/sf0.001")
    assert max(keys) >= 1000 and sorted(map(tuple, out.select("pos", "index", "term").collect())) == fold(rows)


def test_replicas_converge(spark):
    writes = " ".join(f"key{i:02d}#{i + 1}" for i in range(30)) + " key05#31D"
    one, two = log(spark, writes), log(spark, " ".join(reversed(writes.split())))
    from ledgerlake.operators import views

    assert views.view(one).count() == 29 and replication.differences(views.view(one), views.view(two)).isEmpty()


def test_stream_restarts_and_matches_batch(spark, tmp_path):
    log(spark, "a#1 b#2 c#3").write.parquet(f"{tmp_path}/in/one")
    schema = spark.read.parquet(f"{tmp_path}/in/one").schema
    changes = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    for spec in (None, "a#9D b#8"):
        if spec:
            log(spark, spec).write.parquet(f"{tmp_path}/in/two")
        live.keep_view(changes, f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()
    assert sorted((bytes(r["key"]), r["seq"]) for r in live.read_view(spark, f"{tmp_path}/table").collect()) == [(b"b", 8), (b"c", 3)]


def test_stream_rate_limit(spark, tmp_path):
    spark.createDataFrame([("a", 0.0, i) for i in range(3)], "client string, at double, id long").write.parquet(f"{tmp_path}/in/one")
    requests = spark.readStream.schema("client string, at double, id long").parquet(f"{tmp_path}/in/*")
    query = live.rate_limited(requests, 1.0, 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["id"], r["allowed"]) for r in spark.table("limited").collect()) == [(0, True), (1, True), (2, False)]


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_commands_reach_the_sink_in_order(spark, tmp_path):
    """Batches come with rising numbers, each in order of index; a restart hands on only what is new."""
    shape = "`index` long, command string"
    spark.createDataFrame([(i, f"c{i}") for i in random.Random(1).sample(range(1, 60), 59)], shape).repartition(3).write.parquet(f"{tmp_path}/in/one")
    seen = []
    commands = spark.readStream.schema(shape).parquet(f"{tmp_path}/in/*")
    for n in (1, 2):
        if n == 2:
            spark.createDataFrame([(61, "c61"), (60, "c60")], shape).write.parquet(f"{tmp_path}/in/two")
        live.apply_in_order(commands, f"{tmp_path}/state", lambda batch, number: seen.append((number, [r["index"] for r in batch.collect()]))).awaitTermination()
    assert [number for number, _ in seen] == sorted({number for number, _ in seen})
    assert [i for _, batch in seen for i in batch] == list(range(1, 62))


def test_sandbox_against_a_plain_model(spark):
    from ledgerlake.operators import sandbox
    from ledgerlake.schema import DELETE, SET

    lim = sandbox.SandboxLimits(key_bytes=8, value_bytes=40, total_bytes=1500, client_rate=6, total_rate=60)
    r, rows, at = random.Random(2), [], 0.0
    for i in range(150):
        at += r.choice((0.0, 0.25, 2.0))
        kind = DELETE if r.random() < 0.2 else SET
        rows.append((r.choice("abc"), at, 500 - i, bytearray(b"k" * r.choice((0, 3, 8, 9))), kind, None if kind == DELETE else bytearray(b"v" * r.choice((0, 40, 41)))))
    clients, everyone, used, want = {}, [10.0, None], 0, {}

    def take(bucket, now, rate, burst):
        bucket[0] = min(burst, bucket[0] + (0 if bucket[1] is None else now - bucket[1]) * rate)
        bucket[1] = now
        if bucket[0] < 1:
            return False
        bucket[0] -= 1
        return True

    for client, now, i, key, kind, value in sorted(rows, key=lambda x: (x[1], x[2])):
        cost = len(key) + 5 + len(value or b"") + 164
        if not take(clients.setdefault(client, [2.0, None]), now, 0.1, 2.0) or not take(everyone, now, 1.0, 10.0):
            want[i] = sandbox.TOO_OFTEN
        elif not 0 < len(key) <= 8:
            want[i] = sandbox.BAD_KEY
        elif len(value or b"") > 40:
            want[i] = sandbox.BAD_VALUE
        elif used + cost > 1500:
            want[i] = sandbox.FULL
        else:
            used, want[i] = used + cost, sandbox.OK
    judged = sandbox.admit(spark.createDataFrame(rows, "client string, at double, id long, key binary, kind int, value binary"), lim)
    assert {x["id"]: x["verdict"] for x in judged.collect()} == want and len(set(want.values())) == 5
    writes = sandbox.admitted_writes(judged, lim).collect()
    assert len(writes) == list(want.values()).count("ok") and all(bytes(x["key"]).startswith(b"demo/") for x in writes)
