"""Registered queries over the driver's tables, and the DuckDB SQL that checks them.

The changelog comes from ``events`` (schema.from_events), ``pages`` and ``orders``. Keys and values are strings in results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schema
from ledgerlake.functions import bloom, numbers
from ledgerlake.operators import compaction, limits, metadata, replication, views, workload, writes
from ledgerlake.plans.store import Store
from ledgerlake.schema import text
from ledgerlake.sources.shared import shared_folder
from ledgerlake.streaming import live

SNAPSHOT, HORIZON, RUN_ROWS, FLUSH_BYTES = 600, 500, 100, 4096

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def events_log(spark: SparkSession, d: str) -> DataFrame:
    return schema.from_events(spark.read.parquet(f"{d}/events.parquet"))


def with_runs(log: DataFrame) -> DataFrame:
    """The log cut into runs of RUN_ROWS numbers."""
    return log.withColumn("run", F.floor((F.col("seq") - 1) / RUN_ROWS).cast("long"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's number as a user's key: most users, and many keys that no one wrote."""
    return spark.read.parquet(f"{d}/customer.parquet").select(F.format_string("user:%06d", "c_custkey").cast("binary").alias("key"))


CL = """cl AS (SELECT printf('user:%06d', user_id) AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM events)"""
RUNS = f"runs AS (SELECT *, CAST((seq - 1) // {RUN_ROWS} AS BIGINT) AS run FROM cl)"
PROBES = "probes AS (SELECT printf('user:%06d', c_custkey) AS key FROM customer)"
COST = "octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) + 72"


def newest_sql(where: str = "TRUE", source: str = "cl") -> str:
    return f"newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS rn FROM {source} WHERE {where}) WHERE rn = 1)"


def view_sql(where: str = "TRUE", columns: str = "key, seq, value", tail: str = "") -> str:
    return f"WITH {CL}, {newest_sql(where)} SELECT {columns} FROM newest WHERE kind = 1 {tail}"


# -- reads


@_query("latest_view", view_sql())
def _(spark, d):
    return views.view(events_log(spark, d)).select(*text("key"), "seq", *text("value"))


@_query("point_get", view_sql("key = 'user:000003'", "key, value"))
def _(spark, d):
    return views.get(events_log(spark, d), b"user:000003").select(*text("key", "value"))


STATE = "CASE WHEN n.kind = 1 THEN 'Found' WHEN n.kind = 0 THEN 'Deleted' ELSE 'NotFound' END AS result, n.value"


@_query("multi_get_tristate", f"WITH {CL}, {newest_sql()}, {PROBES} SELECT p.key, {STATE} FROM probes p LEFT JOIN newest n USING (key)")
def _(spark, d):
    return views.lookup(events_log(spark, d), probes(spark, d)).select(*text("key"), "result", *text("value"))


@_query("snapshot_view_at", view_sql(f"seq <= {SNAPSHOT}"))
def _(spark, d):
    return views.view(events_log(spark, d), SNAPSHOT).select(*text("key"), "seq", *text("value"))


@_query(
    "snapshot_get_tristate",
    f"""WITH {CL}, {PROBES}, asked AS (SELECT key, CAST(s * 250 AS BIGINT) AS snap FROM probes, range(5) t(s)),
    n AS (SELECT * FROM (SELECT a.key, a.snap, c.kind, c.value, row_number() OVER (PARTITION BY a.key, a.snap ORDER BY c.seq DESC) AS rn
      FROM asked a LEFT JOIN cl c ON c.key = a.key AND c.seq <= a.snap) WHERE rn = 1)
    SELECT n.key, n.snap, {STATE} FROM n""",
)
def _(spark, d):
    asked = probes(spark, d).withColumn("snap", F.explode(F.array([F.lit(s * 250).cast("long") for s in range(5)])))
    return views.lookup_as_of(events_log(spark, d), asked).select(*text("key"), "snap", "result", *text("value"))


@_query("range_scan", view_sql("key >= 'user:000003' AND key < 'user:000012'", "key, value"))
def _(spark, d):
    return views.scan(events_log(spark, d), b"user:000003", b"user:000012").select(*text("key", "value"))


@_query("range_scan_limit", view_sql("key >= 'user:000002'", "key, value", "ORDER BY key LIMIT 7"))
def _(spark, d):
    return views.scan(events_log(spark, d), b"user:000002", limit=7).select(*text("key", "value"))


@_query("range_scan_empty_end", f"WITH {CL}, {newest_sql()} SELECT count(*) AS open_end, 0 AS empty_end FROM newest WHERE kind = 1 AND key >= 'user:000002'")
def _(spark, d):
    """No end is unbounded; an empty end holds nothing."""
    log = events_log(spark, d)
    none = views.scan(log, b"user:000002", b"").agg(F.count("*").cast("int").alias("empty_end"))
    return views.scan(log, b"user:000002").agg(F.count("*").alias("open_end")).join(F.broadcast(none))  # one row each


PAGES = "cl AS (SELECT url AS key, page_id + 1 AS seq, 1 AS kind, html AS value FROM pages)"


@_query("prefix_scan", f"WITH {PAGES}, {newest_sql(chr(34) + 'key' + chr(34) + ' LIKE ' + repr('http://th%'))} SELECT key, seq, md5(value) AS digest FROM newest WHERE kind = 1")
def _(spark, d):
    log = schema.from_pages(spark.read.parquet(f"{d}/pages.parquet"))
    return views.view(views.bounded(log, *views.prefix_bounds(b"http://th"))).select(*text("key"), "seq", F.md5("value").alias("digest"))


@_query(
    "prefix_scan_page",
    f"""WITH {CL}, {newest_sql("key LIKE 'user:0000%'")}, live AS (SELECT key, value, row_number() OVER (ORDER BY key) AS n FROM newest WHERE kind = 1)
    SELECT key, value, (SELECT key FROM live WHERE n = 11) AS next FROM live WHERE n <= 10""",
)
def _(spark, d):
    return views.page(events_log(spark, d), 10, b"user:0000").select(*text("key", "value", "next"))


@_query("namespaced_scan", view_sql("key LIKE 'user:%'", "substr(key, 6) AS key, value"))
def _(spark, d):
    return views.namespaced_scan(events_log(spark, d), b"user:").select(*text("key", "value"))


@_query("seek_first_ge", f"WITH {CL} SELECT key, seq, kind, value FROM cl WHERE key > 'user:000004' OR (key = 'user:000004' AND seq <= 700) ORDER BY key, seq DESC, kind DESC LIMIT 1")
def _(spark, d):
    return views.seek(events_log(spark, d), b"user:000004", 700).select(*text("key"), "seq", F.col("kind").cast("int"), *text("value"))


@_query(
    "version_history",
    f"WITH {CL} SELECT key, seq, kind, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS version FROM cl WHERE key >= 'user:000003' AND key < 'user:000010'",
)
def _(spark, d):
    rows = views.history(events_log(spark, d), b"user:000003", b"user:000010")
    return rows.select(*text("key"), "seq", F.col("kind").cast("int"), *text("value"), F.col("version").cast("long"))


def _three_runs(spark, d) -> list[DataFrame]:
    log = events_log(spark, d)
    return [log.where(F.pmod("seq", F.lit(3)) == i) for i in range(3)] + [log.where("seq <= 100")]


@_query("merge_runs", f"WITH {CL} SELECT key, seq, kind, value FROM cl")
def _(spark, d):
    return views.merge(_three_runs(spark, d)).select(*text("key"), "seq", F.col("kind").cast("int"), *text("value"))


@_query("merge_runs_view", view_sql())
def _(spark, d):
    return views.view(views.merge(_three_runs(spark, d))).select(*text("key"), "seq", *text("value"))


@_query("tombstones_live", f"WITH {CL}, {newest_sql()} SELECT key, seq FROM newest WHERE kind = 0")
def _(spark, d):
    return views.newest(events_log(spark, d)).where("kind = 0").select(*text("key"), "seq")


@_query(
    "value_envelope",
    f"""WITH {CL}, {newest_sql()} SELECT key, CASE WHEN seq % 3 <> 0 AND value <> '' THEN value END AS value,
    CASE WHEN seq % 3 = 0 THEN base64(encode(value) || '\\xFF\\x00'::BLOB) END AS value_b64 FROM newest WHERE kind = 1""",
)
def _(spark, d):
    rows = views.view(events_log(spark, d))
    return views.envelope(rows.withColumn("value", F.when(F.pmod("seq", F.lit(3)) == 0, F.concat("value", F.lit(b"\xff\x00"))).otherwise(F.col("value")))).select(*text("key"), "value", "value_b64")


@_query("orders_latest", "WITH cl AS (SELECT printf('cust:%06d', o_custkey) AS key, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS kind, o_orderpriority AS value FROM orders), " + newest_sql() + " SELECT key, seq, value FROM newest WHERE kind = 1")
def _(spark, d):
    return views.view(schema.from_orders(spark.read.parquet(f"{d}/orders.parquet"))).select(*text("key"), "seq", *text("value"))


# -- compaction


def fate_sql(bottom: bool, horizon: int) -> str:
    gone = "WHEN kind = 0 THEN 'dropped_tombstone' " if bottom else ""
    return f"""fates AS (SELECT *, CASE WHEN seq > {horizon} THEN 'kept' WHEN nth > 1 THEN 'dropped_version' {gone}ELSE 'kept' END AS fate FROM (
      SELECT *, sum(CASE WHEN seq <= {horizon} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS nth FROM cl))"""


def _versions(rows: DataFrame) -> DataFrame:
    return rows.select(*text("key"), "seq", F.col("kind").cast("int"), *text("value"))


@_query("compact_full", f"WITH {CL}, {newest_sql()} SELECT key, seq, kind, value FROM newest WHERE kind = 1")
def _(spark, d):
    return _versions(compaction.compacted(events_log(spark, d), bottom=True))


@_query("compact_partial_keep_tombstones", f"WITH {CL}, {newest_sql(f'seq > {HORIZON}')} SELECT key, seq, kind, value FROM newest")
def _(spark, d):
    return _versions(compaction.compacted(events_log(spark, d).where(F.col("seq") > HORIZON), bottom=False))


@_query("compact_horizon", f"WITH {CL}, {fate_sql(True, HORIZON)} SELECT key, seq, kind, value FROM fates WHERE fate = 'kept'")
def _(spark, d):
    return _versions(compaction.compacted(events_log(spark, d), True, HORIZON))


@_query("compact_horizon_not_bottom", f"WITH {CL}, {fate_sql(False, HORIZON)} SELECT key, seq, kind, value FROM fates WHERE fate = 'kept'")
def _(spark, d):
    return _versions(compaction.compacted(events_log(spark, d), False, HORIZON))


@_query(
    "compaction_stats",
    f"""WITH {CL}, {fate_sql(True, HORIZON)} SELECT count(*) AS input, count(*) FILTER (fate = 'kept') AS output,
    count(*) FILTER (fate = 'dropped_version') AS dropped_versions, count(*) FILTER (fate = 'dropped_tombstone') AS dropped_tombstones FROM fates""",
)
def _(spark, d):
    return compaction.statistics(events_log(spark, d), True, HORIZON)


# -- runs and manifests

RUN_META = f"""meta AS (SELECT run AS num, CAST(sum({COST}) AS BIGINT) AS size, count(*) AS entries, min(seq) AS min_seq, max(seq) AS max_seq,
  min(key) AS smallest, max(key) AS largest FROM runs GROUP BY run)"""


def _meta(rows: DataFrame) -> DataFrame:
    return rows.select("num", "size", "entries", "min_seq", "max_seq", *text("smallest", "largest"))


@_query("run_metadata", f"WITH {CL}, {RUNS}, {RUN_META} SELECT * FROM meta")
def _(spark, d):
    return _meta(metadata.describe_runs(with_runs(events_log(spark, d))))


def manifest_edits(spark: SparkSession, d: str) -> DataFrame:
    """An edit per run that adds it; every fourth also deletes the three before it."""
    runs = metadata.describe_runs(with_runs(events_log(spark, d)))
    merged = F.pmod("num", F.lit(4)) == 3
    return runs.select(
        (F.col("num") + 1).alias("version"), F.when(~merged, F.col("num") * 2).alias("log_number"), (F.col("num") + 2).alias("next_file"), F.col("max_seq").alias("last_seq"),
        F.array(F.struct("num", "size", "entries", "min_seq", "max_seq", "smallest", "largest")).alias("added"),
        F.when(merged, F.array(*(F.col("num") - i for i in (3, 2, 1)))).otherwise(F.array().cast("array<long>")).alias("deleted"),
    )


LAST = "(SELECT max(num) FROM meta)"
LIVE = f"live AS (SELECT * FROM meta m WHERE num % 4 = 3 OR num - num % 4 + 3 > {LAST})"


@_query("manifest_fold", f"WITH {CL}, {RUNS}, {RUN_META}, {LIVE} SELECT * FROM live")
def _(spark, d):
    return _meta(metadata.fold_edits(manifest_edits(spark, d))[0])


@_query("manifest_state", f"WITH {CL}, {RUNS}, {RUN_META} SELECT max(CASE WHEN num % 4 <> 3 THEN num * 2 END) AS log_number, max(num) + 2 AS next_file, max(max_seq) AS last_seq FROM meta")
def _(spark, d):
    return metadata.fold_edits(manifest_edits(spark, d))[1]


@_query("manifest_newest_first", f"WITH {CL}, {RUNS}, {RUN_META}, {LIVE} SELECT num, max_seq FROM live ORDER BY max_seq DESC LIMIT 5")
def _(spark, d):
    return metadata.newest_first(metadata.fold_edits(manifest_edits(spark, d))[0]).select("num", "max_seq").limit(5)


@_query(
    "orphan_runs",
    f"""WITH {CL}, {RUNS}, {RUN_META}, {LIVE} SELECT 'run-' || num AS name FROM meta WHERE num NOT IN (SELECT num FROM live)
    UNION ALL SELECT 'log-' || num FROM meta WHERE num < 3 UNION ALL SELECT 'temporary-' || num FROM meta WHERE num < 2""",
)
def _(spark, d):
    edits = manifest_edits(spark, d)
    nums = edits.select(F.explode("added").alias("r")).select("r.num")
    listed = nums.withColumn("kind", F.explode(F.array(F.lit("run"), F.lit("log"), F.lit("temporary")))).where("kind <> 'temporary' or num < 2")
    return metadata.orphans(listed.select(F.concat_ws("-", "kind", "num").alias("name"), "kind", "num"), metadata.fold_edits(edits)[0], 3)


@_query(
    "run_pruning_candidates",
    f"WITH {CL}, {RUNS}, {RUN_META}, {PROBES} SELECT p.key, CAST({SNAPSHOT} AS BIGINT) AS snap, m.num FROM probes p JOIN meta m ON m.min_seq <= {SNAPSHOT} AND p.key BETWEEN m.smallest AND m.largest",
)
def _(spark, d):
    asked = probes(spark, d).withColumn("snap", F.lit(SNAPSHOT).cast("long"))
    return metadata.may_hold(asked, metadata.describe_runs(with_runs(events_log(spark, d)))).select(*text("key"), "snap", "num")


@_query(
    "read_amp_per_key",
    f"""WITH {CL}, {RUNS}, {RUN_META}, {PROBES}, hit AS (SELECT key, max(run) AS hit FROM runs WHERE seq <= {SNAPSHOT} GROUP BY key)
    SELECT p.key, CAST({SNAPSHOT} AS BIGINT) AS snap, count(m.num) AS consulted FROM probes p LEFT JOIN hit h USING (key)
    LEFT JOIN meta m ON m.min_seq <= {SNAPSHOT} AND p.key BETWEEN m.smallest AND m.largest AND (h.hit IS NULL OR m.num >= h.hit) GROUP BY p.key""",
)
def _(spark, d):
    asked = probes(spark, d).withColumn("snap", F.lit(SNAPSHOT).cast("long"))
    return metadata.probes_until_hit(with_runs(events_log(spark, d)), asked).select(*text("key"), "snap", "consulted")


@_query("entry_cost_by_run", f"WITH {CL}, {RUNS} SELECT run, CAST(sum({COST}) AS BIGINT) AS cost, count(*) AS entries FROM runs GROUP BY run")
def _(spark, d):
    return with_runs(events_log(spark, d)).groupBy("run").agg(F.sum(schema.entry_cost()).alias("cost"), F.count("*").alias("entries"))


@_query(
    "flush_boundaries",
    f"""WITH RECURSIVE {CL}, costs AS (SELECT seq, {COST} AS cost, row_number() OVER (ORDER BY seq) AS n FROM cl),
    fold AS (SELECT n, seq, cost, CAST(cost AS BIGINT) AS size, CAST(0 AS BIGINT) AS run FROM costs WHERE n = 1
      UNION ALL SELECT c.n, c.seq, c.cost, CASE WHEN f.size >= {FLUSH_BYTES} THEN c.cost ELSE f.size + c.cost END, f.run + CASE WHEN f.size >= {FLUSH_BYTES} THEN 1 ELSE 0 END
      FROM fold f JOIN costs c ON c.n = f.n + 1)
    SELECT run, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(cost) AS BIGINT) AS size FROM fold GROUP BY run""",
)
def _(spark, d):
    cut = writes.flush_numbers(events_log(spark, d), FLUSH_BYTES)
    return cut.groupBy("run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("cost").alias("size"))


@_query(
    "write_amp",
    f"""WITH {CL}, {RUNS}, {newest_sql()}, s AS (SELECT sum({COST}) AS flushed, sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) AS users, sum({COST} - 72 + 19) AS logged FROM cl),
    m AS (SELECT sum({COST}) AS merged FROM newest WHERE kind = 1)
    SELECT CAST(users AS BIGINT) AS user_bytes, CAST(logged AS BIGINT) AS log_bytes, CAST(flushed AS BIGINT) AS flush_bytes, CAST(merged AS BIGINT) AS merge_bytes,
    round((logged + flushed + merged) / users, 6) AS amplification FROM s, m""",
)
def _(spark, d):
    log = events_log(spark, d)
    users = schema.entry_cost() - schema.ENTRY_OVERHEAD
    written = log.agg(F.sum(users).alias("user_bytes"), F.sum(users + schema.RECORD_HEADER).alias("log_bytes"), F.sum(schema.entry_cost()).alias("flush_bytes"))
    merged = compaction.compacted(log, True).agg(F.sum(schema.entry_cost()).alias("merge_bytes"))
    out = written.join(F.broadcast(merged))  # one row each
    return out.withColumn("amplification", F.round(metadata.write_amplification(*(F.col(c) for c in ("log_bytes", "flush_bytes", "merge_bytes", "user_bytes"))), 6))


@_query(
    "space_amp_logical",
    f"""WITH {CL}, {newest_sql()}, s AS (SELECT CAST(sum({COST} - 72) AS BIGINT) AS stored FROM cl), l AS (SELECT CAST(sum({COST} - 72) AS BIGINT) AS live FROM newest WHERE kind = 1)
    SELECT stored, live, round(stored / live, 6) AS amplification FROM s, l""",
)
def _(spark, d):
    return metadata.space_amplification(events_log(spark, d)).select("stored", "live", F.round("amplification", 6).alias("amplification"))


@_query(
    "human_bytes",
    """SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || ' KiB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0) || ' MiB'
    ELSE printf('%.1f', n / 1073741824.0) || ' GiB' END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice * (o_orderkey % 4 + 1) * (o_orderkey % 4 + 1) * 997) + 1 AS BIGINT) AS n FROM orders)""",
)
def _(spark, d):
    k = F.col("o_orderkey") % 4 + 1
    n = (F.floor(F.col("o_totalprice") * k * k * 997) + 1).cast("long")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", numbers.human_bytes(n).alias("shown"))


# -- blooms

DISTINCT = f"WITH {CL}, {RUNS}, keys AS (SELECT run AS num, count(DISTINCT key) AS keys FROM runs GROUP BY run)"


@_query("bloom_distinct_keys_per_run", f"{DISTINCT} SELECT * FROM keys")
def _(spark, d):
    return with_runs(events_log(spark, d)).groupBy(F.col("run").alias("num")).agg(F.countDistinct("key").alias("keys"))


@_query(
    "bloom_sizing",
    f"""{DISTINCT}, p AS (SELECT num, keys, -ln(0.01) / (ln(2) * ln(2)) AS bits FROM keys)
    SELECT num, keys, round(bits, 6) AS bits, CAST(least(30, greatest(1, round(bits * ln(2)))) AS INTEGER) AS hashes,
    CAST(floor((greatest(64, ceil(keys * bits)) + 7) / 8) AS BIGINT) AS bytes FROM p""",
)
def _(spark, d):
    rows = with_runs(events_log(spark, d)).groupBy(F.col("run").alias("num")).agg(F.countDistinct("key").alias("keys")).withColumn("b", bloom.bits_per_key(F.lit(0.01)))
    size = F.floor((F.greatest(F.lit(64), F.ceil(F.col("keys") * F.col("b"))) + 7) / 8).cast("long")
    return rows.select("num", "keys", F.round("b", 6).alias("bits"), bloom.num_hashes(F.col("b")).alias("hashes"), size.alias("bytes"))


@_query("bloom_no_false_negatives", f"WITH {CL}, {RUNS} SELECT DISTINCT run AS num, key, TRUE AS maybe FROM runs")
def _(spark, d):
    log = with_runs(events_log(spark, d))
    held = log.select("key", F.col("run").alias("num")).distinct()
    return bloom.ask(held, bloom.filters_by_run(log)).select("num", *text("key"), "maybe")


# -- writes


@_query("put_delete_counts", f"WITH {CL} SELECT key, count(*) FILTER (kind = 1) AS puts, count(*) FILTER (kind = 0) AS deletes, max(seq) AS last_seq FROM cl GROUP BY key")
def _(spark, d):
    return events_log(spark, d).groupBy("key").agg(F.count_if(F.col("kind") == 1).alias("puts"), F.count_if(F.col("kind") == 0).alias("deletes"), F.max("seq").alias("last_seq")).select(*text("key"), "puts", "deletes", "last_seq")


@_query("seq_assignment", "SELECT url AS key, row_number() OVER (ORDER BY page_id) + 41 AS seq, 1 AS kind, md5(html) AS value FROM pages")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select(F.col("url").cast("binary").alias("key"), F.md5(F.col("html").cast("binary")).cast("binary").alias("value"), "page_id")
    return _versions(writes.puts(rows, ["page_id"], 42))


@_query("put_then_delete_view", f"WITH {CL}, {newest_sql()} SELECT key, value FROM newest WHERE kind = 1 AND key NOT IN ('user:000001', 'user:000005', 'user:000199')")
def _(spark, d):
    log = events_log(spark, d)
    gone = spark.createDataFrame([(b"user:000001",), (b"user:000005",), (b"user:000199",)], "key binary")
    return views.view(log.unionByName(writes.deletes(gone, ["key"], 1 << 40))).select(*text("key", "value"))


# -- workload and statistics

MILLIS = "CAST(floor(value * 1000) AS BIGINT)"


@_query(
    "latency_percentiles",
    f"""WITH r AS (SELECT event_type AS phase, {MILLIS} AS latency, row_number() OVER (PARTITION BY event_type ORDER BY {MILLIS}, event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT phase, max(n) AS n, max(latency) FILTER (pos = least(n - 1, n // 2)) AS p50, max(latency) FILTER (pos = least(n - 1, n * 99 // 100)) AS p99, max(latency) AS greatest FROM r GROUP BY phase""",
)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("phase"), F.floor(F.col("value") * 1000).cast("long").alias("latency"))
    return numbers.nearest_rank(rows, "phase", "latency", {"p50": (1, 2), "p99": (99, 100)})


@_query("throughput", "SELECT event_type AS phase, count(*) AS ops, round(count(*) / (sum(value) / 1000), 4) AS per_second FROM events GROUP BY event_type")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("ops"), F.sum("value").alias("s"))
    return rows.select("phase", "ops", F.round(numbers.throughput(F.col("ops"), F.col("s") / 1000), 4).alias("per_second"))


@_query("workload_reads")
def _(spark, d):
    log = workload.writes(spark, 2_000, 20_000)
    asked = workload.reads(spark, 2_000, 5_000)
    return views.lookup(log, asked).groupBy("result").count()


@_query(
    "rate_limiter",
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS client, epoch_us(ts) / 1e6 AS secs, event_id AS id,
      row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
    fold AS (SELECT client, secs, id, n, CAST(1 AS DOUBLE) AS left_over, TRUE AS allowed, CAST(0 AS DOUBLE) AS wait FROM e WHERE n = 1
      UNION ALL SELECT x.client, x.secs, x.id, x.n, CASE WHEN x.had >= 1 THEN x.had - 1 ELSE x.had END, x.had >= 1, CASE WHEN x.had >= 1 THEN 0 ELSE greatest(1.0, (1 - x.had) * 3600) END
      FROM (SELECT e.*, least(CAST(2 AS DOUBLE), f.left_over + greatest(0.0, e.secs - f.secs) / 3600) AS had FROM fold f JOIN e ON e.client = f.client AND e.n = f.n + 1) x)
    SELECT client, id, allowed, round(wait, 2) AS retry_after FROM fold""",
)
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"))
    limited = limits.rate_limited(events.select("client", (F.col("us") / 1e6).alias("at"), "id"), rate=1 / 3600, burst=2)
    return limited.select("client", "id", "allowed", F.round("retry_after", 2).alias("retry_after"))


@_query(
    "byte_budget_admission",
    f"""WITH RECURSIVE {CL}, w AS (SELECT key AS namespace, seq, CAST({COST} AS BIGINT) AS cost, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM cl),
    fold AS (SELECT namespace, seq, cost, n, CASE WHEN cost <= 1000 THEN cost ELSE CAST(0 AS BIGINT) END AS used, cost <= 1000 AS admitted FROM w WHERE n = 1
      UNION ALL SELECT w.namespace, w.seq, w.cost, w.n, f.used + CASE WHEN f.used + w.cost <= 1000 THEN w.cost ELSE 0 END, f.used + w.cost <= 1000 FROM fold f JOIN w ON w.namespace = f.namespace AND w.n = f.n + 1)
    SELECT namespace, seq, cost, admitted FROM fold""",
)
def _(spark, d):
    return limits.within_budget(events_log(spark, d).select(*[F.col("key").cast("string").alias("namespace")], "seq", schema.entry_cost().alias("cost")), 1000)


# -- replication


@_query(
    "raft_log_fold",
    """WITH RECURSIVE rec AS (SELECT o_orderkey AS pos, row_number() OVER (ORDER BY o_orderkey) AS n, CASE WHEN o_orderkey % 10 >= 8 THEN 'TRUNC' ELSE 'ENTRY' END AS rec,
      CAST(4 * (o_orderkey // 10) + CASE o_orderkey % 10 WHEN 8 THEN 20 WHEN 9 THEN 5 ELSE o_orderkey % 10 + 1 + CASE WHEN o_orderkey % 5003 = 0 THEN 6 ELSE 0 END END AS BIGINT) AS index,
      o_orderkey // 10 + 1 AS term FROM orders),
    log AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS low, CAST(NULL AS BIGINT) AS high
      UNION ALL SELECT r.n,
        CASE WHEN r.rec = 'TRUNC' THEN CASE WHEN r.index <= l.low THEN NULL ELSE l.low END WHEN l.low IS NULL OR r.index < l.low OR r.index > l.high + 1 THEN r.index ELSE l.low END,
        CASE WHEN r.rec = 'TRUNC' THEN CASE WHEN r.index <= l.low THEN NULL ELSE least(l.high, r.index - 1) END ELSE r.index END
      FROM log l JOIN rec r ON r.n = l.n + 1),
    fin AS (SELECT low, high FROM log ORDER BY n DESC LIMIT 1)
    SELECT max(pos) AS pos, index, CAST(max_by(term, pos) AS BIGINT) AS term FROM rec, fin WHERE rec = 'ENTRY' AND index BETWEEN low AND high GROUP BY index""",
)
def _(spark, d):
    """A log that grows by eight, is cut beyond its end (which does nothing) and back by four; a gap begins it anew now and then."""
    pos = F.col("pos")
    tens, ones = F.expr("pos div 10"), F.pmod("pos", F.lit(10))
    gap = F.when(F.pmod("pos", F.lit(5003)) == 0, 6).otherwise(0)
    index = 4 * tens + F.when(ones == 8, 20).when(ones == 9, 5).otherwise(ones + 1 + gap)
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("pos"))
    records = orders.select(pos, F.when(ones >= 8, "TRUNC").otherwise("ENTRY").alias("rec"), index.alias("index"), (tens + 1).alias("term"))
    return replication.fold_log(records).select("pos", "index", "term")


@_query(
    "raft_commit_index",
    """WITH m AS (SELECT s_nationkey AS grp, s_suppkey AS node, CAST(s_suppkey * 7 % 40 AS BIGINT) AS match FROM supplier),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY match DESC, node) AS rank, count(*) OVER (PARTITION BY grp) AS n FROM m),
    a AS (SELECT grp, match AS agreed FROM r WHERE rank = n // 2 + 1),
    log AS (SELECT grp, i AS index, i // 10 + 1 AS term FROM (SELECT DISTINCT grp FROM m), range(1, 41) t(i))
    SELECT a.grp, CAST(coalesce(max(l.index), 0) AS BIGINT) AS commit FROM a LEFT JOIN log l ON l.grp = a.grp AND l.index <= a.agreed AND l.term = 2 GROUP BY a.grp""",
)
def _(spark, d):
    suppliers = spark.read.parquet(f"{d}/supplier.parquet")
    matches = suppliers.select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("node"), F.pmod(F.col("s_suppkey") * 7, F.lit(40)).cast("long").alias("match"), F.lit(2).cast("long").alias("current_term"))
    log = suppliers.select(F.col("s_nationkey").alias("grp")).distinct().withColumn("index", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long")))).withColumn("term", F.expr("`index` div 10") + 1)
    return replication.commit_index(matches, log)


@_query(
    "raft_vote_rule",
    """SELECT c_custkey AS voter, (its_term >= term AND (its_term > term OR voted IS NULL OR voted = 5) AND (its_last_term > last_term OR (its_last_term = last_term AND its_last_index >= last_index))) AS granted
    FROM (SELECT c_custkey, c_custkey % 5 AS term, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 7 END AS voted, c_custkey % 4 AS last_term, c_custkey % 11 AS last_index,
      3 AS its_term, 2 AS its_last_term, 6 AS its_last_index FROM customer)""",
)
def _(spark, d):
    c = F.col("c_custkey")
    mod = lambda n: F.pmod(c, F.lit(n))
    granted = replication.grants_vote(mod(5), F.when(mod(3) > 0, mod(7)), mod(4), mod(11), F.lit(5), F.lit(3), F.lit(2).cast("long"), F.lit(6).cast("long"))
    return spark.read.parquet(f"{d}/customer.parquet").select(c.alias("voter"), granted.alias("granted"))


def _two_logs(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") + 1).alias("index"), F.expr("event_id div 100 + 1").alias("term"))
    return rows, rows.where("`index` <= 700").withColumn("term", F.when(F.col("index") > 450, F.col("term") + 1).otherwise(F.col("term")))


FOLLOWER = "f AS (SELECT event_id + 1 AS index, event_id // 100 + 1 + CASE WHEN event_id + 1 > 450 THEN 1 ELSE 0 END AS term FROM events WHERE event_id + 1 <= 700)"


@_query("raft_first_conflict", f"WITH l AS (SELECT event_id + 1 AS index, event_id // 100 + 1 AS term FROM events), {FOLLOWER} SELECT min(index) AS conflict FROM l FULL JOIN f USING (index) WHERE l.term IS DISTINCT FROM f.term")
def _(spark, d):
    return replication.first_conflict(*_two_logs(spark, d))


@_query("raft_conflict_hint", f"WITH {FOLLOWER}, t AS (SELECT term FROM f WHERE index = 620) SELECT (SELECT min(index) FROM f WHERE term = (SELECT term FROM t)) AS conflict_index, (SELECT term FROM t) AS conflict_term")
def _(spark, d):
    return replication.conflict_hint(_two_logs(spark, d)[1], 620, 7)


@_query("raft_apply_committed", f"WITH {CL}, {newest_sql('seq <= 700')} SELECT key, seq, value FROM newest WHERE kind = 1")
def _(spark, d):
    entries = events_log(spark, d).withColumnRenamed("seq", "index").withColumn("kind", F.col("kind").cast("int"))
    noop = spark.createDataFrame([(b"", 0, replication.NOOP, None)], "key binary, `index` long, kind int, value binary")
    return views.view(replication.committed_changelog(entries.unionByName(noop), 700)).select(*text("key"), "seq", *text("value"))


@_query(
    "replica_diff",
    f"""WITH {CL}, {newest_sql()}, a AS (SELECT key, seq FROM newest WHERE kind = 1),
    b AS (SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS nth FROM cl WHERE seq <= (SELECT max(seq) FROM cl) - {HORIZON}) WHERE nth = 1 AND kind = 1)
    (SELECT key, seq, 'left' AS side FROM a EXCEPT ALL SELECT key, seq, 'left' FROM b) UNION ALL (SELECT key, seq, 'right' FROM b EXCEPT ALL SELECT key, seq, 'right' FROM a)""",
)
def _(spark, d):
    """A replica that is HORIZON entries behind, against one that has them all."""
    log = events_log(spark, d)
    behind = log.agg(F.max("seq")).first()[0] - HORIZON
    return replication.differences(views.view(log).select(*text("key"), "seq"), views.view(log, behind).select(*text("key"), "seq"))


@_query("replica_convergence", f"WITH {CL}, {newest_sql()} SELECT count(*) AS entries, 0 AS different FROM newest WHERE kind = 1")
def _(spark, d):
    """A replica that applied the log in another order, some of it twice: as many rows, and none that differs."""
    log = events_log(spark, d)
    one, two = views.view(log), views.view(log.unionByName(log.where(F.pmod("seq", F.lit(3)) == 0)).repartition("seq"))
    found = replication.differences(one.select(*text("key"), "seq"), two.select(*text("key"), "seq")).agg(F.count("*").cast("int").alias("different"))
    return two.agg(F.count("*").alias("entries")).join(F.broadcast(found))  # one row each


# -- stores


@_query("store_reopen_view", view_sql())
def _(spark, d):
    """The log in five batches, some flushed and merged, some left in the store's log; another handle reads the view."""
    at = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    log = events_log(spark, d)
    last = log.agg(F.max("seq")).first()[0]
    store = Store.open(spark, at)
    for n in range(5):
        store.append(log.where((F.col("seq") > last * n // 5) & (F.col("seq") <= last * (n + 1) // 5)))
        if n in (0, 1, 3):
            store.flush()
        if n == 1:
            store.compact()
    store.close()
    return views.view(Store.open(spark, at).snapshot().log()).select(*text("key"), "seq", *text("value"))


# -- streams


@_query("stream_latest_view", view_sql())
def _(spark, d):
    folder = shared_folder(spark)
    at = f"{folder}/live-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{d}/events.parquet").schema
    changes = schema.from_events(spark.readStream.schema(source).parquet(f"{d}/events*.parquet"))
    live.keep_view(changes, f"{at}/table", f"{at}/state").awaitTermination()
    return live.read_view(spark, f"{at}/table").select(*text("key"), "seq", *text("value"))
