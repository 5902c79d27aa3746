"""A store of immutable sorted runs and log segments under a versioned manifest.

A folder holds ``log/<name>`` and ``runs/<name>`` (Parquet; runs are dealt by key ranges and sorted by key, newest first) and
``manifest/<version>.json``, each the whole live state. Names are unique, so writers never meet on one. A commit writes the
next version to a temporary file and renames it to a name that must not exist yet: the loser of a race finds it taken,
raises StoreLocked, and goes on after ``refresh``.

A batch of writes is a log segment; it is durable and readable as soon as the version that lists it is committed. A flush makes
one sorted run of all segments and commits it in their place. Readers pin a version, so commits never change what they see.
What no kept version refers to is an orphan: opening a store and ``vacuum`` remove orphans that are old enough not to be
another writer's work in progress.

A merge drops versions that no snapshot at or beyond its horizon sees. Snapshots before the highest horizon of merges that
dropped something are refused (SnapshotTooOld).
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import compaction, metadata, views
from ledgerlake.schema import CHANGELOG, DELETE, ENTRY_OVERHEAD, RECORD_HEADER, SET, InvalidBatch, KeyNotFound, LedgerError, SnapshotTooOld, StoreClosed, StoreLocked, changelog, entry_cost, validated


@dataclass(frozen=True)
class StoreOptions:
    """Rows of a Parquet row group follow from its bytes; blooms are sized for the distinct keys of one."""

    row_group_bytes: int = 64 << 20
    bloom_false_positives: float = 0.01
    bloom_keys: int = 200_000
    pick: compaction.PickOptions = field(default_factory=compaction.PickOptions)
    auto_compact: bool = True
    keep_versions: int = 5
    #: Cost of the log, and number of its segments, from which a write flushes first.
    flush_bytes: int = 256 << 20
    flush_segments: int = 64
    #: Sequence numbers behind the last one of which merges keep every version.
    retain: int = 0
    #: Age from which something that no version refers to is taken for abandoned.
    orphan_seconds: float = 86_400.0

    def __post_init__(self):
        if self.flush_bytes <= 0 or self.flush_segments <= 0 or self.keep_versions <= 0 or self.retain < 0:
            raise ValueError("options out of bounds")


@dataclass(frozen=True)
class Run:
    """A sorted run, or a segment of the log. ``size`` is what its entries cost; ``num`` rises."""

    num: int
    name: str
    size: int
    entries: int
    min_seq: int
    max_seq: int
    smallest: str
    largest: str


@dataclass(frozen=True)
class State:
    """A version of the manifest. Keys are hexadecimal, which keeps their order."""

    version: int = 0
    next_file: int = 1
    last_seq: int = 0
    #: Snapshots below it are not whole any more.
    floor: int = 0
    runs: tuple[Run, ...] = ()
    log: tuple[Run, ...] = ()
    counters: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def of(text: str) -> "State":
        raw = json.loads(text)
        return State(**raw | {k: tuple(Run(**r) for r in raw[k]) for k in ("runs", "log")})

    def apply(self, added: list[Run], deleted: set[int], last_seq: int = 0, logged: list[Run] | None = None, flushed: set[int] | None = None, floor: int = 0, **counted: int) -> "State":
        """The next version: deletions first; an unknown one is an error and changes nothing."""
        for gone, here in ((deleted, self.runs), (flushed or set(), self.log)):
            if unknown := gone - {r.num for r in here}:
                raise LedgerError(f"unknown runs {sorted(unknown)}")
        runs = tuple(sorted([r for r in self.runs if r.num not in deleted] + added, key=lambda r: -r.max_seq))
        log = tuple([r for r in self.log if r.num not in (flushed or set())] + (logged or []))
        next_file = max([self.next_file, *(r.num + 1 for r in [*added, *(logged or [])])])
        counters = self.counters | {k: self.counters.get(k, 0) + v for k, v in counted.items()}
        return State(self.version + 1, next_file, max(self.last_seq, last_seq), max(self.floor, floor), runs, log, counters)


class Files:
    """The few file operations that a store needs, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.folder = folder.rstrip("/")
        self.system = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def list(self, name: str) -> list[str]:
        at = self.path(name)
        return sorted(s.getPath().getName() for s in self.system.listStatus(at)) if self.system.exists(at) else []

    def age(self, name: str) -> float:
        """Seconds since a file, or the newest file directly in a folder, was written."""
        at = self.path(name)
        times = [self.system.getFileStatus(at).getModificationTime(), *(s.getModificationTime() for s in self.system.listStatus(at))]
        return time.time() - max(times) / 1000

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file whole or not at all; False if it exists."""
        target = self.path(name)
        if self.system.exists(target):
            return False
        part = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.system.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.system.getConf())
            options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            context.rename(part, target, options)  # fails if the target exists
        except Exception as e:
            self.delete(part.getName() if "/" not in name else f"{name.rpartition('/')[0]}/{part.getName()}")
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


class Snapshot:
    """A pinned version and sequence number; reads never see later commits."""

    def __init__(self, store: "Store", state: State, seq: int | None = None):
        self.store, self.state = store, state
        self.seq = state.last_seq if seq is None else min(seq, state.last_seq)
        if self.seq < state.floor:
            raise SnapshotTooOld(f"a merge dropped versions up to {state.floor}; {self.seq} is before it")

    def _held(self, start: bytes | None, end: bytes | None) -> list[tuple[str, Run]]:
        """Runs and segments that the bounds and the snapshot do not exclude."""
        low, high = (start or b"").hex(), None if end is None else end.hex()
        sources = [("runs", r) for r in self.state.runs] + [("log", r) for r in self.state.log]
        return [(kind, r) for kind, r in sources if r.min_seq <= self.seq and r.largest >= low and (high is None or r.smallest < high)]

    def log(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """Visible versions in [start, end). Runs that the bounds or the snapshot exclude are not opened."""
        held = self._held(start, end)
        self.store.read_counters["probes"] += sum(kind == "runs" for kind, _ in held)
        self.store.read_counters["skips"] += len(self.state.runs) - sum(kind == "runs" for kind, _ in held)
        return views.bounded(self.store.read(held), start, end).where(F.col("seq") <= self.seq)

    def scan(self, start: bytes | None = None, end: bytes | None = None, limit: int = 0) -> DataFrame:
        return views.scan(self.log(start, end), start, end, limit)

    def prefix(self, prefix: bytes, limit: int = 0) -> DataFrame:
        return self.scan(*views.prefix_bounds(prefix), limit)

    def lookup(self, probes: DataFrame) -> DataFrame:
        """Per probe key: Found, Deleted or NotFound, and the value. Runs beyond the least and greatest probe are not opened."""
        span = probes.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
        self.store.read_counters["lookups"] += 1
        if span["low"] is None:
            return views.lookup(self.store.read([]), probes)
        return views.lookup(self.log(bytes(span["low"]), bytes(span["high"]) + b"\0"), probes)

    def get(self, key: bytes) -> bytes:
        """One key's value; KeyNotFound if it has none. Asks for many keys belong in ``lookup``."""
        self.store.read_counters["gets"] += 1
        found = views.get(self.log(key, key + b"\0"), key).collect()  # one row at most
        if not found:
            raise KeyNotFound(key)
        return bytes(found[0]["value"])


class Store:
    """One writer's handle. Opening removes what crashed writers have left."""

    def __init__(self, spark: SparkSession, folder: str, options: StoreOptions = StoreOptions()):
        if not folder:
            raise ValueError("a store needs a folder")
        self.spark, self.options, self.closed, self.failed = spark, options, False, None
        self.files = Files(spark, folder)
        self.read_counters = {"gets": 0, "lookups": 0, "probes": 0, "skips": 0}
        self.state = self._latest()
        self.recovered = self._remove_orphans()

    @staticmethod
    def open(spark: SparkSession, folder: str, options: StoreOptions = StoreOptions()) -> "Store":
        return Store(spark, folder, options)

    @property
    def next_seq(self) -> int:
        return self.state.last_seq + 1

    # -- manifest

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.list("manifest") if n.endswith(".json"))

    def _latest(self) -> State:
        versions = self._versions()
        return self.version(versions[-1]) if versions else State()

    def version(self, number: int) -> State:
        return State.of(self.files.read(f"manifest/{number:012d}.json"))

    def _commit(self, state: State) -> None:
        """Makes a version the latest. What it adds must still be there: a vacuum may have taken it for abandoned."""
        before = {r.name for r in (*self.state.runs, *self.state.log)}
        for kind, sources in (("runs", state.runs), ("log", state.log)):
            for r in sources:
                if r.name not in before and not self.files.exists(f"{kind}/{r.name}/_SUCCESS"):
                    raise LedgerError(f"{kind}/{r.name} was removed before it was committed")
        if not self.files.create(f"manifest/{state.version:012d}.json", json.dumps(asdict(state))):
            raise StoreLocked(f"version {state.version} was committed by another writer; refresh and write again")
        self.state = state

    def _open(self) -> None:
        if self.closed:
            raise StoreClosed("the store is closed")
        if self.failed is not None:
            raise LedgerError("an earlier write failed; open the store again") from self.failed

    def _guarded(self, step, *made: str):
        """Runs a write. A lost race or a wrong batch leaves nothing behind, and the handle goes on; any other error fails it."""
        try:
            return step()
        except (StoreLocked, InvalidBatch):
            for name in made:
                self.files.delete(name)
            raise
        except Exception as e:
            self.failed = e
            raise

    # -- runs and segments

    def read(self, held) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], CHANGELOG)
        return self.spark.read.schema(CHANGELOG).parquet(*(f"{self.files.folder}/{kind}/{r.name}" for kind, r in held))

    def read_runs(self, runs) -> DataFrame:
        return self.read([("runs", r) for r in runs])

    def _write(self, rows: DataFrame, kind: str, num: int, name: str, fates: Observation | None = None) -> Run | None:
        """Writes rows once, described while they are written; None if there are none. With ``fates`` rows are those of
        compaction.survivors, counted there. Observed behind the exchange: what lies before it also runs to sample its ranges."""
        where, seen = f"{self.files.folder}/{kind}/{name}", Observation()
        if kind == "runs":
            rows = rows.repartitionByRange("key").sortWithinPartitions("key", F.desc("seq"), F.desc("kind"))
        if fates is not None:
            rows = rows.observe(fates, F.coalesce(F.sum("replaced"), F.lit(0)).alias("versions"), F.count_if(F.col("fate") == compaction.DROPPED_TOMBSTONE).alias("tombstones"))
            rows = rows.where(F.col("fate") == compaction.KEPT)
        facts = {"size": F.sum(entry_cost()), "entries": F.count("*"), "min_seq": F.min("seq"), "max_seq": F.max("seq"), "smallest": F.min(F.hex("key")), "largest": F.max(F.hex("key"))}
        rows = rows.select(*CHANGELOG.names).observe(seen, *(f.alias(n) for n, f in facts.items()))
        writer = rows.write.option("parquet.block.size", self.options.row_group_bytes)
        if kind == "runs":
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", self.options.bloom_keys)
            writer = writer.option("parquet.bloom.filter.fpp#key", self.options.bloom_false_positives)
        writer.parquet(where)
        found = seen.get
        if not found["entries"]:
            self.files.delete(f"{kind}/{name}")
            return None
        return Run(num, name, found["size"], found["entries"], found["min_seq"], found["max_seq"], found["smallest"].lower(), found["largest"].lower())

    def _name(self, num: int) -> str:
        return f"{num:012d}-{uuid.uuid4().hex}"

    # -- writes

    def append(self, log: DataFrame) -> None:
        """Writes a batch of versions with numbers of their own, all beyond those before, each number once. When it returns, the
        batch is durable and readable. A log that is full is flushed first."""
        self._open()
        if self.log_bytes >= self.options.flush_bytes or len(self.state.log) >= self.options.flush_segments:
            self.flush()
        num = self.state.next_file
        name = self._name(num)
        self._guarded(lambda: self._append(validated(log.select(*CHANGELOG.names)), num, name), f"log/{name}")

    def _append(self, rows: DataFrame, num: int, name: str) -> None:
        try:
            segment = self._write(rows, "log", num, name)
        except Exception as e:
            if "USER_RAISED_EXCEPTION" in str(e):  # ``validated`` found a row out of bounds
                raise InvalidBatch(str(e)[:500]) from e
            raise
        if segment is None:
            return
        wrong = None
        if segment.min_seq < self.next_seq:
            wrong = f"sequence number {segment.min_seq} is not beyond {self.next_seq - 1}"
        elif self.read([("log", segment)]).agg(F.count_distinct("seq")).first()[0] != segment.entries:
            wrong = "a sequence number occurs twice"
        if wrong:
            raise InvalidBatch(wrong)
        users = segment.size - segment.entries * ENTRY_OVERHEAD
        self._commit(self.state.apply([], set(), segment.max_seq, [segment], user_bytes=users, log_bytes=users + segment.entries * RECORD_HEADER, entries_written=segment.entries))

    def put(self, key: bytes, value: bytes) -> int:
        return self._one(key, SET, value)

    def delete(self, key: bytes) -> int:
        return self._one(key, DELETE, None)

    def _one(self, key: bytes, kind: int, value: bytes | None) -> int:
        """A batch of one. Many writes belong in ``append``."""
        self._open()
        seq = self.next_seq
        row = self.spark.createDataFrame([(bytearray(key), seq, kind, None if value is None else bytearray(value))], CHANGELOG)
        self.append(changelog(row, F.col("key"), F.col("seq"), F.col("kind"), F.col("value")))
        return seq

    def flush(self) -> bool:
        """Makes one sorted run of the log's segments; False if there are none."""
        self._open()
        if not self.state.log:
            return False
        num = self.state.next_file
        name = self._name(num)

        def step() -> None:
            segments = self.state.log
            run = self._write(self.read([("log", r) for r in segments]), "runs", num, name)
            self._commit(self.state.apply([run], set(), flushed={r.num for r in segments}, flushes=1, flush_bytes=run.size))

        self._guarded(step, f"runs/{name}")
        if self.options.auto_compact:
            self.compact_while_due()
        return True

    # -- compaction

    @property
    def horizon(self) -> int:
        """Up to here merges may drop versions."""
        return max(0, self.state.last_seq - self.options.retain)

    def compact(self) -> bool:
        """Merges all runs; the log is not flushed."""
        self._open()
        return self._merge(0, len(self.state.runs)) if self.state.runs else False

    def flush_and_compact(self) -> bool:
        """Flushes the log and merges all runs."""
        self.flush()
        return self.compact()

    def compact_while_due(self) -> int:
        """Merges what the policy picks until it picks nothing; how many merges."""
        self._open()
        done = 0
        while (chosen := compaction.pick([r.size for r in self.state.runs], self.options.pick)) is not None:
            self._merge(*chosen)
            done += 1
        return done

    def _merge(self, start: int, end: int) -> bool:
        """Merges neighbours [start, end) of the runs, newest first. Tombstones go only if the oldest run takes part."""
        before, name = self.state, self._name(self.state.next_file)
        chosen, bottom = before.runs[start:end], end == len(before.runs)
        newest = max(r.max_seq for r in chosen)
        horizon = None if self.horizon >= newest else self.horizon

        def step() -> None:
            fates = Observation()
            run = self._write(compaction.survivors(self.read_runs(chosen), bottom, horizon), "runs", before.next_file, name, fates)
            dropped = fates.get
            # A merge keeps the greatest number of its runs, so that runs stay in order even if that version was dropped.
            added = [] if run is None else [replace(run, max_seq=newest, min_seq=min(r.min_seq for r in chosen))]
            floor = min(newest, self.horizon) if dropped["versions"] + dropped["tombstones"] else 0
            counted = {"merges": 1, "merge_bytes": run.size if run else 0, "dropped_versions": dropped["versions"], "dropped_tombstones": dropped["tombstones"]}
            self._commit(before.apply(added, {r.num for r in chosen}, floor=floor, **counted))

        self._guarded(step, f"runs/{name}")
        return True

    def orphans(self) -> list[str]:
        """Runs, segments and temporary files that no kept version refers to, whatever their age."""
        kept = [self.version(v) for v in self._versions()[-self.options.keep_versions :]]
        found = [f"manifest/{n}" for n in self.files.list("manifest") if n.endswith(".tmp")]
        for kind in ("runs", "log"):
            live = {r.name for state in kept for r in getattr(state, kind)}
            found += [f"{kind}/{n}" for n in self.files.list(kind) if n not in live]
        return found

    def _remove_orphans(self) -> int:
        gone = [n for n in self.orphans() if self.files.age(n) >= self.options.orphan_seconds]
        for name in gone:
            self.files.delete(name)
        return len(gone)

    def vacuum(self) -> int:
        """Removes old orphans and versions beyond the retention; how many orphans."""
        self._open()
        for version in self._versions()[: -self.options.keep_versions]:
            self.files.delete(f"manifest/{version:012d}.json")
        return self._remove_orphans()

    # -- reads

    def snapshot(self, seq: int | None = None, version: int | None = None) -> Snapshot:
        """Committed data as of now, or as of an earlier number or version."""
        if self.closed:
            raise StoreClosed("the store is closed")
        return Snapshot(self, self.state if version is None else self.version(version), seq)

    def refresh(self) -> None:
        """Takes up commits of other writers."""
        if self.closed:
            raise StoreClosed("the store is closed")
        self.state = self._latest()

    def get(self, key: bytes) -> bytes:
        return self.snapshot().get(key)

    def scan(self, start: bytes | None = None, end: bytes | None = None, limit: int = 0) -> DataFrame:
        return self.snapshot().scan(start, end, limit)

    def lookup(self, probes: DataFrame) -> DataFrame:
        return self.snapshot().lookup(probes)

    @property
    def log_bytes(self) -> int:
        return sum(r.size for r in self.state.log)

    def stats(self) -> dict[str, float]:
        """Counters since the store was made; those of reads (gets, lookups, run_probes, runs_skipped) since this handle was opened.

        run_probes counts runs opened after bounds have excluded others (runs_skipped).
        """
        c, s = self.state.counters, self.state
        user, log, flushed, merged = (c.get(k, 0) for k in ("user_bytes", "log_bytes", "flush_bytes", "merge_bytes"))
        r = self.read_counters
        return {
            "version": s.version, "last_seq": s.last_seq, "floor": s.floor, "manifest_bytes": len(json.dumps(asdict(s))),
            "log_segments": len(s.log), "log_entries": sum(x.entries for x in s.log), "log_size": self.log_bytes, "flush_threshold": self.options.flush_bytes,
            "runs": len(s.runs), "run_bytes": sum(x.size for x in s.runs), "entries": sum(x.entries for x in s.runs), "entries_written": c.get("entries_written", 0),
            "flushes": c.get("flushes", 0), "merges": c.get("merges", 0), "dropped_versions": c.get("dropped_versions", 0), "dropped_tombstones": c.get("dropped_tombstones", 0),
            "user_bytes": user, "log_bytes": log, "flush_bytes": flushed, "merge_bytes": merged, "write_amplification": (log + flushed + merged) / user if user else 0.0,
            "gets": r["gets"], "lookups": r["lookups"], "run_probes": r["probes"], "runs_skipped": r["skips"],
        }

    def public_stats(self) -> dict[str, float]:
        """Aggregates that tell nothing of keys or readers, for anyone to see."""
        shown = ("last_seq", "log_entries", "log_size", "flush_threshold", "runs", "run_bytes", "flushes", "merges", "write_amplification", "runs_skipped")
        return {k: round(v, 2) for k, v in self.stats().items() if k in shown}

    def space_amplification(self) -> float:
        """Bytes of all versions in the runs over bytes of their live rows; reads all runs."""
        return metadata.space_amplification(self.read_runs(self.state.runs)).first()["amplification"]

    def close(self) -> None:
        """Later calls fail. All writes that returned are committed already. Closing twice is fine."""
        self.closed = True
