"""Log files as changelogs, and changelogs as log files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.codecs import MAX_COMMAND, LogRecord, decode_record, encode_frame, encode_log_record, encode_record, replay, replay_consensus
from ledgerlake.schema import CHANGELOG, CorruptData

READ = "path string, key binary, seq long, kind tinyint, value binary"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows, last = [], 0
            for payload in replay(bytes(content)).payloads:
                seq, kind, key, value = decode_record(payload)
                if seq <= last:
                    raise CorruptData(f"{path}: sequence number {seq} after {last}")
                last = seq
                rows.append((path, key, seq, kind, value))
            yield pd.DataFrame(rows, columns=["path", "key", "seq", "kind", "value"])


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the *.log files of a folder (path, key, seq, kind, value). A file is decoded as a whole by one task;
    torn ends are left off, other damage fails the job, and so do numbers that don't rise within a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder)
    return files.select("path", "content").mapInPandas(_decode, READ)


def files_in_order(records: DataFrame) -> DataFrame:
    """Pairs of files whose ranges of sequence numbers overlap; empty for logs that follow each other."""
    spans = records.groupBy("path").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    a, b = spans.select(F.col("path").alias("first"), "low", "high"), spans.select(F.col("path").alias("second"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    return a.join(b, (F.col("first") < F.col("second")) & (F.col("low") <= F.col("high2")) & (F.col("low2") <= F.col("high")))


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        frames = [
            encode_frame(encode_record(int(s), int(k), bytes(key), None if v is None else bytes(v))) for key, s, k, v in zip(batch["key"], batch["seq"], batch["kind"], batch["value"], strict=True)
        ]
        yield pd.DataFrame({"frame": frames})


def frames(log: DataFrame) -> DataFrame:
    """Framed records in order of sequence number within each partition; their concatenation is a log file."""
    return log.select(*CHANGELOG.names).sortWithinPartitions("seq").mapInPandas(_encode, "frame binary")


CONSENSUS = "path string, pos long, rec string, term long, `index` long, voted_for string, command binary"


def _decode_consensus(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = [(path, pos, r.rec, r.term, r.index, r.voted_for, r.command) for pos, r in enumerate(replay_consensus(bytes(content)), 1)]
            found = pd.DataFrame(rows, columns=["path", "pos", "rec", "term", "index", "voted_for", "command"])
            yield found.astype({"term": "Int64", "index": "Int64"})


def read_consensus_logs(spark: SparkSession, folder: str, names: str = "*.raft") -> DataFrame:
    """Records (path, pos, rec, term, index, voted_for, command) of the replicated logs in a folder, one file a node: what
    replication.fold_log and hard_state take, node by node."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder)
    return files.select("path", "content").mapInPandas(_decode_consensus, CONSENSUS)


def _encode_consensus(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    whole = lambda x: None if pd.isna(x) else int(x)
    for batch in batches:
        rows = zip(batch["rec"], batch["term"], batch["index"], batch["voted_for"], batch["command"], strict=True)
        frames = [encode_frame(encode_log_record(LogRecord(rec, whole(term), whole(index), voted, None if command is None else bytes(command))), MAX_COMMAND + 64) for rec, term, index, voted, command in rows]
        yield pd.DataFrame({"frame": frames})


def consensus_frames(records: DataFrame) -> DataFrame:
    """Framed records in order of pos within each partition; their concatenation is a replicated log's file."""
    return records.select("pos", "rec", "term", "index", "voted_for", "command").sortWithinPartitions("pos").mapInPandas(_encode_consensus, "frame binary")
