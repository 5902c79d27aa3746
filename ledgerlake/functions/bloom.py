"""Bloom filters: sizing, building and asking. Stores rely on Parquet's own; these serve keys outside files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
#: FNV-1a's basis and prime, and the two multipliers of the 64-bit finaliser.
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def bits_per_key(p: Column | float):
    """Bits for a false-positive share p."""
    return -F.log(p) / F.lit(math.log(2) ** 2) if isinstance(p, Column) else -math.log(p) / math.log(2) ** 2


def num_hashes(bits: Column | float):
    """Hash functions for so many bits a key: 1 to 30."""
    if isinstance(bits, Column):
        return F.least(F.lit(30), F.greatest(F.lit(1), F.round(bits * F.lit(math.log(2))).cast("int")))
    return min(30, max(1, math.floor(bits * math.log(2) + 0.5)))


def key_hash(key: bytes) -> int:
    h = FNV_BASIS
    for byte in key:
        h = ((h ^ byte) * FNV_PRIME) & _MASK
    h ^= h >> 30
    h = h * MULTIPLIERS[0] & _MASK
    h ^= h >> 27
    h = h * MULTIPLIERS[1] & _MASK
    return h ^ h >> 31


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """key_hash of many keys, byte by byte of all at once; long keys one by one."""
    sizes = np.array([len(k) for k in keys], np.int64)
    out = np.full(len(keys), FNV_BASIS, np.uint64)
    short = np.flatnonzero(sizes <= 256)
    width = int(sizes[short].max(initial=0))
    padded = np.frombuffer(b"".join(keys[i].ljust(width, b"\0") for i in short), np.uint8).reshape(len(short), width) if width else np.zeros((len(short), 0), np.uint8)
    h = out[short]
    for at in range(width):
        on = sizes[short] > at
        h[on] = (h[on] ^ padded[on, at]) * np.uint64(FNV_PRIME)
    for shift, multiplier in ((30, MULTIPLIERS[0]), (27, MULTIPLIERS[1])):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(multiplier)
    out[short] = h ^ (h >> np.uint64(31))
    for i in np.flatnonzero(sizes > 256):
        out[i] = key_hash(keys[i])
    return out


def _positions(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """A row of k places for each hash."""
    step = (h >> np.uint64(32) | h << np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(k, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def build(keys: list[bytes], p: float = 0.01) -> bytes:
    """Bits in whole bytes, 64 at least, and a last byte with the number of hash functions. Repeated keys count once."""
    distinct = list(dict.fromkeys(keys))
    per = bits_per_key(p)
    size, k = (max(64, math.ceil(len(distinct) * per)) + 7) // 8, num_hashes(per)
    held = np.zeros(size * 8, bool)
    held[_positions(key_hashes(distinct), k, size * 8)] = True
    return np.packbits(held, bitorder="little").tobytes() + bytes([k])


def may_contain_all(filter_: bytes, keys: list[bytes]) -> np.ndarray:
    """Never False for a key that was added. A malformed filter excludes nothing."""
    if len(filter_) < 2 or not 1 <= filter_[-1] <= 30:
        return np.ones(len(keys), bool)
    bits = np.unpackbits(np.frombuffer(filter_[:-1], np.uint8), bitorder="little").view(bool)
    return bits[_positions(key_hashes(keys), filter_[-1], len(bits))].all(axis=1)


def may_contain(filter_: bytes, key: bytes) -> bool:
    return bool(may_contain_all(filter_, [key])[0])


def filters_by_run(log: DataFrame, p: float = 0.01, run: str = "run") -> DataFrame:
    """(num, filter) per run. A run's distinct keys are one group: runs are cut at a size that one task holds."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"num": [key[0]], "filter": [build([bytes(x) for x in rows["key"]], p)]})

    return log.select(F.col(run).cast("long").alias("num"), "key").distinct().groupBy("num").applyInPandas(one, "num long, filter binary")


def ask(probes: DataFrame, filters: DataFrame, parts: int = 2) -> DataFrame:
    """Probe keys (key, num) with the verdict of their run's filter. A run's probes are dealt into parts; each meets the filter once."""

    def verdicts(_, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"key": [], "num": [], "maybe": []})
        return pd.DataFrame({"key": asked["key"], "num": asked["num"], "maybe": may_contain_all(bytes(held["filter"].iloc[0]), [bytes(k) for k in asked["key"]])})

    dealt = probes.select("key", F.col("num").cast("long").alias("num"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("long").alias("part"))
    copies = filters.select("num", "filter", F.explode(F.array([F.lit(i).cast("long") for i in range(parts)])).alias("part"))
    return dealt.groupBy("num", "part").cogroup(copies.groupBy("num", "part")).applyInPandas(verdicts, "key binary, num long, maybe boolean")


def skipped(probes: DataFrame, filters: DataFrame) -> DataFrame:
    """Per run: probes asked, and how many of them its filter spared a look into the run."""
    return ask(probes, filters).groupBy("num").agg(F.count("*").alias("asked"), F.count_if(~F.col("maybe")).alias("skipped"))
