"""Byte keys."""

from __future__ import annotations


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key beyond all keys with the prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def client_key(forwarded_for: str | None, peer: str) -> str:
    """Who a request comes from: the last forwarded address, else the peer's host."""
    last = (forwarded_for or "").rpartition(",")[2].strip()
    return last or peer.rpartition(":")[0].strip("[]") or peer
