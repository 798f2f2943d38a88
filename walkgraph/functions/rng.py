"""Draws that depend on (seed, walk_id, step, salt) alone, the same in Python and in SQL."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32


def limit(alpha: float) -> int:
    """A walk goes on if its draw is at most this."""
    return int(alpha * RANGE)


def draws(seed: int, walk_ids: np.ndarray, step: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers below 2 ** 32 for each walk: whether it goes on, and where to."""
    md5, tail = hashlib.md5, f"|{step}|{salt}"
    out = np.frombuffer(b"".join([md5(f"{seed}|{w}{tail}".encode()).digest()[:8] for w in walk_ids.tolist()]), ">u4")
    return out[0::2].astype(np.int64), out[1::2].astype(np.int64)


def fast_draws(seed: int, walk_ids: np.ndarray, step: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """As draws(), by a vectorised mixer that SQL has no twin of."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = walk_ids.astype(u) * u(0x9E3779B97F4A7C15) + u((seed * 0xD1342543DE82EF95 + step * 0xAF251AF3B0F025B5 + salt * 0xB564EF22EC7AECE5) % 2**64)
        x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
        x ^= x >> u(31)
    return (x >> u(32)).astype(np.int64), (x & u(0xFFFFFFFF)).astype(np.int64)


def draw_columns(seed: int, walk_id: Column, step: Column | int, salt: int) -> tuple[Column, Column]:
    """draws() as columns."""
    step = F.lit(step) if isinstance(step, int) else step
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), walk_id.cast("string"), step.cast("string"), F.lit(str(salt))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def draw_sql(seed: int, walk_id: str, step: str, salt: int) -> tuple[str, str]:
    """draws() in the SQL of the checks."""
    digest = f"md5('{seed}|' || {walk_id} || '|' || {step} || '|{salt}')"
    return tuple(f"CAST('0x' || substr({digest}, {k}, 8) AS BIGINT)" for k in (1, 9))
