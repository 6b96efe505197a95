"""Keyed hashes and seeded draws, all as native expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

_BLOCK = 64


def hmac_sha256(key: str | bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex.  The padded keys are worked out once; the rows stay in the JVM."""
    secret = key.encode() if isinstance(key, str) else key
    if len(secret) > _BLOCK:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(_BLOCK, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in secret))
    outer = F.lit(bytearray(b ^ 0x5C for b in secret))
    data = F.encode(message, "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data), 256))), 256)


def seeded_key(seed: int | str, *keys: Column) -> Column:
    """Hex key that orders rows at random, the same way on every run and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def seeded_uniform(seed: int | str, *keys: Column) -> Column:
    """Number in [0, 1) drawn from the keys: the first 13 hex digits over 2**52."""
    digits = F.conv(F.substring(seeded_key(seed, *keys), 1, 13), 16, 10)
    return digits.cast("bigint").cast("double") / F.lit(float(2 ** 52))
