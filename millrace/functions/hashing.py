"""Content hashes, and numbers drawn from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: int | str, key: Column) -> Column:
    """SHA-256 of ``seed:key`` in hex; its order is a reproducible shuffle."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def unit_interval(digest: Column) -> Column:
    """The first 64 bits of a hex digest as a number from 0 to 1."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def partition_of(key: Column, parts: int) -> Column:
    """A stable partition number from the first 60 bits of the key's SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 15), 16, 10).cast("long"), F.lit(parts))
