"""Stable hashes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_key(seed: int, key: Column) -> Column:
    """16 hex digits of SHA-256 over `seed:key`; sorts as the number it stands for."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16)


def unit_interval(seed: int, key: Column) -> Column:
    """That hash as a number in [0, 1)."""
    return (F.conv(rank_key(seed, key), 16, 10).cast("decimal(20,0)") / F.lit(Decimal(2**64))).cast("double")
