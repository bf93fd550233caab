"""Deterministic order keys: every sample, fold and shuffle is driven by an md5 of the row id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_HEX_DIGITS = 15
HASH_SPACE = float(16**HASH_HEX_DIGITS)


def hash_key(column: Column | str, seed: int | str) -> Column:
    """A 60-bit integer that any md5-capable engine reproduces."""
    column = F.col(column) if isinstance(column, str) else column
    text = F.concat_ws("_", column.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, HASH_HEX_DIGITS), 16, 10).cast("bigint")


def hash_fold(column: Column | str, folds: int, seed: int | str) -> Column:
    return F.pmod(hash_key(column, seed), F.lit(folds)).cast("int")


def hash_uniform(column: Column | str, seed: int | str) -> Column:
    """A value in [0, 1)."""
    return hash_key(column, seed).cast("double") / F.lit(HASH_SPACE)
