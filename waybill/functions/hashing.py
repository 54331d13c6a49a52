"""Randomness as a pure function of (id, salt, seed): the same in every partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.small import computed_once


LANE_DIGITS = 13


def digest(key: Column, salt: str, seed: int = 42) -> Column:
    """Digest to order rows by."""
    return F.md5(_seeded(key, salt, seed))


def wide_digest(key: Column, salt: str, seed: int = 42) -> Column:
    """Digest with room for four lanes of 52 bits."""
    return F.sha2(_seeded(key, salt, seed), 256)


def _seeded(key: Column, salt: str, seed: int) -> Column:
    return F.concat_ws("|", key.cast("string"), F.lit(salt), F.lit(str(seed)))


def lane_uniform(hashed: Column, lane: int = 0) -> Column:
    """Uniform in (0, 1) from one of the four lanes of a wide digest.

    52 bits and a half are all a double holds; an index drawn from 4.5e15 rows can be any of them.
    """
    word = F.substring(hashed, LANE_DIGITS * lane + 1, LANE_DIGITS)
    return (F.conv(word, 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(16**LANE_DIGITS))


def lane_normal(hashed: Column, lane: int = 0) -> Column:
    """Standard normal by Box-Muller; a digest gives four, lanes 0-3."""
    pair = lane // 2
    radius = F.sqrt(F.lit(-2.0) * F.ln(lane_uniform(hashed, 2 * pair)))
    angle = F.lit(2.0 * math.pi) * lane_uniform(hashed, 2 * pair + 1)
    return radius * (F.cos(angle) if lane % 2 == 0 else F.sin(angle))


def uniform(key: Column, salt: str, seed: int = 42, lane: int = 0) -> Column:
    return lane_uniform(wide_digest(key, salt, seed), lane)


def normal(key: Column, salt: str, seed: int = 42, lane: int = 0) -> Column:
    return lane_normal(wide_digest(key, salt, seed), lane)


def with_digests(df: DataFrame, key: Column, salts: dict[str, str], seed: int = 42) -> DataFrame:
    """Adds wide digest columns, worked out once per row however many lanes are read."""
    return computed_once(df, {name: wide_digest(key, salt, seed) for name, salt in salts.items()})


def hash_bucket(hashed: Column, digits: int = 4) -> Column:
    """Order-preserving bucket of a hex digest; uniform whatever the keys look like."""
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("int")
