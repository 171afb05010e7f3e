"""Reproducible random columns: a pure function of seed, stream and row id, whatever the partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(row: Column, seed: int, stream: str) -> Column:
    """In [0, 1): the high 53 bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), row), 11) / float(1 << 53)


def integer(row: Column, seed: int, stream: str, n: int | Column) -> Column:
    """In 0 .. n - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), row), F.lit(n) if isinstance(n, int) else n)


def normal(row: Column, seed: int, stream: str) -> Column:
    """Standard normal, by Box and Muller's polar angle form."""
    u, v = uniform(row, seed, stream + "/r"), uniform(row, seed, stream + "/a")
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def choice(row: Column, seed: int, stream: str, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (integer(row, seed, stream, len(values)) + 1).cast("int"))


def uuid(row: Column, seed: int, stream: str) -> Column:
    """A version 4 UUID from two hashes."""
    a, b = (F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), F.lit(f"{stream}/{k}"), row))), 16, "0") for k in "ab")
    cut = lambda c, i, n: F.substring(c, i, n)
    return F.concat(cut(a, 1, 8), F.lit("-"), cut(a, 9, 4), F.lit("-4"), cut(a, 14, 3), F.lit("-a"), cut(b, 2, 3), F.lit("-"), cut(b, 5, 12))
