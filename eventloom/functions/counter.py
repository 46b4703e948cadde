"""Counter-based random numbers: a pure function of seed and row identity.

A retried or differently partitioned task draws the same numbers, and any SQL engine with
md5 can reproduce them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, kind: str, *ids: Column) -> Column:
    """In [0, 1), 48 bits of the md5 of ``seed|kind|ids``."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(kind), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(2**48)


def normal(seed: int, kind: str, *ids: Column) -> Column:
    """Standard normal from two uniforms."""
    u, w = uniform(seed, kind + "-r", *ids), uniform(seed, kind + "-a", *ids)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * w)


def pick(seed: int, kind: str, n: int | Column, *ids: Column) -> Column:
    """Integer in [0, n)."""
    return F.floor(uniform(seed, kind, *ids) * n).cast("int")
