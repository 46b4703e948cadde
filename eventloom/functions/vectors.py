"""Array-column helpers for state and action vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import rotation as rot


def make_state(pos, q) -> Column:
    """Position then roll, pitch, yaw."""
    return F.array(*pos, *rot.euler(q))


def make_action(pos, q, gripper: Column) -> Column:
    return F.array(*pos, *rot.euler(q), gripper)


def delta_action(action: Column, state: Column, wrap: bool = True) -> Column:
    """Action minus state in all but the last (gripper) dimension; rotation dims 3-5 wrapped."""
    d = F.zip_with(F.slice(action, 1, F.size(action) - 1), state, lambda a, s: a - s)
    if wrap:
        d = F.transform(d, lambda v, i: F.when(i.between(3, 5), rot.wrap(v)).otherwise(v))
    return F.concat(d, F.slice(action, -1, 1))


def undelta(action: Column, state: Column) -> Column:
    d = F.zip_with(F.slice(action, 1, F.size(action) - 1), state, lambda a, s: a + s)
    return F.concat(d, F.slice(action, -1, 1))


def zscore(v: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(v, mean, lambda a, m: a - m), std, lambda a, s: a / s)


def un_zscore(v: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(v, std, lambda a, s: a * s), mean, lambda a, m: a + m)


def pad_vector(v: Column, n: int) -> Column:
    """Zero-pad at the end; a longer vector is an error in the caller's data and stays as is."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(v), F.lit(0))))


def array_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, a: s + a * a))


def rounded(v: Column, digits: int = 6) -> Column:
    """Rounded components; zero has no sign."""
    return F.transform(v, lambda a: F.round(a, digits) + F.lit(0.0))


def allclose(a: Column, b: Column, atol: float = 1e-6, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
