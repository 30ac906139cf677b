"""Random numbers as expressions: the same seed and counters give the same number in any task and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(parts: tuple[Column | int | str, ...]) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _bits(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double")


def uniform(*parts: Column | int | str) -> Column:
    """From 0 to below 1."""
    return _bits(_hex(parts), 1) / F.lit(4294967296.0)


def normal(*parts: Column | int | str) -> Column:
    """Standard normal, by Box and Muller."""
    digest = _hex(parts)
    u1, u2 = (_bits(digest, 1) + 1.0) / F.lit(4294967297.0), _bits(digest, 9) / F.lit(4294967296.0)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)
