"""Small column helpers shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (in either case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_key(*parts: Column | str) -> Column:
    """md5 of the parts' texts, null as 'null': the same in any engine."""
    return F.md5(F.concat_ws("|", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts)))


def leading_bits(key: Column, digits: int) -> Column:
    """The first hex digits of a key as a number."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series after a shift by 8."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    stirling = (z - 0.5) * F.ln(z) - z + 0.5 * F.ln(2 * F.pi()) + series
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.ln(x + i)
    return stirling - shift
