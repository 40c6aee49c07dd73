"""Statistics of 2x2 tables, tiers and splits, as columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """With half a case added to each cell."""
    return ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))


def odds_ratio_lower(a: Column, b: Column, c: Column, d: Column, z: float = 1.96) -> Column:
    """Lower end of the odds ratio's confidence interval (Woolf)."""
    a, b, c, d = a + 0.5, b + 0.5, c + 0.5, d + 0.5
    return F.exp(F.log((a * d) / (b * c)) - z * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def g_statistic(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Likelihood ratio G of a 2x2 table; empty or impossible cells add nothing."""
    n = (a + b + c + d).cast("double")
    out = F.lit(0.0)
    for cell, row, col in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        expected = row * col / n
        out = out + F.when((cell > 0) & (expected > 0), 2.0 * cell * F.log(cell / expected)).otherwise(0.0)
    return F.when(n > 0, out).otherwise(0.0)


def pmi(co: Column, a: Column, b: Column, n: Column) -> Column:
    return F.when((n > 0) & (a > 0) & (b > 0), F.log2(co.cast("double") * n / (a.cast("double") * b))).otherwise(0.0)


@arrow_udf(T.DoubleType())
def chi2_tail(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """P(X > x) of chi-squared with one degree of freedom."""
    for column in columns:
        yield pa.array([None if x is None else math.erfc(math.sqrt(max(x, 0.0) / 2.0)) for x in column.to_pylist()], pa.float64())


@lru_cache(maxsize=200_000)
def _fisher(a: int, b: int, c: int, d: int) -> float:
    lg = math.lgamma
    row, col, n = a + b, a + c, a + b + c + d
    fixed = lg(row + 1) + lg(c + d + 1) + lg(col + 1) + lg(b + d + 1) - lg(n + 1)
    total, largest = 0.0, min(row, col)
    for x in range(a, largest + 1):
        term = math.exp(fixed - lg(x + 1) - lg(row - x + 1) - lg(col - x + 1) - lg(n - row - col + x + 1))
        total += term
        if x > row * col / n and term < total * 1e-17:
            break
    return min(1.0, total)


@arrow_udf(T.DoubleType())
def fisher_greater(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """One-sided exact p of a 2x2 table; null where a cell is negative or null."""
    for cells in columns:
        rows = zip(*(c.to_pylist() for c in cells), strict=True)
        yield pa.array([None if any(x is None or x < 0 for x in r) else _fisher(*r) for r in rows], pa.float64())


def tier_of_q(q: Column) -> Column:
    return F.when(q <= 0.01, "0.01").when(q <= 0.05, "0.05").when(q <= 0.10, "0.10")


def tier_of_p(p: Column, tests: Column) -> Column:
    """By the Bonferroni bound, which p must fall below."""
    return F.when(p < F.lit(0.01) / tests, "0.01").when(p < F.lit(0.05) / tests, "0.05").when(p < F.lit(0.10) / tests, "0.10")


def strictest(tiers: Column) -> Column:
    """The least of an array of tiers, which is the strictest; null of none."""
    return F.array_min(F.filter(tiers, lambda t: t.isNotNull() & (t != "")))


def mod_1000_of_md5(text: Column) -> Column:
    """The md5 of a text as a number, modulo 1000, from its four 32-bit words."""
    digest = F.md5(text)
    out = F.lit(0).cast("long")
    for i in range(4):
        # 2 to the 32nd is 296 modulo 1000
        out = F.pmod(out * 296 + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long"), F.lit(1000))
    return out


def split_of(key: Column, test_share: float = 0.2, seed: int = 42) -> Column:
    """test or train, by the key alone."""
    return F.when(mod_1000_of_md5(F.concat(F.lit(f"{seed}:"), key)) < int(test_share * 1000), "test").otherwise("train")


def draw(seed: int, *keys: Column) -> Column:
    """A draw in (0, 1) from 52 bits of an md5 of the keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def y_risk(support: Column, n: Column) -> Column:
    return F.round(F.log10(n / F.greatest(F.lit(1), support)), 6)
