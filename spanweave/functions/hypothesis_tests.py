"""Hypothesis tests and multiple-testing control, over frames of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefix import prefix, ranges
from . import special as sp


def log_add_exp(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_abs_diff_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(-F.exp(-F.abs(a - b)))


@F.pandas_udf(T.DoubleType())
def log_factorial(n: pd.Series) -> pd.Series:
    return pd.Series(sp.log_factorial(n.to_numpy()))


@F.pandas_udf(T.DoubleType())
def log_choose(n: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(sp.log_choose(n.to_numpy(), k.to_numpy()))


def _tiles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _up(value: str, tie: str) -> list[Column]:
    return [F.col(value).asc_nulls_last(), F.col(tie).asc_nulls_last()]


def _down(value: str, tie: str) -> list[Column]:
    return [F.col(value).desc_nulls_first(), F.col(tie).desc_nulls_first()]


def _one(df: DataFrame, *aggregates: Column) -> DataFrame:
    """df with the columns of a one-row aggregate."""
    return df.crossJoin(df.agg(*aggregates))  # the right side is a single row


def benjamini_hochberg(df: DataFrame, p: str = "p", tie: str = "id", out: str = "q", logs: bool = False) -> DataFrame:
    """Add adjusted p-values: over ranks from the largest down the running minimum of p * m / rank,
    at most 1.  With logs, p and the result are logarithms."""
    rows = ranges(df, up := _up(p, tie), _tiles(df), "__tile")
    rows = prefix(rows, [], "__tile", up, F.lit(1).cast("long"), "__rank", "sum", inclusive=True)
    rows = _one(rows, F.count("*").alias("__m"))
    value = F.least(F.lit(0.0), F.col(p) + F.log("__m") - F.log("__rank")) if logs else F.least(F.lit(1.0), F.col(p) * F.col("__m") / F.col("__rank"))
    rows = prefix(rows.withColumn("__v", value), [], "__tile", _down(p, tie), F.col("__v"), out, "min", inclusive=True, reverse=True)
    return rows.drop("__tile", "__rank", "__m", "__v")


def _running(df: DataFrame, log_pep: str, tie: str) -> DataFrame:
    rows = ranges(df, order := _up(log_pep, tie), _tiles(df), "__tile")
    rows = prefix(rows, [], "__tile", order, F.exp(log_pep), "__sum", "sum", inclusive=True)
    rows = prefix(rows, [], "__tile", order, F.lit(1).cast("long"), "__rank", "sum", inclusive=True)
    return rows.withColumn("__mean", F.col("__sum") / F.col("__rank"))


def fdr_control(df: DataFrame, log_pep: str = "logpep", alpha: float = 0.05, tie: str = "id") -> DataFrame:
    """Add `rejected`: the smallest error probabilities while their running mean is at most alpha;
    the very last hypothesis is never rejected."""
    rows = _one(_running(df, log_pep, tie), F.count("*").alias("__m"))
    return rows.withColumn("rejected", (F.col("__mean") <= alpha) & (F.col("__rank") < F.col("__m"))).drop("__tile", "__sum", "__rank", "__mean", "__m")


def pep_qvalues(df: DataFrame, log_pep: str = "logpep", tie: str = "id", out: str = "q", logs: bool = False) -> DataFrame:
    """Add q-values: running means of sorted error probabilities, then the running minimum from
    the largest down."""
    rows = _running(df, log_pep, tie)
    rows = prefix(rows, [], "__tile", _down(log_pep, tie), F.col("__mean"), out, "min", inclusive=True, reverse=True)
    rows = rows.drop("__tile", "__sum", "__rank", "__mean")
    return rows.withColumn(out, F.log(out)) if logs else rows


def null_probability(log_memberships: list[Column]) -> Column:
    """The log of the sum of null states' memberships."""
    out = log_memberships[0]
    for c in log_memberships[1:]:
        out = log_add_exp(out, c)
    return out


def _log_pmf(x, k, n, total):
    """Of x marked ones among n drawn out of `total` with k marked, in logarithms."""
    return sp.log_choose(k, x) + sp.log_choose(total - k, n - x) - sp.log_choose(total, n)


def _tail(x, k, n, total, step: int) -> np.ndarray:
    """The mass from x on away from the mode, by the ratio of neighbouring terms, until a term no
    longer counts.  All tables of a batch go on together; a handful of numbers for each is held."""
    low, high = np.maximum(0, n - (total - k)), np.minimum(n, k)
    out = np.zeros(len(x))
    live = np.flatnonzero((x >= low) & (x <= high))
    x, k, n, rest = (v[live].astype(float) for v in (x, k, n, total - k - n))
    term = np.exp(_log_pmf(x, k, n, k + n + rest))
    summed = term.copy()
    while len(live):
        ratio = x * (rest + x) / ((k - x + 1) * (n - x + 1)) if step < 0 else (k - x) * (n - x) / ((x + 1) * (rest + x + 1))
        x, term = x + step, term * ratio
        summed += term
        go = term > summed * 1e-18
        if not go.all():
            out[live[~go]] = summed[~go]
            live, x, k, n, rest, term, summed = (v[go] for v in (live, x, k, n, rest, term, summed))
    return out


def fisher_p(a, b, c, d, alternative: str = "less") -> np.ndarray:
    """P-values of 2 x 2 tables given as arrays; totals may be of any size.

    Tails are summed from the observed table away from the mode, or taken from their complement;
    the other tail of a two-sided test begins where the mass falls to the observed one's (up to a
    relative 1e-7), found by halving.
    """
    a, b, c, d = (np.asarray(v, np.int64) for v in (a, b, c, d))
    total, k, n = a + b + c + d, a + b, a + c
    low, high = np.maximum(0, n - (total - k)), np.minimum(n, k)
    mode = np.clip(((n + 1.0) * (k + 1.0) / (total + 2.0)).astype(np.int64), low, high)

    def lower(x):
        below = x <= mode
        return np.where(below, _tail(np.where(below, x, low - 1), k, n, total, -1), 1 - _tail(np.where(below, high + 1, x + 1), k, n, total, 1))

    def upper(x):
        above = x >= mode
        return np.where(above, _tail(np.where(above, x, high + 1), k, n, total, 1), 1 - _tail(np.where(above, low - 1, x - 1), k, n, total, -1))

    if alternative != "two_sided":
        return np.clip((lower if alternative == "less" else upper)(a), 0, 1)
    most = _log_pmf(a, k, n, total) + np.log1p(1e-7)

    def edge(inside, outside):
        """The place nearest to the mode with at most the observed mass, from the mode outwards."""
        near, far = inside.copy(), outside.copy()
        while (open_ := np.abs(far - near) > 1).any():
            mid = np.where(open_, (near + far) // 2, far)
            small = _log_pmf(np.clip(mid, low, high), k, n, total) <= most
            near, far = np.where(open_ & ~small, mid, near), np.where(open_ & small, mid, far)
        return far

    whole = _log_pmf(mode, k, n, total) <= most
    left, right = edge(mode, low - 1), edge(mode, high + 1)
    both = _tail(left, k, n, total, -1) + _tail(right, k, n, total, 1)
    return np.where(whole, 1.0, np.clip(both, 0, 1))


def fisher(alternative: str = "less"):
    """The p-value of 2 x 2 tables (a, b, c, d): "less", "two_sided" or "greater"; null if any is."""
    if alternative not in ("less", "two_sided", "greater"):
        raise ValueError(alternative)

    @F.pandas_udf(T.DoubleType())
    def p_value(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        there = ~(a.isna() | b.isna() | c.isna() | d.isna())
        out = pd.Series(np.nan, index=a.index)
        out[there] = fisher_p(*(x[there].to_numpy(np.int64) for x in (a, b, c, d)), alternative)
        return out.where(there, None)

    return p_value
