"""Mixtures fitted by expectation maximisation; every step is one aggregate over the rows, or over
distinct values with their numbers, to which the rows are reduced once."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .emissions import Emissions, NegativeBinomial
from .special import log_sum_exp


def converged(before: float, now: float, threshold: float) -> bool:
    """Relative change below the threshold; a NaN is an error."""
    if math.isnan(now):
        raise ArithmeticError("log likelihood is not a number")
    return now == before or abs((now - before) / (now + before)) < threshold if before > -math.inf else False


@dataclass(frozen=True)
class Poisson:
    rate: float

    def log_density(self, x: Column) -> Column:
        """Up to a term of x alone, which no responsibility depends on."""
        return x * math.log(max(self.rate, 1e-300)) - self.rate

    @staticmethod
    def refit(s0: float, s1: float, s2: float) -> Poisson:
        return Poisson(s1 / s0 if s0 else 0.0)

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        return rng.poisson(self.rate, n)


@dataclass(frozen=True)
class Normal:
    mean: float
    variance: float

    def log_density(self, x: Column) -> Column:
        return -(x - self.mean) * (x - self.mean) / (2 * self.variance) - 0.5 * math.log(2 * math.pi * self.variance)

    @staticmethod
    def refit(s0: float, s1: float, s2: float) -> Normal:
        mean = s1 / s0 if s0 else 0.0
        return Normal(mean, max(s2 / s0 - mean * mean, 1e-6) if s0 else 1.0)

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        return rng.normal(self.mean, math.sqrt(self.variance), n)


@dataclass(frozen=True)
class Mixture:
    weights: tuple[float, ...]
    parts: tuple

    def _joint(self, x: Column) -> list[Column]:
        return [p.log_density(x) + math.log(max(w, 1e-300)) for w, p in zip(self.weights, self.parts)]

    def log_likelihoods(self, x: Column) -> Column:
        joint = self._joint(x)
        top = F.greatest(*joint)
        return top + F.log(sum((F.exp(j - top) for j in joint), F.lit(0.0)))

    def responsibilities(self, x: Column) -> list[Column]:
        whole = self.log_likelihoods(x)
        return [F.exp(j - whole) for j in self._joint(x)]

    def predict(self, x: Column) -> Column:
        """The likeliest part, the first of equal ones."""
        joint = self._joint(x)
        top, out = F.greatest(*joint), F.lit(len(joint) - 1)
        for i in range(len(joint) - 2, -1, -1):
            out = F.when(joint[i] == top, i).otherwise(out)
        return out

    def sample(self, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Parts and values of n draws."""
        part = rng.choice(len(self.weights), n, p=np.array(self.weights) / sum(self.weights))
        each = np.stack([p.sample(n, rng) for p in self.parts], axis=1) if n else np.empty((0, len(self.parts)))
        return part, each[np.arange(n), part]


def fit(df: DataFrame, column: str, start: Mixture, threshold: float = 1e-4, iterations: int = 30) -> tuple[Mixture, list[float]]:
    """The fitted mixture and the log likelihood before each step.  Rows are reduced to distinct
    values with their numbers once; only sums over these come to the driver."""
    model, trace = start, [-math.inf]
    x = F.col("x0")
    rows = histogram(df.where(F.col(column).isNotNull()), [column])
    for _ in range(iterations):
        r = rows.select(x.alias("x"), "n", model.log_likelihoods(x).alias("l"), *[c.alias(f"r{i}") for i, c in enumerate(model.responsibilities(x))])
        sums = [F.sum(F.col("l") * F.col("n")), F.sum("n")] + [F.sum(F.col(f"r{i}") * F.col("n") * f) for i in range(len(model.parts)) for f in (F.lit(1.0), F.col("x"), F.col("x") * F.col("x"))]
        ll, n, *s = r.agg(*sums).first()
        if not n:
            raise ValueError("no rows to fit")
        trace.append(ll)
        if converged(trace[-2], ll, threshold):
            break
        groups = [s[3 * i : 3 * i + 3] for i in range(len(model.parts))]
        model = Mixture(tuple(g[0] / n for g in groups), tuple(type(p).refit(*g) for p, g in zip(model.parts, groups)))
    return model, trace[1:]


# ---- over values of several dimensions --------------------------------------------------


@dataclass(frozen=True)
class Blend:
    """A mixture of parts with emission schemes by dimension, free or shared among parts."""

    weights: tuple[float, ...]
    emissions: Emissions

    def _joint(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return self.emissions.log_densities(x) + np.log(self.weights)

    def memberships(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood, memberships of the parts) of rows of values."""
        joint = self._joint(x)
        ll = log_sum_exp(joint, axis=1)
        return ll, np.exp(joint - ll[:, None])

    def predict(self, *columns: Column | str) -> Column:
        """The likeliest part, the first of equal ones."""

        @F.pandas_udf("int")
        def part(values: pd.DataFrame) -> pd.Series:
            return pd.Series(self._joint(values.to_numpy(float)).argmax(axis=1).astype("int32"))

        return part(F.struct(*[F.col(c).cast("double").alias(f"x{i}") if isinstance(c, str) else c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)]))


def histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x0, x1, ..., n): distinct rows of values with their numbers, staged.  Equal values are added
    up before the shuffle, so a value that most rows have is one row for each task."""
    return staged(df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).groupBy(*[f"x{i}" for i in range(len(columns))]).agg(F.count("*").alias("n")), "values")


def fit_values(df: DataFrame, columns: list[str], start: Blend, threshold: float = 1e-6, iterations: int = 50) -> tuple[Blend, list[float]]:
    """The fitted blend and the log likelihood before each step.

    Rows are reduced to a histogram of distinct values once; a step is a pass over that.  The
    driver sees sums for each scheme, and for each value where a scheme's likelihood needs them.
    Rows without any value count for the weights of parts only.
    """
    held, model, trace, k = histogram(df, columns), start, [-math.inf], len(start.weights)
    kinds = [("kind", pa.int32()), ("i", pa.int32()), ("v", pa.float64()), ("w", pa.float64()), ("wx", pa.float64()), ("wxx", pa.float64())]
    for _ in range(iterations):

        def expect(parts, model=model):
            for b in parts:
                if not b.num_rows:
                    continue
                *xs, n = (c.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False) for c in b.columns)
                x = np.stack(xs, axis=1)
                ll, r = model.memberships(x)
                rows = [(0, 0, None, float((ll * n).sum()), 0.0, 0.0)] + [(1, i, None, float(w), 0.0, 0.0) for i, w in enumerate((r * n[:, None]).sum(axis=0))]
                rows += [(2, *row) for row in model.emissions.weigh(x, r, n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [name for name, _ in kinds])

        sums = held.mapInArrow(expect, "kind int, i int, v double, w double, wx double, wxx double").groupBy("kind", "i", "v").agg(*[F.sum(c).alias(c) for c in ("w", "wx", "wxx")]).collect()
        if not sums:
            raise ValueError("no rows to fit")
        trace.append(sum(r["w"] for r in sums if r["kind"] == 0))
        if converged(trace[-2], trace[-1], threshold):
            break
        part = {r["i"]: r["w"] for r in sums if r["kind"] == 1}
        total = sum(part.values())
        model = Blend(tuple(part[i] / total for i in range(k)), model.emissions.refitted([tuple(r)[1:] for r in sums if r["kind"] == 2]))
    return model, trace[1:]


@dataclass(frozen=True)
class BlendFitter:
    """Guesses and fits blends of counts: parts from few to many, with negative binomial schemes that
    all columns share, or each column its own."""

    parts: int = 2
    shared: bool = False

    def guess(self, df: DataFrame, columns: list[str], attempt: int = 0) -> Blend:
        """Parts whose means are spread around the columns' means, wider with each attempt; one
        aggregate over the rows."""
        sums = df.agg(*[f(c).cast("double") for c in columns for f in (F.avg, F.var_samp)]).first()
        if sums is None or any(sums[2 * i] is None for i in range(len(columns))):
            raise ValueError("no rows to guess from")
        moments = [(max(sums[2 * i], 1e-3), max(sums[2 * i + 1] or 0.0, 1e-3)) for i in range(len(columns))]
        if self.shared:
            moments = [tuple(sum(m[k] for m in moments) / len(moments) for k in (0, 1))]
        spread = [((i + 1) / (self.parts + 1) * 2) ** (1 + attempt) for i in range(self.parts)]
        schemes = tuple(NegativeBinomial(m * w, m * m / (v - m) if v > m else 100.0) for w in spread for m, v in moments)
        of = tuple(tuple(i * len(moments) + (0 if self.shared else d) for d in range(len(columns))) for i in range(self.parts))
        return Blend((1 / self.parts,) * self.parts, Emissions(schemes, of))

    def fit(self, df: DataFrame, columns: list[str], attempts: int = 1, threshold: float = 1e-6, iterations: int = 50) -> tuple[Blend, list[float]]:
        """The fit with the greatest likelihood of several guesses, the first of equal ones."""
        fits = [fit_values(df, columns, self.guess(df, columns, k), threshold, iterations) for k in range(attempts)]
        return max(fits, key=lambda f: f[1][-1])
