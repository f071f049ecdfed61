"""Emission schemes of mixtures and hidden Markov models, refitted from small statistics.

A scheme needs moments only (sums of weights, values and squares) or, where its likelihood has no
such summary, weights by distinct value.  Either is summed over all rows by Spark, so an M-step
sees numbers for each scheme, or for each value of a count, never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .distributions import NegativeBinomial as _Negative
from .special import lgamma


@dataclass(frozen=True)
class Poisson:
    rate: float
    by_value = False

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return x * math.log(max(self.rate, 1e-300)) - self.rate - lgamma(x + 1)

    def refit(self, w: np.ndarray, wx: np.ndarray, wxx: np.ndarray, value: np.ndarray) -> Poisson:
        return Poisson(float(wx.sum() / w.sum())) if w.sum() > 0 else self


@dataclass(frozen=True)
class Normal:
    mean: float
    variance: float
    by_value = False

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return -((x - self.mean) ** 2) / (2 * self.variance) - 0.5 * math.log(2 * math.pi * self.variance)

    def refit(self, w, wx, wxx, value) -> Normal:
        if not w.sum() > 0:
            return self
        mean = float(wx.sum() / w.sum())
        return Normal(mean, max(float(wxx.sum() / w.sum()) - mean * mean, 1e-6))


@dataclass(frozen=True)
class NegativeBinomial:
    """Counts of a mean and a number of failures, infinite for Poisson."""

    mean: float
    failures: float
    by_value = True

    def log_density(self, x: np.ndarray) -> np.ndarray:
        if self.mean == 0:
            return np.where(x == 0, 0.0, -np.inf)
        if math.isinf(self.failures):
            return Poisson(self.mean).log_density(x)
        r, p = self.failures, self.mean / (self.mean + self.failures)
        return lgamma(x + r) - lgamma(x + 1) - math.lgamma(r) + x * math.log(p) + r * math.log1p(-p)

    def refit(self, w, wx, wxx, value) -> NegativeBinomial:
        """Newton steps over the weighted values; kept as it is if they don't raise the likelihood."""
        if not w.sum() > 0:
            return self
        new = [NegativeBinomial(f.mean, f.failures) for f in (_Negative.fit(value, w),)] + [NegativeBinomial(float(wx.sum() / w.sum()), math.inf), self]
        return max(new, key=lambda f: _weighted(f, value, w))


def _weighted(scheme, value: np.ndarray, w: np.ndarray) -> float:
    held = w > 0
    got = float((w[held] * scheme.log_density(value[held])).sum())
    return got if not math.isnan(got) else -math.inf


#: Schemes by name, as model files have them.
SCHEMES = {"Poisson": Poisson, "Normal": Normal, "NegativeBinomial": NegativeBinomial}


@dataclass(frozen=True)
class Emissions:
    """Schemes of states by dimension: of[state][dimension] is the place of its scheme.  A scheme
    named twice is shared (constrained models); named once each, models are free."""

    schemes: tuple
    of: tuple[tuple[int, ...], ...]

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """(rows, states) of rows by dimensions; a value that is missing (NaN) says nothing."""
        out = np.zeros((len(x), len(self.of)))
        for d in range(x.shape[1]):
            there = ~np.isnan(x[:, d])
            u, back = np.unique(x[there, d], return_inverse=True)  # counts repeat, so few are computed
            each = {j: self.schemes[j].log_density(u)[back] for j in {s[d] for s in self.of}}
            for s, names in enumerate(self.of):
                out[there, s] += each[names[d]]
        return out

    def weigh(self, x: np.ndarray, g: np.ndarray, n: np.ndarray | None = None):
        """(scheme, value, w, wx, wxx) of rows x with memberships g, n times each: a row for each
        scheme, with a null value, or for each value of a scheme that needs them."""
        for j, scheme in enumerate(self.schemes):
            for d in range(x.shape[1]):
                states = [s for s, names in enumerate(self.of) if names[d] == j]
                there = ~np.isnan(x[:, d])
                if not states or not there.any():
                    continue
                w, v = g[there][:, states].sum(axis=1) * (1.0 if n is None else n[there]), x[there, d]
                if scheme.by_value:
                    u, back = np.unique(v, return_inverse=True)
                    sums = np.bincount(back, w)
                    yield from zip([j] * len(u), u.tolist(), sums.tolist(), (sums * u).tolist(), (sums * u * u).tolist())
                else:
                    yield j, None, float(w.sum()), float((w * v).sum()), float((w * v * v).sum())

    def refitted(self, rows: list[tuple]) -> Emissions:
        """The schemes after an M-step over summed rows of weigh()."""
        new = list(self.schemes)
        for j in {r[0] for r in rows}:
            own = [r[1:] for r in rows if r[0] == j]
            value, w, wx, wxx = (np.array([math.nan if r[i] is None else r[i] for r in own], float) for i in range(4))
            new[j] = self.schemes[j].refit(w, wx, wxx, value)
        return Emissions(tuple(new), self.of)
