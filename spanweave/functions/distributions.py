"""Discrete and continuous distributions: densities, moments, fits, seeded samples."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from . import special as sp

# ---- log densities ----------------------------------------------------------------------


def log_poisson(k, rate):
    with np.errstate(divide="ignore"):
        return np.asarray(k) * np.log(rate) - rate - sp.log_factorial(k)


def log_binomial(k, n, p):
    return sp.log_choose(n, k) + np.asarray(k) * math.log(p) + (np.asarray(n) - np.asarray(k)) * math.log1p(-p)


def log_negative_binomial(k, failures: float, p: float):
    """Of k successes before `failures` failures, with success probability p."""
    k = np.asarray(k, float)
    return sp.lgamma(k + failures) - sp.log_factorial(k) - math.lgamma(failures) + k * math.log(p) + failures * math.log1p(-p)


def log_beta_density(x, a, b):
    return (a - 1) * np.log(x) + (b - 1) * np.log1p(-np.asarray(x)) - sp.log_beta(a, b)


def log_dirichlet(x, a):
    a = np.asarray(a, float)
    return float(((a - 1) * np.log(x)).sum() + math.lgamma(a.sum()) - sp.lgamma(a).sum())


# ---- expectations and divergences -------------------------------------------------------


def mean_log_dirichlet(a) -> np.ndarray:
    a = np.asarray(a, float)
    return sp.digamma(a) - sp.digamma(a.sum())


def mean_log_beta(a: float, b: float) -> float:
    return float(sp.digamma(a) - sp.digamma(a + b))


def kl_dirichlet(a, b) -> float:
    """The divergence of a from b with means taken under b, negated terms first."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    m = mean_log_dirichlet(b)
    value = -math.lgamma(a.sum()) + math.lgamma(b.sum())
    return float(value - ((a - 1) * m - sp.lgamma(a)).sum() + ((b - 1) * m - sp.lgamma(b)).sum())


def kl_beta(a1: float, b1: float, a2: float, b2: float) -> float:
    s, f = mean_log_beta(a2, b2), mean_log_beta(b2, a2)
    one = (a1 - 1) * s + (b1 - 1) * f - float(sp.log_beta(a1, b1))
    two = (a2 - 1) * s + (b2 - 1) * f - float(sp.log_beta(a2, b2))
    return two - one


# ---- distributions ----------------------------------------------------------------------


@dataclass(frozen=True)
class Categorical:
    """Outcomes 1..n; samples are outcomes too."""

    probabilities: tuple[float, ...]

    @staticmethod
    def of(counts: dict[int, int]) -> Categorical:
        total = sum(counts.values())
        return Categorical(tuple(counts.get(i, 0) / total for i in range(1, max(counts) + 1)))

    def probability(self, x: int) -> float:
        return self.probabilities[x - 1] if 1 <= x <= len(self.probabilities) else 0.0

    def cumulative(self, x: int) -> float:
        return float(sum(self.probabilities[: max(0, x)]))

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        return rng.choice(len(self.probabilities), n, p=self.probabilities) + 1


@dataclass(frozen=True)
class NegativeBinomial:
    mean: float
    failures: float

    @property
    def p(self) -> float:
        return self.mean / (self.mean + self.failures)

    @property
    def variance(self) -> float:
        return self.mean + self.mean**2 / self.failures

    def log_probability(self, k):
        if self.mean == 0:
            return np.where(np.asarray(k) == 0, 0.0, -np.inf)
        return log_poisson(k, self.mean) if math.isinf(self.failures) else log_negative_binomial(k, self.failures, self.p)

    def cumulative(self, k: int) -> float:
        return 0.0 if k < 0 else 1.0 if self.mean == 0 else 1 - sp.beta_inc(k + 1, self.failures, self.p)

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        return rng.poisson(rng.gamma(self.failures, self.mean / self.failures, n))

    @staticmethod
    def from_moments(mean: float, variance: float) -> NegativeBinomial:
        """Poisson (infinite failures) if the variance isn't above the mean."""
        return NegativeBinomial(mean, mean * mean / (variance - mean) if variance > mean else math.inf)

    @staticmethod
    def fit(values, weights=None) -> NegativeBinomial:
        """Maximum likelihood; Newton steps for the number of failures, from the moments."""
        x = np.asarray(values, float)
        w = np.ones_like(x) if weights is None else np.asarray(weights, float)
        mean = float((w * x).sum() / w.sum())
        start = NegativeBinomial.from_moments(mean, float((w * (x - mean) ** 2).sum() / w.sum()))
        return NegativeBinomial(mean, start.failures if math.isinf(start.failures) else fit_failures(mean, x, w, start.failures))


def fit_failures(mean: float, values, weights, start: float) -> float:
    x, w = np.asarray(values, float), np.asarray(weights, float)
    r, total = start, w.sum()
    for _ in range(100):
        g = (w * sp.digamma(x + r)).sum() - total * (float(sp.digamma(r)) - math.log(r / (r + mean)))
        h = (w * sp.trigamma(x + r)).sum() - total * float(sp.trigamma(r)) + total * mean / (r * (r + mean))
        new = r - g / h if h else r
        new = new if new > 0 else r / 2
        if abs(new - r) < 1e-8 * r:
            return float(new)
        r = float(new)
    return r


def fit_gamma(mean: float, mean_log: float) -> tuple[float, float]:
    """(shape, rate) by Newton steps on the logarithm of the mean less the mean logarithm."""
    s = math.log(mean) - mean_log
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (math.log(k) - float(sp.digamma(k)) - s) / (1 / k - float(sp.trigamma(k)))
        k -= step
        if abs(step) < 1e-12 * k:
            break
    return k, k / mean


@dataclass(frozen=True)
class IntNormal:
    """The normal distribution over whole numbers: k has the mass of [k, k + 1)."""

    mean: float
    variance: float

    def _phi(self, x):
        return 0.5 * (1 + sp.erf((np.asarray(x, float) - self.mean) / math.sqrt(2 * self.variance)))

    def probability(self, k):
        return self._phi(np.asarray(k) + 1) - self._phi(k)

    def cumulative(self, k):
        return self._phi(np.asarray(k) + 1)

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        return np.floor(rng.normal(self.mean, math.sqrt(self.variance), n)).astype(int)


def sampler(seed: int) -> dict:
    """Named samplers over one seeded generator."""
    g = np.random.default_rng(seed)
    return {
        "beta": g.beta, "gamma": g.gamma, "geometric": g.geometric, "binomial": g.binomial, "poisson": g.poisson, "uniform": g.uniform, "dirichlet": g.dirichlet,
        "negative_binomial": lambda mean, failures, n=None: g.poisson(g.gamma(failures, mean / failures, n)), "bernoulli": lambda p, n=None: g.random(n) < p,
        "combination": lambda n, k: np.sort(g.choice(n, k, replace=False)),
    }
