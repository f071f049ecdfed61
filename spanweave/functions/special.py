"""Special functions on numpy arrays; nothing beyond numpy and math is needed."""

from __future__ import annotations

import math

import numpy as np

#: The first coefficients of Stirling's series for the logarithm of the gamma function.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def lgamma(x):
    """The logarithm of the gamma function for positive numbers: shifted up to 10 by products of
    the argument, then Stirling's series; other numbers by `math`."""
    x = np.asarray(x, float)
    if (x <= 0).any():
        return np.vectorize(math.lgamma, otypes=[float])(x)
    y, product = x.copy(), np.ones_like(x)
    while (low := y < 10).any():
        product = np.where(low, product * y, product)
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    series = sum(c * z**i for i, c in enumerate(_STIRLING)) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


erf = np.vectorize(math.erf, otypes=[float])


def digamma(x):
    """By the recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    x = x.copy()
    while (low := x < 6).any():
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x):
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    x = x.copy()
    while (low := x < 8).any():
        out = np.where(low, out + 1 / np.where(low, x, 1) ** 2, out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def log_factorial(n):
    return lgamma(np.asarray(n, float) + 1)


def log_choose(n, k):
    return log_factorial(n) - log_factorial(k) - log_factorial(np.asarray(n) - np.asarray(k))


def log_beta(a, b):
    return lgamma(a) + lgamma(b) - lgamma(np.asarray(a) + np.asarray(b))


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - float(log_beta(a, b))) / a
    c, d, out = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1)


def log_sum_exp(a: np.ndarray, axis: int = -1) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)
