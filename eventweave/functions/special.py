"""Special functions as Column expressions, so that they stay in generated code."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8
# Coefficients of the asymptotic series of digamma and of the log-gamma function.
DIGAMMA_SERIES = ((2, -1 / 12), (4, 1 / 120), (6, -1 / 252), (8, 1 / 240), (10, -1 / 132))
LGAMMA_SERIES = ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680))


def digamma(x: Column) -> Column:
    """psi(x) for x > 0: the recurrence up to x + 8, then the asymptotic series."""
    y = x + SHIFT
    out = F.log(y) - 0.5 / y
    for power, c in DIGAMMA_SERIES:
        out = out + c / F.pow(y, power)
    for i in range(SHIFT):
        out = out - 1.0 / (x + i)
    return out


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0, by Stirling's series at x + 8."""
    y = x + SHIFT
    out = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi)
    for power, c in LGAMMA_SERIES:
        out = out + c / F.pow(y, power)
    product = x
    for i in range(1, SHIFT):
        product = product * (x + i)
    return out - F.log(product)


def digamma_of(x: float) -> float:
    """psi(x) of a number on the driver."""
    y = x + SHIFT
    return math.log(y) - 0.5 / y + sum(c / y**p for p, c in DIGAMMA_SERIES) - sum(1 / (x + i) for i in range(SHIFT))


def gamma_kl(alpha_1: Column, beta_1: Column, alpha_2: Column, beta_2: Column) -> Column:
    """KL divergence of Gamma(alpha_1, beta_1) from Gamma(alpha_2, beta_2), rates beta."""
    return alpha_2 * F.log(beta_1 / beta_2) - lgamma(alpha_1) + lgamma(alpha_2) + (alpha_1 - alpha_2) * digamma(alpha_1) - (beta_1 - beta_2) * alpha_1 / beta_1


def gamma_kl_of(x: tuple[float, float], y: tuple[float, float]) -> float:
    """The same of numbers, (alpha, beta) each."""
    (a, b), (c, d) = x, y
    return c * math.log(b / d) - math.lgamma(a) + math.lgamma(c) + (a - c) * digamma_of(a) - (b - d) * a / b


def js_term(p: Column, q: Column) -> Column:
    """A group's part of twice the Jensen-Shannon divergence, with the guards for zeros: a zero
    share counts as 1e-10 in the other's term, and its own term, like any that comes to 0, as 1e-300."""
    a, b = (F.when(x == 0, 1e-10).otherwise(x) for x in (p, q))
    guard = lambda x, own: F.when((own == 0) | (x == 0), 1e-300).otherwise(x)
    return guard(a * F.log(2 * a / (a + b)), p) + guard(b * F.log(2 * b / (a + b)), q)


def gamma_mass(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(shape, x), the regularised lower incomplete gamma function, by its series of positive terms."""
    scale = np.exp(shape * np.log(x) - x - np.array([math.lgamma(a) for a in shape]))
    term = 1 / shape
    total, n = term.copy(), 0
    while (term > 1e-17 * total).any():
        n += 1
        term = term * x / (shape + n)
        total += term
    return total * scale


def gamma_quantile(shape: np.ndarray, p: float) -> np.ndarray:
    """Quantiles of Gamma(shape, 1), NaN where shape isn't above 0: Newton steps, kept inside brackets, on all rows at once."""
    shape = np.asarray(shape, float)
    out, fine = np.full(shape.shape, np.nan), np.isfinite(shape) & (shape > 0)
    if not 0 < p < 1 or not fine.any():
        return out
    a = shape[fine]
    lo, hi, norm = np.zeros(len(a)), a + 40 * np.sqrt(a) + 60, np.array([math.lgamma(v) for v in a])
    x = np.where(a > 0.2, np.maximum(a * (1 - 1 / (9 * a)) ** 3, 1e-3), p ** (1 / a))
    x = np.clip(x, 1e-300, hi)
    for _ in range(200):
        f = gamma_mass(a, x) - p
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            new = x - f / np.exp((a - 1) * np.log(x) - x - norm)
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        done = np.abs(new - x) <= 1e-13 * np.maximum(new, 1e-300)
        x = np.maximum(new, 1e-300)
        if done.all():
            break
    out[fine] = x
    return out
