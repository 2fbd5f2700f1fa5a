"""Rank tests and paired resampling on small matrices (methods by datasets), with numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def ranks(values: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    order = np.argsort(values, kind="stable")
    out = np.empty(len(values))
    i = 0
    while i < len(values):
        j = i
        while j + 1 < len(values) and values[order[j + 1]] == values[order[i]]:
            j += 1
        out[order[i : j + 1]] = (i + j) / 2 + 1
        i = j + 1
    return out


def competition_ranks(scores: np.ndarray) -> np.ndarray:
    """1, 2, 2, 4 with the best score first; scores equal to 10 decimals tie, as in ``evaluate.method_ranks``."""
    rounded = np.round(np.asarray(scores, float), 10)
    return 1 + (rounded[None, :] > rounded[:, None]).sum(axis=1)


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) of a chi-squared variable: upper incomplete gamma by series or continued fraction."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])


def studentized_range_tail(q: float, k: int) -> float:
    """P(Q > q) of the range of k normal variables over a known deviation, by quadrature."""
    if q <= 0:
        return 1.0
    z = np.linspace(-9, 9, 6001)
    density = np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi)
    inner = (_normal_cdf(z) - _normal_cdf(z - q)) ** (k - 1)
    return float(min(1.0, max(0.0, 1 - k * np.trapezoid(density * inner, z))))


def studentized_range_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - studentized_range_tail(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


@dataclass(frozen=True)
class Wilcoxon:
    statistic: float
    p_value: float
    median_difference: float


def wilcoxon(a: np.ndarray, b: np.ndarray) -> Wilcoxon:
    """Two-sided signed-rank test, zero differences dropped; exact without ties up to 50 pairs.

    All differences zero (or no pair) gives statistic 0 and p 1.
    """
    d = np.asarray(a, float) - np.asarray(b, float)
    middle = float(np.median(d)) if len(d) else 0.0
    zeros = bool((d == 0).any())
    d = d[d != 0]
    n = len(d)
    if n == 0:
        return Wilcoxon(0.0, 1.0, middle)
    r = ranks(np.abs(d))
    plus = float(r[d > 0].sum())
    w = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and not zeros and len(set(np.abs(d))) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for i in range(1, n + 1):
            ways[i:] = ways[i:] + ways[:-i].copy()
        return Wilcoxon(w, float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n)), middle)
    _, ties = np.unique(np.abs(d), return_counts=True)
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - (ties**3 - ties).sum() / 2) / 24)
    z = (w - n * (n + 1) / 4) / spread
    return Wilcoxon(w, float(min(1.0, math.erfc(abs(z) / math.sqrt(2)))), middle)


def friedman(matrix: np.ndarray) -> tuple[float, float]:
    """Statistic (corrected for ties) and p-value of a matrix with a row per dataset and a column per method."""
    n, k = matrix.shape
    rows = np.array([ranks(row) for row in matrix])
    ties = sum(float((c**3 - c).sum()) for c in (np.unique(row, return_counts=True)[1] for row in matrix))
    correction = 1 - ties / (n * k * (k * k - 1))
    statistic = 12 / (n * k * (k + 1)) * float((rows.sum(axis=0) ** 2).sum()) - 3 * n * (k + 1)
    if correction == 0:
        return 0.0, 1.0
    return statistic / correction, chi2_tail(statistic / correction, k - 1)


@dataclass(frozen=True)
class Nemenyi:
    """``cd`` is the published critical difference, ``cd_textbook`` the one with the range over the square root of 2."""

    p_values: np.ndarray
    cd: float
    cd_textbook: float


def nemenyi(matrix: np.ndarray, alpha: float = 0.05) -> Nemenyi:
    n, k = matrix.shape
    mean = np.array([ranks(row) for row in matrix]).mean(axis=0)
    unit = math.sqrt(k * (k + 1) / (6 * n))
    gaps = np.abs(mean[:, None] - mean[None, :]) / unit * math.sqrt(2)
    p = np.array([[1.0 if i == j else studentized_range_tail(gaps[i, j], k) for j in range(k)] for i in range(k)])
    q = studentized_range_quantile(1 - alpha, k)
    return Nemenyi(p, q * unit, q / math.sqrt(2) * unit)


def paired_bootstrap_ci(a: np.ndarray, b: np.ndarray, alpha: float = 0.05, n_iter: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of the mean difference of resampled pairs."""
    d = np.asarray(a, float) - np.asarray(b, float)
    rng = np.random.default_rng(seed)
    means = np.array([d[rng.integers(0, len(d), len(d))].mean() for _ in range(n_iter)])
    lo, hi = np.quantile(means, [alpha / 2, 1 - alpha / 2])
    return float(lo), float(hi)


def fisher_pitman(a: np.ndarray, b: np.ndarray, n_iter: int = 10_000, seed: int = 42) -> float:
    """Two-sided permutation p-value of the mean difference: all sign flips up to 16 pairs, else sampled."""
    d = np.asarray(a, float) - np.asarray(b, float)
    n = len(d)
    seen = abs(d.sum())
    if n <= 16:
        signs = 1 - 2 * ((np.arange(2**n)[:, None] >> np.arange(n)) & 1)
        return float((np.abs(signs @ d) >= seen - 1e-12).mean())
    rng = np.random.default_rng(seed)
    signs = rng.choice([-1, 1], (n_iter, n))
    return float(((np.abs(signs @ d) >= seen - 1e-12).sum() + 1) / (n_iter + 1))


def choose_tests(scores: np.ndarray) -> dict[str, object]:
    """Two methods: signed ranks; else Friedman, and Nemenyi in any case."""
    if scores.shape[1] == 2:
        return {"wilcoxon": wilcoxon(scores[:, 0], scores[:, 1])}
    placed = np.array([competition_ranks(row) for row in scores])
    return {"friedman": friedman(placed), "nemenyi": nemenyi(placed)}
