"""Detection levels, limits and intervals, without libraries beyond the standard one."""

from __future__ import annotations

import math


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(log_front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log_front) * h


def chi2_sf(x: float, dof: float) -> float:
    """Chance that chi squared is above x."""
    return gamma_q(dof / 2, x / 2)


def chi2_isf(p: float, dof: float) -> float:
    """Value that chi squared exceeds with chance p."""
    lo, hi = 0.0, max(10.0, dof)
    while chi2_sf(hi, dof) > p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_sf(mid, dof) > p else (lo, mid)
    return (lo + hi) / 2


def single_trial(p: float, trials: int) -> float:
    """Chance of one trial for a chance over all trials."""
    return -math.expm1(math.log1p(-p) / trials) if p < 1 else 1.0


def multi_trial(p: float, trials: int) -> float:
    """Chance over all trials for a chance of one."""
    return -math.expm1(trials * math.log1p(-p)) if p < 1 else 1.0


def z2_level(n: int, epsilon: float = 0.01, trials: int = 1, averaged: int = 1) -> float:
    """Level of Z squared with n harmonics at a chance over all trials; of the mean of several spectra."""
    return chi2_isf(single_trial(epsilon, trials), 2 * n * averaged) / averaged


def fold_level(nbin: int, epsilon: float = 0.01, trials: int = 1) -> float:
    """Level of the epoch-folding statistic."""
    return chi2_isf(single_trial(epsilon, trials), nbin - 1)


def power_level(epsilon: float = 0.01, trials: int = 1, averaged: int = 1, rebin: int = 1) -> float:
    """Level of a Leahy power that is a mean of averaged times rebin ones."""
    m = averaged * rebin
    return chi2_isf(single_trial(epsilon, trials), 2 * m) / m


def noncentral_sf(x: float, dof: int, nc: float) -> float:
    """Chance that a non-central chi squared is above x."""
    total, weight, j = 0.0, math.exp(-nc / 2), 0
    if weight == 0.0:
        mean, sd = dof + nc, math.sqrt(2 * (dof + 2 * nc))
        return 0.5 * math.erfc((x - mean) / sd / math.sqrt(2))
    seen = 0.0
    while seen < 1 - 1e-12 and j < 20_000:
        total += weight * chi2_sf(x, dof + 2 * j)
        seen += weight
        j += 1
        weight *= nc / 2 / j
    return total


def power_limits(power: float, n: int = 1, cl: float = 0.68) -> tuple[float, float]:
    """Limits of the signal power behind a measured one at a two-sided confidence."""

    def solve(p: float) -> float:
        lo, hi = 0.0, power * 4 + 100
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if noncentral_sf(power, 2 * n, mid) < p else (lo, mid)
        return (lo + hi) / 2

    return solve((1 - cl) / 2), solve(1 - (1 - cl) / 2)


def amplitude_of(signal: float, counts: float) -> float:
    """Amplitude of a sinusoid whose pulsed signal gives a Z squared above the noise: sqrt(2 signal / counts)."""
    return math.sqrt(max(0.0, 2 * signal / counts))


def pulsed_fraction_limit(stat: float, counts: float, n: int = 1, cl: float = 0.99) -> float:
    """Upper limit of the pulsed fraction for a statistic that isn't significant."""
    return amplitude_of(power_limits(stat, n, 2 * cl - 1)[1], counts)


def poisson_interval(n: float) -> tuple[float, float]:
    """Approximate one-sigma interval of a Poisson mean, by the cube-root form."""
    return (0.0 if n == 0 else n * (1 - 1 / (9 * n) - 1 / (3 * math.sqrt(n))) ** 3, (n + 1) * (1 - 1 / (9 * (n + 1)) + 1 / (3 * math.sqrt(n + 1))) ** 3)
