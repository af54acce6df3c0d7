"""Numerical kernels on NumPy arrays, used inside Arrow functions."""

from __future__ import annotations

import math

import numpy as np


def als_baseline(y: np.ndarray, lam: float = 1e5, p: float = 0.01, rounds: int = 10) -> np.ndarray:
    """Baseline that minimises weighted squared residuals plus the squared second differences, with asymmetric weights.

    The system has five diagonals and is solved by their LDL' factors, in time in proportion to the length.
    """
    n = len(y)
    if n < 3:
        return y.astype(float).copy()
    main = np.full(n, 6.0)
    main[[0, -1]] = 1.0
    if n > 3:
        main[[1, -2]] = 5.0
    else:
        main[1] = 4.0
    off1 = np.full(n - 1, -4.0)
    off1[[0, -1]] = -2.0
    off2 = np.ones(n - 2)
    w = np.ones(n)
    z = y.astype(float)
    for _ in range(rounds):
        z = _solve_penta(w + lam * main, lam * off1, lam * off2, w * y)
        new = np.where(y > z, p, 1 - p)
        if np.array_equal(new, w):
            break
        w = new
    return z


def _solve_penta(d: np.ndarray, e: np.ndarray, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a symmetric positive system of five diagonals: main d, first e, second f."""
    n = len(d)
    diag, l1, l2 = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        s = d[i]
        if i >= 1:
            s -= l1[i - 1] ** 2 * diag[i - 1]
        if i >= 2:
            s -= l2[i - 2] ** 2 * diag[i - 2]
        diag[i] = s
        if i < n - 1:
            l1[i] = (e[i] - (l2[i - 1] * l1[i - 1] * diag[i - 1] if i >= 1 else 0.0)) / s
        if i < n - 2:
            l2[i] = f[i] / s
    x = b.astype(float).copy()
    for i in range(n):
        if i >= 1:
            x[i] -= l1[i - 1] * x[i - 1]
        if i >= 2:
            x[i] -= l2[i - 2] * x[i - 2]
    x /= diag
    for i in range(n - 2, -1, -1):
        x[i] -= l1[i] * x[i + 1] + (l2[i] * x[i + 2] if i < n - 2 else 0.0)
    return x


def z2_of_profiles(profiles: np.ndarray, n: int) -> np.ndarray:
    """Z squared with n harmonics of each row."""
    nbin = profiles.shape[-1]
    f = np.fft.rfft(profiles, axis=-1)[..., 1 : n + 1]
    total = profiles.sum(axis=-1)
    return np.divide(2 * (np.abs(f) ** 2).sum(axis=-1), total, out=np.zeros(total.shape), where=total > 0) if nbin > 1 else np.zeros(total.shape)


def fast_fold(x: np.ndarray, base: int, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """All foldings of a series at trial periods from ``base`` to base + 1 bins: periods in bins and Z squared.

    The rows of the table (one for each period) are padded to a power of two; halves are folded recursively: trial r of a
    table is the sum of trial r // 2 of its upper half and that of its lower half, shifted by the rounded half of r.
    """
    rows = 2 ** max(1, math.ceil(math.log2(max(1, math.ceil(len(x) / base)))))
    table = np.zeros(rows * base)
    table[: len(x)] = x
    folded = _halves(table.reshape(rows, base))
    return base + np.arange(rows) / (rows - 1), z2_of_profiles(folded, n)


def _halves(table: np.ndarray) -> np.ndarray:
    m, base = table.shape
    if m == 1:
        return table
    top, bottom = _halves(table[: m // 2]), _halves(table[m // 2 :])
    r = np.arange(m)
    columns = (np.arange(base)[None, :] + ((r + 1) // 2)[:, None]) % base
    return top[r // 2] + np.take_along_axis(bottom[r // 2], columns, axis=1)


def fit_template(profile: np.ndarray, template: np.ndarray) -> tuple[float, float, float, float]:
    """Phase, its error, amplitude and base of a profile as base + amp * template shifted in phase.

    The phase of the largest cross-correlation is refined by a parabola; amplitude and base follow by least squares.
    """
    n = len(profile)
    t = template - template.mean()
    cc = np.fft.irfft(np.fft.rfft(profile) * np.conj(np.fft.rfft(t)), n)
    k = int(np.argmax(cc))
    a, b, c = cc[k - 1], cc[k], cc[(k + 1) % n]
    curve = a - 2 * b + c
    ph = ((k + (0.5 * (a - c) / curve if curve < 0 else 0.0)) / n) % 1.0
    moved = np.interp((np.arange(n) / n - ph) % 1.0, np.arange(n + 1) / n, np.r_[t, t[0]])
    norm = float((moved**2).sum())
    amp = float((profile * moved).sum() / norm) if norm > 0 else 0.0
    noise = math.sqrt(max(float(np.mean(profile)), 1e-12))
    slope = math.sqrt(float((np.gradient(moved) ** 2).sum())) * n
    err = noise / (abs(amp) * slope) if amp and slope else 0.5
    return ph, min(err, 0.5), amp, float(profile.mean())


def accelerate(x: np.ndarray, zmax: int, n_best: int, dz: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best (frequency bin, drift in bins, power) of a series: its transform correlated with those of signals that drift by every ``dz`` bins."""
    n = len(x)
    spectrum = np.fft.rfft(x - x.mean()) / math.sqrt(max(x.sum(), 1.0) / 2)
    found = []
    half = 2 * zmax + 16
    u = (np.arange(4 * half) + 0.5) / (4 * half)
    for z in range(-zmax, zmax + 1, dz):
        chirp = np.exp(1j * np.pi * z * (u * u - u))
        k = np.arange(-half // 2, half // 2)
        response = (chirp[None, :] * np.exp(-2j * np.pi * k[:, None] * u[None, :])).mean(axis=1)
        full = np.convolve(spectrum, np.conj(response[::-1]))[half // 2 - 1 : half // 2 - 1 + len(spectrum)]
        power = np.abs(full) ** 2
        power[:1] = 0
        top = np.argsort(-power)[:n_best]
        found += [(int(i), float(z), float(power[i])) for i in top]
    found.sort(key=lambda r: (-r[2], r[0], r[1]))
    best = found[:n_best]
    return tuple(np.array(c) for c in zip(*best)) if best else (np.array([]),) * 3


def savitzky_golay(y: np.ndarray, window: int, order: int, wrap: bool = True) -> np.ndarray:
    """Smoothing by a polynomial fitted to each window."""
    h = window // 2
    a = np.vander(np.arange(-h, h + 1), order + 1, increasing=True)
    c = np.linalg.pinv(a)[0]
    pad = np.r_[y[-h:], y, y[:h]] if wrap else np.pad(y, h, mode="edge")
    return np.convolve(pad, c[::-1], mode="valid")


def gaussian_smooth(y: np.ndarray, sigma: float, wrap: bool = True) -> np.ndarray:
    """Gaussian smoothing, cut at four sigma."""
    h = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-h, h + 1) / sigma) ** 2)
    k /= k.sum()
    pad = np.pad(y, h, mode="wrap" if wrap else "edge")
    return np.convolve(pad, k, mode="valid")


def fit_spectrum(freq: np.ndarray, power: np.ndarray, m: np.ndarray, kind: str = "powerlaw") -> tuple[np.ndarray, float]:
    """Maximum-likelihood fit of a mean of m exponentials: parameters and the log likelihood.

    Models: 'constant' (c), 'powerlaw' (norm, index, c), 'lorentzian' (norm, centre, width, c).  Parameters that have to be
    positive are fitted by their logarithms, by Newton steps on the expected information with a damping that adapts.
    """

    def model(q):
        if kind == "constant":
            return np.exp(q[0]) + 0 * freq
        if kind == "powerlaw":
            return np.exp(q[0]) * (freq / freq.mean()) ** -q[1] + np.exp(q[2])
        return np.exp(q[0]) * np.exp(q[2]) ** 2 / ((freq - q[1]) ** 2 + np.exp(q[2]) ** 2) + np.exp(q[3])

    def loglike(q):
        x = model(q)
        return -float((m * (np.log(x) + power / x)).sum())

    high = max(float(np.quantile(power, 0.05)), 1e-12)
    k = int(np.argmax(power))
    top = max(float(power[k]) - high, high * 0.1)
    q = np.array({"constant": [math.log(high)], "powerlaw": [math.log(max(float(np.median(power)) - high, high * 0.1)), 1.0, math.log(high / 2)], "lorentzian": [math.log(top), freq[k], math.log((freq[-1] - freq[0]) / 20), math.log(high)]}[kind], float)
    positive = np.isin(np.arange(len(q)), {"constant": [0], "powerlaw": [0, 2], "lorentzian": [0, 2, 3]}[kind])
    lam, best = 1e-2, loglike(q)
    for _ in range(300):
        x = model(q)
        step = np.maximum(np.abs(q), 1e-3) * 1e-6
        jac = np.stack([(model(q + np.eye(len(q))[i] * step[i]) - model(q - np.eye(len(q))[i] * step[i])) / (2 * step[i]) for i in range(len(q))], 1)
        grad = jac.T @ (m * (power - x) / x**2)
        info = jac.T @ (jac * (m / x**2)[:, None])
        d = np.linalg.solve(info + lam * np.diag(np.diag(info) + 1e-12), grad)
        # Logarithms move by half at most: a long first step can leave a component at nothing, where its slope vanishes.
        d = np.where(positive, np.clip(d, -0.5, 0.5), d)
        new = loglike(q + d)
        if np.isfinite(new) and new > best:
            small = new - best < 1e-10 * max(1.0, abs(best))
            q, best, lam = q + d, new, lam / 4
            if small:
                break
        else:
            lam *= 5
            if lam > 1e14:
                break
    return np.where(positive, np.exp(np.where(positive, q, 0.0)), q), best


def mixture_shares(weights: np.ndarray, counts: np.ndarray, rounds: int = 2000, least: float = 1e-12) -> np.ndarray:
    """Shares of a mixture's components that expectation-maximisation converges to.

    ``weights``: rows (values of equal evidence) by components, the likelihood of a value under each; ``counts``: values of
    each row.  A step multiplies every share by its mean posterior over its share; steps are lengthened as long as the
    likelihood grows, so that shares that go to nothing get there in a few of them.  Rows without weight tell nothing.
    """
    k = weights.shape[1]
    shares = np.full(k, 1.0 / k)
    kept = weights.max(axis=1) > 0
    weights, counts = weights[kept] / weights[kept].max(axis=1, keepdims=True), counts[kept].astype(float)
    if not counts.sum():
        return shares
    like = lambda s: float(counts @ np.log(weights @ s))
    at, power = like(shares), 1.0
    for _ in range(rounds):
        gain = (counts / (weights @ shares)) @ weights / counts.sum()
        moved = np.maximum(shares * np.maximum(gain, 1e-300) ** power, least)
        moved /= moved.sum()
        new = like(moved)
        if power > 1 and new < at:
            power = 1.0
            continue
        done = np.abs(moved - shares).max() < 1e-13
        shares, at, power = moved, new, power * 2
        if done:
            break
    return shares
