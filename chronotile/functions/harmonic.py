"""Numerical parts of the change detectors: harmonic LASSO, robust screening, angles, quantiles.

A model of a band is eight numbers: level, slope (times SLOPE_SCALE), then cosine and sine of one,
two and three cycles a year, over ordinal days.
"""

from __future__ import annotations

from math import ceil, exp, lgamma, log, pi

import numpy as np

YEAR = 365.25
W = 2 * pi / YEAR
SLOPE_SCALE = 10_000.0
LAMBDA = 20.0
#: A robust residual of more than so many times the band's variability marks cloud or shadow.
MASK_FACTOR = 4.42


def terms(x: np.ndarray, df: int) -> np.ndarray:
    """Columns of a model with df coefficients, without the level."""
    x = np.asarray(x, float)
    angle = W * x
    columns = [x]
    for k in (1, 2, 3):
        columns += [np.cos(k * angle), np.sin(k * angle)]
    return np.column_stack(columns[: df - 1])


_SCALE = np.array([1 / SLOPE_SCALE, 1, 1, 1, 1, 1, 1])


def predict(coefs: np.ndarray, x: np.ndarray, df: int | None = None, columns: np.ndarray | None = None) -> np.ndarray:
    """Bands x days. coefs: bands x 8; unused coefficients are 0, so df may stay out. columns: the terms, where they are known."""
    df = df or 8
    return coefs[:, :1] + (coefs[:, 1:df] * _SCALE[: df - 1]) @ (terms(x, df) if columns is None else columns[:, : df - 1]).T


def _settled(gram: np.ndarray, target: np.ndarray, b: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """For each band (rows of target and b) the solution for the signs of b, and whether it is the optimum. All systems
    are solved in one call; a coefficient that is 0 has a row of the identity."""
    signs = np.sign(b)
    on = signs != 0
    systems = np.where(on[:, :, None] & on[:, None, :], gram, 0.0)
    at = np.arange(len(gram))
    systems[:, at, at] += ~on
    out = np.linalg.solve(systems, np.where(on, target - penalty * signs, 0.0)[:, :, None])[:, :, 0]
    good = (np.sign(out) == signs).all(1) & (on | (np.abs(target - out @ gram) <= penalty * (1 + 1e-9))).all(1)
    return out, good


def lasso(x: np.ndarray, y: np.ndarray, df: int, penalty: float = LAMBDA, rounds: int = 400, guess: np.ndarray | None = None, columns: np.ndarray | None = None):
    """Coefficients (bands x 8), root mean square errors and residuals of bands y over days x. A few
    rounds of coordinate descent on standardised columns, all bands at once as they share them, find the
    signs; the optimum for these signs is then solved for, and proves them right or asks for more rounds.
    guess: coefficients whose signs are tried first, and from which the descent starts. columns: the terms, where they are known."""
    n, p = len(x), df - 1
    if columns is None:
        columns = terms(x, df)
    mean, level = columns.mean(0), y.mean(1)
    centred = columns - mean
    sd = np.sqrt((centred**2).mean(0))
    sd[sd == 0] = 1.0
    z = centred / sd
    gram, target = z.T @ z / n, (y - level[:, None]) @ z / n
    rows = gram.tolist()
    b = np.zeros((len(y), p))
    open_ = list(range(len(y)))

    def settle(bands: list[int]) -> list[int]:
        """Solve for the signs in b; the bands for which they weren't the optimum's."""
        left = []
        try:
            groups = [(bands, *_settled(gram, target[bands], b[bands], penalty))]
        except np.linalg.LinAlgError:  # a singular system: one band at a time, so that it holds up no other
            groups = []
            for k in bands:
                try:
                    groups.append(([k], *_settled(gram, target[[k]], b[[k]], penalty)))
                except np.linalg.LinAlgError:
                    left.append(k)
        for ks, best, good in groups:
            for k, x, ok in zip(ks, best, good.tolist(), strict=True):
                if ok:
                    b[k] = x
                else:
                    left.append(k)
        return left

    if guess is not None:
        b[:] = guess[:, 1:df] * sd
        b[:, 0] /= SLOPE_SCALE
        open_ = settle(open_)
    spent, each = 0, 6
    while open_:
        for k in open_:
            t, c = target[k].tolist(), b[k].tolist()
            for _ in range(each):
                for j in range(p):
                    row = rows[j]
                    new = t[j] + c[j]
                    for m in range(p):
                        new -= row[m] * c[m]
                    c[j] = new - penalty if new > penalty else new + penalty if new < -penalty else 0.0
            b[k] = c
        left = settle(open_)
        open_, spent, each = left, spent + each, 12
        if spent >= rounds:
            break
    slopes = b / sd
    coefs = np.zeros((len(y), 8))
    coefs[:, 0] = level - slopes @ mean
    coefs[:, 1:df] = slopes
    residuals = y - (coefs[:, :1] + slopes @ columns.T)
    coefs[:, 1] *= SLOPE_SCALE
    return coefs, np.sqrt((residuals**2).sum(1) / max(n - df, 1)), residuals


def robust(columns: np.ndarray, y: np.ndarray, rounds: int = 5, tune: float = 4.685, factors=None) -> np.ndarray:
    """Bisquare regression by reweighted least squares; residuals after `rounds` at most. factors: np.linalg.qr(columns), where it is known.
    Each round solves for an orthonormal basis of the columns; what is nearly singular goes to np.linalg.lstsq."""
    n, p = columns.shape
    q, r = np.linalg.qr(columns) if factors is None else factors
    size = np.abs(np.diagonal(r))
    whole = n > p and size.min() > 1e-6 * size.max()
    spread = 1 / np.sqrt(np.maximum(1 - np.minimum((q**2).sum(1), 0.9999), 1e-4))
    beta = np.linalg.solve(r, q.T @ y) if whole else np.linalg.lstsq(columns, y, rcond=None)[0]
    least = max(1e-6 * float(np.std(y)), 1e-12)
    skip = min(p - 1, n - 1)
    low, high = skip + (n - skip - 1) // 2, skip + (n - skip) // 2
    for _ in range(rounds):
        adjusted = (y - columns @ beta) * spread
        ordered = np.sort(np.abs(adjusted))
        sigma = max(float(ordered[low] + ordered[high]) / 2 / 0.6745, least)
        u = adjusted / (tune * sigma)
        weight = np.maximum(1 - u**2, 0.0)  # the square root of the bisquare weight
        new = _weighted(q, r, y, weight) if whole else None
        if new is None:
            new = np.linalg.lstsq(columns * weight[:, None], y * weight, rcond=None)[0]
        done = (np.abs(new - beta) <= 1e-6 * np.maximum(np.abs(new), np.abs(beta))).all()
        beta = new
        if done:
            break
    return y - columns @ beta


def _weighted(q: np.ndarray, r: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray | None:
    """Weighted least squares over columns q @ r; None where the weights leave them nearly dependent."""
    z = q * weight[:, None]
    gram = z.T @ z
    try:
        if np.diagonal(np.linalg.cholesky(gram)).min() < 1e-2:
            return None
        return np.linalg.solve(r, np.linalg.solve(gram, z.T @ (y * weight)))
    except np.linalg.LinAlgError:
        return None


def screen(x: np.ndarray, green: np.ndarray, swir: np.ndarray, noise_green: float, noise_swir: float) -> np.ndarray:
    """True for days that a robust seasonal and multi-year fit of either band marks as cloud or shadow."""
    years = max(1, ceil((x[-1] - x[0]) / YEAR))
    a = W * x
    columns = np.column_stack([np.ones(len(x)), np.cos(a), np.sin(a), np.cos(a / years), np.sin(a / years)])
    factors = np.linalg.qr(columns)
    return (np.abs(robust(columns, green, factors=factors)) > MASK_FACTOR * noise_green) | (np.abs(robust(columns, swir, factors=factors)) > MASK_FACTOR * noise_swir)


def mean_angle(vectors: np.ndarray) -> float:
    """Mean angle in degrees between successive columns (bands x observations); 0 for a single one."""
    if vectors.shape[1] < 2:
        return 0.0
    a, b = vectors[:, :-1], vectors[:, 1:]
    size = np.sqrt((a**2).sum(0) * (b**2).sum(0))
    cosine = np.where(size > 0, (a * b).sum(0) / np.where(size > 0, size, 1), 1.0)
    return float(np.degrees(np.arccos(np.clip(cosine, -1, 1))).mean())


def angle_decay(angle: float, low: float = 45.0, high: float = 90.0) -> float:
    """1 below `low`, 0 above `high`, linear between."""
    return min(1.0, max(0.0, (high - angle) / (high - low)))


def coefficients_for(n: int) -> int:
    """How many coefficients n observations bear."""
    return 4 if n < 18 else 6 if n < 24 else 8


def variability(y: np.ndarray) -> np.ndarray:
    """By band the median absolute difference of successive observations."""
    return np.median(np.abs(np.diff(y, axis=1)), axis=1) if y.shape[1] > 1 else np.zeros(len(y))


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    scale = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for k in range(1, 500):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_quantile(p: float, df: float) -> float:
    """The value that a chi-square variable with df degrees stays under with probability p."""
    if not 0 < p < 1:
        raise ValueError("p must be between 0 and 1")
    low, high = 0.0, max(10.0, 4 * df)
    while gamma_p(df / 2, high / 2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(df / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2
