"""The eleven statistics of many equally long paths at once, in numpy: rows of a matrix are paths.

The DataFrame plans of :mod:`chronolens.functions.stats` define the statistics;
this kernel is for surrogates in bulk, where a window pass over billions of
generated rows would cost more than the statistics.
"""

from __future__ import annotations

import numpy as np

from chronolens.functions.stats import BANDS, HORIZON, LAGS, NAMES, PERIODS, TIE, WINDOW


def _acf(d: np.ndarray, lag: int) -> np.ndarray:
    s = np.einsum("ij,ij->i", d, d)
    if lag >= d.shape[1]:
        return np.zeros(len(d))
    return np.where(s > 0, np.einsum("ij,ij->i", d[:, lag:], d[:, :-lag]) / np.where(s > 0, s, 1), 0.0)


def _rolling_vol(r: np.ndarray, window: int) -> np.ndarray:
    n = r.shape[1]
    if n < window:
        return np.full((len(r), 0), np.nan)
    d = r - r.mean(axis=1, keepdims=True)
    one = np.concatenate((np.zeros((len(r), 1)), np.cumsum(d, axis=1)), axis=1)
    two = np.concatenate((np.zeros((len(r), 1)), np.cumsum(d * d, axis=1)), axis=1)
    s, q = one[:, window:] - one[:, :-window], two[:, window:] - two[:, :-window]
    return np.sqrt(np.maximum(q - s * s / window, 0) / (window - 1) * PERIODS)


def statistics(r: np.ndarray, window: int = WINDOW, k: int = BANDS, horizon: int = HORIZON) -> np.ndarray:
    """One row of values for each path, in the order of NAMES; NaN is undefined."""
    m, n = r.shape
    out = np.full((m, len(NAMES)), np.nan)
    d = r - r.mean(axis=1, keepdims=True)
    m2, m4 = (d * d).mean(axis=1), (d**4).mean(axis=1)
    out[:, 0] = np.sqrt((d * d).sum(axis=1) / (n - 1) * PERIODS) if n > 1 else np.nan
    out[:, 1] = np.where(m2 > 0, m4 / np.where(m2 > 0, m2 * m2, 1) - 3, 0.0)
    a = np.abs(r)
    a = a - a.mean(axis=1, keepdims=True)
    acf = {h: _acf(a, h) for h in [*range(1, LAGS + 1), 66]}
    out[:, 2], out[:, 3], out[:, 4], out[:, 5] = acf[1], acf[22], acf[66], _acf(d, 1)
    out[:, 6] = n * (n + 2) * sum(acf[h] ** 2 / (n - h) for h in range(1, LAGS + 1) if n > h)
    vol = _rolling_vol(r, window)
    valid = vol.shape[1]
    if valid > horizon and valid >= k:
        cuts = np.quantile(vol, np.arange(1, k) / k, axis=1)
        band = sum((vol >= c[:, None] * (1 - TIE)).astype(np.int64) for c in cuts)
        x, y = band[:, :-horizon], band[:, horizon:]
        pairs = valid - horizon
        cell = (np.arange(m)[:, None] * k * k + x * k + y).ravel()
        table = np.bincount(cell, minlength=m * k * k).reshape(m, k, k).astype(float)
        rows, columns = table.sum(axis=2), table.sum(axis=1)
        same = np.einsum("ijj->i", table) / pairs
        chance = (rows * columns).sum(axis=1) / pairs**2
        expected = rows[:, :, None] * columns[:, None, :] / pairs
        chi2 = np.where(expected > 0, (table - expected) ** 2 / np.where(expected > 0, expected, 1), 0).sum(axis=(1, 2))
        out[:, 7], out[:, 8], out[:, 9] = same, (same - chance) * 100, np.sqrt(chi2 / (pairs * (k - 1)))
        u, v = vol[:, :-horizon], vol[:, horizon:]
        good = (u > 0) & (v > 0)
        lu, lv = np.log(np.where(good, u, 1)), np.log(np.where(good, v, 1))
        c = good.sum(axis=1)
        c1 = np.maximum(c, 1)
        du = np.where(good, lu - (lu.sum(axis=1) / c1)[:, None], 0)
        dv = np.where(good, lv - (lv.sum(axis=1) / c1)[:, None], 0)
        su, sv, suv = (du * du).sum(axis=1), (dv * dv).sum(axis=1), (du * dv).sum(axis=1)
        fits = (c >= 30) & (su > 0) & (sv > 0)
        out[:, 10] = np.where(fits, suv**2 / np.where(fits, su * sv, 1), np.nan)
    return out
