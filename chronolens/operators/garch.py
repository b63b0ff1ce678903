"""GARCH(1,1): quasi-maximum-likelihood fit with variance targeting, filter, and simulation from filtered residuals.

The recursion over a series's rows is sequential, so it runs in numpy on one
series at a time (``applyInArrow``); many series and many parameter pairs or
paths run side by side.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BURN = 500
PARAMS = "mu double, omega double, alpha double, beta double, persistence double, uncond_var double, half_life double, nll double"


@dataclass(frozen=True)
class Params:
    mu: float
    omega: float
    alpha: float
    beta: float

    @property
    def persistence(self) -> float:
        return self.alpha + self.beta

    @property
    def uncond_var(self) -> float | None:
        return self.omega / (1 - self.persistence) if self.persistence < 1 else None

    @property
    def half_life(self) -> float | None:
        p = self.persistence
        return float(np.log(0.5) / np.log(p)) if 0 < p < 1 else None


def variances(e: np.ndarray, omega, alpha, beta, first) -> np.ndarray:
    """Conditional variances, one column for each parameter set: v[t] = omega + alpha e[t-1]^2 + beta v[t-1]."""
    omega, alpha, beta = np.broadcast_arrays(np.atleast_1d(omega), np.atleast_1d(alpha), np.atleast_1d(beta))
    v = np.empty((len(e), len(omega)))
    v[0] = first
    square = e * e
    for t in range(1, len(e)):
        v[t] = omega + alpha * square[t - 1] + beta * v[t - 1]
    return v


def likelihoods(e: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gaussian negative log-likelihoods (without the constant) under variance targeting."""
    target = float(np.mean(e * e))
    v = np.maximum(variances(e, target * (1 - alpha - beta), alpha, beta, target), 1e-300)
    return 0.5 * np.sum(np.log(v) + (e * e)[:, None] / v, axis=0)


def fit(r: np.ndarray, rounds: int = 7, points: int = 13) -> tuple[Params, float]:
    """A grid over (alpha, persistence) that zooms in on the best cell; every point of a grid is filtered in one pass.

    Deterministic, and free of starting values. A series without variance, or
    of fewer than ten returns, has all parameters 0.
    """
    r = np.asarray(r, dtype=float)
    mu = float(r.mean()) if len(r) else 0.0
    e = r - mu
    if len(r) < 10 or not np.mean(e * e) > 0:
        return Params(mu if len(r) else 0.0, 0.0, 0.0, 0.0), 0.0
    low, high = np.array([1e-6, 0.0]), np.array([0.5, 0.99999])
    best, value = None, np.inf
    for _ in range(rounds):
        a, p = (x.ravel() for x in np.meshgrid(np.linspace(low[0], high[0], points), np.linspace(low[1], high[1], points)))
        keep = (p > a + 1e-8) & (p < 0.99999)
        a, p = a[keep], p[keep]
        if len(a):
            nll = likelihoods(e, a, p - a)
            at = int(np.argmin(nll))
            if nll[at] < value:
                best, value = (float(a[at]), float(p[at])), float(nll[at])
        step = (high - low) / (points - 1)
        low, high = np.maximum(np.array(best) - 1.5 * step, [1e-8, 0.0]), np.minimum(np.array(best) + 1.5 * step, [0.9999, 0.999989])
    alpha, persistence = best
    return Params(mu, float(np.mean(e * e)) * (1 - persistence), alpha, persistence - alpha), value


def residuals(r: np.ndarray, p: Params) -> np.ndarray:
    """Standardised residuals, scaled to unit sample variance."""
    e = np.asarray(r, dtype=float) - p.mu
    v = variances(e, p.omega, p.alpha, p.beta, max(float(np.mean(e * e)), 1e-16))[:, 0]
    z = e / np.sqrt(np.maximum(v, 1e-300))
    spread = z.std(ddof=1) if len(z) > 1 else 0.0
    if not spread > 0:
        raise ValueError("a series without variance has no residuals")
    return z / spread


def simulate(r: np.ndarray, p: Params, z: np.ndarray, n_sim: int, rng: np.random.Generator, burn: int = BURN) -> np.ndarray:
    """Filtered historical simulation: paths of the length of r, with innovations drawn from z; all paths advance together."""
    n = len(r)
    draws = z[rng.integers(0, len(z), size=(burn + n, n_sim))]
    v = np.full(n_sim, p.uncond_var if p.uncond_var else float(np.var(r)))
    e = np.zeros(n_sim)
    out = np.empty((n_sim, n))
    for t in range(burn + n):
        if t:
            v = p.omega + p.alpha * e * e + p.beta * v
        e = np.sqrt(v) * draws[t] if t else np.zeros(n_sim)
        if t >= burn:
            out[:, t - burn] = e + p.mu
    return out


def generator(*parts) -> np.random.Generator:
    """A random stream that depends only on the parts."""
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:16], "big")))


def ordered(table: pa.Table) -> np.ndarray:
    """Returns in the order of i."""
    return table.column("ret").to_numpy()[np.argsort(table.column("i").to_numpy(), kind="stable")].astype(float)


def _fit(table: pa.Table) -> pa.Table:
    p, nll = fit(ordered(table))
    values = (p.mu, p.omega, p.alpha, p.beta, p.persistence, p.uncond_var, p.half_life, nll)
    return pa.table([table.column("series_id")[:1], *[pa.array([x], pa.float64()) for x in values]], names=["series_id", *[c.split()[0] for c in PARAMS.split(", ")]])


def fit_all(series: DataFrame) -> DataFrame:
    """Rows (series_id, mu, omega, alpha, beta, persistence, uncond_var, half_life, nll)."""
    return series.select("series_id", "i", "ret").groupBy("series_id").applyInArrow(_fit, f"series_id string, {PARAMS}")


def filter_fixed(series: DataFrame, alpha: float, beta: float) -> DataFrame:
    """Rows (series_id, n, last_var, nll) of the filter with given alpha and beta, variance targeting."""

    def run(table: pa.Table) -> pa.Table:
        e = ordered(table)
        e = e - e.mean()
        target = float(np.mean(e * e))
        v = variances(e, target * (1 - alpha - beta), alpha, beta, target)[:, 0]
        nll = float(0.5 * np.sum(np.log(v) + e * e / v))
        return pa.table([table.column("series_id")[:1], pa.array([len(e)]), pa.array([float(v[-1])]), pa.array([nll])], names=["series_id", "n", "last_var", "nll"])

    return series.select("series_id", "i", "ret").groupBy("series_id").applyInArrow(run, "series_id string, n long, last_var double, nll double")


def derived(params: DataFrame) -> DataFrame:
    """params (alpha, beta, omega) with persistence, unconditional variance (NULL if not stationary) and half-life (NULL: infinite)."""
    p = F.col("alpha") + F.col("beta")
    return params.withColumns({"persistence": p, "uncond_var": F.when(p < 1, F.col("omega") / (1 - p)), "half_life": F.when((p > 0) & (p < 1), F.ln(F.lit(0.5)) / F.ln(p))})
