"""Moments sketch: extremes and power sums, solved by maximum entropy.

A sketch table has one row per group::

    keys..., n, skipped, zmin, zmax, s01 ... s11

with ``n`` the values that went in, ``skipped`` those that could not, ``s_k`` the sum of ``z**k`` and ``z = asinh(x)``, or ``asinh(ln x)`` when the
log transform is on.  Build and merge are plain sums; only the fit, which sees
one row per group, runs in Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.scalars import (
    QUANTILES,
    arcsinh_compress,
    as_column,
    log_transform,
    quantile_column,
)

K = 12


def power_columns(k: int = K) -> list[str]:
    return [f"s{i:02d}" for i in range(1, k)]


def usable(value: str | Column, log: bool = False, compress: bool = True) -> Column:
    """The number whose powers are summed; NULL if there is none."""
    x = as_column(value).cast("double")
    if log:
        x = log_transform(x)  # NULL at and below zero
    z = arcsinh_compress(x) if compress else x
    # NaN sorts above infinity, so one comparison finds all that is unusable.
    return F.when(F.abs(x) < F.lit(float("inf")), z)


def power_sums(z: str = "_z", k: int = K) -> list[Column]:
    """The aggregates of a sketch over rows whose value is not NULL."""
    sums, power = [], F.col(z)
    for name in power_columns(k):
        sums.append(F.sum(power).alias(name))
        power = power * F.col(z)
    n = F.count(z)
    return [n.alias("n"), (F.count(F.lit(1)) - n).alias("skipped"), F.min(z).alias("zmin"),
            F.max(z).alias("zmax"), *sums]


def moments_build(df: DataFrame, value: str | Column, keys: Sequence[str] = (), k: int = K,
                  log: bool = False, compress: bool = True) -> DataFrame:
    """Power sums per group.  NULLs are left out.  NaN and infinite values, and with
    ``log`` those not above zero, have no place either; ``skipped`` counts them."""
    rows = df.where(as_column(value).isNotNull()).select(
        *keys, usable(value, log, compress).alias("_z"))
    return rows.groupBy(*keys).agg(*power_sums("_z", k))


def moments_merge(sketches: DataFrame, keys: Sequence[str] = (), k: int = K) -> DataFrame:
    return sketches.groupBy(*keys).agg(*merged_sums(k))


def merged_sums(k: int = K) -> list[Column]:
    """The aggregates that merge sketches."""
    sums = [F.sum(c).alias(c) for c in ("n", "skipped", *power_columns(k))]
    return [*sums, F.min("zmin").alias("zmin"), F.max("zmax").alias("zmax")]


def moments_quantiles(sketch: DataFrame, keys: Sequence[str] = (),
                      ps: Sequence[float] = QUANTILES, k: int = K, log: bool = False,
                      compress: bool = True) -> DataFrame:
    """``keys, n, skipped, moments_used, converged, pct_..`` from the density that fits.

    A fit that does not converge is tried with fewer moments; ``moments_used`` tells how
    many it has, counting the total, and ``converged`` is false if none were left but
    that, which is a uniform density.  A group of skipped values alone has NULL
    quantiles.
    """
    ranks = np.array([float(p) for p in ps])

    @F.pandas_udf("q array<double>, used int, converged boolean")
    def fit(n: pd.Series, lo: pd.Series, hi: pd.Series, sums: pd.Series) -> pd.DataFrame:
        q, used, converged = ([None] * len(n) for _ in range(3))
        some = np.flatnonzero(n.to_numpy() > 0)
        if len(some):
            found = solve_with_fit(
                n.to_numpy(float)[some], lo.to_numpy(float)[some], hi.to_numpy(float)[some],
                np.stack([sums.iloc[i] for i in some]).astype(float), ranks)
            for i, quantiles, size, fitted in zip(some, *found):
                q[i], used[i], converged[i] = quantiles.tolist(), int(size), bool(fitted)
        return pd.DataFrame({"q": pd.Series(q, dtype=object), "used": pd.array(used, dtype="Int32"),
                             "converged": pd.array(converged, dtype="boolean")})

    solved = sketch.where("n + skipped > 0").withColumn(
        "_f", fit("n", "zmin", "zmax", F.array(*power_columns(k)))
    )
    picks = []
    for i, p in enumerate(ps):
        z = F.col("_f.q")[i]
        x = F.sinh(z) if compress else z
        picks.append((F.exp(x) if log else x).alias(quantile_column(p)))
    return solved.select(*keys, "n", "skipped", F.col("_f.used").alias("moments_used"),
                         F.col("_f.converged").alias("converged"), *picks)


# --- the fit, on a batch of sketch rows ------------------------------------------
#
# Arrays have one row per group; all groups of a batch take their Newton steps
# together.

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(256)

#: Rounding error of a power sum, relative to its size, and the error a moment
#: may have before it is left out of the fit.
_SUM_ERROR = 1e-14
_MOMENT_ERROR = 1e-3

_ROWS = 1024  # groups solved together
_STEPS = 100
_DONE, _GOOD_ENOUGH = 1e-9, 1e-5


def _scaled_moments(n: np.ndarray, lo: np.ndarray, hi: np.ndarray,
                    sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the Chebyshev polynomials of ``z`` scaled to [-1, 1], and how many
    of them are usable.

    Scaling is linear in the power means, so the same pass with absolute values
    bounds how far rounding in the sums is blown up.  Moments past the first
    uncertain one are not used.
    """
    raw = np.column_stack((np.ones(len(n)), sums / n[:, None]))
    mid, half = (lo + hi) / 2, (hi - lo) / 2
    degree = raw.shape[1]
    shifted, spread = np.zeros_like(raw), np.zeros_like(raw)
    for i in range(degree):
        for j in range(i + 1):
            term = math.comb(i, j) * half**-i * (-mid) ** (i - j) * raw[:, j]
            shifted[:, i] += term
            spread[:, i] += np.abs(term)
    to_cheb = np.zeros((degree, degree))
    for i in range(degree):
        to_cheb[i, : i + 1] = np.polynomial.chebyshev.cheb2poly(np.eye(degree)[i])[: i + 1]
    means = shifted @ to_cheb.T
    sound = (_SUM_ERROR * (spread @ np.abs(to_cheb).T) <= _MOMENT_ERROR) & (
        np.abs(means) <= 1 + 1e-9)
    usable = np.where(sound.all(axis=1), degree, np.argmin(sound, axis=1))
    return means, np.maximum(usable, 1)


def _max_entropy(target: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densities on the nodes whose first ``size`` Chebyshev means are ``target``.

    Newton's method with backtracking on the convex potential.  Returns the
    densities and which of the groups converged.
    """
    groups, degree = target.shape
    basis = np.polynomial.chebyshev.chebvander(_NODES, degree - 1)
    products = (basis[:, :, None] * basis[:, None, :]).reshape(len(_NODES), -1)
    used = np.arange(degree)[None, :] < size[:, None]
    target = np.where(used, target, 0.0)
    theta = np.zeros((groups, degree))
    theta[:, 0] = -np.log(2.0)

    def potential(t: np.ndarray, goal: np.ndarray) -> np.ndarray:
        return np.exp(t @ basis.T) @ _WEIGHTS - np.einsum("gi,gi->g", t, goal)

    error = np.full(groups, np.inf)
    active = np.arange(groups)
    with np.errstate(over="ignore", invalid="ignore"):
        current = potential(theta, target)
        for _ in range(_STEPS):
            t, goal, mask = theta[active], target[active], used[active]
            weighted = np.exp(t @ basis.T) * _WEIGHTS
            grad = np.where(mask, weighted @ basis - goal, 0.0)
            error[active] = np.abs(grad).max(axis=1)
            go = error[active] >= _DONE
            if not go.any():
                break
            active, t, goal, mask, grad = active[go], t[go], goal[go], mask[go], grad[go]
            hess = (weighted[go] @ products).reshape(-1, degree, degree)
            both = mask[:, :, None] & mask[:, None, :]
            hess = np.where(both, hess, 0.0) + np.eye(degree) * np.where(mask, 1e-13, 1.0)[:, None, :]
            try:
                step = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
            except np.linalg.LinAlgError:  # one flat group; damp the step for all
                step = np.linalg.solve(hess + 1e-6 * np.eye(degree), grad[:, :, None])[:, :, 0]
            slope = np.einsum("gi,gi->g", grad, step)
            scale, pending = np.ones(len(active)), np.arange(len(active))
            best, value = t.copy(), current[active].copy()
            for _ in range(34):
                trial = t[pending] - scale[pending, None] * step[pending]
                got = potential(trial, goal[pending])
                ok = got <= current[active][pending] - 1e-4 * scale[pending] * slope[pending]
                best[pending[ok]], value[pending[ok]] = trial[ok], got[ok]
                pending = pending[~ok]
                if not len(pending):
                    break
                scale[pending] /= 2
            theta[active], current[active] = best, value
            active = np.delete(active, pending)  # no step helps any more
            if not len(active):
                break
        return np.exp(theta @ basis.T), error <= _GOOD_ENOUGH


def solve(n: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray,
          ranks: np.ndarray) -> np.ndarray:
    """Quantiles of ``z``, one row per group; a group uses as many of its moments
    as its fit converges with."""
    return solve_with_fit(n, lo, hi, sums, ranks)[0]


def solve_with_fit(n: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray,
                   ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles, the number of moments used and whether the fit converged, per group."""
    out = np.empty((len(n), len(ranks)))
    used, converged = np.empty(len(n), dtype=np.int64), np.empty(len(n), dtype=bool)
    for start in range(0, len(n), _ROWS):
        part = slice(start, start + _ROWS)
        out[part], used[part], converged[part] = _solve(n[part], lo[part], hi[part], sums[part],
                                                        ranks)
    return out, used, converged


def _solve(n, lo, hi, sums, ranks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = np.repeat(lo[:, None], len(ranks), axis=1)
    # A group of one value is exact with all its moments.
    used, fitted = np.full(len(n), sums.shape[1] + 1), np.ones(len(n), dtype=bool)
    open_rows = np.flatnonzero(hi > lo)
    if not len(open_rows):
        return out, used, fitted
    target, size = _scaled_moments(n[open_rows], lo[open_rows], hi[open_rows], sums[open_rows])
    edges = np.concatenate(([-1.0], -1.0 + np.cumsum(_WEIGHTS)))
    while len(open_rows):
        density, converged = _max_entropy(target, size)
        for i in np.flatnonzero(converged | (size == 1)):
            row = open_rows[i]
            mass = np.concatenate(([0.0], np.cumsum(_WEIGHTS * density[i])))
            at = np.interp(ranks, mass / mass[-1], edges)
            out[row] = (lo[row] + hi[row]) / 2 + at * (hi[row] - lo[row]) / 2
            used[row], fitted[row] = size[i], converged[i] and size[i] > 1
        again = ~converged & (size > 1)
        open_rows, target, size = open_rows[again], target[again], size[again] - 1
    return out, used, fitted
