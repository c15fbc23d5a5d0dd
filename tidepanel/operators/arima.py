"""ARIMA(1,1,1) with regressors by exact likelihood: a Kalman filter that many parameter pairs pass at once, and its maximum.

y = X b + level, the level's change w = phi w' + e + theta e'.  The state is (level, w, e); the level is observed without noise, so
its diffuse start is the first known value, and w starts from its stationary law.  Unknown values are steps without
an update.  Given (phi, theta) the filter is linear, so it runs on y and the columns of X side by side; b and the
variance of e then come from weighted least squares on the innovations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

LEAST = 1e-12


@dataclass(frozen=True)
class Fit:
    phi: float
    theta: float
    beta: np.ndarray
    variance: float
    log_likelihood: float


def _start(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """(pair, 3, 3): covariance of (level, w, e) when the level is known, in units of e's variance."""
    p = np.zeros((len(phi), 3, 3))
    p[:, 1, 1] = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    p[:, 1, 2] = p[:, 2, 1] = p[:, 2, 2] = 1.0
    return p


def _moves(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    t = np.zeros((len(phi), 3, 3))
    t[:, 0, 0] = 1.0
    t[:, 0, 1] = t[:, 1, 1] = phi
    t[:, 0, 2] = t[:, 1, 2] = theta
    return t


def innovations(z: np.ndarray, known: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, pair, column) innovations of ``z`` (step, column), their (step, pair) variances, and which steps have one.

    The first known step starts the filter and has none.
    """
    n, m, g = len(z), z.shape[1], len(phi)
    v, f = np.zeros((n, g, m)), np.ones((n, g))
    first = int(np.argmax(known))
    has = known.copy()
    has[: first + 1] = False
    a = np.zeros((g, 3, m))
    a[:, 0] = z[first]
    p, t = _start(phi, theta), _moves(phi, theta)
    back = t.transpose(0, 2, 1)
    for i in range(first + 1, n):
        a = t @ a
        p = t @ p @ back + 1.0  # e enters level, w and e alike
        p[:, 2, :2] = p[:, :2, 2] = p[:, 2, 2][:, None] = 1.0
        if has[i]:
            f[i] = p[:, 0, 0]
            v[i] = z[i] - a[:, 0]
            gain = p[:, :, 0] / f[i][:, None]
            a = a + gain[:, :, None] * v[i][:, None, :]
            p = p - gain[:, :, None] * p[:, 0][:, None, :]
    return v, f, has


def profile(y: np.ndarray, x: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, b, variance) of each pair, b and the variance being the best for it.  NaN in ``y`` is unknown."""
    known = np.isfinite(y)
    z = np.column_stack([np.where(known, y, 0.0), x])
    v, f, has = innovations(z, known, phi, theta)
    v, f = v[has], f[has]
    n = len(v)
    w = v / np.sqrt(f)[:, :, None]
    beta = np.stack([np.linalg.lstsq(w[:, k, 1:], w[:, k, 0], rcond=None)[0] for k in range(len(phi))]) if x.shape[1] else np.zeros((len(phi), 0))
    rest = w[:, :, 0] - np.einsum("ngm,gm->ng", w[:, :, 1:], beta)
    variance = np.maximum((rest**2).sum(axis=0) / n, LEAST)
    value = -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + np.log(f).sum(axis=0))
    return value, beta, variance


def fit(y: np.ndarray, x: np.ndarray, rounds: int = 30, edge: float = 0.98) -> Fit:
    """The most likely parameters: the best of a coarse net, then Newton steps with halving, in the coordinates whose tanh is (phi, theta) / ``edge``."""
    def at(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return profile(y, x, edge * np.tanh(u[:, 0]), edge * np.tanh(u[:, 1]))

    net = np.arctanh(np.linspace(-0.9, 0.9, 7))
    u = np.array([(a, b) for a in net for b in net])
    value = at(u)[0]
    u, best, h = u[int(np.argmax(value))], float(value.max()), 1e-3
    ring = np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], float)
    for _ in range(rounds):
        q = at(u + h * ring)[0].reshape(3, 3)
        slope = np.array([q[2, 1] - q[0, 1], q[1, 2] - q[1, 0]]) / (2 * h)
        mixed = (q[2, 2] - q[2, 0] - q[0, 2] + q[0, 0]) / (4 * h * h)
        bend = np.array([[q[2, 1] - 2 * q[1, 1] + q[0, 1], mixed * h * h], [mixed * h * h, q[1, 2] - 2 * q[1, 1] + q[1, 0]]]) / (h * h)
        # uphill in any case: curvatures that aren't negative are turned
        size, axes = np.linalg.eigh(bend)
        step = axes @ ((axes.T @ slope) / np.maximum(np.abs(size), 1e-3))
        step *= min(1.0, 1.0 / max(np.abs(step).max(), LEAST))
        tries = u + step * 0.5 ** np.arange(8)[:, None]
        value = at(np.clip(tries, -6, 6))[0]
        k = int(np.argmax(value))
        if value[k] <= best + 1e-9:
            break
        u, best = np.clip(tries[k], -6, 6), float(value[k])
    value, beta, variance = at(u[None])
    return Fit(float(edge * math.tanh(u[0])), float(edge * math.tanh(u[1])), beta[0], float(variance[0]), float(value[0]))


def forecasts(y: np.ndarray, x: np.ndarray, model: Fit, ahead: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(step, horizon) means of y and their variances, seen from each step with what is known up to it; ``x`` has ``ahead`` steps more than ``y``."""
    n = len(y)
    known = np.isfinite(y)
    mean, spread = np.full((n, ahead), np.nan), np.full((n, ahead), np.nan)
    if not known.any():
        return mean, spread
    first = int(np.argmax(known))
    level = np.where(known, y, 0.0) - x[:n] @ model.beta
    t, p = _moves(np.array([model.phi]), np.array([model.theta]))[0], _start(np.array([model.phi]), np.array([model.theta]))[0]
    noise = np.ones((3, 3))
    a = np.array([level[first], 0.0, 0.0])
    for i in range(first, n):
        if i > first:
            a, p = t @ a, t @ p @ t.T + noise
            if known[i]:
                gain = p[:, 0] / p[0, 0]
                a, p = a + gain * (level[i] - a[0]), p - np.outer(gain, p[0])
        b, q = a, p
        for h in range(ahead):
            b, q = t @ b, t @ q @ t.T + noise
            mean[i, h], spread[i, h] = b[0] + x[i + 1 + h] @ model.beta, model.variance * q[0, 0]
    return mean, spread
