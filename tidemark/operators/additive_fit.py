"""The additive seasonal model of one series from its sufficient statistics.

Trend, hinges at the changepoints and Fourier terms enter only through the
Gram matrix and the moments of the training days.  Changepoints carry an L1
penalty (a Laplace prior on changes of slope), the other terms normal priors,
on revenue scaled by its largest value and time scaled to the training span;
coordinate descent on the Gram matrix finds the most likely coefficients,
the noise variance being refitted in turn.
"""

from __future__ import annotations

import numpy as np

# FIXED VALUES of the published model: prior scales of changepoints, of
# growth and offset, and of seasonality.
CHANGEPOINT_SCALE, TREND_SCALE, SEASON_SCALE = 0.05, 5.0, 10.0
SWEEPS, ROUNDS, SETTLED = 400, 12, 1e-9


def design(day: np.ndarray, t: np.ndarray, changepoints: list[float], periods: list[tuple[float, int]]) -> np.ndarray:
    """Trend, one hinge a changepoint, and sine and cosine pairs: the columns
    that ``additive_terms`` builds in Spark, in the same order."""
    columns = [t, *(np.maximum(t - c, 0.0) for c in changepoints)]
    for period, order in periods:
        for k in range(1, order + 1):
            angle = day * (2.0 * np.pi * k / period)
            columns += [np.sin(angle), np.cos(angle)]
    return np.stack(columns, axis=1)


def descend(gram: np.ndarray, moment: np.ndarray, lasso: np.ndarray, ridge: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Minimum of b'Ab / 2 - m'b + sum(ridge b^2) / 2 + sum(lasso |b|)."""
    b, a = start.copy(), gram + np.diag(ridge)
    pull = moment - a @ b                       # kept up to date
    diagonal = np.maximum(np.diag(a), 1e-300)
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(len(b)):
            at = pull[j] + diagonal[j] * b[j]
            new = np.sign(at) * max(abs(at) - lasso[j], 0.0) / diagonal[j]
            if new != b[j]:
                pull -= a[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]))
                b[j] = new
        if moved < SETTLED:
            break
    return b


def fit(x: np.ndarray, y: np.ndarray, n_changepoints: int, scale: float | None = CHANGEPOINT_SCALE) -> tuple[np.ndarray, float]:
    """Coefficients and intercept for columns ``x`` (trend, hinges, seasons).
    ``scale`` None leaves out all penalties: plain least squares."""
    top = float(np.abs(y).max()) or 1.0
    span = float(np.abs(x[:, 0]).max()) or 1.0
    units = np.ones(x.shape[1] + 1)
    units[1:2 + n_changepoints] = span
    z = np.column_stack([np.ones(len(x)), x]) / units
    gram, moment, square = z.T @ z, z.T @ (y / top), float((y / top) @ (y / top))
    if scale is None:
        b = np.linalg.lstsq(gram, moment, rcond=None)[0]
    else:
        hinges = np.zeros(len(units))
        hinges[2:2 + n_changepoints] = 1.0 / scale
        prior = np.full(len(units), SEASON_SCALE ** -2.0)
        prior[:2], prior[2:2 + n_changepoints] = TREND_SCALE ** -2.0, 0.0
        b, noise = np.zeros(len(units)), max(square / len(y), 1e-12)
        for _ in range(ROUNDS):
            b = descend(gram, moment, hinges * noise, prior * noise, b)
            rest = max((square - 2 * moment @ b + b @ gram @ b) / len(y), 1e-12)
            if abs(rest - noise) < 1e-6 * noise:
                break
            noise = rest
    b = b * top / units
    return b[1:], float(b[0])
