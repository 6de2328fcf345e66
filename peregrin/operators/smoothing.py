"""Additive damped Holt-Winters, fitted for many series at once.

For given smoothing parameters the one-step errors are linear in the states that
a series starts from. So the states come from least squares, and only the four
parameters are searched for: from the best of a coarse grid by damped
Gauss-Newton steps on what is left after that projection, with slopes by
differences. Every array has a row per series and candidate, so a step advances
all series of a batch together.
"""

from __future__ import annotations

import numpy as np

SEASON = 12
#: Level, trend and seasons but the last, whose part the level takes: the states to start from.
STATES = SEASON + 1
#: Bounds of level, trend, season and damping; the grid; how many of its best are refined; series advanced together.
LOW, HIGH = np.array([1e-4, 1e-4, 1e-4, 0.8]), np.array([0.9999, 0.9999, 0.9999, 0.998])
GRID = ((0.05, 0.3, 0.6, 0.9), (0.02, 0.15, 0.5), (0.02, 0.2, 0.6), (0.85, 0.98))
STARTS, CHUNK, ROUNDS = 3, 64, 25


def responses(y: np.ndarray, parameters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Errors and last states of each row as linear functions of its first states.

    y: (rows, months), parameters: (rows, 4). Errors: (rows, months, 1 + STATES),
    the first column without any state. Level and trend: (rows, 1 + STATES),
    seasons: (rows, SEASON, 1 + STATES), the first for the month after y.
    """
    alpha, beta, gamma, phi = (parameters[:, i, None] for i in range(4))
    rows, months = y.shape
    level, trend, season = np.zeros((rows, 1 + STATES)), np.zeros((rows, 1 + STATES)), np.zeros((rows, SEASON, 1 + STATES))
    level[:, 1] = trend[:, 2] = 1.0
    season[:, np.arange(SEASON - 1), 3 + np.arange(SEASON - 1)] = 1.0
    errors = np.empty((rows, months, 1 + STATES))
    by_trend, by_season = alpha * beta, gamma * (1 - alpha)
    for t in range(months):
        trend = phi * trend
        level = level + trend
        e = -(level + season[:, t % SEASON])
        e[:, 0] += y[:, t]
        errors[:, t] = e
        level, trend = level + alpha * e, trend + by_trend * e
        season[:, t % SEASON] += by_season * e
    return errors, level, trend, np.roll(season, -(months % SEASON), axis=1)


def project(errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states of least squared error of each row, after a 1 for the constant, and the errors left."""
    r = errors[:, :, 1:]
    square = np.swapaxes(r, 1, 2) @ r
    square += np.eye(STATES) * (1e-10 * np.trace(square, axis1=1, axis2=2)[:, None, None] / STATES)
    states = -np.linalg.solve(square, np.swapaxes(r, 1, 2) @ errors[:, :, :1])[:, :, 0]
    states = np.column_stack([np.ones(len(states)), states])
    return states, np.einsum("rtk,rk->rt", errors, states)


def _inside(u: np.ndarray) -> np.ndarray:
    return LOW + (HIGH - LOW) / (1 + np.exp(-np.clip(u, -30, 30)))


def _outside(parameters: np.ndarray) -> np.ndarray:
    share = np.clip((parameters - LOW) / (HIGH - LOW), 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def _left(y: np.ndarray, parameters: np.ndarray) -> np.ndarray:
    """Errors after projection: y (rows, months), parameters (rows, candidates, 4) -> (rows, candidates, months)."""
    k = parameters.shape[1]
    errors, *_ = responses(np.repeat(y, k, axis=0), parameters.reshape(-1, 4))
    return project(errors)[1].reshape(len(y), k, -1)


def best_parameters(y: np.ndarray) -> np.ndarray:
    """The smoothing parameters of least squared one-step error of each series."""
    grid = np.stack([g.ravel() for g in np.meshgrid(*GRID, indexing="ij")], axis=1)
    cost = (_left(y, np.broadcast_to(grid, (len(y), *grid.shape))) ** 2).sum(2)
    first = np.argsort(cost, axis=1)[:, :STARTS]
    rows = np.repeat(y, STARTS, axis=0)
    u, least = _outside(grid[first].reshape(-1, 4)), np.take_along_axis(cost, first, 1).ravel()
    damping, step = np.full(len(u), 1e-2), 1e-4
    going = np.arange(len(u))
    for _ in range(ROUNDS):
        if not len(going):
            break
        y_, now, was = rows[going], u[going], least[going]
        around = _left(y_, _inside(now[:, None] + np.vstack([np.zeros(4), step * np.eye(4)])))
        here, slope = around[:, 0], np.swapaxes(around[:, 1:] - around[:, :1], 1, 2) / step
        square = np.swapaxes(slope, 1, 2) @ slope
        size = np.maximum(np.diagonal(square, axis1=1, axis2=2), 1e-12 * (1 + was[:, None]))
        # Three strengths of damping are tried at once; the best that helps is taken.
        strengths = damping[going, None] * np.array([0.1, 1.0, 10.0])
        system = square[:, None] + np.eye(4) * (strengths[:, :, None] * size[:, None])[:, :, None]
        moves = -np.linalg.solve(system, np.broadcast_to((np.swapaxes(slope, 1, 2) @ here[:, :, None])[:, None], (*strengths.shape, 4, 1)))[..., 0]
        tried = now[:, None] + np.clip(moves, -3, 3)
        costs = (_left(y_, _inside(tried)) ** 2).sum(2)
        pick = (np.arange(len(going)), costs.argmin(1))
        better = costs[pick] < was
        u[going[better]], least[going[better]] = tried[pick][better], costs[pick][better]
        damping[going] = np.where(better, strengths[pick], damping[going] * 10)
        # A series is done when steps gain next to nothing, or none does however short.
        gain = np.where(better, (was - costs[pick]) / np.maximum(was, 1e-300), 1.0)
        going = going[(gain > 1e-6) & (damping[going] < 1e4) & (least[going] > 1e-18)]
    best = least.reshape(-1, STARTS).argmin(1)
    return _inside(u.reshape(-1, STARTS, 4)[np.arange(len(y)), best])


def fit(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forecasts (series, horizon), parameters (series, 4) and squared errors of series of one length, two seasons at least."""
    forecasts, parameters, squares = [], [], []
    ahead = np.arange(horizon)
    for at in range(0, len(y), CHUNK):
        part = y[at : at + CHUNK]
        # Series of any size are fitted alike: about their mean, in units of their spread.
        mean, spread = part.mean(1, keepdims=True), part.std(1, keepdims=True)
        spread = np.where(spread > 0, spread, 1.0)
        scaled = (part - mean) / spread
        p = best_parameters(scaled)
        errors, level, trend, season = responses(scaled, p)
        states, left = project(errors)
        end = lambda x, s=states: np.einsum("...k,...k->...", x, s if x.ndim == 2 else s[:, None])
        damp = np.cumsum(p[:, 3, None] ** np.arange(1, horizon + 1), axis=1)
        out = end(level)[:, None] + damp * end(trend)[:, None] + end(season)[:, ahead % SEASON]
        forecasts.append(mean + spread * out)
        parameters.append(p)
        squares.append((left**2).sum(1) * spread[:, 0] ** 2)
    return np.concatenate(forecasts), np.concatenate(parameters), np.concatenate(squares)
