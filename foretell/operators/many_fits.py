"""Many penalised logistic models fitted at once: every pass over the rows moves all of them one Newton step.

Each model has its own columns, fold, penalty and weights of classes; all read
the same blocks. A pass sums losses, gradients and curvatures of the models
that are still moving; models whose gradient has vanished are retired. The
objective, C x the summed loss + half the squared weights with free
intercepts, is convex, so a full step that doesn't lower it is halved and
tried again in the next pass, while the other models go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from foretell.operators.blocks import Blocks

#: A model rests when no gradient, divided by C x its rows, is above this.
TOLERANCE = 1e-9
MAX_PASSES = 100


@dataclass
class Fit:
    """One model: places of its columns among those of the blocks, how they are encoded, its training rows, classes and penalty."""

    at: np.ndarray
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    limit: float
    classes: list[int]
    counts: np.ndarray
    c: float = 1.0
    weights: np.ndarray | None = None
    w: np.ndarray = field(default=None)
    converged: bool = False
    passes: int = 0

    @property
    def free(self) -> int:
        """Classes with weights of their own; of two classes only the second has."""
        return len(self.classes) if len(self.classes) > 2 else 1

    @property
    def shape(self) -> tuple[int, int]:
        return self.free, len(self.at) + 1

    def begin(self) -> np.ndarray:
        w = np.zeros(self.shape)
        share = np.log(self.counts / self.counts.sum())
        w[:, -1] = share - share.mean() if self.free > 1 else share[1] - share[0]
        return w


def _sums(fit: Fit, w: np.ndarray, x: np.ndarray, y: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Loss, gradient and the upper triangle of the curvature, unpenalised, of one model over one block."""
    k, d = fit.shape
    rows = (place < fit.limit) & np.isin(y, fit.classes)
    part = x[rows][:, fit.at]
    design = np.empty((len(part), d))
    design[:, :-1] = (np.where(np.isnan(part), fit.fill, part) - fit.mean) / fit.scale
    design[:, -1] = 1.0
    label = np.searchsorted(fit.classes, y[rows])
    weight = np.ones(len(part)) if fit.weights is None else fit.weights[label]
    scores = np.zeros((len(part), max(k, 2)))
    scores[:, -k:] = design @ w.T
    top = scores.max(axis=1, keepdims=True)
    grown = np.exp(scores - top)
    total = grown.sum(axis=1, keepdims=True)
    loss = weight @ (np.log(total[:, 0]) + top[:, 0] - scores[np.arange(len(part)), label])
    p = (grown / total)[:, -k:]
    hit = label[:, None] == np.arange(max(k, 2))[None, -k:]
    slope = ((p - hit) * weight[:, None]).T @ design
    product = lambda share: ((design * share[:, None]).T @ design).reshape(-1)
    if k == 1:
        return np.concatenate([[loss], slope.reshape(-1), product(weight * p[:, 0] * (1 - p[:, 0]))])
    # Chances add up to one, so a class's own curvature is what the pairs it is in take away: only pairs are multiplied out.
    curve = {(i, j): product(-weight * p[:, i] * p[:, j]) for i in range(k) for j in range(i + 1, k)}
    curve |= {(i, i): -sum(c for pair, c in curve.items() if i in pair) for i in range(k)}
    return np.concatenate([[loss], slope.reshape(-1), *[curve[i, j] for i in range(k) for j in range(i, k)]])


def _opened(fit: Fit, sums: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The penalised objective with its gradient and curvature."""
    k, d = fit.shape
    bare = np.ones(d)
    bare[-1] = 0.0
    value = fit.c * sums[0] + 0.5 * float((w * w * bare).sum())
    slope = fit.c * sums[1 : 1 + k * d].reshape(k, d) + w * bare
    curve = np.zeros((k, d, k, d))
    parts = iter(sums[1 + k * d :].reshape(-1, d, d))
    for i in range(k):
        for j in range(i, k):
            curve[i, :, j, :] = curve[j, :, i, :] = fit.c * next(parts)
        curve[i, :, i, :] += np.diag(bare)
    return value, slope, curve.reshape(k * d, k * d)


def fit_many(blocks: Blocks, fits: dict[object, Fit], max_passes: int = MAX_PASSES, progress: Callable[[int, int], None] | None = None) -> dict[object, Fit]:
    """``fits`` with their weights found; ``converged`` says of which the gradient vanished within ``max_passes``."""
    state = {key: {"at": fit.begin(), "step": None, "share": 1.0, "value": np.inf} for key, fit in fits.items()}
    moving = list(fits)
    for number in range(1, max_passes + 1):
        if not moving:
            break
        tried = [(fits[key], state[key]["at"] if state[key]["step"] is None else state[key]["at"] - state[key]["share"] * state[key]["step"]) for key in moving]
        found = blocks.sums(lambda x, y, place, tried=tried: np.concatenate([_sums(fit, w, x, y, place) for fit, w in tried]))
        start, before = 0, len(moving)
        for key, (fit, w) in zip(list(moving), tried, strict=True):
            k, d = fit.shape
            size = 1 + k * d + k * (k + 1) // 2 * d * d
            value, slope, curve = _opened(fit, found[start : start + size], w)
            start += size
            mine = state[key]
            fit.passes = number
            small = np.abs(slope).max() / (fit.c * fit.counts.sum()) < TOLERANCE
            if mine["step"] is not None and not small and not value <= mine["value"] + 1e-12 * abs(mine["value"]):
                mine["share"] /= 2
                if mine["share"] < 1e-6:  # rounding: no lower point along the step
                    moving.remove(key)
                continue
            mine.update(at=w, value=value, share=1.0)
            if small:
                fit.converged = True
                moving.remove(key)
                continue
            # Intercepts are free up to a common shift, which the shortest solution leaves out.
            flat = np.zeros(k * d)
            flat[d - 1 :: d] = 1.0 if k > 1 else 0.0
            scale = np.trace(curve) / len(curve)
            mine["step"] = np.linalg.solve(curve + scale * np.outer(flat, flat), slope.reshape(-1)).reshape(k, d)
        if progress:
            for done in range(len(fits) - before + 1, len(fits) - len(moving) + 1):
                progress(done, len(fits))
    for key, fit in fits.items():
        fit.w = state[key]["at"]
    return fits
