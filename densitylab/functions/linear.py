"""Solvers of ridge systems: small dense ones, and conjugate gradients that only ask for products with the kernel."""

from __future__ import annotations

from collections.abc import Callable, Generator

import numpy as np


class SolverError(ValueError):
    pass


def dual_ridge(kernel: np.ndarray, cross: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Predictions of kernel ridge regression with the training mean as intercept."""
    if not (np.isfinite(alpha) and alpha > 0):
        raise SolverError(f"penalty must be positive and finite, not {alpha}")
    level = y.mean()
    system = kernel.copy()
    system.flat[:: len(y) + 1] += alpha
    found = jittered_cholesky(system)
    if found is None:
        raise SolverError("the system has no factor")
    return level + cross @ np.linalg.solve(found[0].T, np.linalg.solve(found[0], y - level))


def primal_ridge(z: np.ndarray, z_new: np.ndarray, y: np.ndarray, alpha: float, scale: float) -> np.ndarray:
    """The same predictions through the markers' normal equations, for few markers."""
    level = y.mean()
    left = z.T @ z / scale
    left.flat[:: left.shape[0] + 1] += alpha
    return level + z_new @ (np.linalg.solve(left, z.T @ (y - level)) / scale)


Solved = tuple[np.ndarray, np.ndarray, np.ndarray]


def shifted(y: np.ndarray, shift: np.ndarray, residual: float = 1e-8, most: int = 2000) -> Generator[np.ndarray, np.ndarray, Solved]:
    """Weights, relative residuals and steps for (K + c I) a = y - mean, all shifts c from one Krylov space.

    Yields columns d and is sent K d; the kernel may be anywhere.  Conjugate gradients run for the least shift, whose
    directions are asked for, one column a step; the other systems follow by recurrences of the ratios of their residuals,
    so that more penalties cost no more products.  A system stops at a tenth of the limit.
    The last question is always K a for all shifts, and the true residuals are judged by its answer; systems
    that fall short are refined by a few further rounds on what is left.
    """
    n, shift = len(y), np.asarray(shift, float)
    if np.any(~np.isfinite(shift)) or np.any(shift <= 0):
        raise SolverError("penalties must be positive and finite")
    target = y - y.mean()
    size = np.linalg.norm(target)
    if size == 0:
        yield np.zeros((n, len(shift)))
        return np.zeros((n, len(shift))), np.zeros(len(shift)), np.zeros(len(shift), int)
    a, steps = yield from _family(target, shift, 0.1 * residual * size, most)
    for _ in range(4):
        left = target[:, None] - (yield a) - shift * a
        true = np.linalg.norm(left, axis=0) / size
        short = np.flatnonzero(~(true <= residual))
        if not len(short):
            return a, true, steps
        for k in short:
            more, further = yield from _family(left[:, k], shift[k : k + 1], 0.1 * residual * size, most)
            a[:, k] += more[:, 0]
            steps[k] += further[0]
    raise SolverError(f"residual {true.max():.3g} is over {residual:.3g}")


def shifted_by_marker(target: np.ndarray, size: float, trace: float, shift: np.ndarray, residual: float = 1e-8, most: int = 2000) -> Generator[np.ndarray, np.ndarray, Solved]:
    """u = A' a of (A A' + c I) a = t for all shifts c, from (A' A + c I) u = A' t: as many numbers as A has columns.

    ``target`` is A' t, ``size`` the norm of t, ``trace`` that of A' A.  Yields columns d and is sent A' A d.  Residuals are those of a = (t - A u) / c,
    as in ``shifted``: with r what is left of u's equations, they are A r / c, whose norm the last question gives.
    """
    shift = np.asarray(shift, float)
    if np.any(~np.isfinite(shift)) or np.any(shift <= 0):
        raise SolverError("penalties must be positive and finite")
    if size == 0:
        return np.zeros((len(target), len(shift))), np.zeros(len(shift)), np.zeros(len(shift), int)
    limit = 0.1 * residual * size * shift / np.sqrt(trace)
    u, steps = yield from _family(target, shift, limit, most)
    for _ in range(5):
        left = target[:, None] - (yield u) - shift * u
        true = np.sqrt(np.maximum((left * (yield left)).sum(0), 0)) / (shift * size)
        short = np.flatnonzero(~(true <= residual))
        if not len(short):
            return u, true, steps
        for k in short:
            more, further = yield from _family(left[:, k], shift[k : k + 1], limit[k], most)
            u[:, k] += more[:, 0]
            steps[k] += further[0]
    raise SolverError(f"residual {true.max():.3g} is over {residual:.3g}")


def _family(b: np.ndarray, shift: np.ndarray, limit: float | np.ndarray, most: int) -> Generator[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(K + c I) a = b for all shifts c until the recurrences' residuals are under ``limit``."""
    base, m = float(shift.min()), len(shift)
    more, limit = shift - base, np.broadcast_to(limit, m)
    a, along = np.zeros((len(b), m)), np.repeat(b[:, None], m, axis=1)
    r, d = b.copy(), b.copy()
    rho = r @ r
    now, before = np.ones(m), np.ones(m)  # residual of a shift = its ratio x the base residual
    stride_before, turn = 1.0, 0.0
    steps, active = np.zeros(m, int), np.sqrt(rho) > limit
    for _ in range(most):
        if not active.any():
            break
        q = (yield d[:, None])[:, 0] + base * d
        bend = d @ q
        if not (np.isfinite(bend) and bend > 0):
            raise SolverError("the system isn't positive definite")
        stride = rho / bend
        k = np.flatnonzero(active)
        later = now[k] * before[k] * stride_before / (stride * turn * (before[k] - now[k]) + before[k] * stride_before * (1 + more[k] * stride))
        ratio = later / now[k]
        a[:, k] += stride * ratio * along[:, k]
        r = r - stride * q
        fresh = r @ r
        turn, stride_before = fresh / rho, stride
        along[:, k] = later * r[:, None] + turn * ratio**2 * along[:, k]
        d, rho = r + turn * d, fresh
        before[k], now[k] = now[k], later
        steps[k] += 1
        active[k] = np.abs(later) * np.sqrt(rho) > limit[k]
    return a, steps


def driven(solver: Generator[np.ndarray, np.ndarray, Solved], multiply: Callable[[np.ndarray], np.ndarray]) -> Solved:
    try:
        d = next(solver)
        while True:
            d = solver.send(multiply(d))
    except StopIteration as end:
        return end.value


def conjugate_grid(kernel: np.ndarray, y: np.ndarray, ratios: list[float], residual: float = 1e-8, most: int = 2000) -> Solved:
    """``shifted`` for (K + n r I) a = y - mean with a kernel at hand."""
    return driven(shifted(y, len(y) * np.asarray(ratios, float), residual, most), lambda d: kernel @ d)


def jittered_cholesky(kernel: np.ndarray, first: float = 1e-10, last: float = 1e-4) -> tuple[np.ndarray, float] | None:
    """Factor of the kernel plus the least workable jitter (x mean diagonal, by tens), or None."""
    level, jitter = np.trace(kernel) / len(kernel), 0.0
    while jitter <= last * (1 + 1e-9):
        try:
            return np.linalg.cholesky(kernel + jitter * level * np.eye(len(kernel))), jitter
        except np.linalg.LinAlgError:
            jitter = first if jitter == 0 else 10 * jitter
    return None
