"""The leading eigenpairs of a symmetric matrix of which only products with blocks are known, by Jacobi-Davidson.

A search space holds orthonormal vectors and their products. Rayleigh-Ritz gives the pairs of largest Ritz value; those whose
residual reaches double precision, in falling order, are locked, and the space is kept orthogonal to them. For the others the
correction equation (I - QQ')(A - theta I)(I - QQ') t = -r, Q being the locked vectors and the pair's own, is solved by a few
steps of MINRES. All pairs go in lockstep, so one product serves a step of each. All matrices here have as many rows as a
vector has entries; nothing grows with the number of vectors in the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPS = float(np.finfo(float).eps)
Product = Callable[[np.ndarray], np.ndarray]


def orthonormal(new: np.ndarray, against: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """What the columns of new add to those of against; columns that add nothing go."""
    out = np.zeros((new.shape[0], 0))
    for v in new.T:
        if not (size := np.linalg.norm(v)):
            continue
        v, all_ = v / size, np.hstack([against, out])
        for _ in range(3):
            v = v - all_ @ (all_.T @ v)
            if (left := np.linalg.norm(v)) < floor:
                break
            v = v / left
        else:
            out = np.hstack([out, v[:, None]])
    return out


def minres(times: Product, rhs: np.ndarray, project: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Columns t with project((A - shift) t) near rhs, all in the range of project: MINRES, column by column in lockstep. Ends
    after so many steps or when every residual is below goal times its start."""
    k, x = rhs.shape[1], np.zeros_like(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    start, live = beta.copy(), beta > 0
    v, v_old = rhs / np.where(live, beta, 1), np.zeros_like(rhs)
    w, w_old = np.zeros_like(rhs), np.zeros_like(rhs)
    c, c_old, s, s_old, eta, beta = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k), beta.copy(), np.zeros(k)
    for _ in range(steps):
        if not live.any():
            break
        u = np.zeros_like(rhs)
        u[:, live] = times(v[:, live])
        u = project(u - shifts * v)
        alpha = (v * u).sum(axis=0)
        u = project(u - alpha * v - beta * v_old)
        beta_new = np.linalg.norm(u, axis=0)
        # the new column of the tridiagonal matrix under the last two rotations, then its own
        r1, r2, r3 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        size = np.hypot(r1, beta_new)
        live &= size > 0
        safe = np.where(live, size, 1)
        c_new, s_new = r1 / safe, beta_new / safe
        w_new = np.where(live, (v - r3 * w_old - r2 * w) / safe, 0)
        x += np.where(live, c_new * eta * w_new, 0)
        eta = -s_new * eta
        live &= (np.abs(eta) > goal * start) & (beta_new > EPS * np.abs(shifts))
        v_old, v = v, np.where(beta_new > 0, u / np.where(beta_new > 0, beta_new, 1), 0)
        w_old, w, c_old, c, s_old, s, beta = w, w_new, c, c_new, s, s_new, beta_new
    return x


def leading(times: Product, d: int, wanted: int, seed: int = 0, inner: int = 12, most: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, falling; unit vectors as columns; residual norms) of the `wanted` largest eigenpairs, or of all if d is less."""
    rng = np.random.default_rng(seed)
    wanted, guard = min(wanted, d), min(wanted + 2, d)
    width = min(d, 4 * guard + wanted)  # of the search space before a restart
    locked, pairs = np.zeros((d, 0)), []
    space, image = np.zeros((d, 0)), np.zeros((d, 0))
    new = orthonormal(rng.standard_normal((d, min(d, guard + 2))), locked)
    began = 0
    for turn in range(most):
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, times(new)])
        h = space.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        keep = min(space.shape[1], max(guard, 2 * wanted))
        top = min(guard - len(pairs), space.shape[1])
        u, au = space @ y[:, :top], image @ y[:, :top]
        r = au - u * theta[:top]
        norms = np.linalg.norm(r, axis=0)
        scale = max(abs(theta[0]), *(abs(p[0]) for p in pairs), np.finfo(float).tiny)
        whole = space.shape[1] + locked.shape[1] >= d
        tol = 16 * EPS * np.sqrt(d) * scale
        done = 0
        while done < top and len(pairs) + done < wanted and (norms[done] <= tol or whole):
            done += 1
        if done:
            fresh = times(u[:, :done])  # not what rounding has left of it
            for i in range(done):
                pairs.append((float(u[:, i] @ fresh[:, i]), u[:, i], float(np.linalg.norm(fresh[:, i] - (u[:, i] @ fresh[:, i]) * u[:, i]))))
            locked = np.stack([p[1] for p in pairs], axis=1)
            space, image = space @ y[:, done:], image @ y[:, done:]
        if len(pairs) >= wanted or not space.shape[1]:
            break
        if done:
            new, began = np.zeros((d, 0)), began + 1
            continue
        if space.shape[1] + (guard - len(pairs)) > width and not whole:  # thick restart
            space, image = space @ y[:, :keep], image @ y[:, :keep]
        if turn - began < 2:  # no pair is near yet: the products themselves widen the space
            new = orthonormal(image @ y[:, :guard] if not (space.shape[1] == keep) else image[:, :guard], np.hstack([locked, space]))
            if new.shape[1]:
                continue
        active = [i for i in range(top) if norms[i] > tol]

        def project(z: np.ndarray, own: np.ndarray = u[:, active]) -> np.ndarray:
            for _ in range(2):
                z = z - locked @ (locked.T @ z)
                z = z - own * (own * z).sum(axis=0)
            return z

        t = minres(times, -project(r[:, active]), project, theta[active], inner, 0.02)
        new = orthonormal(t, np.hstack([locked, space]))
        if not new.shape[1]:
            new = orthonormal(rng.standard_normal((d, 1)), np.hstack([locked, space]))
    else:
        raise ArithmeticError("no convergence")
    pairs.sort(key=lambda p: -p[0])
    return np.array([p[0] for p in pairs]), np.stack([p[1] for p in pairs], axis=1), np.array([p[2] for p in pairs])
