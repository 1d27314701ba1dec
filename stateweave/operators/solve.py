"""Solvers whose passes over the data are sums: a Gram matrix, or gradient and Hessian of a one-dimensional loss.

Sums are taken by state (see :mod:`.design`).  Rows that are few, or few when grouped, are solved on the driver; otherwise
every Newton step is one distributed sum.  Either way the driver holds matrices of the design's width only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .design import Bank, Batch, Cells, Design, Rows

Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def gram(rows: Rows, design: Design, targets: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'WX, X'WY and Y'WY in one pass."""
    return grams(rows, design, targets)[0]


def grams(rows: Rows, design: Design, targets: list[str], column: str | None = None, values: tuple[int, ...] = (0,)) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`gram` of the rows with each of some values of a column, all in one pass."""
    cells, k = Cells(design), len(targets)
    size = cells.square_size + k * cells.size + k * k

    def work(b: Batch) -> np.ndarray:
        out = []
        for v in values:
            w = b["__w"] * (b[column] == v) if column else b["__w"]
            y = np.stack([b[t] for t in targets]).astype(float) if k else np.zeros((0, b.n))
            out += [cells.raw_square(b, w), *[cells.raw_sums(b, w * x) for x in y], ((y * w) @ y.T).ravel()]
        return np.concatenate(out)

    found = []
    for part in np.split(Bank(rows, [design]).sum(work, size * len(values)), len(values)):
        xx, xy, yy = np.split(part, [cells.square_size, cells.square_size + k * cells.size])
        found.append((cells.square(xx), np.stack([cells.sums(x) for x in np.split(xy, k)], axis=1) if k else np.zeros((cells.p, 0)), yy.reshape(k, k)))
    return found


def ridge_from_gram(xx: np.ndarray, xy: np.ndarray, alpha: float, columns: np.ndarray | None = None) -> np.ndarray:
    """Coefficients for every target; the constant isn't penalised.  ``columns``: use only these (the rest get 0)."""
    use = np.arange(len(xx)) if columns is None else columns
    penalty = np.full(len(use), alpha)
    penalty[use == 0] = 0.0
    out = np.zeros((len(xx), xy.shape[1]))
    out[use] = np.linalg.solve(xx[np.ix_(use, use)] + np.diag(penalty) + 1e-10 * np.eye(len(use)), xy[use])
    return out


def squared_error(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of squared errors of coefficients on the rows behind a Gram matrix, for each target."""
    return np.diag(yy) - 2 * np.einsum("pk,pk->k", w, xy) + np.einsum("pk,pq,qk->k", w, xx, w)


# losses: value, gradient and Hessian with respect to the linear score ---------------------------------------------


def logistic(eta, y):
    p = 1 / (1 + np.exp(-np.clip(eta, -50, 50)))
    return np.maximum(0, eta) + np.log1p(np.exp(-np.abs(eta))) - y * eta, p - y, p * (1 - p)


def squared(eta, y):
    return 0.5 * (eta - y) ** 2, eta - y, np.ones_like(eta)


def huber(delta: float) -> Loss:
    def loss(eta, y):
        r = eta - y
        inside = np.abs(r) <= delta
        return np.where(inside, 0.5 * r**2, delta * (np.abs(r) - 0.5 * delta)), np.clip(r, -delta, delta), np.where(inside, 1.0, 1e-3)

    return loss


def pinball(quantile: float, width: float) -> Loss:
    """Pinball loss, quadratic within ``width`` of the corner."""

    def loss(eta, y):
        r = (y - eta) / width
        inside = np.abs(r) < 1
        value = np.where(inside, 0.25 * (r + 1) ** 2 - (1 - quantile) * r, np.maximum(quantile * r, (quantile - 1) * r)) * width
        slope = np.where(inside, 0.5 * (r + 1) - (1 - quantile), np.where(r > 0, quantile, quantile - 1.0))
        return value, -slope, np.where(inside, 0.5, 1e-3) / width

    return loss


def poisson(eta, y):
    mu = np.exp(np.clip(eta, -40, 40))
    return mu - y * eta, mu - y, mu


def gamma(eta, y):
    r = y * np.exp(-np.clip(eta, -40, 40))
    return eta + r, 1 - r, r


def tweedie(power: float) -> Loss:
    def loss(eta, y):
        e = np.clip(eta, -40, 40)
        a, b = np.exp((1 - power) * e), np.exp((2 - power) * e)
        return b / (2 - power) - y * a / (1 - power), b - y * a, (2 - power) * b - (1 - power) * y * a

    return loss


@dataclass
class Problem:
    """One of several fits on the same rows: min sum(w * loss) + l2/2 |coefficients|^2.

    ``part``: (column, value, without) takes the rows that have (or don't have) a value.
    """

    design: Design
    l2: float
    penalise_constant: bool = True
    start: np.ndarray | None = None
    part: tuple[str, int, bool] | None = None

    def weight(self, b: Batch) -> np.ndarray:
        if self.part is None:
            return b["__w"]
        column, value, without = self.part
        return b["__w"] * ((b[column] == value) != without)


def newton_many(rows: Rows, problems: list[Problem], target: str, loss: Loss, offset: str | None = None, rounds: int = 40, tolerance: float = 1e-10) -> list[np.ndarray]:
    """Solves all problems by Newton steps, halved while the objective rises.

    Every pass over the rows serves all problems that aren't done yet; the codes of their designs are read once.
    """
    cells = [Cells(p.design) for p in problems]
    bank = Bank(rows, [p.design for p in problems])
    penalty = [np.where((np.arange(c.p) > 0) | p.penalise_constant, p.l2, 1e-12) for c, p in zip(cells, problems, strict=True)]
    best = [np.zeros(c.p) if p.start is None else np.array(p.start, float) for c, p in zip(cells, problems, strict=True)]
    trial, step, halved = [b.copy() for b in best], [None] * len(problems), [0] * len(problems)
    value = [np.inf] * len(problems)
    open_ = list(range(len(problems)))
    for _ in range(rounds):
        sizes = [1 + cells[i].size + cells[i].square_size for i in open_]

        def work(b: Batch, now=tuple(open_), at=tuple(trial)) -> np.ndarray:
            out = []
            for i in now:
                w = problems[i].weight(b)
                v, g, h = loss(cells[i].score(b, at[i]) + (b[offset] if offset else 0.0), b[target])
                out += [[w @ v], cells[i].raw_sums(b, w * g), cells[i].raw_square(b, w * np.maximum(h, 1e-9))]
            return np.concatenate(out)

        sums = np.split(bank.sum(work, sum(sizes)), np.cumsum(sizes)[:-1])
        still = []
        for i, s in zip(open_, sums, strict=True):
            c, x = cells[i], trial[i]
            new = s[0] + 0.5 * penalty[i] @ x**2
            if not new <= value[i] + 1e-12 * abs(value[i]):
                halved[i] += 1
                if halved[i] < 12:
                    trial[i] = best[i] - step[i] * 0.5 ** halved[i]
                    still.append(i)
                continue
            g, h = c.sums(s[1 : 1 + c.size]) + penalty[i] * x, c.square(s[1 + c.size :]) + np.diag(penalty[i])
            better = value[i] - new
            best[i], value[i], halved[i] = x, new, 0
            step[i] = np.linalg.solve(h + 1e-12 * np.trace(h) / c.p * np.eye(c.p), g)
            if better > tolerance * max(1.0, abs(new)) and np.abs(g).max() > 1e-9:
                trial[i] = x - step[i]
                still.append(i)
            else:
                best[i] = x - step[i] if np.abs(g).max() < 1e-3 else x  # so near the optimum a last step needs no check
        open_ = still
        if not open_:
            break
    return best


def newton(rows: Rows, design: Design, target: str, loss: Loss, l2: float, penalise_constant: bool, offset: str | None = None, start: np.ndarray | None = None, rounds: int = 40) -> np.ndarray:
    """:func:`newton_many` of one problem."""
    return newton_many(rows, [Problem(design, l2, penalise_constant, start)], target, loss, offset, rounds)[0]


def logistic_l2(rows: Rows, design: Design, target: str, c: float = 1.0, start: np.ndarray | None = None) -> np.ndarray:
    """min |w|^2/2 + c * sum(weight * log loss), the constant being penalised like every coefficient."""
    return newton(rows, design, target, logistic, 1.0 / c, True, start=start)


def logistic_path(rows: Rows, designs: list[Design], target: str, cs: list[float], part: tuple[str, int, bool] | None = None) -> dict[tuple[int, float], np.ndarray]:
    """:func:`logistic_l2` of every design (by its index) at every penalty: all designs in the same passes.

    Penalties go from strong to weak, each starting from the solutions of the one before.
    """
    out: dict[tuple[int, float], np.ndarray] = {}
    start: list = [None] * len(designs)
    for c in sorted(set(cs)):
        start = newton_many(rows, [Problem(d, 1.0 / c, True, s, part) for d, s in zip(designs, start, strict=True)], target, logistic)
        out |= {(i, c): w for i, w in enumerate(start)}
    return out


def mean_losses(rows: Rows, fits: list[tuple[Design, np.ndarray]], target: str, loss: Loss, parts: list[tuple[str, int, bool] | None]) -> np.ndarray:
    """Mean loss of each fit on its part of the rows (infinite where there are none): one pass."""
    cells = [Cells(d) for d, _ in fits]

    def work(b: Batch) -> np.ndarray:
        out = []
        for c, (d, w), part in zip(cells, fits, parts, strict=True):
            own = Problem(d, 0.0, part=part).weight(b)
            out += [own @ loss(c.score(b, w), b[target])[0], own.sum()]
        return np.array(out)

    total = Bank(rows, [d for d, _ in fits]).sum(work, 2 * len(fits)).reshape(-1, 2)
    return np.where(total[:, 1] > 0, total[:, 0] / np.maximum(total[:, 1], 1e-300), np.inf)


def softmax_regression(rows: Rows, design: Design, target: str, classes: int, c: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Multinomial coefficients (width, classes) with an L2 penalty; Newton on the full Hessian.

    A full step is tried with its derivatives, halved ones by their value alone; of the Hessian one half travels.
    """
    cells, bank = Cells(design), Bank(rows, [design])
    p, pairs = cells.p, [(a, b) for a in range(classes) for b in range(a, classes)]

    def at(w: np.ndarray, derivatives: bool = True):
        def work(b: Batch) -> np.ndarray:
            z = np.stack([cells.score(b, w[:, k]) for k in range(classes)])
            z -= z.max(axis=0)
            y, weight = b[target].astype(int), b["__w"]
            lead = z[y, np.arange(b.n)]
            q = np.exp(z)
            total = q.sum(axis=0)
            value = -weight @ (lead - np.log(total))
            if not derivatives:
                return np.array([value])
            q /= total
            g = [cells.raw_sums(b, weight * (q[k] - (y == k))) for k in range(classes)]
            h = [cells.raw_square(b, weight * q[j] * ((j == k) - q[k])) for j, k in pairs]
            return np.concatenate([[value], *g, *h])

        s = bank.sum(work, 1 + classes * cells.size + len(pairs) * cells.square_size if derivatives else 1)
        value = s[0] + 0.5 * (w**2).sum() / c
        if not derivatives:
            return value
        g = np.concatenate([cells.sums(x) for x in np.split(s[1 : 1 + classes * cells.size], classes)]) + w.T.ravel() / c
        h = np.eye(p * classes) / c
        for (j, k), raw in zip(pairs, np.split(s[1 + classes * cells.size :], len(pairs)), strict=True):
            x = cells.square(raw)
            h[j * p : (j + 1) * p, k * p : (k + 1) * p] += x
            if j != k:
                h[k * p : (k + 1) * p, j * p : (j + 1) * p] += x
        return value, g, h

    w = np.zeros((p, classes))
    value, g, h = at(w)
    for _ in range(rounds):
        step = np.linalg.solve(h, g).reshape(classes, p).T
        trial, k = at(w - step), 0
        if trial[0] > value + 1e-12 * abs(value):
            k = next((k for k in range(1, 12) if at(w - step * 0.5**k, False) <= value + 1e-12 * abs(value)), None)
            if k is None:
                break
            trial = at(w - step * 0.5**k)
        w = w - step * 0.5**k
        done = value - trial[0] <= 1e-10 * max(1.0, abs(value))
        value, g, h = trial
        if done:
            break
    return w


def huber_regression(rows: Rows, design: Design, target: str, epsilon: float = 1.35, alpha: float = 1.0, offset: str | None = None, start: np.ndarray | None = None, scale: float = 1.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Coefficients and residual scale that jointly minimise sum(scale + H(r / scale) scale) + alpha |w|^2.

    H is a square up to ``epsilon`` and linear beyond.  Both are solved in turn: the coefficients by Newton steps at a
    scale, the scale in closed form from one sum over the rows.
    """
    w = np.zeros(design.width) if start is None else start
    cells, bank = Cells(design), Bank(rows, [design])
    for _ in range(rounds):
        w = newton(rows, design, target, huber(epsilon * scale), alpha * scale, False, offset=offset, start=w)

        def work(b: Batch, w=w, scale=scale) -> np.ndarray:
            r = np.abs(cells.score(b, w) + (b[offset] if offset else 0.0) - b[target])
            inside = r <= epsilon * scale
            return np.array([b["__w"] @ (inside * r**2), b["__w"] @ ~inside, b["__w"].sum()])

        squares, outside, n = bank.sum(work, 3)
        last, scale = scale, max(np.sqrt(squares / max(n - outside * epsilon**2, 0.05 * n)), 1e-9)
        if abs(scale - last) <= 1e-4 * last:
            break
    return w, float(scale)


def _softened(r: np.ndarray, low: float, high: float, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max over a in (low, high) of a r + delta (log(high - a) + log(a - low)): value, the best a, its slope in r."""
    half, size = (high - low) / 2, np.abs(r)
    root = np.sqrt(delta**2 + (half * size) ** 2)
    gap = half * delta * (1 + delta / (root + half * size)) / (delta + root)  # from the nearer bound, without cancellation
    c = half - gap
    value = (low + high) / 2 * r + c * size + delta * np.log(gap * (2 * half - gap))
    return value, (low + high) / 2 + np.sign(r) * c, 1 / (delta / gap**2 + delta / (2 * half - gap) ** 2)


def quantile_regression(rows: Rows, design: Design, target: str, quantile: float, l1: float = 0.0, offset: str | None = None, start: np.ndarray | None = None, spread: float = 1.0, accuracy: float = 1e-7, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Coefficients that minimise mean pinball loss + l1 * sum of their sizes (the constant's apart), and the gap to the optimum.

    An interior-point method for the linear programme: the multipliers of the rows stay inside their bounds by a
    logarithmic barrier, which leaves a smooth function of the coefficients alone; its Newton steps are sums over the
    rows by state, one pass each, while the barrier weakens.  The gap of the primal and the dual objective (a row's mean)
    is computed in every pass; the steps end when it is below ``accuracy`` times ``spread``, the target's scale.
    """
    cells, bank = Cells(design), Bank(rows, [design])
    p = cells.p

    def at(x: np.ndarray, delta: float):
        def work(b: Batch) -> np.ndarray:
            y, w = b[target] - (b[offset] if offset else 0.0), b["__w"]
            r = y - cells.score(b, x)
            v, a, h = _softened(r, quantile - 1, quantile, delta)
            return np.concatenate([[w.sum(), w @ v, w @ np.maximum(quantile * r, (quantile - 1) * r), w @ (a * y)], cells.raw_sums(b, w * a), cells.raw_square(b, w * h)])

        s = bank.sum(work, 4 + cells.size + cells.square_size)
        n, value, primal, dual = s[:4]
        pull, h = cells.sums(s[4 : 4 + cells.size]), cells.square(s[4 + cells.size :])
        g, free = -pull, np.arange(p) == 0
        if l1:
            v, u, curve = _softened(x[1:], -l1 * n, l1 * n, delta)
            value, primal = value + v.sum(), primal + l1 * n * np.abs(x[1:]).sum()
            g, h = g + np.append(0.0, u), h + np.diag(np.append(0.0, curve))
            dual *= min(1.0, l1 * n / max(np.abs(pull[1:]).max(initial=0.0), 1e-300))
        else:
            free[:] = True
        gap = primal - dual + np.abs(pull * x)[free].sum()
        step = np.linalg.solve(h + 1e-13 * np.trace(h) / p * np.eye(p), g)
        return value, step, float(np.sqrt(max(g @ step, 0.0) / delta)), gap / max(n, 1e-300)

    x, delta = np.zeros(p) if start is None else np.array(start, float), spread
    now = at(x, delta)
    best = (now[3], x)
    for _ in range(rounds):
        value, step, decrement, gap = now
        best = min(best, (gap, x), key=lambda t: t[0])
        if best[0] <= accuracy * spread:
            break
        if decrement < 0.3 and delta > 0.1 * accuracy * spread:  # near the barrier's optimum: a weaker barrier
            delta *= 0.2
            now = at(x, delta)
            continue
        size = 1.0
        for _ in range(20):
            trial = at(x - size * step, delta)
            if trial[0] <= value - 0.05 * size * decrement**2 * delta + 1e-12 * abs(value):
                break
            size /= 3
        else:
            break
        x, now = x - size * step, trial
    return best[1], float(best[0])


def spline_basis(thresholds: list[float], knots: int = 4) -> np.ndarray:
    """A quadratic truncated-power basis over thresholds, on a unit scale: constant, slope, square and up to ``knots`` bends."""
    t = np.asarray(thresholds, float)
    u = (t - t.min()) / (t.max() - t.min()) if len(t) > 1 and t.max() > t.min() else np.zeros(len(t))
    inner = np.linspace(0, 1, min(knots, max(0, len(t) - 3)) + 2)[1:-1]
    columns = [np.ones(len(t)), u, u**2, *[np.maximum(0, u - k) ** 2 for k in inner]][: max(1, len(t))]
    return np.column_stack(columns)


def threshold_head(rows: Rows, design: Design, labels: list[str], basis: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """One logistic head for all thresholds: coefficients (width, thresholds) that vary over thresholds along a basis.

    The score at threshold t is the design times W times the basis at t, plus an intercept of its own for each threshold
    (which is not penalised).  Newton's method on W and the intercepts; every step is one sum over the rows: a full step
    is tried with its derivatives, halved ones by their value alone.
    """
    cells, bank = Cells(design), Bank(rows, [design])
    p, k, m = design.width, basis.shape[1], len(labels)
    q = (p - 1) * k  # the constant's coefficients are the intercepts
    size = q + m

    def unpack(theta):
        return theta[:q].reshape(p - 1, k) @ basis.T, theta[q:]

    def at(theta, curvature=True):
        slope, intercept = unpack(theta)

        def work(b: Batch) -> np.ndarray:
            out = []
            for t, label in enumerate(labels):
                v, g, h = logistic(cells.score(b, np.append(intercept[t], slope[:, t])), b[label])
                out += [[b["__w"] @ v], *([cells.raw_sums(b, b["__w"] * g), cells.raw_square(b, b["__w"] * h)] if curvature else [])]
            return np.concatenate(out)

        each = 1 + cells.size + cells.square_size if curvature else 1
        penalty = np.r_[np.full(q, l2), np.full(m, 1e-9)]
        sums = bank.sum(work, each * m).reshape(m, each)
        value = sums[:, 0].sum() + 0.5 * penalty @ theta**2
        if not curvature:
            return value
        g, h = np.zeros(size), np.zeros((size, size))
        for t, s in enumerate(sums):
            x, square = cells.sums(s[1 : 1 + cells.size]), cells.square(s[1 + cells.size :])
            g[:q] += np.outer(x[1:], basis[t]).ravel()
            g[q + t] = x[0]
            h[:q, :q] += np.kron(square[1:, 1:], np.outer(basis[t], basis[t]))
            h[:q, q + t] = h[q + t, :q] = np.outer(square[1:, 0], basis[t]).ravel()
            h[q + t, q + t] = square[0, 0]
        return value, g + penalty * theta, h + np.diag(penalty)

    theta = np.zeros(size)
    value, g, h = at(theta)
    for _ in range(rounds):
        step = np.linalg.solve(h + 1e-9 * np.eye(size), g)
        trial, k_ = at(theta - step), 0
        if not trial[0] <= value + 1e-12 * abs(value):
            k_ = next((j for j in range(1, 10) if at(theta - step * 0.5**j, False) <= value + 1e-12 * abs(value)), None)
            if k_ is None:
                break
            trial = at(theta - step * 0.5**k_)
        theta = theta - step * 0.5**k_
        last = value
        value, g, h = trial
        if last - value <= 1e-8 * max(1.0, abs(value)):
            break
    slope, intercept = unpack(theta)
    return np.vstack([intercept, slope])


def affine_calibration(rows: Rows, score: str, target: str, l2: float = 1e-3, intercept_only: bool = False) -> tuple[float, float]:
    """Scale and offset of a score that minimise mean log loss + l2 (log(scale)^2 + offset^2), within bounds."""
    return _affine(Bank(rows, []), lambda b: b[score], target, l2, intercept_only)


def _affine(bank: Bank, score: Callable[[Batch], np.ndarray], target: str, l2: float, intercept_only: bool) -> tuple[float, float]:
    theta = np.zeros(2)
    free = np.array([not intercept_only, True])
    for _ in range(50):
        def work(b: Batch, theta=theta) -> np.ndarray:
            z, w = np.exp(theta[0]) * score(b), b["__w"]
            _, g, h = logistic(z + theta[1], b[target])
            j = np.column_stack([z, np.ones(b.n)])
            return np.concatenate([[w.sum()], j.T @ (w * g), (j.T @ (j * (w * h)[:, None])).ravel(), [(w * g) @ z]])

        t = bank.sum(work, 8)
        if not t[0]:
            break
        g, h = t[1:3] / t[0] + 2 * l2 * theta, t[3:7].reshape(2, 2) / t[0] + 2 * l2 * np.eye(2)
        h[0, 0] += max(0.0, t[7] / t[0])  # where the loss isn't convex in the logarithm of the scale, without that part
        step = np.where(free, np.linalg.solve(h + np.diag(np.where(free, 0, 1e12)) + 1e-6 * np.eye(2), g), 0)
        new = np.clip(theta - np.clip(step, -1.0, 1.0), [np.log(0.25), -5], [np.log(4.0), 5])
        if np.abs(new - theta).max() < 1e-9:
            break
        theta = new
    return float(np.exp(theta[0])), float(theta[1])


@dataclass
class Calibration:
    """A scale and an offset fitted to out-of-fold scores, what they gain there a row, and that gain's standard error."""

    scale: float
    offset: float
    gain: float
    error: float
    accepted: bool


def crossfitted_calibration(rows: Rows, design: Design, target: str, c: float, fold: str, folds: int, start: np.ndarray | None = None, intercept_only: bool = False, least_gain: float = 1e-4, least_signal: float = 1.0) -> Calibration:
    """Calibration of a logistic fit by scores that models of the other folds give; refused if it gains too little.

    All fold models are solved in the same passes.  The gain is the mean over rows of the log loss without less that
    with the calibration; it has to reach ``least_gain`` and ``least_signal`` standard errors of these differences.
    """
    models = newton_many(rows, [Problem(design, 1.0 / c, True, start, (fold, k, True)) for k in range(folds)], target, logistic)
    cells, bank = Cells(design), Bank(rows, [design])

    def score(b: Batch) -> np.ndarray:
        out = np.zeros(b.n)
        for k, w in enumerate(models):
            out += (b[fold] == k) * cells.score(b, w)
        return out

    scale, offset = _affine(bank, score, target, 1e-3, intercept_only)

    def work(b: Batch) -> np.ndarray:
        z, w = score(b), b["__w"]
        d = logistic(z, b[target])[0] - logistic(scale * z + offset, b[target])[0]
        return np.array([w.sum(), w @ d, w @ d**2])

    n, one, two = bank.sum(work, 3)
    gain = one / n if n else 0.0
    error = float(np.sqrt(max(0.0, two / n - gain**2) / max(n - 1, 1))) if n else 0.0
    return Calibration(scale, offset, float(gain), error, bool(gain >= least_gain and gain >= least_signal * error))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x): by the regularised incomplete gamma function."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    from math import exp, lgamma, log

    head = exp(-z + a * log(z) - lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * head)
    b, c = z + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return head * out


def output_spectrum(yy: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (descending) and directions of standardised outputs' correlations, and how many stand out of noise.

    ``yy`` is the Gram matrix of a constant and the outputs.
    """
    mean = yy[0, 1:] / n
    cov = yy[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-24))
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    values, vectors = values[::-1], vectors[:, ::-1]
    pivot = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[pivot, np.arange(len(values))])
    edge = (1 + np.sqrt(len(values) / n)) ** 2
    return values, vectors, int(min(6, np.count_nonzero(values > edge)))
