"""Dimension reduction and Gaussian mixtures, as sums over rows that can be taken part by part.

Everything fitted here is a function of sums over a group's rows: a scatter
matrix gives the axes, and each step of expectation-maximisation needs only the
mass, sum and second moments of every component.  So a group in one task and a
group in a thousand parts are fitted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

ROUNDS, TOLERANCE, RIDGE = 100, 1e-3, 1e-6


@dataclass
class Reducer:
    """Principal axes of unit-length rows: a substitute for a neighbour-graph embedding, deterministic and linear."""

    mean: np.ndarray
    axes: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (_unit(x) - self.mean) @ self.axes


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def scatter(x: np.ndarray) -> np.ndarray:
    """Number, sum and second moments of unit rows, as one array that adds up."""
    u = np.hstack((np.ones((len(x), 1)), _unit(x)))
    return u.T @ u


def axes_of(total: np.ndarray, dim: int) -> Reducer:
    """The reducer of rows with this scatter."""
    mean = total[0, 1:] / total[0, 0]
    _, vectors = np.linalg.eigh(total[1:, 1:] / total[0, 0] - np.outer(mean, mean))
    axes = vectors.T[::-1][: max(1, dim)]
    # a sign for each axis that doesn't hang on the solver
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return Reducer(mean, (axes * np.where(sign == 0, 1, sign)[:, None]).T)


def reduce_fit(x: np.ndarray, dim: int) -> Reducer:
    return axes_of(scatter(x), dim)


def _blocks(n: int, size: int = 4096) -> Iterator[slice]:
    return (slice(lo, lo + size) for lo in range(0, n, size))


def features(x: np.ndarray) -> np.ndarray:
    """One, a row's values and their products: what log densities and moments are linear in; a column for each row."""
    i, j = np.triu_indices(x.shape[1])
    return np.vstack((np.ones((1, len(x))), x.T, x.T[i] * x.T[j]))


@dataclass
class Mixture:
    mean: np.ndarray
    form: np.ndarray  # of each component: its log joint density is this times a row's features

    @property
    def k(self) -> int:
        return len(self.mean)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return np.vstack([_shares(self.form @ features(x[b]))[0].T for b in _blocks(len(x))]) if len(x) else np.zeros((0, self.k))

    def bic(self, x: np.ndarray) -> float:
        return bic_of(sum(_shares(self.form @ features(x[b]))[1] for b in _blocks(len(x))), len(x), *self.mean.shape)


def bic_of(likelihood: float, n: int, k: int, d: int) -> float:
    """Of k full-covariance components in d dimensions, from a log likelihood over n rows."""
    return float(-2 * likelihood + (k * d + k * d * (d + 1) / 2 + k - 1) * np.log(n))


def least_bic(n: int, k: int, d: int) -> float:
    """No k components have a lower BIC: as no variance is below the ridge, no density is above that of a component with it all around."""
    most = -0.5 * d * (np.log(2 * np.pi) + np.log(RIDGE))
    return bic_of(n * most, n, k, d) - 1e-6 * n * abs(most)


def _shares(z: np.ndarray, coarse: bool = False, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Responsibilities of a mixture's components, a line each, and the log likelihood, from log joints; z is written over.  coarse: to seven digits, in less time.  weight: how often each row counts."""
    top = z.max(0)
    if coarse:
        near = np.empty(z.shape, np.float32)
        np.subtract(z, top, out=near, casting="same_kind")
        np.maximum(near, -80, out=near)  # what is below is nothing beside 1, but slow
        np.exp(near, out=near)
        z[:] = near
    else:
        z -= top
        np.exp(z, out=z)
    total = z.sum(0)
    z /= total
    each = np.log(total) + top
    return z, float(each.sum() if weight is None else each @ weight)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and how often each is there.  Rows are equal if they are to some eleven decimals: those of equal vectors may differ in the last bits, by where they were reduced."""
    key = np.ascontiguousarray(np.rint(x * 2.0**36).astype(np.int64))
    _, first, n = np.unique(key.view(np.dtype((np.void, key.itemsize * key.shape[1]))).ravel(), return_index=True, return_counts=True)
    order = np.argsort(first)
    return x[first[order]], n[order].astype(float)


def spread_out(x: np.ndarray, seed: int, weight: np.ndarray | float = 1.0) -> Iterator[np.ndarray]:
    """Rows of x, drawn by their squared distance from those before, and their weight."""
    rng = np.random.default_rng(seed)
    c = x[int(rng.integers(len(x)))]
    far = ((x - c) ** 2).sum(1)
    while True:
        yield c
        p = far * weight
        p = p / p.sum() if p.sum() > 0 else np.full(len(x), 1 / len(x))
        c = x[int(rng.choice(len(x), p=p))]
        far = np.minimum(far, ((x - c) ** 2).sum(1))


def centres_of(x: np.ndarray, ks: list[int], seed: int, weight: np.ndarray | float = 1.0) -> list[np.ndarray]:
    """For each number of ks, which rise, centres of k-means; all begin from the same spread-out rows."""
    drawn, rows, out = spread_out(x, seed, weight), [], []
    for k in ks:
        rows += [next(drawn) for _ in range(k - len(rows))]
        out.append(_means(x, np.stack(rows), np.broadcast_to(weight, len(x))))
    return out


def _means(x: np.ndarray, centre: np.ndarray, weight: np.ndarray) -> np.ndarray:
    number, home = np.arange(len(centre))[:, None], None
    for _ in range(20):
        new = np.concatenate([_nearest(x[b], centre) for b in _blocks(len(x), 1 << 16)])
        if home is not None and (new == home).all():
            break
        home = new
        n, total = np.zeros((len(centre), 1)), np.zeros(centre.shape)
        for b in _blocks(len(x), 1 << 16):
            own = (home[b] == number) * weight[b]
            n += own.sum(1, keepdims=True)
            total += own @ x[b]
        centre = np.where(n > 0, total / np.maximum(n, 1), centre)
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(1)[:, None] - 2 * centre @ x.T).argmin(0)


@dataclass
class Run:
    """An expectation-maximisation run of k components: where it stands between two passes over the rows."""

    k: int
    centres: np.ndarray
    model: Mixture | None = None  # None: rows belong to their nearest centre
    likelihood: float = -np.inf
    rounds: int = 0
    done: bool = False


def moments(x: np.ndarray, runs: list[Run], of: np.ndarray | None = None, weight: np.ndarray | None = None) -> list[np.ndarray]:
    """For each run that isn't done, the log likelihood of rows x and the mass, sum and second moments of its components, as one array that adds up.  of: the rows' features, if they are at hand; weight: how often each row counts."""
    live = [r for r in runs if not r.done]
    d = x.shape[1]
    out = [np.zeros((r.k + 1, 1 + d + d * (d + 1) // 2)) for r in live]
    for b in _blocks(len(x), 1 << 10):
        own = features(x[b]) if of is None else of[:, b]
        counted = own if weight is None else own * weight[b]
        for r, total in zip(live, out, strict=True):
            if r.model is None:
                share = (_nearest(x[b], r.centres) == np.arange(r.k)[:, None]).astype(float)
            else:
                share, now = _shares(r.model.form @ own, len(x) > STACKED, None if weight is None else weight[b])
                total[-1, 0] += now
            total[:-1] += share @ counted.T
    return out


def advance(runs: list[Run], totals: list[np.ndarray], d: int) -> None:
    """Moves runs on by the moments of all rows; a run is done when its mean log likelihood rests."""
    on = []
    for run, total in zip(runs, totals, strict=True):
        if run.model is not None:
            before, run.likelihood = run.likelihood, float(total[-1, 0])
            run.rounds += 1
            run.done = run.k == 1 or run.rounds >= ROUNDS or abs(run.likelihood - before) < TOLERANCE * total[:-1, 0].sum()
        if not run.done:
            on.append((run, total[:-1]))
    if not on:
        return
    ks = [run.k for run, _ in on]
    body = np.vstack([b for _, b in on])
    mass = body[:, 0] + 10 * np.finfo(float).eps
    mean = body[:, 1 : 1 + d] / mass[:, None]
    i, j = np.triu_indices(d)
    cov = np.zeros((len(body), d, d))
    cov[:, i, j] = cov[:, j, i] = body[:, 1 + d :] / mass[:, None]
    cov -= mean[:, :, None] * mean[:, None, :]
    cov += RIDGE * np.eye(d)
    size = np.log(np.einsum("kdd->kd", np.linalg.cholesky(cov))).sum(1)
    precision = np.linalg.inv(cov)
    pull = np.matmul(precision, mean[:, :, None])[:, :, 0]
    weight = mass / np.repeat(np.add.reduceat(mass, np.cumsum([0, *ks[:-1]])), ks)
    form = np.empty(body.shape)
    form[:, 0] = np.log(weight) - size - 0.5 * (d * np.log(2 * np.pi) + (mean * pull).sum(1))
    form[:, 1 : 1 + d] = pull
    form[:, 1 + d :] = -0.5 * np.where(i == j, 1, 2) * (precision[:, i, j] + precision[:, j, i]) / 2
    at = 0
    for run, _ in on:
        run.model = Mixture(mean[at : at + run.k], form[at : at + run.k])
        at += run.k


def run_out(x: np.ndarray, runs: list[Run]) -> list[Run]:
    """Runs until all are done, over rows that are in one place."""
    of = _at_hand(x)
    while not all(r.done for r in runs):
        advance([r for r in runs if not r.done], moments(x, runs, of), x.shape[1])
    return runs


def _at_hand(x: np.ndarray) -> np.ndarray | None:
    """The rows' features, unless they are too many to be held."""
    return features(x) if len(x) <= 1 << 17 else None


def _fitted(x: np.ndarray, ks: list[int], seed: int) -> list[Run]:
    return run_out(x, [Run(k, c) for k, c in zip(ks, centres_of(x, ks, seed), strict=True)])


def mixture_fit(x: np.ndarray, k: int, seed: int) -> Mixture:
    """Full-covariance mixture by expectation-maximisation; one component is fitted in closed form."""
    return _fitted(x, [k], seed)[0].model


def numbers(n: int, max_clusters: int) -> range:
    """The numbers of components that are tried for n rows: up to min(max_clusters, n) - 1, or 1 alone."""
    return range(1, max(2, min(max_clusters, n)))


def bic_sweep(x: np.ndarray, ks: list[int], seed: int = 224) -> list[float]:
    """The BIC of each number of components, in rising order."""
    return [bic_of(r.likelihood, len(x), r.k, x.shape[1]) for r in _fitted(x, ks, seed)]


def best_number(ks: list[int], bics: list[float]) -> int:
    """The number of the least BIC, to nine decimals; the fewest if it ties."""
    return min(zip((round(b, 9) for b in bics), ks, strict=True))[1]


def _joined(body: np.ndarray, d: int) -> np.ndarray:
    """The moments of components, of which the two that lose least likelihood by it are one: by Runnalls' bound, mass times log determinant after less before."""
    i, j = np.triu_indices(len(body), 1)
    each = _spread(body, d)
    one, other = min(zip((_spread(body[i] + body[j], d) - each[i] - each[j]).tolist(), i.tolist(), j.tolist(), strict=True))[1:]
    rest = np.delete(body, other, 0)
    rest[one] += body[other]
    return rest


def _spread(body: np.ndarray, d: int) -> np.ndarray:
    """Mass times log determinant of components, by their moments."""
    mass = body[:, 0] + 10 * np.finfo(float).eps
    mean = body[:, 1 : 1 + d] / mass[:, None]
    i, j = np.triu_indices(d)
    cov = np.empty((len(body), d, d))
    cov[:, i, j] = cov[:, j, i] = body[:, 1 + d :] / mass[:, None]
    return mass * np.linalg.slogdet(cov - mean[:, :, None] * mean[:, None, :] + RIDGE * np.eye(d))[1]


def sweep_down(x: np.ndarray, ks: list[int], seed: int) -> Iterator[tuple[float, Mixture]]:
    """The BIC and the mixture of each number of components, from the most, which begin from centres of k-means, down: others begin from the moments of the number before, of which two components are joined.  Each is run until it rests, on all rows; equal ones are looked at once, with their number."""
    n, d = x.shape
    x, weight = distinct(x)
    of = _at_hand(x)
    run = Run(ks[-1], centres_of(x, ks[-1:], seed, weight)[0])
    for k in ks[::-1]:
        while not run.done:
            (total,) = moments(x, [run], of, weight)
            advance([run], [total], d)
        yield bic_of(run.likelihood, n, k, d), run.model
        if k > 1:
            run, body = Run(k - 1, run.centres), _joined(total[:-1], d)
            advance([run], [np.vstack((body, np.zeros((1, body.shape[1]))))], d)


def best_mixture(x: np.ndarray, max_clusters: int = 50, seed: int = 224) -> Mixture:
    """The mixture of the number with the least BIC of all.  Up to STACKED rows, each number begins from k-means of its own, those that cannot have it, as least_bic says, are not fitted, and the best is fitted once more from seed 0; more rows are swept down, and the best is kept as found."""
    ks, tried, bics = list(numbers(len(x), max_clusters)), [], []
    if len(x) > STACKED:
        return min(((round(bic, 9), m.k, m) for bic, m in sweep_down(x, ks, seed)), key=lambda t: t[:2])[2]
    while ks and (not bics or least_bic(len(x), ks[0], x.shape[1]) <= min(bics)):
        # a few at once, and no more than can still win
        now = [k for k in ks[: max(1, min(8, 64 // ks[0]))] if not bics or least_bic(len(x), k, x.shape[1]) <= min(bics)]
        tried, bics, ks = tried + now, bics + bic_sweep(x, now, seed), ks[len(now) :]
    return mixture_fit(x, best_number(tried, bics), 0)


#: Groups of at most so many rows are fitted many at once, in stacks of about so many rows in all.
STACKED, STACK_ROWS = 256, 1 << 13


def best_mixtures(xs: list[np.ndarray], max_clusters: int = 50, seed: int = 224) -> list[Mixture]:
    """best_mixture of each group of rows: the same steps, for small groups of about the same size at once."""
    out: list[Mixture | None] = [None] * len(xs)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, x in enumerate(xs):
        if len(x) > STACKED:
            out[i] = best_mixture(x, max_clusters, seed)
        else:
            alike.setdefault((x.shape[1], -(-len(x) // 4) if len(x) <= 16 else 4 + -(-len(x) // 16)), []).append(i)
    for ids in alike.values():
        most = max(len(xs[i]) for i in ids)
        for lo in range(0, len(ids), max(1, STACK_ROWS // most)):
            these = ids[lo : lo + max(1, STACK_ROWS // most)]
            for i, model in zip(these, _Stack([xs[i] for i in these]).best(max_clusters, seed), strict=True):
                out[i] = model
    return out


class _Stack:
    """Groups of rows, filled up with rows that count for nothing."""

    def __init__(self, xs: list[np.ndarray]):
        self.n = np.array([len(x) for x in xs])
        self.d = xs[0].shape[1]
        self.x = np.zeros((len(xs), self.n.max(), self.d))
        for to, x in zip(self.x, xs, strict=True):
            to[: len(x)] = x
        self.real = (np.arange(self.n.max()) < self.n[:, None]).astype(float)
        i, j = np.triu_indices(self.d)
        t = self.x.transpose(0, 2, 1)
        self.of = np.concatenate((self.real[:, None], t, t[:, i] * t[:, j]), 1)

    def best(self, max_clusters: int, seed: int) -> list[Mixture]:
        least, best = np.full(len(self.n), np.inf), np.ones(len(self.n), int)
        sizes = np.unique(self.n)
        drawn = self._spread_out(seed, max(numbers(n, max_clusters)[-1] for n in sizes))
        for k in numbers(sizes[-1], max_clusters):
            least_of = {n: least_bic(n, k, self.d) if k in numbers(n, max_clusters) else np.inf for n in sizes}
            live = np.flatnonzero((bound := np.array([least_of[n] for n in self.n])) <= np.where(np.isfinite(bound), least, -np.inf))
            if not len(live):
                if k > 1:
                    break
                continue
            likelihood, _, _ = self._run(live, self._means(live, drawn[live, :k]))
            bics = np.array([round(bic_of(v, n, k, self.d), 9) for v, n in zip(likelihood.tolist(), self.n[live].tolist(), strict=True)])
            won = live[bics < least[live]]
            least[live], best[won] = np.minimum(least[live], bics), k
        out: list[Mixture | None] = [None] * len(self.n)
        drawn = self._spread_out(0, best.max())
        for k in np.unique(best):
            these = np.flatnonzero(best == k)
            _, mean, form = self._run(these, self._means(these, drawn[these, :k]))
            for i, m, f in zip(these, mean, form, strict=True):
                out[i] = Mixture(m, f)
        return out

    def _spread_out(self, seed: int, most: int) -> np.ndarray:
        """As spread_out draws them: most rows of each group, which draws as choice() of a generator of its own does."""
        first, chance = {}, {}
        for n in np.unique(self.n):
            rng = np.random.default_rng(seed)
            first[n], chance[n] = int(rng.integers(n)), rng.random(most)
        each = np.arange(len(self.n))
        at = np.array([first[n] for n in self.n])
        chances = np.array([chance[n] for n in self.n])
        out = np.empty((len(self.n), most, self.d))
        far = np.full(self.real.shape, np.inf)
        for i in range(most):
            out[:, i] = c = self.x[each, at]
            far = np.minimum(far, ((self.x - c[:, None]) ** 2).sum(2)) * self.real
            total = far.sum(1, keepdims=True)
            p = np.where(total > 0, far / np.where(total > 0, total, 1), self.real / self.n[:, None])
            cdf = p.cumsum(1)
            at = np.minimum((cdf / cdf[:, -1:] <= chances[:, i, None]).sum(1), self.n - 1)
        return out

    def _nearest(self, these: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return ((centre * centre).sum(2)[:, :, None] - 2 * centre @ self.x[these].transpose(0, 2, 1)).argmin(1)

    def _means(self, these: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """_means, in rounds over the groups that still move."""
        centre = centre.copy()
        number, home, on = np.arange(centre.shape[1])[None, :, None], None, np.arange(len(these))
        for _ in range(20 if centre.shape[1] > 1 else 1):
            new = self._nearest(these[on], centre[on])
            if home is not None:
                move = (new != home).any(1)
                on, new = on[move], new[move]
                if not len(on):
                    break
            home = new
            own = (home[:, None] == number) * self.real[these[on], None]
            n = own.sum(2)[:, :, None]
            centre[on] = np.where(n > 0, own @ self.x[these[on]] / np.maximum(n, 1), centre[on])
        return centre

    def _run(self, these: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(likelihood, mean, form) of each of these groups, after expectation-maximisation from their centres."""
        k = centre.shape[1]
        likelihood, mean, form = np.empty(len(these)), np.empty(centre.shape), np.empty((len(these), k, self.of.shape[1]))
        on, of, real, before = np.arange(len(these)), self.of[these], self.real[these], np.full(len(these), -np.inf)
        share = (self._nearest(these, centre)[:, None] == np.arange(k)[None, :, None]).astype(float)
        for rounds in range(1, ROUNDS + 1):
            now_mean, now = _model(share @ of.transpose(0, 2, 1), self.d)
            z = now @ of
            top = z.max(1, keepdims=True)
            share = np.exp(z - top)
            total = share.sum(1, keepdims=True)
            share /= total
            like = ((np.log(total) + top)[:, 0] * real).sum(1)
            done = (np.abs(like - before) < TOLERANCE * self.n[these[on]]) | (k == 1) | (rounds == ROUNDS)
            if done.any():
                at = on[done]
                likelihood[at], mean[at], form[at] = like[done], now_mean[done], now[done]
                more = ~done
                on, of, real, share, like = on[more], of[more], real[more], share[more], like[more]
                if not len(on):
                    break
            before = like
        return likelihood, mean, form


def _inverted(cov: np.ndarray) -> np.ndarray:
    """The log determinants of matrices, which are along the last axis and become their negative inverses: swept by each pivot in turn, all at once."""
    swept = cov.copy()
    pivots, less = np.empty(swept.shape[1:]), np.empty(swept.shape)
    for p in range(len(swept)):
        line = swept[p].copy()
        pivot = pivots[p] = line[p]
        by = line / pivot
        swept -= np.multiply(line[:, None], by[None], out=less)
        swept[p] = swept[:, p] = by
        swept[p, p] = -1 / pivot
    cov[:] = swept
    return np.log(pivots).sum(0)


def _model(body: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, form) of mixtures by the moments of their components, as advance() takes them."""
    mass = body[:, :, 0] + 10 * np.finfo(float).eps
    mean = body[:, :, 1 : 1 + d] / mass[:, :, None]
    i, j = np.triu_indices(d)
    m = mean.reshape(-1, d).T
    cov = np.empty((d, d, m.shape[1]))
    cov[i, j] = cov[j, i] = body[:, :, 1 + d :].reshape(m.shape[1], -1).T / mass.ravel()
    cov -= m[:, None] * m[None]
    cov[np.arange(d), np.arange(d)] += RIDGE
    size = np.concatenate([_inverted(cov[:, :, at]) for at in _blocks(m.shape[1], 192)])
    pull = -(cov * m[None]).sum(1)
    form = np.empty((body.shape[2], m.shape[1]))
    form[0] = np.log(mass / mass.sum(1, keepdims=True)).ravel() - 0.5 * (size + d * np.log(2 * np.pi) + (m * pull).sum(0))
    form[1 : 1 + d] = pull
    form[1 + d :] = 0.5 * np.where(i == j, 1, 2)[:, None] * (cov[i, j] + cov[j, i]) / 2
    return mean, np.ascontiguousarray(form.T).reshape(body.shape)


def soft_labels(p: np.ndarray, threshold: float) -> list[list[int]]:
    """For each row the components whose posterior exceeds the threshold; if no row has any, each its likeliest."""
    row, label = np.nonzero(p > threshold)
    if not len(row):
        return [[j] for j in p.argmax(1).tolist()]
    out: list[list[int]] = [[] for _ in p]
    for i, j in zip(row.tolist(), label.tolist(), strict=True):
        out[i].append(j)
    return out
