"""Estimators that are fitted on one dataset's cases in memory, by name.

A model has fit(x, y) and predict(x); classifiers have labels and proba(x) too. x is a matrix
of series of one length. Models run inside a group of an experiment, where a dataset fits one task.
"""

from __future__ import annotations

import numpy as np

from chronoloom.functions import catch22, distances, kernels
from chronoloom.functions.arrays import random_intervals


class Dummy:
    """The share of each label, or the mean target."""

    def __init__(self, classes: bool = True):
        self.classes = classes

    def fit(self, x, y):
        self.labels, n = np.unique(y, return_counts=True)
        self.share, self.mean = n / len(y), float(np.mean(y)) if not self.classes else None
        return self

    def proba(self, x):
        return np.tile(self.share, (len(x), 1))

    def predict(self, x):
        return np.full(len(x), self.mean) if not self.classes else self.labels[self.proba(x).argmax(axis=1)]


class Neighbours:
    """The k nearest cases by a named distance; mean target or share of labels. The first is taken at a tie."""

    def __init__(self, distance: str = "euclidean", k: int = 1, classes: bool = True, **parameters):
        self.distance, self.k, self.classes, self.parameters = distance, k, classes, parameters

    def fit(self, x, y):
        self.x, self.y, self.labels = x, y, np.unique(y)
        return self

    def _nearest(self, x):
        return np.argsort(matrix(x, self.x, self.distance, **self.parameters), axis=1, kind="stable")[:, : self.k]

    def proba(self, x):
        return (self.y[self._nearest(x)][:, :, None] == self.labels).mean(axis=1)

    def predict(self, x):
        return self.labels[self.proba(x).argmax(axis=1)] if self.classes else self.y[self._nearest(x)].mean(axis=1)


def matrix(x: np.ndarray, y: np.ndarray, distance: str, **parameters) -> np.ndarray:
    """Distances of all rows of x to all rows of y, a row of x at a time."""
    if distance in ("euclidean", "squared"):
        d = np.array([((y - a) ** 2).sum(axis=1) for a in x]).reshape(len(x), len(y))
        return np.sqrt(d) if distance == "euclidean" else d
    if distance == "minkowski":
        p = parameters.get("p", 2.0)
        return np.array([(np.abs(y - a) ** p).sum(axis=1) ** (1 / p) for a in x]).reshape(len(x), len(y))
    parameters = distances.DEFAULTS.get(distance, {}) | parameters
    return np.array([distances.ELASTIC[distance](np.repeat(a[None], len(y), axis=0), y, **parameters) for a in x]).reshape(len(x), len(y))


class Ridge:
    """Ridge regression on standardised features; classes as one column of -1 and 1 each. The penalty with the least leave-one-out error wins."""

    def __init__(self, features=None, classes: bool = True, penalties=tuple(10.0**k for k in range(-3, 4))):
        self.features, self.classes, self.penalties = features or Raw(), classes, penalties

    def fit(self, x, y):
        a = self.features.fit(x, y).make(x)
        self.mean, self.scale = a.mean(axis=0), np.where(a.std(axis=0) > 1e-9, a.std(axis=0), 1.0)
        a = (a - self.mean) / self.scale
        self.labels = np.unique(y)
        t = (y[:, None] == self.labels) * 2.0 - 1 if self.classes else np.asarray(y, float)[:, None]
        self.base = t.mean(axis=0)
        w, v = np.linalg.eigh(a @ a.T)
        best = None
        for p in self.penalties:
            inverse = (v / (np.maximum(w, 0) + p)) @ v.T
            dual = inverse @ (t - self.base)
            error = float(((dual / np.diag(inverse)[:, None]) ** 2).mean())
            if best is None or error < best[0]:
                best = (error, a.T @ dual)
        self.weights = best[1]
        return self

    def _scores(self, x):
        return ((self.features.make(x) - self.mean) / self.scale) @ self.weights + self.base

    def proba(self, x):
        s = self._scores(x)
        return (s == s.max(axis=1, keepdims=True)) * 1.0

    def predict(self, x):
        s = self._scores(x)
        return self.labels[s.argmax(axis=1)] if self.classes else s[:, 0]


class Forest:
    """Trees grown on bootstrap samples, the best of random cuts on a random few features at each node; votes or means."""

    def __init__(self, features=None, classes: bool = True, trees: int = 100, seed: int = 0):
        self.features, self.classes, self.trees, self.seed = features or Raw(), classes, trees, seed

    def fit(self, x, y):
        rng = np.random.default_rng(self.seed)
        a = np.nan_to_num(self.features.fit(x, y).make(x))
        self.labels = np.unique(y)
        t = (y[:, None] == self.labels) * 1.0 if self.classes else np.asarray(y, float)[:, None]
        self.grown = [self._grow(a, t, rng.integers(len(a), size=len(a)), rng) for _ in range(self.trees)]
        return self

    def _grow(self, a, t, rows, rng):
        """Nested (feature, cut, left, right), or the mean target of a leaf."""
        here = t[rows]
        if len(rows) < 2 or (here == here[0]).all():
            return here.mean(axis=0)
        best = None
        for j in rng.choice(a.shape[1], max(1, int(np.sqrt(a.shape[1]))), replace=False).tolist():
            v = a[rows, j]
            for cut in rng.uniform(v.min(), v.max(), 4) if v.max() > v.min() else ():
                left = v <= cut
                spread = here[left].var(axis=0).sum() * left.sum() + here[~left].var(axis=0).sum() * (~left).sum() if 0 < left.sum() < len(v) else np.inf
                if spread < np.inf and (best is None or spread < best[0]):
                    best = (spread, j, cut, left)
        if best is None:
            return here.mean(axis=0)
        _, j, cut, left = best
        return (j, cut, self._grow(a, t, rows[left], rng), self._grow(a, t, rows[~left], rng))

    def _mean(self, x):
        a, out = np.nan_to_num(self.features.make(x)), 0.0
        for tree in self.grown:
            got = np.zeros((len(a), len(self.labels) if self.classes else 1))
            todo = [(tree, np.arange(len(a)))]
            while todo:
                node, rows = todo.pop()
                if isinstance(node, tuple):
                    left = a[rows, node[0]] <= node[1]
                    todo += [(node[2], rows[left]), (node[3], rows[~left])]
                else:
                    got[rows] = node
            out = out + got / len(self.grown)
        return out

    def proba(self, x):
        return self._mean(x)

    def predict(self, x):
        m = self._mean(x)
        return self.labels[m.argmax(axis=1)] if self.classes else m[:, 0]


class Raw:
    """The points themselves."""

    def fit(self, x, y):
        return self

    def make(self, x):
        return x


class Made(Raw):
    """Features of each series by a function of one series."""

    def __init__(self, function):
        self.function = function

    def make(self, x):
        return np.nan_to_num(np.array([self.function(s) for s in x], float))


class Intervals(Raw):
    """Mean, deviation and slope, and with ``more`` median, least and greatest value, of random intervals."""

    def __init__(self, n: int | None = None, more: bool = False, seed: int = 0):
        self.n, self.more, self.seed = n, more, seed

    def fit(self, x, y):
        self.at = random_intervals(x.shape[1], self.n or max(1, int(np.sqrt(x.shape[1]))) * 10, seed=self.seed)
        return self

    def make(self, x):
        out = []
        for a, b in self.at:
            s, t = x[:, a:b], np.arange(b - a) - (b - a - 1) / 2
            out += [s.mean(axis=1), s.std(axis=1), s @ t / max((t * t).sum(), 1e-9)]
            out += [np.median(s, axis=1), s.min(axis=1), s.max(axis=1)] if self.more else []
        return np.stack(out, axis=1)


class RandomKernels(Raw):
    """Random convolution kernels: share of positive outputs and maximum."""

    def __init__(self, n: int = 500, seed: int = 0):
        self.n, self.seed = n, seed

    def fit(self, x, y):
        rng, m = np.random.default_rng(self.seed), x.shape[1]
        self.kernels = []
        for _ in range(self.n):
            size = min(int(rng.choice((7, 9, 11))), m)
            w = rng.normal(size=size)
            dilation = int(2 ** rng.uniform(0, np.log2(max(1.0, (m - 1) / max(size - 1, 1)))))
            self.kernels.append((w - w.mean(), rng.uniform(-1, 1), dilation, (size - 1) * dilation // 2 if rng.integers(2) else 0))
        return self

    def make(self, x):
        out = []
        for w, bias, dilation, pad in self.kernels:
            p = np.pad(x, ((0, 0), (pad, pad)))
            m = p.shape[1] - (len(w) - 1) * dilation
            c = sum(w[k] * p[:, k * dilation : k * dilation + m] for k in range(len(w))) + bias
            out += [(c > 0).mean(axis=1), c.max(axis=1)]
        return np.stack(out, axis=1)


class FixedKernels(Raw):
    """The 84 kernels of fixed weights: share of outputs above quantiles."""

    def __init__(self, features: int = 1000, seed: int = 0):
        self.features, self.seed = features, seed

    def fit(self, x, y):
        self.model = kernels.fit(x, self.features, self.seed)
        return self

    def make(self, x):
        return kernels.apply(x, self.model)


def _summary(s):
    return [s.mean(), s.std(), s.min(), s.max(), *np.quantile(s, (0.25, 0.5, 0.75))]


def _canonical(s):
    return list(catch22.features(s).values())


_DISTANCES = ["euclidean", "squared", "minkowski", *distances.ELASTIC]


def _both(classes: bool) -> dict:
    """Names of classifiers or regressors, in lower case, each a function of a seed."""
    kind = "classifier" if classes else "regressor"
    c = {"classes": classes}
    out = {
        f"dummy{kind}": lambda seed: Dummy(**c), "dummy": lambda seed: Dummy(**c), "rocket": lambda seed: Ridge(RandomKernels(seed=seed), **c),
        "minirocket": lambda seed: Ridge(FixedKernels(seed=seed), **c), "ridgecv": lambda seed: Ridge(**c), "ridge": lambda seed: Ridge(**c),
        "randomforest": lambda seed: Forest(seed=seed, **c), "randf": lambda seed: Forest(seed=seed, **c), "catch22": lambda seed: Forest(Made(_canonical), seed=seed, **c),
        "summary": lambda seed: Forest(Made(_summary), seed=seed, **c), "tsf": lambda seed: Forest(Intervals(seed=seed), seed=seed, **c),
        "timeseriesforest" + kind: lambda seed: Forest(Intervals(seed=seed), seed=seed, **c), "randomintervals": lambda seed: Forest(Intervals(100, True, seed), seed=seed, **c),
    }
    out |= {f"{n}{kind}": out[n] for n in ("rocket", "minirocket", "catch22", "summary", "ridge", "randomforest")} | {f"randominterval{kind}": out["randomintervals"]}
    for d in _DISTANCES:
        for k in (1, 5):
            out[f"{k}nn-{d}"] = lambda seed, d=d, k=k: Neighbours(d, k, **c)
    out |= {"1nn-ed": out["1nn-euclidean"], "5nn-ed": out["5nn-euclidean"], "kneighborstimeseries" + kind: out["1nn-dtw"]}
    return out


CLASSIFIERS, REGRESSORS = _both(True), _both(False)


class Medoids:
    """k-medoids by a named distance: members go to the nearest medoid, medoids to the member with the least total, until nothing moves."""

    def __init__(self, distance: str = "euclidean", k: int = 2, seed: int = 0, rounds: int = 100, **parameters):
        self.distance, self.k, self.seed, self.rounds, self.parameters = distance, k, seed, rounds, parameters

    def fit(self, x, y=None):
        d, rng = matrix(x, x, self.distance, **self.parameters), np.random.default_rng(self.seed)
        best = None
        for _ in range(5):
            at = rng.choice(len(x), min(self.k, len(x)), replace=False)
            for _ in range(self.rounds):
                own = d[:, at].argmin(axis=1)
                new = np.array([np.flatnonzero(own == c)[d[np.ix_(own == c, own == c)].sum(axis=0).argmin()] if (own == c).any() else at[c] for c in range(len(at))])
                if (new == at).all():
                    break
                at = new
            cost = d[:, at].min(axis=1).sum()
            if best is None or cost < best[0]:
                best = (cost, at)
        self.medoids = x[best[1]]
        return self

    def predict(self, x):
        return matrix(x, self.medoids, self.distance, **self.parameters).argmin(axis=1)


class Means:
    """k-means by squared Euclidean distance of features, the best of ten starts."""

    def __init__(self, features=None, k: int = 2, seed: int = 0, rounds: int = 300):
        self.features, self.k, self.seed, self.rounds = features or Raw(), k, seed, rounds

    def fit(self, x, y=None):
        a, rng = self.features.fit(x, y).make(x), np.random.default_rng(self.seed)
        self.shift, self.scale = (a.mean(axis=0), np.where(a.std(axis=0) > 1e-9, a.std(axis=0), 1.0)) if not type(self.features) is Raw else (0.0, 1.0)
        a, best = (a - self.shift) / self.scale, None
        for _ in range(10):
            centres = a[rng.choice(len(a), min(self.k, len(a)), replace=False)]
            for _ in range(self.rounds):
                own = matrix(a, centres, "squared").argmin(axis=1)
                new = np.array([a[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
                if np.allclose(new, centres):
                    break
                centres = new
            cost = matrix(a, centres, "squared").min(axis=1).sum()
            if best is None or cost < best[0]:
                best = (cost, centres)
        self.centres = best[1]
        return self

    def predict(self, x):
        return matrix((self.features.make(x) - self.shift) / self.scale, self.centres, "squared").argmin(axis=1)


#: Names of clusterers, in lower case, each a function of the number of clusters and a seed.
CLUSTERERS = {
    "dummyclusterer": lambda k, seed: Means(k=1), "kmeans-ed": lambda k, seed: Means(k=k, seed=seed), "kmeans-euclidean": lambda k, seed: Means(k=k, seed=seed),
    "catch22": lambda k, seed: Means(Made(_canonical), k, seed), "catch22clusterer": lambda k, seed: Means(Made(_canonical), k, seed),
    "summary": lambda k, seed: Means(Made(_summary), k, seed), "summaryclusterer": lambda k, seed: Means(Made(_summary), k, seed),
    "rclustering": lambda k, seed: Means(FixedKernels(500, seed), k, seed),
} | {f"{name}-{d}": (lambda k, seed, d=d: Medoids(d, k, seed)) for d in _DISTANCES for name in ("kmedoids", "pam")}


def davies_bouldin(x: np.ndarray, own: np.ndarray, distance: str, **parameters) -> float:
    """Mean over clusters of the worst (scatter + scatter) / separation, around medoids; infinite with one cluster."""
    labels = np.unique(own)
    if len(labels) < 2:
        return np.inf
    d = matrix(x, x, distance, **parameters)
    centre = [np.flatnonzero(own == c)[d[np.ix_(own == c, own == c)].sum(axis=0).argmin()] for c in labels]
    scatter = np.array([d[own == c][:, m].mean() for c, m in zip(labels, centre, strict=True)])
    apart = d[np.ix_(centre, centre)]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(np.eye(len(labels), dtype=bool), -np.inf, (scatter[:, None] + scatter) / apart)
    return float(np.nan_to_num(ratio, nan=np.inf).max(axis=1).mean())


#: Grids by which a distance's parameter is tuned.
GRIDS = {
    "dtw": [{"window": round(k / 100, 2)} for k in range(20)], "ddtw": [{"window": round(k / 100, 2)} for k in range(20)], "msm": [{"c": k / 4} for k in range(20)],
    "wdtw": [{"g": round(k / 20, 2)} for k in range(20)], "erp": [{"gap": k / 10} for k in range(20)], "lcss": [{"epsilon": k / 20} for k in range(1, 21)],
    "edr": [{"epsilon": k / 20} for k in range(1, 21)], "twe": [{"nu": 10.0**-n, "lam": v / 4} for n in range(1, 5) for v in range(5)], "adtw": [{"penalty": k / 4} for k in range(20)],
}


def tune(x: np.ndarray, distance: str, k: int, seed: int = 0) -> tuple[dict, float]:
    """(parameters, score): those of the distance's grid whose k-medoids clusters have the least Davies-Bouldin score, the first at a tie; one cluster alone doesn't count."""
    best = ({}, np.inf)
    for p in GRIDS[distance]:
        own = Medoids(distance, k, seed, **p).fit(x).predict(x)
        score = davies_bouldin(x, own, distance, **p)
        if score < best[1]:
            best = (p, score)
    return best


def named(task: str, name: str, seed: int = 0, k: int = 2):
    """A fresh model by task and name, without regard to case; an unknown name is an error."""
    found = {"classification": CLASSIFIERS, "regression": REGRESSORS, "clustering": CLUSTERERS}[task].get(name.lower())
    if found is None:
        raise ValueError(f"unknown estimator {name!r}")
    return found(k, seed) if task == "clustering" else found(seed)
