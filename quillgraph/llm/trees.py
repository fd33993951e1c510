"""Decision trees over dense features by histograms, in numpy: gradient boosting, random forests, isotonic calibration.

Trained on the driver from bounded samples; a model is a few small arrays that travel with a task.
"""

from __future__ import annotations

import numpy as np

BINS = 64


def edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Split points of each feature: its quantiles, without repetitions."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def binned(x: np.ndarray, cut: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(cut, x.T)], axis=1).astype(np.int64)


class Tree:
    """A complete binary tree: node i has children 2 i + 1 and 2 i + 2; a row goes right if its value is above the split."""

    def __init__(self, xb, cut, g, h, depth, least, ridge, rng=None, features=None):
        n_nodes, width = 2 ** (depth + 1) - 1, xb.shape[1]
        self.depth = depth
        self.feature = np.zeros(n_nodes, np.int32)
        self.split = np.full(n_nodes, np.inf)
        self.value = np.zeros(n_nodes)
        at = np.zeros(len(xb), np.int64)
        bins = max((len(e) for e in cut), default=0) + 1
        for level in range(depth + 1):
            first, count = 2**level - 1, 2**level
            node = at - first
            sum_g, sum_h = np.bincount(node, g, count), np.bincount(node, h, count)
            has = sum_h > 0
            own = np.where(has, -sum_g / np.where(has, sum_h + ridge, 1), 0)
            # an empty node repeats its parent's value
            parents = (np.arange(first, first + count) - 1) // 2
            self.value[first : first + count] = np.where(has, own, self.value[parents] if level else 0)
            if level == depth:
                break
            best = np.full(count, 1e-9)
            chosen, where = np.full(count, -1), np.zeros(count, np.int64)
            usable = range(width) if features is None else rng.choice(width, min(features, width), replace=False)
            for f in usable:
                if not len(cut[f]):
                    continue
                key = node * bins + xb[:, f]
                hg = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(1)
                hh = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(1)
                lg, lh = hg[:, : len(cut[f])], hh[:, : len(cut[f])]
                rg, rh = sum_g[:, None] - lg, sum_h[:, None] - lh
                gain = lg**2 / (lh + ridge + 1e-12) + rg**2 / (rh + ridge + 1e-12) - (sum_g**2 / (sum_h + ridge + 1e-12))[:, None]
                gain[(lh < least) | (rh < least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                better = top > best
                best[better], chosen[better], where[better] = top[better], f, k[better]
            for i in np.flatnonzero(chosen >= 0):
                self.feature[first + i] = chosen[i]
                self.split[first + i] = cut[chosen[i]][where[i]]
            right = (chosen[node] >= 0) & (xb[np.arange(len(xb)), np.maximum(chosen[node], 0)] > where[node])
            at = 2 * at + 1 + right

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.split[at])
        return self.value[at]


class Boosted:
    """Logistic gradient boosting; raw(x) is a log-odds."""

    def __init__(self, x, y, trees=80, depth=4, rate=0.15, least=1.0, ridge=1.0):
        rate0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base, self.rate, self.trees = np.log(rate0 / (1 - rate0)), rate, []
        cut = edges(x)
        xb, raw = binned(x, cut), np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            tree = Tree(xb, cut, p - y, p * (1 - p), depth, least, ridge)
            self.trees.append(tree)
            raw += rate * tree.predict(x)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum(t.predict(x) for t in self.trees)


class Forest:
    """Random forest: bootstrap weights, a random choice of features a level, means in the leaves."""

    def __init__(self, x, y, trees=60, depth=8, least=2.0, seed=7):
        rng, cut = np.random.default_rng(seed), edges(x)
        xb, few = binned(x, cut), max(2, round(x.shape[1] ** 0.5))
        self.trees = []
        for _ in range(trees):
            w = rng.poisson(1.0, len(y)).astype(float)
            self.trees.append(Tree(xb, cut, -y * w, w, depth, least, 1e-6, rng, few))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum(t.predict(x) for t in self.trees) / len(self.trees)


class Isotonic:
    """Pool adjacent violators; between the blocks' middles the fit is linear."""

    def __init__(self, raw: np.ndarray, y: np.ndarray):
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # sum of y, count, sum of raw
        for r, v in zip(raw[order].tolist(), y[order].tolist()):
            blocks.append([v, 1, r])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.y = np.array([b[0] / b[1] for b in blocks])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


class Calibrated:
    """Boosting with isotonic calibration learned from predictions of held-out folds."""

    def __init__(self, x, y, folds=3, **options):
        out = np.zeros(len(y))
        part = np.arange(len(y)) % folds
        for k in range(folds):
            out[part == k] = Boosted(x[part != k], y[part != k], **options).raw(x[part == k])
        self.map, self.model = Isotonic(out, y), Boosted(x, y, **options)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability; a thousandth of it is the raw one's, so that ties keep an order."""
        raw = self.model.raw(x)
        return 0.999 * self.map(raw) + 0.001 / (1 + np.exp(-raw))
