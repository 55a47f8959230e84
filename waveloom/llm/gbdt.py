"""Gradient-boosted trees in numpy: fitted on a bounded sample, scored as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in one set of node arrays. A leaf has feature -1 and its value in `value`; children
    are `left` and `left + 1`, so scoring takes `depth` gathers for a whole batch and every tree."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    @property
    def constant(self) -> bool:
        """Whether no tree has a split, for want of rows or of a feature that tells the classes apart: the score is then one number
        for all rows and says nothing."""
        return not (self.feature >= 0).any()

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.cut[at]
                at = np.where(inner, self.left[at] + right, at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] | list[int], rounds: int = 60, depth: int = 4,
        rate: float = 0.15, bins: int = 48, least: int = 20, l2: float = 1.0) -> Trees:
    """Logistic boosting over quantile histograms.

    monotone[j] is +1 (the score never falls as feature j grows), -1 or 0. A split against the sign is
    not taken, and the middle of the two child values bounds all values below either child, so the sum
    of trees is monotone too. One class alone, or fewer than 2 * least rows, gives the constant model.
    """
    y = y.astype(float)
    rate_of = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    nodes: dict[str, list] = {"feature": [], "cut": [], "left": [], "value": []}
    roots: list[int] = []

    def node() -> int:
        for k, v in (("feature", -1), ("cut", 0.0), ("left", 0), ("value", 0.0)):
            nodes[k].append(v)
        return len(nodes["feature"]) - 1

    def done() -> Trees:
        return Trees(*(np.array(nodes[k], t) for k, t in (("feature", int), ("cut", float), ("left", int), ("value", float))), np.array(roots, int), depth, base)

    if len(y) < 2 * least or y.min() == y.max():
        return done()
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    score = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        root = node()
        roots.append(root)
        todo = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            at, idx, level, low, high = todo.pop()
            gs, hs = g[idx].sum(), h[idx].sum()
            best = (1e-6, None)
            if level < depth and len(idx) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = codes[idx, j]
                    n = np.cumsum(np.bincount(k, minlength=len(c) + 1))[:-1]
                    gl = np.cumsum(np.bincount(k, g[idx], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(k, h[idx], len(c) + 1))[:-1]
                    vl, vr = gl / (hl + l2), (gs - gl) / (hs - hl + l2)
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(n < least) | (len(idx) - n < least) | (monotone[j] * (vr - vl) < 0)] = 0
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (gain[b], (j, b, np.clip(vl[b], low, high), np.clip(vr[b], low, high)))
            if best[1] is None:
                v = float(np.clip(gs / (hs + l2), low, high)) * rate
                nodes["value"][at] = v
                score[idx] += v
                continue
            j, b, vl, vr = best[1]
            left = node()
            node()
            nodes["feature"][at], nodes["cut"][at], nodes["left"][at] = j, float(cuts[j][b]), left
            goes = codes[idx, j] <= b
            mid = (vl + vr) / 2
            lo_hi = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}.get(monotone[j], ((low, high),) * 2)
            todo += [(left, idx[goes], level + 1, *lo_hi[0]), (left + 1, idx[~goes], level + 1, *lo_hi[1])]
    return done()
