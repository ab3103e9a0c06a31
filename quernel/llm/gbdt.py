"""Histogram gradient-boosted trees for a binary label, in numpy.

Features are cut into at most BINS bins at quantiles. A tree is grown level by level: for each node and feature, sums of
gradients and curvatures by bin give the gain of every cut at once. All trees have the same depth and are flattened
into two arrays, so that scoring walks all rows down a tree with a few array operations; where a node isn't split, its cut
is infinity and every row goes left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    base: float
    depth: int
    feature: np.ndarray  # trees x (2**depth - 1)
    cut: np.ndarray  # the same: rows with a larger value go right
    leaf: np.ndarray  # trees x 2**depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**self.depth - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, least: float = 2.0, smooth: float = 2.0) -> Trees:
    """Trees for labels 0 and 1. Without rows the score is one half; with one label only it is near that label."""
    n, d = x.shape
    inner = 2**depth - 1
    rate0 = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate0 / (1 - rate0)))
    if n == 0 or y.min() == y.max():
        return Trees(base, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(n, base)
    features, all_cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(count)
            split = np.full(count, -1)
            choice = np.zeros(count, np.int64)
            for f in range(d):
                if not len(cuts[f]):
                    continue
                width = len(cuts[f]) + 1
                flat = at * width + binned[:, f]
                gs = np.bincount(flat, g, count * width).reshape(count, width)
                hs = np.bincount(flat, h, count * width).reshape(count, width)
                gl, hl = gs.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
                gt, ht = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
                gain[(hl < least * 0.05) | (ht - hl < least * 0.05)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(count), k]
                better = top > best + 1e-9
                best[better], split[better], choice[better] = top[better], k[better], f
            done = split >= 0
            feature[first : first + count][done] = choice[done]
            cut[first : first + count][done] = [cuts[f][k] for f, k in zip(choice[done], split[done], strict=True)]
            right = x[np.arange(n), feature[node]] > cut[node]
            node = 2 * node + 1 + right
        at = node - inner
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf = rate * gs / (hs + smooth)
        margin = margin + leaf[at]
        features.append(feature)
        all_cuts.append(cut)
        leaves.append(leaf)
    return Trees(base, depth, np.array(features), np.array(all_cuts), np.array(leaves))
