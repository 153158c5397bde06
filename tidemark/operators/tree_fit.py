"""One tree ensemble on one series' rows: the small numpy helper that the
grouped training job (``grouped_training``) calls for each of its groups.

A group is the daily rows of one dataset, bounded by the calendar, whatever
the volume of sales behind them.  A split is the best one over the sorted
values of every feature, by second-order gain: with G the sum of residuals
and n the rows of a side, G^2 / (n + l2).  Trees grow level by level, or leaf
by leaf where the leaf of the largest gain is split next until ``num_leaves``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd

TIE = 1e-10                 # gains nearer than this share are equal
NODE_COLUMNS = ["tree_id", "node_id", "left", "right", "feature", "threshold", "value", "weight"]


def coded(x: np.ndarray, max_bins: int | None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Each feature's values as ranks of distinct values, or of at most
    ``max_bins`` runs of about equal rows, with every code's least and
    largest value."""
    codes, low, high = np.empty(x.shape, np.int32), [], []
    for f in range(x.shape[1]):
        values, code, rows = np.unique(x[:, f], return_inverse=True, return_counts=True)
        run = np.arange(len(values))
        if max_bins and len(values) > max_bins:
            run = np.unique((np.cumsum(rows) - rows) * max_bins // len(x), return_inverse=True)[1]
        codes[:, f] = run[code]
        heads = np.flatnonzero(np.diff(run, prepend=-1))
        low.append(values[heads])
        high.append(values[np.append(heads[1:], len(values)) - 1])
    return codes, low, high


def best_splits(order: np.ndarray, starts: np.ndarray, codes: np.ndarray, g: np.ndarray, w: np.ndarray | None, l2: float, least: int):
    """The best split of each run of rows: (gain, feature, last place on its
    left).  ``order``: features x rows, inside every run by the feature's
    code; runs begin at ``starts``; ``w`` is None where all rows weigh one.
    Ties go to the first feature, then to the smallest value."""
    n = order.shape[1]
    sizes = np.diff(np.append(starts, n))
    many = len(starts) > 1
    spread = (lambda v: np.repeat(v, sizes, axis=-1)) if many else (lambda v: v)      # noqa: E731

    def left_of(values):
        sums = np.cumsum(values[order], axis=1)
        if many:
            sums[:, starts[1]:] -= np.repeat(sums[:, starts[1:] - 1], sizes[1:], axis=1)
        return sums

    place = np.arange(1, n + 1) - spread(starts)            # rows on the left
    left = left_of(g)
    total = np.add.reduceat(g[order[0]], starts)
    weight = sizes.astype(float) if w is None else np.add.reduceat(w[order[0]], starts)
    left_w = place.astype(float) if w is None else left_of(w)
    right, right_w = spread(total) - left, spread(weight) - left_w
    allowed = np.zeros(order.shape, bool)
    here = codes.ravel().take(order + np.arange(len(codes))[:, None] * codes.shape[1])
    np.not_equal(here[:, 1:], here[:, :-1], out=allowed[:, :-1])
    allowed &= (place >= least) & (spread(sizes) - place >= max(least, 1))
    gain = np.full(order.shape, -np.inf)
    if l2 or w is None:
        with np.errstate(divide="ignore", invalid="ignore"):
            left *= left
            left /= left_w + l2
            right *= right
            right /= right_w + l2
            np.add(left, right, out=gain, where=allowed)
    else:
        gain[allowed] = left[allowed] ** 2 / left_w[allowed] + right[allowed] ** 2 / right_w[allowed]
    most = np.maximum.reduceat(gain, starts, axis=1)
    best = most.max(axis=0)
    near = best - TIE * np.abs(best)                # sums of other orders differ in their last bits
    feature = (most >= near).argmax(axis=0)
    at = np.where(gain[spread(feature), np.arange(n)] >= spread(near), np.arange(n), n)
    return best - total ** 2 / (weight + l2), feature, np.minimum.reduceat(at, starts)


class Tree:
    """Nodes as growing lists; a leaf has left = -1."""

    def __init__(self):
        self.left, self.right, self.feature, self.threshold, self.value = [], [], [], [], []

    def node(self, value: float) -> int:
        for column, v in ((self.left, -1), (self.right, -1), (self.feature, -1), (self.threshold, 0.0), (self.value, value)):
            column.append(v)
        return len(self.left) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        left, right, feature, threshold = (np.array(c) for c in (self.left, self.right, self.feature, self.threshold))
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[left[at[rows]] >= 0]
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
        return np.array(self.value)[at]


def grow(order: np.ndarray, codes: np.ndarray, low, high, columns: np.ndarray, g: np.ndarray, w: np.ndarray, spec: dict) -> Tree:
    """One tree on the rows in ``order`` (features x rows by code)."""
    l2, least = spec.get("l2", 0.0), spec.get("min_leaf", 1)
    max_depth, max_leaves = spec.get("max_depth") or np.inf, spec.get("num_leaves") or np.inf
    slack = 1e-12 * float((g[order[0]] ** 2 * w[order[0]]).sum())
    tree, gw = Tree(), g * w
    value = lambda rows: float(gw[rows].sum() / (w[rows].sum() + l2))       # noqa: E731
    weights = None if (w[order[0]] == 1.0).all() else w

    def split(node: int, part: np.ndarray, feature: int, last: int):
        """Children of a node as (node, features x rows), their order kept."""
        code = codes[feature, part[feature, last]]
        goes = codes[feature] <= code
        tree.feature[node] = int(columns[feature])
        tree.threshold[node] = float((high[feature][code] + low[feature][codes[feature, part[feature, last + 1]]]) / 2)
        sides = goes[part]
        out = []
        for side in (sides, ~sides):
            rows = part[side].reshape(len(part), -1)
            out.append((tree.node(value(rows[0])), rows))
        tree.left[node], tree.right[node] = out[0][0], out[1][0]
        return out

    root = tree.node(value(order[0]))
    if np.isfinite(max_leaves):
        heap, tick, leaves = [], 0, 1
        fresh = [(root, order, 0)]
        while True:
            fresh = [x for x in fresh if x[1].shape[1] > 1 and x[2] < max_depth]
            if fresh:
                starts = np.cumsum([0] + [x[1].shape[1] for x in fresh[:-1]])
                found = best_splits(np.concatenate([x[1] for x in fresh], axis=1), starts, codes, gw, weights, l2, least)
                for (node, part, depth), start, gain, feature, last in zip(fresh, starts, *found):
                    if gain > slack:
                        heapq.heappush(heap, (-gain, tick, node, part, depth, int(feature), int(last - start)))
                    tick += 1
            if not heap or leaves >= max_leaves:
                return tree
            _, _, node, part, depth, feature, last = heapq.heappop(heap)
            fresh = [(child, rows, depth + 1) for child, rows in split(node, part, feature, last)]
            leaves += 1
    nodes, starts, depth = np.array([root]), np.zeros(1, np.int64), 0
    key = np.zeros(codes.shape[1], np.int16 if codes.shape[1] < 1 << 14 else np.int32)
    while order.shape[1] > len(nodes) and depth < max_depth:
        gain, feature, last = best_splits(order, starts, codes, gw, weights, l2, least)
        chosen = np.flatnonzero(gain > slack)
        if not len(chosen):
            break
        feature, last = feature[chosen], last[chosen]
        code = codes[feature, order[feature, last]]
        above = codes[feature, order[feature, last + 1]]
        # every row's child: two numbers a split node, in the order of the nodes
        number = np.full(len(starts), -1)
        number[chosen] = np.arange(len(chosen))
        mine = np.repeat(number, np.diff(np.append(starts, order.shape[1])))
        rows, mine = order[0][mine >= 0], mine[mine >= 0]
        key[:] = -1
        key[rows] = 2 * mine + (codes[feature[mine], rows] > code[mine])
        total, weight = (np.bincount(key[rows], v[rows], 2 * len(chosen)) for v in (gw, w))
        children = [tree.node(float(v)) for v in total / (weight + l2)]
        for i, node in enumerate(nodes[chosen].tolist()):
            f = int(feature[i])
            tree.left[node], tree.right[node], tree.feature[node] = children[2 * i], children[2 * i + 1], int(columns[f])
            tree.threshold[node] = float((high[f][code[i]] + low[f][above[i]]) / 2)
        child = key[order]
        order = order[child >= 0].reshape(len(order), -1)
        order = np.take_along_axis(order, np.argsort(key[order], axis=1, kind="stable"), axis=1)
        starts = np.searchsorted(key[order[0]], np.arange(2 * len(chosen)))
        nodes, depth = np.array(children), depth + 1
    return tree


def fit_ensemble(x: np.ndarray, y: np.ndarray, spec: dict, seed: int) -> pd.DataFrame:
    """Node table (``NODE_COLUMNS``) of one ensemble.  Boosting (``rate`` is
    set) starts from the mean, as a tree of one leaf, and fits residuals;
    otherwise bootstrapped trees are averaged."""
    rng = np.random.default_rng(seed)
    codes, low, high = coded(x, spec.get("max_bins"))
    codes = np.ascontiguousarray(codes.T)
    n, rate = len(y), spec.get("rate")
    trees, weights = [], []
    pred = np.zeros(n)
    if rate:
        first = Tree()
        first.node(float(y.mean()))
        trees, weights, pred = [first], [1.0], np.full(n, y.mean())
    by_code = np.argsort(codes, axis=1, kind="stable")
    for _ in range(spec["n_estimators"]):
        w = np.ones(n)
        if not rate:
            w = np.bincount(rng.integers(0, n, n), minlength=n).astype(float)
        elif spec.get("subsample", 1.0) < 1.0:
            w = np.zeros(n)
            w[rng.permutation(n)[:max(1, int(n * spec["subsample"]))]] = 1.0
        columns = np.arange(len(codes))
        if spec.get("colsample", 1.0) < 1.0:
            columns = np.sort(rng.permutation(len(codes))[:max(1, int(len(codes) * spec["colsample"]))])
        order = by_code[columns]
        order = order[w[order] > 0].reshape(len(columns), -1)
        tree = grow(order, codes[columns], [low[c] for c in columns], [high[c] for c in columns], columns, y - pred if rate else y, w, spec)
        trees.append(tree)
        weights.append(rate or 1.0)
        if rate:
            pred += rate * tree.predict(x)
    frames = [pd.DataFrame({"tree_id": i, "node_id": np.arange(len(t.left)), "left": t.left, "right": t.right, "feature": t.feature,
                            "threshold": t.threshold, "value": t.value, "weight": wt}) for i, (t, wt) in enumerate(zip(trees, weights))]
    return pd.concat(frames, ignore_index=True)[NODE_COLUMNS]
