"""Isolation-forest kernels (NumPy), run inside Spark tasks.

Algorithm of the published isolation-forest paper (Liu, Ting, Zhou 2008):
each tree isolates a subsample of psi = min(max_samples, n) rows drawn
without replacement by recursive random splits (random feature, uniform
threshold between the node's min and max) up to depth ceil(log2 psi).
Path length of x = depth of its leaf + c(leaf size); the anomaly score is
s = 2^(-mean path / c(psi)); ``score_samples`` = -s, and the decision value
is ``score_samples - offset`` where ``offset`` is the ``contamination``
quantile of the training scores: negative means anomalous.

Trees are built level by level for all trees at once with heap-numbered
nodes (children of k are 2k+1 and 2k+2), so no Python loop runs per node.
"""

from __future__ import annotations

import numpy as np

EULER_GAMMA = 0.5772156649015329


def avg_path_length(n: np.ndarray | float) -> np.ndarray:
    """c(n): average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


def build_forest(x: np.ndarray, n_trees: int, max_samples: int, seed_parts: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Fit ``n_trees`` isolation trees on rows of ``x`` (n x d).

    Returns dense per-tree node arrays of shape (n_trees, 2^(depth+1) - 1):
    ``feature`` (-1 for leaves/unused), ``threshold``, ``leaf_value``
    (depth + c(size) at leaves), plus ``psi`` and ``max_depth``.
    Deterministic for a given ``seed_parts`` and row order.
    """
    x = np.asarray(x, dtype=np.float64)
    n, d = x.shape
    psi = int(min(max_samples, n))
    max_depth = int(np.ceil(np.log2(max(psi, 2))))
    n_nodes = 2 ** (max_depth + 1) - 1
    rng = np.random.default_rng(list(seed_parts))
    # subsample without replacement per tree
    idx = np.stack([rng.choice(n, size=psi, replace=False) for _ in range(n_trees)])  # (T, psi)
    feature = np.full((n_trees, n_nodes), -1, dtype=np.int64)
    threshold = np.zeros((n_trees, n_nodes))
    leaf_value = np.zeros((n_trees, n_nodes))
    tree_of = np.repeat(np.arange(n_trees), psi)
    samples = x[idx.reshape(-1)]  # (T*psi, d)
    node = np.zeros(n_trees * psi, dtype=np.int64)
    active = np.ones(n_trees * psi, dtype=bool)
    for depth in range(max_depth + 1):
        if not active.any():
            break
        key = tree_of[active] * n_nodes + node[active]
        xs = samples[active]
        order = np.argsort(key, kind="stable")
        key_s = key[order]
        xs_s = xs[order]
        starts = np.flatnonzero(np.r_[True, key_s[1:] != key_s[:-1]])
        ukeys = key_s[starts]
        sizes = np.diff(np.r_[starts, len(key_s)])
        mins = np.minimum.reduceat(xs_s, starts, axis=0)
        maxs = np.maximum.reduceat(xs_s, starts, axis=0)
        spread = maxs > mins  # (nodes, d) non-constant features
        n_var = spread.sum(axis=1)
        u_feat = rng.random(len(ukeys))
        u_thr = rng.random(len(ukeys))
        t_ids = ukeys // n_nodes
        k_ids = ukeys % n_nodes
        is_leaf = (sizes <= 1) | (n_var == 0) | (depth >= max_depth)
        # pick the j-th non-constant feature, j uniform
        j = np.minimum((u_feat * np.maximum(n_var, 1)).astype(np.int64), np.maximum(n_var - 1, 0))
        csum = np.cumsum(spread, axis=1)
        f = np.argmax(csum > j[:, None], axis=1)
        lo = mins[np.arange(len(ukeys)), f]
        hi = maxs[np.arange(len(ukeys)), f]
        thr = lo + u_thr * (hi - lo)
        leaf_value[t_ids[is_leaf], k_ids[is_leaf]] = depth + avg_path_length(sizes[is_leaf])
        split = ~is_leaf
        feature[t_ids[split], k_ids[split]] = f[split]
        threshold[t_ids[split], k_ids[split]] = thr[split]
        # route active samples
        act_idx = np.flatnonzero(active)
        fk = feature[tree_of[act_idx], node[act_idx]]
        goes = fk >= 0
        moving = act_idx[goes]
        fv = samples[moving, fk[goes]]
        left = fv < threshold[tree_of[moving], node[moving]]
        node[moving] = np.where(left, 2 * node[moving] + 1, 2 * node[moving] + 2)
        active[act_idx[~goes]] = False
    return {"feature": feature, "threshold": threshold, "leaf_value": leaf_value,
            "psi": psi, "max_depth": max_depth}


#: rows walked at a time: a tree's nodes and a block's rows stay in the cache
WALK_ROWS = 8192


def _full_trees(forest: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, thresholds, values at the lowest level) of trees in which
    every leaf is handed down to the lowest level, so that all walks are
    equally long and need no test for leaves."""
    depth = int(forest["max_depth"])
    feature, threshold = np.array(forest["feature"]), np.array(forest["threshold"])
    value = np.array(forest["leaf_value"])
    for d in range(depth):
        at = np.arange(2**d - 1, 2 ** (d + 1) - 1)
        leaf = feature[:, at] < 0
        for child in (2 * at + 1, 2 * at + 2):
            value[:, child] = np.where(leaf, value[:, at], value[:, child])
            feature[:, child] = np.where(leaf, -1, feature[:, child])
    return np.maximum(feature, 0), threshold, value[:, 2**depth - 1 :]


def path_lengths(x: np.ndarray, forest: dict[str, np.ndarray]) -> np.ndarray:
    """Mean path length of each row of ``x`` over all trees: tree by tree, a
    block of rows walks down a level at a time."""
    x = np.asarray(x, dtype=np.float64)
    feature, threshold, value = _full_trees(forest)
    depth, n_trees, width = int(forest["max_depth"]), feature.shape[0], x.shape[1]
    out = np.empty(len(x))
    for lo in range(0, len(x), WALK_ROWS):
        block = np.ascontiguousarray(x[lo : lo + WALK_ROWS])
        flat, row = block.reshape(-1), np.arange(len(block)) * width
        found = np.empty((len(block), n_trees))
        for t in range(n_trees):
            f, cut = feature[t], threshold[t]
            node = np.zeros(len(block), dtype=np.int64)
            for _ in range(depth):
                left = flat.take(row + f.take(node)) < cut.take(node)
                node *= 2
                node += 2
                node -= left
            found[:, t] = value[t].take(node - (2**depth - 1))
        out[lo : lo + len(block)] = found.mean(axis=1)
    return out


def score_samples(x: np.ndarray, forest: dict[str, np.ndarray]) -> np.ndarray:
    """-s = -2^(-E[h(x)] / c(psi)); lower is more anomalous."""
    c = float(avg_path_length(np.array([forest["psi"]]))[0]) or 1.0
    return -np.power(2.0, -path_lengths(x, forest) / c)


def offset_for(train_scores: np.ndarray, contamination: float) -> float:
    """Decision offset: the ``contamination`` quantile of training scores."""
    return float(np.percentile(train_scores, 100.0 * contamination))
