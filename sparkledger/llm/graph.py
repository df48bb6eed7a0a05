"""A robust-pruned directed graph over unit vectors, and beam search in it, for batches of queries at a time (numpy, inside one task).

Distances are 1 - inner product of unit vectors, half the squared Euclidean distance.
"""

from __future__ import annotations

import numpy as np

#: Links of a node, beam width while building, relaxation of pruning, nodes inserted or searched at a time, beam entries opened at a time.
DEGREE, BUILD_BEAM, ALPHA, BATCH, OPEN = 32, 64, 1.2, 512, 4


def beam_search(x: np.ndarray, links: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (len(x) where none) and distances of each query's beam when no entry of it is left to open, in no order."""
    n, b = len(x), len(q)
    ids, d, opened = np.full((b, beam), n, np.int32), np.full((b, beam), np.inf, np.float32), np.ones((b, beam), bool)
    seen, owner = np.zeros((b, n + 1), bool), np.zeros((b, n + 1), np.int32)
    ids[:, 0], d[:, 0], opened[:, 0] = entry, 1 - q @ x[entry], False
    seen[:, [entry, n]] = True
    width = min(OPEN, beam)
    while True:
        key = np.where(opened, np.inf, d)
        nearest = np.argpartition(key, width - 1, axis=1)[:, :width]
        fresh = np.take_along_axis(key, nearest, 1) < np.inf
        at = np.flatnonzero(fresh.any(axis=1))
        if not len(at):
            return ids, d
        nearest, fresh, row = nearest[at], fresh[at], at[:, None]
        opened[row, nearest] = True
        found = links[np.where(fresh, ids[row, nearest], n)].reshape(len(at), -1)
        place = np.broadcast_to(np.arange(found.shape[1], dtype=np.int32), found.shape)
        owner[row, found] = place
        new = ~seen[row, found] & (owner[row, found] == place)  # a node that two opened entries link to counts once
        i, j = np.nonzero(new)
        node = found[i, j]
        seen[at[i], node] = True
        far = np.full(found.shape, np.inf, np.float32)
        far[i, j] = 1 - np.einsum("nd,nd->n", x[node], q[at[i]])
        d2, ids2 = np.concatenate([d[at], far], 1), np.concatenate([ids[at], found], 1)
        opened2 = np.concatenate([opened[at], np.zeros(found.shape, bool)], 1)
        keep = np.argpartition(d2, beam - 1, axis=1)[:, :beam]
        d[at], ids[at] = np.take_along_axis(d2, keep, 1), np.take_along_axis(ids2, keep, 1)
        opened[at] = np.take_along_axis(opened2, keep, 1) | np.isinf(d[at])


def robust_prune(x: np.ndarray, ids: np.ndarray, d: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to `degree` links a node: again and again the nearest candidate, which rules out those that it is nearer to, by the factor alpha, than the node is.

    ids, d: candidates of each node, nearest first; d is infinite where there is none."""
    v = x[np.minimum(ids, len(x) - 1)]
    between = 1 - np.matmul(v, v.transpose(0, 2, 1))
    left, rows = np.isfinite(d), np.arange(len(ids))
    out = np.full((len(ids), degree), len(x), np.int32)
    for k in range(degree):
        first = left.argmax(axis=1)
        some = left[rows, first]
        if not some.any():
            break
        out[some, k] = ids[some, first[some]]
        left &= ~((alpha * between[rows, first] <= d) & some[:, None])
        left[rows, first] = False
    return out


def _nearest_first(x: np.ndarray, node: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct candidates of each node with their distances, nearest first; the node itself is none."""
    n = len(x)
    ids = np.sort(ids, axis=1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    d = 1 - np.einsum("brd,bd->br", x[np.minimum(ids, n - 1)], x[node])
    d[again | (ids == n) | (ids == node[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)


def _link_back(x: np.ndarray, links: np.ndarray, node: np.ndarray, alpha: float) -> None:
    """Each node that the given nodes link to gets links back; what goes beyond the degree is pruned."""
    n, degree = len(x), links.shape[1]
    i, k = np.nonzero(links[node] < n)
    to, source = links[node][i, k], node[i]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    who, first, count = np.unique(to, return_index=True, return_counts=True)
    for a in range(0, len(who), BATCH):
        w, c = who[a : a + BATCH], count[a : a + BATCH]
        more = np.full((len(w), int(c.max())), n, np.int32)
        of = np.repeat(np.arange(len(w)), c)
        more[of, np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)] = source[first[a] : first[a] + int(c.sum())]
        both = np.sort(np.concatenate([links[w], more], 1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = n
        room = (both < n).sum(axis=1) <= degree
        links[w[room]] = np.sort(both[room], axis=1)[:, :degree]
        full = np.flatnonzero(~room)
        for c0 in range(0, len(full), BATCH // 4):  # a hub may have as many candidates as a batch has nodes
            g = full[c0 : c0 + BATCH // 4]
            links[w[g]] = robust_prune(x, *_nearest_first(x, w[g], both[g]), degree, alpha)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, int]:
    """Links (len(x) where none; a row more than nodes, without links) and the entry node: a random graph first, then every node is searched for and linked anew."""
    n, rng = len(x), np.random.default_rng(seed)
    links = np.full((n + 1, degree), n, np.int32)
    links[:n] = rng.integers(0, n, (n, degree))
    entry = int(np.argmax(x @ x.mean(axis=0)))
    order = rng.permutation(n)
    for a in range(0, n, BATCH):
        node = order[a : a + BATCH]
        near, _ = beam_search(x, links, entry, x[node], beam)
        links[node] = robust_prune(x, *_nearest_first(x, node, np.concatenate([near, links[node]], 1)), degree, alpha)
        _link_back(x, links, node, alpha)
    return links, entry
