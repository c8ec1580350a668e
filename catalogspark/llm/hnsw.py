"""A hierarchical navigable small-world graph over the rows of a matrix, kept as flat arrays of neighbours.

Rows are in order of falling level, so layer k is the first ``sizes[k]`` rows and one array of ``sizes[k] x width`` row
numbers (-1 is none). Rows go in by batches that grow with the graph: a batch's rows look for their neighbours in what is
there and among each other, keep a spread of them, and give links back. All distances of a step are one array operation
over the rows or queries of a batch. Rows are taken as of one length, so that the largest product is the nearest."""

from __future__ import annotations

import numpy as np

#: Neighbours of a row in the upper layers, and twice as many in the lowest.
LINKS = 16
#: Candidates kept while a row is put in, and rows of a batch at most.
WIDTH, BATCH = 96, 512
#: Candidates kept in the upper layers, and taken from a row's own batch.
_UPPER, _BESIDE = 4, 12


def best_first(x: np.ndarray, graph: np.ndarray, count: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, products), best first, of the ``width`` best rows found of the first ``count`` for each of ``q``: the best
    row not looked at yet is looked at, until all kept ones have been."""
    n = len(q)
    ids, sims = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32)
    fresh, seen = np.zeros((n, width), bool), np.zeros((n, count + 1), bool)
    seen[:, count] = True  # stands for no neighbour
    ids[:, 0], sims[:, 0], fresh[:, 0] = start, np.einsum("ij,ij->i", q, x[start]), True
    seen[np.arange(n), start] = True
    live = np.arange(n)
    while len(live):
        at = fresh[live].argmax(axis=1)
        near = graph[ids[live, at]]
        fresh[live, at] = False
        near = np.where(near < 0, count, near)
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        k, j = np.nonzero(new)
        found = np.full(near.shape, -np.inf, np.float32)
        found[k, j] = np.einsum("ij,ij->i", q[live[k]], x[near[k, j]])
        sim = np.concatenate([sims[live], found], axis=1)
        top = np.argpartition(-sim, width - 1, axis=1)[:, :width]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable"), 1)
        sims[live] = np.take_along_axis(sim, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), top, 1)
        fresh[live] = np.take_along_axis(np.concatenate([fresh[live], new], axis=1), top, 1)
        live = live[fresh[live].any(axis=1)]
    ids[sims == -np.inf] = -1
    return ids, sims


def _spread(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates, best first, ``width``: first those nearer to the row than to any taken before, then the
    best of the others."""
    v = x[np.maximum(ids, 0)]
    between = v @ v.transpose(0, 2, 1)
    near = np.full(ids.shape, -np.inf, np.float32)  # the product with the nearest that is taken
    taken = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        take = (ids[:, k] >= 0) & (near[:, k] < sims[:, k])
        taken[:, k] = take
        near = np.where(take[:, None], np.maximum(near, between[:, k]), near)
    order = np.argsort(np.where(ids < 0, 2, ~taken), axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)


def _give_back(x: np.ndarray, graph: np.ndarray, rows: np.ndarray) -> None:
    """Links from the neighbours of ``rows`` to them; a neighbour with too many keeps a spread of its best."""
    width = graph.shape[1]
    k, j = np.nonzero(graph[rows] >= 0)
    target, source = graph[rows[k], j], rows[k]
    held = np.unique(target)
    old = graph[held]
    a, b = np.nonzero(old >= 0)
    target, source = np.concatenate([held[a], target]), np.concatenate([old[a, b], source])
    link = np.unique(np.stack([target, source], axis=1), axis=0)
    target, source = link[:, 0], link[:, 1]
    sim = np.einsum("ij,ij->i", x[target], x[source])
    order = np.lexsort((-sim, target))
    target, source, sim = target[order], source[order], sim[order]
    first = np.searchsorted(target, held)
    place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    within = place < 3 * width
    at = np.searchsorted(held, target[within])
    ids, sims = np.full((len(held), 3 * width), -1, np.int64), np.full((len(held), 3 * width), -np.inf, np.float32)
    ids[at, place[within]], sims[at, place[within]] = source[within], sim[within]
    full = (ids >= 0).sum(axis=1) > width
    graph[held[~full]] = ids[~full, :width]
    for part in np.array_split(np.flatnonzero(full), max(1, full.sum() // BATCH)):
        most = int((ids[part] >= 0).sum(axis=1).max(initial=0))
        graph[held[part]] = _spread(x, ids[part, :most], sims[part, :most], width)


class Graph:
    """Rows ``x`` in order of falling level and the neighbour arrays of the layers, the lowest first."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    def _entry(self, q: np.ndarray, layer: int, count: int) -> np.ndarray:
        """A good row among the first ``count`` from which to look for each of ``q`` in ``layer``."""
        best = np.zeros(len(q), np.int64)
        for upper in reversed(self.layers[layer + 1 :]):
            ids, _ = best_first(self.x, upper, len(upper), q, best, _UPPER)
            best = np.maximum(ids[:, 0], 0)
        if not len(self.layers) > layer + 1:
            return best
        there = (ids >= 0) & (ids < count)
        return np.where(there.any(axis=1), np.take_along_axis(ids, there.argmax(axis=1)[:, None], 1)[:, 0], 0)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, products) of the ``width`` best rows found for each of ``q``, best first; -1 is none."""
        n = len(self.x)
        return best_first(self.x, self.layers[0], n, q, self._entry(q, 0, n), min(width, n))

    def reached(self) -> float:
        """The share of rows that can be reached in the lowest layer."""
        seen, front = np.zeros(len(self.x), bool), np.array([0])
        seen[0] = True
        while len(front):
            near = np.unique(self.layers[0][front])
            front = near[(near >= 0) & ~seen[near]]
            seen[front] = True
        return float(seen.mean())


def levels(n: int, seed: int = 0) -> np.ndarray:
    """Levels drawn so that each layer has one in LINKS of the rows of the one below, falling."""
    drawn = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(np.int64)
    return np.sort(drawn)[::-1]


def build(x: np.ndarray, level: np.ndarray) -> Graph:
    """The graph of ``x``, whose rows are in order of falling ``level``."""
    graph = Graph(x, [np.zeros((0, 0), np.int64)] * (int(level[0]) + 1))
    for layer in range(int(level[0]), -1, -1):
        n, width = int((level >= layer).sum()), LINKS if layer else 2 * LINKS
        own = graph.layers[layer] = np.full((n, width), -1, np.int64)
        count = 1
        while count < n:
            rows = np.arange(count, min(n, count + max(1, min(count // 2, BATCH))))
            q = x[rows]
            ids, sims = best_first(x, own, count, q, graph._entry(q, layer, count), min(WIDTH, count))
            beside = q @ q.T
            np.fill_diagonal(beside, -np.inf)
            some = np.argsort(-beside, axis=1, kind="stable")[:, : min(_BESIDE, len(rows) - 1)]
            ids = np.concatenate([ids, rows[some]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(beside, some, 1)], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")
            own[rows] = _spread(x, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), width)
            _give_back(x, own, rows)
            count += len(rows)
    return graph
