"""Learned partitions of a vector space, in numpy.

The nearest neighbours of a sample form a graph. Its vertices are dealt out to
parts of about equal size with few edges between parts; a small classifier then
learns which parts a vector's neighbours lie in and so extends the partition to
all vectors.
"""

from __future__ import annotations

import dataclasses

import numpy as np

NEIGHBOURS = 10
HIDDEN = 128
SLACK = 0.1


def neighbour_graph(unit: np.ndarray, k: int = NEIGHBOURS, block: int = 1024) -> np.ndarray:
    """For each unit vector the places of its k nearest others, found a block at a time."""
    k = min(k, len(unit) - 1)
    found = np.empty((len(unit), k), np.int64)
    for at in range(0, len(unit), block):
        near = unit[at : at + block] @ unit.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        found[at : at + block] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else 0
    return found


def _halved(unit: np.ndarray, members: np.ndarray, parts: int, first: int, out: np.ndarray) -> None:
    """Deal members out to `parts` parts by cuts across the direction of most spread."""
    if parts <= 1 or len(members) <= 1:
        out[members] = first
        return
    centred = unit[members] - unit[members].mean(axis=0)
    direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    order = members[np.argsort(centred @ direction, kind="stable")]
    low = parts // 2
    cut = len(order) * low // parts
    _halved(unit, order[:cut], low, first, out)
    _halved(unit, order[cut:], parts - low, first + low, out)


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 10) -> np.ndarray:
    """A part for each vertex: recursive halves, then moves that cut fewer edges.

    In each sweep the vertices with the largest gain move to the part that most
    of their neighbours are in, as long as no part exceeds its share by SLACK.
    """
    n = len(unit)
    part = np.zeros(n, np.int64)
    _halved(unit, np.arange(n), parts, 0, part)
    most = int(np.ceil(n / parts * (1 + SLACK)))
    source = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(sweeps):
        seen = np.zeros((n, parts), np.int32)
        np.add.at(seen, (source, part[graph.reshape(-1)]), 1)
        np.add.at(seen, (graph.reshape(-1), part[source]), 1)
        wanted = seen.argmax(axis=1)
        gain = seen[np.arange(n), wanted] - seen[np.arange(n), part]
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if sizes[wanted[v]] < most:
                sizes[part[v]] -= 1
                sizes[wanted[v]] += 1
                part[v] = wanted[v]
                moved += 1
        if not moved:
            break
    return part


@dataclasses.dataclass(frozen=True)
class Router:
    """A network with one hidden layer that gives the probability of each part."""

    weights: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

    @property
    def parts(self) -> int:
        return len(self.weights[3])

    def logits(self, unit: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(unit @ w1 + b1, 0) @ w2 + b2

    def ranked(self, unit: np.ndarray) -> np.ndarray:
        """The parts, most probable first, for each vector."""
        return np.argsort(-self.logits(unit), axis=1, kind="stable")


def train_router(unit: np.ndarray, targets: np.ndarray, seed: int, epochs: int = 12, batch: int = 256) -> Router:
    """Fit to the share of each part among a vector and its neighbours, by Adam on cross entropy."""
    rng = np.random.default_rng(seed)
    shapes = [(unit.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, targets.shape[1]), (targets.shape[1],)]
    weights = [
        (rng.standard_normal(s) * np.sqrt(2 / s[0]) if len(s) == 2 else np.zeros(s)).astype(np.float32) for s in shapes
    ]
    unit, targets = unit.astype(np.float32) * np.float32(np.sqrt(unit.shape[1])), targets.astype(np.float32)
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(unit))
        for at in range(0, len(order), batch):
            x, y = unit[order[at : at + batch]], targets[order[at : at + batch]]
            hidden = np.maximum(x @ weights[0] + weights[1], 0)
            logits = hidden @ weights[2] + weights[3]
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            error = (p - y) / len(x)
            back = (error @ weights[2].T) * (hidden > 0)
            slopes = [x.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            rate = 2e-3 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, m, v in zip(weights, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    weights[0] = weights[0] * np.float32(np.sqrt(unit.shape[1]))
    return Router(tuple(w.astype(np.float64) for w in weights))


def learn_router(unit: np.ndarray, parts: int, seed: int = 42) -> Router:
    graph = neighbour_graph(unit)
    part = balanced_parts(unit, graph, parts)
    targets = np.zeros((len(unit), parts))
    np.add.at(targets, (np.arange(len(unit)), part), 1)
    for column in graph.T:
        np.add.at(targets, (np.arange(len(unit)), part[column]), 1)
    return train_router(unit, targets / targets.sum(axis=1, keepdims=True), seed)


def probes_for(router: Router, unit: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
    """The least number of probed parts that finds `recall` of the k nearest in `unit` of the queries.

    `queries` are places in `unit`. More vectors lie closer together, so over
    all of them the same number finds more.
    """
    near = unit[queries] @ unit.T
    near[np.arange(len(queries)), queries] = -np.inf
    k = min(k, len(unit) - 1)
    if not k:
        return router.parts
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(router.ranked(unit[queries]), axis=1)  # how early each part is probed
    part = router.logits(unit).argmax(axis=1)
    needed = np.sort(np.take_along_axis(place, part[best], axis=1).reshape(-1))
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
