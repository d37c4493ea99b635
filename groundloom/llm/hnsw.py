"""Hierarchical navigable small-world graphs over unit vectors, built and searched for many points at once with numpy."""

from __future__ import annotations

import numpy as np

NEIGHBOURS = 16
BUILD_BEAM = 48
BATCH = 512


def _chosen(vectors: np.ndarray, points: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates (ids, -1 for none, best first) at most ``most`` of them: first those that are nearer to the row's
    own point than to any candidate chosen before, so that links lead into different directions, then the nearest of the rest."""
    count = points.shape[1]
    near = vectors[points]
    among = np.matmul(near, near.transpose(0, 2, 1))
    chosen = np.zeros(points.shape, bool)
    barred = np.full(points.shape, -np.inf, np.float32)
    for c in range(count):
        chosen[:, c] = (points[:, c] >= 0) & (barred[:, c] < sims[:, c]) & (chosen.sum(1) < most)
        barred = np.where(chosen[:, c, None], np.maximum(barred, among[:, c]), barred)
    order = np.argsort(np.where(chosen, 0, np.where(points >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(points, order, 1)


class Layer:
    """One graph over the first points of an insertion order; ``links`` has up to ``width`` neighbours per point, -1 for none."""

    def __init__(self, vectors: np.ndarray, width: int):
        self.vectors, self.width = vectors, width
        self.links = np.full((len(vectors), width), -1, np.int32)

    def search(self, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of up to ``beam`` nearest points per query, best first, by best-first walks from the entries."""
        q, n = len(queries), len(self.vectors)
        ids = np.full((q, beam), -1, np.int32)
        sims = np.full((q, beam), -np.inf, np.float32)
        opened = np.ones((q, beam), bool)
        seen = np.zeros((q, n), bool)
        k = min(entries.shape[1], beam)
        entries = entries[:, :k]
        valid = entries >= 0
        np.put_along_axis(seen, np.where(valid, entries, entries[:, :1]), True, 1)
        ids[:, :k] = entries
        sims[:, :k] = np.where(valid, np.einsum("qkd,qd->qk", self.vectors[entries], queries), -np.inf)
        opened[:, :k] = ~valid
        active = np.arange(q)
        while len(active):
            waiting = np.where(opened[active], -np.inf, sims[active])
            at = waiting.argmax(1)
            best = waiting[np.arange(len(active)), at]
            go = best > -np.inf
            active, at = active[go], at[go]
            if not len(active):
                break
            opened[active, at] = True
            around = self.links[ids[active, at]]
            fresh = (around >= 0) & ~seen[active[:, None], around]
            rows, cols = np.nonzero(fresh)
            seen[active[rows], around[rows, cols]] = True
            near = np.full(around.shape, -np.inf, np.float32)
            near[rows, cols] = np.einsum("nd,nd->n", self.vectors[around[rows, cols]], queries[active[rows]])
            all_sims = np.concatenate([sims[active], near], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, top, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, around, -1)], 1), top, 1)
            opened[active] = np.take_along_axis(np.concatenate([opened[active], ~fresh], 1), top, 1)
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def insert(self, begin: int, end: int, found: np.ndarray, sims: np.ndarray) -> None:
        """Link points ``begin`` to ``end`` to the best of the points found for them and of each other, in both directions."""
        own = np.arange(begin, end, dtype=np.int32)
        inner = self.vectors[begin:end] @ self.vectors[begin:end].T
        np.fill_diagonal(inner, -np.inf)
        points = np.concatenate([found, np.broadcast_to(own, inner.shape)], 1)
        every = np.concatenate([sims, inner], 1)
        points = np.where(every > -np.inf, points, -1)
        order = np.argsort(-every, axis=1)[:, :BUILD_BEAM]
        points, every = np.take_along_axis(points, order, 1), np.take_along_axis(every, order, 1)
        links = _chosen(self.vectors, points, every, self.width // 2)
        self.links[begin:end, : links.shape[1]] = links
        source = np.repeat(own, links.shape[1])
        target = links.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        for width in (8, 64, end - begin):
            part = np.flatnonzero(counts <= width) if width == 8 else np.flatnonzero((counts <= width) & (counts > (8 if width == 64 else 64)))
            for at in range(0, len(part), 256):
                chunk = part[at : at + 256]
                most = int(counts[chunk].max())
                slots = first[chunk, None] + np.arange(most)
                new = np.where(np.arange(most) < counts[chunk, None], source[np.minimum(slots, len(source) - 1)], -1)
                old = self.links[nodes[chunk]]
                new = np.where((new[:, :, None] == old[:, None, :]).any(2), -1, new)
                both = np.concatenate([old, new], 1)
                near = np.where(both >= 0, np.einsum("nkd,nd->nk", self.vectors[both], self.vectors[nodes[chunk]]), -np.inf).astype(np.float32)
                order = np.argsort(-near, axis=1)[:, : max(self.width, BUILD_BEAM)]
                self.links[nodes[chunk]] = _chosen(self.vectors, np.take_along_axis(both, order, 1), np.take_along_axis(near, order, 1), self.width)


class Graph:
    """Layers of fewer and fewer points over the same insertion order: layer ``l`` holds the first ``sizes[l]`` points."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        sizes = [len(vectors)]
        while sizes[-1] > 2 * NEIGHBOURS:
            sizes.append(sizes[-1] // NEIGHBOURS)
        self.layers = [Layer(self.vectors[:n], 2 * NEIGHBOURS) for n in sizes]
        if layers is None:
            for level in range(len(sizes) - 1, -1, -1):
                self._build(level)
        else:
            for layer, links in zip(self.layers, layers, strict=True):
                layer.links = links

    def _build(self, level: int) -> None:
        layer, at = self.layers[level], 0
        while at < len(layer.vectors):
            end = min(len(layer.vectors), at + min(BATCH, max(32, at)))
            if at:
                queries = layer.vectors[at:end]
                # Points of the layer above are the first of this one, so entries found there may not be linked here yet.
                entries = np.zeros((len(queries), 1), np.int32) if level == len(self.layers) - 1 else np.minimum(self._entries(queries, level), at - 1)
                found, sims = layer.search(queries, entries, BUILD_BEAM)
            else:
                found, sims = np.zeros((end, 0), np.int32), np.zeros((end, 0), np.float32)
            layer.insert(at, end, found, sims)
            at = end

    def _entries(self, queries: np.ndarray, level: int) -> np.ndarray:
        top = self.layers[-1].vectors
        entries = np.argsort(-(queries @ top.T), axis=1)[:, :4].astype(np.int32)
        for layer in self.layers[-2:level:-1]:
            entries = layer.search(queries, entries, 8)[0][:, :4]
        return entries

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of up to ``beam`` points per query, in slices that keep the marks of seen points small."""
        queries = np.ascontiguousarray(queries, np.float32)
        step = max(16, min(2048, (1 << 25) // max(1, len(self.vectors))))
        parts = [self.layers[0].search(queries[at : at + step], self._entries(queries[at : at + step], 0), min(beam, len(self.vectors))) for at in range(0, len(queries), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
