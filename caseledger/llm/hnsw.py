"""A hierarchical navigable small-world graph in numpy; inserts and searches run in blocks."""

from __future__ import annotations

import numpy as np

#: Links of a node in upper layers (twice as many in the lowest), width of the search when
#: inserting, nodes of a beam expanded in one step, cells of a block's visited table.
LINKS, BUILD_BEAM, STEP, VISITED = 12, 48, 4, 48 << 20


def _select(sims: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of candidates sorted by similarity (-1 none), those nearer to the node than to any
    candidate taken before them, then the nearest others, up to ``most``."""
    n, width = ids.shape
    v = vectors[np.maximum(ids, 0)]
    between = v @ v.transpose(0, 2, 1)
    taken = np.zeros((n, width), bool)
    for c in range(width):
        rival = np.where(taken[:, :c], between[:, c, :c], -2).max(1, initial=-2)
        taken[:, c] = (ids[:, c] >= 0) & (rival < sims[:, c]) & (taken[:, :c].sum(1) < most)
    order = np.argsort(np.where(taken, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    def __init__(self, vectors: np.ndarray, links: list[np.ndarray] | None = None, levels: np.ndarray | None = None, entry: int = 0):
        self.vectors, self.links, self.levels, self.entry = np.ascontiguousarray(vectors, np.float32), links or [], levels, entry

    def build(self, seed: int = 5) -> "Graph":
        n = len(self.vectors)
        rng = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(rng.random(n)) / np.log(LINKS)).astype(np.int64), 6)
        self.levels[0] = self.levels.max(initial=0)  # the first node is in every layer
        self.links = [np.full((n, LINKS * (2 if layer == 0 else 1)), -1, np.int32) for layer in range(int(self.levels.max(initial=0)) + 1)]
        done = min(n, 1)
        while done < n:
            to = min(n, done + max(1, min(done, 512)))
            self._insert(np.arange(done, to))
            done = to
        return self

    def _insert(self, new: np.ndarray):
        q = self.vectors[new]
        inner = q @ q.T
        near = np.full(len(new), self.entry)
        for layer in range(len(self.links) - 1, -1, -1):
            here = self.levels[new] >= layer
            ids, sims = self.search(layer, q, near[:, None], BUILD_BEAM if here.any() else 1)
            near = np.where(ids[:, 0] >= 0, ids[:, 0], near)
            if not here.any():
                continue
            mine = np.flatnonzero(here)
            mates = np.broadcast_to(new[mine], (len(mine), len(mine)))
            mate_sims = inner[np.ix_(mine, mine)].copy()
            np.fill_diagonal(mate_sims, -2)
            all_ids, all_sims = np.concatenate([ids[mine], mates], 1), np.concatenate([np.where(ids[mine] >= 0, sims[mine], -2), mate_sims], 1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            all_sims = np.take_along_axis(all_sims, top, 1)
            all_ids = np.where(all_sims > -2, np.take_along_axis(all_ids, top, 1), -1)
            width = self.links[layer].shape[1]
            picked = _select(all_sims, all_ids, self.vectors, LINKS)
            self.links[layer][new[mine], :LINKS] = picked
            # the other way round; nodes with too many links choose anew
            src, dst = np.repeat(new[mine], LINKS), picked.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            order = np.lexsort((-np.einsum("ij,ij->i", self.vectors[src], self.vectors[dst]), dst))
            src, dst = src[order], dst[order]
            targets, first, count = np.unique(dst, return_index=True, return_counts=True)
            room = min(int(count.max(initial=0)), 2 * width)  # nearest first
            place = np.arange(len(dst)) - np.repeat(first, count)
            extra = np.full((len(targets), room), -1, np.int64)
            fits = place < room
            extra[np.repeat(np.arange(len(targets)), count)[fits], place[fits]] = src[fits]
            pool = np.concatenate([self.links[layer][targets].astype(np.int64), extra], 1)
            sims = np.where(pool >= 0, np.einsum("ijk,ik->ij", self.vectors[np.maximum(pool, 0)], self.vectors[targets]), -2)
            order = np.argsort(-sims, axis=1, kind="stable")
            pool, sims = np.take_along_axis(pool, order, 1), np.take_along_axis(sims, order, 1)
            twice = np.zeros(pool.shape, bool)
            twice[:, 1:] = (pool[:, 1:] == pool[:, :-1]) & (pool[:, 1:] >= 0)
            pool[twice] = -1
            self.links[layer][targets] = _select(np.where(pool >= 0, sims, -2), pool, self.vectors, width)

    def search(self, layer: int, q: np.ndarray, start: np.ndarray, beam: int, found=None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sims) of each query's beam, nearest first, -1 where it isn't full.
        ``found(queries, ids, sims)`` sees every node that is met."""
        b, n = len(q), len(self.vectors)
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -2, np.float32)
        visited = np.zeros((b, n), bool)
        rows = np.arange(b)
        k = min(start.shape[1], beam)
        for c in range(k):
            fresh = ~visited[rows, start[:, c]]
            visited[rows, start[:, c]] = True
            s = np.einsum("ij,ij->i", self.vectors[start[:, c]], q)
            ids[fresh, c], sims[fresh, c] = start[fresh, c], s[fresh]
            if found:
                found(rows[fresh], start[fresh, c], s[fresh])
        expanded = np.zeros((b, beam), bool)
        live = rows
        while len(live):
            open_sims = np.where(expanded[live] | (ids[live] < 0), -3, sims[live])
            step = min(STEP, beam)
            best = np.argpartition(-open_sims, step - 1, axis=1)[:, :step] if step < beam else np.broadcast_to(np.arange(beam), (len(live), beam))
            ok = np.take_along_axis(open_sims, best, 1) > -3
            go = ok.any(1)
            live, best, ok = live[go], best[go], ok[go]
            if not len(live):
                break
            nodes = np.where(ok, ids[live[:, None], best], 0)
            expanded[live[:, None], best] |= ok
            out = self.links[layer][nodes].astype(np.int64)
            out[~ok] = -1
            out = out.reshape(len(live), -1)
            who = np.broadcast_to(np.arange(len(live))[:, None], out.shape)
            take = out >= 0
            take[take] = ~visited[live[who[take]], out[take]]
            w, o = who[take], out[take]
            if not len(w):
                continue
            pair = np.unique(w * n + o)
            w, o = pair // n, pair % n
            visited[live[w], o] = True
            s = np.einsum("ij,ij->i", self.vectors[o], q[live[w]])
            if found:
                found(live[w], o, s)
            # new nodes as a table, then the best of both
            count = np.bincount(w, minlength=len(live))
            place = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
            new_ids = np.full((len(live), int(count.max())), -1, np.int64)
            new_sims = np.full(new_ids.shape, -2, np.float32)
            new_ids[w, place], new_sims[w, place] = o, s
            all_ids, all_sims = np.concatenate([ids[live], new_ids], 1), np.concatenate([sims[live], new_sims], 1)
            done = np.concatenate([expanded[live], np.zeros(new_ids.shape, bool)], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] if all_sims.shape[1] > beam else np.broadcast_to(np.arange(beam), (len(live), beam))
            ids[live], sims[live], expanded[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, done))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs met with a similarity of at least ``least``. A query whose
        beam is full of such nodes is searched again with one twice as wide."""
        if not len(self.vectors):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit_q, hit_n = [], []
        block = max(1, min(1024, VISITED // len(self.vectors)))
        for lo in range(0, len(q), block):
            part = np.ascontiguousarray(q[lo:lo + block], np.float32)
            near = np.full((len(part), 1), self.entry)
            for layer in range(len(self.links) - 1, 0, -1):
                near = np.maximum(self.search(layer, part, near, 1)[0], 0)
            todo, wide = np.arange(len(part)), min(beam, len(self.vectors))
            while len(todo):
                got: list[tuple[np.ndarray, np.ndarray]] = []

                def found(w, o, s, got=got):
                    keep = s >= least
                    if keep.any():
                        got.append((w[keep], o[keep]))

                _, sims = self.search(0, part[todo], near[todo], wide, found)
                full = (sims[:, -1] >= least) & (wide < len(self.vectors))
                if got:
                    w, o = (np.concatenate(x) for x in zip(*got))
                    keep = ~full[w]
                    hit_q.append(todo[w[keep]] + lo)
                    hit_n.append(o[keep])
                todo, wide = todo[full], min(2 * wide, len(self.vectors))
        none = np.zeros(0, np.int64)
        return (np.concatenate(hit_q), np.concatenate(hit_n)) if hit_q else (none, none)
