"""A hierarchical navigable small-world graph in NumPy, searched for many queries at once."""

import numpy as np

_NONE = -1


class Graph:
    """Layers of neighbour lists over unit vectors; node 0 enters at the top layer."""

    def __init__(self, vectors: np.ndarray, degree: int = 16, beam: int = 64, seed: int = 7):
        """vectors: unit rows. Nodes are inserted in batches, each no larger than what is there already."""
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n, self.degree = len(vectors), degree
        levels = (-np.log(np.random.default_rng(seed).random(n) + 1e-300) / np.log(degree)).astype(int)
        if n:
            levels[0] = levels.max()
        self.layers = [np.full((n, 2 * degree if k == 0 else degree), _NONE, np.int32)
                       for k in range(int(levels.max(initial=0)) + 1)]
        done = 1
        while done < n:
            batch = np.arange(done, min(n, done + min(done, 256)))
            self._insert(batch, levels[batch], beam)
            done = int(batch[-1]) + 1

    def _insert(self, batch: np.ndarray, levels: np.ndarray, beam: int) -> None:
        queries = self.vectors[batch]
        within = queries @ queries.T
        entry = np.zeros(len(batch), np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            ids, sims = self._search_layer(queries, entry[:, None], k, beam)
            entry = ids[:, 0].astype(np.int64)
            mine = np.flatnonzero(levels >= k)
            if not len(mine):
                continue
            peers = np.where(mine[None, :] < mine[:, None], within[np.ix_(mine, mine)], -np.inf)
            cand = np.concatenate([ids[mine], np.broadcast_to(batch[mine], (len(mine), len(mine)))], axis=1)
            score = np.concatenate([sims[mine], peers], axis=1)
            for row, node in enumerate(batch[mine]):
                self._link(int(node), cand[row], score[row], k)

    def _link(self, node: int, cand: np.ndarray, score: np.ndarray, k: int) -> None:
        top = np.argsort(-score, kind="stable")[:4 * self.degree]
        top = top[np.isfinite(score[top])]
        chosen = self._diverse(cand[top], score[top], self.degree)
        links = self.layers[k]
        links[node, :len(chosen)] = chosen
        for other in chosen:
            free = np.flatnonzero(links[other] == _NONE)
            if len(free):
                links[other, free[0]] = node
            else:
                around = np.append(links[other], node)
                near = self.vectors[around] @ self.vectors[other]
                order = np.argsort(-near, kind="stable")
                kept = self._diverse(around[order], near[order], links.shape[1])
                links[other] = _NONE
                links[other, :len(kept)] = kept

    def _diverse(self, cand: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Best first, skipping those nearer to a chosen one; skipped ones fill what is left."""
        if len(cand) <= most:
            return cand
        between = self.vectors[cand] @ self.vectors[cand].T
        chosen, skipped = [], []
        for i in range(len(cand)):
            if len(chosen) == most:
                break
            (skipped if chosen and between[i, chosen].max() > score[i] else chosen).append(i)
        return cand[(chosen + skipped)[:most]]

    def _search_layer(self, queries: np.ndarray, entry: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` best nodes found for each query, best first; missing ones are -1 with -inf."""
        links, rows = self.layers[k], np.arange(len(queries))[:, None]
        n, spread = len(self.vectors), 4
        seen = np.zeros((len(queries), n + 1), bool)
        ids = np.full((len(queries), beam), _NONE, np.int32)
        sims = np.full((len(queries), beam), -np.inf, np.float32)
        width = entry.shape[1]
        ids[:, :width] = entry
        sims[:, :width] = np.einsum("qed,qd->qe", self.vectors[entry], queries)
        seen[rows, entry] = True
        opened = np.zeros(ids.shape, bool)
        active = np.arange(len(queries))
        while len(active):
            waiting = np.where(opened[active] | (ids[active] == _NONE), -np.inf, sims[active])
            best = np.argpartition(-waiting, min(spread, beam) - 1, axis=1)[:, :spread]
            some = np.isfinite(np.take_along_axis(waiting, best, 1))
            live = some.any(axis=1)
            active, best, some = active[live], best[live], some[live]
            if not len(active):
                break
            a = active[:, None]
            opened[a, best] |= some
            nodes = np.where(some, ids[a, best], _NONE)
            near = np.where(nodes[:, :, None] == _NONE, _NONE, links[nodes]).reshape(len(active), -1)
            near = np.sort(near, axis=1)  # a node reached twice counts once
            near[:, 1:][near[:, 1:] == near[:, :-1]] = _NONE
            new = (near != _NONE) & ~seen[a, near]
            seen[a, near] |= new
            keep = max(1, int(new.sum(axis=1).max()))
            order = np.argsort(~new, axis=1, kind="stable")[:, :keep]
            near, new = np.take_along_axis(near, order, 1), np.take_along_axis(new, order, 1)
            sim = np.where(new, np.einsum("qed,qd->qe", self.vectors[near], queries[active]), -np.inf)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_sims = np.concatenate([sims[active], sim.astype(np.float32)], axis=1)
            all_open = np.concatenate([opened[active], np.zeros(near.shape, bool)], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, top, 1)
            sims[active] = np.take_along_axis(all_sims, top, 1)
            opened[active] = np.take_along_axis(all_open, top, 1)
        ids = np.where(np.isfinite(sims), ids, _NONE)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of up to `beam` neighbours of each unit query, best first."""
        queries = np.ascontiguousarray(queries, np.float32)
        entry = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self._search_layer(queries, entry, k, 4)[0][:, :1].astype(np.int64)
        return self._search_layer(queries, entry, 0, beam)
