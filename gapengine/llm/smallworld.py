"""Hierarchical navigable small-world graphs over one shard of vectors, built and searched many vectors at a time.

All steps are array operations over a batch of vectors: a beam per vector, of
which the best not yet expanded entries are expanded together.
"""

from __future__ import annotations

import numpy as np

from gapengine.llm.wordhash import mix

EXPANDED_AT_ONCE = 3


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Graph:
    """``layers[0]`` holds all rows; layer l > 0 a random 1 / degree of layer l - 1.

    A layer is (rows, neighbours): row numbers ascending, and for each the
    row numbers of its neighbours, -1 where it has fewer.
    """

    def __init__(self, units: np.ndarray, ids: np.ndarray, degree: int = 16, beam: int = 48, batch: int = 512):
        self.units = units.astype(np.float32)
        self.degree, self.batch = degree, batch
        chance = (mix(ids.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        level = np.floor(-np.log(np.maximum(chance, 1e-300)) / np.log(degree)).astype(int) if len(ids) else np.zeros(0, int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for top in range(int(level.max()) + 1 if len(level) else 0):
            rows = np.flatnonzero(level >= top)
            self.layers.append((rows, np.full((len(self.units), 2 * degree if top == 0 else degree), -1, dtype=np.int32)))
        for top in range(len(self.layers) - 1, -1, -1):
            self._build(top, beam)

    @classmethod
    def restored(cls, units: np.ndarray, degree: int, batch: int, layers: list[tuple[np.ndarray, np.ndarray]]) -> Graph:
        self = cls.__new__(cls)
        self.units, self.degree, self.batch, self.layers = units.astype(np.float32), degree, batch, layers
        return self

    def _build(self, top: int, beam: int) -> None:
        """Insert the layer's rows in batches; each may be as large as what is there already."""
        rows, links = self.layers[top]
        done = 0
        while done < len(rows):
            new = rows[done : done + min(self.batch, max(done, 32))]
            own = self.units[new] @ self.units[new].T
            np.fill_diagonal(own, -2)
            near = min(len(new) - 1, beam // 2)
            inside = np.argpartition(-own, near - 1, axis=1)[:, :near] if near > 0 else np.zeros((len(new), 0), int)
            found, sims = new[inside], np.take_along_axis(own, inside, axis=1)
            if done:
                ids, values = self._beam(self.units[new], self._entries(self.units[new], top, rows[0]), links, beam)
                found, sims = np.concatenate([found, ids], axis=1), np.concatenate([sims, values], axis=1)
            links[new] = self._diverse(found, sims, links.shape[1])
            self._link_back(links, new)
            done += len(new)

    def _diverse(self, found: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates, nearest first, leaving out those nearer to one chosen than to the row;
        what is left over fills up free places."""
        sims = np.where(found < 0, -3, sims)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most]
        found, sims = np.take_along_axis(found, order, axis=1), np.take_along_axis(sims, order, axis=1)
        vectors = self.units[found]
        among = vectors @ vectors.transpose(0, 2, 1)
        chosen = np.zeros(found.shape, dtype=bool)
        for c in range(found.shape[1]):
            hidden = ((among[:, c, :] > sims[:, c, None]) & chosen).any(axis=1)
            chosen[:, c] = (sims[:, c] > -2) & ~hidden & (chosen.sum(axis=1) < most)
        first = np.argsort(~chosen * 2 + (sims <= -2), axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(sims, first, axis=1) > -2, np.take_along_axis(found, first, axis=1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link_back(self, links: np.ndarray, new: np.ndarray) -> None:
        """Each neighbour of a new row links back; a full one chooses again among old and new."""
        width = links.shape[1]
        source = np.repeat(new, width)
        target = links[new].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        rows, start, count = np.unique(target, return_index=True, return_counts=True)
        for part in range(0, len(rows), self.batch):
            r, s, n = rows[part : part + self.batch], start[part : part + self.batch], count[part : part + self.batch]
            take = np.arange(int(n.max()))
            incoming = np.where(take < n[:, None], source[np.minimum(s[:, None] + take, len(source) - 1)], -1)
            if incoming.shape[1] > 2 * width:
                near = np.where(incoming < 0, -3, self._sims(self.units[r], incoming))
                incoming = np.take_along_axis(incoming, np.argsort(-near, axis=1)[:, : 2 * width], axis=1)
            known = (incoming[:, :, None] == links[r][:, None, :]).any(axis=2)
            both = np.concatenate([links[r], np.where(known, -1, incoming)], axis=1)
            links[r] = self._diverse(both, self._sims(self.units[r], both), width)

    def _sims(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.matmul(self.units[rows], queries[:, :, None])[:, :, 0]

    def _entries(self, queries: np.ndarray, above: int, default: int) -> np.ndarray:
        """The row of layer ``above`` + 1 to which greedy descent from the top leads."""
        at = np.full(len(queries), self.layers[-1][0][0] if len(self.layers) - 1 > above else default)
        value = self._sims(queries, at[:, None])[:, 0]
        for layer in range(len(self.layers) - 1, above, -1):
            links = self.layers[layer][1]
            while True:
                around = links[at]
                sims = np.where(around < 0, -3, self._sims(queries, around))
                best = sims.argmax(axis=1)
                better = sims[np.arange(len(at)), best] > value
                if not better.any():
                    break
                at = np.where(better, around[np.arange(len(at)), best], at)
                value = np.where(better, sims[np.arange(len(at)), best], value)
        return at

    def _beam(self, queries: np.ndarray, entry: np.ndarray, links: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best rows that expansion from ``entry`` finds, with their similarities; -1 fills up."""
        n = len(queries)
        ids = np.full((n, beam), -1, dtype=np.int64)
        sims = np.full((n, beam), -3, dtype=np.float32)
        open_ = np.zeros((n, beam), dtype=bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = entry, self._sims(queries, entry[:, None])[:, 0], True
        seen = np.zeros((n, len(self.units)), dtype=bool)
        seen[np.arange(n), entry] = True
        active = np.arange(n)
        while len(active):
            rank = np.where(open_[active], sims[active], -4)
            width = min(EXPANDED_AT_ONCE, beam)
            pick = np.argpartition(-rank, width - 1, axis=1)[:, :width]
            chosen = np.take_along_axis(rank, pick, axis=1) > -3
            at = np.take_along_axis(ids[active], pick, axis=1)
            open_[active[:, None], pick] = False
            around = np.where(chosen[:, :, None], links[np.where(chosen, at, 0)], -1).reshape(len(active), -1)
            around = np.sort(around, axis=1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            fresh = (around >= 0) & ~seen[active[:, None], around]
            seen[active[:, None], np.where(fresh, around, entry[active][:, None])] = True
            got = np.where(fresh, self._sims(queries[active], around), -3)
            every = np.concatenate([sims[active], got], axis=1)
            best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, around, -1)], axis=1), best, axis=1)
            sims[active] = np.take_along_axis(every, best, axis=1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], fresh], axis=1), best, axis=1)
            active = active[open_[active].any(axis=1)]
        return ids, sims

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        queries = queries.astype(np.float32)
        beam = min(beam, len(self.units))
        out = [self._beam(q, self._entries(q, 0, self.layers[0][0][0]), self.layers[0][1], beam)
               for q in (queries[s : s + self.batch] for s in range(0, len(queries), self.batch))]
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
