"""A robust-pruned directed proximity graph over one shard of unit vectors.

Pure numpy, no Spark. The build follows the batch-insert scheme of the
published Vamana / ParlayANN papers: points are inserted in growing batches;
every batch runs one greedy (beam) search per point against the graph built so
far, the visited nodes and the neighbours become candidates, and relaxed
distance pruning keeps a diverse subset of at most ``degree`` out-edges. All
searches of a batch advance in lockstep, so each step is a handful of numpy
calls over the whole batch and the interpreter cost is shared by hundreds of
points.

Similarity is the inner product of unit vectors (cosine); the pruning rule
works on squared Euclidean distance ``2 - 2 * cos``.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(-1)


class ShardGraph:
    """Index of ``points`` (n x d, unit rows, float32).

    degree: out-edges kept per node. beam: width of the search beam.
    alpha: relaxation of the pruning rule (1.0 = strict; larger keeps longer
    edges). entries: points where searches start, spread over the shard.
    A shard of 0 or 1 points gives an index whose searches return what there is.
    """

    def __init__(self, points: np.ndarray, degree: int = 48, beam: int = 20, alpha: float = 1.1, entries: int = 256):
        self.x = np.ascontiguousarray(points, dtype=np.float32)
        self.n = len(self.x)
        self.degree, self.beam, self.alpha2 = degree, beam, alpha * alpha
        self.edges = np.full((self.n, degree), NONE, dtype=np.int32)
        step = max(1, self.n // max(1, entries))
        self.entry = np.arange(0, self.n, step, dtype=np.int32)[: max(1, entries)]
        if self.n > 1:
            self._build()

    # -- search -----------------------------------------------------------
    def search(self, queries: np.ndarray, k: int, beam: int | None = None, limit: int | None = None, starts: int = 6):
        """Beam search of every query: (ids, similarities), each (q x k), -1 / -inf where there are fewer."""
        ids, sims = [], []
        block = 1024
        for a in range(0, len(queries), block):
            i, s = self._beam(queries[a : a + block], beam or self.beam, limit or self.n, starts)
            ids.append(i[:, :k])
            sims.append(s[:, :k])
        if not ids:
            return np.empty((0, k), np.int32), np.empty((0, k), np.float32)
        return np.concatenate(ids), np.concatenate(sims)

    def _beam(self, q: np.ndarray, beam: int, limit: int, starts: int = 2):
        """Lockstep beam search among the first ``limit`` inserted points."""
        b = len(q)
        entry = self.entry[self.entry < limit]
        first = q @ self.x[entry].T
        m = min(starts, len(entry))
        top = np.argpartition(-first, m - 1, axis=1)[:, :m] if m < len(entry) else np.tile(np.arange(m), (b, 1))
        ids = np.full((b, beam), NONE, np.int32)
        sims = np.full((b, beam), -np.inf, np.float32)
        open_ = np.zeros((b, beam), bool)
        m = min(m, beam)
        ids[:, :m] = entry[top[:, :m]]
        sims[:, :m] = np.take_along_axis(first, top[:, :m], 1)
        open_[:, :m] = True
        seen = np.zeros((b, limit), bool)
        rows = np.arange(b)
        seen[rows[:, None], ids[:, :m]] = True
        live = rows
        while len(live):
            o = np.where(open_[live], sims[live], -np.inf)
            at = o.argmax(1)
            going = o[np.arange(len(live)), at] > -np.inf
            live, at = live[going], at[going]
            if not len(live):
                break
            open_[live, at] = False
            nb = self.edges[ids[live, at]]
            fresh = nb >= 0
            fresh &= ~seen[live[:, None], np.where(fresh, nb, 0)]
            r, c = np.nonzero(fresh)
            who, new = live[r], nb[r, c]
            seen[who, new] = True
            s = np.einsum("ij,ij->i", q[who], self.x[new])
            grid = np.full(nb.shape, -np.inf, np.float32)
            grid[r, c] = s
            alls = np.concatenate([sims[live], grid], 1)
            pick = np.argpartition(-alls, beam - 1, axis=1)[:, :beam]
            alli = np.concatenate([ids[live], nb], 1)
            allo = np.concatenate([open_[live], fresh], 1)
            sims[live] = np.take_along_axis(alls, pick, 1)
            ids[live] = np.take_along_axis(alli, pick, 1)
            open_[live] = np.take_along_axis(allo, pick, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        ids = np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), NONE)
        return ids, sims

    # -- build ------------------------------------------------------------
    def _build(self):
        done = min(self.n, max(2 * self.degree, 32))
        base = np.arange(done, dtype=np.int32)
        self._connect(base, np.tile(base, (done, 1)))
        while done < self.n:
            new = np.arange(done, min(self.n, done + max(64, min(done, 1024))), dtype=np.int32)
            found, _ = self._beam(self.x[new], self.beam, done)
            self._connect(new, found)
            done = new[-1] + 1

    def _connect(self, nodes: np.ndarray, cand: np.ndarray):
        """Sets the out-edges of ``nodes`` from their candidates, then adds the reverse edges, pruning where full."""
        self.edges[nodes] = self._prune(nodes, cand)
        out = self.edges[nodes]
        keep = out >= 0
        dst, src = out[keep], np.repeat(nodes, self.degree).reshape(out.shape)[keep]
        order = np.argsort(dst, kind="stable")
        dst, src = dst[order], src[order]
        targets, begin, count = np.unique(dst, return_index=True, return_counts=True)
        width = min(int(count.max(initial=0)), 2 * self.degree)
        if not len(targets):
            return
        place = np.arange(len(dst)) - np.repeat(begin, count)
        inside = place < width
        extra = np.full((len(targets), width), NONE, np.int32)
        extra[np.repeat(np.arange(len(targets)), count)[inside], place[inside]] = src[inside]
        old = self.edges[targets]
        both = np.concatenate([old, extra], 1)
        free = (both >= 0).sum(1) <= self.degree
        if free.any():
            packed = np.take_along_axis(both[free], np.argsort(both[free] < 0, axis=1, kind="stable"), 1)
            self.edges[targets[free]] = packed[:, : self.degree]
        if (~free).any():
            self.edges[targets[~free]] = self._prune(targets[~free], both[~free])

    def _prune(self, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Robust pruning: the nearest candidate is kept, and drops those it is nearer to, by the factor alpha, than the node is."""
        out = np.full((len(nodes), self.degree), NONE, np.int32)
        block = 2048
        for a in range(0, len(nodes), block):
            p, c = nodes[a : a + block], cand[a : a + block]
            ok = (c >= 0) & (c != p[:, None])
            cx = self.x[np.where(ok, c, 0)]
            sim = np.matmul(cx, self.x[p][:, :, None])[:, :, 0]
            sim[~ok] = -np.inf
            order = np.argsort(-sim, axis=1, kind="stable")
            sim = np.take_along_axis(sim, order, 1)
            c = np.take_along_axis(c, order, 1)
            cx = np.take_along_axis(cx, order[:, :, None], 1)
            among = 2.0 - 2.0 * np.matmul(cx, cx.transpose(0, 2, 1))
            mine = 2.0 - 2.0 * sim
            alive = sim > -np.inf
            rows = np.arange(len(p))
            for slot in range(self.degree):
                at = alive.argmax(1)
                some = alive[rows, at]
                if not some.any():
                    break
                out[a + rows[some], slot] = c[rows[some], at[some]]
                close = self.alpha2 * among[rows, at] <= mine
                alive &= ~(close & some[:, None])
                alive[rows, at] = False
        return out
