"""The most similar vectors of every vector by robust-pruned directed graphs.

Vectors are routed to the two nearest of a set of centres, found through a hierarchy of two levels (fitted on a bounded
sample that grows with the centres); what a centre gets is a shard, whose size stays the same as the table grows. In
each shard a directed graph is built from its first node on: greedy searches of the graph so far propose neighbours for the next
points, a relaxed distance test keeps edges of diverse directions, reverse edges are added and pruned likewise. Then a beam search
runs for every vector in each shard it is in, all vectors of a block in step, so that every step is a few array operations. The
candidates are scored again in double precision and the shards' lists merged.

Vectors of one direction are searched once and their rows put back afterwards. Where candidates tie with the last place, the part
is scanned by id, so that ties are exact however many there are. A shard with more members than MAX_SHARD is split at
random into parts; each of its vectors is a node of one part and is searched for in every part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skarn.runtime import checkpointed, need

#: Different vectors in the sample that the centres are fitted on: at least SAMPLE, else SAMPLE_PER for every centre.
SAMPLE, SAMPLE_PER = 20_000, 20
#: Rows per centre while the square root of the rows over ROOT asks for more centres than that.
PER_CENTRE, ROOT = 2000, 5
#: Most centres, and most nodes of one graph. Up to 1.3e9 rows there are enough centres for shards of MAX_SHARD.
MAX_CENTRES, MAX_SHARD = 65_536, 60_000
#: Groups of centres that a vector's nearest centres are looked for in.
BRANCHES = 8
#: Out-edges per node, slots before a node is pruned again, and the factor of the relaxed distance test.
DEGREE, SLOTS, RELAX = 28, 44, 1.02
#: Kept candidates of a search, nodes expanded per step, steps when building, when querying and when going on, entry points.
BEAM, WIDTH, BUILD_STEPS, QUERY_STEPS, AGAIN_STEPS, ENTRIES = 64, 10, 2, 3, 2, 48
#: Nodes among which a search picks where it enters, at most.
TOP = 256
#: Found neighbours that a node passes on.
LISTED = 24
#: Queries that are searched for in step.
BLOCK = 192
#: Copies of one vector above which only one of them is routed; at most HOT_SHARE of all rows' classes can be that large.
HOT, HOT_SHARE = 1000, 10_000
SALTS = 32
#: Centres with a cosine above this are one.
SAME_CENTRE = 1 - 1e-5
#: Unit vectors that agree in so many steps per unit are one direction; cosines closer than NEAR may round alike.
STEPS, NEAR = 1e10, 1e-6
#: Candidates kept beyond k, nodes scanned at first for ties (four times as many each time), and similarities per scan.
SPARE, SCAN, SCANNED = 4, 2048, 1 << 22


def fit_centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres of unit vectors by a few rounds of spherical k-means; of equal vectors one counts, and no two centres are (nearly) equal."""
    rng = np.random.default_rng(seed)
    x = x[np.sort(np.unique(np.round(x, 6) + 0.0, axis=0, return_index=True)[1])]
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    same = np.triu(c @ c.T > SAME_CENTRE, 1)
    keep = np.ones(len(c), bool)
    for i in range(len(c)):
        if keep[i]:
            keep &= ~same[i]
    return c[keep]


class Centres:
    """Centres in two levels: about the square root of ``k`` groups, each with centres by its share of the sample."""

    def __init__(self, x: np.ndarray, k: int):
        self.top = fit_centres(x, max(1, round(k**0.5)))
        group = np.argmax(x @ self.top.T, axis=1)
        parts = []
        for g in range(len(self.top)):
            own = x[group == g]
            parts.append(fit_centres(own, max(1, round(k * len(own) / len(x)))) if len(own) else self.top[g : g + 1])
        self.all = np.concatenate(parts)
        self.ends = np.cumsum([len(p) for p in parts])

    def __len__(self) -> int:
        return len(self.all)

    def nearest(self, x: np.ndarray, copies: int) -> np.ndarray:
        """The ``copies`` nearest centres of every row, in no order, among those of its BRANCHES nearest groups."""
        b = min(BRANCHES, len(self.top))
        groups = np.argpartition(-(x @ self.top.T), b - 1, axis=1)[:, :b]
        ids, sims = np.full((len(x), copies), -1, np.int64), np.full((len(x), copies), -np.inf, np.float32)
        row, _ = np.divmod(np.argsort(groups.ravel(), kind="stable"), b)
        ends = np.cumsum(np.bincount(groups.ravel(), minlength=len(self.top)))
        for g in range(len(self.top)):
            r = row[ends[g - 1] if g else 0 : ends[g]]
            if len(r):
                first = self.ends[g - 1] if g else 0
                s = x[r] @ self.all[first : self.ends[g]].T
                both = np.concatenate([sims[r], s], 1)
                names = np.concatenate([ids[r], np.broadcast_to(np.arange(first, self.ends[g]), s.shape)], 1)
                keep = np.argpartition(-both, copies - 1, axis=1)[:, :copies]
                sims[r], ids[r] = np.take_along_axis(both, keep, 1), np.take_along_axis(names, keep, 1)
        # Groups of few centres may leave places open: the nearest centre stands in, and the row goes there once more.
        return np.where(ids >= 0, ids, ids.max(axis=1, keepdims=True))


class ShardGraph:
    """A robust-pruned directed graph over the rows of a matrix of unit vectors."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n = len(x)
        self.edges = np.full((n, SLOTS), -1, np.int32)
        self.used = np.zeros(n, np.int32)
        #: each node's best candidates from its insertion: where its own search goes on from
        self.near = np.full((n, BEAM), -1, np.int32)
        done = 1
        while done < n:
            step = min(n - done, done)
            for a in range(done, done + step, BLOCK):
                block = np.arange(a, min(a + BLOCK, done + step))
                ids, sims = self.search(self.x[block], self._entries(self.x[block], done), BUILD_STEPS, done)
                self.near[block] = ids
                self._link(block, ids, sims)
            done += step

    def _entries(self, q: np.ndarray, n: int) -> np.ndarray:
        """Where searches among the first n nodes enter: the ENTRIES nearest of the first TOP."""
        s = q @ self.x[: min(n, TOP)].T
        return np.argpartition(-s, min(ENTRIES, s.shape[1]) - 1, axis=1)[:, :ENTRIES].astype(np.int32)

    def search(self, q: np.ndarray, start: np.ndarray, steps: int, n: int, own: np.ndarray | None = None, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search among the first n nodes for every row of q: ids and similarities of the BEAM best found, unsorted; -1 where there are fewer."""
        edges = self.edges if edges is None else edges
        b = len(q)
        row = np.arange(b)[:, None]
        seen = np.zeros((b, n + 1), bool)  # the last column stands for "no node"
        seen[:, n] = True
        if own is not None:
            seen[np.arange(b), own] = True
        ids = np.sort(np.where(start < 0, n, start), axis=1)
        fresh = ~seen[row, ids]
        fresh[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        seen[row, ids] = True
        sims = np.where(fresh, np.matmul(self.x[np.minimum(ids, n - 1)], q[:, :, None])[:, :, 0], -np.inf)
        pool, score = _best(ids, sims, BEAM)
        spent = np.zeros(pool.shape, bool)
        for _ in range(steps):
            rank = np.where(spent, -np.inf, score)
            pick = np.argpartition(-rank, WIDTH - 1, axis=1)[:, :WIDTH] if rank.shape[1] > WIDTH else np.broadcast_to(np.arange(rank.shape[1]), rank.shape)
            live = rank[row, pick] > -np.inf
            if not live.any():
                break
            spent[row, pick] = True
            nb = np.where(live[:, :, None], edges[np.maximum(pool[row, pick], 0)], -1).reshape(b, -1)
            nb = np.sort(np.where((nb < 0) | (nb >= n), n, nb), axis=1)
            fresh = ~seen[row, nb]
            fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            seen[row, nb] = True
            # Fresh nodes to the front, so that only as many columns are scored as some query needs.
            order = np.argsort(~fresh, axis=1, kind="stable")[:, : max(1, int(fresh.sum(1).max()))]
            nb, fresh = nb[row, order], fresh[row, order]
            sims = np.where(fresh, np.matmul(self.x[np.minimum(nb, n - 1)], q[:, :, None])[:, :, 0], -np.inf)
            both_id, both = np.concatenate([pool, np.where(fresh, nb, -1)], 1), np.concatenate([score, sims], 1)
            both_spent = np.concatenate([spent, np.zeros(nb.shape, bool)], 1)
            keep = np.argpartition(-both, BEAM - 1, axis=1)[:, :BEAM] if both.shape[1] > BEAM else np.broadcast_to(np.arange(both.shape[1]), both.shape)
            pool, score, spent = both_id[row, keep], both[row, keep], both_spent[row, keep]
        return _pad(np.where(score > -np.inf, pool, -1), -1), _pad(score, -np.inf)

    def _prune(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """At most DEGREE of each row's candidates: near first, none that a kept one is RELAX times closer to.

        Up to half of them may be nodes at distance 0, which would else exclude each other.
        """
        order = np.argsort(-sims, axis=1)
        row = np.arange(len(ids))[:, None]
        ids, sims = ids[row, order], sims[row, order]
        v = self.x[np.maximum(ids, 0)]
        # squared distances of unit vectors, to the node and between candidates
        far = 2 - 2 * sims
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        open_ = ids >= 0
        out = np.full((len(ids), DEGREE), -1, np.int32)
        r = np.arange(len(ids))
        for k in range(DEGREE):
            j = np.argmax(open_, axis=1)
            ok = open_[r, j]
            if not ok.any():
                break
            out[ok, k] = ids[r, j][ok]
            shut = (RELAX * RELAX) * between[r, j] <= far
            open_ &= ~(shut & (far > 2 * NEAR) if k < DEGREE // 2 - 1 else shut)
            open_[r, j] = False
        return out

    def _link(self, block: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        keep = self._prune(ids, sims)
        self.edges[block, :DEGREE] = keep
        self.used[block] = (keep >= 0).sum(1)
        # Reverse edges, grouped by the node they start at.
        r, k = np.nonzero(keep >= 0)
        src, dst = keep[r, k], block[r].astype(np.int32)
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.diff(src, prepend=-1))
        place = np.arange(len(src)) - np.repeat(first, np.diff(np.append(first, len(src)))) + self.used[src]
        fits = place < SLOTS
        self.edges[src[fits], place[fits]] = dst[fits]
        nodes = src[first]
        self.used[nodes] = np.minimum(SLOTS, self.used[nodes] + np.diff(np.append(first, len(src))))
        full = nodes[self.used[nodes] >= SLOTS]
        for a in range(0, len(full), BLOCK):
            part = full[a : a + BLOCK]
            cand = self.edges[part]
            s = np.matmul(self.x[np.maximum(cand, 0)], self.x[part][:, :, None])[:, :, 0]
            kept = self._prune(cand, np.where(cand >= 0, s, -np.inf))
            self.edges[part] = -1
            self.edges[part, :DEGREE] = kept
            self.used[part] = (kept >= 0).sum(1)

    def neighbours(self, k: int) -> np.ndarray:
        """For every node the ids of its k best found (-1 where there are fewer).

        Every node is searched for, then what it found is also offered the other way round, and
        the search goes on for AGAIN_STEPS from the union, over the lists of what was found.
        """
        n = len(self.x)
        ids, sims = np.empty((n, BEAM), np.int32), np.empty((n, BEAM), np.float32)
        for a in range(0, n, BLOCK):
            block = np.arange(a, min(a + BLOCK, n))
            start = np.concatenate([self.near[block], self.edges[block]], 1)
            ids[block], sims[block] = self.search(self.x[block], start, QUERY_STEPS, n, own=block)
        found = _best(ids, sims, LISTED)[0]
        ids = np.concatenate([ids, self._back(found)], 1)
        out = np.empty((n, k), np.int32)
        for a in range(0, n, BLOCK):
            block = np.arange(a, min(a + BLOCK, n))
            got, score = self.search(self.x[block], ids[block], AGAIN_STEPS, n, own=block, edges=found)
            out[block] = _best(got, score, k)[0]
        return out

    @staticmethod
    def _back(found: np.ndarray) -> np.ndarray:
        """For each node up to LISTED nodes that list it."""
        n = len(found)
        src, col = np.nonzero(found >= 0)
        dst = found[src, col]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        place = np.arange(len(dst)) - np.searchsorted(dst, np.arange(n + 1))[dst]
        keep = place < LISTED
        back = np.full((n, LISTED), -1, np.int32)
        back[dst[keep], place[keep]] = src[keep]
        return back

    def nearest(self, q: np.ndarray, k: int) -> np.ndarray:
        """The ids of the k best found for other vectors."""
        out = []
        for a in range(0, len(q), BLOCK):
            part = q[a : a + BLOCK]
            ids, sims = self.search(part, self._entries(part, len(self.x)), BUILD_STEPS + QUERY_STEPS, len(self.x))
            out.append(_best(ids, sims, k)[0])
        return np.concatenate(out) if out else np.empty((0, k), np.int32)


def _pad(a: np.ndarray, value: float) -> np.ndarray:
    return a if a.shape[1] >= BEAM else np.pad(a, ((0, 0), (0, BEAM - a.shape[1])), constant_values=value)


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best per row, padded with -1 and -inf."""
    if ids.shape[1] > k:
        keep = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        row = np.arange(len(ids))[:, None]
        ids, sims = ids[row, keep], sims[row, keep]
    elif ids.shape[1] < k:
        ids = np.pad(ids, ((0, 0), (0, k - ids.shape[1])), constant_values=-1)
        sims = np.pad(sims, ((0, 0), (0, k - sims.shape[1])), constant_values=-np.inf)
    return np.where(sims > -np.inf, ids, -1), sims


def usable(v: Column, dim: int) -> Column:
    """Vectors of the right length without null, NaN or infinite numbers that aren't all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that neither large nor tiny numbers overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _direction(x: np.ndarray) -> np.ndarray:
    """Unit vectors in whole steps: equal for vectors of one direction, whatever their length."""
    return np.rint(_unit(x) * STEPS).astype(np.int64)


def _hashes(q: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes per row of whole numbers."""
    odd = np.random.default_rng(11).integers(0, 1 << 63, (q.shape[1], 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.stack([(q.view(np.uint64) * odd[:, i]).sum(1, dtype=np.uint64) for i in range(2)], 1)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _stirred(h: np.ndarray) -> np.ndarray:
    """Hashes spread evenly over the 64-bit numbers (the finalizer of a public mixer)."""
    x = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _tied(q: np.ndarray, base: np.ndarray, by_id: np.ndarray, level: np.ndarray, k: int) -> np.ndarray:
    """For every row of q the first k + 1 nodes in the order ``by_id`` whose rounded cosine is at least its level; -1 where there are fewer."""
    out = np.full((len(q), k + 1), -1, np.int64)
    have = np.zeros(len(q), np.int64)
    todo, a, step = np.arange(len(q)), 0, SCAN
    while len(todo) and a < len(by_id):
        part = by_id[a : a + step]
        rows = max(1, SCANNED // len(part))
        for i in range(0, len(todo), rows):
            t = todo[i : i + rows]
            r, c = np.nonzero(np.round(q[t] @ base[part].T, 6) >= level[t, None])
            nth = np.arange(len(r)) - np.searchsorted(r, np.arange(len(t)))[r] + have[t][r]
            fits = nth <= k
            out[t[r[fits]], nth[fits]] = part[c[fits]]
            have[t] += np.bincount(r, minlength=len(t))
        todo = todo[have[todo] <= k]
        a, step = a + step, step * 4
    return out


def _lists(ids: np.ndarray, more: list, vec: np.ndarray, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every row of a part: the ids and rounded cosines of its k + 1 nearest in it, itself and its copies among them."""
    steps = np.ascontiguousarray(_direction(vec))
    kinds, inverse = np.unique(steps.view(np.dtype((np.void, steps.dtype.itemsize * steps.shape[1]))).ravel(), return_inverse=True)
    # The row with the smallest id stands for its direction, in every shard the same.
    first = np.zeros(len(kinds), np.int64)
    last_first = np.argsort(ids)[::-1]
    first[inverse[last_first]] = last_first
    is_node = np.zeros(len(kinds), bool)
    is_node[inverse[node]] = True
    place = np.cumsum(is_node) - 1  # of a kind among the nodes
    unit = _unit(vec[first])
    base = unit[is_node]
    n = len(base)
    # The smallest ids of each node, k + 1 at most.
    owner = place[inverse[node]]
    mid = ids[node]
    extra = [(o, m) for o, ms in zip(owner, (more[i] for i in np.flatnonzero(node)), strict=True) if ms is not None for m in ms]
    if extra:
        owner = np.concatenate([owner, np.array([o for o, _ in extra])])
        mid = np.concatenate([mid, np.array([m for _, m in extra])])
    pairs = np.unique(np.stack([owner, mid], 1), axis=0)
    owner, mid = pairs[:, 0], pairs[:, 1]
    nth = np.arange(len(owner)) - np.searchsorted(owner, np.arange(n + 1))[owner]
    width = int(min(k, nth.max(initial=0))) + 1
    members = np.full((n, width), -1, np.int64)
    members[owner[nth < width], nth[nth < width]] = mid[nth < width]
    by_id = np.argsort(members[:, 0], kind="stable")
    near = np.full((len(kinds), k + SPARE), -1, np.int64)
    if n:
        g = ShardGraph(base.astype(np.float32))
        near[is_node] = g.neighbours(k + SPARE)
        if not is_node.all():
            near[~is_node] = g.nearest(unit[~is_node].astype(np.float32), k + SPARE)
    out_ids = np.full((len(kinds), k + 1), -1, np.int64)
    out_sims = np.full((len(kinds), k + 1), -np.inf)

    def rank(b: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Fill the lists of the kinds b from candidate nodes (a node counts once); the unrounded cosines."""
        exact = np.einsum("bcd,bd->bc", base[np.maximum(cand, 0)], unit[b]) if n else np.zeros(cand.shape)
        own = members[np.maximum(cand, 0)] if n else np.full((*cand.shape, width), -1)
        own = np.where((cand >= 0)[:, :, None], own, -1).reshape(len(b), -1)
        sims = np.where(own >= 0, np.repeat(np.round(exact, 6), width, axis=1), -np.inf)
        row = np.arange(len(b))[:, None]
        order = np.argsort(own, axis=1, kind="stable")
        order = order[row, np.argsort(-sims[row, order], axis=1, kind="stable")][:, : k + 1]
        w = order.shape[1]
        out_ids[b, :w], out_sims[b, :w] = own[row, order], sims[row, order]
        return exact

    for a in range(0, len(kinds), 1024):
        b = np.arange(a, min(a + 1024, len(kinds)))
        cand = np.concatenate([near[b], np.where(is_node[b], place[b], -1)[:, None]], 1)
        exact = rank(b, cand)
        # More nodes than those kept may tie with the last place.
        least = np.where((near[b] >= 0).all(1), exact[:, :-1].min(1), -np.inf)
        wide = np.flatnonzero((least > -np.inf) & (least >= out_sims[b, k] - NEAR))
        if len(wide):
            more_nodes = _tied(unit[b[wide]], base, by_id, out_sims[b[wide], k], k)
            both = np.sort(np.concatenate([cand[wide], more_nodes], 1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            for i in range(0, len(wide), 1024):
                rank(b[wide[i : i + 1024]], both[i : i + 1024])
    return out_ids[inverse], out_sims[inverse], out_ids[inverse] >= 0


def similar_vectors(df: DataFrame, id_col: str, vector: str, dim: int, k: int = 10) -> DataFrame:
    """``id, rank, neighbour, cosine``: the k rows most similar to each row with a usable vector, most similar first.

    Cosines are rounded to 6 decimals; equal ones rank by the smaller id. Null, short, all-zero vectors and ones with null, NaN
    or infinite numbers take no part. Ids must be different integers. A table of fewer than k + 1 usable rows gives
    shorter lists, an empty one no rows. The search is approximate (recall is measured in the tests); copies of a vector,
    scaled ones too, and ties with the last place are exact.
    """
    need(df, id_col, vector)
    rows = df.where(usable(F.col(vector), dim)).select(F.col(id_col).cast("bigint").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("vec"))

    # The centres are fitted on different vectors: those whose direction has a small hash, one row of a direction in a task.
    n_rows = df.count()
    want = min(MAX_CENTRES, max(1, round(min(n_rows / PER_CENTRE, n_rows**0.5 / ROOT)), math.ceil(3 * n_rows / MAX_SHARD)))
    size = max(SAMPLE, SAMPLE_PER * want)
    drawn_below = min(1.0, size / max(n_rows, 1)) * 2.0**64

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            x = _matrix(b.column(1), dim)
            h = _hashes(_direction(x))
            drawn = np.flatnonzero(_stirred(h[:, 0]) < drawn_below)
            take = np.zeros(len(h), bool)
            for i in drawn.tolist():
                if (key := int(h[i, 0])) not in seen:
                    seen.add(key)
                    take[i] = True
            vec = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take * dim)]).astype(np.int32)), pa.array(_unit(x[take]).astype(np.float32).ravel(), pa.float32()), mask=pa.array(~take))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h[:, 0]), pa.array(h[:, 1]), vec], names=["id", "h1", "h2", "vec"])

    written = checkpointed(rows.mapInArrow(hashed, "id bigint, h1 bigint, h2 bigint, vec array<float>"))
    keys = written.select("id", "h1", "h2")
    n = keys.count()
    # At most HOT_SHARE classes can hold more than this many rows each.
    most = max(HOT, n // HOT_SHARE)
    classes = checkpointed(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("rep")))
    hot = checkpointed(classes.where(F.col("c") > most).select("h1", "h2", "rep"))
    hot_rows = keys.join(F.broadcast(hot), ["h1", "h2"]).select("id", "rep", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    least = hot_rows.withColumn("r", F.row_number().over(W.partitionBy("rep", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    least = least.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).groupBy("rep").agg(F.collect_list("id").alias("more"))
    # At most HOT_SHARE rows: every class of copies that only one row is routed of, by its first hash, with its smallest ids.
    known = hot.join(least, "rep").select("h1", "h2", "rep", "more").orderBy("h1").collect()
    hot_h1, hot_h2, hot_rep = (np.array([r[i] for r in known], np.int64) for i in range(3))
    hot_more = [r["more"] for r in known]
    schema = "id bigint, near array<struct<sim: double, neighbour: bigint>>"
    if not n:
        return df.sparkSession.createDataFrame([], "id bigint, rank int, neighbour bigint, cosine double")
    # About the sample's size, whatever the number of rows.
    drawn = written.where("vec IS NOT NULL").select("h1", "vec").toArrow()
    h1, at = np.unique(drawn.column(0).to_numpy(), return_index=True)
    at = at[np.argsort(_stirred(h1))]
    sample = _matrix(drawn.column(1), dim)[at] if len(at) else np.empty((0, dim), np.float32)
    n_sent = n - classes.where(F.col("c") > most).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0))).first()[0]
    centres = Centres(sample, int(min(want, len(sample)))) if len(sample) else Centres(np.eye(1, dim, dtype=np.float32), 1)
    copies = min(2, len(centres))
    # The rows that a centre gets say in how many parts its shard is split; the split changes cost, not results.
    near = centres.nearest(sample, copies) if len(sample) else np.zeros((1, 1), np.int64)
    parts = np.maximum(1, np.ceil(np.bincount(near.ravel(), minlength=len(centres)) / max(1, len(sample)) * n_sent / MAX_SHARD)).astype(np.int64)
    routes = df.sparkSession.sparkContext.broadcast((centres, parts, hot_h1, hot_h2, hot_rep, hot_more))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, parts, hot_h1, hot_h2, hot_rep, hot_more = routes.value
        for b in batches:
            q = _direction(_matrix(b.column(1), dim))
            ids = b.column(0).to_numpy()
            lists = [None] * len(ids)
            if len(hot_h1):
                h = _hashes(q)
                at = np.minimum(np.searchsorted(hot_h1, h[:, 0]), len(hot_h1) - 1)
                is_hot = (hot_h1[at] == h[:, 0]) & (hot_h2[at] == h[:, 1])
                stay = np.flatnonzero(~is_hot | (hot_rep[at] == ids))
                lists = [hot_more[at[i]] if is_hot[i] else None for i in stay]
                b, q, ids = b.take(pa.array(stay)), q[stay], ids[stay]
            more = pa.array(lists, pa.list_(pa.int64()))
            x = (q / STEPS).astype(np.float32)
            to = centres.nearest(x, copies)
            once = np.ones(to.shape, bool)
            once[:, 1:] = to[:, 1:] != to[:, :1]
            src, to = np.nonzero(once)[0], to[once].astype(np.int32)
            times = parts[to]
            at = np.repeat(np.arange(len(to)), times)
            part = (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
            home = (ids[src[at]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % times[at]
            take = pa.array(src[at])
            yield pa.RecordBatch.from_arrays([pa.array(to[at]), pa.array(part), pa.array(home == part), *(c.take(take) for c in (b.column(0), b.column(1), more))], names=["shard", "part", "node", "id", "vec", "more"])

    def search(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        got, sims, ok = _lists(ids, t.column("more").to_pylist(), _matrix(t.column("vec"), dim), t.column("node").to_numpy(), k)
        size = ok.sum(1)
        items = pa.StructArray.from_arrays([pa.array(sims[ok]), pa.array(got[ok])], names=["sim", "neighbour"])
        return pa.table({"id": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), items)})

    routed = rows.mapInArrow(route, "shard int, part int, node boolean, id bigint, vec array<double>, more array<bigint>").repartition(int(parts.sum()), "shard", "part")
    found = routed.groupBy("shard", "part").applyInArrow(search, schema)
    merged = found.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
    best = F.slice(F.array_sort(F.array_distinct(F.transform("near", lambda x: F.struct((-x["sim"]).alias("neg"), x["neighbour"].alias("neighbour"))))), 1, k + 1)
    merged = merged.select("id", best.alias("near"))
    if not hot.isEmpty():
        merged = checkpointed(merged)
        of_rep = merged.join(F.broadcast(hot.select(F.col("rep").alias("id"))), "id").select(F.col("id").alias("rep"), "near")
        merged = merged.join(F.broadcast(hot.select(F.col("rep").alias("id"))), "id", "left_anti").unionByName(hot_rows.join(F.broadcast(of_rep), "rep").select("id", "near"))
    others = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return merged.select("id", F.posexplode(others).alias("pos", "x")).select("id", (F.col("pos") + 1).alias("rank"), F.col("x.neighbour").alias("neighbour"), (-F.col("x.neg")).alias("cosine"))
