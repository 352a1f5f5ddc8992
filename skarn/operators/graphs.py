"""Behaviour graphs: components, paths, contraction, templates and their alignment."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.strings import Vocabulary, indel_ratio
from skarn.runtime import busy_tasks, checkpointed

#: Rounds in which ``components`` must settle (it takes about the logarithm of the longest path); else it raises an error.
ROUNDS = 200


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, component``: the smallest node of each weakly connected component.

    Alternates large and small stars until nothing changes; every round is two grouped minimums and is cut from its
    lineage in the shared checkpoint folder. A hub's neighbours are rewired to the minimum, never collected.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = e.select("u").union(e.select("v")).distinct()
    e = checkpointed(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(ROUNDS):
        # large star: each larger neighbour of a node points to the node's smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lows.select("u", F.col("m").alias("v"))).distinct()
        new = checkpointed(small)
        changed = new.exceptAll(e).limit(1).count() + e.exceptAll(new).limit(1).count()
        e = new
        if not changed:
            break
    else:
        raise RuntimeError(f"the components didn't settle in {ROUNDS} rounds")
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("m")), "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))


#: Hops that a round of ``distances`` goes before its result is written.
HOPS = 16


def distances(edges: DataFrame, src: str, dst: str, start: DataFrame) -> DataFrame:
    """``node, hops`` from the nodes of ``start`` over undirected edges; unreachable nodes have no row.

    A round walks HOPS edges from the last front, keeps the shortest walk to each node not seen before and writes them; it ends
    when a front is empty, so paths may be of any length.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = checkpointed(e.union(e.select(F.col("v"), F.col("u"))).distinct())
    front = checkpointed(start.select(F.col(start.columns[0]).alias("node"), F.lit(0).alias("hops")).distinct())
    seen = front
    for done in count(0, HOPS):  # ends: a front holds only nodes not seen before
        walks = step = front.select("node")
        walks = walks.limit(0).withColumn("hops", F.lit(0))
        for h in range(1, HOPS + 1):
            step = step.join(e, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct()
            walks = walks.unionByName(step.withColumn("hops", F.lit(done + h)))
        new = checkpointed(walks.groupBy("node").agg(F.min("hops").alias("hops")).join(seen, "node", "left_anti"))
        front = new.where(F.col("hops") == done + HOPS)
        seen = checkpointed(seen.unionByName(new)) if done else seen.unionByName(new)
        if front.isEmpty():
            return seen
    raise AssertionError


@lru_cache(maxsize=200_000)
def _ratio(a: str, b: str) -> float:
    return 1.0 if a == b else indel_ratio(a, b)


def set_similarity(a: list[str], b: list[str]) -> float:
    """The best ratio between two sets of strings; 0 if one is empty."""
    return max((_ratio(x, y) for x, y in product(a, b)), default=0.0)


def node_similarity(a: dict, b: dict) -> float:
    """0.4 for equal types plus the better of the similarity of indicators and of words."""
    return 0.4 * (a["type"] == b["type"]) + max(set_similarity(a["ioc"], b["ioc"]), set_similarity(a["nlp"], b["nlp"]))


def contract(nodes: list[dict], at_least: float = 0.3) -> list[list[int]]:
    """Groups of nodes that are one: similar enough for their distance, and sharing an indicator."""
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by_ioc: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        for x in set(n["ioc"]):
            by_ioc.setdefault(x, []).append(i)
    for same in by_ioc.values():
        for i, j in ((same[a], same[b]) for a in range(len(same)) for b in range(a + 1, len(same))):
            if find(i) != find(j) and node_similarity(nodes[i], nodes[j]) / math.log(abs(i - j) + 2) >= at_least:
                root[find(j)] = find(i)
    groups: dict[int, list[int]] = {}
    for i in range(len(nodes)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


#: Bytes of similarities that are kept at once.
KEPT = 48_000_000


def learn(graphs: list[tuple[list[dict], list[tuple[int, int]], int]], match: float = 0.7) -> tuple[list[dict], dict[tuple[int, int], int], int]:
    """One template of several graphs (or templates): nodes are matched above ``match``, else added; counts add up.

    A graph is ``(nodes, edges, instances)``; a node without ``count`` counts once.
    """
    nodes: list[dict] = []
    edges: dict[tuple[int, int], int] = {}
    total = 0
    vocs = {f: Vocabulary(w for g in graphs for x in g[0] for w in x[f]) for f in ("nlp", "ioc")}
    have: list[dict[str, dict[str, None]]] = []  # the strings of every node, and their places in the vocabulary
    places: list[dict[str, list[int]]] = []
    known: dict[tuple[str, str], tuple[np.ndarray, list[float], list[int]]] = {}  # of a string: its ratios to all, to every node so far, and how many of the node's strings that covers
    most = max(1, KEPT // max(8, *(8 * len(v.place) for v in vocs.values())))

    def add(k: int, x: dict) -> None:
        for f, voc in vocs.items():
            new = [w for w in dict.fromkeys(x[f]) if w not in have[k][f]]
            have[k][f].update(dict.fromkeys(new))
            places[k][f].extend(voc.place[w] for w in new)

    def best_of(x: dict) -> tuple[int | None, float]:
        """The first node of the highest ``node_similarity``, and that."""
        near = [0.0] * len(nodes)
        for f, voc in vocs.items():
            for w in dict.fromkeys(x[f]):
                if (f, w) not in known:
                    if len(known) >= most:
                        known.clear()
                    known[f, w] = (voc.ratios(w), [], [])
                ratios, high, seen = known[f, w]
                high += [0.0] * (len(nodes) - len(high))
                seen += [0] * (len(nodes) - len(seen))
                for k, own in enumerate(places):
                    if seen[k] < len(own[f]):
                        high[k] = max(high[k], float(ratios[own[f][seen[k] :]].max()))
                        seen[k] = len(own[f])
                near = list(map(max, near, high))
        sims = [0.4 * (n["type"] == x["type"]) + s for n, s in zip(nodes, near, strict=True)]
        best = max(range(len(nodes)), key=sims.__getitem__, default=None)
        return best, sims[best] if sims else 0.0

    for g_nodes, g_edges, n in graphs:
        place = {}
        for i, x in enumerate(g_nodes):
            best, sim = best_of(x)
            if best is not None and sim > match:
                nodes[best]["count"] += x.get("count", 1)
                nodes[best]["sorted"] = True
            else:
                best = len(nodes)
                nodes.append({"type": x["type"], "nlp": list(x["nlp"]), "ioc": list(x["ioc"]), "count": x.get("count", 1), "sorted": False})
                have.append({f: {} for f in vocs})
                places.append({f: [] for f in vocs})
            add(best, x)
            place[i] = best
        for e in g_edges:
            a, b, c = (*e, 1) if len(e) == 2 else e
            key = (place[a], place[b])
            edges[key] = edges.get(key, 0) + c
        total += n
    for k, x in enumerate(nodes):
        if x.pop("sorted"):
            x |= {f: sorted(have[k][f]) for f in vocs}
    return nodes, edges, total


TEMPLATE = "technique string, nodes array<struct<type:string,nlp:array<string>,ioc:array<string>,count:int>>, edges array<struct<src:int,dst:int,count:int>>, total_count int"


def learn_templates(graphs: DataFrame, parts: int = 16) -> DataFrame:
    """Templates per technique of ``technique, ord, nodes, edges``; see TEMPLATE.

    Graphs are folded in order within parts of a technique, the parts then in order into one: a technique with a third
    of all graphs is no single task, and what the second step gets is as small as templates are.
    """

    kind = pa.schema([("technique", pa.string()), ("ord", pa.int64()), ("nodes", pa.list_(pa.struct([("type", pa.string()), ("nlp", pa.list_(pa.string())), ("ioc", pa.list_(pa.string())), ("count", pa.int32())]))), ("edges", pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("count", pa.int32())]))), ("total_count", pa.int32())])

    def fold(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["ord"])
        nodes, edges, total = learn([(r["nodes"], [tuple(e.values()) for e in r["edges"]], r["total_count"]) for r in rows])
        return pa.Table.from_pylist([{"technique": rows[0]["technique"], "ord": rows[0]["ord"], "nodes": nodes, "edges": [{"src": a, "dst": b, "count": c} for (a, b), c in sorted(edges.items())], "total_count": total}], schema=kind)

    schema = TEMPLATE.replace("technique string,", "technique string, ord bigint,")
    tasks = busy_tasks(graphs.sparkSession)
    first = graphs.withColumn("part", F.pmod(F.xxhash64("ord"), F.lit(parts))).repartition(tasks, "technique", "part").groupBy("technique", "part").applyInArrow(fold, schema)
    return first.repartition(tasks, "technique").groupBy("technique").applyInArrow(fold, schema).drop("ord")


def prune(templates: DataFrame, at_most: int = 2) -> DataFrame:
    """Counts of at most ``at_most`` become 0; ``norm`` adds up what is left."""
    nodes = F.transform("nodes", lambda n: n.withField("count", F.when(n["count"] <= at_most, 0).otherwise(n["count"])))
    t = templates.withColumn("nodes", nodes)
    return t.withColumn("norm", F.aggregate("nodes", F.lit(0), lambda s, n: s + n["count"]))


#: About how many numbers the arrays of one step of the alignment hold.
CELLS = 400_000


def _best(u: np.ndarray, r: np.ndarray, c: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """The highest score of each problem: every node gets one candidate; all problems are searched side by side.

    ``u``: problem, node, candidate: what a candidate adds by itself, -inf if it is none. ``r``: the root of its similarity. ``c``: problem,
    node, node: the edges' weights. ``inv``: problem, candidate, candidate: 1 / distance, 0 if there is no path.

    Branch and bound, a node a level: a state keeps what each candidate of the open nodes adds to it. It ends where the best
    candidates of the open nodes and the best ends of the edges between those can't beat the best score so far.
    """
    size, depth, width = u.shape
    c_back, r_last, paths = np.ascontiguousarray(c.transpose(0, 2, 1)), np.ascontiguousarray(r.transpose(0, 2, 1)), inv.any(axis=0)
    # What the later nodes' candidates add to a node's: by theirs first, so that the best of them is a maximum over long rows.
    gain = [np.zeros((width, size, width, depth - d - 1)) for d in range(depth)]
    for x, y in zip(*(i.tolist() for i in np.nonzero(paths | paths.T)), strict=True):
        for d in range(depth - 1):
            w = sum(e[:, d, d + 1 :] * v[:, None] for e, v, there in ((c, inv[:, x, y], paths[x, y]), (c_back, inv[:, y, x], paths[y, x])) if there)
            w *= r[:, d, x, None]
            w *= r_last[:, y, d + 1 :]
            gain[d][y, :, x] = w
    rest = np.zeros((depth + 1, size))
    for d in range(depth - 1, -1, -1):
        rest[d] = rest[d + 1] + gain[d].max(axis=0).max(axis=1).sum(axis=1)

    def step(d: int, p: np.ndarray | slice, score: np.ndarray, adds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, what the open nodes add, and bounds of all children."""
        more = adds[:, :, None, 1:] + gain[d][:, p]
        after = score[:, None] + adds[:, :, 0].T
        return after, more, after + more.max(axis=0) @ np.ones(depth - d - 1) + rest[d + 1][p][:, None]

    every = np.arange(size)
    score, adds = np.zeros(size), np.ascontiguousarray(u.transpose(2, 0, 1))
    stack = [(0, every, score, adds)]
    for d in range(depth):  # the first score: always the child of the highest bound
        after, more, bound = step(d, slice(None), score, adds)
        pick = bound.argmax(axis=1)
        score, adds = after[every, pick], more[:, every, pick]
    best = score
    while stack:
        d, p, score, adds = stack.pop()
        most = max(1, CELLS // max(1, width * width * (depth - d)))
        if len(p) > most:  # the later part waits
            stack.append((d, p[most:], score[most:], adds[:, most:]))
            p, score, adds = p[:most], score[:most], adds[:, :most]
        after, more, bound = step(d, p, score, adds)
        s, x = np.nonzero(bound > best[p][:, None] * (1 + 1e-12))
        if not len(s):
            continue
        if d + 1 == depth:
            np.maximum.at(best, p[s], after[s, x])
        else:
            order = np.argsort(-bound[s, x], kind="stable") if len(s) > most else slice(None)
            s, x = s[order], x[order]
            stack.append((d + 1, p[s], after[s, x], more[:, s, x]))
    return best


def _inverse_distances(n: int, edges: Iterable[tuple[int, int]]) -> np.ndarray:
    """1 / length of the shortest directed path, 0 where there is none and on the diagonal."""
    out = np.zeros((n, n))
    kids: dict[int, list[int]] = {}
    for a, b in edges:
        kids.setdefault(a, []).append(b)
    for a in kids:
        level, d, seen = [a], 0, {a}
        while level:
            d += 1
            level = [x for y in level for x in kids.get(y, ()) if not (x in seen or seen.add(x))]
            out[a, level] = 1 / d
    return out


class Aligner:
    """Scores of graphs against a list of templates ``(nodes, edges, norm)``: aligned nodes and edges, weighted by their counts.

    Only template nodes that are similar to some node of the graph can add to the score; actors don't count. The score is that of the
    best of all combinations of their candidates.
    """

    def __init__(self, templates: list[tuple[list[dict], list[tuple[int, int, int]], int]], at_least: float = 0.7):
        self.at_least = at_least
        nodes = [x for t_nodes, _, _ in templates for x in t_nodes]
        self._types: dict[str, int] = {}
        self._type = np.array([self._types.setdefault(x["type"], len(self._types)) for x in nodes], dtype=np.int64)
        self._sets = {f: self._set_table([x[f] for x in nodes]) for f in ("nlp", "ioc")}
        self._known: dict[tuple, np.ndarray] = {}
        self.norm = np.array([norm for *_, norm in templates], dtype=np.float64)
        # Templates of equally many nodes: their places, their nodes' places (nodes of the heaviest edges first), counts and edges.
        start, by_size = 0, {}
        for k, (t_nodes, _, _) in enumerate(templates):
            by_size.setdefault(len(t_nodes), []).append((k, start))
            start += len(t_nodes)
        self._groups = []
        for size, own in sorted(by_size.items()):
            if not size:
                continue
            at, count, edge = np.zeros((len(own), size), dtype=np.int64), np.zeros((len(own), size)), np.zeros((len(own), size, size))
            for i, (k, first) in enumerate(own):
                for a, b, c in templates[k][1]:
                    edge[i, a, b] += c
                heavy = np.argsort(-(edge[i].sum(axis=0) + edge[i].sum(axis=1)), kind="stable")
                edge[i] = edge[i][np.ix_(heavy, heavy)]
                at[i], count[i] = first + heavy, [templates[k][0][a]["count"] for a in heavy]
            actor = np.array([[nodes[a]["type"] == "actor" for a in row] for row in at])
            self._groups.append((np.array([k for k, _ in own]), at, count, edge, np.maximum(edge, edge.transpose(0, 2, 1)) / 2, actor))

    @staticmethod
    def _set_table(sets: list[list[str]]) -> tuple[Vocabulary, np.ndarray, np.ndarray, np.ndarray]:
        """A vocabulary, the places of the strings of all sets that aren't empty, where each of those begins, and which they are."""
        voc = Vocabulary(w for s in sets for w in s)
        full = np.array([k for k, s in enumerate(sets) if len(s)], dtype=np.int64)
        flat = np.array([voc.place[w] for k in full for w in sets[k]], dtype=np.int64)
        return voc, flat, np.cumsum([0, *(len(sets[k]) for k in full[:-1])]), full

    def _near(self, n: dict) -> np.ndarray:
        """The higher of the similarity of indicators and of words to every template node."""
        key = (tuple(n["nlp"]), tuple(n["ioc"]))
        if key not in self._known:
            if len(self._known) * self._type.nbytes > KEPT:
                self._known.clear()
            out = np.zeros(len(self._type))
            for f, (voc, flat, begin, full) in self._sets.items():
                for w in dict.fromkeys(n[f]) if len(full) else ():
                    out[full] = np.maximum(out[full], np.maximum.reduceat(voc.ratios(w)[flat], begin))
            self._known[key] = out
        return self._known[key]

    def similarities(self, n: dict) -> np.ndarray:
        """``node_similarity`` to every template node."""
        return 0.4 * (self._type == self._types.get(n["type"], -1)) + self._near(n)

    def scores(self, graphs: list[tuple[list[dict], list[tuple[int, int]]]], keep: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of graphs and templates and their scores, of those with a score of at least ``keep``."""
        ways: dict[tuple, np.ndarray] = {}
        by_size: dict[int, list[int]] = {}
        for i, (nodes, _) in enumerate(graphs):
            by_size.setdefault(len(nodes), []).append(i)
        for size, own in sorted(by_size.items()):
            if not size or not len(self._type):
                continue
            some = max(1, 4 * CELLS // (size * len(self._type)))
            for k in range(0, len(own), some):
                part = own[k : k + some]
                sims = np.array([[self.similarities(x) for x in graphs[i][0]] for i in part])
                inv = []
                for i in part:
                    key = (size, tuple(graphs[i][1]))
                    if key not in ways:
                        if len(ways) > 1000:
                            ways.clear()
                        ways[key] = _inverse_distances(*key)
                    inv.append(ways[key])
                inv = np.array(inv)
                for place, at, count, edge, most, actor in self._groups:
                    s = sims[:, :, at].transpose(0, 2, 3, 1)  # graph, template, template node, graph node
                    fits = (s >= self.at_least) & ~actor[None, :, :, None]
                    s = np.where(fits, s, 0.0)
                    high = s.max(axis=3)
                    bound = (count * high).sum(axis=2)
                    if size > 1:
                        root = np.sqrt(high)
                        bound += ((root[:, :, None, :] @ most[None])[:, :, 0, :] * root).sum(axis=2)
                    g, t = np.nonzero(bound >= keep * (self.norm[place] + 1) * (1 - 1e-12))
                    if size == 1:
                        total = bound[g, t]
                    else:
                        total, step = np.zeros(len(g)), max(1, 2 * CELLS // (size * at.shape[1]) ** 2)
                        for j in range(0, len(g), step):
                            x, y = g[j : j + step], t[j : j + step]
                            v, ok = s[x, y], fits[x, y]
                            ok[:, :, 0] |= ~ok.any(axis=2)  # a node without candidates adds nothing
                            total[j : j + step] = _best(np.where(ok, count[y][:, :, None] * v, -np.inf), np.sqrt(v), edge[y], inv[x])
                    score = total / (self.norm[place][t] + 1)
                    ok = score >= keep
                    yield np.array(part)[g[ok]], place[t[ok]], score[ok]


def align(graph: tuple[list[dict], list[tuple[int, int]]], template: tuple[list[dict], list[tuple[int, int, int]], int], at_least: float = 0.7) -> float:
    """Score of a graph against a template; see ``Aligner``."""
    return max((float(x) for *_, s in Aligner([template], at_least).scores([graph], -math.inf) for x in s), default=0.0)


def align_all(graphs: DataFrame, templates: list[tuple[str, tuple]], id_col: str, keep: float = 0.9) -> DataFrame:
    """``id_col, technique, score`` of the templates that a graph reaches ``keep`` with; templates are a bounded list."""
    sent = graphs.sparkSession.sparkContext.broadcast(templates)
    kind = dict(graphs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, names = Aligner([t for _, t in sent.value]), pa.array([name for name, _ in sent.value], pa.string())
        for batch in batches:
            same: dict[tuple, list[int]] = {}  # rows of equal graphs
            for i, (nodes, edges) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                key = (tuple((n["type"], tuple(n["nlp"]), tuple(n["ioc"])) for n in nodes), tuple(tuple(e.values()) for e in edges))
                same.setdefault(key, []).append(i)
            gs = [([dict(zip(("type", "nlp", "ioc"), n, strict=True)) for n in nodes], list(edges)) for nodes, edges in same]
            rows, size = np.array([i for own in same.values() for i in own], dtype=np.int64), np.array([len(own) for own in same.values()], dtype=np.int64)
            begin = np.cumsum(size) - size
            for g, t, s in aligner.scores(gs, keep):
                n = size[g]
                at = rows[np.repeat(begin[g] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                score = np.repeat(np.array([round(x, 6) for x in s.tolist()], dtype=np.float64), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), names.take(pa.array(np.repeat(t, n))), pa.array(score)], [id_col, "technique", "score"])

    # Equal graphs go to one task, those of single nodes, which are quickly aligned and may be very many, to any.
    to = F.when(F.size("edges") > 0, F.xxhash64("nodes", "edges")).otherwise(F.xxhash64(id_col))
    return graphs.select(id_col, "nodes", "edges").repartition(busy_tasks(graphs.sparkSession), to).mapInArrow(run, f"`{id_col}` {kind}, technique string, score double")
