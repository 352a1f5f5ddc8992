"""Frequency of every distinct term by burst-trie counting.

Each worker routes its terms through a trie whose leaves are small containers; a container that grows
beyond ``burst`` terms bursts into one child per next character, so prefixes are as long as the local
vocabulary needs. The leaves hold an occurrence and a record counter per term. The subtrees leave a worker
pre-aggregated (a hot term is one counter per worker, whatever its count) and packed: a prefix with its suffixes. A bounded
sample of their prefixes says by which prefixes they are routed, each shorter or longer so that no route holds much more
than its share. The receiving worker merges the subtrees of a route node by node: a subtree whose place is
still free is hung in whole, equal leaves are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.runtime import checkpointed, need

#: Terms a leaf container holds before it bursts.
BURST = 64
#: Terms a worker's trie holds before its subtrees are handed on and a new trie starts; bounds memory.
FLUSH = 200_000
#: Subtrees whose prefixes are looked at to choose the routes, and parts that the routes make of them, about.
SAMPLE, ROUTES = 20_000, 1024
#: Characters Python's str.strip() removes, as a Java character class.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


class BurstTrie:
    """A trie of containers; counters are ``[occurrences, records]``."""

    __slots__ = ("burst", "root", "size")

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.size = burst, {}, 0

    # A node is a dict from character to child; a container is a one-item list around a dict from suffix to counters.
    def add(self, term: str, occ: int, rec: int) -> None:
        node, at = self.root, 0
        while True:
            key = term[at : at + 1]
            child = node.get(key)
            if child is None:
                node[key] = [{term[at + 1 :]: [occ, rec]}]
                self.size += 1
                return
            at += 1
            if isinstance(child, list):
                box = child[0]
                suffix = term[at:]
                c = box.get(suffix)
                if c is not None:
                    c[0] += occ
                    c[1] += rec
                    return
                box[suffix] = [occ, rec]
                self.size += 1
                if key and len(box) > self.burst:
                    node[key] = self._split(box)
                return
            node = child

    @staticmethod
    def _split(box: dict) -> dict:
        node: dict = {}
        for suffix, c in box.items():
            node.setdefault(suffix[:1], [{}])[0][suffix[1:]] = c
        return node

    def graft(self, prefix: str, box: dict) -> None:
        """Merge a subtree: a container below ``prefix``. Its place may be free, a container, inside one, or a node."""
        node = self.root
        for at, key in enumerate(prefix):
            child, last = node.get(key), at == len(prefix) - 1
            if child is None and last:
                node[key] = self._split(box) if len(box) > self.burst else [box]
                self.size += len(box)
                return
            if isinstance(child, list):
                break
            node = node.setdefault(key, {})
        for suffix, (o, r) in box.items():
            self.add(prefix + suffix, o, r)

    def leaves(self) -> Iterator[tuple[str, dict]]:
        """Prefixes in depth-first order with their containers."""
        stack: list[tuple[str, dict | list]] = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if isinstance(node, list):
                yield prefix, node[0]
            else:
                stack.extend((prefix + k, v) for k, v in node.items())

    def items(self) -> Iterator[tuple[str, int, int]]:
        """Terms in depth-first order with their counters."""
        for prefix, box in self.leaves():
            for suffix, (o, r) in box.items():
                yield prefix + suffix, o, r


_LEAVES = "dataset string, route string, prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"
_COUNTS = "dataset string, term string, occurrences bigint, records bigint"


def _emit(tries: dict[str, BurstTrie]) -> Iterator[pa.RecordBatch]:
    for ds, trie in tries.items():
        rows = list(trie.leaves())
        for i in range(0, len(rows), 10_000):
            part = rows[i : i + 10_000]
            counters = [list(x[1].values()) for x in part]
            lists = [[list(x[1]) for x in part], [[c[0] for c in cs] for cs in counters], [[c[1] for c in cs] for cs in counters]]
            kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = [pa.array([ds] * len(part), pa.string()), pa.nulls(len(part), pa.string()), pa.array([x[0] for x in part], pa.string())]
            yield pa.RecordBatch.from_arrays([*names, *(pa.array(v, k) for v, k in zip(lists, kinds, strict=True))], names=[c.split()[0] for c in _LEAVES.split(", ")])


def routes(weights: dict[str, int], most: int) -> set[str]:
    """Prefixes that split weighted prefixes into parts of at most about ``most``; a string's route is the longest one that it starts with."""
    out = {""}
    stack = [("", list(weights.items()))]
    while stack:
        prefix, own = stack.pop()
        if sum(w for _, w in own) <= most:
            continue
        kids: dict[str, list[tuple[str, int]]] = {}
        for p, w in own:
            if len(p) > len(prefix):
                kids.setdefault(p[: len(prefix) + 1], []).append((p, w))
        out.update(kids)
        stack.extend(kids.items())
    return out


def _routed(known: dict[str, set[str]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give every leaf its route; a leaf that several routes share is dealt to them term by term."""
    inner = {ds: {r[:i] for r in rs for i in range(len(r))} for ds, rs in known.items()}

    def route(ds: str, s: str) -> str:
        rs = known.get(ds, {""})
        return next(s[:i] for i in range(min(len(s), max(map(len, rs))), -1, -1) if s[:i] in rs)

    for b in batches:
        rows = []
        for x in b.to_pylist():
            ds, p = x["dataset"], x["prefix"]
            if p not in inner.get(ds, ()):
                rows.append(x | {"route": route(ds, p)})
                continue
            parts: dict[str, list[tuple]] = {}
            for item in zip(x["suffixes"], x["occurrences"], x["records"], strict=True):
                parts.setdefault(route(ds, p + item[0]), []).append(item)
            for r, items in parts.items():
                s, o, n = (list(c) for c in zip(*items, strict=True))
                rows.append({"dataset": ds, "route": r, "prefix": p, "suffixes": s, "occurrences": o, "records": n})
        yield pa.RecordBatch.from_pylist(rows, b.schema)


def _merged(t: pa.Table) -> pa.Table:
    """The terms of one route, its subtrees merged."""
    trie = BurstTrie()
    for p, s, o, r in zip(*(t.column(c).to_pylist() for c in ("prefix", "suffixes", "occurrences", "records")), strict=True):
        trie.graft(p, {k: [x, y] for k, x, y in zip(s, o, r, strict=True)})
    terms, occ, rec = zip(*trie.items(), strict=True)
    return pa.table({"dataset": pa.array([t.column("dataset")[0].as_py()] * len(terms)), "term": pa.array(terms), "occurrences": pa.array(occ, pa.int64()), "records": pa.array(rec, pa.int64())})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[str, BurstTrie] = {}
    for b in batches:
        names = pc.dictionary_encode(b.column(0))
        lists = b.column(1)
        parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        terms = pc.dictionary_encode(lists.flatten())
        codes = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ds_of_row = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        nt = max(1, len(terms.dictionary))
        key = ds_of_row[parent] * nt + codes if len(codes) else codes
        keys, occ = np.unique(key, return_counts=True)
        once = np.unique(parent.astype(np.int64) * nt + codes) if len(codes) else codes
        rkeys, rec = np.unique(ds_of_row[once // nt] * nt + once % nt, return_counts=True) if len(codes) else (keys, occ)
        assert len(rkeys) == len(keys)
        dname, dterm = names.dictionary.to_pylist(), terms.dictionary.to_pylist()
        for k, o, r in zip(keys.tolist(), occ.tolist(), rec.tolist(), strict=True):
            tries.setdefault(dname[k // nt], BurstTrie()).add(dterm[k % nt], o, r)
        if sum(t.size for t in tries.values()) > FLUSH:
            yield from _emit(tries)
            tries = {}
    yield from _emit(tries)


def clean_items(items: Column) -> Column:
    """Items without surrounding whitespace, upper-cased; null and blank ones dropped; a null array gives an empty one."""
    trimmed = F.transform(items, lambda x: F.upper(F.regexp_replace(x, f"^{SPACE}|{SPACE}$", "")))
    return F.coalesce(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def term_frequencies(df: DataFrame, dataset: str, terms: str) -> DataFrame:
    """Occurrences and records of every distinct term of every dataset.

    ``dataset`` is a string column, ``terms`` an array of strings; both may be null (a null dataset counts as
    ``''``, null terms as no terms, null items are skipped). Other columns are ignored. An empty table gives no rows.
    Returns ``dataset, term, occurrences, records``: ``records`` counts rows that hold the term at least once.
    """
    need(df, dataset, terms)
    rows = df.select(
        F.coalesce(F.col(dataset), F.lit("")).alias("dataset"),
        F.coalesce(F.filter(F.col(terms), lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("terms"),
    )
    # The local subtrees are written once: choosing the routes and routing by them both read the small table.
    local = checkpointed(rows.mapInArrow(_count, _LEAVES))
    some = local.select("dataset", "prefix", F.size("suffixes").alias("n")).orderBy(F.xxhash64("dataset", "prefix")).limit(SAMPLE).collect()
    weights: dict[str, dict[str, int]] = {}
    for r in some:
        own = weights.setdefault(r["dataset"], {})
        own[r["prefix"]] = own.get(r["prefix"], 0) + r["n"]
    most = max(BURST, sum(r["n"] for r in some) // ROUTES)
    known = df.sparkSession.sparkContext.broadcast({ds: routes(w, most) for ds, w in weights.items()})
    routed = local.mapInArrow(lambda batches: _routed(known.value, batches), _LEAVES)
    return routed.groupBy("dataset", "route").applyInArrow(_merged, _COUNTS)


def mark_frequencies(freq: DataFrame, totals: DataFrame, rare_below: int = 5, common_above: float = 0.10) -> DataFrame:
    """Add ``mark``: ``rare`` below ``rare_below`` records, ``common`` above the share of all rows, else null.

    ``totals`` has ``dataset, n_rows``: one row per dataset (of a fixed, small number of datasets).
    A term that is both (in a tiny dataset) is ``rare``.
    """
    return freq.join(F.broadcast(totals), "dataset").select(
        "dataset", "term", "occurrences", "records",
        F.when(F.col("records") < rare_below, F.lit("rare")).when(F.col("records") / F.col("n_rows") > common_above, F.lit("common")).alias("mark"),
    )
