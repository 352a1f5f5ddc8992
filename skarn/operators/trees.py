"""Dependency trees as head arrays: ``heads[i]`` is the parent of token i, a root points to itself.

All operators stay inside a row; one Arrow function handles the trees of a whole batch, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Parts of speech that a subphrase may hold besides its own words.
LIGHT = {"ADP", "AUX", "CCONJ", "DET", "PART", "PRON", "PUNCT", "SCONJ"}


def children(heads: list[int]) -> list[list[int]]:
    """Children of every token, in order."""
    out: list[list[int]] = [[] for _ in heads]
    for i, h in enumerate(heads):
        if h != i:
            out[h].append(i)
    return out


def depths(heads: list[int]) -> list[int]:
    """Distance to the root; -1 for tokens on a cycle."""
    out = [-2] * len(heads)
    for i in range(len(heads)):
        path = []
        j = i
        while out[j] == -2:
            out[j] = -1
            path.append(j)
            if heads[j] == j:
                out[j] = 0
                path.pop()
                break
            j = heads[j]
        base = out[j]
        for p in reversed(path):
            base = base + 1 if base >= 0 else -1
            out[p] = base
    return out


def bfs(heads: list[int]) -> list[int]:
    """Tokens level by level, in order within a level."""
    kids = children(heads)
    level = [i for i, h in enumerate(heads) if h == i]
    out = []
    while level:
        out += level
        level = [c for p in level for c in kids[p]]
    return out


def path_up(heads: list[int], i: int) -> list[int]:
    """A token and its ancestors up to the root."""
    out = [i]
    while heads[i] != i and len(out) <= len(heads):
        i = heads[i]
        out.append(i)
    return out


def lca(heads: list[int], a: int, b: int) -> int | None:
    """The lowest common ancestor; null if the tokens are in different trees."""
    up = set(path_up(heads, a))
    return next((x for x in path_up(heads, b) if x in up), None)


def minimal_subtree(heads: list[int], nodes: list[int]) -> set[int]:
    """The tokens on the paths from all nodes to their lowest common ancestor."""
    top = nodes[0]
    for n in nodes[1:]:
        top = lca(heads, top, n)
        if top is None:
            return set()
    out = set()
    for n in nodes:
        for x in path_up(heads, n):
            out.add(x)
            if x == top:
                break
    return out


def is_subphrase(heads: list[int], pos: list[str], nodes: list[int]) -> bool:
    """Whether the smallest subtree of the nodes has no other content word."""
    tree = minimal_subtree(heads, nodes)
    return bool(tree) and all(i in nodes or pos[i] in LIGHT for i in tree)


def subphrases(heads: list[int], pos: list[str], slots: list[list[int]]) -> list[tuple[int, ...]]:
    """All choices of one candidate per slot whose smallest subtree has no other content word.

    Decided slot by slot, rarest first. A choice is given up once its subtree holds content words that the open slots
    can't take: every later choice would hold them too.
    """
    order = sorted(range(len(slots)), key=lambda k: (len(slots[k]), k))
    later = [set().union(*(slots[j] for j in order[k:])) for k in range(len(order) + 1)]
    out = []

    def choose(k: int, chosen: list[int]) -> None:
        if chosen:
            tree = minimal_subtree(heads, chosen)
            other = {i for i in tree if i not in chosen and pos[i] not in LIGHT}
            if not tree or len(other) > len(order) - k or not other <= later[k]:
                return
        if k == len(order):
            out.append(tuple(c for _, c in sorted(zip(order, chosen, strict=True))))
            return
        for c in slots[order[k]]:
            choose(k + 1, [*chosen, c])

    if slots:
        choose(0, [])
    return sorted(out)


def match_pattern(heads: list[int], fits: list[list[int]], relations: list[tuple[int, str]]) -> list[tuple[int, ...]]:
    """All ways to match a dependency pattern.

    ``fits[k]`` lists the tokens that node k of the pattern may be; node 0 is its root, and node k > 0 stands to an earlier
    node ``relations[k - 1] = (node, operator)``: ``>`` child, ``>>`` anywhere below, ``<`` parent, ``<<`` anywhere above it.
    """
    paths: dict[int, list[int]] = {}

    def up(i: int) -> list[int]:
        if i not in paths:
            paths[i] = path_up(heads, i)
        return paths[i]

    def related(a: int, b: int, op: str) -> bool:
        if a == b:
            return False
        low, high = (b, a) if op[0] == ">" else (a, b)
        return heads[low] == high if len(op) == 1 else high in up(low)

    found: list[tuple[int, ...]] = [(i,) for i in fits[0]] if fits else []
    for k, (node, op) in enumerate(relations, 1):
        found = [(*f, i) for f in found for i in fits[k] if related(f[node], i, op)]
    return found


def action_pattern(action: list[str], target: list[str]) -> tuple[list[str], list[tuple[int, str]]]:
    """Words and relations of an action and its target: the first word of the action is the root, all others are anywhere below it."""
    words = [*action, *target]
    return words, [(0, ">>")] * (len(words) - 1)


def triples(heads: list[int], deps: list[str], pos: list[str]) -> list[tuple[int, list[int], int]]:
    """Subject, verbs on the path between, object: for every subject and object of a sentence."""
    subs = [i for i, d in enumerate(deps) if "subj" in d]
    objs = [i for i, d in enumerate(deps) if "obj" in d]
    out = []
    for s in subs:
        for o in objs:
            top = lca(heads, s, o)
            if top is None or s == o:
                continue
            verbs = sorted(i for i in minimal_subtree(heads, [s, o]) | {top} if pos[i] == "VERB")
            if verbs:
                out.append((s, verbs, o))
    return out


def descends(heads: list[int], i: int, j: int) -> bool:
    """Whether token i is below token j."""
    return i != j and j in path_up(heads, i)


def map_trees(df: DataFrame, columns: list[str], fn: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Apply ``fn(*columns)`` to every row; it returns output rows."""
    names = [c.strip().split(" ")[0].strip("`") for c in _split_schema(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for vals in zip(*(pdf[c] for c in columns), strict=True) for r in fn(*(list(v) if hasattr(v, "tolist") and not isinstance(v, str) and getattr(v, "ndim", 0) else v for v in vals))]
            yield pd.DataFrame(rows, columns=names)

    return df.select(*columns).mapInPandas(run, schema)


def _split_schema(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]
