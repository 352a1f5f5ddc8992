"""String operators that need offsets or automata: Arrow functions over whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.runtime import checkpointed, need


def regex_spans(df: DataFrame, id_col: str, text: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """``id_col, spans``: every match of every pattern with its character offsets; null texts have no row."""
    need(df, id_col, text)
    kind = dict(df.dtypes)[id_col]
    compiled = [(k, re.compile(p.replace(r"\z", r"\Z"), re.ASCII)) for k, p in patterns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, [{"start": m.start(), "end": m.end(), "label": k} for k, p in compiled for m in p.finditer(t)]) for i, t in zip(pdf[id_col], pdf[text], strict=True)]
            yield pd.DataFrame(rows, columns=[id_col, "spans"])

    return df.where(F.col(text).isNotNull()).select(id_col, text).mapInPandas(run, f"`{id_col}` {kind}, spans array<struct<start:int,end:int,label:string>>")


def protect(df: DataFrame, id_col: str, text: str, patterns: Sequence[tuple[str, str]], stand_ins: dict[str, str]) -> DataFrame:
    """``id_col, protected, originals``: non-overlapping matches (earliest first) replaced by `` word ``; a map from new offset to original."""
    need(df, id_col, text)
    kind = dict(df.dtypes)[id_col]
    compiled = [(k, re.compile(p.replace(r"\z", r"\Z"), re.ASCII)) for k, p in patterns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf[id_col], pdf[text], strict=True):
                hits = sorted(((m.start(), m.end(), k) for k, p in compiled for m in p.finditer(t)), key=lambda h: h[0])  # of equal starts the earlier kind
                out, back, at, size = [], {}, 0, 0
                for a, b, k in hits:
                    if a < at:
                        continue
                    word = f" {stand_ins[k]} "
                    out += [t[at:a], word]
                    back[size + a - at] = t[a:b]
                    size += a - at + len(word)
                    at = b
                rows.append((i, "".join(out) + t[at:], back))
            yield pd.DataFrame(rows, columns=[id_col, "protected", "originals"])

    return df.where(F.col(text).isNotNull()).select(id_col, text).mapInPandas(run, f"`{id_col}` {kind}, protected string, originals map<int,string>")


#: Names that one automaton holds, about; more names are matched in several passes over the texts.
NAMES = 200_000


def substrings_in(df: DataFrame, id_col: str, text: str, names: DataFrame, name_id: str, name: str) -> DataFrame:
    """``id_col, ids``: sorted ids of all names that occur as substrings. Texts without one have no row; null and empty names occur nowhere.

    The names are sent to the workers in slices of bounded size, one automaton each; more than a slice takes several passes.
    """
    names = checkpointed(names.select(F.col(name_id).alias("i"), F.col(name).alias("n")).where("n <> ''").distinct())
    slices = max(1, -(-names.count() // NAMES))
    parts = [_pass(df, id_col, text, names.where(F.pmod(F.xxhash64("n"), F.lit(slices)) == k)) for k in range(slices)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if slices == 1 else out.groupBy(id_col).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


def _pass(df: DataFrame, id_col: str, text: str, names: DataFrame) -> DataFrame:
    import ahocorasick

    by_name: dict[str, set[str]] = {}
    for i, n in names.toLocalIterator():
        by_name.setdefault(n, set()).add(i)
    sent = df.sparkSession.sparkContext.broadcast({n: sorted(s) for n, s in by_name.items()})
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = ahocorasick.Automaton()
        for n, s in sent.value.items():
            auto.add_word(n, s)
        if len(auto):
            auto.make_automaton()
        for pdf in batches:
            rows = []
            for i, t in zip(pdf[id_col], pdf[text], strict=True):
                ids = {x for _, s in auto.iter(t) for x in s} if len(auto) and t else set()
                if ids:
                    rows.append((i, sorted(ids)))
            yield pd.DataFrame(rows, columns=[id_col, "ids"])

    return df.select(id_col, text).mapInPandas(run, f"`{id_col}` {kind}, ids array<string>")


def indel_ratio(a: str, b: str) -> float:
    """``2 * LCS / (len(a) + len(b))``; 1 for two empty strings. The longest common subsequence by bit-parallel rows."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


class Vocabulary:
    """Distinct strings; ``ratios`` compares one string with all of them at once."""

    #: Bits of a block of a long string; the bit above takes the carry to the next block.
    BITS = 63

    def __init__(self, strings: Iterable[str]):
        words = sorted(set(strings), key=len, reverse=True)
        self.place = {w: i for i, w in enumerate(words)}
        self._size = np.array([len(w) for w in words], dtype=np.int64)
        self._code: dict[str, int] = {}
        flat = np.array([self._code.setdefault(c, len(self._code)) for w in words for c in w], dtype=np.intp)
        start = np.cumsum(self._size) - self._size
        # The j-th characters of the strings longer than j: those come first.
        self._columns = [flat[start[: int((self._size > j).sum())] + j] for j in range(len(words[0]) if words else 0)]

    def ratios(self, a: str) -> np.ndarray:
        """``indel_ratio(a, w)`` of every string, in the order of ``place``."""
        kind = np.uint16 if len(a) <= 16 else np.uint64
        masks, rows = [], []
        for k in range(0, len(a), self.BITS):
            part = a[k : k + self.BITS]
            bits: dict[int, int] = {}
            for i, c in enumerate(part):
                if c in self._code:
                    bits[self._code[c]] = bits.get(self._code[c], 0) | 1 << i
            m = np.zeros(len(self._code), dtype=kind)
            m[list(bits)] = list(bits.values())
            masks.append(m)
            rows.append(np.full(len(self._size), (1 << len(part)) - 1, dtype=kind))
        one = len(masks) == 1
        for col in self._columns:
            n, carry = len(col), kind(0)
            for m, row in zip(masks, rows, strict=True):
                r = row[:n]
                hit = r & m[col]
                added = r + hit if one else r + hit + carry
                if not one:
                    carry = added >> np.uint64(self.BITS)
                r[:] = added | r - hit
                if not one:
                    r &= np.uint64((1 << self.BITS) - 1)
        common = np.zeros(len(self._size), dtype=np.int64)
        for k, row in enumerate(rows):
            n = len(a[k * self.BITS : (k + 1) * self.BITS])
            common += n - np.bitwise_count(row & kind((1 << n) - 1)).astype(np.int64)
        total = len(a) + self._size
        return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)
