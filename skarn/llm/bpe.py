"""Byte-level BPE over a whole corpus by a pair occurrence index.

The words of a chunk of texts are collected once each. All their symbols stand in one linked list, and an index maps the rank of each
mergeable pair to every position where the pair occurs. The active ranks are taken in ascending order from a
heap; a rank's merge is applied at all its positions at once, left to right, and only the neighbours' entries in
the index are updated. A merge can only create pairs of later ranks, so each rank is applied once.
"""

from __future__ import annotations

import heapq
import importlib.util
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.runtime import need

#: Fixed value of the vocabulary: the pattern that splits text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that are indexed together, and words that a worker remembers from one chunk to the next.
CHUNK_CHARS, REMEMBERED = 16_000_000, 400_000


def tokenizer_file(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """The vocabulary's file: in ``folder``, in $SKARN_TOKENIZERS, in the installed collection, or in /opt/tokenizers."""
    if folder is None:
        folder = os.environ.get("SKARN_TOKENIZERS")
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    printable = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    spare = iter(range(256, 512))
    return {b: chr(b if b in printable else next(spare)) for b in range(256)}


class PairIndexBPE:
    """An encoder for a vocabulary file with ``model.vocab`` and ``model.merges``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.byte_id = [vocab[symbols[b]] for b in range(256)]
        self.shift = max(vocab.values()).bit_length()
        #: rank and left, right and merged id of each pair
        self.rank: dict[int, int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ia, ib = vocab[a], vocab[b]
            self.rank.setdefault(ia << self.shift | ib, r)
            self.pairs.append((ia, ib, vocab[a + b]))
        self.split = regex.compile(SPLIT)

    def encode_words(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and where each word's ids end."""
        byte_id, shift, rank, pairs = self.byte_id, self.shift, self.rank, self.pairs
        raw = [w.encode("utf-8") for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lens)
        n = int(ends[-1]) if len(ends) else 0
        sym = np.array(byte_id, np.int64)[np.frombuffer(b"".join(raw), np.uint8)]
        # -1 marks an end of a word on either side.
        nxt_a = np.arange(1, n + 1)
        prv_a = np.arange(-1, n - 1)
        if n:
            nxt_a[ends[lens > 0] - 1] = -1
            prv_a[(ends - lens)[lens > 0]] = -1
        tok, nxt, prv = sym.tolist(), nxt_a.tolist(), prv_a.tolist()
        where: dict[int, list[int]] = {}
        if n > 1:
            at = np.flatnonzero(nxt_a[:-1] >= 0)
            keys = sym[at] << shift | sym[at + 1]
            kinds, inverse = np.unique(keys, return_inverse=True)
            ranks = np.array([rank.get(k, -1) for k in kinds.tolist()], np.int64)[inverse]
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            firsts = np.flatnonzero(np.diff(ranks, prepend=-1))
            for r, a, b in zip(ranks[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(at)], strict=False):
                where[r] = at[a:b].tolist()
        heap = list(where)
        heapq.heapify(heap)
        get = rank.get
        while heap:
            r = heapq.heappop(heap)
            a, b, merged = pairs[r]
            places = where.pop(r)
            places.sort()
            for p in places:
                q = nxt[p]
                if tok[p] != a or q < 0 or tok[q] != b:
                    continue  # a merge before this one took the pair apart
                tok[p] = merged
                tok[q] = -1
                nxt[p] = after = nxt[q]
                left = prv[p]
                if after >= 0:
                    prv[after] = p
                    k = get(merged << shift | tok[after])
                    if k is not None:
                        if k in where:
                            where[k].append(p)
                        else:
                            where[k] = [p]
                            heapq.heappush(heap, k)
                if left >= 0:
                    k = get(tok[left] << shift | merged)
                    if k is not None:
                        if k in where:
                            where[k].append(left)
                        else:
                            where[k] = [left]
                            heapq.heappush(heap, k)
        left_over = np.array(tok, np.int32) if n else np.empty(0, np.int32)
        live = left_over >= 0
        counts = np.concatenate([[0], np.cumsum(live)])
        return left_over[live], counts[ends] if len(ends) else np.empty(0, np.int64)


@lru_cache(maxsize=4)
def encoder(path: str) -> PairIndexBPE:
    """The encoder of a file, loaded once per worker."""
    return PairIndexBPE(path)


class CorpusEncoder:
    """Encodes chunks of texts; remembers a bounded number of words."""

    def __init__(self, path: str):
        self.bpe = encoder(path)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.start = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of the texts, and the words' count per text; new words are encoded together."""
        if len(self.place) > REMEMBERED:
            self._clear()
        place, split = self.place, self.bpe.split
        known = len(place)
        counts = np.zeros(len(texts), np.int64)
        out: list[int] = []
        fresh: list[str] = []
        for i, t in enumerate(texts):
            found = split.findall(t)
            counts[i] = len(found)
            for w in set(found).difference(place):
                place[w] = known + len(fresh)
                fresh.append(w)
            out += map(place.__getitem__, found)
        if fresh:
            ids, ends = self.bpe.encode_words(fresh)
            self.start = np.concatenate([self.start, np.concatenate([[0], ends[:-1]]) + len(self.ids)])
            self.size = np.concatenate([self.size, np.diff(ends, prepend=0)])
            self.ids = np.concatenate([self.ids, ids])
        return np.array(out, np.int64), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the offsets of each text (one more than texts)."""
        idx, counts = self.words(texts)
        size = self.size[idx]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        gather = np.arange(total) + np.repeat(self.start[idx] - (stop - size), size)
        per_text = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[gather], per_text

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        idx, counts = self.words(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.size[idx])])[np.concatenate([[0], np.cumsum(counts)])])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Keys and texts of up to about CHUNK_CHARS characters."""
    keys: list[pa.Array] = []
    texts: list[str | None] = []
    chars = 0
    for b in batches:
        part = b.column(1).to_pylist()
        keys.append(b.column(0))
        texts += part
        chars += sum(len(t) for t in part if t)
        if chars >= CHUNK_CHARS:
            yield pa.concat_arrays(keys), texts
            keys, texts, chars = [], [], 0
    if texts:
        yield pa.concat_arrays(keys), texts


def _sent(df: DataFrame, path: str | None) -> str:
    """Send the vocabulary's file to all executors; only the driver needs to have it."""
    path = path or tokenizer_file()
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_corpus(df: DataFrame, id_col: str, text: str, path: str | None = None) -> DataFrame:
    """``id_col, ids``: the token ids of every row's text, without special tokens (their strings are ordinary text).

    A null text has null, an empty one an empty list. Texts are whole, however long; duplicate rows are encoded each.
    """
    need(df, id_col, text)
    file = _sent(df, path)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = CorpusEncoder(SparkFiles.get(file))
        for keys, texts in _chunks(batches):
            ids, off = enc.encode([t or "" for t in texts])
            # A list array's offsets are 32-bit, and so are a batch's bytes: hand on parts of at most 2**24 ids.
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(off, off[a] + (1 << 24), side="right")) - 1)
                values = pa.array(ids[off[a] : off[b]], pa.int32())
                mask = np.array([t is None for t in texts[a:b]], bool)
                lists = pa.ListArray.from_arrays(pa.array((off[a : b + 1] - off[a]).astype(np.int32)), values, mask=pa.array(mask))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists], names=[id_col, "ids"])
                a = b

    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text: str, path: str | None = None) -> DataFrame:
    """``id_col, n_tokens``: null for a null text, 0 for an empty one."""
    need(df, id_col, text)
    file = _sent(df, path)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = CorpusEncoder(SparkFiles.get(file))
        for keys, texts in _chunks(batches):
            n = enc.count([t or "" for t in texts])
            mask = np.array([t is None for t in texts], bool)
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64(), mask=mask)], names=[id_col, "n_tokens"])

    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")
