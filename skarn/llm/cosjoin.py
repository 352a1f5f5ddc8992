"""Same or near-same sentences across splits: a weighted cosine join verified by word edits.

A sentence is a vector whose terms are (word, how many times it came before), weighted by how rare they are in both splits:
``u = log(1 + N / f)``, with f from a table of fixed size. Two sequences that differ by at most ``k = n // 10`` words
(n: the longer one's count) lose at most k terms each, so their dot product is at least the squared norm of either less its
k heaviest terms: that bound is the join's threshold, and it loses no pair. Terms that the other split doesn't have
have a largest weight of 0 there: each of them is surely lost, so a sentence with more than k of them has no partner, and z of them leave
``k - z`` of the others to lose. The others are ordered from heavy to light. Without a shared term among the heaviest
``k - z + 1`` of them, the residual norm of a sentence is below the threshold; likewise, without s shared terms among the heaviest
``k - z + s``. The inverted lists are therefore keyed by s such terms at once (three for sentences below LONG words, one
above), which keeps the lists short even where every rare word of a sentence belongs to a template. Every
list entry carries a 64-bit sketch, the parity of its terms' places: sequences within k edits differ in at most 2k
terms, so in at most 2k bits. Each pair that meets in a list and is near enough by its sketch is tested once, by its exact
dot product, then by its word edits.

Equal word sequences are one class (by 128 bits) before the join, so copies never multiply candidates. Only hashes and ids
are grouped; a sentence's text is shuffled once, by its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.runtime import checkpointed, join_groups, need

#: Buckets of term frequencies: a table of fixed size, sent to every worker. Terms that share one only look more frequent.
BUCKETS = 1 << 18
#: Words from which a sentence is listed under single terms.
LONG = 70
#: Shorter sequences have no partner but equal ones (9 words may lack one of 10).
SHORTEST = 9
#: Members of a class that one task joins with its links; larger classes are dealt to several.
PART = 10_000


def plain(sentence: Column) -> Column:
    """The longest runs of letters and digits, lower-cased, in order, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def within_edits(a: list[str], b: list[str], k: int) -> bool:
    """Whether two word lists differ by at most k inserted, dropped or replaced words (furthest points per diagonal)."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False

    def slide(x: int, d: int) -> int:
        while x < n and x + d < m and a[x] == b[x + d]:
            x += 1
        return x

    far = {0: slide(0, 0)}
    for e in range(k + 1):
        if far.get(m - n, -1) >= n:
            return True
        if e == k:
            return False
        new = {}
        for d in range(-e - 1, e + 2):
            x = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1)
            if x >= 0 and -n <= d <= m:
                new[d] = slide(min(x, n, m - d), d)
        far = new
    return False


def word_hashes(seq: Column) -> Column:
    """A 64-bit hash of every word."""
    return F.transform(seq, lambda w: F.xxhash64(w))


def _mixed(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Hashes stirred with a salt (the finalizer of a public 64-bit mixer)."""
    x = h ^ (np.asarray(salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _terms(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and words of the row for all (word, earlier occurrence) terms of a batch, grouped by row."""
    h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return row, _mixed(h, np.arange(len(h)) - first), size


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        total += np.bincount(_bucket(_terms(b.column(0))[1]), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


def _bucket(t: np.ndarray) -> np.ndarray:
    return (t & np.uint64(BUCKETS - 1)).astype(np.int64)


def frequencies(texts: DataFrame) -> np.ndarray:
    """Occurrences of the terms of ``w`` by bucket, a table of BUCKETS numbers."""
    hashed = texts.select(word_hashes(F.split("w", " "))).mapInArrow(_frequencies, "bucket bigint, n bigint")
    got = hashed.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _keys(lists: pa.Array, ids: np.ndarray, count: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """Key, id, words and sketch of every list that the rows of a batch stand in (rows have words).

    ``count``: frequencies of both splits, which order the terms; ``other``: those of the other split.
    """
    row, t, size = _terms(lists)
    if not len(size):
        return [np.empty(0, np.int64)] * 4
    begin = np.cumsum(size) - size
    sketch = np.bitwise_xor.reduceat(np.uint64(1) << (t >> np.uint64(58)), begin).view(np.int64)
    bucket = _bucket(t)
    absent = other[bucket] == 0
    order = np.lexsort((t, count[bucket], absent, row))
    t = t[order]
    lost = np.bincount(row[absent], minlength=len(size))
    k = size // 10 - lost
    out: list[list[np.ndarray]] = []
    # The longest partner has n / 0.9 words; from LONG words on pairs meet in the single-term lists.
    for s, fits in ((3, size < LONG), (1, size + size // 9 + 1 >= LONG)):
        for kk in np.unique(k[fits & (k >= 0)]):
            rows = np.flatnonzero(fits & (k == kk))
            p = t[begin[rows][:, None] + np.arange(kk + s)]
            combos = np.array(list(combinations(range(kk + s), s)))
            keys = np.full((len(rows), len(combos)), s, np.uint64)
            for c in range(s):
                keys = _mixed(keys ^ p[:, combos[:, c]], 1)
            out.append([keys.ravel().view(np.int64), *(np.repeat(c[rows], keys.shape[1]) for c in (ids, size, sketch))])
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4


def prefix_lists(reps: DataFrame, count: np.ndarray, other: np.ndarray) -> DataFrame:
    """``key, id, n, s``: a row per list that a sentence ``id, w`` of SHORTEST or more words stands in."""
    sent = reps.sparkSession.sparkContext.broadcast((count, other))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = _keys(b.column(1), b.column(0).to_numpy(), *sent.value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, kinds, strict=True)], names=["key", "id", "n", "s"])

    return reps.select("id", word_hashes(F.split("w", " "))).mapInArrow(lists, "key bigint, id bigint, n int, s bigint")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Different pairs ``l_id, r_id`` that meet in a list, of admissible lengths and sketches."""
    a = left.select("key", *[F.col(c).alias(f"l_{c}") for c in ("id", "n", "s")])
    b = right.select("key", *[F.col(c).alias(f"r_{c}") for c in ("id", "n", "s")])
    n, m = F.greatest("l_n", "r_n"), F.least("l_n", "r_n")
    k = F.floor(n / 10)
    met = a.join(b, "key").where((m >= n - k) & (F.bit_count(F.col("l_s").bitwiseXOR(F.col("r_s"))) <= 2 * k - (n - m)))
    return met.select("l_id", "r_id").distinct()


def _verified(pairs: DataFrame, count: np.ndarray) -> DataFrame:
    """The pairs ``l_id, r_id, l_n, r_n, l_w, r_w`` that reach the threshold and are within their edits, without the texts."""
    sent = pairs.sparkSession.sparkContext.broadcast(np.log1p(max(1, int(count.sum())) / np.maximum(count, 1)) ** 2)
    ids = [f.name for f in pairs.schema.fields if f.name not in ("l_w", "r_w")]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights, terms, ends = [], [], []
            for c in ("l_h", "r_h"):
                _, t, size = _terms(b.column(b.schema.get_field_index(c)))
                terms.append(t)
                weights.append(sent.value[_bucket(t)])
                ends.append(np.concatenate([[0], np.cumsum(size)]))
            texts = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("l_w", "r_w")), strict=True)
            keep = []
            for i, (x, y) in enumerate(texts):
                (t, u), (v, w) = ((terms[j][ends[j][i] : ends[j][i + 1]], weights[j][ends[j][i] : ends[j][i + 1]]) for j in (0, 1))
                n = max(len(t), len(v))
                k = n // 10
                dot = u[np.isin(t, v)].sum()
                floor = max(z.sum() - np.sort(z)[::-1][: k - (n - len(z))].sum() if k >= n - len(z) else np.inf for z in (u, w))
                keep.append(bool(dot >= floor - 1e-6) and within_edits(x.split(" "), y.split(" "), k))
            yield b.filter(pa.array(keep, pa.bool_())).select(ids)

    hashed = [word_hashes(F.split(c, " ")).alias(h) for c, h in (("l_w", "l_h"), ("r_w", "r_h"))]
    return pairs.select("*", *hashed).mapInArrow(verify, ", ".join(f"{c} bigint" for c in ids))


class Overlaps:
    """The links between the word sequences of two splits, and the members of each.

    ``links``: ``l_id, r_id, l_n, r_n``: class ids of sequences that differ by at most a tenth of the longer one's words, equal
    ones included, with their numbers of members. ``members(0)``, ``members(1)``: ``class_id, row_id, n`` of either side. The class id
    is the smallest row id with that word sequence on that side. Null sentences, those without words and rows without an id have no
    class. Ids must be integers that differ within a side; other columns are ignored. Empty sides give empty results.
    """

    def __init__(self, left: DataFrame, right: DataFrame, id_col: str, sentence: str):
        sides = []
        for df in (left, right):
            need(df, id_col, sentence)
            rows = df.select(F.col(id_col).cast("bigint").alias("id"), plain(F.col(sentence)).alias("w")).where("id IS NOT NULL AND w <> ''")
            sides.append(rows.withColumn("n", F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit(""))) + 1))
        hashed = [r.select(F.lit(i).alias("side"), "id", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"), "n") for i, r in enumerate(sides)]
        self._keys = checkpointed(hashed[0].unionByName(hashed[1]))
        self._total = self._keys.count()
        ids = [f(F.when(F.col("side") == i, F.col("id"))).alias(c) for i, p in enumerate("lr") for f, c in ((F.min, f"{p}_id"), (F.count, f"{p}_n"))]
        self._classes = checkpointed(self._keys.groupBy("h1", "h2", "n").agg(*ids))
        freq = [frequencies(r) for r in sides]
        count = freq[0] + freq[1]
        reps, lists = [], []
        for i, p in enumerate("lr"):
            own = self._classes.where((F.col(f"{p}_n") > 0) & (F.col("n") >= SHORTEST)).select(F.col(f"{p}_id").alias("c"), f"{p}_n")
            texts = sides[i].where(F.col("n") >= SHORTEST).select("id", "w")
            reps.append(texts.join(own.hint("shuffle_hash"), F.col("id") == F.col("c")).drop("c"))
            lists.append(prefix_lists(reps[i], count, freq[1 - i]))
        pairs = candidates(*lists)
        for p, r in zip("lr", reps, strict=True):
            pairs = pairs.join(r.withColumnsRenamed({"id": f"{p}_id", "w": f"{p}_w"}).hint("shuffle_hash"), f"{p}_id")
        near = _verified(pairs.where("l_w <> r_w").select("l_id", "r_id", "l_n", "r_n", "l_w", "r_w"), count)
        equal = self._classes.where("l_n > 0 AND r_n > 0").select("l_id", "r_id", "l_n", "r_n")
        self.links = equal.unionByName(near)

    def members(self, side: int, more: DataFrame | None = None) -> DataFrame:
        """``class_id, row_id, n`` of a side, with what ``more`` has for a class (``class_id`` and other columns)."""
        p = "lr"[side]
        groups = self._classes.where(f"{p}_n > 0").select("h1", "h2", F.col(f"{p}_id").alias("class_id"), F.col(f"{p}_n").alias("n"), F.col(f"{p}_n").alias("size"))
        if more is not None:
            groups = checkpointed(groups.join(more, "class_id", "left"))
        rows = self._keys.where(F.col("side") == side).select(F.col("id").alias("row_id"), "h1", "h2")
        return join_groups(rows, groups, ["h1", "h2"], "size", self._total).drop("h1", "h2")

    def pairs(self) -> DataFrame:
        """All pairs of linked rows, ``l_row, r_row``. A class of more than PART members is dealt to several tasks, and its links to all of them."""
        out = self.links
        for p in "lr":
            parts = F.ceil(F.col(f"{p}_n") / PART).cast("int")
            out = out.withColumn(f"{p}_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        for i, p in enumerate("lr"):
            part = F.pmod(F.xxhash64("row_id"), F.ceil(F.col("n") / PART)).cast("int")
            m = self.members(i).select(F.col("class_id").alias(f"{p}_id"), part.alias(f"{p}_part"), F.col("row_id").alias(f"{p}_row"))
            out = out.join(m, [f"{p}_id", f"{p}_part"])
        return out.select("l_row", "r_row")
