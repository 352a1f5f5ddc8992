"""Duplicates hidden by formatting: commutative multiset hashing of normalized fields.

Every normalized field-name and value pair is hashed with two independent 64-bit hashes, and the hashes of a record
are summed modulo 2**64, so the order of pairs (the words of a list of authors too) doesn't matter. Records are
grouped by the 128-bit fingerprint. Equality of the fields is then verified without sorting anything: records with one
spelling (another 128 bits, over the fields in their order) are equal, and of each further spelling in a group one record is
compared with the group's first record, by its title, its DOI and the counts of its authors' words. Only hashes and ids are
shuffled; the texts of the compared records are fetched by id at the end.
"""

from __future__ import annotations

import html
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.runtime import checkpointed, join_groups, need

WORD = regex.compile(r"[\p{L}\p{N}]+")


def _fold(s: str | None, entities: bool) -> str:
    if s is None:
        return ""
    return unicodedata.normalize("NFC", html.unescape(s) if entities else s).lower()


def letters(s: str | None, entities: bool = True) -> str:
    """The letters and digits of a text, entities decoded, composed and lower-cased; '' for null."""
    return "".join(WORD.findall(_fold(s, entities)))


def author_words(s: str | None) -> list[str]:
    """The words of the authors in their order, without ``and``; [] for null."""
    return [w for w in WORD.findall(_fold(s, True)) if w != "and"]


def doi_letters(s: str | None) -> str:
    """The letters and digits of a DOI from its first ``10.`` on; '' if it has none."""
    t = _fold(s, False)
    at = t.find("10.")
    return "" if at < 0 else "".join(WORD.findall(t[at:]))


def _signed(h: int) -> int:
    return int(np.uint64(h & (1 << 64) - 1).astype(np.int64))


def fingerprint(pairs: list[tuple[str, str]], seed: int = 0, bits: int = 64) -> tuple[int, int]:
    """The commutative hash of name and value pairs, as two signed numbers of ``bits`` bits."""
    lo = hi = 0
    for name, value in pairs:
        b = f"{name}\x00{value}".encode("utf-8", "surrogatepass")
        lo += xxhash.xxh3_64_intdigest(b, 11 + seed)
        hi += xxhash.xxh3_64_intdigest(b, 29 + seed)
    cut = (1 << bits) - 1
    return _signed(lo & cut), _signed(hi & cut)


def spelling(title: str, words: list[str], doi: str) -> tuple[int, int]:
    """A 128-bit hash of the normalized fields with the words in their order, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest("\x00".join([title, doi, *words]).encode("utf-8", "surrogatepass"))
    return _signed(h), _signed(h >> 64)


_KEYS = "rec_id bigint, fp_lo bigint, fp_hi bigint, s_lo bigint, s_hi bigint"


def record_keys(rows: DataFrame, seed: int = 0, bits: int = 64) -> DataFrame:
    """``rec_id, fp_lo, fp_hi, s_lo, s_hi`` (fingerprint and spelling) of rows ``rec_id, title, authors, doi``.

    Records whose title has no letter or digit are dropped: nothing says what they are.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, a, d in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if key := letters(t):
                    words, dk = author_words(a), doi_letters(d)
                    out.append((i, *fingerprint([("title", key), ("doi", dk), *(("author", w) for w in words)], seed, bits), *spelling(key, words, dk)))
            cols = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(cols[:, c]) for c in range(5)], names=[x.split()[0] for x in _KEYS.split(", ")])

    return rows.mapInArrow(keys, _KEYS)


def _unequal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ids of records whose fields aren't those of the first record of their group."""
    for pdf in batches:
        bad = [
            i
            for i, *x in pdf.itertuples(index=False)
            if (letters(x[0]), doi_letters(x[2]), Counter(author_words(x[1]))) != (letters(x[3]), doi_letters(x[5]), Counter(author_words(x[4])))
        ]
        yield pd.DataFrame({"first_id": np.array(bad, np.int64)})


def _fetch(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.hint("shuffle_hash"), rows["rec_id"] == ids["id"]).drop("rec_id")


def collapse(df: DataFrame, id_col: str, title: str, authors: str, doi: str, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(members, records)`` of the equal records.

    ``members``: ``keep_id, rec_id``, one row per record with a usable title, ``keep_id`` the smallest id of its class.
    ``records``: ``keep_id, copies``. Null fields equal only null (or empty) ones. Ids must be different integers; rows
    without one are left out. An empty table gives empty results. ``bits`` shortens the fingerprints, for tests.

    A class that holds a third of all rows is one row per fingerprint before it is joined with its rows
    (``runtime.join_groups``). Records that share a fingerprint but not their fields (never seen with 64 bits) are taken
    out of their group and grouped again under other hashes, until none is left.
    """
    need(df, id_col, title, authors, doi)
    rows = df.select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(title).alias("title"), F.col(authors).alias("authors"), F.col(doi).alias("doi")).where("rec_id IS NOT NULL")
    fp, members, seed = ["fp_lo", "fp_hi"], [], 0
    keys = checkpointed(record_keys(rows, bits=bits))
    while True:
        total = keys.count()
        mixed = (F.min("s_lo") != F.max("s_lo")) | (F.min("s_hi") != F.max("s_hi"))
        groups = checkpointed(keys.groupBy(*fp).agg(F.min("rec_id").alias("keep_id"), F.count(F.lit(1)).alias("size"), mixed.alias("mixed")))
        spelt = join_groups(keys, groups.where("mixed").drop("mixed"), fp, "size", total).groupBy("keep_id", "s_lo", "s_hi").agg(F.min("rec_id").alias("first_id"))
        others = checkpointed(spelt.where("first_id <> keep_id"))
        # The texts of one record per further spelling, and of the first records of their groups.
        one = _fetch(rows, others.select(F.col("first_id").alias("id"), "keep_id")).withColumnRenamed("id", "first_id")
        top = _fetch(rows, others.select(F.col("keep_id").alias("id")).distinct()).select(F.col("id").alias("keep_id"), *[F.col(c).alias(f"top_{c}") for c in ("title", "authors", "doi")])
        both = one.join(top.hint("shuffle_hash"), "keep_id").select("first_id", "title", "authors", "doi", "top_title", "top_authors", "top_doi")
        bad = checkpointed(others.join(both.mapInPandas(_unequal, "first_id bigint"), "first_id", "left_semi"))
        placed = join_groups(keys, groups.drop("mixed"), fp, "size", total)
        if bad.isEmpty():
            members.append(placed.select("keep_id", "rec_id"))
            break
        apart = checkpointed(placed.join(bad.select("keep_id", "s_lo", "s_hi"), ["keep_id", "s_lo", "s_hi"], "left_semi").select("rec_id"))
        members.append(placed.select("keep_id", "rec_id").join(apart, "rec_id", "left_anti"))
        seed += 1
        keys = checkpointed(record_keys(rows.join(apart, "rec_id", "left_semi"), seed, bits))
    out = members[0]
    for m in members[1:]:
        # The smallest id of a group is its own in every round: what is taken out never holds it.
        out = out.unionByName(m)
    records = groups.select("keep_id", F.col("size").alias("copies")) if len(members) == 1 else out.groupBy("keep_id").agg(F.count(F.lit(1)).alias("copies"))
    return out.select("keep_id", "rec_id"), records
