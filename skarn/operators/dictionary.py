"""Phrase, bag and attribute matching against dictionaries.

Dictionaries are joined on the first token of a phrase; the phrase itself is then compared with the tokens that
follow, which travel along as a slice as long as the longest phrase. A dictionary is broadcast only if its size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import words
from skarn.runtime import broadcast_if_small


# The initials of concepts that a dictionary is made of (techniques, software, groups, mitigations, data
# sources), and what is left out: ids, and an alias of one id that is an everyday word.
KINDS = ("T", "S", "G", "M", "D")
SKIPPED_IDS = ("S1053.001", "S1053.002")
SKIPPED_ALIASES = (("S0110", "at"),)
#: Words that carry no content of their own; they are left out of bags.
LIGHT_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "is", "it", "its", "of", "on", "or", "over", "that", "the", "their", "this", "to", "via", "was", "were", "with")


def phrase_rows(concepts: DataFrame, label: str, phrases: str) -> DataFrame:
    """``label, phrase`` of every different non-blank alias of an array column; see KINDS and what is skipped. Null labels have none."""
    rows = concepts.where(F.substring(label, 1, 1).isin(*KINDS) & ~F.col(label).isin(*SKIPPED_IDS)).select(F.col(label).alias("label"), F.explode(F.array_distinct(phrases)).alias("phrase"))
    for i, alias in SKIPPED_ALIASES:
        rows = rows.where(~((F.col("label") == i) & (F.col("phrase") == alias)))
    return rows.where("trim(phrase) <> ''").distinct()


def compile_phrases(rows: DataFrame) -> DataFrame:
    """``first, phrase_tokens, label``: equal phrases carry their labels joined by ``||`` in order."""
    toks = rows.select("label", words(F.col("phrase")).alias("phrase_tokens")).where(F.size("phrase_tokens") > 0)
    one = toks.groupBy("phrase_tokens").agg(F.array_join(F.array_sort(F.collect_set("label")), "||").alias("label"))
    return one.select(F.get("phrase_tokens", 0).alias("first"), "phrase_tokens", "label")


def match_phrases(tokens: DataFrame, id_col: str, token_array: str, dictionary: DataFrame, longest: bool = False) -> DataFrame:
    """``id_col, start, end, label`` of every phrase at every start; with ``longest`` only the longest per start.

    The dictionary is computed once, when the operator is called. What a token takes along is cut inside the row, so
    the work is linear in the length of the text. Null token arrays and an empty dictionary give no rows.
    """
    known = broadcast_if_small(dictionary)
    width = known.agg(F.coalesce(F.max(F.size("phrase_tokens")), F.lit(1)).alias("w")).first()["w"]
    t = F.col(token_array)
    starts = F.transform(t, lambda x, i: F.struct(i.alias("start"), x.alias("first"), F.slice(t, i + 1, F.lit(width)).alias("_near")))
    at = tokens.where(F.size(t) > 0).select(id_col, F.inline(starts))
    hit = at.join(known, "first").where(F.slice("_near", F.lit(1), F.size("phrase_tokens")) == F.col("phrase_tokens"))
    out = hit.select(id_col, "start", (F.col("start") + F.size("phrase_tokens")).alias("end"), "label")
    if longest:
        out = out.groupBy(id_col, "start").agg(F.max_by(F.struct("end", "label"), "end").alias("x")).select(id_col, "start", "x.end", "x.label")
    return out


def compile_bags(rows: DataFrame, drop: tuple[str, ...] = LIGHT_WORDS) -> DataFrame:
    """``label, bag, slot, n_slots``: a phrase as a set of words without the light ones, one row per word; a phrase of light words only has none."""
    kept = F.filter(words(F.col("phrase")), lambda w: ~w.isin(*drop))
    toks = rows.select("label", F.array_sort(F.array_distinct(kept)).alias("bag")).where(F.size("bag") > 0).distinct()
    return toks.select("label", F.array_join("bag", " ").alias("bag"), F.explode("bag").alias("slot"), F.size("bag").alias("n_slots"))


def match_bags(tokens: DataFrame, id_col: str, token_array: str, bags: DataFrame) -> DataFrame:
    """``id_col, label, bag, spots``: bags whose words all occur in the sentence; ``spots`` lists the positions per word."""
    at = tokens.select(id_col, F.posexplode(token_array).alias("i", "slot"))
    hits = at.join(broadcast_if_small(bags), "slot").groupBy(id_col, "label", "bag", "n_slots", "slot").agg(F.array_sort(F.collect_list("i")).alias("at"))
    full = hits.groupBy(id_col, "label", "bag", "n_slots").agg(F.sort_array(F.collect_list("at")).alias("spots"))
    return full.where(F.size("spots") == F.col("n_slots")).drop("n_slots")


def tightest(spots: list[list[int]]) -> list[tuple[int, int]]:
    """Spans that cover one position of each slot, the smallest first; positions are used once.

    Sweeps a window over the merged positions instead of trying all combinations.
    """
    left = [sorted(s) for s in spots]
    out = []
    while all(left):
        events = sorted((p, k) for k, s in enumerate(left) for p in s)
        have: dict[int, int] = {}
        best = None
        a = 0
        for p, k in events:
            have[k] = have.get(k, 0) + 1
            while len(have) == len(left):
                q, j = events[a]
                if best is None or p - q < best[1] - best[0]:
                    best = (q, p)
                have[j] -= 1
                if not have[j]:
                    del have[j]
                a += 1
        if best is None:
            break
        out.append((best[0], best[1] + 1))
        left = [[p for p in s if not best[0] <= p <= best[1]] for s in left]
    return out


def bag_spans(matches: DataFrame, id_col: str) -> DataFrame:
    """``id_col, start, end, label`` of the tightest spans of every completed bag."""
    kind = dict(matches.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, a, b, lab) for i, lab, s in zip(pdf[id_col], pdf["label"], pdf["spots"], strict=True) for a, b in tightest([list(x) for x in s])]
            yield pd.DataFrame(rows, columns=[id_col, "start", "end", "label"])

    return matches.select(id_col, "label", "spots").mapInPandas(run, f"`{id_col}` {kind}, start int, end int, label string")


def attribute_patterns(spark: SparkSession, patterns: dict[str, object]) -> DataFrame:
    """``value, pattern, ord`` of patterns given as a value or as ``{"IN": [values]}``; other predicates raise an error."""
    rows: list[tuple[str, str, int]] = []
    for name, spec in patterns.items():
        if isinstance(spec, dict) and set(spec) != {"IN"}:
            raise NotImplementedError(f"predicates {sorted(set(spec) - {'IN'})} of pattern {name}")
        rows += [(v, name, len(rows) + k) for k, v in enumerate(spec["IN"] if isinstance(spec, dict) else [spec])]
    return spark.createDataFrame(rows, "value string, pattern string, ord bigint")


def match_attribute(tokens: DataFrame, attribute: str, patterns: DataFrame, greedy: str = "SET") -> DataFrame:
    """Tokens whose attribute equals a pattern's value; ``patterns`` has ``value, pattern`` and for FIRST also ``ord``.

    Where several patterns have one value, ``greedy`` says what happens: SET gives a row for each, FIRST the one with the
    smallest ``ord``, ERROR raises a ValueError. Null attributes match nothing.
    """
    if greedy not in ("SET", "FIRST", "ERROR"):
        raise ValueError(f"greedy must be SET, FIRST or ERROR, not {greedy}")
    if greedy == "FIRST":
        patterns = patterns.groupBy("value").agg(F.min_by("pattern", "ord").alias("pattern"))
    elif greedy == "ERROR":
        twice = patterns.groupBy("value").agg(F.count_distinct("pattern").alias("n")).where("n > 1").first()
        if twice is not None:
            raise ValueError(f"several patterns have the value {twice['value']!r}")
    known = broadcast_if_small(patterns.select("value", "pattern").distinct())
    return tokens.join(known, tokens[attribute] == known["value"]).drop("value")


def combinations(slots: list[list[int]]) -> list[tuple[int, ...]]:
    """Every choice of one candidate per slot (for small slots)."""
    return list(product(*slots))
