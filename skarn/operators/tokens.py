"""Token tables, vocabularies and encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import words
from skarn.operators.datasets import positions

#: The special tokens at the head of every vocabulary.
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


def token_table(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id_col, i, token``: one row per word, i from 0. Null and empty texts have none."""
    return df.select(id_col, F.posexplode(words(F.col(text))).alias("i", "token"))


def word_counts(tokens: DataFrame, *by: str) -> DataFrame:
    """Occurrences of every token, per ``by`` if given."""
    return tokens.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, k: int, at_least: int, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """The k most frequent tokens (ties: by token) that occur ``at_least`` times, and the special tokens (0 where they don't occur)."""
    top = counts.orderBy(F.desc("n"), "token").limit(k).where(F.col("n") >= at_least)
    extra = F.array(*[F.lit(s) for s in specials])
    base = counts.sparkSession.range(1).select(F.explode(extra).alias("token"))
    return top.unionByName(base.join(top, "token", "left_anti").select("token", F.lit(0).cast("bigint").alias("n")))


def merge_vocabularies(*vocs: DataFrame) -> DataFrame:
    """Counts of several vocabularies added up."""
    out = vocs[0]
    for v in vocs[1:]:
        out = out.unionByName(v)
    return out.groupBy("token").agg(F.sum("n").alias("n"))


def index_map(vocab: DataFrame) -> DataFrame:
    """One row: a map from token to its dense index in token order. For vocabularies of bounded size (a top k)."""
    tokens = F.array_sort(F.collect_list("token"))
    return vocab.agg(tokens.alias("t")).select(F.map_from_arrays("t", F.sequence(F.lit(0), F.size("t") - 1)).alias("index"))


def encode(tokens: Column, index: Column, unknown: str = "[UNK]") -> Column:
    """Indices of an array of tokens; unknown ones take the index of ``unknown``."""
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(index, t), F.try_element_at(index, F.lit(unknown))))


def context(tokens: Column, before: int, after: int, pad: str = "") -> Column:
    """For each token the tokens around it, padded at the ends: ``i, token, left, right``. Stays within the row."""
    n = F.size(tokens)

    def at(i: Column) -> Column:
        return F.when((i >= 1) & (i <= n), F.get(tokens, i - 1)).otherwise(F.lit(pad))

    def one(t: Column, i: Column) -> Column:
        left = F.array(*[at(i + 1 - k) for k in range(before, 0, -1)])
        right = F.array(*[at(i + 1 + k) for k in range(1, after + 1)])
        return F.struct(i.alias("i"), t.alias("token"), left.alias("left"), right.alias("right"))

    return F.transform(tokens, one)


def pairs(sentences: DataFrame, doc: str, order: str, text: str, skip: bool = False) -> DataFrame:
    """Consecutive sentences of a document as ``first, second``; with ``skip`` every second pair only."""
    # The position is a key of its own within the document, so the pairs are a join without hot keys.
    at = positions(sentences.select(doc, order, text), doc, order)
    after = at.select(F.col(doc).alias("_d"), (F.col("pos") - 1).alias("_p"), F.col(text).alias("second"))
    out = at.join(after, F.col(doc).eqNullSafe(F.col("_d")) & (F.col("pos") == F.col("_p"))).select(doc, "pos", F.col(text).alias("first"), "second")
    return out.where("pos % 2 = 0") if skip else out


def propagate(mentions: DataFrame, chain: list[str], label: str, specific: str) -> DataFrame:
    """``mentions`` with unlabelled ones (null or ``''``) labelled by their chain, whose keys are ``chain``.

    A chain takes the label of its most specific mention (where ``specific`` holds), else its most frequent label, of
    equally frequent ones the first in order; a chain without labels stays unlabelled. Its labels are counted before they are compared.
    """
    own = F.coalesce(F.col(label), F.lit(""))
    n = mentions.where(own != "").groupBy(*chain, own.alias("_l")).agg(F.count(F.lit(1)).alias("_c"), F.max(F.coalesce(F.col(specific), F.lit(False))).alias("_s"))
    best = n.groupBy(*chain).agg(F.min_by("_l", F.struct(~F.col("_s"), -F.col("_c"), "_l")).alias("_chain"))
    return mentions.join(best, chain, "left").withColumn(label, F.when(own != "", own).otherwise(F.coalesce("_chain", F.lit("")))).drop("_chain")


def pick_lemma(candidates: DataFrame, word: str = "word") -> DataFrame:
    """One lemma per word: the shortest, verbs first, then by part of speech and spelling."""
    key = F.struct(F.length("lemma"), F.when(F.col("pos") == "VERB", 0).otherwise(1), "pos", "lemma")
    return candidates.groupBy(word).agg(F.min_by(F.struct("lemma", "pos"), key).alias("x")).select(word, "x.lemma", "x.pos")


def base_form(token: Column, lemma: Column) -> Column:
    """The lemma in lower case, else the token in lower case."""
    return F.lower(F.coalesce(lemma, token))
