"""Label arrays and set metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty() -> Column:
    """An empty array of strings."""
    return F.array().cast("array<string>")


def labels(c: Column) -> Column:
    """Items trimmed of white space and upper-cased, null and blank ones dropped, order and repeats kept; [] for null."""
    clean = F.transform(c, lambda x: F.upper(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.coalesce(F.filter(clean, lambda x: x.isNotNull() & (x != "")), empty())


def as_set(c: Column) -> Column:
    """Sorted and without repeats."""
    return F.array_sort(F.array_distinct(c))


def collapse(c: Column) -> Column:
    """Sub-techniques mapped to their technique (``Txxxx.yyy`` to ``Txxxx``)."""
    return F.transform(c, lambda x: F.regexp_replace(x, r"^(T[0-9]{4}).[0-9]{3}.*$", "$1"))


def precision(tp: Column, fp: Column) -> Column:
    """tp / (tp + fp) with the denominator at least 1."""
    return tp / F.greatest(F.lit(1), tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    """tp / (tp + fn) with the denominator at least 1."""
    return tp / F.greatest(F.lit(1), tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2 tp / (2 tp + fp + fn) with the denominator at least 1."""
    return 2 * tp / F.greatest(F.lit(1), 2 * tp + fp + fn)


def set_scores(true: Column, pred: Column) -> dict[str, Column]:
    """precision, recall, accuracy (Jaccard) and f1 of two sets; all 1 if both are empty, 0 where a denominator is 0."""
    tp = F.size(F.array_intersect(true, pred)).cast("double")
    nt, np_ = F.size(F.array_distinct(true)), F.size(F.array_distinct(pred))
    both = (nt == 0) & (np_ == 0)

    def ratio(a: Column, b: Column) -> Column:
        return F.when(both, F.lit(1.0)).when(b == 0, F.lit(0.0)).otherwise(a / b)

    return {"precision": ratio(tp, np_), "recall": ratio(tp, nt), "accuracy": ratio(tp, nt + np_ - tp), "f1": ratio(2 * tp, nt + np_)}


def multi_hot(c: Column, order: Column) -> Column:
    """A 0/1 vector over the labels of ``order``."""
    return F.transform(order, lambda x: F.array_contains(c, x).cast("int"))
