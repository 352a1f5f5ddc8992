"""Expressions over labels, identifiers and configuration names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the form of a concept id.
CONCEPT = r"(?:TA|T|DS|S|G|M)[0-9]{4}(?:\.[0-9]{3})?"


def is_compound(label: Column) -> Column:
    """Whether a label is one or more concept ids joined by ``||``."""
    return label.rlike(rf"^{CONCEPT}(?:\|\|{CONCEPT})*\z")


def concepts(label: Column) -> Column:
    """The concept ids of a compound label, in order; an empty array for other labels."""
    return F.when(is_compound(label), F.split(label, r"\|\|")).otherwise(F.array().cast("array<string>"))


def concept_kind(label: Column) -> Column:
    """The kind of a concept id by its prefix; null for other labels."""
    # Prefixes of concept ids.
    kinds = (("TA", "tactic"), ("T", "technique"), ("DS", "data source"), ("S", "software"), ("G", "group"), ("M", "mitigation"))
    return F.when(label.rlike(rf"^{CONCEPT}\z"), F.coalesce(*[F.when(label.startswith(p), F.lit(k)) for p, k in kinds]))


def is_parent_technique(label: Column) -> Column:
    """A technique id without a sub-technique."""
    return F.contains(label, F.lit("T1")) & ~F.contains(label, F.lit("."))


def rebuild_sentence(left: Column, mention: Column, right: Column) -> Column:
    """A sentence from the text around a mention."""
    return F.concat(F.coalesce(left, F.lit("")), F.coalesce(mention, F.lit("")), F.coalesce(right, F.lit("")))


def percent(score: Column) -> Column:
    """A score as a percentage with two decimals."""
    return F.round(score * 100, 2)


def special_token(t: Column) -> Column:
    """Whether a token is written in brackets."""
    return t.startswith("[") & t.endswith("]") & (F.length(t) > 2)


def model_kind(name: Column, domain: list[str], science: list[str]) -> Column:
    """The family of a model by its name: ``CTI``, ``Sci`` or ``Generic``."""
    return F.when(name.isin(domain), "CTI").when(name.isin(science), "Sci").otherwise("Generic")


def strategy(rag: Column, few_shot: Column, judge: Column, per_sentence: Column) -> Column:
    """The prompt strategy of an experiment's flags."""
    base = F.when(per_sentence, "sentence").otherwise("document")
    return F.concat_ws("+", base, F.when(rag, "rag"), F.when(few_shot, "few_shot"), F.when(judge, "judge"))


def run_setup(folder: Column) -> Column:
    """``struct<run, dataset, model>`` of a result folder named ``run_dataset_model...``."""
    p = F.split(F.element_at(F.split(folder, "/"), -1), "_")
    return F.struct(F.get(p, 0).alias("run"), F.get(p, 1).alias("dataset"), F.array_join(F.slice(p, 3, F.greatest(F.size(p), F.lit(1))), "_").alias("model"))


def is_integer(t: Column) -> Column:
    """Whether a text is a whole number."""
    return t.rlike(r"^-?[0-9]+\z")


def clock(seconds: Column) -> Column:
    """Seconds as ``h:mm:ss``."""
    s = seconds.cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def related_pos(concept: Column, is_word: Column) -> Column:
    """The part of speech of a concept phrase: software and groups are proper nouns unless they are dictionary words."""
    return F.when(concept.rlike("^[SG][0-9]") & ~is_word, "PROPN").otherwise("NOUN")
