"""Pipelines as lists of DataFrame stages; switching a stage off is leaving it out of the list."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]


def run(df: DataFrame, stages: Sequence[tuple[str, Stage]], without: Iterable[str] = ()) -> DataFrame:
    """Apply named stages in order, except those in ``without``; unknown names raise."""
    skip = set(without)
    if unknown := skip - {n for n, _ in stages}:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    for name, stage in stages:
        if name not in skip:
            df = df.transform(stage)
    return df


def require(*columns: str) -> Stage:
    """A stage that checks its input's columns and changes nothing."""

    def check(df: DataFrame) -> DataFrame:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns {missing}")
        return df

    return check
