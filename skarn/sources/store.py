"""Datasets by name, embedding tables, experiment logs, catalogs and knowledge graphs."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators.datasets import spread


@dataclass(frozen=True)
class Dataset:
    """Where the parts of a dataset are and how its columns are called."""

    train: str
    test: str | None
    document: str
    augmented: str | None = None


#: The datasets that can be loaded by name.
DATASETS = {"tram": Dataset("tram_train", "tram_test", "doc_title", "tram_train_augmented_artificial"), "bosch": Dataset("bosch_train", None, "document_name")}


def load_dataset(spark: SparkSession, folder: str, name: str, augmented: bool = False, test_share: int = 20) -> tuple[DataFrame, DataFrame]:
    """Train and test rows ``sent_id, sentence, labels, document``; without a test table a share of the rows is split off by id."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name}; known are {sorted(DATASETS)}")
    d = DATASETS[name]

    def rows(table: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{table}.parquet").select("sent_id", "sentence", "labels", F.col(d.document).alias("document"))

    train = rows(d.augmented if augmented and d.augmented else d.train)
    if d.test:
        return train, rows(d.test)
    part = spread(F.col("sent_id"), 100)
    return train.where(part >= test_share), train.where(part < test_share)


Embedder = Callable[[list[str]], list[list[float]]]


def with_retries(embed: Embedder, attempts: int = 5, wait: float = 1.0) -> Embedder:
    """An embedding service called again after failures, a bounded number of times with growing pauses."""

    def call(texts: list[str]) -> list[list[float]]:
        for i in range(attempts):
            try:
                return embed(texts)
            except OSError:
                if i == attempts - 1:
                    raise
                time.sleep(wait * 2**i)
        raise AssertionError

    return call


def embed_table(df: DataFrame, id_col: str, *texts: str, embed: Embedder) -> DataFrame:
    """``id_col, embedding`` of text columns joined by `` - ``; equal texts are embedded once."""
    text = F.concat_ws(" - ", *texts)
    rows = df.select(id_col, text.alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_text": pdf["_text"], "embedding": embed(pdf["_text"].tolist())})

    known = rows.select("_text").distinct().mapInPandas(run, "_text string, embedding array<double>")
    return rows.join(known, "_text").select(id_col, "embedding")


def log_run(df: DataFrame, path: str, **settings: object) -> None:
    """Append predictions to a run table with the run's settings as columns."""
    df.withColumns({f"run_{k}": F.lit(str(v)) for k, v in settings.items()}).write.mode("append").parquet(path)


def catalog_table(spark: SparkSession, patterns: dict[str, str] | list[tuple[str, str]]) -> DataFrame:
    """A catalog of patterns as ``name, ord, pattern``."""
    items = list(patterns.items()) if isinstance(patterns, dict) else list(patterns)
    for _, p in items:
        re.compile(p)
    return spark.createDataFrame([(n, i, p) for i, (n, p) in enumerate(items)], "name string, ord int, pattern string")


def catalog_json(df: DataFrame) -> str:
    """A catalog as JSON, in order."""
    return json.dumps({r["name"]: r["pattern"] for r in df.orderBy("ord").collect()})


def catalog_from_json(spark: SparkSession, text: str) -> DataFrame:
    """A catalog read back from JSON."""
    return catalog_table(spark, json.loads(text))


_GML = re.compile(r"(node|edge)\s*\[((?:[^\[\]\"]|\"[^\"]*\"|\[[^\]]*\])*)\]")
_PAIR = re.compile(r"(\w+)\s+(\"[^\"]*\"|[^\s\[\]]+)")


def knowledge_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, props`` and edges ``src, dst, props`` of GML files."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(kind, {k: v.strip('"') for k, v in _PAIR.findall(body)}) for text in pdf["value"] for kind, body in _GML.findall(text)]
            yield pd.DataFrame(rows, columns=["kind", "props"])

    raw = spark.read.text(path, wholetext=True).mapInPandas(parse, "kind string, props map<string,string>")
    nodes = raw.where("kind = 'node'").select(F.col("props")["id"].alias("id"), "props")
    edges = raw.where("kind = 'edge'").select(F.col("props")["source"].alias("src"), F.col("props")["target"].alias("dst"), "props")
    return nodes, edges
