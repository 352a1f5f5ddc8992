"""Readers, writers and dispatch rules for the formats the engine takes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())])
TOKEN = T.StructType([T.StructField(n, T.IntegerType() if n in ("id", "start", "end", "head") else T.StringType()) for n in ("id", "start", "end", "tag", "pos", "morph", "lemma", "dep", "head")])
#: A parsed document: text, entities, sentences, tokens, and all matches before overlaps were resolved.
DOC = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("ents", T.ArrayType(SPAN)),
        T.StructField("sents", T.ArrayType(T.StructType(SPAN.fields[:2]))),
        T.StructField("tokens", T.ArrayType(TOKEN)),
        T.StructField("_", T.StructType([T.StructField("ner_matches", T.ArrayType(SPAN))])),
    ]
)
PAPER = T.StructType([T.StructField(n, T.StringType()) for n in ("authors", "title", "venue", "year", "url", "doi", "type")] + [T.StructField("citations", T.IntegerType())])
#: A technique template as it is stored; edges are read as text since their items are of mixed types.
TEMPLATE = "nodes array<struct<type: string, nlp: array<string>, ioc: array<string>, count: int>>, edges array<array<string>>, instances array<array<array<int>>>, total_count int"


def reports(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole text files, one row each: ``file, text``; paths may be globs."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def sniff(t: Column) -> Column:
    """The kind of a document from its beginning: pdf, zip, html, unicode or ascii text."""
    return (
        F.when(t.startswith("%PDF"), "pdf")
        .when(t.startswith("PK"), "zip")
        .when(t.rlike(r"(?i)^[ \t\r\n]*(?:<!doctype html|<html|<head|<body)"), "html")
        .when(t.rlike(r"[^\x00-\x7F]"), "unicode")
        .otherwise("ascii")
    )


def binary_reports(spark: SparkSession, path: str, default: str | None = None) -> DataFrame:
    """Files of any kind with their kind by content; unknown kinds take ``default`` or raise."""
    df = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", F.decode("content", "ISO-8859-1").alias("head"))
    kind = sniff(F.col("head"))
    bad = F.lit(default) if default else F.raise_error(F.concat(F.lit("no reader for "), F.col("file")))
    return df.select("file", "content", F.when(kind.isin("pdf", "html", "unicode", "ascii"), kind).otherwise(bad).alias("kind"))


def parsed_docs(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents; ``spans`` are all matches where stored, else the entities."""
    df = spark.read.schema(DOC).option("mode", "FAILFAST").option("multiLine", True).json(path)
    return df.withColumn("spans", F.coalesce(F.col("_.ner_matches"), F.col("ents")))


def write_docs(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row."""
    df.write.mode(mode).json(path)


def write_tokens(df: DataFrame, path: str) -> None:
    """Token tables as Parquet; an existing table is left as it is."""
    df.write.mode("ignore").parquet(path)


def papers(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a folder with the columns of PAPER."""
    return spark.read.schema(PAPER).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and without an index."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def column_json(spark: SparkSession, path: str, value: str, key_schema: str = "map<string,string>") -> DataFrame:
    """Column-oriented JSON (``{column: {row: value}}``): the column ``value`` as ``row, value``."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"`{value}` {key_schema}").alias("o"))
    return raw.select(F.explode(F.col("o").getField(value)).alias("row", value))


def embedding_table(spark: SparkSession, path: str) -> DataFrame:
    """A latin-1 CSV whose ``embedding`` column is a list literal."""
    df = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumn("embedding", F.from_json("embedding", "array<double>"))


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """``{file: [labels]}`` as ``file, labels``."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("file", "labels"))


def stix_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Concepts of a STIX bundle: ``id, name, aliases, description``; revoked and deprecated ones are dropped."""
    ref = "array<struct<source_name:string,external_id:string>>"
    obj = f"array<struct<type:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,aliases:array<string>,x_mitre_aliases:array<string>,external_references:{ref}>>"
    o = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"objects {obj}").getField("objects")).alias("o")).select("o.*")
    first = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), 0)
    live = ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False))
    none = F.array().cast("array<string>")
    return o.where(live).select(first["external_id"].alias("id"), "name", F.array_union(F.coalesce("aliases", none), F.coalesce("x_mitre_aliases", none)).alias("aliases"), "description").where("id IS NOT NULL")


def tagged_words(spark: SparkSession, path: str) -> DataFrame:
    """``file, sent, i, word, tag`` of files with a ``word tag`` pair per line and blank lines between sentences."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "v"))
    by = W.partitionBy("file").orderBy("line")
    df = raw.withColumn("sent", F.sum(F.when(F.trim("v") == "", 1).otherwise(0)).over(by)).where(F.trim("v") != "")
    parts = F.split(F.trim("v"), r"\s+")
    return df.select("file", "sent", (F.row_number().over(W.partitionBy("file", "sent").orderBy("line")) - 1).alias("i"), F.get(parts, 0).alias("word"), F.element_at(parts, -1).alias("tag"))


def annotated_spans(spark: SparkSession, path: str) -> DataFrame:
    """``{data, label: [[start, end, type]]}`` lines as ``text, start, end, label``."""
    df = spark.read.schema("data string, label array<array<string>>").json(path)
    return df.select(F.col("data").alias("text"), F.explode("label").alias("l")).select("text", F.get("l", 0).cast("int").alias("start"), F.get("l", 1).cast("int").alias("end"), F.get("l", 2).alias("label"))


def related_words(spark: SparkSession, path: str, sources: list[str], rows: int | None = None) -> DataFrame:
    """Related words (ndjson) with one boolean column per source; ``rows`` limits the words read."""
    df = spark.read.schema("word string, related array<struct<word:string,score:double,`from`:array<string>>>").json(path)
    if rows is not None:
        df = df.limit(rows)
    flat = df.select("word", F.inline("related").alias("other", "score", "origin"))
    return flat.select("word", F.col("other").alias("related"), "score", *[F.array_contains("origin", s).alias(f"source_{s}") for s in sources])


def write_vocab(df: DataFrame, path: str, counts: bool = True, mode: str = "errorifexists") -> None:
    """One ``count token`` (or ``token``) per line."""
    df.select(F.concat_ws(" ", F.col("n"), F.col("token")) if counts else F.col("token")).coalesce(1).write.mode(mode).text(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``token, n`` of a counted vocabulary file."""
    p = F.split("value", " ", 2)
    return spark.read.text(path).select(F.get(p, 1).alias("token"), F.get(p, 0).cast("bigint").alias("n"))


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Technique templates of a folder: ``technique, nodes, edges, instances, total_count``."""
    raw = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_name").endswith(".json"))
    return raw.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("technique"), F.from_json("value", TEMPLATE).alias("t")).select("technique", "t.*")


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of ``src,dst,kind`` edges; malformed rows are dropped."""
    return spark.read.schema("src string, dst string, kind string").option("header", True).option("mode", "DROPMALFORMED").csv(path)
