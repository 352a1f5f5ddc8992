"""The same functions on a stream: row-local operators work as they are, windows take a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tumbling(df: DataFrame, ts: str, width: str, key: str, value: str, late: str | None = None) -> DataFrame:
    """``start, key, n, value`` per window; on a stream ``late`` bounds how long rows are waited for."""
    if late is not None:
        df = df.withWatermark(ts, late)
    g = df.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("value"))
    return g.select(F.col("w.start").alias("start"), key, "n", "value")


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
