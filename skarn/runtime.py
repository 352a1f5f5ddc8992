"""Session helpers shared by every operator: shipping the package, cutting lineage, reading tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attribute on the SparkContext that remembers that the package was shipped to its executors.
_MARK = "_skarn_shipped"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skarn")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SKARN_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give every executor this package (once per context), so that Arrow functions can be imported there."""
    sc = spark.sparkContext
    if getattr(sc, _MARK, False):
        return
    root = Path(__file__).resolve().parent
    out = Path(sc._temp_dir) / "skarn_pkg.zip"  # the driver's own folder; Spark serves the file to the executors
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("skarn") / p.relative_to(root))
    sc.addPyFile(str(out))
    setattr(sc, _MARK, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` into the shared folder of ``spark.checkpoint.dir``.

    The folder is read from the session. Only a local session without one gets a folder of its own; a cluster
    without one is an error, as a folder of one machine would lose the data with that machine.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="skarn-cp-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def busy_tasks(spark: SparkSession) -> int:
    """Partitions for rows that are few bytes and much work: a number given to ``repartition`` isn't lowered to fit the bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def need(df: DataFrame, *columns: str) -> None:
    """Raise a ValueError that names the columns an operator misses."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")


#: Most bytes (as text) of a side that is broadcast.
SMALL_BYTES = 32_000_000


def broadcast_if_small(df: DataFrame, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """``df``, computed once and cut from its lineage, with a broadcast hint if its rows are at most ``max_bytes`` as text.

    A larger side comes back without the hint: the planner then shuffles it.
    """
    kept = checkpointed(df)
    size = kept.agg(F.sum(F.octet_length(F.to_json(F.struct(*kept.columns)))).alias("n")).first()["n"] or 0
    return F.broadcast(kept) if size <= max_bytes else kept


#: Rows from which a group is hot at least, and most groups that are hot: the hot groups are a table of bounded size.
HOT, HOT_GROUPS = 10_000, 10_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """The inner join of rows with one row per group, in which no group is one task.

    ``size`` is the column of ``groups`` with the number of rows of the group, ``total`` the number of all rows. Groups of more
    than ``HOT`` rows and more than ``1 / HOT_GROUPS`` of all rows are at most ``HOT_GROUPS``; those are broadcast and
    their rows stay where they are. The other groups are hash-joined. ``rows`` and ``groups`` are read twice: give
    written (checkpointed) ones. ``size`` isn't in the result.
    """
    most = max(HOT, total // HOT_GROUPS)
    hot = F.broadcast(groups.where(F.col(size) > most).drop(size))
    cold = groups.where(F.col(size) <= most).drop(size)
    if total <= HOT:
        return rows.join(cold.hint("shuffle_hash"), keys)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(cold.hint("shuffle_hash"), keys)
    return rest.unionByName(rows.join(hot, keys))
