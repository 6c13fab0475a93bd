"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir`` of the session, else (tests, local mode) an own one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if given:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(given)
        return given
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        own = os.path.join(tempfile.gettempdir(), "packetloom-checkpoints")
        sc.setCheckpointDir(own)
        return own
    return current.get()


_cut_folders: set[str] = set()


def _delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of tables of cut lineage; the session may have ended before."""
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # noqa: BLE001  nothing is left to do at the end of the program
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared checkpoint folder and read it back; survives the loss of executors.

    The table is columnar and its size known, so later plans read only the columns they need and choose joins by
    size. All tables of an application are deleted when the program ends.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/cut-{spark.sparkContext.applicationId}"
    if folder not in _cut_folders:
        _cut_folders.add(folder)
        atexit.register(_delete, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, for clusters that don't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="packetloom-"), "packetloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if not f.endswith(".pyc"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("packetloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(out)


def spread(df: DataFrame, *keys: str | Column, at_least: int = 0) -> DataFrame:
    """Hash-partition by ``keys`` into the session's number of shuffle partitions (AQE may not merge a
    repartition with an explicit number, so Python workers always get an even share)."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), at_least)
    return df.repartition(n, *keys)


def ranked(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with the row's rank from 0 within its group as column ``out``; ``group`` and ``order`` tell rows apart.

    Rows are range-sorted by group and order and numbered in their partitions; the partitions' counts are stitched by
    prefix sums, so a group may hold most of the rows. Group columns must not be null.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    placed = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
    return placed.join(parts.withColumn("_before", before).drop("_n"), [*group, "_part"]).withColumn(out, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Sums of ``value`` over the rows before a row in its group, as column ``out``; for groups of any size, see ``ranked``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    placed = cut(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    parts = parts.select(*group, "_part", (F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_sum")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return placed.withColumn("_inside", inside).join(parts, [*group, "_part"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


BLOCK = 4096  #: places that one window sorts


def filled(df: DataFrame, column: str, out: str, back: bool = False, group: str = "session_id", pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """``df`` with the last value of ``column`` that is not null at or before a row's place (behind it, with ``back``).

    Windows run over blocks of places and are stitched by the blocks' last values, so a group may hold most rows.
    """
    sign = -1 if back else 1
    d = df.withColumn("_block", F.floor(F.col(pos) / block))
    inside = Window.partitionBy(group, "_block").orderBy(sign * F.col(pos)).rowsBetween(Window.unboundedPreceding, 0)
    blocks = d.groupBy(group, "_block").agg(F.max_by(column, F.when(F.col(column).isNotNull(), sign * F.col(pos))).alias("_last"))
    before = Window.partitionBy(group).orderBy(sign * F.col("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(group, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    d = d.withColumn("_own", F.last(column, ignorenulls=True).over(inside)).join(carried, [group, "_block"])
    return d.withColumn(out, F.coalesce("_own", "_carried")).drop("_block", "_own", "_carried")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key. Repeats equal their first row but for the arrival column, so any of them serves."""
    return df.drop("received_at").dropDuplicates(keys)


def round6(col: Column) -> Column:
    return F.round(col.cast("double"), 6)
