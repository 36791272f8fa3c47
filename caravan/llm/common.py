"""Helpers shared by the training-data operators.

Working tables are Parquet files below the shared folder that the session names
in ``spark.checkpoint.dir``: a lost executor never takes a step's result with
it, and the next step reads real sizes. They are scratch data and go with that
folder.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.session import checkpoint_dir

# White space that ends a word, fixed: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back (cuts lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """At most n rows (of long texts or sets) in a batch sent to Python, for what
    is run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(df: DataFrame, keys: list, name: str) -> DataFrame:
    """Rows in global ``keys`` order, as a scratch table with ``_part`` (range
    partition) and ``_row`` (place in it, from 0).

    The order is a range partitioning plus a sort inside each partition; no
    task holds more than its range."""
    n = shuffle_partitions(df.sparkSession)
    t = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_mid", F.monotonically_increasing_id()))
    t = scratch_table(t, name)
    return (t.withColumn("_part", F.shiftright("_mid", 33).cast("int"))
            .withColumn("_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_mid"))


def starts(totals: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Exclusive prefix sums of per-partition totals: for each ``sums`` item
    ``{new: column}`` the sum of ``column`` over all earlier ``order`` values
    (inside each ``by`` group). ``totals`` has one row per range partition (and
    group), so this is a window over a few thousand rows."""
    from pyspark.sql import Window
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    for new, col in sums.items():
        totals = totals.withColumn(new, F.coalesce(F.sum(col).over(before), F.lit(0)).cast("long"))
    return totals


def placed(t: DataFrame) -> DataFrame:
    """``numbered`` rows with one ``place`` over all partitions (of the starts,
    one row per partition is broadcast)."""
    at = starts(t.groupBy("_part").agg(F.count("*").alias("_n")), "_part", {"_first": "_n"}).select("_part", "_first")
    return t.join(F.broadcast(at), "_part").withColumn("place", F.col("_first") + F.col("_row")).drop(
        "_part", "_row", "_first")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))
