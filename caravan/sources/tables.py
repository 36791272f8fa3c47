"""Sources and sinks of the domain tables.

Tables are read with their fixed schema, never inferred. Text formats route
rows that do not fit the schema to a reject table instead of failing the job.
Writes never overwrite what is being read: a changed table is written as a
new snapshot directory, and appended rows go to their own load partition so
the rows "as stored" can be handed back (``INSERT ... RETURNING *``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caravan import schemas

CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet",
               options: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Read one domain table with its fixed schema. For csv / json, rows
    that do not fit the schema are returned as the second DataFrame
    (``_corrupt_record`` text); parquet has no reject table (None)."""
    st = schemas.TABLES[name]
    if fmt == "parquet":
        return spark.read.schema(st).parquet(path), None
    wide = T.StructType(st.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    rd = (spark.read.schema(wide).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT))
    for k, v in (options or {}).items():
        rd = rd.option(k, v)
    if fmt == "csv":
        df = rd.option("header", True).csv(path)
    elif fmt == "json":
        df = rd.json(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    # the corrupt-record column must be materialised before it can be filtered
    # on its own (Spark refuses queries over only that column of a raw file)
    df = df.select(*[F.col(c) for c in df.columns])
    not_null = [f.name for f in st.fields if not f.nullable]
    missing = F.lit(False)
    for c in not_null:
        missing = missing | F.col(c).isNull()
    bad = F.col(CORRUPT).isNotNull() | missing
    good = df.where(~bad).drop(CORRUPT)
    rejects = df.where(bad).select(F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*st.names))).alias(CORRUPT))
    return good, rejects


def append_rows(df: DataFrame, path: str, fmt: str = "parquet", load_id: str | None = None) -> DataFrame:
    """S3: append rows and hand back the rows as stored. Each call writes its
    own ``load_id=...`` partition (partition pruning reads only it back)."""
    load_id = load_id or uuid.uuid4().hex
    df.withColumn("load_id", F.lit(load_id)).write.mode("append").partitionBy("load_id").format(fmt).save(path)
    stored = T.StructType([*df.schema.fields, T.StructField("load_id", T.StringType())])  # the types as written
    return df.sparkSession.read.schema(stored).format(fmt).load(path).where(F.col("load_id") == load_id).drop("load_id")


def write_snapshot(df: DataFrame, root: str, snapshot: str | None = None, fmt: str = "parquet") -> str:
    """Store a changed table as a new snapshot directory (never the one being
    read) and return its path."""
    snapshot = snapshot or uuid.uuid4().hex
    out = f"{root.rstrip('/')}/snapshot={snapshot}"
    df.write.mode("errorifexists").format(fmt).save(out)
    return out


def lookup_by_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Bulk get-by-id. ``ids`` has ``request_id`` and ``id``; every request
    row comes back with the table's columns (null when missing) and
    ``found`` (false where the reference answers 404)."""
    t = table.select(*[F.col(c).alias(f"_t_{c}") for c in table.columns])
    j = ids.select("request_id", F.col(key).cast("string").alias("_rid")).join(
        t, F.col("_rid") == F.col(f"_t_{key}").cast("string"), "left")
    return j.select("request_id", F.col(f"_t_{key}").isNotNull().alias("found"),
                    *[F.col(f"_t_{c}").alias(c) for c in table.columns])


def migrate_bookings(df: DataFrame) -> DataFrame:
    """Bring old-shape bookings (``trip_id`` holding the batch) to the
    current shape (``batch_id``). Idempotent on the new shape; input holding
    both columns is refused."""
    cols = set(df.columns)
    if "trip_id" in cols and "batch_id" in cols:
        raise ValueError("bookings hold both trip_id and batch_id; refusing to guess")
    if "trip_id" in cols:
        return df.withColumnRenamed("trip_id", "batch_id")
    if "batch_id" in cols:
        return df
    raise ValueError("bookings hold neither trip_id nor batch_id")
