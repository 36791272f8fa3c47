"""A keyed table written by a stream: one folder of changes per epoch, folded
into a snapshot from time to time.

``root/changes/epoch=N`` holds the keys that epoch N changed, each with its new
values. ``root/snapshots/upto=N`` holds every key as it was after epoch N. A
reader takes the last complete snapshot and the epochs after it, so reading costs
one snapshot plus the tail, however long the stream has run. Both are written
whole under a name of their own (a snapshot counts once its ``_SUCCESS`` file is
there), so an epoch that is run again after a failure writes the same folder
again and a half-written snapshot is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedLog:
    """``key``: the key column; ``schema``: key and values; ``every``: epochs
    between two snapshots."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, every: int = 16):
        self.spark, self.root, self.schema, self.key, self.every = spark, root.rstrip("/"), schema, key, every
        self.values = [f.name for f in schema.fields if f.name != key]

    def _numbers(self, folder: str, name: str) -> list[int]:
        """The numbers of the complete ``name=N`` folders (names alone; one per epoch
        since the last snapshot, or one per snapshot)."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{name}=")]
        return sorted(int(p.getName().split("=")[1]) for p in found
                      if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def write(self, changes: DataFrame, epoch: int) -> None:
        """Stores an epoch's changes; every ``every`` epochs a snapshot follows,
        after which the epochs it holds are dropped."""
        changes.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/changes/epoch={epoch}")
        if (epoch + 1) % self.every == 0:
            self.compact(epoch)

    def compact(self, epoch: int) -> None:
        """Folds all epochs up to ``epoch`` into a snapshot. The one before it
        stays (a reader may be on it), older ones and the epochs that it holds go."""
        before = self._numbers("snapshots", "upto")
        self.read(epoch + 1).write.mode("overwrite").parquet(f"{self.root}/snapshots/upto={epoch}")
        kept = max((n for n in before if n < epoch), default=None)
        if kept is not None:
            for folder, name, numbers in (("snapshots", "upto", before), ("changes", "epoch", self._numbers("changes", "epoch"))):
                for n in numbers:
                    if n < kept or (n == kept and folder == "changes"):
                        self._delete(f"{self.root}/{folder}/{name}={n}")

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def read(self, before: int | None = None) -> DataFrame:
        """Every key with its latest values, of the epochs below ``before``."""
        snapshots = [n for n in self._numbers("snapshots", "upto") if before is None or n < before]
        last = snapshots[-1] if snapshots else -1
        tail = [n for n in self._numbers("changes", "epoch") if n > last and (before is None or n < before)]
        reader = self.spark.read.schema(self.schema)
        base = (reader.parquet(f"{self.root}/snapshots/upto={last}") if snapshots
                else self.spark.createDataFrame([], self.schema))
        if not tail:
            return base
        parts = [base.withColumn("_epoch", F.lit(-1).cast("long"))]
        paths = [f"{self.root}/changes/epoch={n}" for n in tail]
        kind = T.StructType([*self.schema.fields, T.StructField("epoch", T.LongType())])
        parts.append(self.spark.read.schema(kind).option("basePath", f"{self.root}/changes").parquet(*paths)
                     .withColumnRenamed("epoch", "_epoch"))
        every = parts[0].unionByName(parts[1])
        newest = every.groupBy(self.key).agg(F.max_by(F.struct(*self.values), "_epoch").alias("_v"))
        return newest.select(*[F.col(f"_v.{f.name}") if f.name != self.key else F.col(self.key)
                               for f in self.schema.fields])
