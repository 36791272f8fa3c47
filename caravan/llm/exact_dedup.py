"""Operator 5, exact dedup: stateful streaming deduplication.

The documents are read as a file stream. A stream's state, kept by RocksDB on
disk and never expired, holds for each text digest the stable identifier of the
row that stays, its content locator (file and row in it) and the number of rows
seen. Each micro-batch is summed per digest before it meets the state, so a text
that a third of all rows share is one state update per task. The state's changes
go to a log; the newest entry of a digest is its group.

Digests only nominate: rows are grouped by digest and full text, byte by byte,
and where a digest has several texts its rows are grouped by the text itself. A
text that many rows share leaves a task once.

Defined results: a null text equals the empty one; the row with the largest id
stays; a null id sorts below all others; of rows that repeat id and text the
one later in (file, row) order stays, so each group keeps exactly one row; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.llm.common import scratch_path, scratch_table, text_or_empty

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # many small stores: without this each reserves 4 MB of disk ahead
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _keyed(df: DataFrame, id_col: str, text: Column, digest) -> DataFrame:
    return df.select(digest(text).alias("digest"), F.col(id_col).alias("id"), text.alias("text"),
                     F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def stream_groups(spark: SparkSession, path: str, id_col: str, text_col: str, digest=sha256,
                  work: str | None = None, source_options: dict | None = None) -> DataFrame:
    """Runs the stream over all files now at ``path`` and returns its state:
    (digest, keep(id, file, row), n). With the same ``work`` folder a later call
    goes on where the last one ended and reads only new files."""
    work = work or scratch_path(spark, "dedup-stream")
    schema = spark.read.parquet(path).schema
    # a file stream takes a plain path as a directory; as a pattern it may also be one file
    pattern = f"{path[:-1]}[{path[-1]}]"
    src = spark.readStream.schema(schema).options(**(source_options or {"maxBytesPerTrigger": str(256 << 30)})).parquet(pattern)
    rows = _keyed(src, id_col, text_or_empty(text_col), digest)
    state = rows.groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    log = f"{work}/changes"

    def save(changes: DataFrame, batch: int) -> None:
        # a repeated micro-batch writes the same folder again
        changes.write.mode("overwrite").parquet(f"{log}/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        (state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{work}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    kind = f"digest string, keep struct<id: {kinds[id_col]}, file: string, row: bigint>, n bigint"
    # a table without files makes no micro-batch: the log then holds this empty one alone
    spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{log}/batch=-1")
    changes = spark.read.schema(kind + ", batch bigint").parquet(log)
    newest = changes.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("s"))
    return scratch_table(newest.select("digest", "s.keep", "s.n"), "dedup-state")


def differing(rows: DataFrame) -> DataFrame:
    """The digests that stand for several texts. Texts move here alone, each
    once a task; what is counted per digest are texts, not rows."""
    texts = rows.groupBy("digest", "text").agg(F.count("*").alias("n"))
    many = texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
    return scratch_table(many.select("digest"), "dedup-collided")


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256,
                work: str | None = None, source_options: dict | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest."""
    groups = stream_groups(spark, path, id_col, text_col, digest, work, source_options)
    rows = _keyed(spark.read.parquet(path), id_col, text_or_empty(text_col), digest)
    collided = differing(rows)

    def out(df: DataFrame) -> DataFrame:
        kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
        return df.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"),
                         F.col("n").alias("group_size"), kept.alias("kept"), "digest")

    sound = rows.drop("text").join(groups.join(collided, "digest", "left_anti"), "digest")
    mixed = rows.join(collided, "digest", "left_semi")
    parted = mixed.groupBy("digest", "text").agg(
        F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    return out(sound).unionByName(out(mixed.join(parted, ["digest", "text"])))
