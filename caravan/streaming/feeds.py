"""Structured Streaming forms of the reference's write paths.

The reference has no streams; three of its write paths are event feeds at
heart (enquiries, coupon attempts, booking requests). Each stream form gives
the same result as its batch operator on the same rows:

* T1 ``stream_leads``: append enquiries; a lead delivered twice (same id given
  by the feed) is stored once, and none is too late to be stored. The ids are
  keyed state of the stream, kept on disk by RocksDB.
* T2 ``stream_coupon_status``: J9 as a stateless stream-static join.
* T3 ``stream_admission``: M6 per micro-batch on the seats used so far, one
  update a batch and epoch. Arrival order is the order within and across
  micro-batches.
* T4 ``stream_occupancy``: travellers per batch kept up to date.

T3 and T4 keep their result per batch in a ``KeyedLog``: epochs of changes, folded
into a snapshot every few epochs.

Checkpoint locations are the caller's; on a cluster they belong in the shared
folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from caravan.operators.admission import admit_bookings
from caravan.operators.coupons import coupon_status
from caravan.streaming.keyed_log import KeyedLog

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: without this each reserves 4 MB of disk ahead
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _started(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


# ------------------------------------------------------------------ T1
def dedupe_leads(leads: DataFrame, key: str = "id") -> DataFrame:
    """Batch form of T1: one row per lead id, the first by file and row (``leads``
    read from files)."""
    order = F.struct(F.col("_metadata.file_modification_time").alias("m"), F.col("_metadata.file_path").alias("p"),
                     F.col("_metadata.row_index").alias("r"))
    return (leads.select(F.struct(*leads.columns).alias("row"), F.col(key).alias("_k"), order.alias("o"))
            .groupBy("_k").agg(F.min_by("row", "o").alias("row")).select("row.*"))


def stream_leads(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, key: str = "id",
                 available_now: bool = True, source_options: dict | None = None) -> StreamingQuery:
    """Parquet files of enquiries under ``source`` -> leads at ``sink``.

    The state of the stream holds, per lead id, when it was first delivered: the
    micro-batch (its timestamp, which a replay reads from the checkpoint again),
    the file (by modification time, then path) and the row in it. The first row in this order is
    stored, under ``sink/epoch=N``; an id whose first and last delivery are not
    of one micro-batch is an old one. So no micro-batch reads what is stored, a
    replayed epoch writes the same rows again, and no lead is too late. Rows are
    reduced per id before they are shuffled, so an id that a third of a
    micro-batch repeats is one row a task. Enquiries with equal content but
    different ids both stay; those without an id count as one id."""
    rows = spark.readStream.schema(schema).options(**(source_options or {})).parquet(source)
    names = [f.name for f in schema.fields]
    first = F.struct(F.current_timestamp().alias("batch"), F.col("_metadata.file_modification_time").alias("modified"),
                     F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    state = (rows.select(F.col(key).alias("_key"), first.alias("first"), F.struct(*names).alias("lead"))
             .groupBy("_key").agg(F.min(F.struct("first", "lead")).alias("first"), F.max("first.batch").alias("last")))

    def store(df: DataFrame, epoch: int) -> None:
        new = df.where(F.col("first.first.batch") == F.col("last")).select("first.lead.*")
        new.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/epoch={epoch}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():  # taken over by the query when it starts
        spark.conf.set(k, v)
    try:
        return _started(state.writeStream.outputMode("update").foreachBatch(store)
                        .option("checkpointLocation", checkpoint), available_now)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_leads(spark: SparkSession, sink: str) -> DataFrame:
    """The leads stored by T1."""
    return spark.read.parquet(sink).drop("epoch")


# ------------------------------------------------------------------ T2
def stream_coupon_status(attempts: DataFrame, coupons: DataFrame) -> DataFrame:
    """J9 over a stream of attempts and a static coupon table (stateless
    stream-static left join; the coupon side is reduced to one row per code)."""
    return coupon_status(attempts, coupons)


# ------------------------------------------------------------------ T3
_SEATS = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("travellers", T.LongType())])


def seats_used(spark: SparkSession, sink: str) -> KeyedLog:
    """The state of T3: seats used per batch."""
    return KeyedLog(spark, f"{sink.rstrip('/')}/seats", _SEATS, "batch_id")


def stream_admission(requests: DataFrame, batches: DataFrame, bookings: DataFrame | None, sink: str, checkpoint: str,
                     available_now: bool = True, segments: int | None = None) -> StreamingQuery:
    """Streaming M6. ``requests`` is a stream of (request_id, seq, batch_id,
    travellers); batches / bookings are static. Every request comes out, with
    M6's columns and error codes, under ``sink/decisions/epoch=N``; ``seq`` is compared in
    the type given.

    A micro-batch's requests go through M6 as they are: a batch with a third of them is
    spread over tasks, its segments composed as step functions. It starts
    from the seats used after the epochs before (of a batch not seen before: those booked),
    and its last decision per batch is the one state update of the epoch."""
    spark = requests.sparkSession
    root = sink.rstrip("/")

    def decide(df: DataFrame, epoch: int) -> None:
        s = df.sparkSession
        log = seats_used(s, root)
        known = log.read(before=epoch)
        if bookings is not None:
            booked = bookings.select(F.col("batch_id").cast("string").alias("batch_id"),
                                     F.col("travellers").cast("long").alias("travellers"))
            asked = df.select(F.col("batch_id").cast("string").alias("batch_id")).distinct()
            fresh = booked.join(asked, "batch_id", "left_semi").join(known.select("batch_id"), "batch_id", "left_anti")
            known = known.unionByName(fresh)
        path = f"{root}/decisions/epoch={epoch}"
        admit_bookings(batches, known, df, segments).write.mode("overwrite").parquet(path)
        # seats only grow, so a batch's most seats are those after its last decision
        after = (s.read.parquet(path).where("seats_after is not null")
                 .groupBy("batch_id").agg(F.max("seats_after").alias("travellers")))
        log.write(after, epoch)

    return _started(requests.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint), available_now)


def read_admission(spark: SparkSession, sink: str) -> DataFrame:
    """The decisions stored by T3."""
    return spark.read.parquet(f"{sink.rstrip('/')}/decisions").drop("epoch")


# ------------------------------------------------------------------ T4
_OCCUPANCY = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("total_bookings", T.LongType())])


def occupancy_updates(bookings: DataFrame) -> DataFrame:
    """T4 aggregate: travellers per batch (a streaming aggregate in update mode)."""
    return (bookings.groupBy(F.col("batch_id").cast("string").alias("batch_id"))
            .agg(F.sum("travellers").cast("bigint").alias("total_bookings")))


def _occupancy(spark: SparkSession, sink: str, every: int) -> KeyedLog:
    return KeyedLog(spark, sink, _OCCUPANCY, "batch_id", every)


def stream_occupancy(bookings: DataFrame, sink: str, checkpoint: str, available_now: bool = True,
                     snapshot_every: int = 16) -> StreamingQuery:
    """T4: keep travellers per batch up to date. Each micro-batch's updated
    rows are an epoch of a keyed log (written under a name of its own, so a
    replayed epoch is idempotent), folded into a snapshot every
    ``snapshot_every`` epochs."""
    def upsert(df: DataFrame, epoch: int) -> None:
        _occupancy(df.sparkSession, sink, snapshot_every).write(df, epoch)

    return _started(occupancy_updates(bookings).writeStream.outputMode("update")
                    .option("checkpointLocation", checkpoint).foreachBatch(upsert), available_now)


def read_occupancy(spark: SparkSession, sink: str) -> DataFrame:
    """Latest travellers per batch: one snapshot plus the epochs since it."""
    return _occupancy(spark, sink, 16).read()
