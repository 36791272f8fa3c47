"""Streams (T1-T4) and table files (S1, S3) as registered queries: the adapter's
rows are written as files under the shared folder, the library's stream or
reader runs over them to their end, and the stored result is returned."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.plans import queries_changes as QC
from caravan.plans.registry import QUERIES, register
from caravan.session import checkpoint_dir
from caravan.sources import media as MD
from caravan.sources import tables as ST
from caravan.streaming import feeds as S
from caravan.testdata import Tables, duck_with

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _work(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/queries/{name}-{uuid.uuid4().hex}"


def _files(df: DataFrame, work: str) -> DataFrame:
    """The rows as Parquet files, and a stream over them."""
    df.write.parquet(f"{work}/in")
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{work}/in")


def _stored(out: DataFrame, work: str) -> DataFrame:
    """Runs a stream to the end of its files; what it stored."""
    (out.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return out.sparkSession.read.schema(out.schema).parquet(f"{work}/out")


@register("stream_leads", duck_with("leads") + "SELECT * FROM leads")
def q_stream_leads(spark, d):
    """Every lead, delivered twice, is stored once."""
    leads, work = Tables(spark, d).leads, _work(spark, "leads")
    for _ in range(2):
        leads.write.mode("append").parquet(f"{work}/in")
        S.stream_leads(spark, f"{work}/in", leads.schema, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return S.read_leads(spark, f"{work}/out")


@register("stream_coupon_status", QUERIES["coupon_status"][1])
def q_stream_coupons(spark, d):
    """J9 over a stream of attempts."""
    t, work = Tables(spark, d), _work(spark, "coupons")
    return _stored(S.stream_coupon_status(_files(t.coupon_attempts, work), t.coupons), work)


@register("stream_admission", QUERIES["admit_bookings_numeric_seq"][1])
def q_stream_admission(spark, d):
    """M6 over a stream of requests in two micro-batches, batches a third full."""
    t, work = Tables(spark, d), _work(spark, "admission")
    taken = t.bookings.groupBy("batch_id").agg((F.sum("travellers") / 3).cast("bigint").alias("travellers"))
    req = QC.numeric_requests(t).select("request_id", "seq", F.col("batch_ref").alias("batch_id"),
                                        F.col("travellers").cast("int").alias("travellers"))
    # whole batches in each micro-batch: the order within a batch is that of seq. A
    # micro-batch is as many files as there are tasks, so none holds half of the rows
    for half in range(2):
        req.where(F.pmod(F.xxhash64("batch_id"), F.lit(2)) == half).write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(req.schema).parquet(f"{work}/in")
        S.stream_admission(stream, t.batches, taken, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return S.read_admission(spark, f"{work}/out")


@register("stream_occupancy", duck_with("bookings") + """
SELECT CAST(batch_id AS VARCHAR) AS batch_id, CAST(sum(travellers) AS BIGINT) AS total_bookings
FROM bookings GROUP BY batch_id""")
def q_stream_occupancy(spark, d):
    """T4: travellers per batch kept up to date, the bookings in several files."""
    t, work = Tables(spark, d), _work(spark, "occupancy")
    seats = t.bookings.select("id", "batch_id", "travellers")
    for third in range(3):  # a micro-batch each, written by as many tasks as read the bookings
        (seats.where(F.pmod(F.xxhash64("id"), F.lit(3)) == third).select("batch_id", "travellers")
         .write.mode("append").parquet(f"{work}/in"))
        stream = spark.readStream.schema("batch_id bigint, travellers int").parquet(f"{work}/in")
        S.stream_occupancy(stream, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return S.read_occupancy(spark, f"{work}/out")


def _store(root: str):
    """Stores an object of ``size`` bytes under each key (on the executors)."""
    def run(frames):
        from pyarrow import fs
        system, base = fs.FileSystem.from_uri(root)
        for pdf in frames:
            for key, size in zip(pdf["key"], pdf["size"], strict=True):
                path = f"{base}/{key}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(b"x" * int(size))
            yield pdf
    return run


@register("media_manifest", """
SELECT concat('trips/', lower(c_mktsegment), '/customer-', c_custkey, '_', c_nationkey, '.jpg') AS key,
       CAST(c_custkey % 13 AS BIGINT) AS size FROM customer
UNION ALL SELECT concat('itineraries/supplier-', s_suppkey, '_itinerary.pdf'), CAST(s_suppkey % 7 AS BIGINT) FROM supplier
UNION ALL SELECT concat('N', n_nationkey, '.pdf'), CAST(1 AS BIGINT) FROM nation""")
def q_media_manifest(spark, d):
    """The listing of an object tree that holds an object per customer,
    supplier and nation (prefixes two deep, one deep and none)."""
    work = _work(spark, "media")
    root = work if "://" in work else f"file://{work.removeprefix('file:')}"
    c, s, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "supplier", "nation"))
    text = lambda col: F.col(col).cast("string")
    objects = c.select(F.concat(F.lit("trips/"), F.lower("c_mktsegment"), F.lit("/customer-"), text("c_custkey"), F.lit("_"),
                                text("c_nationkey"), F.lit(".jpg")).alias("key"), (F.col("c_custkey") % 13).cast("long").alias("size"))
    objects = objects.unionByName(s.select(F.concat(F.lit("itineraries/supplier-"), text("s_suppkey"), F.lit("_itinerary.pdf"))
                                           .alias("key"), (F.col("s_suppkey") % 7).cast("long").alias("size")))
    objects = objects.unionByName(n.select(F.concat(F.lit("N"), text("n_nationkey"), F.lit(".pdf")).alias("key"),
                                           F.lit(1).cast("long").alias("size")))
    objects.mapInPandas(_store(root), "key string, size long").write.format("noop").mode("overwrite").save()
    return MD.media_manifest(spark, root).select("key", "size")


@register("read_coupons_json", duck_with("coupons") + """
SELECT CAST(id AS VARCHAR) AS id, code, false AS rejected FROM coupons WHERE id % 10 <> 0
UNION ALL SELECT CAST(id AS VARCHAR), NULL, true FROM coupons WHERE id % 10 = 0""")
def q_read_coupons(spark, d):
    """Coupons from JSON lines with the fixed schema; a text where the start
    date should be goes to the rejects."""
    t, work = Tables(spark, d), _work(spark, "coupons-json")
    odd = F.when(F.col("id") % 10 == 0, "soon").otherwise(F.col("start_date").cast("string"))
    rows = t.coupons.select("id", F.to_json(F.struct(F.col("id").cast("string").alias("id"), "code", "deduction",
                                                     odd.alias("start_date"), "end_date", "status")).alias("value"))
    # numbers are written bare, the odd text quoted
    rows.select(F.regexp_replace("value", '"start_date":"([0-9]+)"', '"start_date":$1')).write.text(f"{work}/in")
    good, bad = ST.read_table(spark, "coupons", f"{work}/in", "json")
    return (good.select(F.col("id").cast("string").alias("id"), "code", F.lit(False).alias("rejected"))
            .unionByName(bad.select(F.get_json_object(ST.CORRUPT, "$.id").alias("id"),
                                    F.lit(None).cast("string").alias("code"), F.lit(True).alias("rejected"))))


@register("append_bookings", duck_with("bookings") + "SELECT * FROM bookings WHERE room_type = 'single'")
def q_append(spark, d):
    """S3: rows appended to a table that has others, as stored."""
    t, work = Tables(spark, d), _work(spark, "append")
    ST.append_rows(t.bookings.where("room_type <> 'single'"), f"{work}/table")
    return ST.append_rows(t.bookings.where("room_type = 'single'"), f"{work}/table")
