"""Hot keys: one batch / code / name holding a third of all rows. Results stay
whole and exact; with broadcast disabled the big joins run as sort-merge joins
that AQE splits (skew=true)."""
import pytest
from pyspark.sql import functions as F

from caravan.operators import bookings as B
from caravan.operators import changes as CH
from caravan.operators import coupons as CP

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _tables(spark, n=30000):
    bk = spark.range(n).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"),
        (F.col("id") % 50).cast("string").alias("user_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 997).cast("string")).alias("batch_id"),
        F.lit("n").alias("name"), F.lit("0123456789").alias("phone_number"),
        F.lit(None).cast("string").alias("guardian_number"), F.lit("a@b.co").alias("email"),
        F.lit(10).cast("bigint").alias("payment"), (F.col("id") % 4 + 1).cast("int").alias("travellers"),
        F.lit("single").alias("room_type"), F.lit(0).alias("invoice_id"))
    ba = spark.range(997).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("trip_id"),
                                 F.lit(1).cast("bigint").alias("from_date"), F.lit(2).cast("bigint").alias("to_date"),
                                 F.lit(1).alias("days"), F.lit(0).alias("nights"), F.lit(5).cast("bigint").alias("price"),
                                 F.lit(0).cast("bigint").alias("tax"), F.lit(100).alias("max_adventurers"),
                                 F.lit(True).alias("status"), F.col("id").cast("string").alias("batch_name"),
                                 F.lit(0).alias("single_room"), F.lit(0).alias("double_room"),
                                 F.lit(0).alias("triple_room"), F.lit(0).cast("bigint").alias("created_at"))
    hot = spark.createDataFrame([("hot", "t", 1, 2, 1, 0, 5, 0, 100, True, "HOT", 0, 0, 0, 0)], ba.schema)
    trips = spark.createDataFrame([("t", "Spiti", "x", 1, "", "{}", "", "", True)],
                                  "id string, destination_name string, destinations string, physical_rating int, "
                                  "description string, itinerary string, inclusions string, excluions string, "
                                  "status boolean")
    return bk, ba.unionByName(hot), trips


def test_hot_batch_results_whole(skewed):
    bk, ba, trips = _tables(skewed)
    occ = {r["id"]: r["total_bookings"] for r in B.batch_occupancy(ba, bk).collect()}
    want = {r["batch_id"]: r["s"] for r in bk.groupBy("batch_id").agg(F.sum("travellers").alias("s")).collect()}
    assert occ["hot"] == want["hot"] and sum(occ.values()) == sum(want.values())
    detail = B.booking_detail_flat(bk, ba, trips)
    got = detail.collect()  # runs this DataFrame's own plan, so its final AQE plan is visible
    assert len(got) == 30000 and sum(r["batch_id"] == "hot" for r in got) == 10000
    plan = detail._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "skew=true" in plan


def test_hot_code_and_hot_name(skewed):
    import datetime as dt
    coupons = skewed.createDataFrame([("1", "HOT", 5, 0, 10**10, True), ("2", "K2", 5, 0, 10**10, True)],
                                     "id string, code string, deduction int, start_date long, end_date long, "
                                     "status boolean")
    att = skewed.range(9000).select(F.col("id").alias("attempt_id"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"),
                                    F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("code_raw"))
    s = dict((r["status"], r["attempts"]) for r in CP.coupon_status_summary(CP.coupon_status(att, coupons)).collect())
    assert s == {"VALID": 3000, "NOT_FOUND": 6000}
    req = skewed.range(6000).select(F.col("id").cast("string").alias("request_id"), F.col("id").alias("seq"),
                                    F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("name"))
    d = CH.decide(req, [], F.col("name"), None, "DUPLICATE_NAME")
    got = dict((r["error_code"], r["c"]) for r in d.groupBy("error_code").agg(F.count("*").alias("c")).collect())
    assert got == {None: 4001, "DUPLICATE_NAME": 1999}
