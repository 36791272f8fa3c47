"""Stream = batch for T1-T4: inputs split into 3 ordered files (one row
delivered twice), processed with availableNow triggers."""
import datetime as dt
import os

from pyspark.sql import functions as F

from caravan.operators.admission import admit_bookings
from caravan.operators.coupons import coupon_status
from caravan.streaming import feeds as S
from caravan.streaming.keyed_log import KeyedLog
from helpers import rows


def _write_parts(df, root, n=3, order_col=None):
    data = df.orderBy(order_col).collect() if order_col else df.collect()
    k = (len(data) + n - 1) // n
    for i in range(n):
        part = data[i * k:(i + 1) * k]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.parquet(os.path.join(root, f"f{i}"))
    return root


def test_leads_stream_dedupes(spark, scratch):
    t0 = dt.datetime(2024, 1, 1)
    leads = spark.createDataFrame(
        [(i, f"L{i}", t0 + dt.timedelta(minutes=i)) for i in range(30)] + [(5, "L5", t0 + dt.timedelta(minutes=5))]
        + [(99, "L1", t0)], "id long, name string, event_ts timestamp")
    src = _write_parts(leads, os.path.join(scratch, "in"), order_col="event_ts")
    q = S.stream_leads(spark, src + "/*", leads.schema, os.path.join(scratch, "out"), os.path.join(scratch, "ck"))
    q.awaitTermination()
    got = S.read_leads(spark, os.path.join(scratch, "out"))
    assert rows(got) == rows(S.dedupe_leads(spark.read.schema(leads.schema).parquet(src + "/*")))
    assert got.count() == 31  # same content, different id: both kept


def test_first_delivered_lead_is_stored(spark, scratch):
    """Of several rows with one id the first by micro-batch, file and row; a replay writes the same."""
    src, out, ck = (os.path.join(scratch, x) for x in ("first", "first_out", "first_ck"))
    kind = "id long, name string"
    options = {"maxFilesPerTrigger": "1"}
    for i in range(4):
        part = [(k % 5, f"{i}-{k}") for k in range(20)] + [(None, f"none-{i}"), (100 + i, f"own-{i}")]
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(os.path.join(src, f"f{i}"))
        S.stream_leads(spark, src + "/*", spark.createDataFrame([], kind).schema, out, ck,
                       source_options=options).awaitTermination()
        if i == 1:
            for name in ("1", ".1.crc"):  # as after a crash: epoch 1 runs again
                os.remove(os.path.join(ck, "commits", name))
    want = [(k, f"0-{k}") for k in range(5)] + [(None, "none-0")] + [(100 + i, f"own-{i}") for i in range(4)]
    assert rows(S.read_leads(spark, out)) == sorted(want, key=repr)
    assert spark.read.parquet(f"{out}/epoch=3").count() == 1


def test_late_leads_are_stored(spark, scratch):
    """A lead older than all that came before is stored; a replay adds nothing."""
    src, out, ck = (os.path.join(scratch, x) for x in ("late", "late_out", "late_ck"))
    for i, hour in enumerate((5, 6, 0, 0)):
        day = dt.datetime(2024, 1, 1, hour)
        lead = spark.createDataFrame([(min(i, 2), f"L{i}", day)], "id long, name string, event_ts timestamp")
        lead.coalesce(1).write.parquet(os.path.join(src, f"f{i}"))
        S.stream_leads(spark, src + "/*", lead.schema, out, ck).awaitTermination()
    assert rows(S.read_leads(spark, out), "id", "name") == [(0, "L0"), (1, "L1"), (2, "L2")]


def test_coupon_stream_equals_batch(spark, scratch):
    coupons = spark.createDataFrame([("1", "K1", 10, 0, 10**10, True), ("2", "K2", 5, 0, 1, True)],
                                    "id string, code string, deduction int, start_date long, end_date long, "
                                    "status boolean")
    att = spark.createDataFrame([(i, dt.datetime(2024, 1, 1), c) for i, c in enumerate([" k1", "k2 ", "", "x"] * 6)],
                                "attempt_id long, ts timestamp, code_raw string")
    src = _write_parts(att, os.path.join(scratch, "att"))
    stream = spark.readStream.schema(att.schema).parquet(src + "/*")
    q = (S.stream_coupon_status(stream, coupons).writeStream.format("memory").queryName("coupon_t2")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert rows(spark.table("coupon_t2")) == rows(coupon_status(att, coupons))


def test_admission_stream_equals_batch(spark, scratch):
    batches = spark.createDataFrame([("b1", 10), ("b2", 7)], "id string, max_adventurers int")
    bookings = spark.createDataFrame([("b2", 3)], "batch_id string, travellers int")
    reqs = spark.createDataFrame([(f"r{i:02d}", i, "none" if i % 7 == 6 else "b1" if i % 3 else "b2", i % 5)
                                  for i in range(24)],
                                 "request_id string, seq int, batch_id string, travellers int")
    src = _write_parts(reqs, os.path.join(scratch, "req"), order_col="seq")
    stream = (spark.readStream.schema(reqs.schema).option("maxFilesPerTrigger", 1).parquet(src + "/*"))
    out = os.path.join(scratch, "adm")
    S.stream_admission(stream, batches, bookings, out, os.path.join(scratch, "ck3")).awaitTermination()
    cols = ("request_id", "seq", "accepted", "error_code", "seats_after")
    assert rows(S.read_admission(spark, out), *cols) == rows(admit_bookings(batches, bookings, reqs), *cols)


def test_hot_batch_in_a_stream(spark, scratch):
    """A batch with most requests of each micro-batch, split over segments."""
    batches = spark.createDataFrame([("hot", 900), ("b", 50)], "id string, max_adventurers int")
    reqs = spark.createDataFrame([(f"r{i:04d}", i, "b" if i % 9 == 0 else "hot", 1 + i % 5) for i in range(900)],
                                 "request_id string, seq int, batch_id string, travellers int")
    src = _write_parts(reqs, os.path.join(scratch, "hot"), order_col="seq")
    stream = spark.readStream.schema(reqs.schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    out = os.path.join(scratch, "hot_out")
    S.stream_admission(stream, batches, None, out, os.path.join(scratch, "hot_ck"), segments=6).awaitTermination()
    assert rows(S.read_admission(spark, out)) == rows(admit_bookings(batches, None, reqs))
    assert dict(rows(S.seats_used(spark, out).read()))["hot"] == 900


def test_keyed_log_snapshots(spark, scratch):
    """Snapshot plus tail is the latest value of each key; old epochs go, a half-written snapshot is not read."""
    kind = spark.createDataFrame([], "k string, v long").schema
    root, want = os.path.join(scratch, "log"), {}
    for epoch in range(11):
        log = KeyedLog(spark, root, kind, "k", every=4)
        change = {f"k{(epoch * 3 + j) % 7}": epoch * 10 + j for j in range(3)}
        log.write(spark.createDataFrame(list(change.items()), kind), epoch)
        if epoch == 5:
            log.write(spark.createDataFrame(list(change.items()), kind), epoch)  # run again
        want |= change
        assert dict(rows(log.read())) == want
    assert sorted(os.listdir(os.path.join(root, "snapshots"))) == ["upto=3", "upto=7"]
    assert "epoch=3" not in os.listdir(os.path.join(root, "changes"))
    os.makedirs(os.path.join(root, "snapshots", "upto=10"))
    assert dict(rows(KeyedLog(spark, root, kind, "k").read())) == want
    assert dict(rows(KeyedLog(spark, root, kind, "k").read(before=0))) == {}


def test_occupancy_stream_equals_batch(spark, scratch):
    bk = spark.createDataFrame([(f"k{i}", f"b{i % 4}", i % 3 + 1) for i in range(30)],
                               "id string, batch_id string, travellers int")
    src = _write_parts(bk, os.path.join(scratch, "bk"), order_col="id")
    stream = spark.readStream.schema(bk.schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    q = S.stream_occupancy(stream, os.path.join(scratch, "occ"), os.path.join(scratch, "ck4"))
    q.awaitTermination()
    got = rows(S.read_occupancy(spark, os.path.join(scratch, "occ")))
    want = rows(bk.groupBy("batch_id").agg(F.sum("travellers").cast("bigint").alias("total_bookings")))
    assert got == want
