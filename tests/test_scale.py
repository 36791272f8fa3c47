"""Steps whose work has to be spread, or to stay off the wide rows."""
import glob

import pytest
from pyspark.sql import functions as F

from caravan.functions import columns as FN
from caravan.operators import bookings as B
from caravan.operators import changes as CH
from caravan.plans import registry, shapes
from caravan.session import checkpoint_dir


def _lineitem(spark, scratch, n=4000, files=8):
    """lineitem and orders in several files, so that several tasks read them."""
    k = F.col("id")
    (spark.range(n).repartition(files).select(
        k.alias("l_orderkey"), (k % 7 + 1).alias("l_linenumber"), (k % 90 + 1).alias("l_partkey"), (k % 20 + 1).alias("l_suppkey"),
        (k % 40 + 1).cast("double").alias("l_quantity"), (k % 100 + 1).cast("double").alias("l_extendedprice"),
        F.lit("A").alias("l_returnflag"), F.expr("timestamp_ntz '1995-01-01'").alias("l_shipdate"))
     .write.parquet(f"{scratch}/lineitem.parquet"))
    (spark.range(n).select(k.alias("o_orderkey"), (k % 50).alias("o_custkey"), F.lit(5.0).alias("o_totalprice"),
                           F.lit("O").alias("o_orderstatus"), F.expr("timestamp_ntz '1995-01-01'").alias("o_orderdate"))
     .write.parquet(f"{scratch}/orders.parquet"))
    return scratch


@pytest.mark.parametrize("name, batches", [("admission", 2), ("occupancy", 3)])
def test_stream_input_is_written_by_all_tasks(spark, scratch, name, batches):
    """No file of the stream's input holds a micro-batch: each task writes its own."""
    d, at = _lineitem(spark, scratch), f"{checkpoint_dir(spark).removeprefix('file:')}/queries"
    before = set(glob.glob(f"{at}/{name}-*"))
    out = registry.queries()[f"stream_{name}"](spark, d)
    assert out.count() == 4000
    work, = set(glob.glob(f"{at}/{name}-*")) - before
    read = spark.read.parquet(f"{work}/in")
    assert read.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 4000 / batches / 2
    done = glob.glob(f"{work}/checkpoint/commits/[0-9]*")
    assert len(done) == batches


def _plan(df):
    """The plan as run."""
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


REQUEST = ("request_id string, seq long, user_ref string, batch_ref string, name string, phone_number string, "
           "guardian_number string, email string, payment string, travellers string, room_type string, "
           "has_invoice boolean, id string")


@pytest.fixture()
def no_static_broadcast(spark):
    """As for tables beyond the broadcast limit: plans by estimated size shuffle both sides."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _requests(spark, n=60):
    """Users u0-u9 are known (u3 twice), batches b0-b5 (b2 twice); u10, u11, b6 and null refs are not."""
    rows_ = [(f"r{i}", i, None if i == 50 else f"u{i % 12}", None if i == 51 else f"b{i % 7}", "" if i == 52 else "n", "0123456789",
              None, "a b@c.de" if i == 53 else "a@b.de", "10", "2", "single", True, f"k{i % 50}") for i in range(n)]
    users = spark.createDataFrame([(f"u{i}",) for i in range(10)] + [("u3",), (None,)], "id string")
    batches = spark.createDataFrame([(f"b{i}", 50, "t1" if i % 2 else "t2") for i in range(6)] + [("b2", 50, "t2"), (None, 1, "t1")],
                                    "id string, max_adventurers int, trip_id string")
    return spark.createDataFrame(rows_, REQUEST), users, batches


def _code(r):
    if r.user_ref is None or r.batch_ref is None or not r.name:
        return "MISSING_FIELDS"
    if " " in r.email:
        return "INVALID_EMAIL"
    if int(r.user_ref[1:]) >= 10:
        return "USER_NOT_FOUND"
    return "BATCH_NOT_FOUND" if r.batch_ref == "b6" else None


def _times(r):
    """A row for each of its parents' rows, as a left join gives."""
    return (2 if r.user_ref == "u3" else 1) * (2 if r.batch_ref == "b2" else 1)


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_validation_does_not_shuffle_the_requests(no_static_broadcast, monkeypatch, limit):
    """Few odd refs: the requests stay where they are read. Many (limit 0): a shuffled join, the same rows."""
    spark = no_static_broadcast
    monkeypatch.setattr(shapes.small_side, "__defaults__", (limit,))
    monkeypatch.setattr(shapes.odd_references, "__defaults__", (limit,))
    req, users, batches = _requests(spark)
    want = sorted((r.request_id, str(_code(r))) for r in req.collect() for _ in range(_times(r)))
    out = CH.validate_bookings(req, users, batches)
    assert sorted((r.request_id, str(r.error_code)) for r in out.collect()) == want
    assert ("Exchange hashpartitioning" in _plan(out)) == (limit == 0)
    bookings = req.limit(30).selectExpr("id", "user_ref AS user_id", "batch_ref AS batch_id", "name", "phone_number",
                                        "guardian_number", "email", "10L AS payment", "2 AS travellers", "room_type", "0 AS invoice_id")
    table, got = CH.update_bookings(bookings, req, users, batches)
    known = {r.id for r in bookings.collect()}
    want = sorted((r.request_id, str(_code(r) if r.id in known else "NOT_FOUND")) for r in req.collect() for _ in range(_times(r)))
    assert sorted((r.request_id, str(r.error_code)) for r in got.collect()) == want
    assert table.count() == 30


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_lookups_of_few_keys(no_static_broadcast, monkeypatch, limit):
    """J7 and J8 by the keys that are missing or asked for, null refs and repeated parents included."""
    spark = no_static_broadcast
    monkeypatch.setattr(shapes.small_side, "__defaults__", (limit,))
    req, _, batches = _requests(spark)
    missing = B.missing_references(req, batches, "batch_ref")
    want = sorted(r.request_id for r in req.collect() if r.batch_ref in (None, "b6"))
    assert sorted(r.request_id for r in missing.collect()) == want
    trips = spark.createDataFrame([("t1",)], "id string")
    gone = CH.cascade_keys(req.withColumnRenamed("batch_ref", "batch_id"), batches, trips)
    assert sorted(r.request_id for r in gone.collect()) == sorted(r.request_id for r in req.collect() if r.batch_ref in ("b1", "b3", "b5"))
    for df in (missing, gone):
        assert ("Exchange hashpartitioning" in _plan(df)) == (limit == 0)


def test_users_of_bookings_are_measured(no_static_broadcast):
    """The bookings are shuffled for their batch only."""
    spark = no_static_broadcast
    req, users, batches = _requests(spark)
    bookings = req.selectExpr("id", "user_ref AS user_id", "batch_ref AS batch_id", "name", "phone_number", "guardian_number",
                              "email", "10 AS payment", "2 AS travellers", "room_type", "0 AS invoice_id")
    ba = batches.selectExpr("id", "trip_id", "'x' AS batch_name", "1 AS from_date", "2 AS to_date")
    out = B.admin_bookings(bookings, users.selectExpr("id", "concat('n', id) AS name", "'e' AS email"), ba)
    assert out.count() == sum(_times(r) for r in req.collect())
    assert _plan(out).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2


def test_cheap_paths_of_text_rules(spark):
    """The plain pattern and the full one, as one rule."""
    texts = {"a@b.de": True, "a@b.c.d": True, "é@ü.de": True, "a@b": False, "a@.de": False, "a@b.": False, "a@b.c@d": False,
             "a @b.de": False, "a@b.de\n": False, "": False, None: False}
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.s: r.e for r in df.select("s", FN.is_email("s").alias("e")).collect()}
    assert got == texts
    js = {" {\"id\":1}": True, "　[1]": True, "x{": False, "b1": False, None: False, "": False}
    df = spark.createDataFrame([(t,) for t in js], "s string")
    assert {r.s: r.j for r in df.select("s", FN.looks_like_json("s").alias("j")).collect()} == js
