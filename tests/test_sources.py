"""Edge fixtures: old_bookings, constraints, typed reads with rejects,
snapshots, lookups, paging."""
import os

import pytest

from caravan.operators import paging as PG
from caravan.sources import tables as ST
from caravan.sources.constraints import constraint_report
from helpers import rows


def test_migrate_bookings_shapes(spark):
    old = spark.createDataFrame([("k", "b")], "id string, trip_id string")
    assert ST.migrate_bookings(old).columns == ["id", "batch_id"]
    new = spark.createDataFrame([("k", "b")], "id string, batch_id string")
    assert ST.migrate_bookings(new).columns == ["id", "batch_id"]
    both = spark.createDataFrame([("k", "b", "c")], "id string, trip_id string, batch_id string")
    with pytest.raises(ValueError):
        ST.migrate_bookings(both)


def test_constraint_report(spark):
    users = spark.createDataFrame([("u1", "A"), ("u1", "B"), ("u2", None)], "id string, name string")
    bookings = spark.createDataFrame([("k1", "u1"), ("k2", "uX")], "id string, user_id string")
    rep = {(r["table"], r["constraint"]): r["violations"]
           for r in constraint_report({"users": users, "bookings": bookings}).collect()}
    assert rep[("users", "name NOT NULL")] == 1
    assert rep[("users", "id PRIMARY KEY")] == 1
    assert rep[("bookings", "user_id REFERENCES users(id)")] == 1


def test_read_table_rejects(spark, scratch):
    p = os.path.join(scratch, "coupons.csv")
    with open(p, "w") as f:
        f.write("id,code,deduction,start_date,end_date,status\n")
        f.write("1,SAVE,10.5,1,2,true\n2,BAD,abc,1,2,true\n3,,5,1,2,true\n")
    good, bad = ST.read_table(spark, "coupons", p, "csv")
    assert rows(good, "id") == [("1",)]
    assert bad.count() == 2


def test_append_and_snapshot(spark, scratch):
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    back = ST.append_rows(df, os.path.join(scratch, "t"))
    back2 = ST.append_rows(df.selectExpr("'b' AS id", "2 AS n"), os.path.join(scratch, "t"))
    assert rows(back) == [("a", 1)] and rows(back2) == [("b", 2)]
    out = ST.write_snapshot(df, os.path.join(scratch, "snap"), "v1")
    assert out.endswith("snapshot=v1") and spark.read.parquet(out).count() == 1


def test_lookup_found_flag(spark):
    t = spark.createDataFrame([("b1", 5)], "id string, n int")
    ids = spark.createDataFrame([("r1", "b1"), ("r2", "b9")], "request_id string, id string")
    assert rows(ST.lookup_by_ids(t, ids), "request_id", "found", "n") == [("r1", True, 5), ("r2", False, None)]


def test_paging_rules(spark):
    df = spark.createDataFrame([(f"t{i:02d}", f"D{i % 5}") for i in range(45)], "id string, destination_name string")
    order = PG.sort_keys("trips")
    seen = []
    for p in range(1, 4):
        r, meta = PG.page(df, order, str(p), None)
        m = meta.collect()[0]
        assert (m["total"], m["limit"], m["totalPages"]) == (45, 20, 3)
        seen += [x["id"] for x in r.collect()]
    assert seen == [x["id"] for x in df.orderBy(*order).collect()]  # page union = whole list
    for bad in ("0", "abc", None):
        assert PG.js_int_or(bad, 1) == 1
    assert PG.js_int_or("2x", 1) == 2
    _, meta = PG.page(df, order, "9", "0")
    assert meta.collect()[0]["count"] == 0
    with pytest.raises(ValueError):
        PG.page(df, order, "-1", None)


def test_banner_listing_newest_first(spark):
    banners = spark.createDataFrame([("b1", "Summer Sale", "d", True, 10), ("b2", "Winter", "d", False, 30),
                                     ("b0", "Tie", "d", True, 30)],
                                    "id string, banner_name string, description string, status boolean, "
                                    "created_at long")
    assert [r["id"] for r in PG.list_banners(banners).collect()] == ["b0", "b2", "b1"]
    leads = spark.createDataFrame([("l1", None), ("l2", 5)], "id string, created_at long")
    full = leads.selectExpr("id", "'t' AS type", "'n' AS name", "'x' AS location", "1 AS travellers", "1 AS days",
                            "'e' AS email", "'p' AS phone", "'m' AS message", "1 AS budget",
                            "CAST(NULL AS STRING) AS date", "created_at")
    assert [r["id"] for r in PG.list_leads(full).collect()] == ["l1", "l2"]  # null created_at first
