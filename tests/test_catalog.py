"""Edge fixtures for the catalogue (FIXTURES §3: cheapest_ties, date_range,
month, pages, search)."""
import pytest
from pyspark.sql import functions as F

from caravan.operators import catalog as C
from caravan.plans.shapes import with_group_count
from helpers import rows

AS_OF = 1000
BATCH = ("id string, trip_id string, from_date long, to_date long, price long, max_adventurers int, "
         "status boolean, batch_name string, single_room int, double_room int, triple_room int, created_at long")


def _b(spark, data):
    return spark.createDataFrame(data, BATCH)


def _trips(spark, data):
    return spark.createDataFrame(data, "id string, destination_name string, status boolean")


def test_cheapest_ties_and_bounds(spark):
    trips = _trips(spark, [("t1", "Spiti", True), ("t2", "Ladakh", True), ("t3", "Goa", True),
                           ("t4", "Off", False)])
    b = _b(spark, [
        # t1: equal price, later one listed first -> earliest from_date wins
        ("b2", "t1", 3000, 3100, 100, 10, True, "B2", 0, 0, 0, 1),
        ("b1", "t1", 2000, 2100, 100, 10, True, "B1", 0, 0, 0, 1),
        ("b0", "t1", 1000, 1100, 50, 10, True, "B0", 0, 0, 0, 1),   # from_date == as_of: excluded
        ("b9", "t1", 2500, 2600, 10, 10, False, "B9", 0, 0, 0, 1),  # inactive cheaper: excluded
        # t2: equal price and date -> lowest id
        ("c2", "t2", 5000, 5100, 70, 10, True, "C2", 0, 0, 0, 1),
        ("c1", "t2", 5000, 5200, 70, 10, True, "C1", 0, 0, 0, 1),
    ])
    out = C.trip_catalog(trips, b, AS_OF)
    got = {r["id"]: (r["lowestPriceBatch"]["id"] if r["lowestPriceBatch"] else None, r["from_month"], r["to_month"])
           for r in out.collect()}
    assert got == {"t1": ("b1", 1000, 3100), "t2": ("c1", 5000, 5200), "t3": (None, None, None)}
    assert [r["id"] for r in out.collect()] == ["t3", "t2", "t1"]  # ordered by destination


def test_date_range_public_vs_admin(spark):
    b = _b(spark, [("a", "t", 100, 900, 1, 1, False, "A", 0, 0, 0, 1),
                   ("b", "t", 300, 400, 1, 1, True, "B", 0, 0, 0, 1)])
    assert rows(C.trip_date_range(b, True)) == [("t", 300, 400)]
    assert rows(C.trip_date_range(b, False)) == [("t", 100, 900)]


def test_month_any_year_utc(spark):
    dec31 = 1704067199  # 2023-12-31T23:59:59Z
    b = _b(spark, [("x", "t", 1670000000, 0, 1, 1, True, "X", 0, 0, 0, 1),   # 2022-12-02
                   ("y", "t", dec31, 0, 1, 1, True, "Y", 0, 0, 0, 1),
                   ("z", "t", 1704067200, 0, 1, 1, True, "Z", 0, 0, 0, 1)])  # 2024-01-01
    assert rows(C.batches_in_month(b, 0, 12), "id") == [("x",), ("y",)]


def test_search_wildcards_and_case(spark):
    u = spark.createDataFrame([("1", "50% Off"), ("2", "5000 Off"), ("3", "a_b"), ("4", "axb"), ("5", "MiXed")],
                              "id string, name string")
    assert rows(C.search_users(u, "50%"), "id") == [("1",), ("2",)]
    assert rows(C.search_users(u, "50%", literal=True), "id") == [("1",)]
    assert rows(C.search_users(u, "a_b"), "id") == [("3",), ("4",)]
    assert rows(C.search_users(u, "mixed"), "id") == [("5",)]
    t = spark.createDataFrame([("1", "Spiti Valley")], "id string, destination_name string")
    assert C.search_trips(t, "").count() == 1
    assert C.search_trips(t, "VALLEY").count() == 1


def test_trip_batch_pages_and_totals(spark):
    data = [(f"b{i}", "t", 2000 + i, 0, 100 - (i % 3), 10, True, f"B{i}", 0, 0, 0, 1) for i in range(10)]
    b = _b(spark, data)
    bk = spark.createDataFrame([("k1", "b0", 3), ("k2", "b0", 2)], "id string, batch_id string, travellers int")
    whole = C.upcoming_batches(b, AS_OF).orderBy("price", "from_date", "id").collect()
    seen = []
    for p in (1, 2, 3, 4):
        pg = C.trip_batch_pages(b, bk, AS_OF, None, p).orderBy("position").collect()
        assert all(r["totalBatches"] == 10 and r["totalPages"] == 3 for r in pg)
        seen += [r["id"] for r in pg]
    assert seen == [r["id"] for r in whole]  # page union = whole ordered list
    occ = {r["id"]: r["total_bookings"] for r in C.trip_batch_pages(b, bk, AS_OF, None, 1).collect()}
    assert occ.get("b0", 5) == 5
    with pytest.raises(ValueError):
        C.trip_batch_pages(b, bk, AS_OF, None, 0)


def test_with_group_count_no_keys(spark):
    df = spark.range(7)
    assert {r["total_count"] for r in with_group_count(df, []).collect()} == {7}


def test_legacy_cheapest_keeps_ties(spark):
    df = spark.createDataFrame([("1", "A", 5), ("2", "A", 5), ("3", "A", 7), ("4", "B", 1)],
                               "id string, destination_name string, price int")
    assert rows(C.legacy_cheapest_by_destination(df), "id") == [("1",), ("2",), ("4",)]
