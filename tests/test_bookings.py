"""Edge fixtures: roster_nulls, user_trips, nested_parents, coupon_bounds."""
from caravan.operators import bookings as B
from caravan.operators import coupons as CP
from helpers import rows

BATCHES = ("id string, trip_id string, from_date long, to_date long, days int, nights int, price long, "
           "tax long, max_adventurers int, status boolean, batch_name string, single_room int, "
           "double_room int, triple_room int, created_at long")
TRIPS = ("id string, destination_name string, destinations string, physical_rating int, description string, "
         "itinerary string, inclusions string, excluions string, status boolean")
BOOKINGS = ("id string, user_id string, batch_id string, name string, phone_number string, "
            "guardian_number string, email string, payment long, travellers int, room_type string, invoice_id int")


def _fixture(spark):
    trips = spark.createDataFrame([("t1", "Spiti", "x", 1, "", "{}", "", "", True)], TRIPS)
    batches = spark.createDataFrame([
        ("b1", "t1", 10, 20, 1, 0, 5, 0, 10, True, "B1", 0, 0, 0, 1),
        ("b2", "tX", 30, 40, 1, 0, 5, 0, 10, True, "B2", 0, 0, 0, 1),   # trip missing
        ("b3", "t1", 50, 60, 1, 0, 5, 0, 10, True, "B3", 0, 0, 0, 1),   # no bookings
    ], BATCHES)
    bookings = spark.createDataFrame([
        ("k2", "u1", "b1", "n", "p", None, "e", 1, 2, "single", 0),
        ("k1", "uX", "b1", "n", "p", None, "e", 1, 3, "single", 0),     # user missing
        ("k3", "u1", "b2", "n", "p", None, "e", 1, 4, "single", 0),
        ("k4", "u1", "bX", "n", "p", None, "e", 1, 1, "single", 0),     # batch missing
        ("k5", "u1", "b1", "n", "p", None, "e", 1, 1, "single", 0),     # same trip again
    ], BOOKINGS)
    users = spark.createDataFrame([("u1", "Asha", "a@x.io"), ("u2", "Ravi", "r@x.io")],
                                  "id string, name string, email string")
    return trips, batches, bookings, users


def test_roster_nulls(spark):
    trips, batches, bookings, users = _fixture(spark)
    r = {x["id"]: x for x in B.batch_roster(batches, trips, bookings).collect()}
    assert r["b1"]["total_travellers"] == 6 and r["b1"]["booking_count"] == 3
    assert r["b2"]["destination_name"] is None and r["b3"]["total_bookings"] == 0
    e = B.batch_roster_entries(batches, bookings, users)
    nested = {x["id"]: (x["users"], x["travellers"])
              for x in B.nest_roster(B.batch_roster(batches, trips, bookings), e).collect()}
    assert nested["b1"] == ([None, "Asha", "Asha"], [3, 2, 1])
    assert nested["b3"] == ([], [])


def test_user_trips(spark):
    trips, batches, bookings, users = _fixture(spark)
    n = {x["user_id"]: x["trips"] for x in B.nest_user_trips(B.user_trips(users, bookings, batches, trips)).collect()}
    assert n == {"u1": ["Spiti"], "u2": []}


def test_nested_parents(spark):
    trips, batches, bookings, users = _fixture(spark)
    n = {x["id"]: x for x in B.booking_detail_nested(bookings, batches, trips).collect()}
    assert n["k4"]["batch"] is None and n["k4"]["batch_id"] is None
    assert n["k3"]["batch"]["trip"] is None and n["k3"]["batch"]["id"] == "b2"
    assert n["k2"]["batch"]["trip"]["destination_name"] == "Spiti"
    raw = {x["id"]: x["batch_id"] for x in B.booking_detail_nested(bookings, batches, trips, True).collect()}
    assert raw["k4"] == "bX"
    flat = {x["id"]: (x["batch_id"], x["trip_id"]) for x in B.booking_detail_flat(bookings, batches, trips).collect()}
    assert flat["k4"] == (None, None) and flat["k3"] == ("b2", None)


def test_coupon_bounds(spark):
    coupons = spark.createDataFrame([
        ("1", "SAVE", 10, 1000, 2000, True), ("0", "SAVE", 99, 0, 0, False),   # duplicate code: lowest id wins
        ("2", "OFF", 5, 0, 9999, False), ("3", "low", 5, 0, 9999, True)],
        "id string, code string, deduction int, start_date long, end_date long, status boolean")
    import datetime as dt
    def ts(ms):
        return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
    att = spark.createDataFrame([
        (1, ts(1000_000), " save "), (2, ts(2000_000), "SAVE"), (3, ts(999_999), "SAVE"),
        (4, ts(2000_001), "SAVE"), (5, ts(5), "  "), (6, ts(5), "OFF"), (7, ts(5), "nope"), (8, ts(5), "low")],
        "attempt_id long, ts timestamp, code_raw string")
    # "0" < "1": the disabled duplicate has the lowest id and wins
    got = dict(rows(CP.coupon_status(att, coupons), "attempt_id", "status"))
    assert got == {1: "DISABLED", 2: "DISABLED", 3: "DISABLED", 4: "DISABLED", 5: "REQUIRED", 6: "DISABLED",
                   7: "NOT_FOUND", 8: "NOT_FOUND"}
    c2 = coupons.where("id <> '0'")
    got = dict(rows(CP.coupon_status(att, c2), "attempt_id", "status"))
    assert got == {1: "VALID", 2: "VALID", 3: "NOT_STARTED", 4: "EXPIRED", 5: "REQUIRED", 6: "DISABLED",
                   7: "NOT_FOUND", 8: "NOT_FOUND"}
    # a lower-case stored code only matches when normalised
    got = dict(rows(CP.coupon_status(att, c2, normalize=True), "attempt_id", "status"))
    assert got[8] == "VALID"
