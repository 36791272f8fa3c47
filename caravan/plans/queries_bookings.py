"""Booking-side queries (J1-J3, J7, J9, A2-A7, A9) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravan.operators import bookings as B
from caravan.operators import coupons as CP
from caravan.plans.registry import register
from caravan.testdata import Tables, duck_with

_BK = ", ".join(f"b.{c}" for c in B.BOOKING_COLS if c != "batch_id")
_BA = ", ".join(f"ba.{c}" for c in B.DETAIL_BATCH_COLS if c != "trip_id")
_TR = ", ".join(f"t.{c}" for c in B.DETAIL_TRIP_COLS)
_JOIN3 = "FROM bookings b LEFT JOIN batches ba ON b.batch_id = ba.id LEFT JOIN trips t ON ba.trip_id = t.id"


@register("booking_detail_flat", duck_with("bookings", "batches", "trips") + f"""
SELECT {_BK}, ba.id AS batch_id, {_BA}, ba.status AS batch_status, t.id AS trip_id, {_TR},
       t.status AS trip_status {_JOIN3}""")
def q_booking_detail_flat(spark, d):
    t = Tables(spark, d)
    return B.booking_detail_flat(t.bookings, t.batches, t.trips)


_NEST_BA = ", ".join(f"ba.{c} AS batch__{c}" for c in B.DETAIL_BATCH_COLS if c != "trip_id")
_NEST_TR = ", ".join(f"t.{c} AS batch__trip__{c}" for c in B.DETAIL_TRIP_COLS)


@register("booking_detail_nested", duck_with("bookings", "batches", "trips") + f"""
SELECT {_BK}, b.batch_id, ba.id IS NOT NULL AS has_batch, ba.id AS batch__id,
       t.id AS batch__trip_id, {_NEST_BA}, ba.status AS batch__status,
       t.id IS NOT NULL AS has_trip, t.id AS batch__trip__id, {_NEST_TR}, t.status AS batch__trip__status
{_JOIN3}""")
def q_booking_detail_nested(spark, d):
    """J2 single-read form (raw batch_id kept), nested structs rendered flat."""
    t = Tables(spark, d)
    n = B.booking_detail_nested(t.bookings, t.batches, t.trips, keep_raw_batch_id=True)
    ba_fields = ["id", "trip_id"] + [c for c in B.DETAIL_BATCH_COLS if c != "trip_id"] + ["status"]
    tr_fields = ["id"] + B.DETAIL_TRIP_COLS + ["status"]
    return n.select(*B.BOOKING_COLS, F.col("batch").isNotNull().alias("has_batch"),
                    *[F.col(f"batch.{c}").alias(f"batch__{c}") for c in ba_fields],
                    F.col("batch.trip").isNotNull().alias("has_trip"),
                    *[F.col(f"batch.trip.{c}").alias(f"batch__trip__{c}") for c in tr_fields])


@register("booking_detail_list", duck_with("bookings", "batches", "trips") + f"""
SELECT {_BK}, ba.id AS batch_id, ba.id AS batch__id, t.id AS batch__trip__id,
       t.destination_name AS batch__trip__destination_name {_JOIN3}""")
def q_booking_detail_list(spark, d):
    """J2 list form: batch_id is the joined batch's."""
    t = Tables(spark, d)
    n = B.booking_detail_nested(t.bookings, t.batches, t.trips)
    return n.select(*B.BOOKING_COLS, F.col("batch.id").alias("batch__id"), F.col("batch.trip.id").alias("batch__trip__id"),
                    F.col("batch.trip.destination_name").alias("batch__trip__destination_name"))


_J3_COLS = ", ".join(f"b.{c}" for c in B.BOOKING_COLS)


@register("admin_bookings", duck_with("bookings", "users", "batches", "trips") + f"""
SELECT {_J3_COLS}, u.name AS user_name, u.email AS user_email, ba.batch_name, ba.from_date,
       ba.to_date, t.destination_name
FROM bookings b LEFT JOIN users u ON b.user_id = u.id LEFT JOIN batches ba ON b.batch_id = ba.id
LEFT JOIN trips t ON ba.trip_id = t.id""")
def q_admin_bookings(spark, d):
    t = Tables(spark, d)
    return B.admin_bookings(t.bookings, t.users, t.batches, t.trips)


@register("admin_booking_single_form", duck_with("bookings", "users", "batches") + f"""
SELECT {_J3_COLS}, u.name AS user_name, u.email AS user_email, ba.batch_name, ba.from_date, ba.to_date
FROM bookings b LEFT JOIN users u ON b.user_id = u.id LEFT JOIN batches ba ON b.batch_id = ba.id""")
def q_admin_booking_single(spark, d):
    """J3 single-booking form (no trip join), for all bookings."""
    t = Tables(spark, d)
    return B.admin_bookings(t.bookings, t.users, t.batches, None)


@register("missing_user_references", duck_with("booking_requests", "users") + """
SELECT * FROM booking_requests r
WHERE NOT EXISTS (SELECT 1 FROM users u WHERE CAST(u.id AS VARCHAR) = r.user_ref)""")
def q_missing_users(spark, d):
    t = Tables(spark, d)
    return B.missing_references(t.booking_requests, t.users, "user_ref")


@register("missing_batch_references", duck_with("booking_requests", "batches") + """
SELECT * FROM booking_requests r
WHERE NOT EXISTS (SELECT 1 FROM batches b WHERE CAST(b.id AS VARCHAR) = r.batch_ref)""")
def q_missing_batches(spark, d):
    t = Tables(spark, d)
    return B.missing_references(t.booking_requests, t.batches, "batch_ref")


_OCC = "LEFT JOIN (SELECT batch_id, sum(travellers) AS s FROM bookings GROUP BY batch_id) o ON o.batch_id = ba.id"


@register("batch_occupancy", duck_with("batches", "bookings") + f"""
SELECT ba.*, CAST(COALESCE(o.s, 0) AS BIGINT) AS total_bookings FROM batches ba {_OCC}""")
def q_occupancy(spark, d):
    t = Tables(spark, d)
    return B.batch_occupancy(t.batches, t.bookings)


@register("batch_capacity", duck_with("batches", "bookings") + f"""
SELECT ba.id, ba.max_adventurers, CAST(COALESCE(o.s, 0) AS BIGINT) AS current_bookings,
       ba.max_adventurers - CAST(COALESCE(o.s, 0) AS BIGINT) AS remaining FROM batches ba {_OCC}""")
def q_capacity(spark, d):
    t = Tables(spark, d)
    return B.batch_capacity(t.batches, t.bookings)


_RB = ", ".join(f"ba.{c}" for c in B.ROSTER_BATCH_COLS[1:])


@register("batch_roster", duck_with("batches", "trips", "bookings") + f"""
SELECT ba.id, tr.destination_name, {_RB}, count(b.id) AS booking_count,
       CAST(COALESCE(sum(b.travellers), 0) AS BIGINT) AS total_bookings,
       CAST(COALESCE(sum(b.travellers), 0) AS BIGINT) AS total_travellers
FROM batches ba LEFT JOIN trips tr ON ba.trip_id = tr.id LEFT JOIN bookings b ON ba.id = b.batch_id
GROUP BY ALL""")
def q_roster(spark, d):
    t = Tables(spark, d)
    return B.batch_roster(t.batches, t.trips, t.bookings)


@register("batch_roster_entries", duck_with("batches", "bookings", "users") + """
SELECT b.batch_id, b.id AS booking_id, u.name AS user_name, b.travellers
FROM bookings b JOIN batches ba ON b.batch_id = ba.id LEFT JOIN users u ON b.user_id = u.id""")
def q_roster_entries(spark, d):
    t = Tables(spark, d)
    return B.batch_roster_entries(t.batches, t.bookings, t.users)


@register("user_trips", duck_with("users", "bookings", "batches", "trips") + """
, pairs AS (SELECT DISTINCT b.user_id AS uid, t.destination_name FROM bookings b
    JOIN batches ba ON b.batch_id = ba.id JOIN trips t ON ba.trip_id = t.id
    WHERE t.destination_name IS NOT NULL)
SELECT u.id AS user_id, u.name, p.destination_name FROM users u LEFT JOIN pairs p ON u.id = p.uid""")
def q_user_trips(spark, d):
    t = Tables(spark, d)
    return B.user_trips(t.users, t.bookings, t.batches, t.trips)


@register("trips_with_batches", duck_with("trips", "batches", "bookings") + """
, occ AS (SELECT batch_id, sum(travellers) AS s FROM bookings GROUP BY batch_id),
rng AS (SELECT trip_id, min(from_date) AS from_month, max(to_date) AS to_month FROM batches GROUP BY trip_id)
SELECT t.*, r.from_month, r.to_month, ba.id AS batch_id, ba.from_date AS batch_from_date,
       ba.to_date AS batch_to_date, ba.batch_name,
       CASE WHEN ba.id IS NOT NULL THEN CAST(COALESCE(o.s, 0) AS BIGINT) END AS booking_count
FROM trips t LEFT JOIN rng r ON r.trip_id = t.id LEFT JOIN batches ba ON ba.trip_id = t.id
LEFT JOIN occ o ON o.batch_id = ba.id""")
def q_trips_with_batches(spark, d):
    t = Tables(spark, d)
    return B.trips_with_batches(t.trips, t.batches, t.bookings)


@register("bookings_total", duck_with("bookings") + "SELECT count(*) AS total FROM bookings")
def q_bookings_total(spark, d):
    return B.row_total(Tables(spark, d).bookings)


@register("batches_distinct_total", duck_with("batches") + "SELECT count(DISTINCT id) AS total FROM batches")
def q_batches_distinct(spark, d):
    return B.distinct_total(Tables(spark, d).batches, "id")


@register("booking_count_per_user", duck_with("users", "bookings") + """
SELECT u.id AS user_id, count(b.id) AS booking_count FROM users u
LEFT JOIN bookings b ON b.user_id = u.id GROUP BY u.id""")
def q_booking_count_per_user(spark, d):
    t = Tables(spark, d)
    return B.booking_count_per_user(t.users, t.bookings)


_COUPON_SQL = duck_with("coupons", "coupon_attempts") + """
, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY id) AS rn FROM coupons) WHERE rn = 1),
a AS (SELECT attempt_id, CASE WHEN trim(code_raw) = '' THEN NULL ELSE upper(trim(code_raw)) END AS code,
             epoch_us(ts) // 1000 AS ts_ms FROM coupon_attempts),
s AS (SELECT a.attempt_id, a.code, c.id AS coupon_id, c.deduction,
        CASE WHEN a.code IS NULL THEN 'REQUIRED' WHEN c.id IS NULL THEN 'NOT_FOUND'
             WHEN NOT c.status THEN 'DISABLED' WHEN a.ts_ms < c.start_date * 1000 THEN 'NOT_STARTED'
             WHEN a.ts_ms > c.end_date * 1000 THEN 'EXPIRED' ELSE 'VALID' END AS status
      FROM a LEFT JOIN c ON a.code = c.code)
"""


@register("coupon_status", _COUPON_SQL + """
SELECT attempt_id, code, status, coupon_id, CASE WHEN status = 'VALID' THEN deduction END AS deduction FROM s""")
def q_coupon_status(spark, d):
    t = Tables(spark, d)
    return CP.coupon_status(t.coupon_attempts, t.coupons)


@register("coupon_status_summary", _COUPON_SQL + "SELECT status, count(*) AS attempts FROM s GROUP BY status")
def q_coupon_summary(spark, d):
    t = Tables(spark, d)
    return CP.coupon_status_summary(CP.coupon_status(t.coupon_attempts, t.coupons))
