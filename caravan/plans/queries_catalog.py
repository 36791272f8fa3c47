"""Catalogue queries (P1-P8, A1, A8, J4-J6, J12, W1, W2) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravan.operators import catalog as C
from caravan.plans.registry import register
from caravan.plans.shapes import prefix_fields, with_group_count
from caravan.testdata import AS_OF, Tables, duck_with

TRIP_COLS = ["id", "destination_name", "destinations", "physical_rating", "description",
             "itinerary", "inclusions", "excluions", "days", "nights", "status", "images"]
BATCH_COLS = ["id", "trip_id", "from_date", "to_date", "days", "nights", "price", "tax",
              "max_adventurers", "status", "batch_name", "single_room", "double_room",
              "triple_room", "created_at"]


def _sql_lpb(fields, alias="b", prefix="lpb_"):
    return ", ".join(f"{alias}.{f} AS {prefix}{f}" for f in fields)


def _sql_cols(cols, alias):
    return ", ".join(f"{alias}.{c}" for c in cols)


_LATERAL = f"""LEFT JOIN LATERAL (
    SELECT * FROM batches WHERE trip_id = t.id AND status AND from_date > {AS_OF}
    ORDER BY price, from_date, id LIMIT 1) b ON true"""
_DATE_AGG = """LEFT JOIN (SELECT trip_id, min(from_date) AS from_month, max(to_date) AS to_month
    FROM batches WHERE status GROUP BY trip_id) d ON d.trip_id = t.id"""


@register("trip_catalog", duck_with("trips", "batches") + f"""
SELECT {_sql_cols(TRIP_COLS, 't')}, {_sql_lpb(C.CATALOG_BATCH_FIELDS)}, d.from_month, d.to_month
FROM trips t {_LATERAL} {_DATE_AGG}
WHERE t.status""")
def q_trip_catalog(spark, d):
    """J5 flagship, nested batch rendered as lpb_* columns."""
    t = Tables(spark, d)
    out = C.trip_catalog(t.trips, t.batches, AS_OF, ordered=False)
    return out.select(*TRIP_COLS, *prefix_fields("lowestPriceBatch", C.CATALOG_BATCH_FIELDS, "lpb_"),
                      "from_month", "to_month")


@register("trip_detail", duck_with("trips", "batches") + f"""
SELECT {_sql_cols(TRIP_COLS, 't')}, {_sql_lpb(C.DETAIL_BATCH_FIELDS)},
       d.from_month AS start, d.to_month AS "end", d.from_month, d.to_month
FROM trips t {_LATERAL} {_DATE_AGG}
WHERE t.status AND t.id IN (SELECT trip_id FROM batches)""")
def q_trip_detail(spark, d):
    """J6 for the trips that have any batch (ids given as a DataFrame)."""
    t = Tables(spark, d)
    ids = t.batches.select(F.col("trip_id").alias("id"))
    out = C.trip_detail(t.trips, t.batches, ids, AS_OF)
    return out.select(*TRIP_COLS, *prefix_fields("lowestPriceBatch", C.DETAIL_BATCH_FIELDS, "lpb_"),
                      "start", "end", "from_month", "to_month")


@register("cheapest_upcoming_batch", duck_with("trips", "batches") + f"""
SELECT {_sql_cols(TRIP_COLS, 't')}, {_sql_lpb(C.CATALOG_BATCH_FIELDS)}
FROM trips t {_LATERAL}""")
def q_cheapest(spark, d):
    """J4 over all trips (inactive ones too)."""
    t = Tables(spark, d)
    out = C.cheapest_upcoming_batch(t.trips, t.batches, AS_OF)
    return out.select(*TRIP_COLS, *prefix_fields("lowestPriceBatch", C.CATALOG_BATCH_FIELDS, "lpb_"))


@register("trip_date_range_public", duck_with("batches") + """
SELECT trip_id, min(from_date) AS from_month, max(to_date) AS to_month
FROM batches WHERE status GROUP BY trip_id""")
def q_date_range_public(spark, d):
    return C.trip_date_range(Tables(spark, d).batches, active_only=True)


@register("trip_date_range_admin", duck_with("batches") + """
SELECT trip_id, min(from_date) AS from_month, max(to_date) AS to_month
FROM batches GROUP BY trip_id""")
def q_date_range_admin(spark, d):
    return C.trip_date_range(Tables(spark, d).batches, active_only=False)


@register("upcoming_count", duck_with("batches") + f"""
SELECT trip_id, count(*) AS upcoming_batches FROM batches
WHERE status AND from_date > {AS_OF} GROUP BY trip_id""")
def q_upcoming_count(spark, d):
    return C.upcoming_count(Tables(spark, d).batches, AS_OF)


@register("upcoming_batches", duck_with("batches") + f"""
SELECT * FROM batches WHERE status AND from_date > {AS_OF}""")
def q_upcoming(spark, d):
    return C.upcoming_batches(Tables(spark, d).batches, AS_OF)


@register("batches_in_month", duck_with("batches") + f"""
SELECT * FROM batches WHERE status AND from_date > {AS_OF}
  AND month(make_timestamp(from_date * 1000000)) = 3""")
def q_in_month(spark, d):
    return C.batches_in_month(Tables(spark, d).batches, AS_OF, 3)


@register("search_trips", duck_with("trips") + """
SELECT * FROM trips WHERE destination_name ILIKE '%r#0000001%'""")
def q_search_trips(spark, d):
    return C.search_trips(Tables(spark, d).trips, "R#0000001")


@register("search_batches", duck_with("batches") + """
SELECT id, batch_name FROM batches WHERE lower(batch_name) LIKE lower('%B1_7%')""")
def q_search_batches(spark, d):
    """P4 with ``_`` acting as a wildcard, as in the reference."""
    return C.search_batches(Tables(spark, d).batches, "B1_7")


@register("search_users", duck_with("users") + """
SELECT id, name FROM users WHERE lower(name) LIKE lower('%IER#00000002%')""")
def q_search_users(spark, d):
    return C.search_users(Tables(spark, d).users, "IER#00000002")


@register("user_profiles", duck_with("users") + """
SELECT id, name, email, phone_number AS "phoneNumber", created_at AS "createdAt", role, gender,
       emergency_contact AS "emergencyContact", address FROM users""")
def q_profiles(spark, d):
    return C.user_profiles(Tables(spark, d).users)


@register("active_trips", duck_with("trips") + "SELECT * FROM trips WHERE status")
def q_active_trips(spark, d):
    return C.active_trips(Tables(spark, d).trips)


@register("bookings_of_users", duck_with("users", "bookings") + """
SELECT * FROM bookings WHERE user_id IN (SELECT id FROM users WHERE role = 'admin')""")
def q_bookings_of_users(spark, d):
    """P8 for all admin users (ids given as a DataFrame)."""
    t = Tables(spark, d)
    admins = t.users.where(F.col("role") == "admin").select(F.col("id").alias("user_id"))
    return C.bookings_of_users(t.bookings, admins)


@register("legacy_cheapest_by_destination", duck_with("trips", "batches") + """
, bt AS (SELECT b.id, b.price, t.destination_name FROM batches b LEFT JOIN trips t ON b.trip_id = t.id)
SELECT * FROM bt WHERE price = (SELECT min(price) FROM bt b2 WHERE b2.destination_name = bt.destination_name)""")
def q_legacy(spark, d):
    """J12 over batches with their destination name."""
    t = Tables(spark, d)
    bt = t.batches.join(t.trips.select(F.col("id").alias("tid"), "destination_name"),
                        F.col("trip_id") == F.col("tid"), "left").select("id", "price", "destination_name")
    return C.legacy_cheapest_by_destination(bt)


@register("upcoming_with_total_count", duck_with("batches") + f"""
SELECT *, count(*) OVER (PARTITION BY trip_id) AS total_count FROM batches
WHERE status AND from_date > {AS_OF}""")
def q_with_total(spark, d):
    """Per-trip total next to every row, counted after the filter."""
    return with_group_count(C.upcoming_batches(Tables(spark, d).batches, AS_OF), ["trip_id"])


@register("upcoming_with_grand_total", duck_with("batches") + f"""
SELECT *, count(*) OVER () AS total_count FROM batches WHERE status AND from_date > {AS_OF}""")
def q_with_grand_total(spark, d):
    """W1 without keys: the total of all rows next to every row."""
    return with_group_count(C.upcoming_batches(Tables(spark, d).batches, AS_OF), [])


@register("trip_batch_totals", duck_with("trips", "batches") + f"""
SELECT t.id AS trip_id, count(b.id) AS "totalBatches", CAST(ceil(count(b.id) / 4) AS BIGINT) AS "totalPages"
FROM trips t LEFT JOIN batches b ON b.trip_id = t.id AND b.status AND b.from_date > {AS_OF} GROUP BY t.id""")
def q_trip_batch_totals(spark, d):
    """W2 totals of every trip."""
    t = Tables(spark, d)
    return C.trip_batch_totals(t.trips, t.batches, AS_OF)


def _pages_sql(page: int, month: int | None) -> str:
    month_cond = f" AND month(make_timestamp(from_date * 1000000)) = {month}" if month else ""
    lo, hi = (page - 1) * 4, page * 4
    return duck_with("batches", "bookings") + f"""
, up AS (SELECT * FROM batches WHERE status AND from_date > {AS_OF}{month_cond}),
r AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY price, from_date, id) AS position,
             count(*) OVER (PARTITION BY trip_id) AS "totalBatches" FROM up)
SELECT {_sql_cols(BATCH_COLS, 'r')},
       CAST(COALESCE((SELECT sum(travellers) FROM bookings WHERE batch_id = r.id), 0) AS BIGINT) AS total_bookings,
       {page} AS page, 4 AS "limit", CAST(r.position AS INTEGER) AS position, r."totalBatches",
       CAST(ceil(r."totalBatches" / 4) AS BIGINT) AS "totalPages"
FROM r WHERE position > {lo} AND position <= {hi}"""


@register("trip_batch_pages", _pages_sql(1, None))
def q_pages_1(spark, d):
    t = Tables(spark, d)
    return C.trip_batch_pages(t.batches, t.bookings, AS_OF, None, 1)


@register("trip_batch_pages_p2", _pages_sql(2, None))
def q_pages_2(spark, d):
    t = Tables(spark, d)
    return C.trip_batch_pages(t.batches, t.bookings, AS_OF, None, 2)


@register("trip_batch_pages_month", _pages_sql(1, 5))
def q_pages_month(spark, d):
    t = Tables(spark, d)
    return C.trip_batch_pages(t.batches, t.bookings, AS_OF, 5, 1)
