"""Source / listing queries (S4-S6, O1-O3) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravan.operators import bookings as B
from caravan.operators import paging as PG
from caravan.plans.registry import register
from caravan.session import cut_lineage
from caravan.sources import constraints as CS
from caravan.sources import tables as ST
from caravan.testdata import Tables, duck_with

_BATCH_COLS = ["id", "trip_id", "from_date", "to_date", "days", "nights", "price", "tax", "max_adventurers",
               "status", "batch_name", "single_room", "double_room", "triple_room", "created_at"]


@register("lookup_batches_by_request", duck_with("booking_requests", "batches") + f"""
SELECT r.request_id, b.id IS NOT NULL AS found, {", ".join("b." + c for c in _BATCH_COLS)}
FROM booking_requests r LEFT JOIN batches b ON CAST(b.id AS VARCHAR) = r.batch_ref""")
def q_lookup(spark, d):
    """The batch named by every booking request (found = false for a 404)."""
    t = Tables(spark, d)
    ids = t.booking_requests.select("request_id", F.col("batch_ref").alias("id"))
    return ST.lookup_by_ids(t.batches, ids)


@register("migrate_bookings", duck_with("bookings") + "SELECT * FROM bookings")
def q_migrate(spark, d):
    """Old-shape bookings (batch held in trip_id) brought to the current shape."""
    b = Tables(spark, d).bookings
    old = b.withColumnRenamed("batch_id", "trip_id")
    return ST.migrate_bookings(old)


@register("constraint_report", duck_with("users", "trips", "batches", "bookings") + """
SELECT 'users' AS "table", c || ' NOT NULL' AS "constraint", 'not_null' AS kind, CAST(v AS BIGINT) AS violations
FROM (SELECT count_if(id IS NULL) AS id, count_if(name IS NULL) AS name, count_if(email IS NULL) AS email,
             count_if(phone_number IS NULL) AS phone_number, count_if(created_at IS NULL) AS created_at,
             count_if(role IS NULL) AS role FROM users) UNPIVOT (v FOR c IN (id, name, email, phone_number,
             created_at, role))
UNION ALL
SELECT 'trips', c || ' NOT NULL', 'not_null', CAST(v AS BIGINT)
FROM (SELECT count_if(id IS NULL) AS id, count_if(destination_name IS NULL) AS destination_name,
             count_if(destinations IS NULL) AS destinations, count_if(physical_rating IS NULL) AS physical_rating,
             count_if(description IS NULL) AS description, count_if(itinerary IS NULL) AS itinerary,
             count_if(inclusions IS NULL) AS inclusions, count_if(excluions IS NULL) AS excluions,
             count_if(days IS NULL) AS days, count_if(nights IS NULL) AS nights, count_if(status IS NULL) AS status
      FROM trips) UNPIVOT (v FOR c IN (id, destination_name, destinations, physical_rating, description,
      itinerary, inclusions, excluions, days, nights, status))
UNION ALL
SELECT 'batches', c || ' NOT NULL', 'not_null', CAST(v AS BIGINT)
FROM (SELECT count_if(id IS NULL) AS id, count_if(trip_id IS NULL) AS trip_id,
             count_if(from_date IS NULL) AS from_date, count_if(to_date IS NULL) AS to_date,
             count_if(price IS NULL) AS price, count_if(tax IS NULL) AS tax,
             count_if(max_adventurers IS NULL) AS max_adventurers, count_if(status IS NULL) AS status,
             count_if(batch_name IS NULL) AS batch_name, count_if(single_room IS NULL) AS single_room,
             count_if(double_room IS NULL) AS double_room, count_if(triple_room IS NULL) AS triple_room
      FROM batches) UNPIVOT (v FOR c IN (id, trip_id, from_date, to_date, price, tax, max_adventurers, status,
      batch_name, single_room, double_room, triple_room))
UNION ALL
SELECT 'bookings', c || ' NOT NULL', 'not_null', CAST(v AS BIGINT)
FROM (SELECT count_if(id IS NULL) AS id, count_if(user_id IS NULL) AS user_id,
             count_if(batch_id IS NULL) AS batch_id, count_if(name IS NULL) AS name,
             count_if(phone_number IS NULL) AS phone_number, count_if(email IS NULL) AS email,
             count_if(payment IS NULL) AS payment, count_if(travellers IS NULL) AS travellers,
             count_if(room_type IS NULL) AS room_type, count_if(invoice_id IS NULL) AS invoice_id
      FROM bookings) UNPIVOT (v FOR c IN (id, user_id, batch_id, name, phone_number, email, payment,
      travellers, room_type, invoice_id))
UNION ALL
SELECT tb, 'id PRIMARY KEY', 'duplicate_key', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (
  SELECT 'users' AS tb, count(*) AS n FROM users GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'trips', count(*) FROM trips GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'batches', count(*) FROM batches GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'bookings', count(*) FROM bookings GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT tb, 1 FROM (VALUES ('users'), ('trips'), ('batches'), ('bookings')) v(tb)) GROUP BY tb
UNION ALL
SELECT 'batches', 'trip_id REFERENCES trips(id)', 'orphan_fk', count(*) FROM batches
  WHERE trip_id NOT IN (SELECT id FROM trips)
UNION ALL
SELECT 'bookings', 'user_id REFERENCES users(id)', 'orphan_fk', count(*) FROM bookings
  WHERE user_id NOT IN (SELECT id FROM users)
UNION ALL
SELECT 'bookings', 'batch_id REFERENCES batches(id)', 'orphan_fk', count(*) FROM bookings
  WHERE batch_id NOT IN (SELECT id FROM batches)""")
def q_constraints(spark, d):
    """S6 over users, trips, batches and bookings."""
    t = Tables(spark, d)
    return CS.constraint_report({"users": t.users, "trips": t.trips, "batches": t.batches,
                                 "bookings": t.bookings})


@register("admin_trips_page", duck_with("trips") + """
SELECT * FROM trips ORDER BY destination_name, id LIMIT 20 OFFSET 40""")
def q_trips_page(spark, d):
    """O1 + O2: third page of the admin trip list (the page is the feature)."""
    rows, _ = PG.page(Tables(spark, d).trips, PG.sort_keys("trips"), "3", None)
    return rows


@register("admin_trips_page_meta", duck_with("trips") + """
SELECT CAST(greatest(0, least(20, count(*) - 40)) AS BIGINT) AS count, count(*) AS total, 3 AS page,
       20 AS "limit", CAST(ceil(count(*) / 20) AS BIGINT) AS "totalPages" FROM trips""")
def q_trips_page_meta(spark, d):
    """O1 metadata: count, total, page, limit, totalPages."""
    _, meta = PG.page(Tables(spark, d).trips, PG.sort_keys("trips"), "3", "abc")
    return meta


@register("admin_bookings_page", duck_with("bookings") + """
SELECT * FROM bookings ORDER BY id DESC LIMIT 20 OFFSET 0""")
def q_bookings_page(spark, d):
    """O1: first page of bookings, newest id first ('0' page -> 1)."""
    rows, _ = PG.page(Tables(spark, d).bookings, PG.sort_keys("bookings"), "0", "20")
    return rows


@register("list_coupons_page", duck_with("coupons") + """
SELECT id, code, deduction, start_date, end_date, status FROM coupons
ORDER BY start_date DESC, id LIMIT 50 OFFSET 100""")
def q_list_coupons(spark, d):
    """O3: coupons page 3 of 50, newest start first."""
    rows, _ = PG.list_coupons(Tables(spark, d).coupons, "3", "50")
    return rows


@register("list_leads", duck_with("leads") + """
SELECT id, type, name, location, travellers, days, email, phone, message, budget, date, created_at
FROM leads ORDER BY created_at DESC NULLS FIRST, id""")
def q_list_leads(spark, d):
    """O3: all leads, newest first."""
    return PG.list_leads(Tables(spark, d).leads)


_BANNERS = """WITH banners AS (SELECT s_suppkey AS id, s_name AS banner_name, concat('Offer of ', s_name) AS description,
  s_acctbal >= 0 AS status, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 1700000000 + s_nationkey END AS created_at, 'x' AS image
  FROM supplier) """


@register("list_banners", _BANNERS + """
SELECT id, banner_name, description, status, created_at, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) AS place
FROM banners""")
def q_list_banners(spark, d):
    """O3: all banners (one per supplier), newest first, with their place in the list."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    banners = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("banner_name"),
                       F.concat(F.lit("Offer of "), F.col("s_name")).alias("description"), (F.col("s_acctbal") >= 0).alias("status"),
                       F.when(F.col("s_suppkey") % 9 != 0, F.col("s_nationkey") + 1700000000).alias("created_at"), F.lit("x").alias("image"))
    listed = PG.list_banners(banners)
    return PG.placed(listed, PG.sort_keys("banners"))


@register("bookings_deep_page", duck_with("bookings") + """
SELECT * FROM bookings ORDER BY id DESC LIMIT 500 OFFSET (SELECT 500 * (count(*) // 1000) FROM bookings)""")
def q_bookings_deep_page(spark, d):
    """O1: a page in the middle of all bookings."""
    b = Tables(spark, d).bookings
    middle = b.count() // 1000 + 1
    return PG.deep_page(b, PG.sort_keys("bookings"), middle, 500)[0]


@register("users_page_with_trips", duck_with("users", "bookings", "batches", "trips") + """
, page AS (SELECT id, name, email, phone_number, created_at, role FROM users
           ORDER BY created_at DESC, id LIMIT 20 OFFSET 20)
SELECT p.*, coalesce((SELECT string_agg(DISTINCT t.destination_name, '|' ORDER BY t.destination_name)
                      FROM bookings b JOIN batches ba ON ba.id = b.batch_id JOIN trips t ON t.id = ba.trip_id
                      WHERE b.user_id = p.id), '') AS trips
FROM page p""")
def q_users_page(spark, d):
    """O1 + A5: second page of users, newest first, with their trips (joined by |)."""
    t = Tables(spark, d)
    u = t.users.select("id", "name", "email", "phone_number", "created_at", "role")
    rows, _ = PG.page(u, PG.sort_keys("users"), 2, 20)
    out = B.users_with_trips(rows, t.bookings, t.batches, t.trips)
    return out.withColumn("trips", F.array_join("trips", "|"))


@register("batches_page_with_roster", duck_with("users", "bookings", "batches", "trips") + """
, page AS (SELECT * FROM batches ORDER BY created_at DESC, id LIMIT 20 OFFSET 0)
SELECT p.id, t.destination_name, p.total_count, string_agg(CASE WHEN b.id IS NOT NULL THEN coalesce(u.name, '-') END, '|' ORDER BY b.id) AS users,
       string_agg(CAST(b.travellers AS VARCHAR), '|' ORDER BY b.id) AS travellers
FROM (SELECT page.*, (SELECT count(*) FROM bookings b2 WHERE b2.batch_id = page.id) AS total_count FROM page) p
LEFT JOIN trips t ON t.id = p.trip_id LEFT JOIN bookings b ON b.batch_id = p.id LEFT JOIN users u ON u.id = b.user_id
GROUP BY p.id, t.destination_name, p.total_count""")
def q_batches_page(spark, d):
    """O1 + A4: first page of batches, newest first, with names and travellers of
    their bookings (joined by |)."""
    t = Tables(spark, d)
    rows, _ = PG.page(t.batches, [F.col("created_at").desc_nulls_first(), F.col("id").asc_nulls_last()], 1, 20)
    rows = cut_lineage(rows)
    mine = t.bookings.join(rows.select(F.col("id").alias("_p")), F.col("batch_id") == F.col("_p"), "left_semi")
    out = B.nest_roster(B.batch_roster(rows, t.trips, mine), B.batch_roster_entries(rows, mine, t.users))

    def shown(c):
        return F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), "|"))
    return out.select("id", "destination_name", F.col("booking_count").alias("total_count"),
                      shown("users").alias("users"), shown("travellers").alias("travellers"))
