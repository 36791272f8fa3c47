"""Bulk-change queries (J8, M1-M13) with DuckDB oracles. Request tables come
from the adapter (``caravan.testdata``); each query returns either the
per-request outcome or the stored table after the change."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravan.operators import admission as AD
from caravan.operators import changes as CH
from caravan.plans.registry import register
from caravan.testdata import AS_OF, Tables, duck_with


def _pi(c: str) -> str:
    """JS parseInt in DuckDB text."""
    return f"TRY_CAST(nullif(regexp_extract({c}, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT)"


def _pf(c: str) -> str:
    return (f"TRY_CAST(nullif(regexp_extract({c}, '^\\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)"
            f"([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE)")


def _blank(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '') = ''"


def _blank0(c: str) -> str:
    return f"({_blank(c)} OR trim(CAST({c} AS VARCHAR)) = '0')"


def _sha(*cols: str) -> str:
    return "sha256(concat_ws(chr(1), " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"


def _first_sql(key: str, valid: str) -> str:
    """The first valid request per key: by seq, those without one last, then by id."""
    return (f"SELECT {key} AS fk, seq IS NULL AS fn, coalesce(seq, 0) AS fs, request_id AS fr FROM x WHERE {valid} "
            f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY seq NULLS LAST, request_id) = 1")


_LATER = "(x.seq IS NULL, coalesce(x.seq, 0), x.request_id) > (f.fn, f.fs, f.fr)"


def _asked_sql(requests: str, ties: bool) -> str:
    """The request table; with ``ties`` many requests share a seq or have none."""
    seq = "CASE WHEN seq % 7 = 0 THEN NULL ELSE seq % 5 END" if ties else "seq"
    return f"asked AS (SELECT * REPLACE ({seq} AS seq) FROM {requests})"


def tied(requests):
    """The request table of ``_asked_sql`` with ties."""
    return requests.withColumn("seq", F.when(F.col("seq") % 7 != 0, F.col("seq") % 5))


_OUTCOME = "SELECT request_id, error_code IS NULL AS accepted, error_code FROM d"

# ------------------------------------------------------------------ M1
_TRIP_E1 = ("CASE WHEN " + " OR ".join(_blank(f'"{c}"') for c in CH.TRIP_REQUIRED) +
            " THEN 'MISSING_FIELDS' WHEN coalesce(n_images, 0) <= 0 THEN 'IMAGE_REQUIRED'"
            " WHEN NOT coalesce(has_itinerary, false) THEN 'ITINERARY_REQUIRED'"
            " WHEN json_valid(\"daysData\") IS NOT TRUE THEN 'INVALID_DAYS_JSON' END")

def _trips_decided_sql(ties: bool = False) -> str:
    return duck_with("trips", "trip_requests") + f""", {_asked_sql('trip_requests', ties)}, r1 AS (SELECT *, {_TRIP_E1} AS e1 FROM asked),
x AS (SELECT r1.*, name IN (SELECT destination_name FROM trips) AS ex FROM r1),
f AS ({_first_sql('name', 'e1 IS NULL AND NOT coalesce(ex, false)')}),
d AS (SELECT x.*, coalesce(e1, CASE WHEN coalesce(ex, false) OR {_LATER} THEN 'DUPLICATE_NAME' END)
        AS error_code FROM x LEFT JOIN f ON f.fk = x.name)
"""


@register("insert_trips_outcome", _trips_decided_sql() + _OUTCOME)
def q_insert_trips_outcome(spark, d):
    t = Tables(spark, d)
    return CH.insert_trips(t.trips, t.trip_requests)[1]


@register("insert_trips_ties", _trips_decided_sql(ties=True) + _OUTCOME)
def q_insert_trips_ties(spark, d):
    """Requests with equal arrival numbers, and without one."""
    t = Tables(spark, d)
    return CH.insert_trips(t.trips, tied(t.trip_requests))[1]


@register("insert_trips_table", _trips_decided_sql() + f"""
SELECT CAST(id AS VARCHAR) AS id, destination_name, destinations, physical_rating, description, itinerary,
       inclusions, excluions, days, nights, status, images FROM trips
UNION ALL
SELECT {_sha('request_id', 'name')}, name, destinations, CAST({_pi('"physicalRating"')} AS INTEGER),
       description, "daysData", '', '', days, CAST({_pi('nights')} AS INTEGER), true, n_images
FROM d WHERE error_code IS NULL""")
def q_insert_trips_table(spark, d):
    t = Tables(spark, d)
    return CH.insert_trips(t.trips, t.trip_requests)[0]


# ------------------------------------------------------------------ M2
_NUMS = ['"startDate"', '"endDate"', '"standardPrice"', '"tripleRoom"', 'tax', '"maxAdventurers"']
_BATCH_E1 = ("CASE WHEN " + " OR ".join(
    [_blank('"batchName"'), _blank('"assignedTrip"'), _blank0('"startDate"'), _blank0('"endDate"'),
     _blank0('"standardPrice"'), '"tripleRoom" IS NULL', 'tax IS NULL', _blank0('"maxAdventurers"')]) +
    f" THEN 'MISSING_FIELDS' WHEN {_pi('\"endDate\"')} <= {_pi('\"startDate\"')} THEN 'INVALID_DATES' END")
_BATCH_E3 = ("CASE WHEN " + " OR ".join(f"{_pi(c)} IS NULL" for c in _NUMS) +
             " THEN 'INVALID_NUMBER' WHEN \"assignedTrip\" NOT IN (SELECT CAST(id AS VARCHAR) FROM trips)"
             " THEN 'TRIP_NOT_FOUND' END")


def _batches_decided_sql(ties: bool = False) -> str:
    return duck_with("batches", "trips", "batch_requests") + f""", {_asked_sql('batch_requests', ties)}, r1 AS (
  SELECT *, {_BATCH_E1} AS e1, {_BATCH_E3} AS e3 FROM asked),
x AS (SELECT r1.*, "batchName" IN (SELECT batch_name FROM batches) AS ex FROM r1),
f AS ({_first_sql('"batchName"', 'e1 IS NULL AND e3 IS NULL AND NOT coalesce(ex, false)')}),
d AS (SELECT x.*, coalesce(e1, CASE WHEN coalesce(ex, false) OR {_LATER} THEN 'DUPLICATE_NAME' END, e3)
        AS error_code FROM x LEFT JOIN f ON f.fk = x."batchName")
"""


@register("insert_batches_outcome", _batches_decided_sql() + _OUTCOME)
def q_insert_batches_outcome(spark, d):
    t = Tables(spark, d)
    return CH.insert_batches(t.batches, t.batch_requests, t.trips, AS_OF)[1]


@register("insert_batches_ties", _batches_decided_sql(ties=True) + _OUTCOME)
def q_insert_batches_ties(spark, d):
    """Requests with equal arrival numbers, and without one."""
    t = Tables(spark, d)
    return CH.insert_batches(t.batches, tied(t.batch_requests), t.trips, AS_OF)[1]


@register("insert_batches_table", _batches_decided_sql() + f"""
SELECT CAST(id AS VARCHAR) AS id, CAST(trip_id AS VARCHAR) AS trip_id, from_date, to_date, days, nights,
       price, tax, max_adventurers, status, batch_name, single_room, double_room, triple_room, created_at
FROM batches
UNION ALL
SELECT {_sha('request_id', '"batchName"')}, "assignedTrip", {_pi('"startDate"')}, {_pi('"endDate"')},
       NULL, NULL, {_pi('"standardPrice"')}, {_pi('tax')}, {_pi('"maxAdventurers"')},
       CASE WHEN status IS NULL THEN true ELSE lower(status) IN ('true', '1', 't') END, "batchName",
       coalesce({_pi('"singleRoom"')}, 0), coalesce({_pi('"doubleRoom"')}, 0), {_pi('"tripleRoom"')},
       coalesce({_pi('"createdAt"')}, {AS_OF})
FROM d WHERE error_code IS NULL""")
def q_insert_batches_table(spark, d):
    t = Tables(spark, d)
    return CH.insert_batches(t.batches, t.batch_requests, t.trips, AS_OF)[0]


# ------------------------------------------------------------------ M3
def _coupons_decided_sql(ties: bool = False) -> str:
    e1 = ("CASE WHEN " + " OR ".join([_blank('"couponCode"'), _blank0('deduction'), _blank0('"startDate"'),
                                       _blank0('"endDate"')]) + " THEN 'MISSING_FIELDS' END")
    return duck_with("coupons", "coupon_requests") + f""", {_asked_sql('coupon_requests', ties)}, r1 AS (SELECT *, {e1} AS e1 FROM asked),
x AS (SELECT r1.*, "couponCode" IN (SELECT code FROM coupons) AS ex FROM r1),
f AS ({_first_sql('"couponCode"', 'e1 IS NULL AND NOT coalesce(ex, false)')}),
d AS (SELECT x.*, coalesce(e1, CASE WHEN coalesce(ex, false) OR {_LATER} THEN 'DUPLICATE_CODE' END)
        AS error_code FROM x LEFT JOIN f ON f.fk = x."couponCode")
"""


@register("insert_coupons_outcome", _coupons_decided_sql() + _OUTCOME)
def q_insert_coupons_outcome(spark, d):
    t = Tables(spark, d)
    return CH.insert_coupons(t.coupons, t.coupon_requests)[1]


@register("insert_coupons_ties", _coupons_decided_sql(ties=True) + _OUTCOME)
def q_insert_coupons_ties(spark, d):
    """Requests with equal arrival numbers, and without one."""
    t = Tables(spark, d)
    return CH.insert_coupons(t.coupons, tied(t.coupon_requests))[1]


@register("insert_coupons_table", _coupons_decided_sql() + f"""
SELECT CAST(id AS VARCHAR) AS id, code, deduction, start_date, end_date, status FROM coupons
UNION ALL
SELECT {_sha('request_id', '"couponCode"')}, "couponCode",
       CAST(CAST({_pf('deduction')} AS DECIMAL(12, 2)) AS INTEGER), {_pi('"startDate"')},
       {_pi('"endDate"')}, true
FROM d WHERE error_code IS NULL""")
def q_insert_coupons_table(spark, d):
    t = Tables(spark, d)
    return CH.insert_coupons(t.coupons, t.coupon_requests)[0]


# ------------------------------------------------------------------ M4
def _users_decided_sql(ties: bool = False) -> str:
    e1 = ("CASE WHEN " + " OR ".join(_blank(c) for c in ['name', 'email', '"phoneNumber"', 'role']) +
          " THEN 'MISSING_FIELDS' WHEN NOT regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+')"
          " THEN 'INVALID_EMAIL' WHEN NOT regexp_full_match(\"phoneNumber\", '[0-9]{10}')"
          " THEN 'INVALID_PHONE' END")
    e3 = "CASE WHEN lower(trim(role)) NOT IN ('user', 'admin', 'superadmin') THEN 'INVALID_ROLE' END"
    return duck_with("users", "user_requests") + f""", {_asked_sql('user_requests', ties)}, r1 AS (SELECT *, {e1} AS e1, {e3} AS e3 FROM asked),
x AS (SELECT r1.*, email IN (SELECT email FROM users) AS ex FROM r1),
f AS ({_first_sql('email', 'e1 IS NULL AND e3 IS NULL AND NOT coalesce(ex, false)')}),
d AS (SELECT x.*, coalesce(e1, CASE WHEN coalesce(ex, false) OR {_LATER} THEN 'DUPLICATE_EMAIL' END, e3)
        AS error_code FROM x LEFT JOIN f ON f.fk = x.email)
"""


@register("insert_users_outcome", _users_decided_sql() + _OUTCOME)
def q_insert_users_outcome(spark, d):
    t = Tables(spark, d)
    return CH.insert_users(t.users, t.user_requests, AS_OF)[1]


@register("insert_users_ties", _users_decided_sql(ties=True) + _OUTCOME)
def q_insert_users_ties(spark, d):
    """Requests with equal arrival numbers, and without one."""
    t = Tables(spark, d)
    return CH.insert_users(t.users, tied(t.user_requests), AS_OF)[1]


@register("insert_users_table", _users_decided_sql() + f"""
SELECT CAST(id AS VARCHAR) AS id, name, email, phone_number, created_at, role, gender, emergency_contact,
       address FROM users
UNION ALL
SELECT {_sha('request_id', 'email')}, name, email, CAST({_pi('"phoneNumber"')} AS VARCHAR),
       CAST({AS_OF} AS BIGINT), lower(trim(role)), NULL, NULL, NULL
FROM d WHERE error_code IS NULL""")
def q_insert_users_table(spark, d):
    t = Tables(spark, d)
    return CH.insert_users(t.users, t.user_requests, AS_OF)[0]


# ------------------------------------------------------------------ M5, M9
def _booking_rules_sql(with_invoice: bool, not_found: bool) -> str:
    parts = []
    if not_found:
        parts.append("WHEN NOT bk_ok THEN 'NOT_FOUND'")
    if with_invoice:
        parts.append("WHEN NOT coalesce(has_invoice, false) THEN 'INVOICE_REQUIRED'")
    missing = " OR ".join(_blank(c) for c in
                          ["user_ref", "batch_ref", "name", "phone_number", "email", "payment", "travellers",
                           "room_type"])
    parts += [f"WHEN {missing} THEN 'MISSING_FIELDS'",
              f"WHEN {_pf('payment')} IS NULL OR {_pf('payment')} <= 0 THEN 'INVALID_PAYMENT'",
              f"WHEN {_pi('travellers')} IS NULL OR {_pi('travellers')} <= 0 THEN 'INVALID_TRAVELLERS'",
              "WHEN NOT regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN 'INVALID_EMAIL'",
              "WHEN NOT regexp_full_match(phone_number, '[0-9]{10}') THEN 'INVALID_PHONE'",
              f"WHEN NOT ({_blank('guardian_number')}) AND NOT regexp_full_match(guardian_number, '[0-9]{{10}}')"
              " THEN 'INVALID_GUARDIAN_PHONE'",
              "WHEN user_ref NOT IN (SELECT CAST(id AS VARCHAR) FROM users) THEN 'USER_NOT_FOUND'",
              "WHEN batch_ref NOT IN (SELECT CAST(id AS VARCHAR) FROM batches) THEN 'BATCH_NOT_FOUND'"]
    return "CASE " + " ".join(parts) + " END"


@register("validate_bookings", duck_with("booking_requests", "users", "batches") + f"""
SELECT request_id, user_ref AS user_id, batch_ref AS batch_id, {_booking_rules_sql(True, False)} AS error_code,
       CAST({_pf('payment')} AS DECIMAL(12, 2)) AS payment_value,
       CAST({_pi('travellers')} AS INTEGER) AS travellers_value
FROM booking_requests""")
def q_validate_bookings(spark, d):
    t = Tables(spark, d)
    v = CH.validate_bookings(t.booking_requests, t.users, t.batches)
    return v.select("request_id", "user_id", "batch_id", "error_code", "payment_value", "travellers_value")


def _updates_sql() -> str:
    return duck_with("bookings", "booking_updates", "users", "batches") + f"""
, u AS (SELECT bu.*, bu.id IN (SELECT id FROM bookings) AS bk_ok FROM booking_updates bu),
d AS (SELECT u.*, {_booking_rules_sql(False, True)} AS error_code FROM u)
"""


@register("update_bookings_outcome", _updates_sql() + _OUTCOME)
def q_update_bookings_outcome(spark, d):
    t = Tables(spark, d)
    return CH.update_bookings(t.bookings, t.booking_updates, t.users, t.batches)[1]


@register("update_bookings_table", _updates_sql() + f"""
, ok AS (SELECT * FROM d WHERE error_code IS NULL)
SELECT b.id, CAST(coalesce(ok.user_ref, CAST(b.user_id AS VARCHAR)) AS VARCHAR) AS user_id,
       coalesce(ok.batch_ref, CAST(b.batch_id AS VARCHAR)) AS batch_id,
       CASE WHEN ok.id IS NULL THEN b.name ELSE ok.name END AS name,
       CASE WHEN ok.id IS NULL THEN b.phone_number ELSE ok.phone_number END AS phone_number,
       CASE WHEN ok.id IS NULL THEN b.guardian_number ELSE nullif(ok.guardian_number, '') END AS guardian_number,
       CASE WHEN ok.id IS NULL THEN b.email ELSE ok.email END AS email,
       CASE WHEN ok.id IS NULL THEN b.payment
            ELSE CAST(CAST({_pf('ok.payment')} AS DECIMAL(12, 2)) AS BIGINT) END AS payment,
       CASE WHEN ok.id IS NULL THEN b.travellers ELSE CAST({_pi('ok.travellers')} AS INTEGER) END AS travellers,
       CASE WHEN ok.id IS NULL THEN b.room_type ELSE ok.room_type END AS room_type, b.invoice_id
FROM bookings b LEFT JOIN ok ON ok.id = b.id""")
def q_update_bookings_table(spark, d):
    t = Tables(spark, d)
    return CH.update_bookings(t.bookings, t.booking_updates, t.users, t.batches)[0]


# ------------------------------------------------------------------ M6
@register("admit_bookings", duck_with("batches", "booking_requests").replace("WITH ", "WITH RECURSIVE ", 1) + """
, caps AS (SELECT CAST(id AS VARCHAR) AS b, max_adventurers AS cap FROM batches),
r AS (SELECT request_id, seq, batch_ref AS b, CAST(travellers AS INTEGER) AS n FROM booking_requests),
rb AS (SELECT r.*, c.cap, row_number() OVER (PARTITION BY r.b ORDER BY r.seq) AS rn
       FROM r JOIN caps c ON c.b = r.b),
fold AS (
  SELECT b, rn, request_id, seq, n, cap, n <= cap AS accepted, CASE WHEN n <= cap THEN n ELSE 0 END AS used
  FROM rb WHERE rn = 1
  UNION ALL
  SELECT rb.b, rb.rn, rb.request_id, rb.seq, rb.n, rb.cap, f.used + rb.n <= rb.cap,
         CASE WHEN f.used + rb.n <= rb.cap THEN f.used + rb.n ELSE f.used END
  FROM fold f JOIN rb ON rb.b = f.b AND rb.rn = f.rn + 1)
SELECT request_id, b AS batch_id, seq, n AS travellers, accepted,
       CASE WHEN NOT accepted THEN 'NO_CAPACITY' END AS error_code, CAST(used AS BIGINT) AS seats_after
FROM fold
UNION ALL
SELECT request_id, b, seq, n, false, 'BATCH_NOT_FOUND', NULL FROM r WHERE b NOT IN (SELECT b FROM caps)""")
def q_admit(spark, d):
    """M6 over every booking request, batches starting empty."""
    t = Tables(spark, d)
    req = t.booking_requests.select("request_id", "seq", F.col("batch_ref").alias("batch_id"),
                                    F.col("travellers").cast("int").alias("travellers"))
    return AD.admit_bookings(t.batches, None, req)


# Arrival numbers 10 times the line number plus a digit: 20 comes before 110, as
# text it would not. FOLD decides rows rb(request_id, seq, b, n, cap, used0, rn).
_NUMERIC_SEQ = "l_linenumber * 10 + l_partkey % 10"
_FOLD = """
fold AS (
  SELECT b, rn, request_id, seq, n, cap, used0 + n <= cap AS accepted,
         CASE WHEN used0 + n <= cap THEN used0 + n ELSE used0 END AS used
  FROM rb WHERE rn = 1
  UNION ALL
  SELECT rb.b, rb.rn, rb.request_id, rb.seq, rb.n, rb.cap, f.used + rb.n <= rb.cap,
         CASE WHEN f.used + rb.n <= rb.cap THEN f.used + rb.n ELSE f.used END
  FROM fold f JOIN rb ON rb.b = f.b AND rb.rn = f.rn + 1)"""


def _numeric_requests_sql(*views: str) -> str:
    """booking_requests with a numeric seq (columns as in the adapter's view)."""
    return duck_with(*views).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, req AS (SELECT r.* EXCLUDE (seq), l.seq FROM booking_requests r JOIN
  (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                             epoch_us(l_shipdate) // 1000000 // 86400) AS id, {_NUMERIC_SEQ} AS seq
   FROM lineitem) l ON l.id = r.request_id),
caps AS (SELECT CAST(id AS VARCHAR) AS b, max_adventurers AS cap FROM batches)"""


def numeric_requests(t: Tables):
    part = F.split_part("request_id", F.lit("-"), F.lit(3)).cast("long")
    line = F.split_part("request_id", F.lit("-"), F.lit(2)).cast("long")
    return t.booking_requests.withColumn("seq", line * 10 + part % 10)


_USED = """
, used AS (SELECT CAST(batch_id AS VARCHAR) AS b, sum(travellers) AS used0 FROM bookings GROUP BY batch_id)"""


@register("admit_bookings_summary", _numeric_requests_sql("batches", "booking_requests", "bookings") + _USED + f""",
rb AS (SELECT r.request_id, r.seq, r.batch_ref AS b, CAST(r.travellers AS INTEGER) AS n, c.cap,
              coalesce(u.used0, 0) AS used0, row_number() OVER (PARTITION BY r.batch_ref ORDER BY r.seq) AS rn
       FROM booking_requests r JOIN caps c ON c.b = r.batch_ref LEFT JOIN used u ON u.b = r.batch_ref), {_FOLD}
SELECT accepted, CASE WHEN NOT accepted THEN 'NO_CAPACITY' END AS error_code, count(*) AS requests
FROM fold GROUP BY accepted
UNION ALL
SELECT false, 'BATCH_NOT_FOUND', count(*) FROM booking_requests WHERE batch_ref NOT IN (SELECT b FROM caps)
HAVING count(*) > 0""")
def q_admit_summary(spark, d):
    """M6 totals per outcome, starting from the existing bookings."""
    t = Tables(spark, d)
    req = t.booking_requests.select("request_id", "seq", F.col("batch_ref").alias("batch_id"),
                                    F.col("travellers").cast("int").alias("travellers"))
    a = AD.admit_bookings(t.batches, t.bookings, req)
    return a.groupBy("accepted", "error_code").agg(F.count(F.lit(1)).alias("requests"))


@register("admit_bookings_numeric_seq", _numeric_requests_sql("batches", "booking_requests", "bookings") + f"""
, used AS (SELECT CAST(batch_id AS VARCHAR) AS b, sum(travellers) // 3 AS used0 FROM bookings GROUP BY batch_id),
rb AS (SELECT req.request_id, req.seq, req.batch_ref AS b, CAST(req.travellers AS INTEGER) AS n, c.cap,
              coalesce(u.used0, 0) AS used0,
              row_number() OVER (PARTITION BY req.batch_ref ORDER BY req.seq, req.request_id) AS rn
       FROM req JOIN caps c ON c.b = req.batch_ref LEFT JOIN used u ON u.b = req.batch_ref), {_FOLD}
SELECT request_id, b AS batch_id, seq, n AS travellers, accepted,
       CASE WHEN NOT accepted THEN 'NO_CAPACITY' END AS error_code, CAST(used AS BIGINT) AS seats_after
FROM fold
UNION ALL
SELECT request_id, batch_ref, seq, CAST(travellers AS INTEGER), false, 'BATCH_NOT_FOUND', NULL FROM req
WHERE batch_ref NOT IN (SELECT b FROM caps)""")
def q_admit_numeric(spark, d):
    """M6 with numeric arrival numbers, starting from batches a third full."""
    t = Tables(spark, d)
    taken = t.bookings.groupBy("batch_id").agg((F.sum("travellers") / 3).cast("bigint").alias("travellers"))
    req = numeric_requests(t).select("request_id", "seq", F.col("batch_ref").alias("batch_id"),
                                      F.col("travellers").cast("int").alias("travellers"))
    return AD.admit_bookings(t.batches, taken, req)


_ODD_CAP = "CASE WHEN id % 4 = 0 THEN 2000000000 WHEN id % 4 = 1 THEN 0 ELSE max_adventurers END"
_ODD_USED = "CASE WHEN batch_id % 3 = 0 THEN -travellers ELSE travellers // 3 END"


@register("admit_bookings_any_capacity", duck_with("batches", "booking_requests", "bookings").replace(
    "WITH ", "WITH RECURSIVE ", 1) + f"""
, caps AS (SELECT CAST(id AS VARCHAR) AS b, {_ODD_CAP} AS cap FROM batches),
used AS (SELECT CAST(batch_id AS VARCHAR) AS b, sum({_ODD_USED}) AS used0 FROM bookings GROUP BY batch_id),
rb AS (SELECT r.request_id, r.seq, r.batch_ref AS b, CAST(r.travellers AS INTEGER) AS n, c.cap,
              coalesce(u.used0, 0) AS used0,
              row_number() OVER (PARTITION BY r.batch_ref ORDER BY r.seq, r.request_id) AS rn
       FROM booking_requests r JOIN caps c ON c.b = r.batch_ref LEFT JOIN used u ON u.b = r.batch_ref), {_FOLD}
SELECT request_id, b AS batch_id, seq, n AS travellers, accepted,
       CASE WHEN NOT accepted THEN 'NO_CAPACITY' END AS error_code, CAST(used AS BIGINT) AS seats_after
FROM fold
UNION ALL
SELECT request_id, batch_ref, seq, CAST(travellers AS INTEGER), false, 'BATCH_NOT_FOUND', NULL FROM booking_requests
WHERE batch_ref NOT IN (SELECT b FROM caps)""")
def q_admit_any(spark, d):
    """M6 with capacities of 0 and 2e9 and booked sums below zero."""
    t = Tables(spark, d)
    caps = t.batches.withColumn("max_adventurers", F.expr(_ODD_CAP))
    taken = t.bookings.select("batch_id", F.expr(_ODD_USED.replace("//", "div")).alias("travellers"))
    req = t.booking_requests.select("request_id", "seq", F.col("batch_ref").alias("batch_id"),
                                    F.col("travellers").cast("int").alias("travellers"))
    return AD.admit_bookings(caps, taken, req)


def _booked_sql() -> str:
    return _numeric_requests_sql("bookings", "booking_requests", "users", "batches") + f"""
, v AS (SELECT request_id, seq, user_ref, batch_ref, name, phone_number, guardian_number, email, payment,
               travellers, room_type, {_booking_rules_sql(True, False)} AS code FROM req),
used AS (SELECT CAST(batch_id AS VARCHAR) AS b, sum(travellers) AS used0 FROM bookings GROUP BY batch_id),
rb AS (SELECT v.request_id, v.seq, v.batch_ref AS b, {_pi('v.travellers')} AS n, c.cap,
              coalesce(u.used0, 0) AS used0,
              row_number() OVER (PARTITION BY v.batch_ref ORDER BY v.seq, v.request_id) AS rn
       FROM v JOIN caps c ON c.b = v.batch_ref LEFT JOIN used u ON u.b = v.batch_ref WHERE v.code IS NULL), {_FOLD},
d AS (SELECT v.*, coalesce(v.code, CASE WHEN NOT f.accepted THEN 'NO_CAPACITY' END) AS error_code
      FROM v LEFT JOIN fold f ON f.request_id = v.request_id)
"""


@register("book_requests_outcome", _booked_sql() + _OUTCOME)
def q_book_outcome(spark, d):
    """M5, M6 and the insert in one, on top of the existing bookings: the outcome."""
    t = Tables(spark, d)
    return CH.book_requests(t.bookings, numeric_requests(t), t.users, t.batches)[1]


@register("book_requests_table", _booked_sql() + f"""
SELECT id, CAST(user_id AS VARCHAR) AS user_id, CAST(batch_id AS VARCHAR) AS batch_id, name, phone_number,
       guardian_number, email, payment, travellers, room_type, invoice_id FROM bookings
UNION ALL
SELECT {_sha('request_id')}, user_ref, batch_ref, name, phone_number,
       nullif(guardian_number, '') AS guardian_number, email,
       CAST(CAST({_pf('payment')} AS DECIMAL(12, 2)) AS BIGINT) AS payment,
       CAST({_pi('travellers')} AS INTEGER) AS travellers, room_type, 0 AS invoice_id
FROM d WHERE error_code IS NULL""")
def q_book_table(spark, d):
    """M5, M6 and the insert in one: the new bookings table."""
    t = Tables(spark, d)
    return CH.book_requests(t.bookings, numeric_requests(t), t.users, t.batches)[0]


# ------------------------------------------------------------------ M7
@register("direct_bookings", duck_with("bookings") + f"""
SELECT id, CAST(user_id AS VARCHAR) AS user_id, CAST(batch_id AS VARCHAR) AS batch_id, name, phone_number,
       guardian_number, email, payment, travellers, room_type, invoice_id FROM bookings
UNION ALL
SELECT {_sha('o_orderkey')}, CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), concat('D', o_orderkey),
       lpad(CAST(o_custkey AS VARCHAR), 10, '0'), NULL, concat('d', o_orderkey, '@example.com'),
       CAST(CAST(floor(o_totalprice) AS DECIMAL(12, 2)) AS BIGINT), 2, 'double', 0
FROM orders""")
def q_direct(spark, d):
    """M7: one unchecked customer booking per order, appended to bookings."""
    t = Tables(spark, d)
    o = spark.read.parquet(f"{d}/orders.parquet")
    req = o.select(F.col("o_orderkey").cast("string").alias("request_id"),
                   F.col("o_custkey").cast("string").alias("userId"),
                   F.col("o_orderkey").cast("string").alias("batch_id"),
                   F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("fullName"),
                   F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("number"),
                   F.lit(None).cast("string").alias("guardianNumber"),
                   F.concat(F.lit("d"), F.col("o_orderkey").cast("string"), F.lit("@example.com")).alias("email"),
                   F.floor("o_totalprice").cast("bigint").cast("string").alias("payment"),
                   F.lit("2").alias("travellers"), F.lit("double").alias("roomType"))
    return CH.direct_bookings(t.bookings, req)


# ------------------------------------------------------------------ M8
# the name patches one after the other, the trips' names as a map
_TRIP_PATCH_D = duck_with("trips", "trip_patches").replace("WITH ", "WITH RECURSIVE ", 1) + """
, np AS (SELECT tp.request_id, tp.id, tp.name, row_number() OVER (ORDER BY tp.seq) AS k
         FROM trip_patches tp JOIN trips t ON t.id = tp.id WHERE list_contains(set_fields, 'name')),
names AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS request_id, true AS ok,
         map(list(id ORDER BY id), list(destination_name ORDER BY id)) AS m FROM trips
  UNION ALL
  SELECT k, request_id, ok, CASE WHEN ok THEN map_concat(m, MAP {id: name}) ELSE m END
  FROM (SELECT np.k, np.request_id, np.id, np.name, n.m,
               n.m[np.id] = np.name
               OR len([e for e in map_entries(n.m) if e.value = np.name AND e.key <> np.id]) = 0 AS ok
        FROM names n JOIN np ON np.k = n.k + 1)),
p AS (SELECT tp.*, t.id AS cid, n.ok FROM trip_patches tp LEFT JOIN trips t ON t.id = tp.id
      LEFT JOIN names n ON n.request_id = tp.request_id),
d AS (SELECT p.*, CASE WHEN cid IS NULL THEN 'NOT_FOUND' WHEN NOT coalesce(ok, true) THEN 'DUPLICATE_NAME'
        WHEN len(set_fields) = 0 THEN 'NO_FIELDS' END AS error_code FROM p)
"""


@register("patch_trips_outcome", _TRIP_PATCH_D + _OUTCOME)
def q_patch_trips_outcome(spark, d):
    t = Tables(spark, d)
    return CH.apply_patches(t.trips, t.trip_patches, "trips")[1]


@register("patch_trips_table", _TRIP_PATCH_D + f"""
, ok AS (SELECT * FROM d WHERE error_code IS NULL)
SELECT CAST(t.id AS VARCHAR) AS id,
       CASE WHEN list_contains(ok.set_fields, 'name') THEN ok.name ELSE t.destination_name END AS destination_name,
       t.destinations, t.physical_rating,
       CASE WHEN list_contains(ok.set_fields, 'description') THEN ok.description ELSE t.description END
         AS description,
       t.itinerary, t.inclusions, t.excluions, t.days,
       CAST(CASE WHEN list_contains(ok.set_fields, 'nights') THEN {_pi('ok.nights')} ELSE t.nights END AS INTEGER)
         AS nights,
       t.status, t.images
FROM trips t LEFT JOIN ok ON ok.id = t.id""")
def q_patch_trips_table(spark, d):
    t = Tables(spark, d)
    return CH.apply_patches(t.trips, t.trip_patches, "trips")[0]


_BATCH_PATCH_D = duck_with("batches", "batch_patches") + f"""
, p AS (SELECT bp.*, b.id AS cid FROM batch_patches bp LEFT JOIN batches b ON b.id = bp.id),
d AS (SELECT p.*, CASE WHEN cid IS NULL THEN 'NOT_FOUND'
        WHEN list_contains(set_fields, 'startDate') AND list_contains(set_fields, 'endDate')
             AND NOT ({_blank('"startDate"')}) AND NOT ({_blank('"endDate"')})
             AND {_pi('"endDate"')} <= {_pi('"startDate"')} THEN 'INVALID_DATES'
        WHEN len(set_fields) = 0 THEN 'NO_FIELDS' END AS error_code FROM p)
"""


@register("patch_batches_outcome", _BATCH_PATCH_D + _OUTCOME)
def q_patch_batches_outcome(spark, d):
    t = Tables(spark, d)
    return CH.apply_patches(t.batches, t.batch_patches, "batches")[1]


@register("patch_batches_table", _BATCH_PATCH_D + f"""
, ok AS (SELECT * FROM d WHERE error_code IS NULL)
SELECT CAST(b.id AS VARCHAR) AS id, CAST(b.trip_id AS VARCHAR) AS trip_id,
       CASE WHEN list_contains(ok.set_fields, 'startDate') THEN {_pi('ok."startDate"')} ELSE b.from_date END
         AS from_date,
       CASE WHEN list_contains(ok.set_fields, 'endDate') THEN {_pi('ok."endDate"')} ELSE b.to_date END AS to_date,
       b.days, b.nights,
       CASE WHEN list_contains(ok.set_fields, 'standardPrice') THEN {_pi('ok."standardPrice"')} ELSE b.price END
         AS price,
       b.tax, b.max_adventurers,
       CASE WHEN list_contains(ok.set_fields, 'status') THEN lower(ok.status) IN ('true', '1', 't')
            ELSE b.status END AS status,
       b.batch_name, b.single_room, b.double_room, b.triple_room, b.created_at
FROM batches b LEFT JOIN ok ON ok.id = b.id""")
def q_patch_batches_table(spark, d):
    t = Tables(spark, d)
    return CH.apply_patches(t.batches, t.batch_patches, "batches")[0]


_COUPON_PATCHES = """coupon_patches AS (
  SELECT p_partkey AS request_id, p_partkey AS seq, p_partkey + 3 AS id,
         CASE p_partkey % 4 WHEN 0 THEN ['deduction'] WHEN 1 THEN ['startDate', 'status'] WHEN 2 THEN ['endDate'] ELSE [] END AS set_fields,
         CAST(p_size + 1 AS VARCHAR) AS deduction, '1700000000' AS "startDate", CAST(1700000000 + p_partkey AS VARCHAR) || 'x' AS "endDate",
         CASE WHEN p_size % 2 = 0 THEN 'TRUE' ELSE 'no' END AS status FROM part)"""
_COUPON_PATCH_D = duck_with("coupons") + f""", {_COUPON_PATCHES},
p AS (SELECT cp.*, c.id AS cid FROM coupon_patches cp LEFT JOIN coupons c ON c.id = cp.id),
d AS (SELECT p.*, CASE WHEN cid IS NULL THEN 'NOT_FOUND' WHEN len(set_fields) = 0 THEN 'NO_FIELDS' END AS error_code FROM p)
"""


def _coupon_patches(spark, d):
    k = F.col("p_partkey") % 4
    return spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("request_id"), F.col("p_partkey").alias("seq"), (F.col("p_partkey") + 3).alias("id"),
        F.when(k == 0, F.array(F.lit("deduction"))).when(k == 1, F.array(F.lit("startDate"), F.lit("status")))
         .when(k == 2, F.array(F.lit("endDate"))).otherwise(F.array().cast("array<string>")).alias("set_fields"),
        (F.col("p_size") + 1).cast("string").alias("deduction"), F.lit("1700000000").alias("startDate"),
        F.concat((F.col("p_partkey") + 1700000000).cast("string"), F.lit("x")).alias("endDate"),
        F.when(F.col("p_size") % 2 == 0, "TRUE").otherwise("no").alias("status"))


@register("patch_coupons_outcome", _COUPON_PATCH_D + _OUTCOME)
def q_patch_coupons_outcome(spark, d):
    """M8 for coupons: the code cannot change, all other fields can."""
    return CH.apply_patches(Tables(spark, d).coupons, _coupon_patches(spark, d), "coupons")[1]


@register("patch_coupons_table", _COUPON_PATCH_D + f""", ok AS (SELECT * FROM d WHERE error_code IS NULL)
SELECT CAST(c.id AS VARCHAR) AS id, c.code,
       CAST(CASE WHEN list_contains(ok.set_fields, 'deduction') THEN {_pf('ok.deduction')} ELSE c.deduction END AS BIGINT) AS deduction,
       CASE WHEN list_contains(ok.set_fields, 'startDate') THEN {_pi('ok."startDate"')} ELSE c.start_date END AS start_date,
       CASE WHEN list_contains(ok.set_fields, 'endDate') THEN {_pi('ok."endDate"')} ELSE c.end_date END AS end_date,
       CASE WHEN list_contains(ok.set_fields, 'status') THEN lower(ok.status) IN ('true', '1', 't') ELSE c.status END AS status
FROM coupons c LEFT JOIN ok ON ok.id = c.id""")
def q_patch_coupons_table(spark, d):
    return CH.apply_patches(Tables(spark, d).coupons, _coupon_patches(spark, d), "coupons")[0]


_ROLE_D = duck_with("users") + """, asked AS (
  SELECT s_suppkey AS request_id, s_suppkey AS seq, s_suppkey + 2 AS id,
         CASE s_suppkey % 5 WHEN 0 THEN ' Admin ' WHEN 1 THEN 'superadmin' WHEN 2 THEN 'guest' WHEN 3 THEN '' END AS role FROM supplier),
p AS (SELECT a.*, u.id AS cid FROM asked a LEFT JOIN users u ON u.id = a.id),
d AS (SELECT p.*, CASE WHEN coalesce(role, '') = '' THEN 'ROLE_REQUIRED'
        WHEN lower(trim(role)) NOT IN ('user', 'admin', 'superadmin') THEN 'INVALID_ROLE'
        WHEN cid IS NULL THEN 'NOT_FOUND' END AS error_code FROM p)
"""


def _role_patches(spark, d):
    k = F.col("s_suppkey") % 5
    return spark.read.parquet(f"{d}/supplier.parquet").select(
        F.col("s_suppkey").alias("request_id"), F.col("s_suppkey").alias("seq"), (F.col("s_suppkey") + 2).alias("id"),
        F.array(F.lit("role")).alias("set_fields"),
        F.when(k == 0, " Admin ").when(k == 1, "superadmin").when(k == 2, "guest").when(k == 3, "").alias("role"))


@register("patch_user_role_outcome", _ROLE_D + _OUTCOME)
def q_patch_role_outcome(spark, d):
    """M8 for user roles."""
    return CH.apply_patches(Tables(spark, d).users, _role_patches(spark, d), "user_role")[1]


@register("patch_user_role_table", _ROLE_D + """
SELECT CAST(u.id AS VARCHAR) AS id, u.name, u.email, u.phone_number, u.created_at,
       coalesce(lower(trim(d.role)), u.role) AS role, u.gender, u.emergency_contact, u.address
FROM users u LEFT JOIN d ON d.id = u.id AND d.error_code IS NULL""")
def q_patch_role_table(spark, d):
    return CH.apply_patches(Tables(spark, d).users, _role_patches(spark, d), "user_role")[0]


_PROFILE_D = duck_with("users") + """, asked AS (
  SELECT s_suppkey AS request_id, s_suppkey AS seq, s_suppkey + 2 AS id, concat('N', s_suppkey) AS name,
         CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '0' || s_suppkey END AS phone,
         CASE WHEN s_suppkey % 2 = 0 THEN 'f' END AS gender, concat('A ', s_nationkey) AS address FROM supplier),
d AS (SELECT a.*, CASE WHEN u.id IS NULL THEN 'NOT_FOUND' END AS error_code FROM asked a LEFT JOIN users u ON u.id = a.id)
"""


def _profile_patches(spark, d):
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(
        k.alias("request_id"), k.alias("seq"), (k + 2).alias("id"), F.array().cast("array<string>").alias("set_fields"),
        F.concat(F.lit("N"), k.cast("string")).alias("name"),
        F.when(k % 3 != 0, F.concat(F.lit("0"), k.cast("string"))).alias("phoneNumber"), F.when(k % 2 == 0, "f").alias("gender"),
        F.concat(F.lit("A "), F.col("s_nationkey").cast("string")).alias("address"))


@register("patch_user_profile_outcome", _PROFILE_D + _OUTCOME)
def q_patch_profile_outcome(spark, d):
    """M8 for user profiles."""
    return CH.apply_patches(Tables(spark, d).users, _profile_patches(spark, d), "user_profile")[1]


@register("patch_user_profile_table", _PROFILE_D + """
SELECT CAST(u.id AS VARCHAR) AS id, CASE WHEN d.id IS NULL THEN u.name ELSE d.name END AS name, u.email,
       CASE WHEN d.id IS NULL THEN u.phone_number ELSE d.phone END AS phone_number, u.created_at, u.role,
       CASE WHEN d.id IS NULL THEN u.gender ELSE d.gender END AS gender,
       CASE WHEN d.id IS NULL THEN u.emergency_contact END AS emergency_contact,
       CASE WHEN d.id IS NULL THEN u.address ELSE d.address END AS address
FROM users u LEFT JOIN d ON d.id = u.id AND d.error_code IS NULL""")
def q_patch_profile_table(spark, d):
    """All five profile fields are set, those not given to null."""
    return CH.apply_patches(Tables(spark, d).users, _profile_patches(spark, d), "user_profile")[0]


# ------------------------------------------------------------------ J8, M10-M13
def _inactive_trip_ids(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("request_id"),
                                                  F.col("c_custkey").alias("id"))


@register("cascade_keys", duck_with("bookings", "batches") + """
SELECT * FROM bookings WHERE batch_id IN (SELECT id FROM batches WHERE trip_id IN
  (SELECT c_custkey FROM customer WHERE c_acctbal < 0))""")
def q_cascade_keys(spark, d):
    """Bookings of the batches of every trip asked for deletion."""
    t = Tables(spark, d)
    return CH.cascade_keys(t.bookings, t.batches, _inactive_trip_ids(spark, d))


_CASCADE = duck_with("trips", "batches", "bookings") + """
, req AS (SELECT c_custkey AS request_id, c_custkey AS id FROM customer WHERE c_acctbal < 0),
gone AS (SELECT id FROM req WHERE id IN (SELECT id FROM trips))
"""


@register("delete_trips_outcome", _CASCADE + """
SELECT request_id, id IN (SELECT id FROM gone) AS accepted,
       CASE WHEN id NOT IN (SELECT id FROM gone) THEN 'NOT_FOUND' END AS error_code FROM req""")
def q_delete_trips_outcome(spark, d):
    t = Tables(spark, d)
    return CH.delete_trips_cascade(t.trips, t.batches, t.bookings, _inactive_trip_ids(spark, d))[3]


@register("delete_trips_batches", _CASCADE + "SELECT * FROM batches WHERE trip_id NOT IN (SELECT id FROM gone)")
def q_delete_trips_batches(spark, d):
    t = Tables(spark, d)
    return CH.delete_trips_cascade(t.trips, t.batches, t.bookings, _inactive_trip_ids(spark, d))[1]


@register("delete_trips_bookings", _CASCADE + """
SELECT * FROM bookings WHERE batch_id NOT IN (SELECT id FROM batches WHERE trip_id IN (SELECT id FROM gone))""")
def q_delete_trips_bookings(spark, d):
    t = Tables(spark, d)
    return CH.delete_trips_cascade(t.trips, t.batches, t.bookings, _inactive_trip_ids(spark, d))[2]


@register("delete_trips_trips", _CASCADE + "SELECT * FROM trips WHERE id NOT IN (SELECT id FROM gone)")
def q_delete_trips_trips(spark, d):
    t = Tables(spark, d)
    return CH.delete_trips_cascade(t.trips, t.batches, t.bookings, _inactive_trip_ids(spark, d))[0]


def _restricted_sql(table: str, ref: str, req: str) -> str:
    return f"""
, req AS ({req}),
d AS (SELECT request_id, id, CASE WHEN id NOT IN (SELECT id FROM {table}) THEN 'NOT_FOUND'
        WHEN id IN (SELECT {ref} FROM bookings) THEN 'HAS_BOOKINGS' END AS error_code FROM req)
"""


_BATCH_DEL = duck_with("batches", "bookings") + _restricted_sql(
    "batches", "batch_id", "SELECT o_orderkey AS request_id, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'")


def _final_orders(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("request_id"),
                                                         F.col("o_orderkey").alias("id"))


@register("delete_batches_outcome", _BATCH_DEL + _OUTCOME)
def q_delete_batches_outcome(spark, d):
    """M11 for every finished departure."""
    t = Tables(spark, d)
    return CH.delete_batches_restricted(t.batches, t.bookings, _final_orders(spark, d))[1]


@register("delete_batches_table", _BATCH_DEL + """
SELECT * FROM batches WHERE id NOT IN (SELECT id FROM d WHERE error_code IS NULL)""")
def q_delete_batches_table(spark, d):
    t = Tables(spark, d)
    return CH.delete_batches_restricted(t.batches, t.bookings, _final_orders(spark, d))[0]


_USER_DEL = duck_with("users", "bookings") + _restricted_sql(
    "users", "user_id", "SELECT s_suppkey AS request_id, s_suppkey AS id FROM supplier WHERE s_acctbal < 0")


def _negative_suppliers(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("request_id"),
                                                  F.col("s_suppkey").alias("id"))


@register("delete_users_outcome", _USER_DEL + _OUTCOME)
def q_delete_users_outcome(spark, d):
    t = Tables(spark, d)
    return CH.delete_users_restricted(t.users, t.bookings, _negative_suppliers(spark, d))[1]


@register("delete_users_table", _USER_DEL + """
SELECT * FROM users WHERE id NOT IN (SELECT id FROM d WHERE error_code IS NULL)""")
def q_delete_users_table(spark, d):
    t = Tables(spark, d)
    return CH.delete_users_restricted(t.users, t.bookings, _negative_suppliers(spark, d))[0]


def _small_parts(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.where(F.col("p_size") < 10).select(F.col("p_partkey").alias("request_id"),
                                                F.col("p_partkey").alias("id"))


_COUPON_DEL = duck_with("coupons") + """
, req AS (SELECT p_partkey AS request_id, p_partkey AS id FROM part WHERE p_size < 10),
d AS (SELECT request_id, id, CASE WHEN id NOT IN (SELECT id FROM coupons) THEN 'NOT_FOUND' END AS error_code
      FROM req)
"""


@register("delete_coupons_outcome", _COUPON_DEL + _OUTCOME)
def q_delete_coupons_outcome(spark, d):
    t = Tables(spark, d)
    return CH.delete_rows(t.coupons, _small_parts(spark, d), report_missing=True)[1]


@register("delete_coupons_table", _COUPON_DEL + "SELECT * FROM coupons WHERE id NOT IN (SELECT id FROM req)")
def q_delete_coupons_table(spark, d):
    t = Tables(spark, d)
    return CH.delete_rows(t.coupons, _small_parts(spark, d), report_missing=True)[0]


def _low_value_events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.where(F.col("value") < 10).select(F.col("event_id").alias("request_id"),
                                               F.col("event_id").alias("id"))


@register("delete_leads_outcome", """
SELECT event_id AS request_id, true AS accepted, CAST(NULL AS VARCHAR) AS error_code
FROM events WHERE value < 10""")
def q_delete_leads_outcome(spark, d):
    """M13 for leads: unknown ids are not reported."""
    t = Tables(spark, d)
    return CH.delete_rows(t.leads, _low_value_events(spark, d), report_missing=False)[1]


@register("delete_leads_table", duck_with("leads") + """
SELECT * FROM leads WHERE id NOT IN (SELECT event_id FROM events WHERE value < 10)""")
def q_delete_leads_table(spark, d):
    t = Tables(spark, d)
    return CH.delete_rows(t.leads, _low_value_events(spark, d), report_missing=False)[0]


# ------------------------------------------------------------------ M13 bookings
# Requests: the bookings of up to 4 travellers, every third id unknown. Files: one
# invoice per booking beside the trips' media.
_BOOKING_DEL = duck_with("bookings", "media") + """
, req AS (SELECT id AS request_id, CASE WHEN travellers = 3 THEN concat(id, 'x') ELSE id END AS id
          FROM bookings WHERE travellers <= 4),
files AS (SELECT key, size, last_modified FROM media
          UNION ALL SELECT concat(id, '.pdf'), 1, CAST(NULL AS TIMESTAMP) FROM bookings),
d AS (SELECT request_id, CASE WHEN id NOT IN (SELECT id FROM bookings) THEN 'NOT_FOUND' END AS error_code FROM req)
"""


def _booking_deletes(spark, d):
    t = Tables(spark, d)
    small = t.bookings.where(F.col("travellers") <= 4)
    ids = small.select(F.col("id").alias("request_id"),
                       F.when(F.col("travellers") == 3, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"))
    invoices = t.bookings.select(F.concat("id", F.lit(".pdf")).alias("key"), F.lit(1).cast("bigint").alias("size"),
                                 F.lit(None).cast(t.media.schema["last_modified"].dataType).alias("last_modified"))
    return CH.delete_bookings(t.bookings, t.media.unionByName(invoices), ids)


@register("delete_bookings_table", _BOOKING_DEL + "SELECT * FROM bookings WHERE id NOT IN (SELECT id FROM req)")
def q_delete_bookings_table(spark, d):
    return _booking_deletes(spark, d)[0]


@register("delete_bookings_files", _BOOKING_DEL + """
SELECT * FROM files WHERE key NOT IN (SELECT concat(id, '.pdf') FROM req)""")
def q_delete_bookings_files(spark, d):
    """The manifest without the deleted bookings' files."""
    return _booking_deletes(spark, d)[1]


@register("delete_bookings_outcome", _BOOKING_DEL + _OUTCOME)
def q_delete_bookings_outcome(spark, d):
    return _booking_deletes(spark, d)[2]
