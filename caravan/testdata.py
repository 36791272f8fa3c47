"""Adapter: the driver's TPC-H-like tables shown as the domain tables.

Each view is a plain projection of one whole source table; some child rows get
a reference to an id that does not exist (``NO_SUCH`` added), so that left joins
see missing parents and some parents have no child. Only the two ``events`` views
filter, by the event type that defines them. It does none of an operator's work. The same views are given as
DuckDB text in ``DUCK_VIEWS`` so oracle queries run on identical input.

``as_of`` is the fixed clock used by every time-dependent query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = 978307200  # 2001-01-01T00:00:00Z
NO_SUCH = 900000000  # added to a key: an id that no table holds


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _epoch(c: str) -> Column:
    # files hold TIMESTAMP_NTZ; the session zone is UTC
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _dangling(c: str, every: int, rest: int) -> Column:
    """The key, or an id that does not exist where key % every = rest."""
    k = F.col(c).cast("bigint")
    return F.when(k % every == rest, k + NO_SUCH).otherwise(k)


def _user_key() -> Column:
    return _dangling("l_suppkey", 10, 7)


def _batch_key(c: str = "l_orderkey") -> Column:
    return _dangling(c, 50, 13)


def _trip_key(c: str = "o_custkey") -> Column:
    return _dangling(c, 25, 11)


def users(spark, d):
    s = _read(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"),
        F.lpad(_s("s_suppkey"), 10, "0").alias("phone_number"),
        (F.lit(900000000) + F.expr("s_suppkey div 3") * 3600).alias("created_at"),
        F.when(F.col("s_suppkey") % 10 == 0, "admin").otherwise("user").alias("role"),
        F.lit(None).cast("string").alias("gender"),
        F.lit(None).cast("string").alias("emergency_contact"),
        F.lit(None).cast("string").alias("address"),
    )


def trips(spark, d):
    c = _read(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("destination_name"),
        F.col("c_mktsegment").alias("destinations"),
        (F.col("c_nationkey") % 5 + 1).alias("physical_rating"),
        F.concat(F.lit("Tour of "), F.col("c_name")).alias("description"),
        F.concat(F.lit('{"1":{"title":"Arrival","content":"'), F.col("c_name"),
                 F.lit('"},"2":{"title":"'), F.col("c_mktsegment"),
                 F.lit('","content":"Day two"}}')).alias("itinerary"),
        F.lit("").alias("inclusions"),
        F.lit("").alias("excluions"),
        _s(F.col("c_nationkey") % 10 + 2).alias("days"),
        (F.col("c_nationkey") % 10 + 1).alias("nights"),
        (F.col("c_acctbal") >= 0).alias("status"),
        F.lit(None).cast("int").alias("images"),
    )


def batches(spark, d):
    o = _read(spark, d, "orders")
    days = F.col("o_orderkey") % 10 + 1
    return o.select(
        F.col("o_orderkey").alias("id"),
        _trip_key().alias("trip_id"),
        _epoch("o_orderdate").alias("from_date"),
        (_epoch("o_orderdate") + days * 86400).alias("to_date"),
        days.alias("days"),
        (days - 1).alias("nights"),
        F.floor("o_totalprice").cast("bigint").alias("price"),
        F.lit(0).cast("bigint").alias("tax"),
        (F.lit(80) + F.col("o_orderkey") % 60).alias("max_adventurers"),
        (F.col("o_orderstatus") != "F").alias("status"),
        F.concat(F.lit("B"), _s("o_orderkey")).alias("batch_name"),
        (F.col("o_orderkey") % 4).alias("single_room"),
        (F.col("o_orderkey") % 5).alias("double_room"),
        (F.col("o_orderkey") % 2).alias("triple_room"),
        (_epoch("o_orderdate") - 2592000).alias("created_at"),
    )


def _booking_id() -> Column:
    return F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"),
                      _s("l_suppkey"), _s(F.expr("unix_timestamp(cast(l_shipdate as timestamp)) div 86400")))


def _room_type() -> Column:
    return (F.when(F.col("l_returnflag") == "A", "single")
            .when(F.col("l_returnflag") == "N", "double").otherwise("triple"))


def bookings(spark, d):
    li = _read(spark, d, "lineitem")
    return li.select(
        _booking_id().alias("id"),
        _user_key().alias("user_id"),
        _batch_key().alias("batch_id"),
        F.concat(F.lit("P"), _s("l_partkey")).alias("name"),
        F.lpad(_s("l_suppkey"), 10, "0").alias("phone_number"),
        F.lit(None).cast("string").alias("guardian_number"),
        F.concat(F.lit("p"), _s("l_partkey"), F.lit("@example.com")).alias("email"),
        F.floor("l_extendedprice").cast("bigint").alias("payment"),
        F.floor("l_quantity").cast("int").alias("travellers"),
        _room_type().alias("room_type"),
        F.lit(0).alias("invoice_id"),
    )


def booking_requests(spark, d):
    li = _read(spark, d, "lineitem")
    return li.select(
        _booking_id().alias("request_id"),
        _booking_id().alias("seq"),
        _s(_user_key()).alias("user_ref"),
        _s(_batch_key()).alias("batch_ref"),
        F.concat(F.lit("P"), _s("l_partkey")).alias("name"),
        F.lpad(_s("l_suppkey"), 10, "0").alias("phone_number"),
        F.when(F.col("l_linenumber") == 2, F.lpad(_s("l_partkey"), 10, "0"))
         .when(F.col("l_linenumber") == 3, F.lpad(_s("l_partkey"), 9, "0"))
         .alias("guardian_number"),
        F.concat(F.lit("p"), _s("l_partkey"), F.lit("@example.com")).alias("email"),
        _s(F.floor("l_extendedprice").cast("bigint")).alias("payment"),
        _s(F.floor("l_quantity").cast("bigint")).alias("travellers"),
        _room_type().alias("room_type"),
        F.lit(True).alias("has_invoice"),
    )


def coupons(spark, d):
    p = _read(spark, d, "part")
    start = F.lit(1704067200) + (F.col("p_partkey") % 20) * 86400
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("K"), _s("p_partkey")).alias("code"),
        (F.col("p_size") * 10).alias("deduction"),
        start.alias("start_date"),
        (start + (F.col("p_size") % 10 + 1) * 86400).alias("end_date"),
        (F.col("p_partkey") % 7 != 0).alias("status"),
    )


def coupon_attempts(spark, d):
    e = _read(spark, d, "events")
    return e.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("attempt_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 31 == 0, F.lit(" "))
         .otherwise(F.concat(F.when(F.col("event_id") % 9 == 4, " none").otherwise(" k"),
                               F.get_json_object("props", "$.k"), F.lit(" ")))
         .alias("code_raw"),
    )


def leads(spark, d):
    e = _read(spark, d, "events")
    return e.where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 2 == 0, "group").otherwise("solo").alias("type"),
        F.concat(F.lit("L"), _s("user_id")).alias("name"),
        F.lit("unknown").alias("location"),
        (F.col("user_id") % 8 + 1).alias("travellers"),
        (F.col("user_id") % 6 + 2).alias("days"),
        F.concat(F.lit("l"), _s("user_id"), F.lit("@example.com")).alias("email"),
        F.lpad(_s("user_id"), 10, "0").alias("phone"),
        F.col("props").alias("message"),
        F.floor("value").cast("bigint").alias("budget"),
        _s(F.col("ts").cast("date")).alias("date"),
        _epoch("ts").alias("created_at"),
    )


def media(spark, d):
    o = _read(spark, d, "orders")
    return o.select(
        F.concat(F.lit("trips/customer-"), F.lpad(_s(_trip_key()), 9, "0"), F.lit("_"),
                 F.when(F.col("o_orderkey") % 11 == 0,
                        F.concat(F.lit("itinerary-"), _s("o_orderkey"), F.lit(".pdf")))
                  .otherwise(F.concat(_s("o_orderkey"), F.lit(".jpg")))).alias("key"),
        (F.col("o_orderkey") * 10).alias("size"),
        F.col("o_orderdate").alias("last_modified"),  # kept TIMESTAMP_NTZ: no zone on collect
    )


VIEWS = {
    "users": users, "trips": trips, "batches": batches, "bookings": bookings,
    "booking_requests": booking_requests, "coupons": coupons,
    "coupon_attempts": coupon_attempts, "leads": leads, "media": media,
}



# ------------------------------------------------ request tables (stand-in input)
# Requests for the bulk-change operators, one per source row. They only give
# rows in the request schema (text fields, as in form bodies); which of them
# pass is decided by the operators.
def _days_json(name_col) -> Column:
    return F.concat(F.lit('{"1":{"title":"Arrival","content":"'), name_col, F.lit('"}}'))


def trip_requests(spark, d):
    c = _read(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("seq"),
        F.when(F.col("c_custkey") % 25 == 11, F.concat(F.lit("New "), F.col("c_name"))).otherwise(F.col("c_name"))
         .alias("name"),
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.concat(F.lit("Tour of "), F.col("c_name")))
         .alias("description"),
        _s(F.col("c_nationkey") % 10 + 2).alias("numberOfDays"),
        F.when(F.col("c_custkey") % 13 == 0, F.lit('{"1":{"title":"Arrival"'))
         .otherwise(_days_json(F.col("c_name"))).alias("daysData"),
        _s(F.col("c_nationkey") % 10 + 2).alias("days"),
        _s(F.col("c_nationkey") % 10 + 1).alias("nights"),
        F.col("c_mktsegment").alias("destinations"),
        _s(F.col("c_nationkey") % 5 + 1).alias("physicalRating"),
        (F.col("c_nationkey") % 4).alias("n_images"),
        F.lit(True).alias("has_itinerary"),
    )


def batch_requests(spark, d):
    o = _read(spark, d, "orders")
    start = _epoch("o_orderdate")
    length = F.when(F.col("o_orderkey") % 17 == 0, F.lit(0)).otherwise((F.col("o_orderkey") % 10 + 1) * 86400)
    return o.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("B"), _s("o_orderkey")))
         .otherwise(F.concat(F.lit("N"), _s(F.expr("o_orderkey div 3")))).alias("batchName"),
        _s(_trip_key()).alias("assignedTrip"),
        _s(start).alias("startDate"), _s(start + length).alias("endDate"),
        _s(F.floor("o_totalprice").cast("bigint")).alias("standardPrice"),
        F.lit(None).cast("string").alias("singleRoom"), F.lit("2").alias("doubleRoom"),
        F.lit("0").alias("tripleRoom"), F.lit("0").alias("tax"),
        _s(F.lit(80) + F.col("o_orderkey") % 60).alias("maxAdventurers"),
        F.lit(None).cast("string").alias("createdAt"), F.lit(None).cast("string").alias("status"),
    )


def coupon_requests(spark, d):
    p = _read(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("request_id"), F.col("p_partkey").alias("seq"),
        F.concat(F.when(F.col("p_partkey") % 9 == 4, "NEW").otherwise("K"), _s(F.col("p_partkey") % 150))
         .alias("couponCode"),
        F.when(F.col("p_size") % 10 == 0, F.lit("")).otherwise(_s(F.col("p_size") * 10)).alias("deduction"),
        F.lit("1704067200").alias("startDate"),
        _s(F.lit(1704067200) + F.col("p_size") * 86400).alias("endDate"),
    )


def user_requests(spark, d):
    s = _read(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("request_id"), F.col("s_suppkey").alias("seq"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("bad"), _s("s_suppkey")))
         .when(F.col("s_suppkey") % 10 == 7, F.concat(F.lit("new."), F.lower("s_name"), F.lit("@example.com")))
         .otherwise(F.concat(F.lower("s_name"), F.lit("@example.com"))).alias("email"),
        F.lpad(_s("s_suppkey"), 10, "0").alias("phoneNumber"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit(" Admin "))
         .when(F.col("s_suppkey") % 3 == 1, F.lit("user")).otherwise(F.lit("guest")).alias("role"),
    )


def booking_updates(spark, d):
    li = _read(spark, d, "lineitem")
    bid = _booking_id()
    return li.select(
        F.when(F.col("l_linenumber") == 4, F.concat(bid, F.lit("-x"))).otherwise(bid).alias("id"),
        bid.alias("request_id"), bid.alias("seq"),
        _s(_user_key()).alias("user_ref"), _s(_batch_key()).alias("batch_ref"),
        F.concat(F.lit("P"), _s("l_partkey")).alias("name"),
        F.lpad(_s("l_suppkey"), 10, "0").alias("phone_number"),
        F.lit(None).cast("string").alias("guardian_number"),
        F.concat(F.lit("p"), _s("l_partkey"), F.lit("@example.com")).alias("email"),
        _s(F.floor("l_extendedprice").cast("bigint")).alias("payment"),
        _s(F.floor("l_quantity").cast("bigint") + 1).alias("travellers"),
        _room_type().alias("room_type"),
        F.lit(True).alias("has_invoice"),
    )


def trip_patches(spark, d):
    c = _read(spark, d, "customer")
    k = F.col("c_nationkey") % 3
    return c.select(
        F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("seq"),
        _trip_key("c_custkey").alias("id"),
        F.when(k == 0, F.array(F.lit("name"))).when(k == 1, F.array(F.lit("description"), F.lit("nights")))
         .otherwise(F.array().cast("array<string>")).alias("set_fields"),
        F.concat(F.lit("Customer#"), F.lpad(_s(F.col("c_custkey") + 1), 9, "0")).alias("name"),
        F.concat(F.lit("Updated "), F.col("c_name")).alias("description"),
        _s(F.col("c_nationkey") % 7 + 1).alias("nights"),
    )


def batch_patches(spark, d):
    o = _read(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    start = _epoch("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("seq"),
        _batch_key("o_orderkey").alias("id"),
        F.when(k == 0, F.array(F.lit("startDate"), F.lit("endDate")))
         .when(k == 1, F.array(F.lit("standardPrice"), F.lit("status")))
         .when(k == 2, F.array(F.lit("endDate")))
         .otherwise(F.array().cast("array<string>")).alias("set_fields"),
        _s(start).alias("startDate"),
        F.when(k == 0, _s(start - 86400)).otherwise(_s(start + 864000)).alias("endDate"),
        _s(F.floor("o_totalprice").cast("bigint") + 100).alias("standardPrice"),
        F.lit("false").alias("status"),
    )


REQUESTS = {"trip_requests": trip_requests, "batch_requests": batch_requests,
            "coupon_requests": coupon_requests, "user_requests": user_requests,
            "booking_updates": booking_updates, "trip_patches": trip_patches,
            "batch_patches": batch_patches}
VIEWS.update(REQUESTS)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)


class Tables:
    """Lazy accessor: ``Tables(spark, d).trips`` etc."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return VIEWS[name](self.spark, self.sf_dir)
        raise AttributeError(name)


# ---------------------------------------------------------------- DuckDB text
_EPOCH = "(epoch_us({c}) // 1000000)"
_BOOKING_ID = ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
               "epoch_us(l_shipdate) // 1000000 // 86400)")
_USER_KEY = f"CASE WHEN l_suppkey % 10 = 7 THEN l_suppkey + {NO_SUCH} ELSE l_suppkey END"
_BATCH_KEY = f"CASE WHEN l_orderkey % 50 = 13 THEN l_orderkey + {NO_SUCH} ELSE l_orderkey END"
_TRIP_KEY = f"CASE WHEN o_custkey % 25 = 11 THEN o_custkey + {NO_SUCH} ELSE o_custkey END"
_ROOM = "CASE l_returnflag WHEN 'A' THEN 'single' WHEN 'N' THEN 'double' ELSE 'triple' END"

DUCK_VIEWS = {
    "users": """SELECT s_suppkey AS id, s_name AS name,
        concat(lower(s_name), '@example.com') AS email,
        lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS phone_number,
        900000000 + (s_suppkey // 3) * 3600 AS created_at,
        CASE WHEN s_suppkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role,
        CAST(NULL AS VARCHAR) AS gender, CAST(NULL AS VARCHAR) AS emergency_contact,
        CAST(NULL AS VARCHAR) AS address
      FROM supplier""",
    "trips": """SELECT c_custkey AS id, c_name AS destination_name, c_mktsegment AS destinations,
        c_nationkey % 5 + 1 AS physical_rating, concat('Tour of ', c_name) AS description,
        concat('{"1":{"title":"Arrival","content":"', c_name, '"},"2":{"title":"', c_mktsegment,
               '","content":"Day two"}}') AS itinerary,
        '' AS inclusions, '' AS excluions, CAST(c_nationkey % 10 + 2 AS VARCHAR) AS days,
        c_nationkey % 10 + 1 AS nights, c_acctbal >= 0 AS status, CAST(NULL AS INTEGER) AS images
      FROM customer""",
    "batches": f"""SELECT o_orderkey AS id, {_TRIP_KEY} AS trip_id,
        {_EPOCH.format(c='o_orderdate')} AS from_date,
        {_EPOCH.format(c='o_orderdate')} + (o_orderkey % 10 + 1) * 86400 AS to_date,
        o_orderkey % 10 + 1 AS days, o_orderkey % 10 AS nights,
        CAST(floor(o_totalprice) AS BIGINT) AS price, CAST(0 AS BIGINT) AS tax,
        80 + o_orderkey % 60 AS max_adventurers, o_orderstatus <> 'F' AS status,
        concat('B', o_orderkey) AS batch_name, o_orderkey % 4 AS single_room,
        o_orderkey % 5 AS double_room, o_orderkey % 2 AS triple_room,
        {_EPOCH.format(c='o_orderdate')} - 2592000 AS created_at
      FROM orders""",
    "bookings": f"""SELECT {_BOOKING_ID} AS id, {_USER_KEY} AS user_id, {_BATCH_KEY} AS batch_id,
        concat('P', l_partkey) AS name, lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS phone_number,
        CAST(NULL AS VARCHAR) AS guardian_number, concat('p', l_partkey, '@example.com') AS email,
        CAST(floor(l_extendedprice) AS BIGINT) AS payment,
        CAST(floor(l_quantity) AS INTEGER) AS travellers, {_ROOM} AS room_type, 0 AS invoice_id
      FROM lineitem""",
    "booking_requests": f"""SELECT {_BOOKING_ID} AS request_id, {_BOOKING_ID} AS seq,
        CAST({_USER_KEY} AS VARCHAR) AS user_ref, CAST({_BATCH_KEY} AS VARCHAR) AS batch_ref,
        concat('P', l_partkey) AS name, lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS phone_number,
        CASE WHEN l_linenumber = 2 THEN lpad(CAST(l_partkey AS VARCHAR), 10, '0')
             WHEN l_linenumber = 3 THEN lpad(CAST(l_partkey AS VARCHAR), 9, '0') END AS guardian_number,
        concat('p', l_partkey, '@example.com') AS email,
        CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS payment,
        CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) AS travellers,
        {_ROOM} AS room_type, true AS has_invoice
      FROM lineitem""",
    "coupons": """SELECT p_partkey AS id, concat('K', p_partkey) AS code, p_size * 10 AS deduction,
        1704067200 + (p_partkey % 20) * 86400 AS start_date,
        1704067200 + (p_partkey % 20) * 86400 + (p_size % 10 + 1) * 86400 AS end_date,
        p_partkey % 7 <> 0 AS status
      FROM part""",
    "coupon_attempts": """SELECT event_id AS attempt_id, ts,
        CASE WHEN event_id % 31 = 0 THEN ' '
             ELSE concat(CASE WHEN event_id % 9 = 4 THEN ' none' ELSE ' k' END, json_extract_string(props, '$.k'), ' ') END AS code_raw
      FROM events WHERE event_type = 'purchase'""",
    "leads": f"""SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'group' ELSE 'solo' END AS type,
        concat('L', user_id) AS name, 'unknown' AS location, user_id % 8 + 1 AS travellers,
        user_id % 6 + 2 AS days, concat('l', user_id, '@example.com') AS email,
        lpad(CAST(user_id AS VARCHAR), 10, '0') AS phone, props AS message,
        CAST(floor(value) AS BIGINT) AS budget, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
        {_EPOCH.format(c='ts')} AS created_at
      FROM events WHERE event_type = 'signup'""",
    "media": f"""SELECT concat('trips/customer-', lpad(CAST({_TRIP_KEY} AS VARCHAR), 9, '0'), '_',
          CASE WHEN o_orderkey % 11 = 0 THEN concat('itinerary-', o_orderkey, '.pdf')
               ELSE concat(o_orderkey, '.jpg') END) AS key,
        o_orderkey * 10 AS size, o_orderdate AS last_modified
      FROM orders""",
}


_DAYS_JSON = "concat('{\"1\":{\"title\":\"Arrival\",\"content\":\"', c_name, '\"}}')"
DUCK_VIEWS.update({
    "trip_requests": f"""SELECT c_custkey AS request_id, c_custkey AS seq,
        CASE WHEN c_custkey % 25 = 11 THEN concat('New ', c_name) ELSE c_name END AS name,
        CASE WHEN c_acctbal < 0 THEN '' ELSE concat('Tour of ', c_name) END AS description,
        CAST(c_nationkey % 10 + 2 AS VARCHAR) AS "numberOfDays",
        CASE WHEN c_custkey % 13 = 0 THEN '{{"1":{{"title":"Arrival"'
             ELSE {_DAYS_JSON} END AS "daysData",
        CAST(c_nationkey % 10 + 2 AS VARCHAR) AS days, CAST(c_nationkey % 10 + 1 AS VARCHAR) AS nights,
        c_mktsegment AS destinations, CAST(c_nationkey % 5 + 1 AS VARCHAR) AS "physicalRating",
        c_nationkey % 4 AS n_images, true AS has_itinerary FROM customer""",
    "batch_requests": f"""SELECT o_orderkey AS request_id, o_orderkey AS seq,
        CASE WHEN o_orderkey % 4 = 0 THEN concat('B', o_orderkey) ELSE concat('N', o_orderkey // 3) END
          AS "batchName",
        CAST({_TRIP_KEY} AS VARCHAR) AS "assignedTrip",
        CAST({_EPOCH.format(c='o_orderdate')} AS VARCHAR) AS "startDate",
        CAST({_EPOCH.format(c='o_orderdate')} + CASE WHEN o_orderkey % 17 = 0 THEN 0
             ELSE (o_orderkey % 10 + 1) * 86400 END AS VARCHAR) AS "endDate",
        CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS "standardPrice",
        CAST(NULL AS VARCHAR) AS "singleRoom", '2' AS "doubleRoom", '0' AS "tripleRoom", '0' AS tax,
        CAST(80 + o_orderkey % 60 AS VARCHAR) AS "maxAdventurers",
        CAST(NULL AS VARCHAR) AS "createdAt", CAST(NULL AS VARCHAR) AS status FROM orders""",
    "coupon_requests": """SELECT p_partkey AS request_id, p_partkey AS seq,
        concat(CASE WHEN p_partkey % 9 = 4 THEN 'NEW' ELSE 'K' END, p_partkey % 150) AS "couponCode",
        CASE WHEN p_size % 10 = 0 THEN '' ELSE CAST(p_size * 10 AS VARCHAR) END AS deduction,
        '1704067200' AS "startDate", CAST(1704067200 + p_size * 86400 AS VARCHAR) AS "endDate"
      FROM part""",
    "user_requests": """SELECT s_suppkey AS request_id, s_suppkey AS seq, s_name AS name,
        CASE WHEN s_suppkey % 5 = 0 THEN concat('bad', s_suppkey)
             WHEN s_suppkey % 10 = 7 THEN concat('new.', lower(s_name), '@example.com')
             ELSE concat(lower(s_name), '@example.com') END AS email,
        lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS "phoneNumber",
        CASE WHEN s_suppkey % 3 = 0 THEN ' Admin ' WHEN s_suppkey % 3 = 1 THEN 'user' ELSE 'guest' END AS role
      FROM supplier""",
    "booking_updates": f"""SELECT CASE WHEN l_linenumber = 4 THEN concat({_BOOKING_ID}, '-x')
          ELSE {_BOOKING_ID} END AS id,
        {_BOOKING_ID} AS request_id, {_BOOKING_ID} AS seq,
        CAST({_USER_KEY} AS VARCHAR) AS user_ref, CAST({_BATCH_KEY} AS VARCHAR) AS batch_ref,
        concat('P', l_partkey) AS name, lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS phone_number,
        CAST(NULL AS VARCHAR) AS guardian_number, concat('p', l_partkey, '@example.com') AS email,
        CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS payment,
        CAST(CAST(floor(l_quantity) AS BIGINT) + 1 AS VARCHAR) AS travellers,
        {_ROOM} AS room_type, true AS has_invoice FROM lineitem""",
    "trip_patches": f"""SELECT c_custkey AS request_id, c_custkey AS seq,
        {_TRIP_KEY.replace('o_custkey', 'c_custkey')} AS id,
        CASE WHEN c_nationkey % 3 = 0 THEN ['name'] WHEN c_nationkey % 3 = 1 THEN ['description', 'nights']
             ELSE CAST([] AS VARCHAR[]) END AS set_fields,
        concat('Customer#', lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0')) AS name,
        concat('Updated ', c_name) AS description, CAST(c_nationkey % 7 + 1 AS VARCHAR) AS nights
      FROM customer""",
    "batch_patches": f"""SELECT o_orderkey AS request_id, o_orderkey AS seq,
        {_BATCH_KEY.replace('l_orderkey', 'o_orderkey')} AS id,
        CASE WHEN o_orderkey % 4 = 0 THEN ['startDate', 'endDate']
             WHEN o_orderkey % 4 = 1 THEN ['standardPrice', 'status']
             WHEN o_orderkey % 4 = 2 THEN ['endDate'] ELSE CAST([] AS VARCHAR[]) END AS set_fields,
        CAST({_EPOCH.format(c='o_orderdate')} AS VARCHAR) AS "startDate",
        CAST(CASE WHEN o_orderkey % 4 = 0 THEN {_EPOCH.format(c='o_orderdate')} - 86400
             ELSE {_EPOCH.format(c='o_orderdate')} + 864000 END AS VARCHAR) AS "endDate",
        CAST(CAST(floor(o_totalprice) AS BIGINT) + 100 AS VARCHAR) AS "standardPrice",
        'false' AS status FROM orders""",
})


def duck_with(*names: str) -> str:
    """``WITH`` clause defining the named adapter views for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({DUCK_VIEWS[n]})" for n in names) + "\n"
