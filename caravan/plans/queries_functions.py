"""Column-function queries (F1-F15, U1): each function applied to a whole
table column in one Spark query, checked against the same rule in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravan.functions import columns as FN
from caravan.functions.itinerary import itinerary_table
from caravan.functions.sql import register_functions
from caravan.plans.registry import register
from caravan.testdata import Tables, duck_with

_SLUG = ("regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")


def _pi(c: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({c}, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT)"


def _pf(c: str) -> str:
    return (f"TRY_CAST(nullif(regexp_extract({c}, '^\\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)"
            f"([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE)")


@register("fn_trip_keys", duck_with("trips") + f"""
SELECT id, {_SLUG.format(c='destination_name')} AS slug,
       'trips/' || {_SLUG.format(c='destination_name')} || '_itinerary.pdf' AS itinerary_key,
       'itineraries/' || {_SLUG.format(c='destination_name')} || '_itinerary.pdf' AS created_itinerary_key,
       'banners/' || {_SLUG.format(c='destination_name')} AS banner_written_key,
       CASE WHEN starts_with(lower(trim(destination_name)), 'banners/') THEN lower(trim(destination_name))
            ELSE 'banners/' || lower(trim(destination_name)) END AS banner_read_key
FROM trips""")
def q_fn_trip_keys(spark, d):
    """F1, F14, F15 over every trip name."""
    t = Tables(spark, d).trips
    n = F.col("destination_name")
    return t.select("id", FN.slug(n).alias("slug"),
                    FN.media_key("trip_itinerary", n, ext=F.lit("pdf")).alias("itinerary_key"),
                    FN.media_key("itinerary_dir", n, ext=F.lit("pdf")).alias("created_itinerary_key"),
                    FN.media_key("banner", n).alias("banner_written_key"),
                    FN.banner_key(n).alias("banner_read_key"))


@register("fn_batch_dates", duck_with("batches") + """
SELECT id, CAST(month(make_timestamp(from_date * 1000000)) AS INTEGER) AS from_month_no,
       strftime(make_timestamp(from_date * 1000000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS from_iso,
       strftime(make_timestamp(to_date * 1000000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS to_iso
FROM batches""")
def q_fn_batch_dates(spark, d):
    """F2, F3 over every batch."""
    b = Tables(spark, d).batches
    return b.select("id", FN.epoch_month("from_date").alias("from_month_no"),
                    FN.epoch_iso("from_date").alias("from_iso"), FN.epoch_iso("to_date").alias("to_iso"))


@register("fn_parse_numbers", f"""
SELECT o_orderkey AS id, {_pi('o_orderpriority')} AS priority_int,
       {_pi('CAST(o_totalprice AS VARCHAR)')} AS price_int,
       {_pf('o_orderpriority')} AS priority_float,
       {_pf('o_orderstatus')} AS status_float
FROM orders""")
def q_fn_parse_numbers(spark, d):
    """F4, F5 over order text columns ('1-URGENT' -> 1, 'F' -> null)."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), FN.js_parse_int("o_orderpriority").alias("priority_int"),
                    FN.js_parse_int(F.col("o_totalprice").cast("string")).alias("price_int"),
                    FN.js_parse_float("o_orderpriority").alias("priority_float"),
                    FN.js_parse_float("o_orderstatus").alias("status_float"))


@register("fn_contact_checks", duck_with("user_requests", "booking_requests") + """
SELECT CAST(request_id AS VARCHAR) AS id, coalesce(regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+'), false)
         AS email_ok,
       coalesce(regexp_full_match("phoneNumber", '[0-9]{10}'), false) AS phone_ok,
       lower(trim(role)) AS role_norm, coalesce(lower(trim(role)) IN ('user', 'admin', 'superadmin'), false)
         AS role_ok
FROM user_requests
UNION ALL
SELECT request_id, coalesce(regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+'), false),
       coalesce(regexp_full_match(guardian_number, '[0-9]{10}'), false), NULL, NULL
FROM booking_requests""")
def q_fn_contact_checks(spark, d):
    """F6, F7, F9 over user and booking requests."""
    t = Tables(spark, d)
    u = t.user_requests.select(F.col("request_id").cast("string").alias("id"),
                               FN.is_email("email").alias("email_ok"),
                               FN.is_phone10("phoneNumber").alias("phone_ok"),
                               FN.norm_role("role").alias("role_norm"), FN.is_role("role").alias("role_ok"))
    b = t.booking_requests.select(F.col("request_id").alias("id"), FN.is_email("email").alias("email_ok"),
                                  FN.is_phone10("guardian_number").alias("phone_ok"),
                                  F.lit(None).cast("string").alias("role_norm"),
                                  F.lit(None).cast("boolean").alias("role_ok"))
    return u.unionByName(b)


@register("fn_codes_and_refs", duck_with("coupon_attempts") + """
SELECT attempt_id, CASE WHEN trim(code_raw) = '' THEN NULL ELSE upper(trim(code_raw)) END AS code,
       e.props AS ref_text,
       CASE WHEN regexp_matches(trim(e.props), '^[\\{\\[]') THEN json_extract_string(e.props, '$.id')
            ELSE e.props END AS ref,
       regexp_matches(trim(e.props), '^[\\{\\[]') AND json_valid(e.props) IS NOT TRUE AS ref_bad
FROM coupon_attempts a JOIN events e ON e.event_id = a.attempt_id""")
def q_fn_codes_and_refs(spark, d):
    """F8 over coupon attempts, F10 over the event payload texts."""
    t = Tables(spark, d)
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("_eid"), "props")
    a = t.coupon_attempts.join(e, F.col("attempt_id") == F.col("_eid"))
    return a.select("attempt_id", FN.norm_code("code_raw").alias("code"), F.col("props").alias("ref_text"),
                    FN.ref_id("props").alias("ref"), FN.ref_malformed("props").alias("ref_bad"))


@register("fn_media_keys", duck_with("media") + """
SELECT key, string_split(key, '/')[-1] AS name, string_split(key, '.')[-1] AS ext,
       CASE WHEN contains(lower(key), 'itinerary') THEN 'itinerary' ELSE 'image' END AS kind
FROM media""")
def q_fn_media_keys(spark, d):
    """F12, F13 over the whole manifest."""
    m = Tables(spark, d).media
    return m.select("key", FN.file_name("key").alias("name"), FN.file_ext("key").alias("ext"),
                    FN.media_kind("key").alias("kind"))


@register("itinerary_days", duck_with("trips") + """
SELECT t.id AS trip_id, k AS day, TRY_CAST(k AS INTEGER) AS day_no,
       json_extract_string(t.itinerary, '$."' || k || '".title') AS title,
       json_extract_string(t.itinerary, '$."' || k || '".content') AS content
FROM trips t, unnest(json_keys(t.itinerary)) AS u(k)""")
def q_itinerary_days(spark, d):
    """one row per itinerary day of every trip."""
    return itinerary_table(Tables(spark, d).trips)[0]


@register("sql_functions", duck_with("trips", "users") + f"""
SELECT CAST(t.id AS VARCHAR) AS id, {_SLUG.format(c='t.destination_name')} AS value, 'slug' AS fn FROM trips t
UNION ALL
SELECT CAST(u.id AS VARCHAR), CAST(regexp_full_match(u.email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') AS VARCHAR),
       'is_email' FROM users u""")
def q_sql_functions(spark, d):
    """The registered SQL functions called from Spark SQL over whole tables."""
    register_functions(spark)
    t = Tables(spark, d)
    t.trips.createOrReplaceTempView("caravan_trips")
    t.users.createOrReplaceTempView("caravan_users")
    return spark.sql("""
        SELECT CAST(id AS STRING) AS id, slug(destination_name) AS value, 'slug' AS fn FROM caravan_trips
        UNION ALL
        SELECT CAST(id AS STRING), CAST(is_email(email) AS STRING), 'is_email' FROM caravan_users""")


_ODD_ITINERARY = ("CASE id % 5 WHEN 1 THEN replace(itinerary, '\"', '') WHEN 2 THEN concat(itinerary, ' x') WHEN 3 THEN NULL "
                  "WHEN 4 THEN substr(itinerary, 1, 20) ELSE itinerary END")


@register("itinerary_rejects", duck_with("trips") + f"""
SELECT id AS trip_id, itinerary FROM (SELECT id, {_ODD_ITINERARY} AS itinerary FROM trips)
WHERE NOT json_valid(itinerary)""")
def q_itinerary_rejects(spark, d):
    """the texts that are no JSON object, four trips of five being given an odd one."""
    t = Tables(spark, d).trips
    return itinerary_table(t.withColumn("itinerary", F.expr(_ODD_ITINERARY.replace('\"', '"'))))[1]


_CALLS = {  # function -> (view, argument)
    "js_parse_int": ("leads", "concat(' ', travellers, 'x')"), "is_phone10": ("users", "phone_number"),
    "norm_code": ("coupon_attempts", "code_raw"), "norm_role": ("users", "concat(' ', upper(role))"),
    "is_role": ("users", "concat(role, CASE WHEN id % 2 = 0 THEN 's' ELSE ' ' END)"), "file_name": ("media", "key"),
    "file_ext": ("media", "key"), "media_kind": ("media", "key")}
_DUCK_CALLS = {
    "js_parse_int": "regexp_extract({x}, '^\\s*([0-9]+)', 1)", "is_phone10": "CAST(regexp_full_match({x}, '[0-9]{{10}}') AS VARCHAR)",
    "norm_code": "nullif(upper(trim({x})), '')", "norm_role": "lower(trim({x}))",
    "is_role": "CAST(lower(trim({x})) IN ('user', 'admin', 'superadmin') AS VARCHAR)",
    "file_name": "string_split({x}, '/')[-1]", "file_ext": "string_split({x}, '.')[-1]",
    "media_kind": "CASE WHEN contains(lower({x}), 'itinerary') THEN 'itinerary' ELSE 'image' END"}


@register("sql_functions_all", duck_with("leads", "users", "coupon_attempts", "media") + " UNION ALL ".join(
    f"SELECT '{f}' AS fn, {_DUCK_CALLS[f].format(x=x)} AS value, count(*) AS n FROM {v} GROUP BY ALL"
    for f, (v, x) in _CALLS.items()))
def q_sql_functions_all(spark, d):
    """Every other registered SQL function over a whole table, its values counted."""
    register_functions(spark)
    t = Tables(spark, d)
    for view in {v for v, _ in _CALLS.values()}:
        getattr(t, view).createOrReplaceTempView(f"caravan_{view}")
    return spark.sql(" UNION ALL ".join(
        f"SELECT '{f}' AS fn, CAST({f}({x}) AS STRING) AS value, count(*) AS n FROM caravan_{v} GROUP BY 1, 2"
        for f, (v, x) in _CALLS.items()))
