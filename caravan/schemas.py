"""Fixed domain schemas (the DDL as corrected for what the handlers really read
and write). Schemas are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
MONEY = T.DecimalType(12, 2)


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


USERS = _st(
    ("id", S, False), ("name", S, False), ("email", S, False),
    ("phone_number", S, False), ("created_at", L, False), ("role", S, False),
    ("gender", S, True), ("emergency_contact", S, True), ("address", S, True),
)

TRIPS = _st(
    ("id", S, False), ("destination_name", S, False), ("destinations", S, False),
    ("physical_rating", I, False), ("description", S, False), ("itinerary", S, False),
    ("inclusions", S, False), ("excluions", S, False), ("days", S, False),
    ("nights", I, False), ("status", B, False), ("images", I, True),
)

BATCHES = _st(
    ("id", S, False), ("trip_id", S, False), ("from_date", L, False), ("to_date", L, False),
    ("days", I, True), ("nights", I, True), ("price", MONEY, False), ("tax", MONEY, False),
    ("max_adventurers", I, False), ("status", B, False), ("batch_name", S, False),
    ("single_room", I, False), ("double_room", I, False), ("triple_room", I, False),
    ("created_at", L, True),
)

BOOKINGS = _st(
    ("id", S, False), ("user_id", S, False), ("batch_id", S, False), ("name", S, False),
    ("phone_number", S, False), ("guardian_number", S, True), ("email", S, False),
    ("payment", MONEY, False), ("travellers", I, False), ("room_type", S, False),
    ("invoice_id", I, False),
)

LEADS = _st(
    ("id", S, False), ("type", S, False), ("name", S, False), ("location", S, False),
    ("travellers", I, False), ("days", I, False), ("email", S, False), ("phone", S, True),
    ("message", S, False), ("budget", MONEY, False), ("date", S, True), ("created_at", L, True),
)

COUPONS = _st(
    ("id", S, False), ("code", S, False), ("deduction", MONEY, False),
    ("start_date", L, False), ("end_date", L, False), ("status", B, False),
)

BANNERS = _st(
    ("id", S, False), ("banner_name", S, False), ("description", S, False),
    ("status", B, False), ("created_at", L, False),
)

MEDIA = _st(("key", S, False), ("size", L, False), ("last_modified", T.TimestampType(), True))

COUPON_ATTEMPTS = _st(("attempt_id", L, False), ("ts", T.TimestampType(), False),
                      ("code_raw", S, True))

BOOKING_REQUESTS = _st(
    ("request_id", S, False), ("seq", S, False), ("user_ref", S, True), ("batch_ref", S, True),
    ("name", S, True), ("phone_number", S, True), ("guardian_number", S, True),
    ("email", S, True), ("payment", S, True), ("travellers", S, True), ("room_type", S, True),
    ("has_invoice", B, True),
)

TABLES = {
    "users": USERS, "trips": TRIPS, "batches": BATCHES, "bookings": BOOKINGS,
    "leads": LEADS, "coupons": COUPONS, "banners": BANNERS,
}

# Fixed values from the reference: primary key of every table, NOT NULL columns
# (nullable=False above) and the foreign keys the code relies on.
PRIMARY_KEYS = {t: "id" for t in TABLES}
FOREIGN_KEYS = [
    ("batches", "trip_id", "trips"),
    ("bookings", "user_id", "users"),
    ("bookings", "batch_id", "batches"),
]
