"""Bookings and their parents: joined detail (J1-J3), reference checks (J7),
occupancy and capacity (A2, A3), rosters (A4-A6), counts (A7, A9).

Scale notes: bookings is the fact table. Every per-batch / per-user total is
a partial aggregate (reduced map-side, so one hot batch does not land in one
task) joined to the dimension afterwards. Rosters are produced in long form,
one row per member in the reference's order key; ``nest_*`` helpers turn a
long roster into the reference's nested arrays for presentation of a bounded
selection (an array is one row, so it is never built for a whole hot group
inside the registered jobs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.plans.shapes import small_side, sum_by_key
from caravan.session import cut_lineage

# Fixed values from the reference: column lists of the joined booking reads.
BOOKING_COLS = ["id", "user_id", "batch_id", "name", "phone_number", "guardian_number", "email",
                "payment", "travellers", "room_type", "invoice_id"]
DETAIL_BATCH_COLS = ["trip_id", "from_date", "to_date", "days", "nights", "price",
                     "max_adventurers", "batch_name", "single_room", "double_room", "triple_room"]
DETAIL_TRIP_COLS = ["destination_name", "destinations", "physical_rating", "description",
                    "itinerary", "inclusions", "excluions"]
ROSTER_BATCH_COLS = ["id", "from_date", "to_date", "price", "tax", "single_room", "double_room",
                     "triple_room", "max_adventurers", "status", "batch_name", "trip_id"]


def _pref(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in df.columns])


# ------------------------------------------------------------------ J1, J2
def _booking_batch_trip(bookings: DataFrame, batches: DataFrame, trips: DataFrame) -> DataFrame:
    # the two dimensions first, so that the fact is shuffled once, on its own key
    ba, t = _pref(batches, "ba_"), _pref(trips, "t_")
    dims = ba.join(t, ba["ba_trip_id"] == t["t_id"], "left")
    return bookings.join(dims, bookings["batch_id"] == dims["ba_id"], "left")


def booking_detail_flat(bookings: DataFrame, batches: DataFrame, trips: DataFrame,
                        ordered: bool = False) -> DataFrame:
    """Bookings with their batch and trip (left joins), flat. As in the
    reference's row objects, ``batch_id`` and ``trip_id`` are the *joined*
    parent ids (last duplicate name wins), so null for a dangling reference."""
    j = _booking_batch_trip(bookings, batches, trips)
    cols = [F.col(c) for c in BOOKING_COLS if c != "batch_id"]
    out = j.select(
        *cols, F.col("ba_id").alias("batch_id"),
        *[F.col("ba_" + c).alias(c) for c in DETAIL_BATCH_COLS if c != "trip_id"],
        F.col("ba_status").alias("batch_status"),
        F.col("t_id").alias("trip_id"),
        *[F.col("t_" + c).alias(c) for c in DETAIL_TRIP_COLS],
        F.col("t_status").alias("trip_status"))
    return out.orderBy(F.col("id").desc_nulls_first()) if ordered else out


def booking_detail_nested(bookings: DataFrame, batches: DataFrame, trips: DataFrame,
                          keep_raw_batch_id: bool = False, ordered: bool = False) -> DataFrame:
    """booking{..., batch{..., trip{...}}}; a missing parent is a null
    struct. The list read shows the joined batch_id, the single read the
    booking's own (``keep_raw_batch_id=True``)."""
    j = _booking_batch_trip(bookings, batches, trips)
    trip = F.when(F.col("t_id").isNotNull(), F.struct(
        F.col("t_id").alias("id"), *[F.col("t_" + c).alias(c) for c in DETAIL_TRIP_COLS],
        F.col("t_status").alias("status")))
    batch = F.when(F.col("ba_id").isNotNull(), F.struct(
        F.col("ba_id").alias("id"), F.col("t_id").alias("trip_id"),
        *[F.col("ba_" + c).alias(c) for c in DETAIL_BATCH_COLS if c != "trip_id"],
        F.col("ba_status").alias("status"), trip.alias("trip")))
    batch_id = F.col("batch_id") if keep_raw_batch_id else F.col("ba_id")
    out = j.select(*[batch_id.alias("batch_id") if c == "batch_id" else F.col(c) for c in BOOKING_COLS],
                   batch.alias("batch"))
    return out.orderBy(F.col("id").desc_nulls_first()) if ordered else out


# ------------------------------------------------------------------ J3
def admin_bookings(bookings: DataFrame, users: DataFrame, batches: DataFrame,
                   trips: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Bookings with user name / email, batch name and dates and (list
    form) the destination; left joins throughout. ``trips=None`` gives the
    single-booking form without destination."""
    u = small_side(users.select(F.col("id").alias("_u_id"), F.col("name").alias("user_name"),
                                F.col("email").alias("user_email")))
    ba = batches.select(F.col("id").alias("_ba_id"), "batch_name", "from_date", "to_date",
                        F.col("trip_id").alias("_ba_trip_id"))
    cols = BOOKING_COLS + ["user_name", "user_email", "batch_name", "from_date", "to_date"]
    if trips is not None:  # batch and trip first: the fact is not shuffled for the trip
        t = trips.select(F.col("id").alias("_t_id"), "destination_name")
        ba = ba.join(t, F.col("_ba_trip_id") == F.col("_t_id"), "left")
        cols.append("destination_name")
    j = (bookings.select(*BOOKING_COLS)
         .join(u, F.col("user_id") == F.col("_u_id"), "left")
         .join(ba, F.col("batch_id") == F.col("_ba_id"), "left"))
    out = j.select(*cols)
    return out.orderBy(F.col("id").desc_nulls_first()) if ordered else out


# ------------------------------------------------------------------ J7
def missing_references(requests: DataFrame, dim: DataFrame, key: str, dim_key: str = "id") -> DataFrame:
    """Requests whose ``key`` names no row of ``dim``, null included. Only the
    distinct keys meet ``dim`` (anti join); the requests are looked up in what is left."""
    d = dim.select(F.col(dim_key).cast("string").alias("_known"))
    asked = requests.select(F.col(key).cast("string").alias("_ref")).distinct()
    absent = small_side(cut_lineage(asked.join(d, F.col("_ref") == F.col("_known"), "left_anti")))
    return requests.join(absent, requests[key].cast("string").eqNullSafe(absent["_ref"]), "left_semi")


# ------------------------------------------------------------------ A2, A3
def booked_travellers(bookings: DataFrame) -> DataFrame:
    """Travellers booked per batch id, pre-aggregated (``_batch_id``, ``total_bookings``)."""
    return sum_by_key(bookings, "batch_id", "travellers", "total_bookings", as_key="_batch_id")


def batch_occupancy(batches: DataFrame, bookings: DataFrame) -> DataFrame:
    """A2: every batch with the travellers booked into it (0 when none), bigint."""
    occ = booked_travellers(bookings)
    j = batches.join(occ, batches["id"] == occ["_batch_id"], "left")
    return j.select(*[batches[c] for c in batches.columns],
                    F.coalesce(F.col("total_bookings"), F.lit(0)).cast("bigint").alias("total_bookings"))


def batch_capacity(batches: DataFrame, bookings: DataFrame) -> DataFrame:
    """A3: ``remaining = max_adventurers - travellers booked`` (negative when
    over-subscribed through the unchecked insert and update paths)."""
    occ = batch_occupancy(batches, bookings)
    return occ.select("id", "max_adventurers", F.col("total_bookings").alias("current_bookings"),
                      (F.col("max_adventurers") - F.col("total_bookings")).alias("remaining"))


# ------------------------------------------------------------------ A4
def batch_roster(batches: DataFrame, trips: DataFrame, bookings: DataFrame) -> DataFrame:
    """A4 totals: one row per batch with its destination (null when the trip is
    missing), number of bookings and total travellers (= ``total_bookings`` and
    ``total_travellers`` of the reference). The member list is
    ``batch_roster_entries``."""
    per_batch = (bookings.groupBy(F.col("batch_id").alias("_batch_id"))
                 .agg(F.count(F.lit(1)).alias("booking_count"),
                      F.sum("travellers").cast("bigint").alias("total_travellers")))
    t = trips.select(F.col("id").alias("_t_id"), "destination_name")
    j = (batches.select(*ROSTER_BATCH_COLS)
         .join(t, F.col("trip_id") == F.col("_t_id"), "left")
         .join(per_batch, F.col("id") == F.col("_batch_id"), "left"))
    tot = F.coalesce(F.col("total_travellers"), F.lit(0)).cast("bigint")
    return j.select("id", "destination_name", *ROSTER_BATCH_COLS[1:],
                    F.coalesce(F.col("booking_count"), F.lit(0)).alias("booking_count"),
                    tot.alias("total_bookings"), tot.alias("total_travellers"))


def batch_roster_entries(batches: DataFrame, bookings: DataFrame, users: DataFrame) -> DataFrame:
    """A4 members: one row per booking of an existing batch (batch_id,
    booking_id, user_name, travellers); the reference's order key is the
    booking id within a batch. A booking whose user is missing has a null
    user_name (the reference's null array element)."""
    u = users.select(F.col("id").alias("_u_id"), F.col("name").alias("user_name"))
    ba = batches.select(F.col("id").alias("_ba_id"))
    j = (bookings.join(ba, F.col("batch_id") == F.col("_ba_id"), "left_semi")
         .join(u, F.col("user_id") == F.col("_u_id"), "left"))
    return j.select("batch_id", F.col("id").alias("booking_id"), "user_name", "travellers")


def nest_roster(roster: DataFrame, entries: DataFrame) -> DataFrame:
    """A4 nested form: ``users`` (names) and ``travellers`` arrays ordered by
    booking id, ``[]`` without bookings. Builds one array per batch, so use it
    on a bounded selection of batches (one page, one id)."""
    e = (entries.groupBy(F.col("batch_id").alias("_b"))
         .agg(F.array_sort(F.collect_list(F.struct("booking_id", "user_name", "travellers")))
              .alias("_m")))
    j = roster.join(e, roster["id"] == e["_b"], "left")
    m = F.coalesce(F.col("_m"), F.array())
    return j.select(*[roster[c] for c in roster.columns],
                    F.transform(m, lambda x: x["user_name"]).alias("users"),
                    F.transform(m, lambda x: x["travellers"]).alias("travellers"))


# ------------------------------------------------------------------ A5
def user_trips(users: DataFrame, bookings: DataFrame, batches: DataFrame, trips: DataFrame) -> DataFrame:
    """A5 long form: distinct (user, destination_name) pairs of each user's
    bookings; null destinations dropped; a user without any gets one row with
    a null destination (the reference's ``[]``). The distinct is a partial
    aggregate, so a user with very many bookings is reduced map-side."""
    ba = batches.select(F.col("id").alias("_ba_id"), F.col("trip_id").alias("_ba_trip"))
    t = trips.select(F.col("id").alias("_t_id"), "destination_name")
    # batches with their destination, and each (user, batch) once, before they meet
    places = (ba.join(t, F.col("_ba_trip") == F.col("_t_id")).where(F.col("destination_name").isNotNull())
              .select("_ba_id", "destination_name"))
    pairs = (bookings.select("user_id", "batch_id").distinct()
             .join(places, F.col("batch_id") == F.col("_ba_id"))
             .select(F.col("user_id").alias("_uid"), "destination_name").distinct())
    j = users.select("id", "name").join(pairs, F.col("id") == F.col("_uid"), "left")
    return j.select(F.col("id").alias("user_id"), "name", "destination_name")


def users_with_trips(users_page: DataFrame, bookings: DataFrame, batches: DataFrame, trips: DataFrame) -> DataFrame:
    """The admin user list as served: a page of users, each with the sorted
    distinct destinations of their bookings. Only the page's bookings are read on."""
    mine = bookings.join(users_page.select(F.col("id").alias("_page")), F.col("user_id") == F.col("_page"), "left_semi")
    nested = nest_user_trips(user_trips(users_page, mine, batches, trips))
    nested = nested.select(F.col("user_id").alias("_uid"), "trips")
    j = users_page.join(nested, users_page["id"] == nested["_uid"], "left")
    return j.select(*[users_page[c] for c in users_page.columns], "trips")


def nest_user_trips(long: DataFrame) -> DataFrame:
    """A5 nested form: ``trips`` = sorted distinct destination names, ``[]`` when none."""
    return (long.groupBy("user_id", "name")
            .agg(F.array_sort(F.collect_set("destination_name")).alias("trips")))


# ------------------------------------------------------------------ A6
def trips_with_batches(trips: DataFrame, batches: DataFrame, bookings: DataFrame) -> DataFrame:
    """A6 long form: every trip with its all-batch date range and one row per
    batch (id, from_date, to_date, batch_name, booking_count = travellers
    booked); a trip without batches has one row with null batch fields. One
    grouped pass instead of the reference's query per trip."""
    occ = booked_travellers(bookings)
    b = (batches.select(F.col("id").alias("batch_id"), F.col("trip_id").alias("_trip"),
                        "from_date", "to_date", "batch_name")
         .join(occ, F.col("batch_id") == F.col("_batch_id"), "left")
         .select("batch_id", "_trip", "from_date", "to_date", "batch_name",
                 F.coalesce(F.col("total_bookings"), F.lit(0)).cast("bigint").alias("booking_count")))
    rng = (batches.groupBy(F.col("trip_id").alias("_rt"))
           .agg(F.min("from_date").alias("from_month"), F.max("to_date").alias("to_month")))
    t = trips.join(rng, trips["id"] == rng["_rt"], "left")
    j = t.join(b, t["id"] == b["_trip"], "left")
    return j.select(*[F.col(c) for c in trips.columns], "from_month", "to_month",
                    "batch_id", F.col("from_date").alias("batch_from_date"),
                    F.col("to_date").alias("batch_to_date"), "batch_name", "booking_count")


def nest_trip_batches(long: DataFrame, trip_cols) -> DataFrame:
    """A6 nested form: ``batches`` array ordered by from_date (then id)."""
    item = F.struct(F.col("batch_from_date").alias("from_date"), F.col("batch_id").alias("id"),
                    F.col("batch_to_date").alias("to_date"), "batch_name", "booking_count")
    g = long.groupBy(*trip_cols, "from_month", "to_month").agg(
        F.array_sort(F.collect_list(F.when(F.col("batch_id").isNotNull(), item))).alias("_b"))
    return g.select(*trip_cols, "from_month", "to_month", F.transform("_b", lambda x: F.struct(
        x["id"].alias("id"), x["from_date"].alias("from_date"), x["to_date"].alias("to_date"),
        x["batch_name"].alias("batch_name"), x["booking_count"].alias("booking_count"))).alias("batches"))


# ------------------------------------------------------------------ A7, A9
def row_total(df: DataFrame) -> DataFrame:
    """``COUNT(*)`` as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def distinct_total(df: DataFrame, col: str = "id") -> DataFrame:
    """``COUNT(DISTINCT col)`` as a one-row DataFrame."""
    return df.agg(F.count_distinct(F.col(col)).alias("total"))


def booking_count_per_user(users: DataFrame, bookings: DataFrame) -> DataFrame:
    """Bookings per user (0 when none), the guard of the user delete."""
    c = bookings.groupBy(F.col("user_id").alias("_uid")).agg(F.count(F.lit(1)).alias("booking_count"))
    j = users.select("id").join(c, F.col("id") == F.col("_uid"), "left")
    return j.select(F.col("id").alias("user_id"),
                    F.coalesce(F.col("booking_count"), F.lit(0)).alias("booking_count"))

