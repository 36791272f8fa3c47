"""Trip catalogue: public and admin reads over trips and their batches.

P1-P8 (filters / projections), A1, A8 (grouped), J4-J6 (lowest-price batch
per trip and the catalogue built on it), J12, W1-W2 (per-trip pages).
``as_of`` (epoch seconds) replaces the wall clock so results repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravan.functions.columns import epoch_month
from caravan.operators.bookings import booked_travellers
from caravan.plans.shapes import top1_struct

# Fixed values from the reference: fields of the nested lowest-price batch
# (catalogue form has created_at, the detail form does not) and the page size
# of the per-trip batch listing.
CATALOG_BATCH_FIELDS = ["id", "from_date", "to_date", "price", "max_adventurers", "batch_name",
                        "single_room", "double_room", "triple_room", "created_at"]
DETAIL_BATCH_FIELDS = CATALOG_BATCH_FIELDS[:-1]
TRIP_BATCH_PAGE_SIZE = 4


# ------------------------------------------------------------------ P1-P8
def upcoming_batches(batches: DataFrame, as_of: int) -> DataFrame:
    """Active batches that start strictly after ``as_of``."""
    return batches.where(F.col("status") & (F.col("from_date") > F.lit(as_of)))


def batches_in_month(batches: DataFrame, as_of: int, month: int) -> DataFrame:
    """P1 plus calendar month (UTC) of from_date, any year."""
    return upcoming_batches(batches, as_of).where(epoch_month("from_date") == F.lit(int(month)))


def like_pattern(text: str, literal: bool = False) -> str:
    """``%text%``; the reference does not escape ``%`` / ``_`` (they stay
    wildcards), ``literal=True`` escapes them."""
    if literal:
        text = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{text}%"


def search_trips(trips: DataFrame, text: str | None, literal: bool = False) -> DataFrame:
    """Case-insensitive substring match on destination_name; no text -> all."""
    if not text:
        return trips
    return trips.where(F.col("destination_name").ilike(like_pattern(text, literal)))


def _search_by_name(df: DataFrame, col: str, text: str, literal: bool) -> DataFrame:
    out = df.where(F.lower(F.col(col)).like(like_pattern(text, literal).lower()))
    return out.select("id", col).orderBy(F.col(col).asc_nulls_last(), F.col("id").asc())


def search_batches(batches: DataFrame, text: str, literal: bool = False) -> DataFrame:
    """(id, batch_name) of batches whose name contains ``text`` (any case), by name."""
    return _search_by_name(batches, "batch_name", text, literal)


def search_users(users: DataFrame, text: str, literal: bool = False) -> DataFrame:
    """P5: (id, name) of users whose name contains ``text`` (any case), by name."""
    return _search_by_name(users, "name", text, literal)


PROFILE_COLUMNS = [("id", "id"), ("name", "name"), ("email", "email"),
                   ("phone_number", "phoneNumber"), ("created_at", "createdAt"), ("role", "role"),
                   ("gender", "gender"), ("emergency_contact", "emergencyContact"),
                   ("address", "address")]


def user_profiles(users: DataFrame) -> DataFrame:
    """Public profile columns (never the password), camelCase names."""
    return users.select(*[F.col(a).alias(b) for a, b in PROFILE_COLUMNS])


def active_trips(trips: DataFrame) -> DataFrame:
    """Trips shown on public reads."""
    return trips.where(F.col("status"))


def bookings_of_users(bookings: DataFrame, user_ids: DataFrame | Sequence | None = None) -> DataFrame:
    """Bookings of the given users (a DataFrame with ``user_id`` or a short
    list); all bookings when not given."""
    if user_ids is None:
        return bookings
    if isinstance(user_ids, DataFrame):
        return bookings.join(user_ids.select("user_id").distinct(), "user_id", "left_semi")
    return bookings.where(F.col("user_id").isin(list(user_ids)))


# ------------------------------------------------------------------ A1, A8
def trip_date_range(batches: DataFrame, active_only: bool = True) -> DataFrame:
    """A1: earliest from_date and latest to_date per trip. Public reads use
    active batches only, admin reads all; past batches count in both."""
    b = batches.where(F.col("status")) if active_only else batches
    return b.groupBy("trip_id").agg(F.min("from_date").alias("from_month"),
                                   F.max("to_date").alias("to_month"))


def upcoming_count(batches: DataFrame, as_of: int) -> DataFrame:
    """Number of active upcoming batches per trip."""
    return (upcoming_batches(batches, as_of).groupBy("trip_id")
            .agg(F.count(F.lit(1)).alias("upcoming_batches")))


# ------------------------------------------------------------------ J4-J6
def _cheapest_key(fields: Sequence[str]) -> Column:
    # sort order price, from_date, then id for a stable answer on ties
    rest = [f for f in fields if f not in ("price", "from_date", "id")]
    return top1_struct("price", "from_date", "id", *rest)


def _nest(col: str, fields: Sequence[str]) -> Column:
    return F.when(F.col(col).isNotNull(), F.struct(*[F.col(f"{col}.{f}").alias(f) for f in fields]))


def _catalog_aggregate(batches: DataFrame, as_of: int, fields: Sequence[str]) -> DataFrame:
    """One grouped pass over active batches per trip: the cheapest upcoming one
    (J4) and the date range (A1). ``min`` over a struct is a partial aggregate,
    so a trip holding most batches is reduced before the shuffle."""
    upcoming = F.col("from_date") > F.lit(as_of)
    return (batches.where(F.col("status"))
            .groupBy(F.col("trip_id").alias("_trip_id"))
            .agg(F.min(F.when(upcoming, _cheapest_key(fields))).alias("_cheapest"),
                 F.min("from_date").alias("from_month"),
                 F.max("to_date").alias("to_month")))


def cheapest_upcoming_batch(trips: DataFrame, batches: DataFrame, as_of: int,
                            fields: Sequence[str] = CATALOG_BATCH_FIELDS) -> DataFrame:
    """Per trip the active upcoming batch with the lowest price, then the
    earliest from_date (then id); the trip is kept with a null batch when none."""
    agg = (upcoming_batches(batches, as_of)
           .groupBy(F.col("trip_id").alias("_trip_id"))
           .agg(F.min(_cheapest_key(fields)).alias("_cheapest")))
    out = trips.join(agg, trips["id"] == agg["_trip_id"], "left")
    return out.select(*[trips[c] for c in trips.columns],
                      _nest("_cheapest", fields).alias("lowestPriceBatch"))


def trip_catalog(trips: DataFrame, batches: DataFrame, as_of: int, ordered: bool = True) -> DataFrame:
    """J5 (flagship): active trips, each with its lowest-price upcoming batch
    nested as ``lowestPriceBatch`` and the active-batch date range as
    ``from_month`` / ``to_month``; ordered by destination."""
    agg = _catalog_aggregate(batches, as_of, CATALOG_BATCH_FIELDS)
    t = active_trips(trips)
    out = t.join(agg, t["id"] == agg["_trip_id"], "left").select(
        *[t[c] for c in trips.columns],
        _nest("_cheapest", CATALOG_BATCH_FIELDS).alias("lowestPriceBatch"),
        "from_month", "to_month")
    if ordered:
        out = out.orderBy(F.col("destination_name").asc_nulls_last(), F.col("id").asc())
    return out


def trip_detail(trips: DataFrame, batches: DataFrame, ids: DataFrame | None, as_of: int) -> DataFrame:
    """Catalogue rows for the given trip ids (DataFrame with ``id``; all
    active trips when None), with ``start`` / ``end`` as well; the nested
    batch has no created_at."""
    agg = _catalog_aggregate(batches, as_of, DETAIL_BATCH_FIELDS)
    t = active_trips(trips)
    if ids is not None:
        t = t.join(ids.select("id").distinct(), "id", "left_semi")
    out = t.join(agg, t["id"] == agg["_trip_id"], "left")
    return out.select(
        *[t[c] for c in trips.columns],
        _nest("_cheapest", DETAIL_BATCH_FIELDS).alias("lowestPriceBatch"),
        F.col("from_month").alias("start"), F.col("to_month").alias("end"),
        "from_month", "to_month")


def legacy_cheapest_by_destination(df: DataFrame, dest: str = "destination_name",
                                   price: str = "price") -> DataFrame:
    """Rows whose price equals the minimum price of their destination; all
    ties kept. The minimum is a partial aggregate joined back on
    (destination, price), so a hot destination is split by AQE's skew join."""
    mins = df.groupBy(F.col(dest).alias("_d")).agg(F.min(price).alias("_p"))
    out = df.join(mins, (df[dest] == mins["_d"]) & (df[price] == mins["_p"]), "left_semi")
    return out


# ------------------------------------------------------------------ W2
def _batch_totals(up: DataFrame, size: int) -> DataFrame:
    return (up.groupBy(F.col("trip_id").alias("_t")).agg(F.count(F.lit(1)).alias("totalBatches"))
            .withColumn("totalPages", F.ceil(F.col("totalBatches") / F.lit(size)).cast("bigint")))


def trip_batch_totals(trips: DataFrame, batches: DataFrame, as_of: int, month: int | None = None,
                      size: int = TRIP_BATCH_PAGE_SIZE) -> DataFrame:
    """W2 totals of every trip, also where a page is empty: trip_id,
    totalBatches, totalPages."""
    up = batches_in_month(batches, as_of, month) if month else upcoming_batches(batches, as_of)
    t = _batch_totals(up, size)
    j = trips.select(F.col("id").alias("trip_id")).join(t, F.col("trip_id") == F.col("_t"), "left")
    return j.select("trip_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                 for c in ("totalBatches", "totalPages")])


def trip_batch_pages(batches: DataFrame, bookings: DataFrame, as_of: int, month: int | None = None,
                     page=1, size: int = TRIP_BATCH_PAGE_SIZE) -> DataFrame:
    """For every trip the ``page`` of its upcoming batches ordered by price,
    from_date (then id), with total_bookings (travellers booked), totalBatches
    and totalPages. The row number is bounded by the page end, so Spark plans a
    partial WindowGroupLimit before the shuffle (at most page*size rows per
    trip and map task). A trip whose page is empty has no row; its totals are in
    ``trip_batch_totals``. The reference reports a total of 0 for a page past the
    end when a month is given; here totals are always the true ones."""
    p = int(page) if str(page).strip().lstrip("+").isdigit() else None
    if p is None or p < 1:
        raise ValueError(f"page must be a positive integer, got {page!r}")
    up = batches_in_month(batches, as_of, month) if month else upcoming_batches(batches, as_of)
    w = Window.partitionBy("trip_id").orderBy(
        F.col("price").asc_nulls_last(), F.col("from_date").asc_nulls_last(), F.col("id").asc_nulls_last())
    lo, hi = (p - 1) * size, p * size
    ranked = up.withColumn("position", F.row_number().over(w))
    rows = ranked.where((F.col("position") <= hi) & (F.col("position") > lo))
    totals = _batch_totals(up, size)
    occ = booked_travellers(bookings)
    out = (rows.join(occ, rows["id"] == occ["_batch_id"], "left")
           .join(totals, rows["trip_id"] == totals["_t"], "left"))
    return out.select(*[rows[c] for c in batches.columns],
                      F.coalesce(F.col("total_bookings"), F.lit(0)).cast("bigint").alias("total_bookings"),
                      F.lit(p).alias("page"), F.lit(size).alias("limit"), "position",
                      "totalBatches", "totalPages")
