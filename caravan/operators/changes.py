"""Bulk table changes: the reference's single-row insert / update / delete
handlers re-aimed as set jobs over a table of requests (J8, M1-M5, M7-M13).

Every operator returns DataFrames ``(new_table, outcome)``; ``outcome`` has one
row per request: ``request_id, accepted, error_code``. Plain Parquet has no
row-level MERGE, so a caller stores ``new_table`` as a new snapshot directory
(``caravan.sources.tables.write_snapshot``); with a table format the outcome
feeds ``MERGE INTO``.

Request columns are text, as in the reference's form / JSON bodies. The JS
"required" test (``!value``) is ``blank``: null or empty text; JSON-number
bodies also treat 0 as missing (``blank0``).

Requests are decided "as if handled one after the other" in ``seq`` order (equal
ones by ``request_id``, which names one request; those without a ``seq`` last):
* the first failing rule wins, rules in the reference's order;
* among requests that pass all rules, the first in this order per unique key
  wins and the later ones get the key's DUPLICATE code; a request rejected for
  another reason does not block the key. The first valid request per key is a
  partial aggregate joined back (no window over a key's whole group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravan.operators.admission import admit_bookings
from caravan.operators.media import media_owner
from caravan.plans.shapes import odd_references, small_side
from caravan.session import cut_lineage
from caravan.functions.columns import (is_email, json_text_ok, is_phone10, is_role, js_parse_float, js_parse_int,
                                       looks_like_json, norm_code, norm_role, to_money)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c) -> Column:
    """JS ``!value`` for a text field: null or empty."""
    return F.coalesce(_c(c).cast("string"), F.lit("")) == ""


def blank0(c) -> Column:
    """JS ``!value`` for a JSON field that may be the number 0."""
    return blank(c) | (F.trim(_c(c).cast("string")) == "0")


def any_of(*conds: Column) -> Column:
    """OR of conditions, null treated as false."""
    out = F.lit(False)
    for c in conds:
        out = out | F.coalesce(c, F.lit(False))
    return out


def first_error(rules: Sequence[tuple[Column, str]]) -> Column:
    """Code of the first rule whose condition holds; null when none does."""
    out = None
    for cond, code in rules:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return out if out is not None else F.lit(None).cast("string")


def _stable_id(*cols) -> Column:
    """Deterministic id for an inserted row (re-runs give equal ids)."""
    return F.sha2(F.concat_ws("\u0001", *[_c(c).cast("string") for c in cols]), 256)


def decide(requests: DataFrame, before: Sequence[tuple[Column, str]], key: Column | None,
           existing_keys: DataFrame | None, dup_code: str,
           after: Sequence[tuple[Column, str]] = ()) -> DataFrame:
    """Attach ``error_code`` (null = accepted) to every request.

    ``before`` rules run first, then the uniqueness check of ``key`` against
    ``existing_keys`` (one column ``_key``) and against earlier accepted
    requests, then the ``after`` rules."""
    r = requests.withColumn("_e1", first_error(before)).withColumn("_e3", first_error(after))
    if key is None:
        return r.withColumn("error_code", F.coalesce("_e1", "_e3")).drop("_e1", "_e3")
    r = r.withColumn("_key", key)
    if existing_keys is not None:
        ek = existing_keys.select(F.col("_key").alias("_ek")).distinct().withColumn("_exists", F.lit(True))
        r = r.join(ek, r["_key"] == ek["_ek"], "left").drop("_ek")
    else:
        r = r.withColumn("_exists", F.lit(None).cast("boolean"))
    exists = F.coalesce(F.col("_exists"), F.lit(False))
    valid = F.col("_e1").isNull() & ~exists & F.col("_e3").isNull()
    turn = F.struct(F.col("seq").isNull().alias("last"), "seq", "request_id")
    first = (r.where(valid).groupBy(F.col("_key").alias("_fk")).agg(F.min(turn).alias("_first")))
    r = r.join(first, r["_key"] == first["_fk"], "left").drop("_fk")
    dup = exists | (F.col("_first").isNotNull() & (turn > F.col("_first")))
    err = F.coalesce(F.col("_e1"), F.when(dup, F.lit(dup_code)), F.col("_e3"))
    return r.withColumn("error_code", err).drop("_e1", "_e3", "_key", "_exists", "_first")


def outcome(decided: DataFrame) -> DataFrame:
    return decided.select("request_id", F.col("error_code").isNull().alias("accepted"), "error_code")


# ------------------------------------------------------------------ M1
TRIP_REQUIRED = ["name", "description", "numberOfDays", "daysData", "days", "nights", "destinations",
                 "physicalRating"]


def insert_trips(trips: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M1: required fields; at least one image and an itinerary file; daysData
    must parse as JSON; destination_name not present yet (exact text), first
    request wins within the batch. Defaults: inclusions / excluions '', status
    true, images = number of images uploaded.

    requests: request_id, seq, name, description, numberOfDays, daysData, days,
    nights, destinations, physicalRating (text), n_images (int), has_itinerary."""
    before = [(any_of(*[blank(c) for c in TRIP_REQUIRED]), "MISSING_FIELDS"),
              (F.coalesce(F.col("n_images"), F.lit(0)) <= 0, "IMAGE_REQUIRED"),
              (~F.coalesce(F.col("has_itinerary"), F.lit(False)), "ITINERARY_REQUIRED"),
              (~json_text_ok("daysData"), "INVALID_DAYS_JSON")]
    existing = trips.select(F.col("destination_name").alias("_key"))
    d = decide(requests, before, F.col("name"), existing, "DUPLICATE_NAME")
    new = d.where(F.col("error_code").isNull()).select(
        _stable_id("request_id", "name").alias("id"),
        F.col("name").alias("destination_name"), "destinations",
        js_parse_int("physicalRating").try_cast("int").alias("physical_rating"), "description",
        F.col("daysData").alias("itinerary"), F.lit("").alias("inclusions"),
        F.lit("").alias("excluions"), F.col("days").cast("string").alias("days"),
        js_parse_int("nights").try_cast("int").alias("nights"), F.lit(True).alias("status"),
        F.col("n_images").cast("int").alias("images"))
    return _append(trips, new), outcome(d)


# Key columns hold opaque ids; inserted rows get text ids (hashes) and refer
# to parents by the text given in the request, so keys are stored as text.
KEY_COLS = ("id", "trip_id", "user_id", "batch_id")


def _stored(df: DataFrame, dtypes, source: DataFrame | None = None) -> list[Column]:
    src = source if source is not None else df
    # a number beyond the stored type becomes null and never ends the whole job
    return [(src[c] if c in src.columns else F.lit(None)).try_cast("string" if c in KEY_COLS else t).alias(c)
            for c, t in dtypes]


def _append(table: DataFrame, new: DataFrame) -> DataFrame:
    """Stored table after inserts: the old rows and the new ones, new rows cast
    to the stored column types (columns absent from the request are null)."""
    return table.select(*_stored(table, table.dtypes)).unionByName(
        new.select(*_stored(new, table.dtypes)))


# ------------------------------------------------------------------ M2
def insert_batches(batches: DataFrame, requests: DataFrame, trips: DataFrame,
                   as_of: int) -> tuple[DataFrame, DataFrame]:
    """M2: required fields (0 counts as missing for dates, price and maximum,
    but tax and tripleRoom only need to be given); ``to > from``; batch_name
    not present yet, first request wins. single / double rooms default 0,
    created_at defaults to ``as_of``, status to true. Rules the database
    enforced in the reference come last: numbers must parse (INVALID_NUMBER)
    and the trip must exist (TRIP_NOT_FOUND, the foreign key).

    requests: request_id, seq, batchName, assignedTrip, startDate, endDate,
    standardPrice, singleRoom, doubleRoom, tripleRoom, tax, maxAdventurers,
    createdAt, status (text)."""
    frm, to = js_parse_int("startDate"), js_parse_int("endDate")
    missing = (blank("batchName") | blank("assignedTrip") | blank0("startDate") | blank0("endDate")
               | blank0("standardPrice") | F.col("tripleRoom").isNull() | F.col("tax").isNull()
               | blank0("maxAdventurers"))
    before = [(missing, "MISSING_FIELDS"), (to <= frm, "INVALID_DATES")]
    nums = [frm, to, js_parse_int("standardPrice"), js_parse_int("tripleRoom"), js_parse_int("tax"),
            js_parse_int("maxAdventurers")]
    tids = trips.select(F.col("id").cast("string").alias("_tid"), F.lit(True).alias("_trip_ok"))
    r = requests.join(tids, F.col("assignedTrip").cast("string") == F.col("_tid"), "left")
    after = [(any_of(*[n.isNull() for n in nums]), "INVALID_NUMBER"),
             (F.col("_trip_ok").isNull(), "TRIP_NOT_FOUND")]
    existing = batches.select(F.col("batch_name").alias("_key"))
    d = decide(r, before, F.col("batchName"), existing, "DUPLICATE_NAME", after)
    status = F.when(F.col("status").isNull(), F.lit(True)).otherwise(
        F.lower(F.col("status").cast("string")).isin("true", "1", "t"))
    new = d.where(F.col("error_code").isNull()).select(
        _stable_id("request_id", "batchName").alias("id"), F.col("assignedTrip").alias("trip_id"),
        frm.alias("from_date"), to.alias("to_date"),
        js_parse_int("standardPrice").alias("price"), js_parse_int("tax").alias("tax"),
        js_parse_int("maxAdventurers").alias("max_adventurers"), status.alias("status"),
        F.col("batchName").alias("batch_name"),
        F.coalesce(js_parse_int("singleRoom"), F.lit(0)).alias("single_room"),
        F.coalesce(js_parse_int("doubleRoom"), F.lit(0)).alias("double_room"),
        js_parse_int("tripleRoom").alias("triple_room"),
        F.coalesce(js_parse_int("createdAt"), F.lit(as_of)).alias("created_at"))
    return _append(batches, new), outcome(d)


# ------------------------------------------------------------------ M3
def insert_coupons(coupons: DataFrame, requests: DataFrame,
                   normalize: bool = False) -> tuple[DataFrame, DataFrame]:
    """M3: required fields, code unique by exact text (first request wins),
    status true. The code is stored as typed, so a lower-case code never
    validates (J9 upper-cases); ``normalize=True`` stores trim + upper.

    requests: request_id, seq, couponCode, deduction, startDate, endDate."""
    code = norm_code("couponCode") if normalize else F.col("couponCode")
    before = [(blank("couponCode") | blank0("deduction") | blank0("startDate") | blank0("endDate"),
               "MISSING_FIELDS")]
    existing = coupons.select(F.col("code").alias("_key"))
    d = decide(requests, before, code, existing, "DUPLICATE_CODE")
    new = d.where(F.col("error_code").isNull()).select(
        _stable_id("request_id", "couponCode").alias("id"), code.alias("code"),
        to_money(js_parse_float("deduction")).alias("deduction"),
        js_parse_int("startDate").alias("start_date"), js_parse_int("endDate").alias("end_date"),
        F.lit(True).alias("status"))
    return _append(coupons, new), outcome(d)


# ------------------------------------------------------------------ M4
def insert_users(users: DataFrame, requests: DataFrame, as_of: int) -> tuple[DataFrame, DataFrame]:
    """M4: required fields, email format, 10-digit phone, email not present
    yet, role one of user / admin / superadmin, in that order. created_at is
    ``as_of``; the phone is stored as its integer value (leading zeros go, as
    in the reference); no password column is produced.

    requests: request_id, seq, name, email, phoneNumber, role."""
    before = [(blank("name") | blank("email") | blank("phoneNumber") | blank("role"), "MISSING_FIELDS"),
              (~is_email("email"), "INVALID_EMAIL"),
              (~is_phone10("phoneNumber"), "INVALID_PHONE")]
    after = [(~is_role("role"), "INVALID_ROLE")]
    existing = users.select(F.col("email").alias("_key"))
    d = decide(requests, before, F.col("email"), existing, "DUPLICATE_EMAIL", after)
    new = d.where(F.col("error_code").isNull()).select(
        _stable_id("request_id", "email").alias("id"), "name", "email",
        js_parse_int("phoneNumber").cast("string").alias("phone_number"),
        F.lit(as_of).cast("bigint").alias("created_at"), norm_role("role").alias("role"))
    return _append(users, new), outcome(d)


# ------------------------------------------------------------------ M5, M9
def _booking_rules(with_invoice: bool) -> list[tuple[Column, str]]:
    """The rules that a request breaks by itself; user and batch come after them."""
    # parsed once in _parsed (the columns are referenced by several rules)
    uid, bid = F.col("user_id"), F.col("batch_id")
    pay, trav = F.col("_pay"), F.col("_trav")
    rules = [(F.col("_ubad") | F.col("_bbad"), "INVALID_REFERENCE_FORMAT")]
    if with_invoice:
        rules.append((~F.coalesce(F.col("has_invoice"), F.lit(False)), "INVOICE_REQUIRED"))
    rules += [
        (blank(uid) | blank(bid) | blank("name") | blank("phone_number") | blank("email")
         | blank("payment") | blank("travellers") | blank("room_type"), "MISSING_FIELDS"),
        # beyond the stored types the reference's insert fails
        (pay.isNull() | (pay <= 0) | F.col("payment_value").isNull(), "INVALID_PAYMENT"),
        (trav.isNull() | (trav <= 0) | F.col("travellers_value").isNull(), "INVALID_TRAVELLERS"),
        (~is_email("email"), "INVALID_EMAIL"),
        (~is_phone10("phone_number"), "INVALID_PHONE"),
        (~blank("guardian_number") & ~is_phone10("guardian_number"), "INVALID_GUARDIAN_PHONE"),
    ]
    return rules


def _ref_from(text, is_json) -> "Column":
    """F10 with the JSON test precomputed: ``$.id`` of a JSON text, else the text."""
    return F.when(is_json, F.get_json_object(text, "$.id")).otherwise(text)


def _parsed(requests: DataFrame) -> DataFrame:
    """Requests with user_id, batch_id, payment_value, travellers_value and what the rules need."""
    # reference texts: "looks like JSON" is decided once per column and reused
    r = requests.select("*", looks_like_json("user_ref").alias("_uj"), looks_like_json("batch_ref").alias("_bj"),
                        js_parse_float("payment").alias("_pay"), js_parse_int("travellers").alias("_trav"))
    return r.select("*", _ref_from(F.col("user_ref"), F.col("_uj")).cast("string").alias("user_id"),
                    _ref_from(F.col("batch_ref"), F.col("_bj")).cast("string").alias("batch_id"),
                    (F.col("_uj") & ~json_text_ok("user_ref")).alias("_ubad"),
                    (F.col("_bj") & ~json_text_ok("batch_ref")).alias("_bbad"),
                    to_money(F.col("_pay")).alias("payment_value"), F.col("_trav").try_cast("int").alias("travellers_value"))


def _checked(requests: DataFrame, users: DataFrame, batches: DataFrame, with_invoice: bool) -> DataFrame:
    """Requests with their first failing rule. A request's own rules are decided where
    it is read; then only the refs that are not one row of their table are joined."""
    r = _parsed(requests)
    d = r.withColumn("error_code", first_error(_booking_rules(with_invoice))).drop("_pay", "_trav", "_uj", "_bj", "_ubad", "_bbad")
    for key, parents, code in (("user_id", users, "USER_NOT_FOUND"), ("batch_id", batches, "BATCH_NOT_FOUND")):
        odd = odd_references(r, key, parents.select(F.col("id").cast("string")))
        absent = F.col(key).isNull() | ~F.coalesce("_found", F.lit(True))
        j = d.join(odd, F.col(key) == F.col("_ref"), "left")
        d = j.withColumn("error_code", F.coalesce("error_code", F.when(absent, code))).drop("_ref", "_found")
    return d


def validate_bookings(requests: DataFrame, users: DataFrame, batches: DataFrame) -> DataFrame:
    """M5: every booking request with its first failing rule (null = valid):
    reference format, invoice present, required fields, payment > 0,
    travellers > 0, email, phone, guardian phone if given, user exists, batch
    exists. Adds user_id, batch_id, payment_value, travellers_value.

    requests: request_id, seq, user_ref, batch_ref, name, phone_number,
    guardian_number, email, payment, travellers, room_type (text), has_invoice."""
    return _checked(requests, users, batches, True)


def book_requests(bookings: DataFrame, requests: DataFrame, users: DataFrame,
                  batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The admin booking write, M5 then M6 then the insert: valid requests are
    decided in ``seq`` order against the seats that ``bookings`` leave, the
    accepted ones are appended. The outcome has M5's codes and NO_CAPACITY.

    requests: as for ``validate_bookings``; request_id is unique."""
    v = validate_bookings(requests, users, batches)
    valid = v.where(F.col("error_code").isNull())
    d = admit_bookings(batches.select("id", "max_adventurers"), bookings.select("batch_id", "travellers"),
                       valid.select("request_id", "seq", "batch_id", F.col("travellers_value").alias("travellers")))
    d = cut_lineage(d.select(F.col("request_id").alias("_rid"), "accepted", F.col("error_code").alias("_refused")))
    j = v.join(d, v["request_id"].cast("string") == d["_rid"], "left")
    new = j.where("accepted").select(
        _stable_id("request_id").alias("id"), "user_id", "batch_id", "name", "phone_number",
        F.when(~blank("guardian_number"), F.col("guardian_number")).alias("guardian_number"), "email",
        F.col("payment_value").alias("payment"), F.col("travellers_value").alias("travellers"), "room_type",
        F.lit(0).alias("invoice_id"))
    decided = j.withColumn("error_code", F.coalesce("error_code", "_refused"))
    return _append(bookings, new), outcome(decided)


def direct_bookings(bookings: DataFrame, requests: DataFrame) -> DataFrame:
    """M7: the customer-side insert: no validation, no capacity check,
    invoice_id 0. requests: request_id, userId, batch_id, fullName, number,
    guardianNumber, email, payment, travellers, roomType (text)."""
    new = requests.select(
        _stable_id("request_id").alias("id"), F.col("userId").alias("user_id"), "batch_id",
        F.col("fullName").alias("name"), F.col("number").alias("phone_number"),
        F.col("guardianNumber").alias("guardian_number"), "email",
        to_money(js_parse_float("payment")).alias("payment"),
        js_parse_int("travellers").alias("travellers"), F.col("roomType").alias("room_type"),
        F.lit(0).alias("invoice_id"))
    return _append(bookings, new)


def _last_by_seq(d: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per key, the value of each field from the request with the highest seq
    (a partial aggregate: a key with very many requests is reduced map-side)."""
    last = d.groupBy(F.col(key).alias("_id")).agg(
        F.max_by(F.struct(*[F.col(f) for f in fields]), F.col("seq")).alias("_last"))
    return last.select("_id", *[F.col(f"_last.{f}").alias(f"_new_{f}") for f in fields])


BOOKING_UPDATE_FIELDS = ["user_id", "batch_id", "name", "phone_number", "guardian_number", "email",
                         "payment", "travellers", "room_type"]


def update_bookings(bookings: DataFrame, requests: DataFrame, users: DataFrame,
                    batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M9: full-row update of existing bookings: NOT_FOUND first, then the M5
    rules without the invoice rule; no capacity check. Several accepted
    updates of one booking: the last by seq wins.

    requests: M5 columns plus ``id`` (the booking to update)."""
    v = _checked(requests, users, batches, False)
    # outcome: NOT_FOUND comes first, so it needs the existence check
    ids = bookings.select(F.col("id").cast("string").alias("_bk"))
    rx = v.select("request_id", F.col("id").cast("string").alias("_asked"), "error_code").join(
        ids, F.col("_asked") == F.col("_bk"), "left")
    d = rx.select("request_id", F.when(F.col("_bk").isNull(), "NOT_FOUND").otherwise(F.col("error_code")).alias("error_code"))
    # new table: a request for an unknown id matches no booking in the final
    # join, so the table path skips the existence check
    ok = v.where(F.col("error_code").isNull()).select(
        F.col("id").cast("string").alias("id"), "seq", "user_id", "batch_id", "name", "phone_number",
        F.when(~blank("guardian_number"), F.col("guardian_number")).alias("guardian_number"), "email",
        F.col("payment_value").alias("payment"), F.col("travellers_value").alias("travellers"),
        "room_type")
    last = _last_by_seq(ok, "id", BOOKING_UPDATE_FIELDS)
    j = bookings.join(last, bookings["id"].cast("string") == last["_id"], "left")
    def stored(c: str, t: str) -> Column:
        t = "string" if c in KEY_COLS else t
        if c not in BOOKING_UPDATE_FIELDS:
            return bookings[c].cast(t).alias(c)
        # each branch is cast to the stored type (no coercion of text ids to the old key type)
        return F.when(F.col("_id").isNotNull(), F.col(f"_new_{c}").cast(t)).otherwise(bookings[c].cast(t)).alias(c)

    cols = [stored(c, t) for c, t in bookings.dtypes]
    return j.select(*cols), outcome(d)


# ------------------------------------------------------------------ M8
# Fixed values from the reference: patchable request fields per table, the
# stored column each one sets, and how the text is converted.
PATCH_SPECS = {
    "trips": {"status": ("status", "bool"), "name": ("destination_name", "text"),
              "description": ("description", "text"), "days": ("days", "text"),
              "nights": ("nights", "int"), "destinations": ("destinations", "text"),
              "physicalRating": ("physical_rating", "int"), "daysData": ("itinerary", "text"),
              "totalImageCount": ("images", "int")},
    "batches": {"batchName": ("batch_name", "text"), "assignedTrip": ("trip_id", "text"),
                "startDate": ("from_date", "int"), "endDate": ("to_date", "int"),
                "standardPrice": ("price", "int"), "singleRoom": ("single_room", "int0"),
                "doubleRoom": ("double_room", "int0"), "tripleRoom": ("triple_room", "int"),
                "tax": ("tax", "int"), "maxAdventurers": ("max_adventurers", "int"),
                "status": ("status", "bool")},
    "coupons": {"deduction": ("deduction", "float"), "startDate": ("start_date", "int"),
                "endDate": ("end_date", "int"), "status": ("status", "bool")},
    "user_role": {"role": ("role", "role")},
    "user_profile": {"name": ("name", "text"), "phoneNumber": ("phone_number", "text"),
                     "gender": ("gender", "text"), "emergencyContact": ("emergency_contact", "text"),
                     "address": ("address", "text")},
}


def _convert(c: str, how: str) -> Column:
    col = F.col(c)
    if how == "int":
        return js_parse_int(col)
    if how == "int0":
        return F.coalesce(js_parse_int(col), F.lit(0))
    if how == "float":
        return to_money(js_parse_float(col))
    if how == "bool":
        return F.lower(col.cast("string")).isin("true", "1", "t")
    if how == "role":
        return norm_role(col)
    return col.cast("string")


def _refused_names(trips: DataFrame, named: DataFrame) -> DataFrame:
    """Name patches (request_id, seq, _cid, name) that another trip's name stands
    against when their turn comes, decided as if one after the other.

    Rounds work on the patches and on the trips that hold one of their names, never on
    all trips. Each knows which patches are accepted (A) or still open (U). A trip
    holds a name for sure from the patch that gave it until its next patch, and
    perhaps until its next accepted one. Running counts over a name's events (all
    trips, and the patched trip itself) tell each open patch whether another trip
    holds the name for sure (refused), or not at all (accepted). The open patch
    with the smallest seq is always decided, and all that do not wait for another;
    rounds are as many as the longest chain of patches that wait for each other."""
    seq = dict(named.dtypes)["seq"]
    todo = cut_lineage(named.select("request_id", "seq", F.col("_cid").alias("trip"), "name",
                                    F.lit("U").alias("state")))
    stored = trips.select(F.lit(None).cast(todo.schema["request_id"].dataType).alias("request_id"),
                          F.lit(None).cast(seq).alias("seq"), F.col("id").cast("string").alias("trip"),
                          F.col("destination_name").alias("name"), F.lit("A").alias("state"))
    # only trips that hold a name asked for have a say: rounds read these, not all trips
    stored = cut_lineage(stored.join(todo.select("name").distinct(), "name", "left_semi").select(todo.columns))
    while not todo.where("state = 'U'").isEmpty():
        later = (Window.partitionBy("trip").orderBy(F.col("seq").asc_nulls_first())
                 .rowsBetween(1, Window.unboundedFollowing))
        kept = stored.unionByName(todo.where("state <> 'R'"))
        held = kept.select("*", F.min("seq").over(later).alias("next"),
                           F.min(F.when(F.col("state") == "A", F.col("seq"))).over(later).alias("next_sure"))
        held = held.where(F.col("name").isNotNull())
        sure = F.col("state") == "A"
        gone = F.col("at").isNotNull()  # the name is never given up without a next patch

        def events(at, d_sure, d_may):
            return held.select("trip", "name", at.alias("at"), F.lit(1).alias("turn"), d_sure.alias("sure"),
                               d_may.alias("may"), F.lit(None).cast("string").alias("state"),
                               F.lit(None).cast(seq).alias("seq"), F.lit(None).cast(stored.schema["request_id"].dataType)
                               .alias("request_id"))
        zero, one = F.lit(0), F.lit(1)
        asked = todo.where("state = 'U'").select("trip", "name", F.col("seq").alias("at"), F.lit(0).alias("turn"),
                                                 zero.alias("sure"), zero.alias("may"), "state", "seq", "request_id")
        line = (asked.unionByName(events(F.col("seq"), F.when(sure, 1).otherwise(0), one))
                .unionByName(events(F.col("next"), F.when(sure, -1).otherwise(0), zero).where(gone))
                .unionByName(events(F.col("next_sure"), zero, F.lit(-1)).where(gone)))
        order = [F.col("at").asc_nulls_first(), F.col("turn")]
        every = Window.partitionBy("name").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        own = Window.partitionBy("name", "trip").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        seen = line.select("*", F.sum("sure").over(every).alias("all_sure"), F.sum("may").over(every).alias("all_may"),
                           F.sum("sure").over(own).alias("own_sure"), F.sum("may").over(own).alias("own_may"))
        others_sure, others_may = F.col("all_sure") - F.col("own_sure"), F.col("all_may") - F.col("own_may")
        verdict = (F.when((F.col("own_sure") > 0) | (others_may == 0), "A")
                   .when((F.col("own_may") == 0) & (others_sure > 0), "R").otherwise("U"))
        decided = seen.where("turn = 0").select("request_id", "seq", "trip", "name", verdict.alias("state"))
        todo = cut_lineage(todo.where("state <> 'U'").unionByName(decided))
    return todo.where("state = 'R'").select("request_id", "seq")


def apply_patches(table: DataFrame, patches: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """M8: partial updates. ``set_fields`` (array of request field names) tells
    "given" from "given as null"; only given fields change (user_profile sets
    all five fields, missing ones become null). Rules per kind:

    * trips: NOT_FOUND, DUPLICATE_NAME (new name held by *another* trip), NO_FIELDS
    * batches: NOT_FOUND, INVALID_DATES (only when both dates are given), NO_FIELDS
    * coupons: NOT_FOUND, NO_FIELDS (the code cannot change)
    * user_role: ROLE_REQUIRED, INVALID_ROLE, NOT_FOUND
    * user_profile: NOT_FOUND

    Patches are decided one after the other in ``seq`` order (``seq`` is unique in
    a run): a name taken by an earlier accepted patch is held, one given up by an
    earlier rename is free. Accepted patches of one id are applied in that order:
    per field the last given value wins.

    patches: request_id, seq, id, set_fields, one text column per request field."""
    spec = PATCH_SPECS[kind]
    if kind == "user_profile":  # every profile field is written; absent ones as null
        patches = patches.select("*", *[F.lit(None).cast("string").alias(f) for f in spec
                                        if f not in patches.columns])
    else:  # a field without a column can never be given
        spec = {f: v for f, v in spec.items() if f in patches.columns}
    sf = F.coalesce(F.col("set_fields"), F.array().cast("array<string>"))
    given = {f: F.array_contains(sf, f) for f in spec}
    never = F.lit(False)
    cur = table.select(F.col("id").cast("string").alias("_cid"),
                       *([F.col("destination_name").alias("_cur_name")] if kind == "trips" else []))
    p = patches.join(cur, patches["id"].cast("string") == cur["_cid"], "left")
    not_found = (F.col("_cid").isNull(), "NOT_FOUND")
    no_fields = (~any_of(*given.values()), "NO_FIELDS")
    if kind == "trips" and "name" not in patches.columns:
        patches = patches.withColumn("name", F.lit(None).cast("string"))
        p = p.withColumn("name", F.lit(None).cast("string"))
    if kind == "trips":
        named = p.where(given.get("name", never) & F.col("_cid").isNotNull() & F.col("name").isNotNull())
        refused = _refused_names(table, named).select(F.col("request_id").alias("_rr"), F.col("seq").alias("_rs"),
                                                      F.lit(True).alias("_taken"))
        p = p.join(refused, (p["request_id"] == refused["_rr"]) & (p["seq"] == refused["_rs"]), "left")
        rules = [not_found, (F.col("_taken").isNotNull(), "DUPLICATE_NAME"), no_fields]
    elif kind == "batches":
        rules = [not_found, no_fields]
        if "startDate" in spec and "endDate" in spec:  # the dates rule needs both given
            both = given["startDate"] & given["endDate"] & ~blank("startDate") & ~blank("endDate")
            rules.insert(1, (both & (js_parse_int("endDate") <= js_parse_int("startDate")), "INVALID_DATES"))
    elif kind == "coupons":
        rules = [not_found, no_fields]
    elif kind == "user_role":
        rules = [(blank("role"), "ROLE_REQUIRED"), (~is_role("role"), "INVALID_ROLE"), not_found]
    elif kind == "user_profile":
        rules = [not_found]
        given = {f: F.lit(True) for f in spec}
    else:
        raise ValueError(kind)
    d = p.withColumn("error_code", first_error(rules))
    ok = d.where(F.col("error_code").isNull())
    vals = ok.select(F.col("id").cast("string").alias("id"), "seq",
                     *[F.when(given[f], F.struct(_convert(f, how).alias("v"))).alias(f"_v_{f}")
                       for f, (_, how) in spec.items()])
    agg = vals.groupBy(F.col("id").alias("_id")).agg(
        *[F.max_by(F.col(f"_v_{f}"), F.when(F.col(f"_v_{f}").isNotNull(), F.col("seq"))).alias(f"_n_{f}")
          for f in spec])
    j = table.join(agg, table["id"].cast("string") == agg["_id"], "left")
    by_col = {col: f for f, (col, _) in spec.items()}
    out = []
    for c, t in table.dtypes:
        t = "string" if c in KEY_COLS else t
        if c in by_col:
            n = F.col(f"_n_{by_col[c]}")
            out.append(F.when(n.isNotNull(), n["v"].cast(t)).otherwise(table[c].cast(t)).alias(c))
        else:
            out.append(table[c].cast(t).alias(c))
    return j.select(*out), outcome(d)


# ------------------------------------------------------------------ J8, M10-M13
def _ids(ids: DataFrame, col: str = "id") -> DataFrame:
    return ids.select(F.col(col).cast("string").alias("_del")).distinct()


def cascade_keys(bookings: DataFrame, batches: DataFrame, trip_ids: DataFrame) -> DataFrame:
    """Bookings whose batch belongs to one of the trips
    (``batch_id IN (SELECT id FROM batches WHERE trip_id = ...)``)."""
    t = _ids(trip_ids)
    b = small_side(cut_lineage(batches.join(t, batches["trip_id"].cast("string") == t["_del"], "left_semi").select(
        F.col("id").cast("string").alias("_bid"))))
    return bookings.join(b, bookings["batch_id"].cast("string") == b["_bid"], "left_semi")


def delete_trips_cascade(trips: DataFrame, batches: DataFrame, bookings: DataFrame,
                         ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Remove the trips, their batches and the bookings of those batches;
    an unknown trip id changes nothing (NOT_FOUND). Returns (trips, batches,
    bookings, outcome). ids: (request_id, id)."""
    req = ids.select("request_id", F.col("id").cast("string").alias("_rid"))
    known = trips.select(F.col("id").cast("string").alias("_tid"))
    oc = req.join(known, req["_rid"] == known["_tid"], "left")
    out = oc.select("request_id", F.col("_tid").isNotNull().alias("accepted"),
                    F.when(F.col("_tid").isNull(), "NOT_FOUND").alias("error_code"))
    gone = oc.where(F.col("_tid").isNotNull()).select(F.col("_tid").alias("id"))
    g = _ids(gone)
    # bookings go with their batch: anti join on the set of deleted batch ids
    gone_batches = small_side(cut_lineage(batches.join(g, batches["trip_id"].cast("string") == g["_del"], "left_semi")
                                          .select(F.col("id").cast("string").alias("_gb"))))
    new_bookings = bookings.join(gone_batches, bookings["batch_id"].cast("string") == F.col("_gb"),
                                 "left_anti")
    new_batches = batches.join(g, batches["trip_id"].cast("string") == g["_del"], "left_anti")
    new_trips = trips.join(g, trips["id"].cast("string") == g["_del"], "left_anti")
    return new_trips, new_batches, new_bookings, out


def _restricted_delete(table: DataFrame, refs: DataFrame, ref_col: str,
                       ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    req = ids.select("request_id", F.col("id").cast("string").alias("_rid"))
    known = table.select(F.col("id").cast("string").alias("_kid"))
    # only references to requested ids: the few ids go to the many references
    asked = req.select("_rid").distinct()
    used = refs.select(F.col(ref_col).cast("string").alias("_uid")).join(
        asked, F.col("_uid") == F.col("_rid"), "left_semi").distinct().withColumn("_used", F.lit(True))
    oc = (req.join(known, req["_rid"] == known["_kid"], "left")
          .join(used, F.col("_rid") == F.col("_uid"), "left"))
    err = first_error([(F.col("_kid").isNull(), "NOT_FOUND"), (F.col("_used").isNotNull(), "HAS_BOOKINGS")])
    oc = oc.withColumn("error_code", err)
    gone = _ids(oc.where(F.col("error_code").isNull()).select(F.col("_rid").alias("id")))
    new = table.join(gone, table["id"].cast("string") == gone["_del"], "left_anti")
    return new, outcome(oc)


def delete_batches_restricted(batches: DataFrame, bookings: DataFrame,
                              ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete only batches without bookings (else HAS_BOOKINGS); unknown -> NOT_FOUND."""
    return _restricted_delete(batches, bookings, "batch_id", ids)


def delete_users_restricted(users: DataFrame, bookings: DataFrame,
                            ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete only users without bookings (else HAS_BOOKINGS); unknown -> NOT_FOUND."""
    return _restricted_delete(users, bookings, "user_id", ids)


def delete_rows(table: DataFrame, ids: DataFrame, report_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """Unconditional delete by id. Coupons and bookings report NOT_FOUND
    for unknown ids (``report_missing``), leads do not."""
    req = ids.select("request_id", F.col("id").cast("string").alias("_rid"))
    known = table.select(F.col("id").cast("string").alias("_kid"))
    oc = req.join(known, req["_rid"] == known["_kid"], "left")
    err = F.when(F.col("_kid").isNull(), "NOT_FOUND") if report_missing else F.lit(None).cast("string")
    oc = oc.withColumn("error_code", err)
    g = _ids(ids)
    new = table.join(g, table["id"].cast("string") == g["_del"], "left_anti")
    return new, outcome(oc)


def delete_bookings(bookings: DataFrame, manifest: DataFrame,
                    ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M13 for bookings: the rows go and with them their files ``{id}.*``.
    Returns (bookings, manifest, outcome)."""
    new, out = delete_rows(bookings, ids)
    kind, owner = media_owner(F.col("key"))
    m = manifest.select("*", kind.alias("_kind"), owner.alias("_owner"))
    gone = bookings.select(F.col("id").cast("string").alias("_bk")).join(
        _ids(ids), F.col("_bk") == F.col("_del"), "left_semi")
    files = m.join(gone, (F.col("_kind") == "booking") & (F.col("_owner") == F.col("_bk")), "left_anti")
    return new, files.drop("_kind", "_owner"), out
