"""Edge fixtures: booking_rules, inserts, patches, deletes (+ properties)."""
from caravan.operators import changes as CH
from caravan.sources.constraints import constraint_report
from helpers import rows

REQ = ("request_id string, seq long, user_ref string, batch_ref string, name string, phone_number string, "
       "guardian_number string, email string, payment string, travellers string, room_type string, "
       "has_invoice boolean")


def _dims(spark):
    users = spark.createDataFrame([("u1", "A", "a@x.io")], "id string, name string, email string")
    batches = spark.createDataFrame([("b1", "t1", 10)], "id string, trip_id string, max_adventurers int")
    return users, batches


def test_booking_rules_first_wins(spark):
    users, batches = _dims(spark)
    ok = ("u1", "b1", "N", "9876543210", None, "n@x.io", "100", "2", "single", True)
    cases = {
        "bad_ref": ('{"id": ', "b1") + ok[2:],
        "json_ref": ('{"id": "u1"}', "b1") + ok[2:],
        "no_invoice": ok[:-1] + (False,),
        "missing": ("u1", "b1", "", "9876543210", None, "n@x.io", "100", "2", "single", True),
        "pay0": ok[:6] + ("0",) + ok[7:],
        "pay_text": ok[:6] + ("12abc",) + ok[7:],
        "pay_empty_and_bad_email": ok[:5] + ("bad", "") + ok[7:],
        "trav0": ok[:7] + ("0",) + ok[8:],
        "email": ok[:5] + ("bad@x",) + ok[6:],
        "phone9": ok[:3] + ("987654321",) + ok[4:],
        "phone_nl": ok[:3] + ("9876543210\n",) + ok[4:],
        "guardian": ok[:4] + ("12345",) + ok[5:],
        "user": ("uX",) + ok[1:],
        "batch": ("u1", "bX") + ok[2:],
        "valid": ok,
    }
    data = [(k, i) + v for i, (k, v) in enumerate(cases.items())]
    out = dict(rows(CH.validate_bookings(spark.createDataFrame(data, REQ), users, batches),
                    "request_id", "error_code"))
    assert out == {"bad_ref": "INVALID_REFERENCE_FORMAT", "json_ref": None, "no_invoice": "INVOICE_REQUIRED",
                   "missing": "MISSING_FIELDS", "pay0": "INVALID_PAYMENT", "pay_text": None,
                   "pay_empty_and_bad_email": "MISSING_FIELDS", "trav0": "INVALID_TRAVELLERS",
                   "email": "INVALID_EMAIL", "phone9": "INVALID_PHONE", "phone_nl": "INVALID_PHONE",
                   "guardian": "INVALID_GUARDIAN_PHONE", "user": "USER_NOT_FOUND", "batch": "BATCH_NOT_FOUND",
                   "valid": None}


def test_insert_users_order_and_duplicates(spark):
    users = spark.createDataFrame([("u1", "A", "a@x.io", "1", 1, "user", None, None, None)],
                                  "id string, name string, email string, phone_number string, created_at long, "
                                  "role string, gender string, emergency_contact string, address string")
    req = spark.createDataFrame([
        ("r1", 1, "B", "a@x.io", "0123456789", "guest"),      # stored email wins over the role rule
        ("r2", 2, "C", "c@x.io", "0123456789", "guest"),      # invalid role does not block c@
        ("r3", 3, "C", "c@x.io", "0123456789", " Admin "),    # first valid c@
        ("r4", 4, "C", "c@x.io", "0123456789", "user"),       # duplicate within the batch
        ("r5", 5, "D", "d@x.io", "12345", "user"),
    ], "request_id string, seq long, name string, email string, phoneNumber string, role string")
    new, oc = CH.insert_users(users, req, 99)
    assert dict(rows(oc, "request_id", "error_code")) == {
        "r1": "DUPLICATE_EMAIL", "r2": "INVALID_ROLE", "r3": None, "r4": "DUPLICATE_EMAIL", "r5": "INVALID_PHONE"}
    added = [r for r in new.collect() if r["email"] == "c@x.io"]
    assert len(added) == 1 and added[0]["role"] == "admin" and added[0]["phone_number"] == "123456789"
    assert "password" not in new.columns


def test_insert_batches_zero_rules(spark):
    batches = spark.createDataFrame([("b1", "t1", "Old", 1, 5, True)],
                                    "id string, trip_id string, batch_name string, single_room int, "
                                    "created_at long, status boolean")
    trips = spark.createDataFrame([("t1",)], "id string")
    cols = ("request_id string, seq long, batchName string, assignedTrip string, startDate string, endDate string, "
            "standardPrice string, singleRoom string, doubleRoom string, tripleRoom string, tax string, "
            "maxAdventurers string, createdAt string, status string")
    base = ["N", "t1", "100", "200", "50", None, None, "0", "0", "10", None, None]
    req = spark.createDataFrame([
        ("ok", 1, *base),
        ("price0", 2, "P", "t1", "100", "200", "0", None, None, "0", "0", "10", None, None),
        ("tax_missing", 3, "T", "t1", "100", "200", "5", None, None, "0", None, "10", None, None),
        ("dates", 4, "D", "t1", "200", "200", "5", None, None, "0", "0", "10", None, None),
        ("dup_old", 5, "Old", "t1", "100", "200", "5", None, None, "0", "0", "10", None, None),
        ("no_trip", 6, "Q", "tX", "100", "200", "5", None, None, "0", "0", "10", None, None),
    ], cols)
    new, oc = CH.insert_batches(batches, req, trips, 77)
    assert dict(rows(oc, "request_id", "error_code")) == {
        "ok": None, "price0": "MISSING_FIELDS", "tax_missing": "MISSING_FIELDS", "dates": "INVALID_DATES",
        "dup_old": "DUPLICATE_NAME", "no_trip": "TRIP_NOT_FOUND"}
    n = [r for r in new.collect() if r["batch_name"] == "N"][0]
    assert (n["single_room"], n["created_at"], n["status"]) == (0, 77, True)


def test_insert_coupons_case_kept(spark):
    coupons = spark.createDataFrame([("1", "SAVE", 5, 0, 1, True)],
                                    "id string, code string, deduction int, start_date long, end_date long, "
                                    "status boolean")
    req = spark.createDataFrame([("r1", 1, "save", "10.5", "1", "2"), ("r2", 2, "SAVE", "1", "1", "2")],
                                "request_id string, seq long, couponCode string, deduction string, "
                                "startDate string, endDate string")
    new, oc = CH.insert_coupons(coupons, req)
    assert dict(rows(oc, "request_id", "error_code")) == {"r1": None, "r2": "DUPLICATE_CODE"}
    assert {r["code"] for r in new.collect()} == {"SAVE", "save"}
    _, oc2 = CH.insert_coupons(coupons, req, normalize=True)
    assert dict(rows(oc2, "request_id", "error_code"))["r1"] == "DUPLICATE_CODE"


def test_insert_trips_rules(spark):
    trips = spark.createDataFrame([("t1", "Spiti")], "id string, destination_name string")
    cols = ("request_id string, seq long, name string, description string, numberOfDays string, daysData string, "
            "days string, nights string, destinations string, physicalRating string, n_images int, "
            "has_itinerary boolean")
    j = '{"1":{"title":"a","content":"b"}}'
    req = spark.createDataFrame([
        ("dup", 1, "Spiti", "d", "2", j, "2", "1", "x", "3", 2, True),
        ("bad_json", 2, "Goa", "d", "2", "{1:{title:'a'}}", "2", "1", "x", "3", 2, True),
        ("ok", 3, "Goa", "d", "2", j, "2", "1", "x", "3", 2, True),
        ("dup_batch", 4, "Goa", "d", "2", j, "2", "1", "x", "3", 2, True),
        ("no_img", 5, "Kerala", "d", "2", j, "2", "1", "x", "3", 0, True),
        ("trailing", 6, "Ooty", "d", "2", j + " x", "2", "1", "x", "3", 1, True),
    ], cols)
    new, oc = CH.insert_trips(trips, req)
    assert dict(rows(oc, "request_id", "error_code")) == {
        "dup": "DUPLICATE_NAME", "bad_json": "INVALID_DAYS_JSON", "ok": None, "dup_batch": "DUPLICATE_NAME",
        "no_img": "IMAGE_REQUIRED", "trailing": "INVALID_DAYS_JSON"}


def test_patches(spark):
    trips = spark.createDataFrame([("t1", "Spiti", "d1", 3), ("t2", "Goa", "d2", 4)],
                                  "id string, destination_name string, description string, nights int")
    p = spark.createDataFrame([
        ("p1", 1, "t1", ["description"], None, None, None),          # set to null
        ("p2", 2, "t1", ["name"], "Spiti", None, None),              # rename to own name: fine
        ("p3", 3, "t2", ["name"], "Spiti", None, None),              # another trip's name
        ("p4", 4, "t2", [], None, None, None),
        ("p5", 5, "tX", ["nights"], None, None, "5"),
        ("p6", 6, "t2", ["nights"], None, None, "6x"),
    ], "request_id string, seq long, id string, set_fields array<string>, name string, description string, "
       "nights string")
    new, oc = CH.apply_patches(trips, p, "trips")
    assert dict(rows(oc, "request_id", "error_code")) == {
        "p1": None, "p2": None, "p3": "DUPLICATE_NAME", "p4": "NO_FIELDS", "p5": "NOT_FOUND", "p6": None}
    assert rows(new) == [("t1", "Spiti", None, 3), ("t2", "Goa", "d2", 6)]
    # no patches = identity
    same, _ = CH.apply_patches(trips, p.limit(0), "trips")
    assert rows(same) == rows(trips)


def test_batch_patch_dates_only_when_both(spark):
    b = spark.createDataFrame([("b1", 100, 200)], "id string, from_date long, to_date long")
    p = spark.createDataFrame([("p1", 1, "b1", ["endDate"], "500", "50"),
                               ("p2", 2, "b1", ["startDate", "endDate"], "300", "250")],
                              "request_id string, seq long, id string, set_fields array<string>, "
                              "startDate string, endDate string")
    new, oc = CH.apply_patches(b, p, "batches")
    assert dict(rows(oc, "request_id", "error_code")) == {"p1": None, "p2": "INVALID_DATES"}
    assert rows(new) == [("b1", 100, 50)]


def test_user_role_and_profile(spark):
    u = spark.createDataFrame([("u1", "A", "user", "1", "f", "x", "addr")],
                              "id string, name string, role string, phone_number string, gender string, "
                              "emergency_contact string, address string")
    p = spark.createDataFrame([("r1", 1, "u1", ["role"], " SuperAdmin "), ("r2", 2, "u1", ["role"], ""),
                               ("r3", 3, "uX", ["role"], "guest")],
                              "request_id string, seq long, id string, set_fields array<string>, role string")
    new, oc = CH.apply_patches(u, p, "user_role")
    assert dict(rows(oc, "request_id", "error_code")) == {"r1": None, "r2": "ROLE_REQUIRED", "r3": "INVALID_ROLE"}
    assert new.collect()[0]["role"] == "superadmin"
    prof = spark.createDataFrame([("q1", 1, "u1", None, "B")],
                                 "request_id string, seq long, id string, set_fields array<string>, name string")
    new, _ = CH.apply_patches(u, prof, "user_profile")
    r = new.collect()[0]
    assert (r["name"], r["gender"], r["address"], r["role"]) == ("B", None, None, "user")


def test_deletes_leave_no_orphans(spark):
    trips = spark.createDataFrame([("t1", "A"), ("t2", "B")], "id string, destination_name string")
    batches = spark.createDataFrame([("b1", "t1", "X1"), ("b2", "t2", "X2"), ("b3", "t2", "X3")],
                                    "id string, trip_id string, batch_name string")
    bookings = spark.createDataFrame([("k1", "u1", "b1", 1), ("k2", "u1", "b2", 1)],
                                     "id string, user_id string, batch_id string, travellers int")
    users = spark.createDataFrame([("u1", "n"), ("u2", "m")], "id string, name string")
    ids = spark.createDataFrame([("r1", "t2"), ("r2", "tX")], "request_id string, id string")
    nt, nb, nk, oc = CH.delete_trips_cascade(trips, batches, bookings, ids)
    assert dict(rows(oc, "request_id", "error_code")) == {"r1": None, "r2": "NOT_FOUND"}
    assert rows(nt, "id") == [("t1",)] and rows(nb, "id") == [("b1",)] and rows(nk, "id") == [("k1",)]
    rep = constraint_report({"trips": nt, "batches": nb, "bookings": nk, "users": users})
    assert all(r["violations"] == 0 for r in rep.where("kind = 'orphan_fk'").collect())
    del_b = spark.createDataFrame([("r1", "b1"), ("r2", "b3"), ("r3", "bX")], "request_id string, id string")
    nb2, oc2 = CH.delete_batches_restricted(batches, bookings, del_b)
    assert dict(rows(oc2, "request_id", "error_code")) == {"r1": "HAS_BOOKINGS", "r2": None, "r3": "NOT_FOUND"}
    assert rows(nb2, "id") == [("b1",), ("b2",)]
    del_u = spark.createDataFrame([("r1", "u1"), ("r2", "u2")], "request_id string, id string")
    nu, oc3 = CH.delete_users_restricted(users, bookings, del_u)
    assert dict(rows(oc3, "request_id", "error_code")) == {"r1": "HAS_BOOKINGS", "r2": None}
    leads = spark.createDataFrame([("l1",)], "id string")
    nl, oc4 = CH.delete_rows(leads, spark.createDataFrame([("r", "lX")], "request_id string, id string"), False)
    assert rows(oc4, "error_code") == [(None,)] and nl.count() == 1


def test_coupon_patches(spark):
    c = spark.createDataFrame([("c1", "SAVE", 5, 1, 2, True)],
                              "id string, code string, deduction int, start_date long, end_date long, "
                              "status boolean")
    p = spark.createDataFrame([("p1", 1, "c1", ["deduction", "status"], "12.5", "false", "NEW"),
                               ("p2", 2, "cX", ["deduction"], "1", None, None),
                               ("p3", 3, "c1", ["code"], None, None, "NEW")],
                              "request_id string, seq long, id string, set_fields array<string>, deduction string, "
                              "status string, code string")
    new, oc = CH.apply_patches(c, p, "coupons")
    assert dict(rows(oc, "request_id", "error_code")) == {"p1": None, "p2": "NOT_FOUND", "p3": "NO_FIELDS"}
    r = new.collect()[0]
    assert (r["code"], r["deduction"], r["status"]) == ("SAVE", 12, False)  # code cannot change


def test_text_refs_into_numeric_keys(spark):
    """Requests name parents by text; stored numeric keys become text, no cast error."""
    bookings = spark.createDataFrame([("k1", 1, 10, "n", "0123456789", None, "a@b.co", 5, 1, "single", 0)],
                                     "id string, user_id bigint, batch_id bigint, name string, phone_number string, "
                                     "guardian_number string, email string, payment bigint, travellers int, "
                                     "room_type string, invoice_id int")
    users = spark.createDataFrame([("u-x",)], "id string")
    batches = spark.createDataFrame([("b-y",)], "id string")
    req = spark.createDataFrame([("k1", "r1", "1", '{"id": "u-x"}', "b-y", "N", "0123456789", None, "a@b.co", "7",
                                  "2", "double", True)],
                                "id string, request_id string, seq string, user_ref string, batch_ref string, "
                                "name string, phone_number string, guardian_number string, email string, "
                                "payment string, travellers string, room_type string, has_invoice boolean")
    new, oc = CH.update_bookings(bookings, req, users, batches)
    assert rows(oc, "error_code") == [(None,)]
    r = new.collect()[0]
    assert (r["user_id"], r["batch_id"], r["travellers"]) == ("u-x", "b-y", 2)
    b2 = spark.createDataFrame([(1, 5, 100, 200)], "id bigint, trip_id bigint, from_date long, to_date long")
    p = spark.createDataFrame([("p", 1, "1", ["assignedTrip"], "trip-text")],
                              "request_id string, seq long, id string, set_fields array<string>, assignedTrip string")
    nb, _ = CH.apply_patches(b2, p, "batches")
    assert nb.collect()[0]["trip_id"] == "trip-text"


def test_insert_users_ties_and_null_seq(spark):
    """One of several requests of a key with one arrival number, or with none, is accepted."""
    users = spark.createDataFrame([], "id string, name string, email string, phone_number string, created_at long, role string")
    req = spark.createDataFrame(
        [("c", 1, "a@x.y"), ("b", 1, "a@x.y"), ("a", None, "a@x.y"), ("d", None, "n@x.y"), ("e", None, "n@x.y"),
         ("f", 2, "n2@x.y"), ("g", None, "n2@x.y")], "request_id string, seq int, email string")
    req = req.selectExpr("*", "'N' AS name", "'0123456789' AS phoneNumber", "'user' AS role")
    table, out = CH.insert_users(users, req, 1)
    assert sorted(r["request_id"] for r in out.where("accepted").collect()) == ["b", "d", "f"]
    assert table.count() == 3
