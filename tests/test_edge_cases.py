"""Inputs that the registered queries' tables do not hold."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caravan.functions import columns as FN
from caravan.functions.itinerary import itinerary_table
from caravan.functions.sql import register_functions
from caravan.operators import changes as CH
from caravan.operators.admission import admit_bookings
from caravan.plans.shapes import with_group_count
from helpers import rows

PARSE_INT = {"0x10": 16, "-0X1f": -31, "0x": 0, " 12": 12, "﻿　7a": 7, " +5.9": 5, "x1": None, "": None,
             "99999999999999999999": None, "010": 10}
EMAIL = {"a@b.de": True, "a b@c.de": False, "a @c.de": False, "a@b": False, "a@b.c\n": False, "a@@b.c": False}
JSON = {'{"id":"b","id":"b"}': True, '{"a":1}{"b":2}': False, '{"a":1} x }': False, "[1] [2]": False, '"x" y': False,
        '"x"': True, " [1, 2]\n": True, "{a:1}": False, "{'a':1}": False, "[NaN]": False, "[01]": False, "": False,
        "  ": False, "1": True, "1,2": False, "null": True, '{"a":{"b":[{}]}}': True, "{": False}


def test_text_rules_as_column_and_sql(spark):
    register_functions(spark)
    df = spark.createDataFrame([(s,) for s in [*PARSE_INT, *EMAIL, " ab ", "  Admin"]], "s string")
    got = {r.s: r for r in df.select("s", FN.js_parse_int("s").alias("i"), FN.is_email("s").alias("e"),
                                     FN.js_parse_float("s").alias("f")).collect()}
    assert {s: got[s].i for s in PARSE_INT} == PARSE_INT
    assert {s: got[s].e for s in EMAIL} == EMAIL
    assert got[" 12"].f == 12.0
    for name in ("js_parse_int", "is_email", "norm_code", "norm_role", "slug", "is_role"):
        same = df.where(~getattr(FN, name)("s").eqNullSafe(F.expr(f"{name}(s)")))
        assert same.collect() == [], name


def test_json_as_json_parse(spark):
    df = spark.createDataFrame([(s,) for s in JSON], "s string")
    assert {r.s: r.ok for r in df.select("s", FN.json_text_ok("s").alias("ok")).collect()} == JSON


def test_itinerary_with_text_after_it_is_rejected(spark):
    good = '{"3":{"title":"a","content":"x"},"3":{"title":"b","content":"y"}}'
    t = spark.createDataFrame([(1, good), (2, good + ' {"4":{}}')], "id long, itinerary string")
    days, rejects = itinerary_table(t)
    assert rows(days, "trip_id", "day", "title") == [(1, "3", "b")]
    assert rows(rejects, "trip_id") == [(2,)]


def _request(i, **kw):
    base = {"request_id": f"r{i}", "seq": i, "user_ref": "u", "batch_ref": "b", "name": "n", "phone_number": "0123456789",
            "guardian_number": "", "email": "a@b.de", "payment": "10", "travellers": "2", "room_type": "single",
            "has_invoice": True}
    return {**base, **kw}


REQUEST = ("request_id string, seq long, user_ref string, batch_ref string, name string, phone_number string, "
           "guardian_number string, email string, payment string, travellers string, room_type string, "
           "has_invoice boolean")


def _parents(spark):
    return (spark.createDataFrame([("u",)], "id string"),
            spark.createDataFrame([("b", 10)], "id string, max_adventurers int"))


def test_every_booking_rule(spark):
    cases = [({}, None), ({"user_ref": '{"id":"u"}'}, None), ({"user_ref": '{"id":"u"} x'}, "INVALID_REFERENCE_FORMAT"),
             ({"has_invoice": None}, "INVOICE_REQUIRED"), ({"name": ""}, "MISSING_FIELDS"),
             ({"payment": "20000000000"}, "INVALID_PAYMENT"), ({"payment": "-1"}, "INVALID_PAYMENT"),
             ({"travellers": "3000000000"}, "INVALID_TRAVELLERS"), ({"travellers": "0x2"}, None),
             ({"email": "a@b"}, "INVALID_EMAIL"), ({"phone_number": "1"}, "INVALID_PHONE"),
             ({"guardian_number": "1"}, "INVALID_GUARDIAN_PHONE"), ({"user_ref": "v"}, "USER_NOT_FOUND"),
             ({"batch_ref": "c"}, "BATCH_NOT_FOUND")]
    req = spark.createDataFrame([_request(i, **kw) for i, (kw, _) in enumerate(cases)], REQUEST)
    got = {r.request_id: r.error_code for r in CH.validate_bookings(req, *_parents(spark)).collect()}
    assert got == {f"r{i}": code for i, (_, code) in enumerate(cases)}


@pytest.mark.parametrize("kind", ["int", "long", "decimal(10,0)"])
def test_admission_in_numeric_order(spark, kind):
    batches = spark.createDataFrame([("b", 10)], "id string, max_adventurers int")
    req = spark.createDataFrame([("late", 10, "b", 8), ("early", 2, "b", 8), ("other", 11, None, 1)],
                                "request_id string, seq int, batch_id string, travellers int")
    out = admit_bookings(batches, None, req.withColumn("seq", F.col("seq").cast(kind)))
    assert rows(out, "request_id", "error_code") == [("early", None), ("late", "NO_CAPACITY"),
                                                     ("other", "BATCH_NOT_FOUND")]
    assert dict(out.dtypes)["seq"] == {"long": "bigint"}.get(kind, kind)


def test_book_requests(spark):
    users, batches = _parents(spark)
    bookings = spark.createDataFrame([("k", "u", "b", "n", "1", None, "a@b.de", Decimal(5), 3, "single", 0)],
                                     "id string, user_id string, batch_id string, name string, phone_number string, "
                                     "guardian_number string, email string, payment decimal(12,2), travellers int, "
                                     "room_type string, invoice_id int")
    req = spark.createDataFrame([_request(10, travellers="6"), _request(2, travellers="6"), _request(11, travellers="1"),
                                 _request(12, name="")], REQUEST)
    new, out = CH.book_requests(bookings, req, users, batches)
    assert rows(out, "request_id", "accepted", "error_code") == [
        ("r10", False, "NO_CAPACITY"), ("r11", True, None), ("r12", False, "MISSING_FIELDS"), ("r2", True, None)]
    assert sorted(r.travellers for r in new.collect()) == [1, 3, 6]
    assert new.dtypes == bookings.dtypes


def test_group_count_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert rows(with_group_count(df, ["k"])) == [("a", 3, 1), (None, 1, 2), (None, 2, 2)]
    assert rows(with_group_count(df, []), "total_count") == [(3,)] * 3


def test_patches_of_one_run_are_decided_in_turn(spark):
    """Against a plain loop: names taken and given up within the run."""
    import random
    for seed in range(3):
        rnd = random.Random(seed)
        trips = [(i, f"n{i % 9}") for i in range(11)]
        patches = [(f"r{k}", k, rnd.randrange(12), ["name"] if rnd.random() < 0.9 else [], f"n{rnd.randrange(12)}")
                   for k in range(40)]
        names, want = dict(trips), {}
        for r, _, i, fields, name in patches:
            taken = any(v == name for j, v in names.items() if j != i)
            if i not in names:
                want[r] = "NOT_FOUND"
            elif fields and names[i] != name and taken:
                want[r] = "DUPLICATE_NAME"
            else:
                want[r] = None if fields else "NO_FIELDS"
                if fields:
                    names[i] = name
        t = spark.createDataFrame(trips, "id long, destination_name string")
        q = spark.createDataFrame(patches, "request_id string, seq int, id long, set_fields array<string>, name string")
        new, out = CH.apply_patches(t, q, "trips")
        assert {r.request_id: r.error_code for r in out.collect()} == want
        assert {int(r.id): r.destination_name for r in new.collect()} == names
