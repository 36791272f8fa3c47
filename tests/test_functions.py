"""Column functions, itinerary table and SQL functions."""
from caravan.functions import columns as FN
from caravan.functions.itinerary import itinerary_table
from caravan.functions.sql import register_functions


def _one(spark, col, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(col("v")).collect()]


def test_parse_numbers(spark):
    assert _one(spark, FN.js_parse_int, ["12ab", "  -3x", "", "abc", "0", "1e3", None]) == [12, -3, None, None, 0, 1,
                                                                                          None]
    assert _one(spark, FN.js_parse_float, ["12.5ab", ".5", "-1e2x", "x"]) == [12.5, 0.5, -100.0, None]


def test_regex_end_anchor(spark):
    assert _one(spark, FN.is_phone10, ["9876543210", "9876543210\n", "987654321", None]) == [True, False, False,
                                                                                            False]
    assert _one(spark, FN.is_email, ["a@b.co", "a@b.co\n", "a b@c.d", "a@b"]) == [True, False, False, False]


def test_codes_roles_refs(spark):
    assert _one(spark, FN.norm_code, [" save\t", "  ", None]) == ["SAVE", None, None]
    assert _one(spark, FN.is_role, [" Admin ", "guest", "SUPERADMIN"]) == [True, False, True]
    assert _one(spark, FN.ref_id, ['{"id": "u1"}', "u2", '["x"]', ' {"id": 7}']) == ["u1", "u2", None, "7"]
    assert _one(spark, FN.ref_malformed, ['{"id": ', "plain", '{"id": 1}']) == [True, False, False]


def test_keys(spark):
    assert _one(spark, FN.file_name, ["trips/a_b.jpg", "x"]) == ["a_b.jpg", "x"]
    assert _one(spark, FN.file_ext, ["a.tar.gz", "noext"]) == ["gz", "noext"]
    assert _one(spark, FN.media_kind, ["trips/a_ITINERARY.pdf", "trips/a_1.jpg"]) == ["itinerary", "image"]
    assert _one(spark, FN.banner_key, [" Summer Sale ", "banners/x"]) == ["banners/summer sale", "banners/x"]
    assert _one(spark, lambda c: FN.media_key("banner", c), ["Summer Sale"]) == ["banners/summer-sale"]


def test_epoch(spark):
    assert _one(spark, FN.epoch_iso, [0, 1704067199], "long") == ["1970-01-01T00:00:00.000Z",
                                                                  "2023-12-31T23:59:59.000Z"]


def test_itinerary_strict_and_lenient(spark):
    good = '{"1":{"title":"Arrive","content":"x"},"2":{"title":"Trek","content":"y"}}'
    seed = '{1:{"title":"a","content":"b"},3:{"title":"old","content":"c"},3:{"title":"new","content":"d"}}'
    trips = spark.createDataFrame([("t1", good), ("t2", seed), ("t3", '{"1":{"title":"x"'), ("t4", good + " x")],
                                  "id string, itinerary string")
    days, rej = itinerary_table(trips)
    assert sorted(r["trip_id"] for r in rej.collect()) == ["t2", "t3", "t4"]
    assert sorted((r["trip_id"], r["day_no"], r["title"]) for r in days.collect()) == [("t1", 1, "Arrive"),
                                                                                       ("t1", 2, "Trek")]
    days, rej = itinerary_table(trips, lenient=True)
    got = sorted((r["trip_id"], r["day_no"], r["title"]) for r in days.collect() if r["trip_id"] == "t2")
    assert got == [("t2", 1, "a"), ("t2", 3, "new")]  # duplicate day: last wins


def test_sql_functions(spark):
    names = register_functions(spark)
    assert "slug" in names
    r = spark.sql("SELECT slug('  Spiti Valley!! ') AS s, is_phone10('9876543210') AS p, "
                  "norm_code(' k1 ') AS c, js_parse_int('12ab') AS i, media_kind('x_Itinerary.pdf') AS k").collect()[0]
    assert (r["s"], r["p"], r["c"], r["i"], r["k"]) == ("spiti-valley", True, "K1", 12, "itinerary")
