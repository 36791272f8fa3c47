"""Edge fixtures: slugs, manifest (trip without files, only itinerary,
more than 1,000 files, orphans, booking invoices)."""
import os

from pyspark.sql import functions as F

from caravan.functions.columns import slug
from caravan.operators import media as M
from caravan.sources.media import media_manifest
from helpers import rows


def test_slug_rules_and_idempotence(spark):
    df = spark.createDataFrame([("  Spiti Valley!! ",), ("!!!",), ("Café Goa",), ("a__b",)], "n string")
    out = [r[0] for r in df.select(slug("n")).collect()]
    assert out == ["spiti-valley", "", "caf-goa", "a-b"]
    twice = [r[0] for r in df.select(slug(slug("n"))).collect()]
    assert twice == out


def _manifest(spark, keys):
    return spark.createDataFrame([(k, 1, None) for k in keys], "key string, size long, last_modified timestamp")


def test_trip_media_and_itinerary(spark):
    trips = spark.createDataFrame([("t1", "Spiti Valley"), ("t2", "Goa"), ("t3", "Itinerary Trek"), ("t4", "Ooty")],
                                  "id string, destination_name string")
    keys = ([f"trips/spiti-valley_{i:05d}.jpg" for i in range(1200)] +
            ["trips/spiti-valley_itinerary.pdf", "trips/spiti-valley_ITINERARY-b.pdf",
             "trips/goa_itinerary.pdf", "itineraries/ooty_itinerary.pdf",
             "trips/itinerary-trek_a.jpg", "trips/spiti-valley-extra_1.jpg", "banners/x"])
    m = _manifest(spark, keys)
    media = M.trip_media(trips, m)
    counts = dict(rows(media.groupBy("trip_id").agg(F.count("key").alias("n")), "trip_id", "n"))
    # > 1,000 files all listed; a name containing "itinerary" makes its images itinerary files
    assert counts == {"t1": 1200, "t2": 0, "t3": 0, "t4": 0}
    it = dict(rows(M.trip_itinerary_file(trips, m), "trip_id", "itinerary_key"))
    assert it == {"t1": "trips/spiti-valley_ITINERARY-b.pdf", "t2": "trips/goa_itinerary.pdf",
                  "t3": "trips/itinerary-trek_a.jpg", "t4": None}
    it2 = dict(rows(M.trip_itinerary_file(trips, m, include_itineraries_dir=True), "trip_id", "itinerary_key"))
    assert it2["t4"] == "itineraries/ooty_itinerary.pdf"


def test_sampling_is_seeded_and_without_repeats(spark):
    trips = spark.createDataFrame([("t1", "Spiti"), ("t2", "Goa")], "id string, destination_name string")
    m = _manifest(spark, [f"trips/spiti_{i}.jpg" for i in range(10)] + ["trips/goa_1.jpg"])
    a = rows(M.sample_trip_images(trips, m, 3, seed=1), "trip_id", "key")
    b = rows(M.sample_trip_images(trips, m, 3, seed=1), "trip_id", "key")
    assert a == b and len(a) == 4 and len(set(a)) == 4
    cat = dict(rows(M.catalog_image(trips.union(spark.createDataFrame([("t3", "None")], trips.schema)), m),
                    "trip_id", "image"))
    assert cat["t3"] == "/kashmir_lightbox_4.jpg" and cat["t2"] == "trips/goa_1.jpg"


def test_orphans_and_changes(spark):
    trips = spark.createDataFrame([("t1", "Spiti")], "id string, destination_name string")
    bookings = spark.createDataFrame([("k1",)], "id string")
    m = _manifest(spark, ["trips/spiti_1.jpg", "trips/gone_1.jpg", "k1.pdf", "k2.pdf",
                          "itineraries/spiti_itinerary.pdf", "weird", "banners/sale"])
    orphans = rows(M.orphan_media(trips, bookings, m), "key")
    assert orphans == [("k2.pdf",), ("trips/gone_1.jpg",), ("weird",)]
    added = spark.createDataFrame([("t1", "Spiti", "jpg", 6, "u1"), ("t1", "Spiti", "jpg", 6, "u2")],
                                  "trip_id string, destination_name string, ext string, size long, upload_id string")
    removed = spark.createDataFrame([("trips/spiti_1.jpg",)], "key string")
    new, counts = M.media_changes(m, removed, added)
    keys = [r["key"] for r in new.collect()]
    assert len(set(keys)) == len(keys)  # two uploads alike in all but their id
    assert "trips/spiti_1.jpg" not in keys and sum(k.startswith("trips/spiti_") for k in keys) == 2
    assert rows(counts) == [("t1", 2)]
    totals = spark.createDataFrame([("t1", 9)], "trip_id string, total_image_count int")
    assert rows(M.media_changes(m, removed, added, totals)[1]) == [("t1", 9)]


def test_manifest_from_files(spark, scratch):
    for k in ["trips/spiti_a.jpg", "trips/spiti_itinerary.pdf", "k1.pdf"]:
        p = os.path.join(scratch, k)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(b"x" * 3)
    man = media_manifest(spark, scratch)
    assert rows(man, "key", "size") == [("k1.pdf", 3), ("trips/spiti_a.jpg", 3), ("trips/spiti_itinerary.pdf", 3)]
    assert all(r["last_modified"] is not None for r in man.collect())
    assert rows(media_manifest(spark, "file://" + scratch, "spiti_*.jpg"), "key") == [("trips/spiti_a.jpg",)]
    assert media_manifest(spark, os.path.join(scratch, "none")).collect() == []


def test_itineraries_are_replaced(spark):
    man = spark.createDataFrame([("trips/goa_itinerary.pdf", 1, None), ("trips/goa_old-itinerary.doc", 2, None), ("trips/goa_a.jpg", 3, None),
                                 ("trips/ooty_itinerary.pdf", 4, None)], "key string, size long, last_modified timestamp")
    none = spark.createDataFrame([], "key string")
    images = spark.createDataFrame([], "trip_id string, destination_name string, ext string, size long, upload_id string")
    files = spark.createDataFrame([("t1", "Goa", "pdf", 10, "u1", "trips/goa_old-itinerary.doc"), ("t1", "Goa", "pdf", 11, "u2", None),
                                   ("t2", "Leh!", "docx", 12, "u3", None)],
                                  "trip_id string, destination_name string, ext string, size long, upload_id string, removed_key string")
    out, counts = M.media_changes(man, none, images, itineraries=files)
    assert rows(out, "key", "size") == [("trips/goa_a.jpg", 3), ("trips/goa_itinerary.pdf", 11), ("trips/leh_itinerary.docx", 12),
                                        ("trips/ooty_itinerary.pdf", 4)]
    assert counts.collect() == []


def test_banner_objects_owned_by_banners(spark):
    trips = spark.createDataFrame([("t1", "Spiti")], "id string, destination_name string")
    bookings = spark.createDataFrame([("k1",)], "id string")
    banners = spark.createDataFrame([("b1", "Summer Sale!")], "id string, banner_name string")
    m = _manifest(spark, ["banners/summer-sale", "banners/old"])
    assert rows(M.orphan_media(trips, bookings, m, banners), "key") == [("banners/old",)]
