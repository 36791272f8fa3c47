"""Media queries (J10, J11, W3, M14, M15). Oracles use the reference's own
prefix test (``starts_with(key, 'trips/' || slug || '_')``), a theta join,
against the library's equi-join on the slug."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravan.functions.columns import CATALOG_FALLBACK_IMAGE
from caravan.operators import media as M
from caravan.plans.registry import register
from caravan.testdata import Tables, duck_with

_SLUG = ("regexp_replace(regexp_replace(lower(trim(destination_name)), '[^a-z0-9]+', '-', 'g'), "
         "'^-+|-+$', '', 'g')")
_T = f", t AS (SELECT id AS trip_id, destination_name, status, {_SLUG} AS s FROM trips)\n"
_PREFIX = "starts_with(m.key, 'trips/' || t.s || '_')"
_IMG = "NOT contains(lower(m.key), 'itinerary')"


@register("trip_media", duck_with("trips", "media") + _T + f"""
SELECT t.trip_id, t.destination_name, m.key, string_split(m.key, '/')[-1] AS name, m.size, m.last_modified
FROM t LEFT JOIN media m ON {_PREFIX} AND {_IMG}""")
def q_trip_media(spark, d):
    t = Tables(spark, d)
    return M.trip_media(t.trips, t.media)


@register("trip_itinerary_file", duck_with("trips", "media") + _T + f"""
SELECT t.trip_id, t.destination_name, min(m.key) AS itinerary_key,
       string_split(min(m.key), '/')[-1] AS itinerary_name
FROM t LEFT JOIN media m ON {_PREFIX} AND NOT ({_IMG}) GROUP BY t.trip_id, t.destination_name""")
def q_itinerary_file(spark, d):
    t = Tables(spark, d)
    return M.trip_itinerary_file(t.trips, t.media)


@register("sample_trip_images_counts", duck_with("trips", "media") + _T + f"""
SELECT t.trip_id, least(count(*), 3) AS picked, least(count(*), 3) AS distinct_picked
FROM t JOIN media m ON {_PREFIX} AND {_IMG} GROUP BY t.trip_id""")
def q_sample_counts(spark, d):
    """W3 checked by its sizes: min(3, images of the trip) picks, no repeats."""
    t = Tables(spark, d)
    s = M.sample_trip_images(t.trips, t.media, 3, seed=7)
    return s.groupBy("trip_id").agg(F.count(F.lit(1)).alias("picked"),
                                    F.count_distinct("key").alias("distinct_picked"))


def _sampled(n: int, seed: int) -> str:
    return duck_with("trips", "media") + _T + f"""
, r AS (SELECT t.trip_id, m.key, row_number() OVER (PARTITION BY t.trip_id ORDER BY md5(m.key || '/{seed}'), m.key) AS pick
        FROM t JOIN media m ON {_PREFIX} AND {_IMG})
, s AS (SELECT * FROM r WHERE pick <= {n})
"""


@register("sample_trip_images", _sampled(3, 7) + "SELECT trip_id, key, pick FROM s")
def q_sample(spark, d):
    """Three seeded random images per trip."""
    t = Tables(spark, d)
    return M.sample_trip_images(t.trips, t.media, 3, seed=7)


@register("catalog_image", _sampled(1, 7) + f"""
SELECT t.trip_id, coalesce(s.key, '{CATALOG_FALLBACK_IMAGE}') AS image FROM t LEFT JOIN s ON s.trip_id = t.trip_id""")
def q_catalog_image(spark, d):
    """W3 catalogue form: one seeded random image per trip or the fallback image."""
    t = Tables(spark, d)
    return M.catalog_image(t.trips, t.media, seed=7)


def _changes_inputs(t):
    removed = (M.trip_media(t.trips.where(~F.col("status")), t.media)
               .where(F.col("key").isNotNull()).select("key"))
    added = (M.trip_media(t.trips.where(F.col("status")), t.media).where(F.col("key").isNull())
             .select("trip_id", "destination_name", F.lit("jpg").alias("ext"), F.lit(0).alias("size"),
                     F.col("trip_id").alias("upload_id")))
    return removed, added


_CHANGES = duck_with("trips", "media") + _T + f"""
, removed AS (SELECT m.key FROM t JOIN media m ON {_PREFIX} AND {_IMG} WHERE NOT t.status),
added AS (SELECT t.trip_id, t.destination_name, t.s FROM t WHERE t.status AND NOT EXISTS
          (SELECT 1 FROM media m WHERE {_PREFIX} AND {_IMG}))
"""


@register("media_changes_manifest", _CHANGES + """
SELECT key, size, last_modified FROM media WHERE key NOT IN (SELECT key FROM removed)
UNION ALL
SELECT 'trips/' || s || '_' || substr(sha256(concat_ws('/', trip_id, trip_id)), 1, 32)
       || '.jpg' AS key, 0 AS size, CAST(NULL AS TIMESTAMP) AS last_modified FROM added""")
def q_media_changes_manifest(spark, d):
    """Drop the images of inactive trips, add a first image to every
    active trip without one; the new manifest."""
    t = Tables(spark, d)
    removed, added = _changes_inputs(t)
    return M.media_changes(t.media, removed, added)[0]


@register("media_changes_counts", _CHANGES + "SELECT trip_id, CAST(1 AS INTEGER) AS images FROM added")
def q_media_changes_counts(spark, d):
    """Image count stored per changed trip."""
    t = Tables(spark, d)
    removed, added = _changes_inputs(t)
    return M.media_changes(t.media, removed, added)[1]


_OLD_FILE = "lower(m.key) LIKE '%itinerary%'"


@register("media_itineraries_replaced", duck_with("trips", "media") + _T + f"""
, old AS (SELECT t.trip_id, m.key FROM t JOIN media m ON {_PREFIX} AND {_OLD_FILE} WHERE t.status),
new AS (SELECT 'trips/' || s || '_itinerary.' || CASE WHEN trip_id % 2 = 0 THEN 'pdf' ELSE 'docx' END AS key,
               max(trip_id) AS size FROM t WHERE status GROUP BY ALL)
SELECT key, size, last_modified FROM media
WHERE key NOT IN (SELECT key FROM old) AND key NOT IN (SELECT key FROM new)
UNION ALL
SELECT key, size, CAST(NULL AS TIMESTAMP) FROM new""")
def q_itineraries_replaced(spark, d):
    """Every active trip gets a new itinerary file and its old ones go; a
    second change stores the files again, with another size, under the same keys."""
    t = Tables(spark, d)
    active = t.trips.where("status")
    old = M.trip_media(active, t.media, "itinerary").where(F.col("key").isNotNull()).select("key")
    files = active.select(F.col("id").alias("trip_id"), "destination_name",
                          F.when(F.col("id") % 2 == 0, "pdf").otherwise("docx").alias("ext"),
                          F.lit(0).alias("size"), F.col("id").alias("upload_id"))
    no_images = _changes_inputs(t)[1].limit(0)
    first = M.media_changes(t.media, old, no_images, itineraries=files)[0]
    again = files.withColumn("size", F.col("trip_id"))
    return M.media_changes(first, old.limit(0), no_images, itineraries=again)[0]


@register("orphan_media", duck_with("trips", "bookings", "media") + _T + """
SELECT m.key, m.size, m.last_modified, 'trip' AS owner_kind,
       split_part(substr(m.key, 7), '_', 1) AS owner_key
FROM media m WHERE NOT EXISTS (SELECT 1 FROM t WHERE starts_with(m.key, 'trips/' || t.s || '_'))""")
def q_orphans(spark, d):
    """M15 over the trip media and all bookings."""
    t = Tables(spark, d)
    return M.orphan_media(t.trips, t.bookings, t.media)
