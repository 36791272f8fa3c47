"""Media objects of trips and bookings.

The reference lists objects per trip by the prefix ``trips/{slug}_`` (one list
call per trip). Slugs never contain ``_``, so "key starts with the prefix" is
"text between ``trips/`` and the first ``_`` equals the slug": an equi-join
of the whole manifest with all trips in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravan.functions.columns import (CATALOG_FALLBACK_IMAGE, ITINERARIES_PREFIX, ITINERARY_MARK,
                                       file_name, media_key, slug)


def _prefix_slug(key: Column, prefix: str) -> Column:
    """Text between ``prefix`` and the first ``_`` of keys under ``prefix``
    that hold a ``_``; null otherwise."""
    rest = key.substr(len(prefix) + 1, 1 << 30)
    return F.when(key.startswith(prefix) & rest.contains("_"), F.split_part(rest, F.lit("_"), F.lit(1)))


def _is_itinerary(key: Column) -> Column:
    return F.lower(key).contains(ITINERARY_MARK)


def keyed_manifest(manifest: DataFrame) -> DataFrame:
    """Manifest with ``_slug`` (trip owner part of ``trips/`` keys) and ``kind``."""
    k = F.col("key")
    return manifest.select("*", _prefix_slug(k, "trips/").alias("_slug"),
                           F.when(_is_itinerary(k), "itinerary").otherwise("image").alias("kind"))


def trip_media(trips: DataFrame, manifest: DataFrame, kind: str = "image") -> DataFrame:
    """Files of every trip (long form: trip_id, destination_name, key,
    name, size, last_modified); images exclude keys containing "itinerary" in
    any case. Inactive trips have media too; a trip without files is kept with
    null file columns.

    Plan: the matched part is an inner equi-join on the slug (AQE broadcasts
    the trip side when small, else splits a hot slug with its skew join); the
    trips without files come from an anti join against the distinct slugs."""
    t = trips.select(F.col("id").alias("trip_id"), "destination_name",
                     slug("destination_name").alias("_tslug"))
    m = keyed_manifest(manifest).where(F.col("_slug").isNotNull() & (F.col("kind") == kind))
    files = m.select("_slug", "key", file_name("key").alias("name"), "size", "last_modified")
    matched = t.join(files, t["_tslug"] == files["_slug"], "inner").select(
        "trip_id", "destination_name", "key", "name", "size", "last_modified")
    slugs = files.select(F.col("_slug").alias("_s")).distinct()
    empty = t.join(slugs, t["_tslug"] == slugs["_s"], "left_anti").select(
        "trip_id", "destination_name", F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast(manifest.schema["size"].dataType).alias("size"),
        F.lit(None).cast(manifest.schema["last_modified"].dataType).alias("last_modified"))
    return matched.unionByName(empty)


def trip_itinerary_file(trips: DataFrame, manifest: DataFrame,
                        include_itineraries_dir: bool = False) -> DataFrame:
    """Per trip the first (lowest key, the listing order) object under
    ``trips/{slug}_`` whose key contains "itinerary"; null when none. The
    create path writes itineraries under ``itineraries/``, which the reader
    never lists; ``include_itineraries_dir=True`` looks there as well."""
    k = F.col("key")
    owner = _prefix_slug(k, "trips/")
    if include_itineraries_dir:
        owner = F.coalesce(owner, _prefix_slug(k, ITINERARIES_PREFIX))
    it = (manifest.where(_is_itinerary(k)).select(owner.alias("_slug"), "key")
          .where(F.col("_slug").isNotNull())
          .groupBy("_slug").agg(F.min("key").alias("itinerary_key")))
    t = trips.select(F.col("id").alias("trip_id"), "destination_name",
                     slug("destination_name").alias("_tslug"))
    j = t.join(it, t["_tslug"] == it["_slug"], "left")
    return j.select("trip_id", "destination_name", "itinerary_key",
                    file_name("itinerary_key").alias("itinerary_name"))


def sample_trip_images(trips: DataFrame, manifest: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Up to ``n`` distinct images per trip, chosen uniformly at random but
    repeatable by ``seed`` (rank by a seeded hash of the key). Long form
    (trip_id, pick, key); trips without images have no rows. The row number is
    bounded by ``n``, so the limit is applied per map task before the shuffle."""
    files = trip_media(trips, manifest, "image").where(F.col("key").isNotNull())
    w = Window.partitionBy("trip_id").orderBy(F.md5(F.concat("key", F.lit(f"/{seed}"))), F.col("key"))
    return (files.select("trip_id", "key", F.row_number().over(w).alias("pick"))
            .where(F.col("pick") <= n))


def catalog_image(trips: DataFrame, manifest: DataFrame, seed: int = 0,
                  fallback: str = CATALOG_FALLBACK_IMAGE) -> DataFrame:
    """W3, catalogue form: one random image key per trip, the fixed fallback
    image when the trip has none."""
    pick = sample_trip_images(trips, manifest, 1, seed).select(F.col("trip_id").alias("_t"), "key")
    t = trips.select(F.col("id").alias("trip_id"))
    j = t.join(pick, t["trip_id"] == pick["_t"], "left")
    return j.select("trip_id", F.coalesce(F.col("key"), F.lit(fallback)).alias("image"))


def media_changes(manifest: DataFrame, removed: DataFrame, added: DataFrame, totals: DataFrame | None = None,
                  itineraries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifest after removals and uploads, and the image count stored on
    each changed trip.

    removed: (key); added: (trip_id, destination_name, ext, size, upload_id[,
    token]) new image uploads, keyed ``trips/{slug}_{token}.{ext}`` (token: a hash
    of the upload id when not given, so no two uploads share a key); totals: optional (trip_id, total_image_count) as
    supplied by the client. Existing keys keep their names. The stored count is
    the supplied total, else the number of images added; trips with neither
    are not changed.

    itineraries: optional (trip_id, destination_name, ext, size, upload_id[,
    removed_key]) new itinerary files, keyed ``trips/{slug}_itinerary.{ext}``. The
    trip's old file ``removed_key`` (if given) goes first; a file stored under the same
    key is replaced; of several uploads under one key the last (greatest
    ``upload_id``) stays."""
    gone = removed.select("key")
    if itineraries is not None:
        if "removed_key" in itineraries.columns:
            gone = gone.unionByName(itineraries.select(F.col("removed_key").alias("key")))
        files = (itineraries.select(media_key("trip_itinerary", F.col("destination_name"), ext=F.col("ext")).alias("key"),
                                    F.col("size").cast(manifest.schema["size"].dataType).alias("size"), "upload_id")
                 .groupBy("key").agg(F.max_by("size", "upload_id").alias("size"))
                 .withColumn("last_modified", F.lit(None).cast(manifest.schema["last_modified"].dataType)))
        gone = gone.unionByName(files.select("key"))
    kept = manifest.join(gone.where("key is not null").distinct(), "key", "left_anti")
    tok = (F.col("token") if "token" in added.columns else
           F.substring(F.sha2(F.concat_ws("/", F.col("trip_id").cast("string"),
                                          F.col("upload_id").cast("string")), 256), 1, 32))
    new = added.select(media_key("trip_image", F.col("destination_name"), tok, F.col("ext")).alias("key"),
                       F.col("size").cast(manifest.schema["size"].dataType).alias("size"),
                       F.lit(None).cast(manifest.schema["last_modified"].dataType).alias("last_modified"))
    out = kept.select("key", "size", "last_modified").unionByName(new)
    if itineraries is not None:
        out = out.unionByName(files.select("key", "size", "last_modified"))
    counts = added.groupBy(F.col("trip_id").alias("_t")).agg(F.count(F.lit(1)).alias("_added"))
    if totals is not None:
        tt = totals.select(F.col("trip_id").alias("_tt"), "total_image_count")
        c = counts.join(tt, counts["_t"] == tt["_tt"], "full")
        images = c.select(F.coalesce("_tt", "_t").alias("trip_id"),
                          F.coalesce(F.col("total_image_count"), F.col("_added")).cast("int").alias("images"))
    else:
        images = counts.select(F.col("_t").alias("trip_id"), F.col("_added").cast("int").alias("images"))
    return out, images


def media_owner(key: Column) -> tuple[Column, Column]:
    """(owner kind, owner key) of an object key: trip images and itineraries
    belong to the trip slug, ``{bookingId}.{ext}`` at the root to a booking,
    ``banners/{slug}`` to a banner."""
    trip = F.coalesce(_prefix_slug(key, "trips/"), _prefix_slug(key, ITINERARIES_PREFIX))
    # the booking delete removes the keys starting with "{id}." (ids hold no '.')
    booking = F.when(~key.contains("/") & key.contains("."), F.split_part(key, F.lit("."), F.lit(1)))
    banner = F.when(key.startswith("banners/"), F.substring(key, len("banners/") + 1, F.length(key)))
    kind = (F.when(trip.isNotNull(), "trip").when(booking.isNotNull(), "booking")
            .when(banner.isNotNull(), "banner").otherwise("unknown"))
    return kind, F.coalesce(trip, booking, banner)


def orphan_media(trips: DataFrame, bookings: DataFrame, manifest: DataFrame,
                 banners: DataFrame | None = None) -> DataFrame:
    """Objects that no live trip, booking or banner owns. Without ``banners``
    nothing is known about banner files, so none is reported.
    Deleting a trip leaves its files in place in the reference; deleting a
    booking removes ``{id}.*``.

    Each kind of object has an anti join of its own against its owners' keys: trips
    and banners are small (broadcast by measured size), and the bookings are met by the
    objects named after a booking alone."""
    kind, owner = media_owner(F.col("key"))
    m = manifest.select("*", kind.alias("owner_kind"), owner.alias("owner_key"))

    def without(which: str, owners: DataFrame) -> DataFrame:
        return m.where(F.col("owner_kind") == which).join(owners, F.col("owner_key") == F.col("_o"), "left_anti")
    out = m.where(F.col("owner_kind") == "unknown")
    out = out.unionByName(without("trip", trips.select(slug("destination_name").alias("_o"))))
    out = out.unionByName(without("booking", bookings.select(F.col("id").cast("string").alias("_o"))))
    if banners is not None:
        out = out.unionByName(without("banner", banners.select(slug("banner_name").alias("_o"))))
    return out
