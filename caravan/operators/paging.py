"""Listing and paging (O1-O3).

Fixed sort orders of the reference, with explicit null placement
(PostgreSQL sorts nulls last ascending and first descending) and ``id`` as the
last key so pages are stable on ties. A page is ``orderBy.offset.limit``:
Spark plans it as a top-k (``TakeOrderedAndProject``: each task keeps
offset+limit rows), never a full sort into one task. That grows with the offset,
so a page far down the list (``deep_page``) is found by order statistics: rows
are dealt into ranges of the order, a range's count gives the place of its first
row, and only the ranges that hold the page are sorted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravan.session import cut_lineage

# Fixed values from the reference: default page / page size of the admin
# lists, the sort order of each listing, and the listed columns.
DEFAULT_PAGE, DEFAULT_LIMIT = 1, 20
ORDERS = {
    "trips": [("destination_name", "asc")],
    "batches": [("from_date", "desc"), ("destination_name", "asc")],
    "users": [("created_at", "desc")],
    "coupons": [("start_date", "desc")],
    "bookings": [("id", "desc")],
    "banners": [("created_at", "desc")],
    "leads": [("created_at", "desc")],
}
COUPON_COLUMNS = ["id", "code", "deduction", "start_date", "end_date", "status"]
BANNER_COLUMNS = ["id", "banner_name", "description", "status", "created_at"]
LEAD_COLUMNS = ["id", "type", "name", "location", "travellers", "days", "email", "phone", "message",
                "budget", "date", "created_at"]


def js_int_or(value, default: int) -> int:
    """``parseInt(value) || default`` of the request parameters."""
    m = re.match(r"^\s*([+-]?\d+)", str(value)) if value is not None else None
    n = int(m.group(1)) if m else 0
    return n or default


def sort_keys(name: str) -> list[Column]:
    keys = []
    for col, how in ORDERS[name]:
        keys.append(F.col(col).asc_nulls_last() if how == "asc" else F.col(col).desc_nulls_first())
    if ORDERS[name][-1][0] != "id":
        keys.append(F.col("id").asc_nulls_last())
    return keys


def ordered(df: DataFrame, name: str) -> DataFrame:
    """O2: the fixed order of a listing."""
    return df.orderBy(*sort_keys(name))


def page(df: DataFrame, order: list[Column], page=None, limit=None) -> tuple[DataFrame, DataFrame]:
    """O1: one page of ``df`` in ``order`` and its metadata (count, total,
    page, limit, totalPages). page / limit follow ``parseInt(x) || default``;
    a negative page raises (the database refuses a negative OFFSET)."""
    p, lim = js_int_or(page, DEFAULT_PAGE), js_int_or(limit, DEFAULT_LIMIT)
    off = (p - 1) * lim
    if off < 0 or lim < 0:
        raise ValueError(f"negative offset or limit: page={page!r} limit={limit!r}")
    rows = df.orderBy(*order).offset(off).limit(lim) if off else df.orderBy(*order).limit(lim)
    total = F.count(F.lit(1))
    meta = df.agg(total.alias("total")).select(
        F.greatest(F.lit(0), F.least(F.lit(lim), F.col("total") - F.lit(off))).alias("count"), "total",
        F.lit(p).alias("page"), F.lit(lim).alias("limit"),
        F.ceil(F.col("total") / F.lit(lim)).cast("bigint").alias("totalPages"))
    return rows, meta


def _ranges(df: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows dealt into ranges of the order (``_range``), and (_range, _first, _n):
    the place of each range's first row and its size, one row per range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    return dealt, counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")))


def deep_page(df: DataFrame, order: list[Column], page=None, limit=None) -> tuple[DataFrame, DataFrame]:
    """O1 for pages far down the list: the same rows and metadata as ``page``.
    Only the ranges that hold the page are sorted (each by itself)."""
    p, lim = js_int_or(page, DEFAULT_PAGE), js_int_or(limit, DEFAULT_LIMIT)
    off = (p - 1) * lim
    if off < 0 or lim < 0:
        raise ValueError(f"negative offset or limit: page={page!r} limit={limit!r}")
    dealt, first = _ranges(df, order)
    first = cut_lineage(first)
    held = first.where((F.col("_first") < off + lim) & (F.col("_first") + F.col("_n") > off))
    # the range holds the page's rows from off - _first on
    rows = dealt.join(F.broadcast(held), "_range")  # as many rows as ranges
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    rows = rows.withColumn("_place", place).where(F.col("_place").between(off, off + lim - 1)).orderBy("_place")
    meta = first.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total")).select(
        F.greatest(F.lit(0), F.least(F.lit(lim), F.col("total") - F.lit(off))).alias("count"), "total",
        F.lit(p).alias("page"), F.lit(lim).alias("limit"),
        F.ceil(F.col("total") / F.lit(lim)).cast("bigint").alias("totalPages"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns]), meta


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with the place (from 1) of each row in the order: a sort of every
    range by itself, never of all rows in one task."""
    dealt, first = _ranges(df, order)
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(first), "_range").withColumn("place", place).drop("_range", "_first", "_n")


def list_coupons(coupons: DataFrame, page_no=None, limit=None) -> tuple[DataFrame, DataFrame]:
    """O3: coupon listing, newest start first, paged."""
    return page(coupons.select(*COUPON_COLUMNS), sort_keys("coupons"), page_no, limit)


def list_banners(banners: DataFrame) -> DataFrame:
    """O3: banner listing, newest first, unpaged."""
    return banners.select(*BANNER_COLUMNS).orderBy(*sort_keys("banners"))


def list_leads(leads: DataFrame) -> DataFrame:
    """O3: lead listing, newest first (null created_at first), unpaged."""
    return leads.select(*LEAD_COLUMNS).orderBy(*sort_keys("leads"))
