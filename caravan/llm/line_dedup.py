"""Operator 1, line dedup: drop the lines that much of a site repeats.

Documents are grouped by host. For each host and line the number of pages that
contain the line is divided by the host's number of pages; a line above
``max_ratio`` is boilerplate of that host and is cut from all its documents. Lines
are compared without white space at their ends; blank lines are never
boilerplate; the other lines stay as they are, in order.

A page is a distinct text: copies of a document are one, so they make none of its
lines boilerplate. The share must exceed the ratio beyond what chance explains
(``exceeds``: a score test with ``Z`` standard deviations, and two pages at least), at
every size of a host: with 5 % it takes 2 of 2 to 11 pages, 10 of 100, 64 of 1000.

Near copies are not one text, so pages vote a second time: a page of which the lines
found so far are more than half (in characters) is taken for a copy, and not for
a page that holds them beside other text. What still exceeds the ratio is cut, and what only
such pages hold stays.

Defined results: a null text stays null and has no lines; an empty text stays
empty; null hosts form one host; a line repeated inside a document counts once;
two pages that hold little but a line keep it; an empty table gives no rows; a
column named n_lines or n_dropped (in any case) gives way to the counts.

Scale: the line counts are partial sums keyed by host and 128-bit digests of line
and text, so a hot host or line shrinks before the shuffle. What comes back is
one row per host with its boilerplate digests: a host with L distinct lines per
page has fewer than L / max_ratio of them, and no text is shuffled unless that table is
too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravan.llm.common import scratch_table

MAX_RATIO = 0.05
Z = 2.0  # standard deviations by which a line's share must exceed the ratio
_EDGE = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.trim(line, F.lit(_EDGE))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(_key(line)))


def exceeds(n: Column, total: Column, ratio: float) -> Column:
    """Whether n of total, 2 at least, is more than ``ratio`` beyond chance."""
    over = n - total * F.lit(ratio)
    return (n >= 2) & (over > 0) & (over * over > total * F.lit(Z * Z * ratio * (1 - ratio)))


def _digests(lines: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(lines, lambda x: _key(x) != ""), _digest))


def _above(votes: DataFrame, totals: DataFrame, ratio: float) -> DataFrame:
    """(host, digests) of the lines that enough pages hold; votes: (host,
    text_digest, digest), repeats allowed."""
    n = votes.groupBy("host", "digest").agg(F.countDistinct("text_digest").alias("n")).where("n >= 2")
    v, t = n.alias("v"), totals.alias("t")
    return (v.join(t, F.expr("v.host <=> t.host")).where(exceeds(F.col("n"), F.col("total"), ratio))
            .groupBy("v.host").agg(F.collect_list("digest").alias("digests")))


def boilerplate(rows: DataFrame, max_ratio: float) -> DataFrame:
    """(host, digests) of the lines to drop, from rows (host, text)."""
    rows = rows.where("text is not null").withColumn("text_digest", F.unhex(F.md5("text")))
    totals = scratch_table(rows.groupBy("host").agg(F.countDistinct("text_digest").alias("total")), "boilerplate-pages")
    every = rows.select("host", "text_digest", F.explode(_digests(_lines(F.col("text")))).alias("digest"))
    found = scratch_table(_above(every, totals, max_ratio), "boilerplate-lines")
    # the second vote: only rows that hold a found line are exploded, to those lines
    r, b = rows.alias("r"), found.alias("b")

    def chars(lines: Column) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.char_length(_key(x)))

    held = r.join(b, F.expr("r.host <=> b.host")).select("r.host", "text_digest", "digests", _lines(F.col("text")).alias("lines"))
    held = held.withColumn("hits", F.array_intersect(F.transform("lines", _digest), F.col("digests"))).where(F.size("hits") > 0)
    cut = F.filter("lines", lambda x: (_key(x) != "") & F.array_contains(F.col("hits"), _digest(x)))
    held = held.where(2 * chars(cut) <= chars(F.col("lines")))
    return _above(held.select("host", "text_digest", F.explode("hits").alias("digest")), totals, max_ratio)


def drop_boilerplate_lines(docs: DataFrame, host: Column, text_col: str = "text", max_ratio: float = MAX_RATIO,
                           counts: bool = True) -> DataFrame:
    """``docs`` with the cleaned text in ``text_col``, plus (with ``counts``)
    n_lines and n_dropped."""
    d = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"),
                    host.alias("host"), F.col(text_col).alias("text"))
    found = scratch_table(boilerplate(d.select("host", "text"), max_ratio), "boilerplate")
    d, b = d.alias("d"), found.alias("b")
    lines = _lines(F.col("d.text"))
    joined = d.join(b, F.expr("d.host <=> b.host"), "left").select(
        "d.row", "d.text", "b.digests", lines.alias("lines"))
    hits = F.array_intersect(F.transform("lines", _digest), F.col("digests"))
    joined = joined.withColumn("hits", hits)
    kept = F.when(F.size("hits") > 0,
                  F.filter("lines", lambda x: (_key(x) == "") | ~F.array_contains(F.col("hits"), _digest(x)))
                  ).otherwise(F.col("lines"))
    joined = joined.withColumn("kept", kept)
    cleaned = F.when(F.col("text").isNotNull(), F.array_join("kept", "\n"))
    fields = [(cleaned if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)
              if not counts or c.lower() not in ("n_lines", "n_dropped") or c == text_col]
    if counts:
        n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
        n_kept = F.when(F.col("text").isNull(), 0).otherwise(F.size("kept")).cast("long")
        fields += [n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped")]
    return joined.select(*fields)
