"""Plan shapes shared by the operators.

* Group-wise work is written as aggregates (partial + final, so a hot key is
  reduced map-side before the shuffle) rather than windows over whole groups.
* Totals are joined back as aggregates or scalar subqueries, never as
  ``count() over ()`` (a window without keys runs in one task).
* Join sides are chosen by Catalyst / AQE from runtime sizes under
  ``spark.sql.adaptive.autoBroadcastJoinThreshold``. AQE knows a side's size only
  once the wide side beside it is shuffled, so where that shuffle is the cost
  ``small_side`` measures first; a side above the limit stays a shuffled join.
* Rows are looked up in a parent table by the few keys that are not exactly one
  row of it (``odd_references``), so that wide rows need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravan.session import cut_lineage

SMALL_BYTES = 64 << 20  # as autoBroadcastJoinThreshold in session.CLUSTER_CONF


def small_side(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """The side of a join, marked for broadcast if all its rows, measured, come to at
    most ``limit`` bytes (per column its text and 16 bytes); else as it is."""
    row = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(16 * len(df.columns)))
    size = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def odd_references(rows: DataFrame, key: str, ids: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """(_ref, _found): the keys asked for that are not exactly one row of ``ids`` (one
    column, of the key's type): those without a row once with false, those with several as often
    as they are there with true. A left join with it gives each row as often as a
    left join with ``ids`` would, and needs no shuffle of the rows if few keys are odd."""
    asked = rows.select(F.col(key).alias("_ref")).where(F.col("_ref").isNotNull()).distinct()
    there = ids.toDF("_id").groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    odd = asked.join(there, F.col("_ref") == F.col("_id"), "left").where(n != 1).select(
        "_ref", F.explode(F.array_repeat(n > 0, F.greatest(n, F.lit(1)).cast("int"))).alias("_found"))
    return small_side(cut_lineage(odd), limit)


def with_group_count(df: DataFrame, keys: Sequence[str], name: str = "total_count") -> DataFrame:
    """``COUNT(*) OVER (PARTITION BY keys)`` as a pre-aggregated count joined
    back on the keys; without keys, a scalar subquery."""
    if not keys:
        total = df.select(F.count(F.lit(1)).alias(name))
        return df.select("*", total.scalar().alias(name))
    counts = df.groupBy(*[F.col(k).alias(f"_w1_{k}") for k in keys]).agg(F.count(F.lit(1)).alias(name))
    same = [df[k].eqNullSafe(counts[f"_w1_{k}"]) for k in keys]  # nulls are one group, as in a window
    return df.join(counts, reduce(and_, same), "left").select(*[df[c] for c in df.columns], name)


def top1_struct(*cols: str | Column) -> Column:
    """Struct whose natural order is the sort order of the given columns; the
    ``min`` of it per group is the first row of the group."""
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])


def prefix_fields(s: str, fields: Sequence[str], prefix: str) -> list[Column]:
    """Struct fields of column ``s`` as flat, prefixed columns."""
    return [F.col(f"{s}.{f}").alias(f"{prefix}{f}") for f in fields]


def sum_by_key(df: DataFrame, key: str, value: str, out: str, as_key: str | None = None) -> DataFrame:
    """Pre-aggregated sum per key (partial aggregation before the shuffle)."""
    return df.groupBy(F.col(key).alias(as_key or key)).agg(F.sum(value).cast("bigint").alias(out))
