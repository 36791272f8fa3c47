"""Bulk coupon validation.

Each attempt (attempt_id, ts, code_raw) gets the outcome of the reference's
rules, first failing rule wins: REQUIRED (blank code), NOT_FOUND, DISABLED,
NOT_STARTED (ts < start), EXPIRED (ts > end), else VALID with the deduction.
The window is closed at both ends and compared in milliseconds.

Plan: coupons are reduced to one row per code (lowest id; a partial
aggregate), then an equi-join on the normalised code and a ``when`` chain. The
attempt side is never shuffled for the coupons when the code table is small
(AQE broadcasts it from its runtime size); when it is large, a hot code is
split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.functions.columns import norm_code

# Fixed values from the reference: outcome codes in rule order.
OUTCOMES = ["REQUIRED", "NOT_FOUND", "DISABLED", "NOT_STARTED", "EXPIRED", "VALID"]


def coupons_by_code(coupons: DataFrame, normalize: bool = False) -> DataFrame:
    """One coupon per code: the lowest id wins among duplicates (the reference
    takes an arbitrary first row). ``normalize=True`` also matches codes stored
    in lower case (the reference stores them as typed and so never finds them)."""
    code = norm_code("code") if normalize else F.col("code")
    first = F.min(F.struct("id", "deduction", "start_date", "end_date", "status"))
    return (coupons.groupBy(code.alias("_code")).agg(first.alias("_c"))
            .select("_code", F.col("_c.id").alias("coupon_id"), F.col("_c.deduction").alias("_deduction"),
                    F.col("_c.start_date").alias("_start"), F.col("_c.end_date").alias("_end"),
                    F.col("_c.status").alias("_status")))


def coupon_status(attempts: DataFrame, coupons: DataFrame, normalize: bool = False) -> DataFrame:
    """(attempt_id, code, status, coupon_id, deduction) for every attempt."""
    a = attempts.select("attempt_id", norm_code("code_raw").alias("code"),
                        F.unix_millis(F.col("ts").cast("timestamp")).alias("_ts_ms"))
    c = coupons_by_code(coupons, normalize)
    j = a.join(c, a["code"] == c["_code"], "left")
    status = (F.when(F.col("code").isNull(), "REQUIRED")
              .when(F.col("coupon_id").isNull(), "NOT_FOUND")
              .when(~F.col("_status"), "DISABLED")
              .when(F.col("_ts_ms") < F.col("_start") * 1000, "NOT_STARTED")
              .when(F.col("_ts_ms") > F.col("_end") * 1000, "EXPIRED")
              .otherwise("VALID"))
    return j.select("attempt_id", "code", status.alias("status"), "coupon_id",
                    F.when(status == "VALID", F.col("_deduction")).alias("deduction"))


def coupon_status_summary(status: DataFrame) -> DataFrame:
    """Attempts per outcome."""
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("attempts"))
