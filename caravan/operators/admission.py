"""M6: capacity-aware booking admission.

Rule (reference): a request for ``n`` travellers is accepted iff
``seats_used + n <= max_adventurers``. Requests of a batch are decided in
arrival order (``seq``); a rejected request uses no seats, so a later, smaller
one may still fit. This is a greedy fold, not a running sum.

Scale: the fold is sequential per batch, but no batch has to sit in one task. In
terms of the free seats ``r`` a request is the function
``f(r) = r - n if n <= r else r``, and

1. requests (with cap and seats already booked) are range-partitioned on
   (batch_id, seq) and sorted; a hot batch spans many partitions. The result
   is checkpointed so every pass below sees the same partitions;
2. a batch can only span partitions across a partition boundary, so at most
   P - 1 batches are split (P = number of range partitions). For their (batch,
   partition) segments the sums of travellers are added up: all requests are
   accepted up to the segment in which the sum first exceeds the free seats,
   so every start state up to that segment (the turning one) is known, and it
   is folded as it is;
3. after the turning segment fewer seats are free than the largest request in it
   asks for. Each later segment is the composition of its requests as a step
   function on that many free seats: sorted breakpoints, between which the same
   requests are accepted. A request adds a breakpoint where it splits a piece;
   requests larger than any piece's free seats add none. Neither
   ``max_adventurers`` nor the booked sums have an influence on its size. Requests
   of very different sizes can double the pieces again and again: a segment that
   comes to more than ``PIECES`` has no step function;
4. the step functions of a split batch are composed in partition order, JVM-side
   (``aggregate`` over at most P entries), giving each segment's start state. Up
   to the first segment without a step function the starts are known; such
   segments (one a batch at a time) are then folded as they are, and the
   composition goes on. This table has O(P) rows, a proven bound, so it is broadcast;
5. one ordered ``mapInPandas`` pass over the partitions folds every batch from
   its start state (the free seats, or the composed state for a segment of a
   split batch).

Every step is exact, for any capacity and also for booked sums below zero.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caravan.session import cut_lineage

# The Python functions below run in executor workers; shipping this module by
# value means workers do not need the package installed (no --py-files).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STEPS_SCHEMA = "_b string, _seg int, steps array<struct<lo: bigint, taken: bigint>>"
_DECISION_SCHEMA = ("request_id string, _b string, seq {seq}, travellers int, "
                    "accepted boolean, seats_after long")
PIECES = 1024  # breakpoints of a segment's step function at most
_NEVER = np.iinfo(np.int64).min  # below any number of free seats


def accepted(ns: np.ndarray, free: int) -> np.ndarray:
    """Which of the requests, in order, fit into ``free`` seats. Each pass takes
    all up to the first that does not fit and drops those too large since."""
    out = np.zeros(len(ns), bool)
    left = np.flatnonzero(ns <= free)
    while len(left):
        total = np.cumsum(ns[left])
        k = int(np.searchsorted(total, free, "right"))  # sums rise: the first k fit
        out[left[:k]] = True
        if k:
            free -= int(total[k - 1])
        left = left[k + 1:]
        left = left[ns[left] <= free]
    return out


def steps(ns: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The composition of requests on 0 .. top - 1 free seats (and any number
    below): of ``lo[i]`` to ``lo[i + 1] - 1`` seats, ``taken[i]`` are taken. None if
    that takes more than ``PIECES`` pieces."""
    lo, taken = np.array([_NEVER], np.int64), np.zeros(1, np.int64)
    most = top - 1  # most free seats any piece has now
    for n in ns.tolist():
        if n > most:
            continue
        ends = np.append(lo[1:], top)
        at = taken + n  # a piece's starts from here on accept
        split = (lo < at) & (at < ends)
        both = np.concatenate([lo, at[split]])
        took = np.concatenate([np.where(lo >= at, at, taken), at[split]])
        order = np.argsort(both, kind="stable")
        lo, taken = both[order], took[order]
        same = np.concatenate([[True], taken[1:] != taken[:-1]])
        lo, taken = lo[same], taken[same]
        if len(lo) > PIECES:
            return None
        most = int((np.append(lo[1:], top) - 1 - taken).max())
    return lo, taken


def _segment_steps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step function of one segment: of its known start, or else of all starts
    it can have (null if there are too many pieces)."""
    pdf = pdf.sort_values(["seq", "request_id"], kind="stable")
    ns, start = pdf["n"].to_numpy(dtype=np.int64), pdf["known"].iloc[0]
    if start is not None and start == start:
        pieces = [_NEVER], [int(ns[accepted(ns, int(start))].sum())]
    else:
        pieces = steps(ns, int(pdf["top"].iloc[0]))
    told = pieces and [{"lo": int(a), "taken": int(t)} for a, t in zip(*pieces, strict=True)]
    return pd.DataFrame({"_b": [pdf["_b"].iloc[0]], "_seg": [int(pdf["_seg"].iloc[0])], "steps": [told]})


def _fold_partitions(batches):
    """Ordered fold over one partition (rows sorted by batch, seq); the state
    carries across Arrow batches of the partition."""
    cur, free = None, 0
    for pdf in batches:
        b, ns, caps = (pdf[c].to_numpy() for c in ("_b", "n", "cap"))
        ns, caps, starts = ns.astype(np.int64), caps.astype(np.int64), pdf["start"].to_numpy(dtype=np.int64)
        acc, after = np.zeros(len(ns), bool), np.zeros(len(ns), np.int64)
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
        for i, j in zip(first, [*first[1:], len(b)], strict=True):
            if b[i] != cur:
                cur, free = b[i], int(starts[i])
            got = accepted(ns[i:j], free)
            acc[i:j] = got
            after[i:j] = caps[i] - free + np.cumsum(np.where(got, ns[i:j], 0))
            free -= int(ns[i:j][got].sum())
        yield pd.DataFrame({"request_id": pdf["request_id"], "_b": pdf["_b"], "seq": pdf["seq"],
                            "travellers": pdf["n"].astype("int32"), "accepted": acc, "seats_after": after})


def _starts(seg: DataFrame, split: DataFrame) -> DataFrame:
    """(_b, _seg, start): the free seats with which each segment of a split
    batch begins. O(P) rows."""
    hot = seg.join(F.broadcast(split), "_b", "left_semi")
    sums = hot.groupBy("_b", "_seg").agg(F.sum("n").alias("total"), F.max("n").alias("largest"),
                                         F.first("free").alias("free"))
    w = Window.partitionBy("_b").orderBy("_seg")
    before = F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    known = sums.withColumn("known", F.col("free") - before)
    # rows of a split batch: at most P, so these windows are bounded
    turning = F.min(F.when(F.col("total") > F.col("known"), F.col("_seg"))).over(Window.partitionBy("_b"))
    known = known.withColumn("turning", turning)
    # fewer than this many seats are free after the turning segment
    top = F.max(F.when(F.col("_seg") == F.col("turning"), F.col("largest"))).over(Window.partitionBy("_b"))
    known = known.withColumn("top", top).select(
        "_b", "_seg", "turning", "top", F.when(F.col("turning").isNull() | (F.col("_seg") <= F.col("turning")),
                                               F.col("known")).alias("known"))
    known = cut_lineage(known)
    early = known.where("turning is null or _seg < turning").select("_b", "_seg", F.col("known").alias("start"))
    late = known.where("_seg >= turning").select("_b", "_seg", "known", "top")
    first = known.where("_seg = turning").select("_b", F.col("known").alias("s0"))

    def stepped(of: DataFrame) -> DataFrame:
        return (hot.join(F.broadcast(of), ["_b", "_seg"])
                .select("_b", "_seg", "seq", "request_id", "n", "known", "top")
                .groupBy("_b", "_seg").applyInPandas(_segment_steps, _STEPS_SCHEMA))

    parts = cut_lineage(stepped(late))
    while True:
        starts = cut_lineage(_composed(parts, first))
        # known starts of segments without a step function
        stuck = starts.where("start is not null").join(parts.where("steps is null"), ["_b", "_seg"]).select(
            "_b", "_seg", F.col("start").alias("known"), F.lit(None).cast("bigint").alias("top"))
        if stuck.isEmpty():
            return early.unionByName(starts)
        parts = cut_lineage(parts.join(stuck, ["_b", "_seg"], "left_anti").unionByName(stepped(stuck)))


def _composed(parts: DataFrame, first: DataFrame) -> DataFrame:
    """(_b, _seg, start) from the segments' step functions in order; start is
    null after the first segment without one."""
    comp = parts.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_seg", "steps"))).alias("ts")).join(first, "_b")

    def after(s, t):
        return s - F.element_at(F.filter(t["steps"], lambda p: p["lo"] <= s), -1)["taken"]
    states = F.aggregate("ts", F.array(F.col("s0")), lambda acc, t: F.concat(
        acc, F.array(F.when(t["steps"].isNotNull() & F.element_at(acc, -1).isNotNull(), after(F.element_at(acc, -1), t)))))
    return (comp.select("_b", F.posexplode("ts").alias("_i", "_t"), states.alias("_st"))
            .select("_b", F.col("_t._seg").alias("_seg"), F.element_at("_st", F.col("_i") + 1).alias("start")))


def admit_bookings(batches: DataFrame, bookings: DataFrame | None, requests: DataFrame,
                   segments: int | None = None) -> DataFrame:
    """M6: decide booking requests against batch capacity.

    batches: (id, max_adventurers); bookings: existing (batch_id, travellers)
    or None; requests: (request_id, seq, batch_id, travellers) with ``seq``
    the arrival order, in its own type's order (equal ones by request_id).
    Output per request: request_id, batch_id, seq,
    travellers, accepted, error_code (BATCH_NOT_FOUND, INVALID_TRAVELLERS,
    NO_CAPACITY or null), seats_after (seats used after the decision; null when
    not folded)."""
    spark = requests.sparkSession
    p = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = classified(batches, bookings, requests)
    # classified, range-partitioned (which samples it first), sorted, checkpointed
    order = ["_b", "seq", "request_id"]
    ck = cut_lineage(r.repartitionByRange(p, *order).sortWithinPartitions(*order)
                     .withColumn("_seg", F.spark_partition_id()))
    bad = ck.where(F.col("_err").isNotNull()).select(
        "request_id", F.col("_b").alias("batch_id"), "seq", F.col("n").alias("travellers"),
        F.lit(False).alias("accepted"), F.col("_err").alias("error_code"),
        F.lit(None).cast("bigint").alias("seats_after"))
    seg = ck.where(F.col("_err").isNull()).drop("_err").withColumn("free", F.col("cap") - F.col("used0"))
    # batches present in more than one partition (at most P - 1 of them)
    edges = seg.groupBy("_seg").agg(F.min("_b").alias("lo"), F.max("_b").alias("hi"))
    split = (edges.select(F.explode(F.array("lo", "hi")).alias("_b"), "_seg").distinct()
             .groupBy("_b").agg(F.count(F.lit(1)).alias("_parts")).where(F.col("_parts") > 1)
             .select("_b"))
    # O(P) rows by construction, so broadcast; the join keeps the sorted order
    # of the streamed side
    folded = (seg.join(F.broadcast(_starts(seg, split)), ["_b", "_seg"], "left")
              .select("request_id", "seq", "_b", "n", "cap", F.coalesce("start", "free").alias("start"))
              .mapInPandas(_fold_partitions, _DECISION_SCHEMA.format(seq=dict(r.dtypes)["seq"])))
    good = folded.select("request_id", F.col("_b").alias("batch_id"), "seq", "travellers", "accepted",
                         F.when(~F.col("accepted"), F.lit("NO_CAPACITY")).alias("error_code"),
                         "seats_after")
    return good.unionByName(bad)


def classified(batches: DataFrame, bookings: DataFrame | None, requests: DataFrame) -> DataFrame:
    """Requests (request_id, seq, _b, n) with their batch's ``cap``, the seats
    booked (``used0``) and the code of what needs no fold (``_err``)."""
    caps = batches.select(F.col("id").cast("string").alias("_cb"),
                          F.col("max_adventurers").cast("bigint").alias("cap"))
    r = requests.select(F.col("request_id").cast("string").alias("request_id"),
                        "seq",  # compared in the type given: 2 comes before 10
                        F.col("batch_id").cast("string").alias("_b"),
                        F.col("travellers").try_cast("int").alias("n"))
    r = r.join(caps, r["_b"] == caps["_cb"], "left").drop("_cb")
    used0 = F.lit(0).cast("bigint")
    if bookings is not None:
        used = (bookings.groupBy(F.col("batch_id").cast("string").alias("_ub"))
                .agg(F.sum("travellers").cast("bigint").alias("used0")))
        r = r.join(used, r["_b"] == used["_ub"], "left").drop("_ub")
        used0 = F.coalesce("used0", used0)
    return r.withColumn("used0", used0).withColumn("_err", F.when(F.col("cap").isNull(), "BATCH_NOT_FOUND").when(
        F.col("n").isNull() | (F.col("n") <= 0), "INVALID_TRAVELLERS"))
