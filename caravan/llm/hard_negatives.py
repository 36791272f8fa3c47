"""Operator 11, hard-negative mining with LEMP-style coordinate pruning.

For an anchor its positives are the ``positives`` best rows of its label, and
for each of them the hard negatives are the first ``negatives`` rows of another
label whose score lies between ``low_percent`` of the positive's and the
positive's. Both are searches for large inner products:

1. Vectors are ordered by length and cut into buckets of ``BUCKET`` rows, so a
   bucket holds vectors of like length. Anchors are cut into blocks of ``ANCHORS``.
2. An anchor needs scores from some value on (``low``). It searches a bucket
   only if its length times the longest of the bucket reaches that value.
3. Inside a bucket the vectors are scaled to length 1 and each coordinate has a
   sorted list. ``low`` becomes a cosine the anchor must reach with the longest
   vector of the bucket; with it, each of the anchor's ``FOCUS`` largest
   coordinates has a range of feasible values, which is one stretch of its list.
   The stretches are intersected.
4. What is left is verified by the exact integer product.

The positives' search first takes the longest bucket alone; the worst score that
an anchor's best rows have there is its ``low`` for the other buckets. The
negatives' search has its ``low`` from the positives: ``low_percent`` of the
smallest that is not negative.

Scores are integer inner products of floor(scale * x): exact; beyond the range
of a long they take its nearest end.

Defined results: a row whose label, id, vector or any component is null or not
finite, or whose vector is empty, takes no part; rows that repeat an id are rows
of their own, each a candidate for the others and (if its id is an anchor's) an
anchor of its own; equal scores go to the smaller id, then to the longer vector,
the smaller label and vector hash; shorter vectors are padded with zeros; an anchor alone with its label
has no positives, a positive without a row in its range no row in the result; an
empty table gives no rows; other columns are not read.

Scale: a task holds one block of anchors and one bucket, whatever the label or
however common a vector (ties in length are cut between buckets like all else).
Of A anchors and N rows, each row is sent A / ``ANCHORS`` times and each anchor
N / ``BUCKET`` times at most, that is as far as lengths do not prune; a task hands
on only an anchor's best rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravan.llm.common import numbered, placed, scratch_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET = 2048
ANCHORS = 1024
FOCUS = 4
EXACT = float(2 ** 53)  # products of doubles are exact below
_LONG = np.iinfo(np.int64)
_FOUND = "aid long, goal long, key long, vec_id long, score long"


# ---------------------------------------------------------------- one bucket
class Bucket:
    """Rows of like length with a sorted list for each coordinate."""

    def __init__(self, x: np.ndarray):
        self.x = x
        norm = np.sqrt((x * x).sum(axis=1))
        self.longest = float(norm.max())
        unit = x / np.where(norm > 0, norm, 1)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.place = np.empty_like(self.order)  # of each row in each list
        np.put_along_axis(self.place, self.order, np.arange(len(x))[:, None], axis=0)
        self.values = np.take_along_axis(unit, self.order, axis=0)

    def candidates(self, q: np.ndarray, low: float) -> np.ndarray | slice:
        """Rows whose product with q can reach ``low``."""
        length = float(np.sqrt(q @ q))
        if low <= 0:
            return np.arange(len(self.x))
        if length * self.longest * (1 + 1e-9) < low:
            return np.zeros(0, np.int64)
        # the cosine that even the longest vector needs, rounded down
        theta = min(1.0, low / (length * self.longest)) * (1 - 1e-9)
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        c = q[focus] / length
        reach = np.sqrt(np.maximum(0.0, (1 - c * c) * (1 - theta * theta))) + 1e-9
        # a list is feasible to its end where the anchor is nearer to its axis than the angle allowed
        top = np.where(c >= theta, np.inf, c * theta + reach)
        bottom = np.where(-c >= theta, -np.inf, c * theta - reach)
        fro = [int(np.searchsorted(self.values[:, f], v, "left")) for f, v in zip(focus, bottom, strict=True)]
        to = [int(np.searchsorted(self.values[:, f], v, "right")) for f, v in zip(focus, top, strict=True)]
        best = int(np.argmin(np.subtract(to, fro)))
        found = self.order[fro[best]:to[best], focus[best]]
        for i, f in enumerate(focus):
            if i != best:
                at = self.place[found, f]
                found = found[(at >= fro[i]) & (at < to[i])]
        return found

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        x = self.x[rows]
        if float(np.sqrt(q @ q)) * self.longest < EXACT:
            return (x @ q).astype(np.int64)
        exact = [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in x]
        return np.array([min(max(s, _LONG.min), _LONG.max) for s in exact], np.int64)


def first(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """The k greatest scores, ties to the smaller id, then key."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((keys[at], ids[at], -scores[at]))[:k]]


def _vectors(col: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(col), width))
    for i, v in enumerate(col):
        out[i, :len(v)] = v
    return out


def _unit(k: int, width: int, same_label: bool, low_percent: int = 0):
    """One task: the best rows of a bucket for each anchor of a block, either of
    its label (one goal, 0) or of another label for each of its goals."""
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 5]
        if len(anchors) and len(rows):
            bucket = Bucket(_vectors(rows["v"], width))
            keys, ids, labels = (rows[c].to_numpy() for c in ("key", "vec_id", "label"))
            for q, aid, label, low, goals in zip(_vectors(anchors["q"], width), anchors["aid"], anchors["a_label"],
                                                 anchors["low"], anchors["goals"], strict=True):
                at = bucket.candidates(q, low)
                at = at[(keys[at] != aid) & ((labels[at] == label) == same_label)]
                s = bucket.scores(q, at)
                for goal in goals.tolist():
                    fits = np.arange(len(at))
                    if not same_label:  # low_percent * goal <= 100 * s <= 100 * goal, in whole numbers
                        fits = np.flatnonzero((s <= goal) & (s >= -(-low_percent * goal // 100)))
                    best = fits[first(s[fits], ids[at[fits]], keys[at[fits]], k)]
                    out.append((np.full(len(best), aid), np.full(len(best), goal), keys[at[best]], ids[at[best]], s[best]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("aid", "goal", "key", "vec_id", "score"),
                                                                  zip(*out, strict=True), strict=True)})
    return run


# ---------------------------------------------------------------- search
def sound(vector: Column) -> Column:
    """Not null, not empty, all components finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(
        vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))


def _floor(x: Column) -> Column:
    """floor as a double, also beyond the range of a long."""
    return F.when(F.abs(x) < F.lit(EXACT), F.floor(x).cast("double")).otherwise(x)


def bucketed(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(key, vec_id, label, v, length, bucket): rows numbered from the longest
    on (then by id, label and a hash of the vector) and cut into buckets."""
    x = F.col(vector_col)
    rows = df.where(sound(x)).select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.transform(x, lambda e: _floor(F.lit(float(scale)) * e.cast("double"))).alias("v")
    ).where("vec_id is not null and label is not null")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    rows = rows.withColumn("length", length).withColumn("_hash", F.xxhash64("v"))
    rows = placed(numbered(rows, [F.desc("length"), F.col("vec_id"), F.col("label"), F.col("_hash")], "negatives-rows"))
    return rows.select(F.col("place").alias("key"), "vec_id", "label", "v", "length",
                       F.floor(F.col("place") / BUCKET).cast("long").alias("bucket"))


def _searched(asked: DataFrame, rows: DataFrame, buckets: DataFrame, n: tuple[int, int], unit) -> DataFrame:
    """``unit`` on every block of anchors and each of the buckets from n[0] to
    n[1] - 1 whose lengths do not rule out all of them."""
    enough = F.col("length") * F.col("longest") * F.lit(1 + 1e-9) >= F.col("low")
    need = asked.groupBy("block").agg(F.min(F.when(F.col("low") > 0, F.col("low") / F.col("length")).otherwise(
        F.lit(float("-inf")))).alias("need"))
    pairs = (need.withColumn("bucket", F.explode(F.sequence(F.lit(n[0]).cast("long"), F.lit(n[1] - 1).cast("long"))))
             .join(buckets.select("bucket", "longest"), "bucket")
             .where(F.col("longest") * F.lit(1 + 1e-9) >= F.col("need")).select("block", "bucket", "longest"))
    a = asked.join(pairs, "block").where(enough)
    b = rows.join(pairs, "bucket").select(F.col("block").alias("r_block"), F.col("bucket").alias("r_bucket"),
                                          "key", "vec_id", "label", "v")
    return a.groupBy("block", "bucket").cogroup(b.groupBy("r_block", "r_bucket")).applyInPandas(unit, _FOUND)


def hard_negatives(df: DataFrame, every: int, positives: int = 5, negatives: int = 5, low_percent: int = 80,
                   scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
                   label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and
    negative_score for the anchors, the rows whose id is divisible by ``every``."""
    rows = scratch_table(bucketed(df, id_col, vector_col, F.col("label") if label is None else label, scale),
                         "negatives-bucketed")
    buckets = scratch_table(rows.groupBy("bucket").agg(F.max("length").alias("longest"), F.max(F.size("v")).alias("width")),
                            "negatives-buckets")
    n, width = buckets.agg(F.count("*"), F.max("width")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                                   "positive_score long, negative_score long")
    anchors = placed(numbered(rows.where(F.col("vec_id") % every == 0).select(
        F.col("key").alias("aid"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"),
        F.col("v").alias("q"), "length"), ["aid"], "negatives-anchors"))
    anchors = scratch_table(anchors.withColumn("block", F.floor(F.col("place") / ANCHORS).cast("long")).drop("place"),
                            "negatives-blocks")
    no_bound, order = F.lit(float("-inf")), [F.desc("score"), "vec_id", "key"]

    # positives: the longest bucket gives each anchor its bound for the others
    unit = _unit(positives, width, True)
    asked = anchors.withColumn("goals", F.array(F.lit(0).cast("long"))).withColumn("low", no_bound)
    longest = scratch_table(_searched(asked, rows, buckets, (0, 1), unit), "negatives-longest")
    found = longest
    if n > 1:
        kth = longest.groupBy("aid").agg(F.count("*").alias("_n"), F.min("score").alias("_kth"))
        low = F.when(F.col("_n") == positives, F.col("_kth").cast("double")).otherwise(no_bound)
        bounded = scratch_table(asked.drop("low").join(kth, "aid", "left").withColumn("low", low).drop("_n", "_kth"),
                                "negatives-asked")
        found = longest.unionByName(_searched(bounded, rows, buckets, (1, n), unit))
    rank = F.row_number().over(Window.partitionBy("aid").orderBy(*order))
    best = scratch_table(found.withColumn("rank", rank).where(F.col("rank") <= positives).select(
        "aid", F.col("vec_id").alias("positive_id"), F.col("score").alias("goal")), "negatives-positives")

    # a negative score of the positive leaves nothing between its bounds
    goals = best.where("goal >= 0").groupBy("aid").agg(
        F.collect_set("goal").alias("goals"),
        F.ceil(F.min("goal") * F.lit(low_percent / 100 * (1 - 1e-12))).cast("double").alias("low"))
    asked = scratch_table(anchors.join(goals, "aid"), "negatives-goals")
    found = _searched(asked, rows, buckets, (0, n), _unit(negatives, width, False, low_percent))
    rank = F.row_number().over(Window.partitionBy("aid", "goal").orderBy(*order))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return (best.join(found, ["aid", "goal"]).join(anchors.select("aid", "anchor_id"), "aid")
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
                    F.col("goal").alias("positive_score"), F.col("score").alias("negative_score")))
