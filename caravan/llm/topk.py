"""Operator 3, exact top-k inner products by dual-tree cover-tree search.

Queries and data are indexed together. The top level is a net of ``PIVOTS``
centres picked from a bounded sample of ``FIT_ROWS`` vectors (smallest id
hashes); it only decides where a vector is filed, never what is found. Every
vector is filed under its nearest centre, each centre's covering radius is the
exact maximum over its vectors. A centre's data is split into blocks of about
``BLOCK`` rows and its queries into groups of the same size, so a common vector
or a crowded centre is spread over many tasks.

1. Each query group searches one block of its own centre. The group's worst kth
   score is from then on a lower bound (and each query's own kth score a bound
   for what later searches hand on).
2. A (query group, centre) pair is pruned if the largest inner product that the
   centres and radii allow, <q,p> + rq|p| + rp|q| + rq rp, is below that bound;
   the blocks of the other centres are searched, one task each.
3. Inside a task both sides are cover trees (greedy nets, radii halving) that
   are descended together under the same rule, down to leaf products.
4. The groups' answers are merged to each query's best k.

Scores are integer inner products of floor(scale * x), exact below 2^53; beyond,
the nearest double, cut to the range of a long.

Defined results: a vector that is null, empty, or holds a null or a non-finite
component takes no part, nor does a row without id; rows that repeat an id are rows
of their own: each is a candidate for all others, and each a query if its id is
one (their results stand under the same id); shorter vectors are padded with zeros; equal scores go to the
smaller id; a query with fewer than k candidates returns all; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caravan.llm.common import numbered, placed, scratch_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIVOTS = 8
FIT_ROWS = 2048
BLOCK = 1024
LEAF = 64


# ---------------------------------------------------------------- one task: trees
class Node:
    __slots__ = ("center", "radius", "rows", "kids", "norm")

    def __init__(self, center, radius, rows, kids):
        self.center, self.radius, self.rows, self.kids = center, radius, rows, kids
        self.norm = float(np.sqrt(center @ center))


def cover_tree(x: np.ndarray, rows: np.ndarray, at: int) -> Node:
    """Cover tree over ``rows`` of x, centred on row ``at``: the children are a
    greedy net of half the radius, each with its exact covering radius."""
    far = np.sqrt(((x[rows] - x[at]) ** 2).sum(axis=1))
    radius = float(far.max())
    if len(rows) <= LEAF or radius == 0:
        return Node(x[at], radius, rows, [])
    nets, rest = [], rows[np.argsort(far, kind="stable")]
    while len(rest):
        near = np.sqrt(((x[rest] - x[rest[0]]) ** 2).sum(axis=1)) <= radius / 2
        nets.append(rest[near])
        rest = rest[~near]
        if len(nets) > len(rows) // 4:  # nothing to gain at this scale: the node stays a leaf
            return Node(x[at], radius, rows, [])
    if len(nets) == 1:
        return Node(x[at], radius, rows, [])
    return Node(x[at], radius, rows, [cover_tree(x, r, int(r[0])) for r in nets])


def most(a: Node, b: Node) -> float:
    """No vector of a has a larger inner product with one of b."""
    v = float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
    return v + 1e-9 * abs(v) + 1e-6


class Search:
    """Best k (score, id) of every query row."""

    def __init__(self, q, q_ids, d, d_ids, k, low=-np.inf):
        self.q, self.q_ids, self.d, self.d_ids, self.k = q, q_ids, d, d_ids, k
        self.low = np.broadcast_to(low, len(q))  # scores below have no use
        self.score = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)

    def pair(self, a: Node, b: Node) -> None:
        if most(a, b) < np.maximum(self.score[a.rows, -1], self.low[a.rows]).min():
            return
        if not a.kids and not b.kids:
            self.leaves(a.rows, b.rows)
        elif b.kids and (not a.kids or b.radius >= a.radius):
            for c in sorted(b.kids, key=lambda c: -most(a, c)):
                self.pair(a, c)
        else:
            for c in a.kids:
                self.pair(c, b)

    def leaves(self, a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(b), 4 * LEAF):
            part = b[i:i + 4 * LEAF]
            s = self.q[a] @ self.d[part].T
            s[self.q_ids[a][:, None] == self.d_ids[part][None, :]] = -np.inf
            scores = np.concatenate([self.score[a], s], axis=1)
            ids = np.concatenate([self.ids[a], np.broadcast_to(self.d_ids[part], s.shape)], axis=1)
            ids[scores == -np.inf] = np.iinfo(np.int64).max
            order = np.lexsort((ids, -scores), axis=1)[:, :self.k]
            self.score[a] = np.take_along_axis(scores, order, 1)
            self.ids[a] = np.take_along_axis(ids, order, 1)


def _vectors(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), "<f8").reshape(len(col), -1)


_FOUND = "gid long, query_id long, vec_id long, score long"


def _unit(k: int):
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        cols = ["gid", "query_id", "vec_id", "score"]
        if not len(queries) or not len(data):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in cols})
        q, d = _vectors(queries["query"]), _vectors(data["data"])
        s = Search(q, queries["query_id"].to_numpy(), d, data["vec_id"].to_numpy(), k,
                   queries["low"].to_numpy())
        s.pair(cover_tree(q, np.arange(len(q)), 0), cover_tree(d, np.arange(len(d)), 0))
        hit = np.isfinite(s.score) & (s.score >= s.low[:, None])
        at = np.nonzero(hit)[0]
        return pd.DataFrame({"gid": queries["gid"].iloc[0], "query_id": s.q_ids[at], "vec_id": s.ids[hit],
                             "score": np.clip(s.score[hit], -2.0 ** 63, 2.0 ** 63 - 1024).astype(np.int64)})[cols]
    return run


# ---------------------------------------------------------------- top level
def net(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first centres of a bounded sample."""
    picked = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def _file(centers: np.ndarray):
    def run(batches):
        width = centers.shape[1]
        for b in batches:
            lists = b.column("v")
            n = pa.compute.list_value_length(lists).to_numpy()
            flat = lists.flatten().to_numpy().astype("<f8")
            x = np.zeros((len(n), width))
            x[np.arange(width) < n[:, None]] = flat
            far = np.sqrt(((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)) if len(n) else np.zeros((0, 1))
            node = far.argmin(axis=1) if len(n) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("ask"), pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.array(node.astype(np.int32)), pa.array(far[np.arange(len(n)), node])],
                names=["vec_id", "ask", "v", "node", "far"])
    return run


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): the rows that take part, with whole components."""
    x = F.col(vector_col)
    sound = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))),
                       F.lit(False))

    def whole(e):
        e = F.lit(float(scale)) * e.cast("double")
        return F.when(F.abs(e) < F.lit(2.0 ** 53), F.floor(e).cast("double")).otherwise(e)
    rows = df.where(sound & (F.size(x) > 0) & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def top_k(df: DataFrame, k: int, every: int, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the queries (rows whose id is
    divisible by ``every``) against every other row."""
    spark = df.sparkSession
    # from here on a row goes by its place in the order of ids, so ties go to the smaller id
    rows = placed(numbered(quantised(df, id_col, vector_col, scale), ["id"], "topk-numbered"))
    rows = scratch_table(rows.select(F.col("place").alias("vec_id"), "id", "v", (F.col("id") % every == 0).alias("ask")),
                         "topk-vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()
    fit = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        fit[i, :len(r["v"])] = r["v"]
    centers = net(fit, PIVOTS)
    filed = scratch_table(rows.drop("id").mapInArrow(
        _file(centers), "vec_id long, ask boolean, v binary, node int, far double"), "topk-filed")

    # PIVOTS rows: counts and covering radii of the top level
    is_query = F.col("ask")
    stats = {r["node"]: r for r in filed.groupBy("node").agg(
        F.count("*").alias("n"), F.max("far").alias("radius"), F.sum(is_query.cast("long")).alias("nq"),
        F.max(F.when(is_query, F.col("far"))).alias("q_radius")).collect()}
    blocks = {n: -(-r["n"] // BLOCK) for n, r in stats.items()}
    groups = {n: max(1, -(-r["nq"] // BLOCK)) for n, r in stats.items()}

    def dealt(counts: dict[int, int]):
        n = F.element_at(F.create_map(*[F.lit(v) for kv in counts.items() for v in kv]), F.col("node"))
        return F.pmod(F.xxhash64("vec_id"), n).cast("int")

    data = filed.select("vec_id", "v", "node", dealt(blocks).alias("block"))
    queries = filed.where(is_query).select(
        "vec_id", "v", "node", (F.col("node") * F.lit(1 << 32) + dealt(groups)).cast("long").alias("gid"))

    def searched(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """asked: queries with ``low``; pairs: (gid, node, block) to search, each
        in one task."""
        q = asked.join(pairs, "gid").select("gid", "node", "block", "query_id", "query", "low")
        d = data.join(pairs, ["node", "block"]).select(
            *(F.col(c).alias(f"d_{c}") for c in ("gid", "node", "block")), F.col("vec_id").alias("vec_id"),
            F.col("v").alias("data"))
        return q.groupBy("gid", "node", "block").cogroup(d.groupBy("d_gid", "d_node", "d_block")).applyInPandas(
            _unit(k), _FOUND)

    gids = queries.select("gid", "node").distinct()
    asked = queries.select("gid", F.col("vec_id").alias("query_id"), F.col("v").alias("query"))
    none = F.lit(float("-inf"))
    first = scratch_table(searched(asked.withColumn("low", none), gids.withColumn("block", F.lit(0))), "topk-first")
    kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    low = F.when(F.col("n") == k, F.col("kth").cast("double")).otherwise(none)
    bounds = scratch_table(queries.select("gid", "node", "vec_id").join(kth, "vec_id", "left")
                           .select("gid", "node", F.col("vec_id").alias("query_id"), low.alias("low")), "topk-bounds")
    worst = bounds.groupBy("gid", "node").agg(F.min("low").alias("worst"))

    # the largest product each pair of centres allows: PIVOTS x PIVOTS numbers
    norm = np.sqrt((centers ** 2).sum(axis=1))

    def allowed(a: int, b: int) -> float:
        ra, rb = stats[a]["q_radius"] or 0.0, stats[b]["radius"]
        v = float(centers[a] @ centers[b] + ra * norm[b] + rb * norm[a] + ra * rb)
        return v + 1e-9 * abs(v) + 1e-6

    options = F.array(*[F.struct(F.lit(a).alias("q"), F.lit(b).alias("node"), F.lit(blocks[b]).alias("blocks"),
                                 F.lit(allowed(a, b)).alias("most")) for a in stats for b in stats])
    pairs = (worst.select("gid", F.col("node").alias("own"), F.explode(
        F.filter(options, lambda o: (o["q"] == F.col("node")) & (o["most"] >= F.col("worst")))).alias("o"))
        .select("gid", "own", F.col("o.node").alias("node"), F.explode(F.sequence(F.lit(0), F.col("o.blocks") - 1))
                .alias("block"))
        .where((F.col("own") != F.col("node")) | (F.col("block") != 0)).drop("own"))
    rest = asked.join(bounds.select("query_id", "low"), "query_id")
    found = first.unionByName(searched(rest, pairs))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = (found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))
    for place in ("query_id", "vec_id"):
        best = best.join(rows.select(F.col("vec_id").alias(place), F.col("id").alias(f"{place}_of")), place)
    return best.select(F.col("query_id_of").alias("query_id"), "rank", F.col("vec_id_of").alias("vec_id"), "score")
