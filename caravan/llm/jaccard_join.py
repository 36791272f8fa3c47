"""Operator 6, n-gram Jaccard join by a blocked sparse matrix product.

Two documents link when the Jaccard similarity of their word shingle sets is at
least ``percent`` / 100. The overlap counts are the product of the document by
n-gram incidence matrix with its transpose; it is taken block by block, and only
for blocks and pairs that size-derived bounds leave possible:

* Documents with equal sets are one row of the matrix (a node).
* Sizes n <= m can link only if 100 n >= percent m, and then differ in at most
  d = floor((n + m)(100 - percent) / (100 + percent)) shingles. Per size class the
  n-grams are dealt by hash into more than d parts; at least one part is the same
  in both (pigeonhole), so its digest brings the pair into one block. No link is
  lost, however frequent a shingle is, and a shared passage alone makes no block
  unless a whole part consists of it.
* A set of E parts shares at least E - d of them with whatever it links with. The
  nodes of a digest are its run. Short runs (``RUN`` nodes at most) give their
  pairs; a pair that shares too few parts (those of short runs counted, those of
  long runs allowed for) is none. What is left is bounded by class histograms,
  sixteen times smaller than the sets, and then multiplied pair by pair.
* In long runs no pairs are made. A node leaves out its E - d - 1 most common
  parts: the rarest common part of a pair that links is never among them. The
  long runs that stay join nodes to block families. A passage that many
  documents share fills few of a document's parts, so it joins none; what does are large groups of
  nearly equal documents. Every node is first multiplied with the family's hub
  (the node with most such runs). The Jaccard distance is a metric: nodes that link to
  the hub need no product among each other, and a node farther than twice the
  link distance needs none with them. This keeps a large family of near copies
  linear.
* Of what is left in a family, pairs are discarded whose class histograms bound
  the overlap below what their sizes ask for; the rest is multiplied in blocks of ``BLOCK`` rows of like size (blocks whose sizes
  cannot link do not meet), accumulating overlap counts over column chunks and
  discarding pairs whose count cannot reach the bound any more. A block returns a
  spanning forest of its links, not its pairs.

Components of the links follow by contraction (``components``).

Words are the runs of other characters between white space (space, U+0009 to
U+000D), A-Z lower-cased; a shorter text is one shingle.

Defined results: a null text, or one without words, has an empty set and links
with nothing; a null id is ignored when a component's smallest id is taken, and
a component of null ids alone has null; repeated rows are documents of one
component; an empty table gives no rows; other columns are not read. Shingles
are 64-bit hashes and a node's name is a 64-bit digest of its set.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravan.llm.common import arrow_rows, scratch_table
from caravan.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = 24               # nodes of a run whose pairs are listed
HUB_ROWS = 1024        # rows of a family multiplied with one copy of its hub
BITS = 1 << 23         # bits of the filter that picks the texts wanted (1 MB)
CLASS_RATIO = 1.5      # width of a size class; must exceed 100 / percent
BLOCK = 128            # rows of a matrix block
WIDE_BLOCK = 1024      # rows of a block of histograms
COLUMNS = 4096         # columns multiplied at a time
CACHE_WORDS = 100_000  # word hashes kept by a Python worker


def _tidy(run):
    """``run``, after which the worker gives the memory of its batches back: it
    lives on and would keep it beside the next operators'."""
    def tidied(batches):
        import ctypes
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)
    return tidied


# ---------------------------------------------------------------- sets
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash
    name, kept = sys.__dict__.get("_caravan_cache", (None, None))
    if name != "word hashes" or len(kept) > CACHE_WORDS:  # a worker keeps one cache
        kept = {}
        sys.__dict__["_caravan_cache"] = ("word hashes", kept)
    for w in set(words).difference(kept):
        kept[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    n = min(width, len(h))
    out = h[:len(h) - n + 1]
    for k in range(1, n):
        out = _mix(out) + h[k:len(h) - n + 1 + k]
    return np.unique(_mix(out ^ np.uint64(n)))


def node_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(grams.tobytes()).digest()[:8], "little", signed=True)


# ---------------------------------------------------------------- size-derived bounds
def max_difference(size: int, percent: int) -> int:
    """Most shingles in which a set of up to ``size`` and a smaller one that
    links with it can differ."""
    return 2 * size * (100 - percent) // (100 + percent)


def size_class(n: int, percent: int) -> tuple[int, int]:
    """(number, largest size) of the class that holds size n. Class 0 has the
    sizes of which only equal sets link."""
    top, c = (100 + percent - 1) // (2 * (100 - percent)) if percent < 100 else n, 0
    while n > top:
        top, c = max(top + 1, int(top * CLASS_RATIO)), c + 1
    return c, top


def parts(grams: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the parts of a set, for each class a partner can be in, and
    their marks: the number of parts shared with whatever links, times 64, plus
    the class."""
    n = len(grams)
    out, marks, size, widest = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], n, n * 100 // percent
    while n:
        c, top = size_class(size, percent)
        d = max_difference(top, percent)
        if c:
            count = int((d + 1) * 1.12) + 3  # some to spare, as parts may be empty
            at = ((grams >> np.uint64(7)) % np.uint64(count)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums = np.add.reduceat(_mix(grams + np.uint64(c))[order], first)
            where = at[order][first]
            if len(where) <= d:  # too few to be sure of a common one: empty parts count as well
                empty = np.setdiff1d(np.arange(count), where)
                where, sums = np.concatenate([where, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
            out.append(_mix(sums ^ _mix(where.astype(np.uint64) + np.uint64(c << 32))))
            marks.append(np.full(len(where), (len(where) - d) << 6 | c, np.int32))
        if top >= widest:
            break
        size = top + 1
    return np.concatenate(out), np.concatenate(marks)


def digests(grams: np.ndarray, percent: int) -> np.ndarray:
    return parts(grams, percent)[0]


# ---------------------------------------------------------------- passes over the texts
def _nodes(width: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_hash"),
                 pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "row_hash", "node", "n"])
    return run


def _digest_rows(width: int, percent: int):
    def run(batches):
        seen = set()  # nodes of this task: a copy adds nothing
        for b in batches:
            nodes, found, marks = [], [], []
            for t in b.column("text").to_pylist():
                grams = shingle_set(t, width)
                node = node_of(grams)
                if len(grams) and node not in seen:
                    seen.add(node)
                    d, m = parts(grams, percent)
                    found.append(d)
                    marks.append(m)
                    nodes.append(np.full(len(d), node, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(nodes)),
                     pa.array(np.concatenate(marks))], names=["digest", "node", "mark"])
    return run


def run_rows(digest: np.ndarray, node: np.ndarray, mark: np.ndarray, long_run: int | None, limit: int) -> list:
    """(a, b, mark, long) of whole runs: the pairs (a < b) of short ones, node
    and digest of the rows of long ones (and of ``long_run``, which goes on)."""
    if not len(digest):
        return []
    start = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
    n = np.diff(np.append(start, len(digest)))
    big = (n > limit) | (digest[start] == long_run if long_run is not None else False)
    rows = np.repeat(big, n)
    out = [(node[rows], digest[rows], mark[rows], np.ones(int(rows.sum()), bool))]
    for size in np.unique(n[~big & (n > 1)]):
        at = start[~big & (n == size)][:, None] + np.arange(size)
        i, j = np.triu_indices(size, 1)
        a, b = at[:, i].ravel(), at[:, j].ravel()
        out.append((node[a], node[b], np.maximum(mark[a], mark[b]), np.zeros(len(a), bool)))
    return out


def _runs(limit: int):
    """Rows sorted by (digest, node) to ``run_rows``; at most ``limit`` rows of
    an unfinished run are held back."""
    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)],
                                          names=["a", "b", "mark", "long"])

    def run(batches):
        held, long_run, last = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], None, None
        for b in batches:
            if not b.num_rows:
                continue
            digest, node, mark = (np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, range(3), strict=True))
            new = np.concatenate([[(digest[0], node[0]) != last], (digest[1:] != digest[:-1]) | (node[1:] != node[:-1])])
            digest, node, mark = digest[new], node[new], mark[new]  # copies of a node stand side by side
            if not len(digest):
                held = [digest, node, mark]
                continue
            cut = int(np.searchsorted(digest, digest[-1]))
            goes_on = long_run == digest[-1] and cut == 0 or len(digest) - cut > limit
            to = len(digest) if goes_on else cut
            rows = run_rows(digest[:to], node[:to], mark[:to], long_run, limit)
            last = (digest[-1], node[-1]) if goes_on else None
            long_run = digest[-1] if goes_on else None
            held = [digest[to:], node[to:], mark[to:]]
            if rows:
                yield batch(rows)
        rows = run_rows(*held, long_run, limit)
        if rows:
            yield batch(rows)
    return run


def _chosen(bits: np.ndarray):
    """Rows whose ``row_hash`` the filter may hold."""
    def run(batches):
        for b in batches:
            at = b.column("row_hash").to_numpy() & (BITS - 1)
            yield b.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("node", "family", "hub", "salt")), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([histogram(s).tobytes() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "family", "hub", "salt", "n", "histogram", "grams"])
    return run


# ---------------------------------------------------------------- products
def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _with_hub(percent: int):
    """zone 0: links to the hub; 1: may link to what does; 2: cannot."""
    def run(batches):
        for b in batches:
            zones = []
            for mine, hubs in zip(b.column("grams").to_pylist(), b.column("hub_grams").to_pylist(), strict=True):
                x, h = np.frombuffer(mine, np.uint64), np.frombuffer(hubs, np.uint64)
                both = _overlap(x, h)
                union = len(x) + len(h) - both
                # distance <= 2 * (1 - percent / 100)
                near = 100 * (union - both) <= 2 * (100 - percent) * union
                zones.append(0 if 100 * both >= percent * union else 1 if near else 2)
            keep = ("node", "family", "hub", "n", "histogram")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(zones, pa.int32())],
                                             names=[*keep, "zone"])
    return run


def _possible_pairs(percent: int):
    """The pairs whose histograms allow a link."""
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint16).astype(np.int64), np.frombuffer(y, np.uint16).astype(np.int64)
                classes = min(len(x), len(y))
                both = np.minimum(x.reshape(-1, classes).sum(axis=0), y.reshape(-1, classes).sum(axis=0)).sum()
                keep.append((100 + percent) * both >= percent * (x.sum() + y.sum()))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _linked(percent: int):
    """The pairs that link."""
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = _overlap(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of the links between two lists of sets."""
    if not left or not right:  # a block's hash range may be empty
        return np.zeros((len(left), len(right)), bool)
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    alive = (100 * n[:, None] >= percent * m) & (100 * m >= percent * n[:, None])
    # least overlap that links: 100 o >= percent (n + m - o)
    need = -(-percent * (n[:, None] + m) // (100 + percent))
    rows = np.concatenate([np.repeat(np.arange(len(left)), n), len(left) + np.repeat(np.arange(len(right)), m)])
    columns, at, uses = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    # a column that one row alone uses adds to no overlap
    kept = uses[at] > 1
    rows, at = rows[kept], (np.cumsum(uses > 1) - 1)[at[kept]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    rest = np.bincount(rows, minlength=len(left) + len(right))
    rest_l, rest_r = rest[:len(left)], rest[len(left):]
    count = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        alive &= count + np.minimum(rest_l[:, None], rest_r) >= need
        if not alive.any():
            break
        here = slice(*np.searchsorted(at, [c, c + COLUMNS]))
        a = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        a[rows[here], at[here] - c] = 1
        count += a[:len(left)] @ a[len(left):].T
        used = a.sum(axis=1).astype(np.int64)
        rest_l, rest_r = rest_l - used[:len(left)], rest_r - used[len(left):]
    return alive & (count >= need)


def forest(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the same nodes as the links (a[i], b[j]), as stars."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(links), strict=True):
        x, y = find(int(a[i])), find(int(b[j]))
        root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def histogram(grams: np.ndarray) -> np.ndarray:
    """Counts of a set's columns in about n / 2 hash classes (a power of two)."""
    classes = 1 << max(4, len(grams).bit_length() - 2)
    at = (grams >> np.uint64(24)) & np.uint64(classes - 1)
    return np.bincount(at.astype(np.int64), minlength=classes).astype(np.uint16)


def _bounded(percent: int):
    """Forest of the pairs whose overlap, bounded by the sum of the smaller
    counts of each class, can reach the link bound."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = [np.frombuffer(x, np.uint16) for x in rows["histogram"]]
        classes = min(map(len, counts))
        h = np.array([c.reshape(-1, classes).sum(axis=0) for c in counts], np.uint32)
        size, nodes, side = h.sum(axis=1).astype(np.int64), rows["node"].to_numpy(), rows["side"].to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        links = np.zeros((len(left), len(right)), bool)
        for k, i in enumerate(left):
            both = np.minimum(h[i], h[right]).sum(axis=1)
            links[k] = (100 + percent) * both >= percent * (size[i] + size[right])
        links &= nodes[left][:, None] != nodes[right]
        return pd.DataFrame(forest(links, nodes[left], nodes[right]), columns=["a", "b"], dtype=np.int64)
    return run


def _product(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        nodes, side = rows["node"].to_numpy(), rows["side"].to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: both, a block with itself
        links = linked_pairs([sets[i] for i in left], [sets[i] for i in right], percent)
        links &= nodes[left][:, None] != nodes[right]
        return pd.DataFrame(forest(links, nodes[left], nodes[right]), columns=["a", "b"], dtype=np.int64)
    return run


def _block_counts(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(family, name): the family's blocks of ``size`` rows per size step; a
    family has some hundred steps at most."""
    n = rows.groupBy("family", "step").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
    return n.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias(name))


def _met(rows: DataFrame, mine: str, other: str, payload: str, unit) -> DataFrame:
    """Each row once for every block of ``other`` that its own block (dealt by
    hash within its step) meets: those of its step and the two beside it."""
    k = F.pmod(F.xxhash64("node"), F.try_element_at(mine, F.col("step"))).cast("int")

    def at(d: int) -> Column:
        n = F.coalesce(F.try_element_at(other, F.col("step") + d), F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda m: unit(
            F.struct("step", F.col("k").alias("block")), F.struct((F.col("step") + d).alias("step"), m.alias("block")))))
    units = F.flatten(F.filter(F.array(at(-1), at(0), at(1)), lambda x: x.isNotNull()))
    return rows.withColumn("k", k).select("family", "node", payload, F.explode(units).alias("u")).select(
        "family", "node", payload, "u.*")


def _unit(i: Column, j: Column, side) -> Column:
    return F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))


def _with_itself(rows: DataFrame, payload: str, size: int) -> DataFrame:
    """Units (family, i, j) of all pairs of rows (family, node, step, payload)."""
    rows = rows.join(_block_counts(rows, size, "blocks"), "family")
    return _met(rows, "blocks", "blocks", payload, lambda a, b: _unit(
        F.least(a, b), F.greatest(a, b), F.when(a == b, 2).when(a < b, 0).otherwise(1)))


def _between(left: DataFrame, right: DataFrame, payload: str, size: int) -> DataFrame:
    """Units (family, i, j) of all pairs of a left and a right row."""
    both = _block_counts(left, size, "l").join(_block_counts(right, size, "r"), "family")
    return _met(left.join(both, "family"), "l", "r", payload, lambda a, b: _unit(a, b, F.lit(0))).unionByName(
        _met(right.join(both, "family"), "r", "l", payload, lambda a, b: _unit(b, a, F.lit(1))))


def _blocks(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Forest edges of all products beyond the hubs'.

    Sets more than one size step (a factor of 100 / percent) apart cannot link.
    Rows that do not link to their hub are first compared by their histograms,
    which bound the overlap from above and are a sixteenth of the sets; only what
    these leave connected is a family for the products of the sets."""
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    near = near.withColumn("step", F.floor(F.log("n") / F.lit(width)).cast("int"))
    edge = "a long, b long"
    off = near.where("zone > 0")
    possible = (_with_itself(off.select("family", "node", "step", "histogram"), "histogram", WIDE_BLOCK)
                .groupBy("family", "i", "j").applyInPandas(_bounded(percent), edge))
    finer = components(possible).withColumnRenamed("label", "family")
    # the sets of what is still to be multiplied: a family's shell and core, if it has both
    grams = sets.select("node", "grams")
    own = off.select("node", "step").join(finer, "node").join(grams, "node")
    own = _with_itself(own.select("family", "node", "step", "grams"), "grams", BLOCK)
    shelled = near.where("zone = 1").select("family").distinct()
    inner = near.where("zone < 2").join(shelled, "family").join(grams, "node").select(
        "family", "node", "step", "zone", "grams")
    cross = _between(inner.where("zone = 1").drop("zone"), inner.where("zone = 0").drop("zone"), "grams", BLOCK)
    # families of the two kinds may share a name: their units must not
    units = own.withColumn("kind", F.lit(0)).unionByName(cross.withColumn("kind", F.lit(1)))
    return units.groupBy("kind", "family", "i", "j").applyInPandas(_product(percent), edge)


# ---------------------------------------------------------------- candidates
def _families(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, family, hub, salt) of the nodes that long runs join, and (node,
    class, held): how many of a node's parts are in long runs."""
    rows = runs.where("long").select(F.col("a").alias("node"), F.col("b").alias("digest"), "mark",
                                     F.col("mark").bitwiseAND(F.lit(63)).alias("class"))
    size = rows.groupBy("digest").agg(F.count("*").alias("size"))
    # a node's parts of one class, the most common first
    w = Window.partitionBy("node", "class")
    rows = scratch_table(rows.join(size, "digest").withColumn(
        "rank", F.row_number().over(w.orderBy(F.desc("size"), "digest"))).withColumn("held", F.count("*").over(w)),
        "jaccard-long")
    kept = scratch_table(rows.where(F.col("rank") >= F.shiftright("mark", 6)).select("node", "digest"), "jaccard-kept")
    # a run is a star around its smallest node: copies of one family have few of them
    head = kept.groupBy("digest").agg(F.min("node").alias("b"))
    family = components(kept.join(head, "digest").select(F.col("node").alias("a"), "b").distinct())
    weight = kept.groupBy("node").agg(F.count("*").alias("runs"))
    family = weight.join(family.withColumnRenamed("label", "family"), "node")
    hubs = family.groupBy("family").agg(F.max(F.struct("runs", "node"))["node"].alias("hub"),
                                        F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("copies"))
    family = family.join(hubs, "family").select(
        "node", "family", "hub", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("salt"))
    return scratch_table(family, "jaccard-families"), rows.where("rank = 1").select("node", "class", "held")


def _candidates(runs: DataFrame, family: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough parts, but for those inside a family."""
    pairs = (runs.where("not long").groupBy("a", "b", F.col("mark").bitwiseAND(F.lit(63)).alias("class"))
             .agg(F.count("*").alias("n"), F.max(F.shiftright("mark", 6)).alias("need")))
    for side in ("a", "b"):
        pairs = pairs.join(held.select(F.col("node").alias(side), "class", F.col("held").alias(f"held_{side}")),
                           [side, "class"], "left")
    both = F.least(F.coalesce("held_a", F.lit(0)), F.coalesce("held_b", F.lit(0)))
    pairs = pairs.where(F.col("n") + both >= F.col("need")).select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(family.select(F.col("node").alias(side), F.col("family").alias(f"family_{side}")), side, "left")
    return pairs.where("family_a is null or family_b is null or family_a <> family_b").select("a", "b")


def _met_pairs(pairs: DataFrame, sets: DataFrame, payload: str) -> DataFrame:
    """(a, b, x, y): the pairs with a column of their sets."""
    for side, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col(payload).alias(name)), side)
    return pairs


# ---------------------------------------------------------------- operator
def similar_components(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id
    that links reach), row_hash (of id and text) and kept (whether it has no
    words or is its component's smallest id)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_hash"),
                       F.col(text_col).alias("text"))
    with arrow_rows(rows.sparkSession, 1000):
        named = scratch_table(rows.mapInArrow(_tidy(_nodes(width)), "doc_id long, row_hash long, node long, n long"),
                              "jaccard-nodes")
    # of each node the row with the smallest id, nulls last
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash"))
    smallest = scratch_table(named.where("n > 0").groupBy("node").agg(pick.alias("p"))
                             .select("node", "p.doc_id", "p.row_hash"), "jaccard-smallest")

    with arrow_rows(rows.sparkSession, 1000):
        runs = scratch_table(rows.select("text").mapInArrow(_tidy(_digest_rows(width, percent)), "digest long, node long, mark int")
                             .repartition("digest").sortWithinPartitions("digest", "node")
                             .mapInArrow(_tidy(_runs(RUN)), "a long, b long, mark int, long boolean"), "jaccard-runs")
    family, held = _families(runs)
    pairs = scratch_table(_candidates(runs, family, held), "jaccard-pairs")

    # one document of each node wanted gives the set
    wanted = (pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(family.select("node")).distinct()
              .join(family, "node", "left").join(smallest.select("node", "row_hash"), "node"))
    wanted = scratch_table(wanted.withColumn("bit", F.col("row_hash").bitwiseAND(F.lit(BITS - 1)) + 1), "jaccard-wanted")
    bits = np.zeros(BITS // 8, np.uint8)
    for r in wanted.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():  # BITS / 32768 rows
        bits[4096 * (r["k"] - 1):4096 * r["k"]] = np.frombuffer(r["bits"], np.uint8)
    texts = rows.select("row_hash", "text").mapInArrow(_chosen(bits), "row_hash long, text string")
    sets = texts.join(wanted.drop("bit"), "row_hash").dropDuplicates(["row_hash"]).select("node", "family", "hub", "salt", "text")
    with arrow_rows(rows.sparkSession, 500):
        sets = scratch_table(sets.mapInArrow(_tidy(_sets(width)), "node long, family long, hub long, salt int, n long, "
                                                           "histogram binary, grams binary"), "jaccard-sets")
        possible = scratch_table(_met_pairs(pairs, sets, "histogram").mapInArrow(
            _possible_pairs(percent), "a long, b long"), "jaccard-possible")
        links = _met_pairs(possible, sets, "grams").mapInArrow(_linked(percent), "a long, b long")
        # a copy of the hub for each HUB_ROWS rows of its family
        own = sets.where("family is not null")
        copies = own.groupBy("family").agg(F.max("salt").alias("most"))
        of_hub = own.where("node = hub").join(copies, "family").select(
            "family", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("salt"), F.col("grams").alias("hub_grams"))
        near = scratch_table(own.join(of_hub, ["family", "salt"]).mapInArrow(
            _tidy(_with_hub(percent)), "node long, family long, hub long, n long, histogram binary, zone int"), "jaccard-zones")
    to_hub = near.where("zone = 0 and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    label = components(links.unionByName(to_hub).unionByName(_blocks(near, sets, percent)))

    joined = smallest.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = joined.groupBy("label").agg(pick.alias("p")).select(
        "label", F.col("p.doc_id").alias("component_id"), F.col("p.row_hash").alias("first_hash"))
    of_node = joined.join(first, "label").select("node", "component_id", "first_hash")
    alone = F.col("n") == 0
    return named.join(of_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "row_hash", (alone | (F.col("row_hash") == F.col("first_hash"))).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest
    id; documents without words all stay. Of rows that repeat id and text the
    first in order of the other columns stays."""
    found = similar_components(docs, width, percent, id_col, text_col).where("kept")
    keep = found.groupBy("row_hash").agg(F.max(F.col("n_shingles") == 0).alias("alone"))
    d = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(id_col, text_col).alias("row_hash"))
    d = d.join(keep, "row_hash")
    order = [F.col(f"row.`{c}`") for c, t in docs.dtypes if c not in (id_col, text_col) and "map" not in t]
    w = Window.partitionBy("row_hash").orderBy(*order or [F.lit(0)])  # the join's partitions
    return d.withColumn("i", F.row_number().over(w)).where("alone or i = 1").select("row.*")
