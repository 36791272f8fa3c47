"""Operator 13, periodic run detection by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q and a length of
at least max(``MIN_LENGTH``, ``EXPONENT`` * q) that no neighbouring word extends
with that period. Every word of a run stands in it ``EXPONENT`` times at least,
so a word that occurs less often in the current segment is in no run: it splits
the segment. Parts that are too short for any run go, the others are counted
anew, until no word is rare in its segment. All segments of all texts of a
batch take these steps together.

What survives is scanned lag by lag. A run of period q holds at least
``EXPONENT - 1`` whole blocks of the grid 0, q, 2q, ..., so equal hashes of
neighbouring blocks name every place where lag q can have a run (hashes only
nominate; a place is extended word by word in both directions). A lag q costs m / q
for a segment of m words, all lags together m log m. A stretch that a smaller
period already gave has that one as its smallest period (a stretch of two
periods that both fit twice also has their greatest common divisor), and the
multiples of a found period are skipped inside its run.

Defined results: a null text has no words; a text without words has no run and
an empty ``collapsed``; words are compared as they are; rows that repeat an id
or a text are rows of their own; a null id stays null; an empty table gives no rows;
other columns are not read.

Scale: row-wise, no shuffle. A task holds one Arrow batch (bounded in bytes by
Spark), cut into slices of ``SLICE_WORDS`` words; one text is never cut.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravan.llm.common import WORD, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXPONENT = 4
MIN_LENGTH = 6
SLICE_WORDS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the block hashes

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


# ---------------------------------------------------------------- splitting
def split(codes: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Places (in ``codes``) of the segments that survive; ``doc`` numbers the
    text of each word."""
    at, seg, wide = np.arange(len(codes)), doc.astype(np.int64), int(codes.max(initial=0)) + 1
    while len(at):
        # a segment goes on while its places do
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(seg) != 0)
        seg = np.cumsum(new) - 1
        long = (np.bincount(seg) >= MIN_LENGTH)[seg]
        at, seg = at[long], seg[long]
        _, which, n = np.unique(seg * wide + codes[at], return_inverse=True, return_counts=True)
        often = n[which] >= EXPONENT
        if len(at) and often.all():
            return np.split(at, np.flatnonzero(np.diff(seg)) + 1)
        at, seg = at[often], seg[often]
    return []


# ---------------------------------------------------------------- lag scan
def _equal_from(x: np.ndarray, q: int, at: int) -> int:
    """First i >= at with x[i] != x[i + q]."""
    end, step = len(x) - q, 64
    while at < end:
        to = min(end, at + step)
        bad = np.flatnonzero(x[at:to] != x[at + q:to + q])
        if len(bad):
            return at + int(bad[0])
        at, step = to, 4 * step
    return end


def _equal_to(x: np.ndarray, q: int, at: int) -> int:
    """Smallest i with x[j] == x[j + q] for all j from i to at - 1."""
    step = 64
    while at > 0:
        fro = max(0, at - step)
        bad = np.flatnonzero(x[fro:at] != x[fro + q:at + q])
        if len(bad):
            return fro + int(bad[-1]) + 1
        at, step = fro, 4 * step
    return 0


def lag_scan(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment."""
    m = len(x)
    power = np.empty(m + 1, np.uint64)
    power[0] = 1
    power[1:] = _BASE
    with np.errstate(over="ignore"):
        np.multiply.accumulate(power, out=power)
        prefix = np.zeros(m + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
        found: list[tuple[int, int, int]] = []
        known: set[tuple[int, int]] = set()
        multiples: dict[int, list[tuple[int, int]]] = {}
        for q in range(1, m // EXPONENT + 1):
            block = np.diff(prefix[::q][:m // q + 1])
            same = block[:-1] * power[q] == block[1:]
            hit = np.flatnonzero(same[:-1] & same[1:])
            done = multiples.pop(q, [])
            if not len(hit):
                continue
            for s, e in done:
                hit = hit[(hit * q < s) | ((hit + EXPONENT - 1) * q > e)]
            reach = -1
            for j in hit.tolist():
                if j * q < reach:
                    continue
                lo, hi = _equal_to(x, q, j * q), _equal_from(x, q, j * q)
                reach = hi
                end = hi + q
                if end - lo < max(MIN_LENGTH, EXPONENT * q) or (lo, end) in known:
                    continue
                known.add((lo, end))
                found.append((lo, end - lo, q))
                for k in range(2 * q, (end - lo) // EXPONENT + 1, q):
                    multiples.setdefault(k, []).append((lo, end))
    return found


# ---------------------------------------------------------------- one slice
def _slice(lists: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed) of a slice of word lists."""
    sizes = pc.list_value_length(lists).to_numpy()
    values = lists.flatten()
    codes = values.dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    rows = []
    for places in split(codes, doc):
        d = int(doc[places[0]])
        base = int(places[0] - first[d])
        rows += [(d, base + s, n, q) for s, n, q in lag_scan(codes[places])]
    rows.sort(key=lambda r: (r[0], r[1], r[3]))
    table = np.array(rows, np.int64).reshape(-1, 4)
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, first[table[:, 0]] + table[:, 1] + table[:, 3], 1)
    np.add.at(cover, first[table[:, 0]] + table[:, 1] + table[:, 2], -1)
    keep = np.cumsum(cover[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(sizes)))]).astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), values.filter(pa.array(keep))), " ")
    runs = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(table[:, 0], np.arange(len(sizes) + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(table[:, i]) for i in (1, 2, 3)], names=["start", "length", "period"]))
    return runs, collapsed


def _runs(batches):
    for b in batches:
        lists = b.column(1)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        at = 0
        while at < len(lists):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + SLICE_WORDS, "right")))
            runs, collapsed = _slice(lists.slice(at, to - at))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), runs.cast(_RUN), collapsed],
                                             names=["doc_id", "runs", "collapsed"])
            at = to


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  word_list: Column | None = None) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period; by start,
    then period) and ``collapsed``, its words without those that a run repeats
    after its first period. ``word_list`` replaces the words of the text."""
    listed = words(text_or_empty(text_col)) if word_list is None else word_list
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), listed.alias("words"))
    return rows.mapInArrow(_runs, f"doc_id long, runs {RUN}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period, ties by start, then
    period (the order of ``runs``); null if there is none."""
    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def with_periods(text: Column, doc_id: Column) -> Column:
    """The words of ``text``; where the checksum of the id ends in 0, what
    follows place a repeats with a period drawn from the same checksum."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / F.lit(10)).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % F.lit(8))).cast("long")
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
    # one element of an array, so that the words are taken once
    return F.element_at(F.transform(F.array(words(text)), lambda w: F.when(
        (h % 10 == 0) & (F.size(w) > 0), repeated(w)).otherwise(w)), 1)
