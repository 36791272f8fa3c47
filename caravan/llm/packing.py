"""Operator 9, best-fit packing by a linear grouping scheme.

Every document becomes its ids plus an end id; one longer than a sequence is cut
into full pieces and a rest. Lengths are integers up to ``capacity``, so the
pieces' histogram (at most ``capacity`` rows) is all that the plan needs:

1. large lengths, in falling order, are dealt into ``groups`` groups of equal
   cardinality, each rounded up to its largest length;
2. configurations of these few sizes are optimised one after the other: the
   largest size left plus the subset of the others that fills the sequence best,
   taken as often as the groups allow;
3. the actual lengths replace the rounded ones, run by run, which gives back the
   rounding's space;
4. the small lengths go, longest first, to the tightest sequence that holds them.

The plan consists of runs: "the pieces of length l ranked r to r + n are in
sequences s to s + n at offset o". Spark ranks the pieces of each length (range
partitions and prefix sums of their counts) and each task looks its pieces up in
the plan, so neither a common length nor a large table meets in one task.

Defined results: a null text is empty and has the end id alone; null and
repeated ids are pieces of their own, ordered like any other; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.llm.common import numbered, scratch_table, starts
from caravan.llm.tokens import default_tokenizer, word_ids

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
GROUPS = 256       # rounded sizes
SMALL = 1 / 8      # lengths up to this share of a sequence are small


# ---------------------------------------------------------------- pieces
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        cache, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            cols = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), cache.of(b.column(1).to_pylist()), strict=True):
                data, step = ids + end, 4 * capacity
                for k, at in enumerate(range(0, len(data), step)):
                    cut = data[at:at + step]
                    for c, v in zip(cols, (doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECE, strict=True)],
                                             schema=_PIECE)
    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
           end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), end_id, capacity),
                           "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- plan
def linear_groups(hist: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """[(rounded size, runs [length, first rank, count])], sizes falling."""
    total = sum(hist.values())
    each = max(1, -(-total // groups))
    out: list[tuple[int, list[list[int]]]] = []
    left = 0
    for length in sorted(hist, reverse=True):
        rank, count = 0, hist[length]
        while count:
            if left == 0:
                left = each
                if not out or out[-1][0] != length:  # equal sizes are one group
                    out.append((length, []))
            take = min(left, count)
            out[-1][1].append([length, rank, take])
            rank, count, left = rank + take, count - take, left - take
    return out


def best_configuration(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """index -> uses: the largest size left and the fullest subset beside it."""
    first = next(i for i, n in enumerate(left) if n)
    room, mask = capacity - sizes[first], (1 << (capacity - sizes[first] + 1)) - 1
    reach, stages = 1, []  # bit c: c tokens can be filled exactly
    for i in range(first, len(sizes)):
        s, n = sizes[i], left[i] - (i == first)
        for _ in range(min(n, room // s)):
            more = reach | (reach << s) & mask
            if more == reach:
                break
            stages.append((i, reach))
            reach = more
    fill, uses = reach.bit_length() - 1, {first: 1}
    for i, before in reversed(stages):
        if not before >> fill & 1:
            uses[i] = uses.get(i, 0) + 1
            fill -= sizes[i]
    return uses


class Plan:
    """Runs (length, first rank, count, first sequence, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.n_sequences = capacity, [], 0
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, count)

    def new(self, n: int) -> int:
        self.n_sequences += n
        return self.n_sequences - n

    def configuration(self, slots: list[list[list[int]]], times: int) -> None:
        """``times`` sequences; each slot brings runs of as many pieces."""
        while times:
            n = min(times, *(runs[0][2] for runs in slots))
            first, used = self.new(n), 0
            for runs in slots:
                length, rank, count = runs[0]
                self.rows.append((length, rank, n, first, used))
                used += length
                if count == n:
                    runs.pop(0)
                else:
                    runs[0] = [length, rank + n, count - n]
            if used < self.capacity:
                self.open[self.capacity - used].append((first, n))
            times -= n

    def best_fit(self, length: int, count: int) -> None:
        rank, room = 0, length
        while count and room <= self.capacity:
            if not self.open[room]:
                room += 1
                continue
            first, n = self.open[room].pop()
            rank, count = self._fill(length, rank, count, first, n, room)
        each = self.capacity // length
        while count:
            n = max(1, count // each)
            rank, count = self._fill(length, rank, count, self.new(n), n, self.capacity)

    def _fill(self, length: int, rank: int, count: int, first: int, n: int, room: int) -> tuple[int, int]:
        """Fills n sequences with ``room`` each as far as ``count`` pieces go:
        whole sequences first, then one in part; the rest stays open as it is."""
        each = room // length
        whole = min(n, count // each)
        for per, seq, m in ((each, first, whole), (count - whole * each, first + whole, 1)):
            if m == 0 or per <= 0 or seq >= first + n:
                continue
            per = min(per, each)
            for k in range(per):
                self.rows.append((length, rank, m, seq, self.capacity - room + k * length))
                rank, count = rank + m, count - m
            if room - per * length:
                self.open[room - per * length].append((seq, m))
            n, first = n - m, seq + m
        if n:
            self.open[room].append((first, n))
        return rank, count


def make_plan(hist: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> Plan:
    plan = Plan(capacity)
    grouped = linear_groups({k: n for k, n in hist.items() if k > capacity * small}, groups)
    sizes = [s for s, _ in grouped]
    runs = [r for _, r in grouped]
    left = [sum(x[2] for x in r) for r in runs]
    while any(left):
        uses = best_configuration(sizes, left, capacity)
        times = min(left[i] // n for i, n in uses.items())
        slots = []
        for i, n in uses.items():
            left[i] -= n * times
            for _ in range(n):  # each slot gets pieces of its own
                slots.append(_cut(runs[i], times))
        plan.configuration(slots, times)
    for length in sorted((k for k in hist if k <= capacity * small), reverse=True):
        plan.best_fit(length, hist[length])
    return plan


def _cut(runs: list[list[int]], n: int) -> list[list[int]]:
    """Takes the first n pieces off ``runs``."""
    out = []
    while n:
        length, rank, count = runs[0]
        take = min(n, count)
        out.append([length, rank, take])
        n -= take
        if take == count:
            runs.pop(0)
        else:
            runs[0] = [length, rank + take, count - take]
    return out


# ---------------------------------------------------------------- placing
def _place(rows: np.ndarray):
    """rows: the plan by (length, first rank), as an int64 array."""
    def run(batches):
        width = int(rows[:, 1].max()) + 2 if len(rows) else 1
        keys = rows[:, 0] * width + rows[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length * width + np.minimum(rank, width - 1), side="right") - 1
            hit = rows[at]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, piece, start, length,
    ids_crc32)."""
    ordered = numbered(cut, ["length", "doc_id", "piece", "start", "ids_crc32"], "pack-order")
    # at most one row per length, and one more where a partition ends inside it
    per = ordered.groupBy("_part", "length").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    hist = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(hist, capacity, groups, small)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    before = starts(per, "_part", {"before": "n"}, by=["length"]).select("_part", "length", "first", "before")
    ranked = ordered.join(F.broadcast(before), ["_part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("_row") - F.col("first")).alias("rank"))
    return ranked.mapInArrow(_place(rows), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                           "sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and place in it."""
    cut = scratch_table(pieces(docs, id_col, text_col, tokenizer, end_id, capacity), "pack-pieces")
    return pack_pieces(cut, capacity)
