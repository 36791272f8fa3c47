"""Operator 2, sharding: contiguous shards of near-equal byte size.

Documents are taken in id order (range partitions), each partition gives its
byte and row totals, the exclusive prefix sums of those totals place every
document on one global byte axis, and the axis is cut at equal targets. A
document belongs to the shard that holds its middle byte, so a shard differs
from the target by less than its largest document.

Defined results: a null text has no bytes; a null id sorts first; repeated ids
are ordered by text checksum and size (rows alike in all three are
interchangeable); an empty table gives no rows; other columns of the input are
not read, so their names cannot clash.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.llm.common import scratch_table, shuffle_partitions, starts, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW_OVERHEAD = 8  # bytes counted for each document besides its text


def _running(batches):
    """Adds the range partition, the place in it and the bytes before a row."""
    part, rows, before = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size = b.column(1).to_numpy()
        ends = before + np.cumsum(size, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(len(size), part, np.int32)),
             pa.array(np.arange(rows, rows + len(size), dtype=np.int64)), pa.array(ends - size)],
            names=["doc_id", "size", "text_crc32", "part", "row", "bytes_before"])
        if len(size):
            rows, before = rows + len(size), int(ends[-1])


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its shard (0 to ``n_shards`` - 1), its gapless
    ``slot`` in the shard, its size and text checksum."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    placed = scratch_table(
        rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
        .mapInArrow(_running, "doc_id long, size long, text_crc32 long, part int, row long, bytes_before long"),
        "shard-rows")

    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    offsets = starts(totals, "part", {"bytes_start": "part_bytes", "rows_start": "part_rows"})
    total = totals.agg(F.sum("part_bytes").alias("all_bytes"))
    # one row per range partition
    offsets = offsets.select("*", total.scalar().alias("all_bytes"))
    located = placed.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32",
        (F.col("rows_start") + F.col("row")).alias("place"),
        F.expr(f"cast(least({n_shards - 1}, (2 * (bytes_start + bytes_before) + size) * {n_shards} "
               "div (2 * all_bytes)) as int)").alias("shard"))
    first = located.groupBy("shard").agg(F.min("place").alias("first_place"))  # n_shards rows
    return located.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot"))
