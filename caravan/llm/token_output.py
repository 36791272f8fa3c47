"""Operator 10, token-id output: fixed-width bit packing.

``write_tokens`` encodes every text, ends it with ``end_id`` and writes the ids
in ascending document order. The file format, one Parquet row per block:

* ``packed``: the block's ids, each in the minimum number of bits that holds the
  vocabulary, least significant bit first (at 16 bits: little-endian uint16);
* ``doc_ids`` and ``doc_starts``: the documents of the block and the place of
  their first id in it; ``n_ids``, ``bits``;
* ``part``, ``block``: range partition and block in it; ``first_doc`` and
  ``last_doc`` let a reader skip blocks.

A second small table, ``parts``, has the ids before each partition, so a
document's global place is parts.ids_start + block start + doc_starts. Blocks
close at ``block_ids`` ids; a document is not cut, so a longer one has a block
of its own. Parquet rows rather than raw files, because a cluster's shared
store is reachable through Spark's writers only.

``read_tokens`` unpacks whole blocks with numpy; ``unpack(..., start, stop)``
reads any id range of a block by bit offset without unpacking the rest.

Defined results: a null text is empty and has the end id alone; null ids sort
first; rows that repeat an id follow each other in text checksum order; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.llm.common import shuffle_partitions, starts, text_or_empty
from caravan.llm.tokens import default_tokenizer, word_ids

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_IDS = 1 << 18


def bits_for(vocab: int) -> int:
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """uint32 ids, ``bits`` bits each, least significant bit first."""
    if bits in (8, 16, 32):  # the same layout, without the bit matrix
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a packed block, as little-endian uint32."""
    if bits in (8, 16, 32):
        w = bits // 8
        return np.frombuffer(packed, f"<u{w}", stop - start, start * w).astype("<u4")
    first = start * bits // 8
    raw = np.frombuffer(packed, np.uint8, (stop * bits + 7) // 8 - first, first)
    flat = np.unpackbits(raw, bitorder="little")[start * bits - 8 * first:][:(stop - start) * bits]
    return (flat.reshape(-1, bits).astype("<u4") << np.arange(bits, dtype="<u4")).sum(axis=1, dtype="<u4")


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("block_start", pa.int64()), ("n_ids", pa.int64()),
                    ("bits", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("packed", pa.binary())])
BLOCK_SCHEMA = ("part int, block long, block_start long, n_ids long, bits int, first_doc long, last_doc long, "
                "doc_ids array<long>, doc_starts array<long>, packed binary")


def _blocks(path: str, end_id: int, bits: int, block_ids: int):
    def run(batches):
        cache, part = word_ids(path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        block, before = 0, 0
        docs, at, data, n = [], [], [], 0

        def close():
            return pa.RecordBatch.from_pylist([{
                "part": part, "block": block, "block_start": before, "n_ids": n, "bits": bits,
                "first_doc": docs[0], "last_doc": docs[-1], "doc_ids": docs, "doc_starts": at,
                "packed": pack(np.frombuffer(b"".join(data), "<u4"), bits)}], _BLOCK)

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), cache.of(b.column(1).to_pylist()), strict=True):
                k = len(ids) // 4 + 1
                if docs and n + k > block_ids:
                    yield close()
                    block, before = block + 1, before + n
                    docs, at, data, n = [], [], [], 0
                docs.append(doc)
                at.append(n)
                data += [ids, end]
                n += k
        if docs:
            yield close()
    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Writes ``path``/blocks and ``path``/parts."""
    from tokenizers import Tokenizer
    tokenizer = tokenizer or default_tokenizer()
    bits = bits_for(Tokenizer.from_file(tokenizer).get_vocab_size())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.crc32(text_or_empty(text_col).cast("binary")).alias("crc"))  # a short key to order repeated ids
    spark = docs.sparkSession
    (rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "crc").sortWithinPartitions("doc_id", "crc")
     .mapInArrow(_blocks(tokenizer, end_id, bits, block_ids), BLOCK_SCHEMA)
     .write.option("compression", "none").parquet(f"{path}/blocks"))  # packed bits do not compress
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    starts(totals, "part", {"ids_start": "n_ids"}).write.parquet(f"{path}/parts")


_DOC = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()),
                  ("ids_crc32", pa.int64())])


def _documents(with_ids: bool):
    schema = _DOC.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _DOC

    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                ids = unpack(x["packed"], x["bits"], 0, x["n_ids"])
                at = np.array([*x["doc_starts"], x["n_ids"]], np.int64)
                cut = [ids[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                columns = [pa.array(x["doc_ids"], pa.int64()), pa.array(np.full(len(cut), x["part"], np.int32)),
                           pa.array(at[:-1] + x["block_start"]), pa.array(np.diff(at)),
                           pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64())]
                if with_ids:
                    columns.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False, where=None) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids before it),
    n_tokens, ids_crc32 and, if asked for, the ids. ``where`` filters blocks by
    ``first_doc`` / ``last_doc`` before they are unpacked."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    if where is not None:
        blocks = blocks.where(where)
    blocks = blocks.select("part", "block_start", "n_ids", "bits", "doc_ids", "doc_starts", "packed")
    docs = blocks.mapInArrow(_documents(with_ids), "doc_id long, part int, at long, n_tokens long, ids_crc32 long"
                             + (", ids array<int>" if with_ids else ""))
    parts = spark.read.schema("part int, n_ids long, ids_start long").parquet(f"{path}/parts")
    # one row per range partition
    out = docs.join(F.broadcast(parts.select("part", "ids_start")), "part")
    return out.select("doc_id", (F.col("ids_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
                      *(["ids"] if with_ids else []))
