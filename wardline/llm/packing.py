"""Sum-of-squares packing of token sequences into fixed-size sequences."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import tokens
from wardline.llm.common import stored, strings, text_batches

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs together.
SHARD_PIECES = 8192
_FULL = 1 << 61


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item (``1 <= size <= capacity``).

    With ``N(g)`` open bins of residual gap ``g``, an item goes into the open
    bin for which the sum of ``N(g)`` squared gets smallest (equal sums: the
    smallest gap).  A new bin is opened only if no open one has room, and items
    are taken from long to short (stable): both waste less than the rule's
    online form, 0.7 % over the volume bound against 3.9 % on the test texts."""
    n = len(sizes)
    bin_of, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)  # count[0] stays 0: full bins are closed
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        here, left = count[s:capacity], count[:capacity - s]
        change = np.where(here > 0, 1 - 2 * here, np.iinfo(np.int64).max)
        change[1:] = np.where(here[1:] > 0, change[1:] + 1 + 2 * left[1:], change[1:])
        k = int(change.argmin()) if s < capacity else 0
        if s < capacity and here[k] > 0:
            gap = s + k
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, bins
            bins += 1
        bin_of[i], offset[i] = b, capacity - gap
        if gap - s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bin_of, offset


def _pieces(vocabulary: str, end_id: int, capacity: int):
    end = struct.pack("<I", end_id)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = []
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encode(strings(some.column("text")))):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]))
                             for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID, vocabulary: str = tokens.VOCABULARY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.

    Texts are tokenized once, and the small piece table is stored.  A document
    over ``capacity`` is cut so that only its first piece may be shorter; full
    pieces are sequences of their own and need no packing.  The others are
    dealt at random (by row number, so equal ids or texts do not meet) to
    shards of about ``shard_pieces``, and every shard is packed by
    ``sum_of_squares``; at most a few bins per shard stay part-filled.

    A null text is empty (just the end id); null ids and repeated rows are
    packed like any other; an empty table gives no rows."""
    rows = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = stored(rows.mapInArrow(_pieces(vocabulary, end_id, capacity), schema), "pieces")
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())
    part = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard_pieces))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        group["sequence_id"] = group["shard"].astype("int64") * (1 << 32) + bins
        group["offset"] = offsets
        return group[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = (part.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(17)), F.lit(shards)).cast("int"))
              .groupBy("shard").applyInPandas(pack, out))
    full = pieces.where(F.col("length") >= capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.lit(_FULL) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)
