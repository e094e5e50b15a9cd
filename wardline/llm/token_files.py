"""Token-id files: independent zstandard frames with a trailing seek table.

File format (the published seekable zstandard format):

* one frame per document: its ids as little-endian unsigned 32-bit integers;
* a skippable frame (magic ``0x184D2A50``) with one int64 document id per
  frame and one byte per frame telling whether that id is null;
* the seek table: a skippable frame (magic ``0x184D2A5E``) with, per frame,
  compressed size, decompressed size and the low 32 bits of the XXH64 of the
  decompressed data, then the footer (frame count, descriptor ``0x80``, magic
  ``0x8F92EAB1``).

Any zstandard reader can decompress the whole file; ``SeekableReader`` fetches
single documents and checks each frame's checksum.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import tokens
from wardline.llm.common import range_bounds, range_of, ranges, shared_folder, strings, text_batches

# Fixed values of the seekable zstandard format.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_FOOTER = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

END_ID = 0
LEVEL = 3


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path on it; a plain path is a local one."""
    return fs.FileSystem.from_uri(uri)


class SeekableWriter:
    """Appends ready-made frames to a file that appears under its name only
    when it is complete, so an attempt that died leaves nothing to read."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []

    def append(self, doc_id: int | None, frame: bytes, size: int, checksum: int) -> None:
        self.out.write(frame)
        self.entries.append((len(frame), size, checksum))
        self.ids.append(doc_id)

    def close(self) -> None:
        ids = np.array([0 if i is None else i for i in self.ids], "<i8").tobytes()
        ids += np.array([i is None for i in self.ids], "u1").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_IDS, len(ids)) + ids)
        table = np.array(self.entries, "<u4").reshape(-1, 3).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table)
        self.out.write(struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEK_FOOTER))
        self.out.close()
        self.fs.move(self.part, self.path)


class SeekableReader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        count, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_FOOTER or not descriptor & WITH_CHECKSUMS:
            raise ValueError(f"{uri}: no seek table with checksums")
        table_at = size - 9 - 12 * count
        entries = np.frombuffer(self.file.read_at(12 * count, table_at), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.plain, self.checksums = entries.T
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        ids_at = int(self.starts[-1]) + 8
        raw = self.file.read_at(9 * count, ids_at)
        values, null = np.frombuffer(raw[:8 * count], "<i8"), np.frombuffer(raw[8 * count:], "u1")
        self.doc_ids = [None if n else int(v) for v, n in zip(values, null)]
        self.inflate = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, k: int) -> bytes:
        """The ids of the ``k``-th document; reads and inflates its frame alone."""
        frame = self.file.read_at(int(self.sizes[k]), int(self.starts[k]))
        ids = self.inflate.decompress(frame, max_output_size=int(self.plain[k]) or 1)
        if len(ids) != self.plain[k] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.checksums[k]:
            raise ValueError(f"{self.path}: frame {k} is damaged")
        return ids

    def find(self, doc_id: int | None) -> list[int]:
        return [k for k, d in enumerate(self.doc_ids) if d == doc_id]

    def close(self) -> None:
        self.file.close()


def _frames(vocabulary: str, end_id: int, level: int):
    end = struct.pack("<I", end_id)
    schema = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("plain", pa.int64()),
                        ("checksum", pa.int64()), ("frame", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [x + end for x in encode(strings(some.column("text")))]
                yield pa.record_batch([
                    some.column("range"), some.column("doc_id").cast(pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in ids], pa.int64()),
                    pa.array([press.compress(x) for x in ids], pa.binary()),
                ], schema=schema)

    return run


def _write(folder: str):
    schema = pa.schema([("range", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_range, writer, done = None, None, []

        def finish():
            writer.close()
            done.append((open_range, uri(open_range), len(writer.ids), sum(e[1] for e in writer.entries) // 4))

        def uri(r):
            return f"{folder}/tokens-{r:06d}.zst"

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("range", "doc_id", "frame", "plain", "checksum")]
            for r, doc_id, frame, plain, checksum in zip(*columns):
                if r != open_range:
                    if writer:
                        finish()
                    open_range, writer = r, SeekableWriter(uri(r))
                writer.append(doc_id, frame, plain, checksum)
        if writer:
            finish()
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], names=schema.names).cast(schema)

    return run


def write_token_files(docs: DataFrame, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str = tokens.VOCABULARY, end_id: int = END_ID, level: int = LEVEL):
    """Encode whole texts and write them, ascending by id, as seekable files.

    Returns the manifest, one ``(range, path, docs, ids, start)`` per file with
    ``start`` the ids in all files before; its length is bounded by the number
    of ranges (``common.ranges``), so it is a driver list.

    A null text is empty (only the end id); null document ids come last; rows
    that repeat an id stay side by side, ordered by checksum and length; an
    empty table writes no file.  Texts are compressed to frames before the one
    shuffle, so that moves the final bytes; ranges come from quantiles of the
    ids, so no range depends on how many rows share a source or a text."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    target, path = file_system(folder)
    target.create_dir(path, recursive=True)
    rows = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = ranges(spark)
    bounds = range_bounds(rows, "doc_id", n)
    framed = rows.withColumn("range", range_of(F.col("doc_id"), bounds)).mapInArrow(
        _frames(vocabulary, end_id, level), "range int, doc_id long, plain long, checksum long, frame binary")
    ordered = framed.repartition(n, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_last(), "checksum", "plain")
    manifest = sorted(tuple(r) for r in ordered.mapInArrow(_write(folder), "range int, path string, docs long, ids long").collect())
    out, start = [], 0
    for r, path, n_docs, n_ids in manifest:
        out.append((r, path, n_docs, n_ids, start))
        start += n_ids
    return out


def _read():
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                reader = SeekableReader(path)
                counts = reader.plain // 4
                starts = start + np.concatenate(([0], np.cumsum(counts)[:-1]))
                crc = [zlib.crc32(reader.document(k)) for k in range(len(reader))]
                reader.close()
                yield pa.record_batch([pa.array(reader.doc_ids, pa.int64()), pa.array(starts[:len(crc)], pa.int64()),
                                       pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return run


def read_token_files(spark, manifest) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``."""
    files = spark.createDataFrame([(r, p, s) for r, p, _, _, s in manifest], "range int, path string, start long")
    return files.repartition(max(1, len(manifest)), "range").mapInArrow(
        _read(), "doc_id long, start long, n_tokens long, ids_crc32 long")
