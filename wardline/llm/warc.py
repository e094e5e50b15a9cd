"""Web archives: writing WARC files, normalising whole-file gzip streams to one
member per record with a sidecar offset index, and reading records back."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import shared_folder
from wardline.llm.token_files import file_system

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for a gzip wrapper

#: The pages carry no capture time; archives of equal pages are to be equal.
DATE = "1970-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 1000
LEVEL = 4
CHUNK = 1 << 20
#: A new archive is begun after so many bytes of records.
ARCHIVE_BYTES = 64 << 20
SALTS = 32


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    text = record_id.strip("<>").rpartition(":")[2]
    return None if text == "none" else int(text)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record.  A revisit keeps the HTTP head, which tells the
    payload's length, and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%-._~")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", block, b"", b""])


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Plain bytes of a gzip stream of any number of members, read once."""
    member = None
    for chunk in chunks:
        while chunk:
            member = member or zlib.decompressobj(GZIP)
            yield member.decompress(chunk)
            chunk = member.unused_data if member.eof else b""
            member = None if member.eof else member
    if member is not None:
        raise ValueError("the gzip stream ends early")


def split_records(plain: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, block, the record's raw bytes) one after the other;
    holds one record at a time."""
    plain, buffer, done = iter(plain), bytearray(), False

    def more() -> None:
        nonlocal done
        piece = next(plain, None)
        done = piece is None
        buffer.extend(piece or b"")

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0 and not done:
            more()
        if end < 0:
            if buffer.strip():
                raise ValueError("a record's header is cut off")
            return
        head = bytes(buffer[:end]).decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {head[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        size = end + 4 + int(fields["content-length"])
        while len(buffer) < size + 4 and not done:
            more()
        if buffer[size:size + 4] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        raw = bytes(buffer[:size + 4])
        del buffer[:size + 4]
        yield fields, raw[end + 4:size], raw


def _chunks(file) -> Iterator[bytes]:
    while chunk := file.read(CHUNK):
        yield chunk


def _deflate(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return z.compress(raw) + z.flush()


def normalise(source: str, target: str, level: int = LEVEL) -> int:
    """Rewrite an archive that is one gzip stream (or any number of members)
    so that each record is a member of its own, and write ``target + ".idx"``:
    one JSON line per record with its offset and length.  Streams; the files
    appear under their names only when complete.  Returns the record count."""
    fs, path = file_system(source)
    out_fs, out_path = file_system(target)
    mark = uuid.uuid4().hex
    count = offset = 0
    with fs.open_input_stream(path, compression=None) as raw, \
            out_fs.open_output_stream(f"{out_path}.{mark}.part", compression=None) as out, \
            out_fs.open_output_stream(f"{out_path}.idx.{mark}.part", compression=None) as index:
        for fields, _, record in split_records(inflate(_chunks(raw))):
            member = _deflate(record, level)
            out.write(member)
            line = {"id": fields["warc-record-id"], "type": fields["warc-type"], "uri": fields.get("warc-target-uri"),
                    "digest": fields.get("warc-payload-digest"), "offset": offset, "length": len(member)}
            index.write(json.dumps(line).encode() + b"\n")
            offset += len(member)
            count += 1
    out_fs.move(f"{out_path}.{mark}.part", out_path)
    out_fs.move(f"{out_path}.idx.{mark}.part", f"{out_path}.idx")
    return count


class ArchiveReader:
    """Single records of a normalised archive, by its sidecar index."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        with fs.open_input_stream(f"{path}.idx", compression=None) as f:
            self.index = [json.loads(line) for line in f.read().splitlines()]
        self.file = fs.open_input_file(path)

    def record(self, entry: dict) -> tuple[dict[str, str], bytes]:
        raw = self.file.read_at(entry["length"], entry["offset"])
        (fields, block, _), = split_records(inflate([raw]))
        return fields, block

    def close(self) -> None:
        self.file.close()


def _write(folder: str, level: int, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, out = TaskContext.get().partitionId(), [], None

        def finish():
            stream.write(out.flush())
            stream.close()
            fs.move(temporary, path)
            made.append(uri)

        written = 0
        for batch in batches:
            for page_id, url, html, digest, keeper in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "keeper"))):
                if out is None:
                    uri = f"{folder}/pages-{part:05d}-{len(made):04d}.warc.gz"
                    fs, path = file_system(uri)
                    temporary = f"{path}.{uuid.uuid4().hex}.part"
                    stream, out, written = fs.open_output_stream(temporary, compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
                record = make_record(page_id, url, html.encode(), digest, keeper, keeper is not None)
                stream.write(out.compress(record))
                written += len(record)
                if written >= archive_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield pa.record_batch([pa.array(made, pa.string())], names=["path"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES, level: int = LEVEL,
                   archive_bytes: int = ARCHIVE_BYTES) -> list[str]:
    """Write one record per page into archives that are one gzip stream each;
    returns their paths (a driver list bounded by tasks and total size /
    ``archive_bytes``).

    Of records with equal payloads of at least ``min_revisit_bytes``, the one
    with the largest page id is a response and the others revisit it.  A null
    html is an empty payload, a null url leaves the field out.  Rows that
    repeat the largest id with an equal payload are responses all.  Rows
    without an id revisit an equal page that has one, else they are responses.

    Who revisits whom is settled on digests alone: pre-aggregated per digest,
    then joined back only for digests with copies, over ``SALTS`` salts, so one
    payload may hold any share of the rows.  Payloads are shuffled once, by id."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    light = rows.where(F.octet_length("html") >= min_revisit_bytes).select("page_id", "digest")
    shared = (light.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
              .where("n > 1 and keeper is not null").select("digest", "keeper")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    revisits = (light.withColumn("salt", salt).join(shared, ["digest", "salt"])
                .where(~F.col("page_id").eqNullSafe(F.col("keeper")))
                .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "keeper").distinct())
    decided = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    made = decided.select("page_id", "url", "html", "digest", "keeper").mapInArrow(_write(folder, level, archive_bytes), "path string")
    return sorted(r.path for r in made.collect())


def _normalise(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                target = path.removesuffix(".warc.gz") + "-records.warc.gz"
                n = normalise(path, target, level)
                yield pa.record_batch([pa.array([target]), pa.array([n], pa.int64())], names=["path", "records"])

    return run


def normalise_archives(spark, paths: list[str], level: int = LEVEL) -> list[str]:
    """Normalise every archive, one per task; returns the new paths."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return sorted(r.path for r in files.mapInArrow(_normalise(level), "path string, records long").collect())


def _read():
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset", "length"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                reader = ArchiveReader(path)
                rows = []
                for entry in reader.index:
                    fields, block = reader.record(entry)
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.lower().rpartition(b"content-length:")[2])
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind, other = fields["warc-type"], fields.get("warc-refers-to")
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: {fields['warc-record-id']} does not have the payload it names")
                    rows.append((_page_of(fields["warc-record-id"]), size, digest, kind, other and _page_of(other), entry["offset"], entry["length"]))
                reader.close()
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def read_archives(spark, paths: list[str]) -> DataFrame:
    """Per record of normalised archives: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, offset, length``; a response's
    payload is checked against its digest."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInArrow(_read(), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long")
