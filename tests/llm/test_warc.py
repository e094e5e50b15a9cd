import gzip
import hashlib

import pytest
from pyarrow import fs

from check_oracle import compare, duck
from wardline.llm.common import shared_folder
from wardline.llm.queries import ORACLES, QUERIES
from wardline.llm.warc import ArchiveReader, inflate, make_record, normalise, normalise_archives, read_archives, split_records, write_archives
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def pages(spark):
    big, bigger = "<p>" + "x" * 1000, "é" * 600
    rows = [(1, "http://a/", "short"), (2, "http://a/2", "short"), (3, "http://b/ü \r\nx", big), (4, None, big), (9, "http://c", big), (9, "http://c", big),
            (None, "http://n", big), (12, "u", bigger), (11, "u", bigger), (13, "u", None), (14, "u", ""), (15, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, offset long, digest string")


def test_round_trip(spark, pages):
    folder = shared_folder(spark, "warc-test")
    archives = write_archives(pages, folder, archive_bytes=2500)
    assert len(archives) > 1
    made = normalise_archives(spark, archives)
    got = read_archives(spark, made).drop("offset", "length").collect()
    rows, want = pages.collect(), []
    for r in rows:
        payload = (r.html or "").encode()
        same = [x.page_id for x in rows if (x.html or "").encode() == payload and x.page_id is not None]
        keeper = max(same) if len(payload) >= 1000 else r.page_id
        again = keeper != r.page_id
        want.append((r.page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", keeper if again else None))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    for path in made:  # every record is a member of its own
        reader = ArchiveReader(path)
        raw = fs.FileSystem.from_uri(path)[0].open_input_stream(fs.FileSystem.from_uri(path)[1], compression=None).read()
        assert sum(e["length"] for e in reader.index) == len(raw)
        for e in reader.index:
            member = raw[e["offset"]:e["offset"] + e["length"]]
            assert gzip.decompress(member).startswith(b"WARC/1.1\r\nWARC-Type: " + e["type"].encode())


def test_normalise_any_framing(spark, tmp_path):
    digest = hashlib.sha1(b"page").hexdigest()
    records = [make_record(i, f"http://x/{i}", b"page", digest, None, False) for i in range(5)]
    files = {"one": gzip.compress(b"".join(records)), "two": gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:])),
             "each": b"".join(map(gzip.compress, records)), "split": gzip.compress(b"".join(records)[:300]) + gzip.compress(b"".join(records)[300:])}
    results = set()
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
        assert normalise(str(tmp_path / name), str(tmp_path / f"{name}.out")) == 5
        results.add((tmp_path / f"{name}.out").read_bytes())
        plain = b"".join(inflate(raw[i:i + 7] for i in range(0, len(raw), 7)))
        assert [r for _, _, r in split_records([plain])] == records
    assert len(results) == 1
    for bad in (files["one"][:-20], gzip.compress(b"".join(records)[:-10]), gzip.compress(b"hello\r\n\r\n")):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError):
            normalise(str(tmp_path / "bad"), str(tmp_path / "bad.out"))
        assert not (tmp_path / "bad.out").exists()


def test_empty_table(spark, pages):
    assert write_archives(pages.limit(0)) == []
    assert read_archives(spark, normalise_archives(spark, [])).count() == 0


def test_matches_sql(spark):
    class Q:
        build, sql = QUERIES["op9_warc"], ORACLES["op9_warc"]

    ok, msg = compare(spark, duck(SF_SMALL), "op9_warc", Q, SF_SMALL)
    assert ok, msg
