import struct
import zlib
from functools import cache

import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardline.llm import tokens
from wardline.llm.common import table
from wardline.llm.packing import pack_documents, sum_of_squares
from wardline.llm.token_files import SeekableReader, read_token_files, write_token_files
from tests.conftest import SF_SMALL


@cache
def plain():
    t = Tokenizer.from_file(tokens.public_tokenizers.path(tokens.VOCABULARY))
    t.encode_special_tokens = True
    return t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" ab'sé1.\n\t 　🙂", max_size=24), max_size=6))
def test_pieces_equal_whole_text_encoding(texts):
    want = [np.asarray(e.ids, "<u4").tobytes() for e in plain().encode_batch(texts, add_special_tokens=False)]
    small = few_kept()
    assert small.encode(texts) == want and len(small.known) <= small.kept


@cache
def few_kept():
    return tokens.PieceEncoder(tokens.public_tokenizers.path(tokens.VOCABULARY), kept=5)


def expected(rows, end):
    encode = plain().encode
    return [(d, np.asarray([*encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes()) for d, t in rows]


def test_files_round_trip(spark, edge_docs):
    rows = sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    got = read_token_files(spark, write_token_files(edge_docs)).orderBy("start").collect()
    want, start = [], 0
    for d, ids in expected(rows, 0):
        want.append((d, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert [r.doc_id for r in got] == [d for d, _ in rows]


def test_real_documents(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = read_token_files(spark, write_token_files(docs)).orderBy("doc_id").collect()
    start = 0
    for (d, ids), r in zip(expected(rows, 0), got):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_format_and_single_document_reads(spark, edge_docs):
    manifest = write_token_files(edge_docs)
    _, path, n, _, _ = manifest[0]
    reader = SeekableReader(path)
    raw = reader.file.read_at(reader.file.size(), 0)
    assert raw[-4:] == struct.pack("<I", 0x8F92EAB1) and len(reader) == n
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole == b"".join(reader.document(k) for k in range(n))
    assert [xxhash.xxh64_intdigest(reader.document(k)) & 0xFFFFFFFF for k in range(n)] == list(reader.checksums)
    damaged = bytearray(raw)
    damaged[-9 - 12 * n + 8] ^= 1  # the first frame's checksum
    bad = path.removeprefix("file://") + "-damaged"
    with open(bad, "wb") as out:
        out.write(damaged)
    with pytest.raises(ValueError):
        SeekableReader(bad).document(0)


def test_empty_table(spark, no_docs):
    assert write_token_files(no_docs) == []
    assert read_token_files(spark, []).count() == 0
    assert pack_documents(no_docs).count() == 0


def check_packing(docs_rows, packed, capacity):
    by_seq, by_doc = {}, {}
    for r in packed:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id,), []).append(r)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for d, ids in expected(docs_rows, 2):
        n = len(ids) // 4
        first = n % capacity or min(n, capacity) if n > capacity else n
        cuts = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
        want += [(d, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed]
    assert sorted(got, key=str) == sorted(want, key=str)
    return len(by_seq), sum(r.length for r in packed)


def test_packing_edges(edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    check_packing(rows, pack_documents(edge_docs, capacity=64, shard_pieces=4).collect(), 64)


def test_packing_real_documents_is_tight(spark):
    docs = table(spark, SF_SMALL.replace("0.001", "0.01"), "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    used, total = check_packing(rows, pack_documents(docs).collect(), 1024)
    assert used <= 1.01 * -(-total // 1024) + 2


def brute_sum_of_squares(sizes, capacity):
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    gaps, where = [], {}
    for i in order:
        best = None
        squares = lambda g: sum(c * c for c in np.unique([x for x in g if x], return_counts=True)[1])
        seen = {}
        for b, g in enumerate(gaps):
            if g >= sizes[i]:
                seen.setdefault(g, b)
        for g in sorted(seen):
            after = list(gaps)
            after[seen[g]] -= sizes[i]
            if best is None or squares(after) < best[0]:
                best = (squares(after), seen[g])
        if best is None:
            gaps.append(capacity)
            best = (0, len(gaps) - 1)
        gaps[best[1]] -= sizes[i]
    return sorted(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_sum_of_squares_rule(sizes):
    bins, offsets = sum_of_squares(np.array(sizes, np.int64), 12)
    load = np.bincount(bins, weights=sizes, minlength=0) if sizes else np.zeros(0)
    assert sorted(12 - load) == brute_sum_of_squares(sizes, 12)
    for b in set(bins.tolist()):
        inside = sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == b)
        assert [o for o, _ in inside] == list(np.cumsum([0, *[s for _, s in inside]])[:-1])
