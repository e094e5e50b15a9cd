import hashlib
import re

import numpy as np
import xxhash

from wardline.llm.common import table
from wardline.llm.fingerprints import fingerprint_documents, within_radius
from tests.conftest import SF_SMALL


def simhash(text):
    total, votes = 0, np.zeros(64, np.int64)
    for w in re.split(r"[\x20\x09-\x0D]+", text.lower()):
        h = xxhash.xxh64_intdigest(w.encode(), seed=42)
        votes += np.array([h >> i & 1 for i in range(64)]) * len(w)
        total += len(w)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ids = [r for r in rows if r[0] is not None]
    out = []
    for k, (d, t) in enumerate(rows):
        nxt = "" if d is None else ids[(k + 1) % len(ids)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + nxt[:cut]
        a, b, c = simhash(t), simhash(edited), simhash(nxt)
        like = lambda x, y: 1 - (x ^ y).bit_count() / 64
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", like(a, b), None if d is None else like(a, c)))
    return sorted(out, key=str)


def test_edges(edge_docs):
    got = fingerprint_documents(edge_docs).drop("fingerprint_bits").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in edge_docs.collect()])


def test_real_documents(spark):
    docs = table(spark, SF_SMALL, "documents")
    got = fingerprint_documents(docs).drop("fingerprint_bits").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_and_single(spark, no_docs, edge_docs):
    assert fingerprint_documents(no_docs).count() == 0
    one = edge_docs.where("doc_id = 11")
    r = fingerprint_documents(one).first()
    assert r.near_next == 1.0 and r.n_chars == len(one.first().text)


def test_block_tables_find_all_within_radius(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 60)
    prints = [int(x) for x in base]
    for x in base:
        for flips in (1, 2, 3, 4):
            y = int(x) & (1 << 64) - 1
            for b in rng.choice(64, flips, replace=False):
                y ^= 1 << int(b)
            prints.append(y - (1 << 64) if y >> 63 else y)
    prints += prints[:20]
    df = spark.createDataFrame([(p,) for p in prints] + [(None,)], "fingerprint long")
    queries = spark.createDataFrame([(p,) for p in prints[:90]], "fingerprint long")
    for radius, blocks in ((3, 6), (3, 4), (1, 2), (0, 1)):
        got = {tuple(r) for r in within_radius(queries, df, radius, blocks).collect()}
        far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
        want = {(q, p, far(q, p)) for q in prints[:90] for p in prints if far(q, p) <= radius}
        assert got == want
