import re
from collections import defaultdict

import pytest

from check_oracle import compare, duck
from wardline.llm.common import table
from wardline.llm.mixing import mix, repeat_documents
from wardline.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water_fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if level * weight[s] > cap * sizes[s]}
        for s in capped or free:
            target[s] = cap * sizes[s] if capped else level * weight[s]
            left -= target[s]
        free = free - capped if capped else set()
    return target


def check(docs):
    rows = [(r.doc_id, r.source, words(r.text)) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    target, taken = water_fill(dict(sizes)), defaultdict(int)
    got = mix(docs).collect()
    assert sorted([(r.doc_id, r.source, r.size) for r in got], key=str) == sorted(rows, key=str)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, abs=1.01)
    return got


def test_edges(edge_docs):
    assert sorted(check(edge_docs), key=str) == sorted(check(edge_docs.repartition(3)), key=str)


def test_real_documents_and_copies(spark):
    docs = table(spark, SF_SMALL, "documents")
    got = {r.doc_id: r for r in check(docs)}
    copies = defaultdict(list)
    for r in repeat_documents(docs, mix(docs)).collect():
        copies[r.doc_id].append(r.text)
    for r in docs.collect():
        m = got[r.doc_id]
        assert sum(words(t) for t in copies[r.doc_id]) == m.taken
        assert all(r.text.startswith(t) for t in copies[r.doc_id])


def test_empty_and_wordless(spark, no_docs, edge_docs):
    assert mix(no_docs).count() == 0
    blank = edge_docs.where("trim(text) = '' or text is null")
    assert {r.taken for r in mix(blank).collect()} == {0}


def test_matches_sql(spark):
    class Q:
        build, sql = QUERIES["op8_mixing"], ORACLES["op8_mixing"]

    ok, msg = compare(spark, duck(SF_SMALL), "op8_mixing", Q, SF_SMALL)
    assert ok, msg
