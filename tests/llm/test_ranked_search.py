import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from check_oracle import compare, duck
from tests.conftest import SF_SMALL
from wardline.llm.queries import ORACLES, QUERIES
from wardline.llm.ranked_search import Lookup, Shared, document_terms, rank_documents, terms_of

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in _TERM.findall(text or "")]


def brute(docs, items, top=20):
    terms = [(i, Counter(plain_terms(t))) for i, t in docs]
    full = [(i, c) for i, c in terms if c]
    total, df = sum(c.total() for _, c in full), Counter(t for _, c in full for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in full:
            m, s = 100 - 25 + (25 * c.total() * len(full)) // total, 0
            for t in plain_terms(text):
                if t in c:
                    s += math.floor(1000 * math.log((2 * len(full) + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return out


def test_shared_nodes_hold_the_queries_terms():
    rng = random.Random(2)
    words = [b"w%d" % i for i in range(40)]
    base = rng.sample(words, 12)
    queries = [rng.sample(base, 8) + rng.choices(words, k=rng.randint(0, 9)) for _ in range(60)] + [[], [b"only"], [b"a"] * 5]
    plan = Shared(queries)

    def expand(node):
        return [plan.terms[node]] if node < len(plan.terms) else [t for part in plan.pairs[node - len(plan.terms)] for t in expand(part)]

    for q, nodes in zip(queries, plan.queries):
        assert sorted(t for n in nodes for t in expand(n)) == sorted(q)
    # additions: fewer than one by one
    assert len(plan.pairs) + sum(len(q) for q in plan.queries) < 0.7 * sum(map(len, queries))
    values = np.random.default_rng(1).integers(0, 9, (len(plan.terms), 5))
    want = np.array([sum((values[plan.terms.index(t)] for t in q), np.zeros(5, int)) for q in queries if q])
    assert (plan.scores(values) == want).all()


def test_terms_of_texts():
    texts = ["Ünï-code ÉTÉ 12a_b", None, "", "a" * 300 + " b", "x", "y\x00z{|}~\x7f", "日本 語x", "b", "b", "A b"]
    assert [[t.decode() for t in terms_of(x)] for x in texts] == [plain_terms(x) for x in texts]
    asked = sorted({t for x in texts for t in terms_of(x)} - {b"y"}) + [b"missing"]
    rows = []
    for counts, row, term, times in document_terms(pa.array(texts), Lookup(asked)):
        assert counts.tolist() == [len(plain_terms(x)) for x in texts]
        rows += [(r, asked[t].decode(), n) for r, t, n in zip(row.tolist(), term.tolist(), times.tolist())]
    assert sorted(rows) == sorted((i, t, n) for i, x in enumerate(texts) for t, n in Counter(plain_terms(x)).items() if t != "y")


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["été", "Zoë"]
    docs = [(rng.choice([i, i, 7, None]), " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 400])))) for i in range(300)]
    items = [(i // 2, " ".join(rng.choices(words, k=rng.choice([0, 3, 12])))) for i in range(24)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    for block in (4096, 5):
        got = [tuple(r) for r in rank_documents(d, q, query_block=block).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute(docs, items)))


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "the tale of wörd5 the text", 3, "x"), (1, None, 1, "y"), (2, "!!", 1, "z"), (None, "Ünïcode", 1, None), (3, "unheard0", 1, "")],
                                  "item_id long, text string, rank int, doc_id string")
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    want = brute(docs, [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(str, map(tuple, rank_documents(edge_docs, items).collect()))) == sorted(map(str, want))
    assert rank_documents(no_docs, items).count() == 0
    assert rank_documents(edge_docs, items.limit(0)).count() == 0


def test_matches_sql(spark):
    class Q:
        build, sql = QUERIES["op13_ranked_search"], ORACLES["op13_ranked_search"]

    ok, msg = compare(spark, duck(SF_SMALL), "op13_ranked_search", Q, SF_SMALL)
    assert ok, msg
