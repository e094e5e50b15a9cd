import numpy as np

from check_oracle import compare, duck
from wardline.llm.queries import ORACLES, QUERIES
from wardline.llm.topk import nra, top_k
from tests.conftest import SF_SMALL


def test_nra_equals_full_ranking():
    rng = np.random.default_rng(2)
    for n, d, scale in ((300, 8, 50), (40, 3, 2), (3, 4, 9), (200, 5, 1 << 20)):
        x, ids = rng.integers(-scale, scale + 1, (n, d)), rng.permutation(n) * 7
        q, query_ids = np.concatenate([x[:10], rng.integers(-scale, scale + 1, (3, d)), np.zeros((1, d), np.int64)]), np.concatenate([ids[:10], [-1, -2, -3, -4]])
        for depths in ((1 / 8, 1 / 2, 1.0), (0.05, 0.1, 0.2, 0.4, 0.8, 1.0), (1.0,)):
            for k in (1, 5):
                for j, got in enumerate(nra(x, ids, q, query_ids[:len(q)], k, depths)):
                    score = x @ q[j]
                    rows = [i for i in np.lexsort((ids, -score)) if ids[i] != query_ids[j]][:k]
                    assert [(ids[i], score[i]) for i in got] == [(ids[i], score[i]) for i in rows]


def test_nra_stops_early_on_peaked_lists():
    n = 4000
    x = np.zeros((n, 2), np.int64)
    x[:, 0] = np.arange(n)
    x[:, 1] = np.arange(n)
    (got,) = nra(x, np.arange(n), np.array([[1, 1]]), np.array([-1]), 5, (0.01,))
    assert list(got) == [3999, 3998, 3997, 3996, 3995]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.5, -0.25]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.0]),
            (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (150, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (200, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, score long")
    ok = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for qi, q in ok:
        if qi % 50 == 0:
            found = sorted([(-int(q @ v), i) for i, v in ok if i != qi and len(v) == len(q)])[:5]
            want += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    for sizes in ({}, {"block_vectors": 2, "block_queries": 1}):
        assert sorted(tuple(r) for r in top_k(df, **sizes).collect()) == sorted(want)
    assert top_k(df.limit(0)).count() == 0


def test_matches_sql(spark):
    class Q:
        build, sql = QUERIES["op5_topk"], ORACLES["op5_topk"]

    ok, msg = compare(spark, duck(SF_SMALL), "op5_topk", Q, SF_SMALL)
    assert ok, msg
