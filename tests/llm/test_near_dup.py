import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from check_oracle import compare, duck
from wardline.llm.components import components
from wardline.llm.near_dup import circulant_signatures, n_bands, near_duplicates
from wardline.llm.queries import ORACLES, QUERIES
from wardline.llm.shingles import shingle_sets
from tests.conftest import SF_SMALL


def plain_set(text, size=5):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) >= size:
        return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
    return {tuple(words)} if words else set()


def brute(rows, percent):
    """Per row its set size and the smallest id of its component."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if group[m] == group[k] and rows[m][0] is not None]
        c = d if not sets[k] else min(ids, default=None)
        out.append((d, len(sets[k]), c, d == c))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\n.", max_size=40), max_size=8))
def test_shingles_equal_plain_sets(texts):
    hashed = list(shingle_sets(pa.array(texts, pa.string())))
    plain = [plain_set(t) for t in texts]
    assert [len(h) for h in hashed] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(hashed[i], hashed[j])) == len(plain[i] & plain[j])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        n = 2000
        k = int(2 * n * share / (1 + share))
        common, a, b = (rng.integers(0, 1 << 63, m).astype(np.uint64) for m in (k, n - k, n - k))
        s = circulant_signatures([np.concatenate([common, a]), np.concatenate([common, b])], 512)
        assert abs((s[0] == s[1]).mean() - k / (2 * n - k)) < 0.07
    assert (1 - 0.85 ** 4) ** n_bands(85) <= 1e-8 < (1 - 0.85 ** 4) ** (n_bands(85) - 1)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(None, 3), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if a is not None:
            label.setdefault(a, a)
            label.setdefault(b, b)
    for _ in label:
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    alone = {v for v in label if all(v not in e or e[0] == e[1] for e in edges)}
    assert {k: v for k, v in got.items() if k not in alone} == {k: v for k, v in label.items() if k not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = near_duplicates(edge_docs, percent=85).collect()
    want = brute(rows, 85)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted((w[:3] for w in want), key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_chains_copies_and_borderline_groups(spark, percent):
    """Chains whose ends are far apart, a group around one text that are not
    all links of each other, many exact copies, and unrelated texts."""
    rng = np.random.default_rng(percent)
    word = lambda: f"w{rng.integers(1_000_000)}"
    rows, base = [], [word() for _ in range(120)]
    now = list(base)
    for _ in range(12):  # a chain: each step changes a little
        now[rng.integers(len(now))] = word()
        rows.append(" ".join(now))
    other = [word() for _ in range(150)]
    for _ in range(40):  # a star: copies of one text with two changes each
        copy = list(other)
        for _ in range(2):
            copy[rng.integers(len(copy))] = word()
        rows.append(" ".join(copy))
    rows += [" ".join(other).upper()] * 25 + [" ".join(word() for _ in range(80)) for _ in range(20)] + ["one two", "one  two", "one", "", None]
    order = rng.permutation(len(rows))
    docs = [(int(100 + 3 * i), rows[k]) for i, k in enumerate(order)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, percent)


def test_group_with_edits_from_a_small_vocabulary(spark):
    """Copies of one text with one to fourteen of few possible edits: many are
    near the threshold, and edits meet by chance."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(140)]
    docs = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.integers(1, 15)):
            copy[rng.integers(len(copy))] = f"edit{rng.integers(3)}"
        docs.append((int(i * 2 + 1), " ".join(copy)))
    want = brute(docs, 85)
    assert 5 < len({w[2] for w in want}) < 85
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_matches_sql(spark):
    class Q:
        build, sql = QUERIES["op7_near_duplicates"], ORACLES["op7_near_duplicates"]

    ok, msg = compare(spark, duck(SF_SMALL), "op7_near_duplicates", Q, SF_SMALL)
    assert ok, msg
