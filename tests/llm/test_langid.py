import itertools
import zlib

import numpy as np
import pytest

from wardline.llm import langid
from wardline.llm.common import table
from wardline.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    field = langid.WordField(["a", "b", "c"], moves=rng.normal(size=(3, 3)))
    lengths = np.array([3, 1, 4, 2])
    scores = rng.normal(size=(lengths.sum(), 3))
    got, expected = field.marginals(scores, lengths)
    at, moves = 0, np.zeros((3, 3))
    for n in lengths:
        want, z, own = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[at + i, k] for i, k in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:])))
            z += p
            for i, k in enumerate(path):
                want[i, k] += p
            for a, b in zip(path, path[1:]):
                own[a, b] += p
        assert np.allclose(got[at:at + n], want / z, atol=1e-5)
        moves += own / z
        at += n
    assert np.allclose(expected, moves, atol=1e-4)


@pytest.fixture(scope="module")
def field(spark):
    return langid.learn(table(spark, SF_SMALL.replace("0.001", "0.01"), "documents"))


def test_held_out_accuracy(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    got = {r.doc_id: r for r in QUERIES["op2_language"](spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert len(got) == len(docs) and {d.doc_id for d in held} == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_switched_text_is_labelled_by_word(spark, field):
    docs = {r.lang: langid.words_of(r.text) for r in table(spark, SF_SMALL, "documents").orderBy("doc_id").collect() if len(r.text) > 800}
    runs = [("en", 12), ("de", 12), ("fr", 12)]
    words = [w for lang, n in runs for w in docs[lang][20:20 + n]]
    rows = langid.label_words(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), field).orderBy("position").collect()
    want = [lang for lang, n in runs for _ in range(n)]
    assert [r.word for r in rows] == words
    assert np.mean([r.lang == k for r, k in zip(rows, want)]) > 0.85


def test_edges(spark, edge_docs, no_docs, field):
    got = langid.predict(edge_docs, field)
    assert got.columns == [*edge_docs.columns, "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        if any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred in field.labels and 0 < r.score <= 1
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    odd = spark.createDataFrame([("½ ² 12",), ("ª",), ("_",)], "text string")
    assert [r.lang_pred == "und" for r in langid.predict(odd, field).collect()] == [True, False, True]
    assert langid.predict(no_docs, field).count() == 0
    nothing = langid.learn(no_docs)
    assert {r.lang_pred for r in langid.predict(edge_docs, nothing).collect()} == {"und"}


def test_only_text_decides(spark, field):
    df = table(spark, SF_SMALL, "documents").limit(50)
    from pyspark.sql import functions as F

    changed = df.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": -F.col("doc_id")})
    assert [r.lang_pred for r in langid.predict(df, field).collect()] == [r.lang_pred for r in langid.predict(changed, field).collect()]
