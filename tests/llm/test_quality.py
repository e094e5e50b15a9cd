import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF_SMALL
from wardline.llm import quality
from wardline.llm.common import table
from wardline.llm.queries import QUERIES

SF = SF_SMALL.replace("0.001", "0.01")


def raw(t):
    return np.frombuffer(t if isinstance(t, bytes) else t.encode(), np.uint8)


def plain_score(net, text):
    """One text, byte by byte and window by window."""
    data = [0] * quality.WIDTH + raw(text).tolist()
    data += [0] * (quality.n_blocks(len(raw(text))) * quality.BLOCK + quality.WIDTH - len(data))
    code = []
    for i, b in enumerate(data):
        seen = any(i - lag >= 3 and data[i - 3:i + 1] == data[i - 3 - lag:i + 1 - lag] for lag in range(1, quality.LAGS + 1))
        code.append(b + 256 * (seen and b != 0))
    respond = [np.maximum(sum((net.w["embed"][code[i + k]] @ net.w["filters"].reshape(quality.WIDTH, quality.EMBED, -1)[k] for k in range(quality.WIDTH)), net.w["bias"]), 0)
               for i in range(0, len(data) - quality.WIDTH, quality.STRIDE)]
    per = quality.BLOCK // quality.STRIDE
    blocks = [np.max(respond[i:i + per], axis=0) for i in range(0, len(respond), per)]
    chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:])] or blocks
    hidden = np.tanh(np.mean(chunks, axis=0) @ net.w["hidden"] + net.w["hidden_bias"])
    return 1 / (1 + np.exp(-(hidden @ net.w["out"] + net.w["out_bias"][0])))


def test_scores_equal_the_plain_network(monkeypatch):
    rng = np.random.default_rng(1)
    net = quality.Network(seed=3)
    texts = ["", "x", "ab ab ab ab", "Ünï " * 90, "q" * 700, *("".join(map(chr, rng.integers(32, 127, n))) for n in (200, 212, 213, 256, 1300))]
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(net.scores([raw(t) for t in texts]), want, atol=2e-6)
    monkeypatch.setattr(quality, "PIECE_BYTES", 512)  # long texts in pieces
    assert np.allclose(net.scores([raw(t) for t in texts]), want, atol=2e-6)


def test_gradients():
    rng = np.random.default_rng(2)
    net = quality.Network(seed=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    code = rng.integers(0, 512, (5, 2 * quality.BLOCK + quality.WIDTH))
    of, y, weight = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.3, 1.0])
    _, g = net.step(code, of, y, weight)
    for name, v in net.w.items():
        at = np.unravel_index(int(np.abs(g[name]).argmax()), v.shape)
        v[at] += 3e-4
        high = net.step(code, of, y, weight)[0]
        v[at] -= 6e-4
        low = net.step(code, of, y, weight)[0]
        v[at] += 3e-4
        assert np.isclose((high - low) / 6e-4, g[name][at], rtol=2e-2, atol=1e-6)


@pytest.fixture(scope="module")
def net(spark):
    return quality.learn(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op11_quality"](spark, SF).collect()}
    assert len(got) == table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [r for r in table(spark, SF, "labels").collect() if got[r.doc_id].held_out]
    right = {k: np.mean([got[r.doc_id].predicted == k for r in held if r.quality == k]) for k in (0, 1)}
    assert min(right.values()) > 0.85 and np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.96


def test_only_text_decides(spark, net, edge_docs, no_docs):
    rows = quality.score(edge_docs, net).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    clash = edge_docs.selectExpr("*", "doc_id AS score", "'x' AS predicted")
    assert [r.score for r in quality.score(clash, net).collect()] == [r.score for r in rows]
    assert quality.score(no_docs, net).count() == 0
    # without usable labels every text is undecided
    odd = spark.createDataFrame([(5, None, 1), (None, 1, 1), (9, 7, 1)], "doc_id long, quality int, text int")
    for labels in (odd, odd.limit(0)):
        assert {(r.score, r.predicted) for r in quality.score(edge_docs, quality.learn(edge_docs, labels)).collect()} == {(0.5, 1)}
    one = spark.createDataFrame([(i, 0) for i in (3, 5, 7, 9, 11, 12, 20, 20)], "doc_id long, quality int")
    assert {r.predicted for r in quality.score(edge_docs, quality.learn(edge_docs, one)).collect()} == {0}


def test_drawn_chunks_are_the_texts_chunks():
    text = raw("".join(map(chr, np.random.default_rng(3).integers(97, 100, 4000))))
    code, first = quality.laid_out([text])
    batch = pa.record_batch([pa.array([77], pa.int64()), pa.array([1], pa.int32()), pa.array([text.tobytes().decode()])], names=["draw", "quality", "text"])
    (out,) = quality._drawn_chunks(4)(iter([batch]))
    got = np.frombuffer(out.column("chunks")[0].as_py(), np.uint16).reshape(4, -1)
    every = [quality.chunk(code, k) for k in range(int(first[1]) - 1)]
    assert all(any((g == e).all() for e in every) for g in got)
