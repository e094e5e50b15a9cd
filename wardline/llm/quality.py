"""Text quality by a byte-level convolutional network in numpy.

Every byte, with a flag that says whether the four bytes ending at it also end
a few bytes earlier, is embedded; learned filters run over the whole text;
their responses are max-pooled in overlapping chunks, the chunks averaged and
combined by a small layer into one probability.  Short and long texts go
through the same chunks, so nothing depends on where a text ends."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import kept_in_worker, text_batches
from wardline.llm.langid import remainder
from wardline.llm.shingles import text_bytes

#: A chunk is two neighbouring blocks; chunks overlap by one block.
BLOCK = 256
WIDTH, STRIDE, FILTERS, EMBED, HIDDEN = 12, 2, 32, 8, 16
#: How many bytes back a repeated four-byte run is looked for.
LAGS = 40
#: Zeros around each text, ``WIDTH`` of them in front: no filter reaches ahead
#: into the next text and no look back the one before.
PAD = LAGS + 4
_POSITIONS = BLOCK // STRIDE

#: The fit's bound: labelled texts per class, and chunks drawn of each.
FIT_DOCUMENTS = 1000
FIT_CHUNKS = 4
EPOCHS = 8
BATCH = 64
RATE = 4e-3
SEED = 5
#: Bytes worked on at once; longer texts go piece by piece.
PIECE_BYTES = 1 << 19


def codes(data: np.ndarray) -> np.ndarray:
    """Bytes, plus 256 where a four-byte run is repeated within ``LAGS``."""
    seen = np.zeros(len(data), bool)
    if len(data) > 4:
        wide = data.astype(np.uint32)
        run = wide[3:] | wide[2:-1] << 8 | wide[1:-2] << 16 | wide[:-3] << 24
        for lag in range(1, min(LAGS, len(run) - 1) + 1):
            seen[3 + lag:] |= run[lag:] == run[:-lag]
        seen &= data != 0
    return data.astype(np.int32) + 256 * seen


def n_blocks(size: int) -> int:
    return -(-(size + PAD) // BLOCK)


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of texts, each in blocks of its own with zeros around, and the
    first block of each; ``WIDTH`` more zeros at the end."""
    first = np.concatenate(([0], np.cumsum([n_blocks(len(t)) for t in texts]))).astype(np.int64)
    data = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    for t, at in zip(texts, first.tolist()):
        data[at * BLOCK + WIDTH:at * BLOCK + WIDTH + len(t)] = t
    return codes(data), first


class Network:
    """Weights by name; ``forward`` for scoring, ``step`` for learning."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = weights or {
            "embed": rng.normal(0, 0.3, (512, EMBED)), "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)), "bias": np.zeros(FILTERS),
            "hidden": rng.normal(0, FILTERS ** -0.5, (FILTERS, HIDDEN)), "hidden_bias": np.zeros(HIDDEN), "out": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "out_bias": np.zeros(1)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def patches(self, code: np.ndarray) -> np.ndarray:
        """Embedded windows at every ``STRIDE``-th byte."""
        x = np.ascontiguousarray(self.w["embed"][code])
        n = (len(code) - WIDTH) // STRIDE
        size = x.itemsize
        return np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STRIDE * EMBED * size, size))

    def block_maxima(self, code: np.ndarray) -> np.ndarray:
        """Per block the largest response of each filter."""
        windows = self.patches(code)
        out = np.empty((len(windows) // _POSITIONS, FILTERS), np.float32)
        for b in range(0, len(out), 32):
            part = windows[b * _POSITIONS:min(len(out), b + 32) * _POSITIONS]
            out[b:b + 32] = (np.ascontiguousarray(part) @ self.w["filters"]).reshape(-1, _POSITIONS, FILTERS).max(axis=1)
        return np.maximum(out + self.w["bias"], 0)

    def combine(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.tanh(pooled @ self.w["hidden"] + self.w["hidden_bias"])
        return 1 / (1 + np.exp(-(hidden @ self.w["out"] + self.w["out_bias"][0]).astype(np.float64)))

    def pooled(self, maxima: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean over a text's chunks of the chunks' maxima."""
        out = np.empty((len(first) - 1, FILTERS), np.float32)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            own = maxima[a:b]
            out[k] = np.maximum(own[1:], own[:-1]).mean(axis=0, dtype=np.float64) if b - a > 1 else own[0]
        return out

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Probabilities of whole texts (bytes), in pieces of bounded size."""
        out, some, size = [], [], 0
        for t in texts:
            if some and size + len(t) > PIECE_BYTES:
                out.append(self._small(some))
                some, size = [], 0
            if len(t) > PIECE_BYTES:
                out.append(self._long(t))
            else:
                some.append(t)
                size += len(t) + BLOCK
        if some:
            out.append(self._small(some))
        return np.round(np.concatenate(out), 6) if out else np.zeros(0)

    def _small(self, texts: list[np.ndarray]) -> np.ndarray:
        code, first = laid_out(texts)
        return self.combine(self.pooled(self.block_maxima(code), first))

    def _long(self, text: np.ndarray) -> np.ndarray:
        """A long text's pieces look back and ahead, so that they respond as the whole."""
        total, maxima = n_blocks(len(text)), []
        text = np.concatenate([np.zeros(WIDTH, np.uint8), text])
        for a in range(0, total * BLOCK, PIECE_BYTES):
            b = min(a + PIECE_BYTES, total * BLOCK)
            back = min(a, BLOCK)
            data = np.zeros(b - a + back + WIDTH, np.uint8)
            own = text[a - back:b + WIDTH]
            data[:len(own)] = own
            maxima.append(self.block_maxima(codes(data)[back:]))
        whole = np.concatenate(maxima)
        return self.combine(self.pooled(whole, np.array([0, len(whole)])))

    def step(self, code: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over chunks (rows of ``code``; ``of``: their text)."""
        w, n = self.w, len(y)
        x = np.ascontiguousarray(w["embed"][code])  # chunks x bytes x EMBED
        positions = 2 * _POSITIONS
        size = x.itemsize
        windows = np.lib.stride_tricks.as_strided(x, (len(x), positions, WIDTH * EMBED), (x.strides[0], STRIDE * EMBED * size, size))
        response = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ w["filters"]
        response = response.reshape(len(x), positions, FILTERS)
        where = response.argmax(axis=1)
        most = np.take_along_axis(response, where[:, None], axis=1)[:, 0] + w["bias"]
        active = np.maximum(most, 0)
        chunks = np.bincount(of, minlength=n)[:, None]
        pooled = np.zeros((n, FILTERS), np.float32)
        np.add.at(pooled, of, active)
        pooled /= chunks
        hidden = np.tanh(pooled @ w["hidden"] + w["hidden_bias"])
        p = 1 / (1 + np.exp(-(hidden @ w["out"] + w["out_bias"][0])))
        loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).mean())
        d = (weight * (p - y) / n).astype(np.float32)
        g = {"out": hidden.T @ d, "out_bias": np.array([d.sum()])}
        back = np.outer(d, w["out"]) * (1 - hidden ** 2)
        g |= {"hidden": pooled.T @ back, "hidden_bias": back.sum(axis=0)}
        back = ((back @ w["hidden"].T) / chunks)[of] * (most > 0)
        best = windows[np.arange(len(x))[:, None], where]  # chunks x filters x patch
        g |= {"filters": (best.transpose(1, 2, 0) @ back.T[:, :, None])[:, :, 0].T, "bias": back.sum(axis=0)}
        to_patch = (back[:, :, None] * w["filters"].T[None]).reshape(len(x), FILTERS, WIDTH, EMBED)
        at = where[:, :, None] * STRIDE + np.arange(WIDTH)
        of_byte = code[np.arange(len(x))[:, None, None], at].ravel()
        embed = np.stack([np.bincount(of_byte, to_patch[..., k].ravel(), 512) for k in range(EMBED)], axis=1)
        return loss, g | {"embed": embed}


def chunk(code: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th chunk of one laid-out text, with what its filters read
    behind it; a text of one block has that block and zeros."""
    out = np.zeros(2 * BLOCK + WIDTH, np.int32)
    own = code[k * BLOCK:(k + 2) * BLOCK + WIDTH]
    out[:len(own)] = own
    return out


def fit(examples: list[tuple[list[np.ndarray], int]], *, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Learn from (chunks of a text, label) pairs; both classes weigh alike."""
    net = Network(seed=seed)
    y = np.array([label for _, label in examples], np.float32)
    if not len(y) or y.min() == y.max():
        net.w["out"][:] = 0  # one class or none: its share, half without any
        net.w["out_bias"][:] = 0 if not len(y) else 4 if y[0] else -4
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    rng = np.random.default_rng(seed)
    first, second, t = {k: 0.0 for k in net.w}, {k: 0.0 for k in net.w}, 0
    steps = epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            rows = order[a:a + BATCH]
            code = np.concatenate([examples[i][0] for i in rows])
            of = np.repeat(np.arange(len(rows)), [len(examples[i][0]) for i in rows])
            _, g = net.step(code, of, y[rows], weight[rows])
            t += 1
            rate = RATE * (1 - t / (steps + 1))
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                net.w[k] -= (rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.99 ** t)) + 1e-8)).astype(np.float32)
    return net


def _texts(column: pa.Array) -> list[np.ndarray]:
    data, bounds = text_bytes(column)
    return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _drawn_chunks(most: int):
    """Per text up to ``most`` of its chunks, spread over the whole of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, draw in zip(_texts(batch.column("text")), batch.column("draw").to_pylist()):
                last = max(1, n_blocks(len(t)) - 1)
                t = np.concatenate([np.zeros(WIDTH, np.uint8), t])
                rng = np.random.default_rng(draw & 0xFFFFFFFF)
                picked = [int(rng.integers(last * i // most, max(last * (i + 1) // most, last * i // most + 1))) for i in range(min(most, last))] if last > most else range(last)
                parts = []
                for k in picked:
                    lo = max(0, k * BLOCK - BLOCK)
                    piece = np.zeros(k * BLOCK - lo + 2 * BLOCK + WIDTH, np.uint8)
                    own = t[lo:(k + 2) * BLOCK + WIDTH]
                    piece[:len(own)] = own
                    parts.append(codes(piece)[k * BLOCK - lo:].astype(np.uint16))
                out.append(np.concatenate(parts).tobytes())
            yield pa.record_batch([batch.column("draw"), batch.column("quality"), pa.array(out, pa.binary())], names=["draw", "quality", "chunks"])

    return run


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          fit_documents: int = FIT_DOCUMENTS) -> Network:
    """Fit on about ``fit_documents`` labelled texts per class, of documents
    whose crc32 modulo 3 is not 1.  A digest of the text chooses: all below a
    threshold that the class's count sets, so no group of rows is ranked and
    equal texts count once.  The driver gets a few chunks of each, drawn all
    over the text, of bounded size."""
    marked = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("quality"))
              .where((remainder("doc_id", 3) != 1) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    share = (F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)).alias("share")
    digests = docs.select(F.col(id_col).alias("doc_id"), text).select("doc_id", share)
    drawn = digests.join(marked, "doc_id")
    counts = {r.quality: r.n for r in drawn.groupBy("quality").agg(F.approx_count_distinct("share", 0.02).alias("n")).collect()}
    if not counts:
        return fit([])
    limit = F.lit(0.0)
    for k, n in counts.items():
        limit = F.when(F.col("quality") == k, F.lit(fit_documents / max(1, n))).otherwise(limit)
    # about fit_documents a class; twice as many at the most
    chosen = drawn.where(F.col("share") <= limit).groupBy("share").agg(F.min("doc_id").alias("doc_id"), F.max("quality").alias("quality"))
    chosen = chosen.orderBy("share").limit(4 * fit_documents).collect()
    picked = docs.sparkSession.createDataFrame([(r.doc_id, r.quality, int(r.share * (1 << 53))) for r in chosen], "doc_id long, quality int, draw long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text).join(F.broadcast(picked), "doc_id").select("draw", "quality", "text")
    rows = text_batches(rows).mapInArrow(_drawn_chunks(FIT_CHUNKS), "draw long, quality int, chunks binary").collect()
    size = 2 * BLOCK + WIDTH
    return fit([(np.frombuffer(r.chunks, np.uint16).reshape(-1, size).astype(np.int32), r.quality)
                for r in sorted(rows, key=lambda r: (r.draw, r.chunks))])


def score(docs: DataFrame, net: Network, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted``, from
    the text alone (columns of these names are replaced).

    A null text is empty; an empty text is a chunk of zeros and has a score
    too; whole texts of any length are read, long ones in pieces that give the
    same responses.  Rows are independent; equal texts have equal scores (to
    six decimals); an empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(net.w)
    mark = uuid.uuid4().hex
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept_in_worker(f"quality {mark}", lambda: Network(model.value))
        for batch in batches:
            p = own.scores(_texts(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                                             [*names, "score", "predicted"])

    kept = text_batches(docs.select(*[F.col(f"`{n}`") for n in names]))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}score double, predicted int")
