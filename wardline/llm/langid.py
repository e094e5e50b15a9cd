"""Language identification: a linear-chain conditional random field labels every
word of a text, also of code-switched text, by forward-backward."""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import kept_in_worker, row_blocks, strings, text_batches
from wardline.llm.shingles import mix64

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Feature table; n-grams of up to so many characters, borders included, so
#: that those at a border are the word's affixes.
TABLE_BITS = 18
MAX_GRAM = 4
#: The fit's bound: labelled documents per language, and words in sequences made of them.
FIT_DOCUMENTS = 400
FIT_SEQUENCES = 3000
SEQUENCE_WORDS = 32
MEAN_RUN = 10
EPOCHS = 5
BATCH = 100
SEED = 7
#: Words kept per worker with their scores, and text worked on at once.
KEPT_WORDS = 120_000
BLOCK_BYTES = 3 << 20

#: A script is a language's own from this share of its letters on.
OWN_SCRIPT = 0.01

_OPEN, _CLOSE = 2, 3
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs of distinct words: character n-grams, affixes (the
    n-grams that hold a border mark) and the word itself as lexicon entry."""
    s = chr(_OPEN) + (chr(_CLOSE) + chr(_OPEN)).join(words) + chr(_CLOSE)
    code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(code == _OPEN)
    word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
    place = np.arange(len(code)) - starts[word]
    size = np.diff(np.append(starts, len(code)))[word]
    rolling, ids, of = np.zeros(len(code), np.uint64), [], []
    for n in range(1, MAX_GRAM + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        rolling = rolling[:m] * _GOLDEN + code[n - 1:] + np.uint64(1)
        fits = place[:m] + n <= size[:m]
        if n == 1:
            fits &= (code != _OPEN) & (code != _CLOSE)
        ids.append(mix64(rolling[fits] + np.uint64(n << 40)))
        of.append(word[:m][fits])
    powers = mix64(place.astype(np.uint64) + np.uint64(99)) | np.uint64(1)
    ids.append(mix64(np.add.reduceat(code * powers, starts) + np.uint64(77)))
    of.append(np.arange(len(starts)))
    return (np.concatenate(ids) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.concatenate(of)


def script(letter: str) -> str:
    """The script of a letter, as its Unicode name begins (LATIN, CJK, ...)."""
    return unicodedata.name(letter, "?").partition(" ")[0].partition("-")[0]


class WordField:
    """Labels, feature weights (table x labels), transition weights, and the
    scripts that the languages are written in."""

    def __init__(self, labels: list[str], weights: np.ndarray | None = None, moves: np.ndarray | None = None, scripts: frozenset[str] = frozenset()):
        n = len(labels)
        self.scripts = scripts
        self.labels = labels
        self.weights = np.zeros((1 << TABLE_BITS, n), np.float32) if weights is None else weights
        self.moves = np.zeros((n, n)) if moves is None else moves

    def scores(self, ids: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(of, self.weights[ids, k], n) for k in range(len(self.labels))], axis=1)

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of every word's labels (rows as given, sequence after
        sequence) and the summed expected transitions.  All sequences advance
        together, the longest first, so a step is a few array operations."""
        n_labels = scores.shape[1]
        order = np.argsort(-lengths, kind="stable")
        firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
        sizes = lengths[order]
        total, longest = int(sizes.sum()), int(sizes[0]) if len(sizes) else 0
        at_step = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
        begin = np.concatenate(([0], np.cumsum(at_step)))
        step_of = np.repeat(np.arange(longest), at_step)
        rank = np.arange(total) - begin[step_of]
        rows = firsts[rank] + step_of  # time-major -> given order
        likely = scores[rows]
        likely = np.exp(likely - likely.max(axis=1, keepdims=True)).astype(np.float32)
        move = np.exp(self.moves - self.moves.max()).astype(np.float32)
        forward, backward = np.empty_like(likely), np.ones_like(likely)
        for t in range(longest):
            a, b = begin[t], begin[t + 1]
            x = likely[a:b].copy() if t == 0 else (forward[begin[t - 1]:begin[t - 1] + b - a] @ move) * likely[a:b]
            forward[a:b] = x / x.sum(axis=1, keepdims=True)
        expected = np.zeros((n_labels, n_labels))
        for t in range(longest - 2, -1, -1):
            a, b, n = begin[t], begin[t + 1], at_step[t + 1]
            follows = likely[b:b + n] * backward[b:b + n]
            x = follows @ move.T
            backward[a:a + n] = x / x.sum(axis=1, keepdims=True)
        if longest > 1:
            follow = step_of > 0
            prev = (begin[step_of - 1] + rank)[follow]
            both = forward[prev][:, :, None] * move[None] * (likely * backward)[follow][:, None, :] if total < 200_000 else None
            if both is not None:
                expected = (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        both = forward * backward
        out = np.empty((total, n_labels), np.float32)
        out[rows] = both / both.sum(axis=1, keepdims=True)
        return out, expected


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def fit(labelled: list[tuple[str, str]], *, sequences: int = FIT_SEQUENCES, epochs: int = EPOCHS, seed: int = SEED) -> WordField:
    """Learn from (text, language) pairs.  A training sequence strings together
    runs of words from documents of random languages, each word labelled with
    its document's language, so transitions learn how languages alternate."""
    labels = sorted({lang for _, lang in labelled})
    field = WordField(labels)
    by_label = {k: [w for t, lang in labelled if lang == k if (w := [x for x in words_of(t) if any(c.isalpha() for c in x)])] for k in labels}
    by_label = {k: v for k, v in by_label.items() if v}
    if not by_label:
        return field
    for docs in by_label.values():
        letters: Counter = Counter()
        for c, n in Counter("".join(chain.from_iterable(docs))).items():
            if c.isalpha():
                letters[script(c)] += n
        field.scripts |= {k for k, n in letters.items() if n >= OWN_SCRIPT * letters.total()}
    rng = np.random.default_rng(seed)
    usable = sorted(by_label)
    tokens, gold = [], []
    for _ in range(sequences):
        n = 0
        while n < SEQUENCE_WORDS:
            k = usable[rng.integers(len(usable))]
            doc = by_label[k][rng.integers(len(by_label[k]))]
            run = min(int(rng.geometric(1 / MEAN_RUN)), SEQUENCE_WORDS - n, len(doc))
            at = int(rng.integers(len(doc) - run + 1))
            tokens += doc[at:at + run]
            gold += [labels.index(k)] * run
            n += run
    ids, of = features(tokens)
    by_word = np.argsort(of, kind="stable")
    ids, of = ids[by_word], of[by_word]
    gold_of = np.array(gold)
    memory_w, memory_m = np.full_like(field.weights, 1e-6), np.full_like(field.moves, 1e-6)
    step = BATCH * SEQUENCE_WORDS
    for epoch in range(epochs):
        rate = 0.2 / (1 + epoch)
        for a in range(0, len(gold_of), step):
            b = min(len(gold_of), a + step)
            lo, hi = np.searchsorted(of, (a, b))
            some, word = ids[lo:hi], of[lo:hi] - a
            y = gold_of[a:b]
            p, expected = field.marginals(field.scores(some, word, b - a), np.full((b - a) // SEQUENCE_WORDS, SEQUENCE_WORDS))
            miss = np.eye(len(labels))[y] - p
            for k in range(len(labels)):
                g = np.bincount(some, miss[word, k], 1 << TABLE_BITS)
                touched = np.flatnonzero(g)
                memory_w[touched, k] += g[touched] ** 2
                field.weights[touched, k] += rate * g[touched] / np.sqrt(memory_w[touched, k])
            y = y.reshape(-1, SEQUENCE_WORDS)
            seen = np.zeros_like(expected)
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            g = seen - expected
            memory_m += g ** 2
            field.moves += rate * g / np.sqrt(memory_m)
    return field


class Labeller:
    """Scores distinct words once and keeps them, up to ``KEPT_WORDS``."""

    def __init__(self, field: WordField):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.field.labels)), np.float32)
        self.letters = np.zeros(0, bool)

    def label(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[str]]]:
        """Per text the label probabilities of its words, and the words.  Words
        without any letter (superscripts and the like) are left out."""
        split = [words_of(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.forget()
        new = sorted(set().union(*split).difference(self.known)) if split else []
        if new:
            ids, of = features(new)
            self.table = np.concatenate([self.table, self.field.scores(ids, of, len(new)).astype(np.float32)])
            self.letters = np.concatenate([self.letters, [any(c.isalpha() for c in w) for w in new]])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        lengths = np.array([len(w) for w in split], np.int64)
        rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        keep = self.letters[rows]
        if not keep.all():
            of = np.repeat(np.arange(len(split)), lengths)
            rows, lengths = rows[keep], np.bincount(of[keep], minlength=len(split))
            split = [[w for w in words if any(c.isalpha() for c in w)] for words in split]
        some = np.flatnonzero(lengths)
        p = self.field.marginals(self.table[rows], lengths[some])[0] if len(some) else np.zeros((0, self.table.shape[1]))
        return np.split(p, np.cumsum(lengths)[:-1]) if len(texts) else [], split

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Per text the language of most of its words by mean probability, and
        that mean; ``und`` and 0 without letters or without learned languages."""
        langs, scores = [], []
        for p in self.label(texts)[0] if self.field.labels else [()] * len(texts):
            if len(p):
                mean = p.mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                langs.append(self.field.labels[best])
                scores.append(min(1.0, float(mean[best])))
            else:
                langs.append(UNKNOWN)
                scores.append(0.0)
        return langs, scores


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          fit_documents: int = FIT_DOCUMENTS) -> WordField:
    """Fit on at most ``fit_documents`` documents per language, those with the
    smallest digests of id and text among documents whose crc32 modulo 4 is not
    2 and whose language and text are not null."""
    rows = docs.where((remainder(id_col, 4) != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    some = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"))
    # tasks send their smallest digests per language, not texts
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    draws = some.select("lang", "draw").distinct().withColumn("nth", nth).where(F.col("nth") <= fit_documents)
    last = draws.groupBy("lang").agg(F.max("draw").alias("last"))
    taken = some.join(F.broadcast(last), "lang").where("draw <= last")  # one row per language
    taken = taken.dropDuplicates(["lang", "draw"]).select("lang", "draw", "text").collect()
    return fit([(r.text, r.lang) for r in sorted(taken, key=lambda r: (r.lang, r.draw, r.text))])


def letter_classes(scripts: frozenset[str]) -> bytes:
    """Per code point 0 (no letter), 1 (a letter of these scripts) or 2."""
    return bytes((1 if script(c) in scripts else 2) if (c := chr(i)).isalpha() else 0 for i in range(sys.maxunicode + 1))


def written(text: str, classes: np.ndarray) -> float:
    """Share of a text's letters that are of class 1."""
    if text.isascii():
        code = np.frombuffer(text.encode(), np.uint8)
    else:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    _, own, other = np.bincount(classes[code], minlength=3).tolist()
    return own / max(1, own + other)


def predict(docs: DataFrame, field: WordField, *, text_col: str = "text", written_col: str | None = None,
            lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with ``lang_out`` and ``score_out`` (0 to 1), from the text alone
    (columns of these names are replaced; others stay as they are), and if asked ``written_col``, the share of a text's letters that are of the
    learned languages' scripts.  Null texts and texts without a letter are ``und`` with score 0; rows are
    independent; an empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast((field.labels, field.weights, field.moves))

    mark = uuid.uuid4().hex
    letters = docs.sparkSession.sparkContext.broadcast(letter_classes(field.scripts)) if written_col else None
    names = [c for c in docs.columns if c not in (lang_out, score_out, written_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(letters.value, np.uint8) if letters else None
        own = kept_in_worker(f"labeller {mark}", lambda: Labeller(WordField(*model.value)))
        for batch in batches:
            texts = strings(batch.column(text_col))
            langs, scores = [], []
            for a, b in row_blocks(np.array([len(t) for t in texts], np.int64), BLOCK_BYTES):
                x, y = own.predict(texts[a:b])
                langs += x
                scores += y
            more = [pa.array([written(t, classes) for t in texts], pa.float64())] if written_col else []
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *more],
                                             [*names, lang_out, score_out, *[written_col] * len(more)])

    kept = text_batches(docs.select(*[F.col(f"`{n}`") for n in names]))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}`{lang_out}` string, `{score_out}` double" + f", `{written_col}` double" * bool(written_col))


def label_words(docs: DataFrame, field: WordField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``doc_id, position, word, lang, probability``.  Null
    texts, texts without letters and fields without languages give no rows;
    other columns play no part, and repeated rows repeat their words."""
    model = docs.sparkSession.sparkContext.broadcast((field.labels, field.weights, field.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(WordField(*model.value))
        for batch in batches:
            probabilities, split = own.label(strings(batch.column("text"))) if own.field.labels else ([], [])
            for doc_id, p, words in zip(batch.column("doc_id").to_pylist(), probabilities, split):
                yield pa.record_batch([
                    pa.array([doc_id] * len(words), pa.int64()), pa.array(range(len(words)), pa.int64()), pa.array(words, pa.string()),
                    pa.array([own.field.labels[k] for k in p.argmax(axis=1)] if len(words) else [], pa.string()),
                    pa.array(p.max(axis=1).astype(float) if len(words) else [], pa.float64())],
                    names=["doc_id", "position", "word", "lang", "probability"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, position long, word string, lang string, probability double")
