"""Personal data: exact patterns, and a semi-Markov conditional random field
that adds spans the patterns miss.

The field's candidates are whole segments of any length that have the form of
an address or of a number.  Its weights are learned here from the corpus itself: spans found by the patterns,
the same spans in other spellings, and look-alikes (dates, versions, amounts)
that are not personal data."""

from __future__ import annotations

import heapq
import math
import random
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from bisect import bisect_left
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import release_kept, strings, text_batches

# The patterns of the base spans, in the order of the kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
#: A text without the kind's sign holds no span of it.
_SIGN = {"email": re.compile("@"), "ip": re.compile("[0-9]"), "card": re.compile("[0-9]{2}|[0-9][ -][0-9]"), "phone": re.compile(r"\+")}

#: The same matches without trying every start of a long run: from inside a run
#: of digits or of local-part characters nothing matches that does not match
#: from its beginning.  An address may begin where the one before it ended.
_RUNS = {"ip": re.compile("(?<![0-9])" + PATTERNS["ip"].replace("+", "++")),
         "email": re.compile(r"(?<![A-Za-z0-9._%+-])" + PATTERNS["email"].replace("]+@", "]++@"))}
_EMAIL_HERE = re.compile(PATTERNS["email"].replace("]+@", "]++@"))

Span = tuple[str, int, int]


def _matches(kind: str, text: str) -> Iterator[re.Match]:
    if kind != "email":
        yield from _RUNS.get(kind, _COMPILED[kind]).finditer(text)
        return
    at = 0
    while m := (at and _EMAIL_HERE.match(text, at)) or _RUNS[kind].search(text, at):
        yield m
        at = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _holds(kind: str, text: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        parts = [p.lstrip("0") for p in text.split(".")]  # any number of zeros in front
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)
    digits = re.sub("[^0-9]", "", text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind that pass the kind's test, by
    start, then kind."""
    found = []
    for order, kind in enumerate(KINDS):
        if _SIGN[kind].search(text):
            found += [(m.start(), order, m.end()) for m in _matches(kind, text) if _holds(kind, m.group())]
    return [(KINDS[o], a, b) for a, o, b in sorted(found)]


# -- segments and their features ------------------------------------------------
#: The longest kind of number, a card, has so many digits; addresses end where
#: their form ends, however many labels they have.
MAX_DIGITS = 19
#: Tokens on either side of a sign that belong to its window.
MARGIN = 3
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_TRIGGER = re.compile(r"[0-9]{2,}|@|\(at\)|\[at\]", re.IGNORECASE)
#: A host has at most 127 labels; signs of a number in a row, at most.
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]+){1,126}", re.IGNORECASE)
MAX_SIGNS = 4
_AT = re.compile(r"\s?(?:@|\(at\)|\[at\])\s?", re.IGNORECASE)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_NUMBER = re.compile(r"\+?[0-9(][0-9().\s/-]*[0-9]")
#: What segments can hold besides blanks: a window's ends go on over these.
_INSIDE = re.compile(r"[A-Za-z0-9._%+@()\[\]/-]*")


def windows(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, tokens) of the pieces of a line around digits and at-signs;
    all else is outside any entity.  Windows do not overlap, and end at signs
    that no segment holds, so the work is linear in the line."""
    for line in re.finditer(r"[^\n]+", text) if _TRIGGER.search(text) else ():
        begin, end = line.span()
        lo = reach = -1
        done = begin  # the end of the window before
        for m in chain(_TRIGGER.finditer(text, begin, end), (None,)):
            mark = m.start() if m else end + 65
            if lo >= 0 and mark > reach:
                hi = min(end, max(reach, done))
                hi = _INSIDE.match(text, hi, end).end()
                while lo > done and _INSIDE.fullmatch(text, lo - 1, lo):
                    lo -= 1
                if tokens := [t.span() for t in _TOKEN.finditer(text, lo, hi)]:
                    yield lo, hi, tokens
                lo, done = -1, hi
            if m is None or mark < done:
                continue
            if lo < 0:
                lo = max(done, mark - 48)
            at = _AT.match(text, mark, end)
            host = at and _HOST.match(text, at.end(), end)
            reach = max(reach, mark + 64, host.end() if host else 0)


def segment_features(text: str, a: int, b: int) -> list[str] | None:
    """Features of the whole segment, or None if it can be no entity: its
    border cuts a word or number, or it is neither number- nor address-like."""
    s = text[a:b]
    before, after = text[a - 1:a], text[b:b + 1]
    if (before.isalnum() and s[0].isalnum()) or (after.isalnum() and s[-1].isalnum()):
        return None
    digits = re.sub("[^0-9]", "", s)
    at = _AT.search(s)
    if at:
        local, host = s[:at.start()], s[at.end():]
        if not _LOCAL.fullmatch(local) or not _HOST.fullmatch(host):
            return None
        if before and before in "._%+-@" or after and after in "@-" or (after == "." and text[b + 1:b + 2].isalnum()):
            return None
        out = ["at", "at:" + ("sign" if at.group() == "@" else "spelt" if "@" not in at.group() else "blanks"),
               f"labels:{min(4, len(re.findall(r'[A-Za-z0-9-]+', host)))}", f"top:{min(6, len(re.split(r'[^A-Za-z0-9-]+', host)[-1]))}",
               "local:" + ("digits" if local.isdigit() else "letters")]
    else:
        if not _NUMBER.fullmatch(s) or len(digits) < 4 or s.count("(") != s.count(")"):
            return None
        if before and before in ".-/+:$€£#,=_" or after and after in "-/:%_=" or (after in (".", ",") and text[b + 1:b + 2].isdigit()):
            return None
        groups = [len(g) for g in re.findall("[0-9]+", s)]
        parts = s.split(".")
        quads = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
        separators = "".join(sorted(set(re.sub("[0-9]", "", s))))
        out = [f"digits:{len(digits)}", f"groups:{'-'.join(map(str, groups))}", f"separators:{separators}",
               f"plus:{s[0] == '+'}", f"quads:{quads}", f"luhn:{13 <= len(digits) <= 19 and luhn(digits)}",
               f"plus:{s[0] == '+'},digits:{len(digits)}", f"groups:{len(groups)},separators:{separators}",
               f"tail:{'-'.join(map(str, groups[-3:]))}", f"bracket:{'(' in s}",
               f"zero:{digits[0] == '0'}", f"year:{groups[0] == 4 and digits[:2] in ('19', '20')}"]
    return [*out, "before:" + ("word" if before.isspace() or not before else before), "after:" + ("word" if after.isspace() or not after else after)]


class Field:
    """Segments of kinds 1..n and, of kind 0, single outside tokens (score 0).
    A path's score sums its segments' feature weights and the weights of
    neighbouring kinds."""

    def __init__(self, weights: dict[tuple[str, int], float] | None = None):
        self.w = defaultdict(float, weights or {})
        self.kinds = range(1, len(KINDS) + 1)

    def segments(self, text: str, tokens) -> dict[tuple[int, int], list[str]]:
        """Candidate segments (first token, one past the last) with features."""
        out, n, hi = {}, len(tokens), tokens[-1][1] if tokens else 0
        run, host = -1, None  # where the local part ends, and the host behind it

        def take(i, j):
            if f := segment_features(text, tokens[i][0], tokens[j - 1][1]):
                out[i, j] = f

        for i, (a, _) in enumerate(tokens):
            c, digits, signs = text[a], 0, 0
            if not (c.isalnum() or c in "+("):
                continue
            for j in range(i, n):
                x, y = tokens[j]
                if "0" <= text[x] <= "9":
                    digits, signs = digits + y - x, 0
                    if digits > MAX_DIGITS:
                        break
                    take(i, j + 1)
                elif text[x] not in "().-/" and (j > i or c != "+"):
                    break
                elif (signs := signs + 1) > MAX_SIGNS:
                    break
            if a >= run:
                local = _LOCAL.match(text, a, hi)
                run = local.end() if local else -1
                at = local and _AT.match(text, run, hi)
                host = at and _HOST.match(text, at.end(), hi)
            if host and not _LOCAL.match(text, a - 1, a) or host and not a:  # no address begins inside a local part
                for j in range(i + 1, n):
                    b = tokens[j][1]
                    if b > host.end():
                        break
                    after = text[b:b + 1]
                    if tokens[j][0] > host.start() and not (after and after in "@-" or after == "." and text[b + 1:b + 2].isalnum()):
                        take(i, j + 1)
        return out

    def score(self, features: list[str], kind: int) -> float:
        return self.w["bias", kind] + sum(self.w[f, kind] for f in features)

    def decode(self, n: int, segments) -> list[tuple[int, int, int]]:
        """The best path's entities, (first, past last, kind)."""
        ends = defaultdict(list)
        for (i, j), f in segments.items():
            ends[j].append((i, [self.score(f, k) for k in self.kinds]))
        best = [[0.0] + [-math.inf] * len(KINDS)]
        back: list[list] = [[None] * (len(KINDS) + 1)]
        for j in range(1, n + 1):
            row, from_ = [-math.inf] * (len(KINDS) + 1), [None] * (len(KINDS) + 1)
            p = max(range(len(KINDS) + 1), key=lambda k: best[j - 1][k] + self.w["next", k, 0])
            row[0], from_[0] = best[j - 1][p] + self.w["next", p, 0], (j - 1, p)
            for i, scores in ends[j]:
                for k in self.kinds:
                    p = max(range(len(KINDS) + 1), key=lambda q: best[i][q] + self.w["next", q, k])
                    s = best[i][p] + self.w["next", p, k] + scores[k - 1]
                    if s > row[k]:
                        row[k], from_[k] = s, (i, p)
            best.append(row)
            back.append(from_)
        out, j, k = [], n, max(range(len(KINDS) + 1), key=lambda q: best[n][q])
        while j:
            i, p = back[j][k]
            if k:
                out.append((i, j, k))
            j, k = i, p
        return out[::-1]

    def gradient_step(self, n: int, segments, gold: set[tuple[int, int, int]], rate: float, memory) -> float:
        """One step up the log-likelihood of ``gold`` by forward-backward;
        returns the log-likelihood."""
        m = len(KINDS) + 1
        pairs = [[self.w["next", p, k] for k in range(m)] for p in range(m)]
        scored = {ij: [self.score(f, k) for k in self.kinds] for ij, f in segments.items()}
        ends, starts = defaultdict(list), defaultdict(list)
        for i, j in scored:
            ends[j].append(i)
            starts[i].append(j)
        add = lambda v: max(v) + math.log(sum(math.exp(x - max(v)) for x in v)) if v and max(v) > -math.inf else -math.inf
        into = [[-math.inf] * m for _ in range(n + 1)]  # about to begin a segment of kind k at i
        done = [[-math.inf] * m for _ in range(n + 1)]  # a segment of kind k ends at j
        done[0][0] = 0.0
        for j in range(n + 1):
            if j:
                done[j][0] = into[j - 1][0]
                for k in self.kinds:
                    done[j][k] = add([into[i][k] + scored[i, j][k - 1] for i in ends[j]])
            for k in range(m):
                into[j][k] = add([done[j][p] + pairs[p][k] for p in range(m)])
        after = [[0.0] * m for _ in range(n + 1)]  # of what follows a segment of kind k that ends at j
        for j in range(n - 1, -1, -1):
            begin = [after[j + 1][0]] + [add([scored[j, e][k - 1] + after[e][k] for e in starts[j]]) for k in self.kinds]
            after[j] = [add([pairs[p][k] + begin[k] for k in range(m)]) for p in range(m)]
        total = add(done[n])
        grad = defaultdict(float)
        for (i, j), f in segments.items():
            for k in self.kinds:
                p = math.exp(min(0.0, into[i][k] + scored[i, j][k - 1] + after[j][k] - total))
                d = ((i, j, k) in gold) - p
                if abs(d) > 1e-4:
                    grad["bias", k] += d
                    for x in f:
                        grad[x, k] += d
        path, at, prev, likelihood = sorted(gold), 0, 0, 0.0
        steps = []
        for i, j, k in path:
            steps += [0] * (i - at) + [k]
            at = j
            likelihood += scored[i, j][k - 1]
        for k in steps + [0] * (n - at):
            grad["next", prev, k] += 1
            likelihood += pairs[prev][k]
            prev = k
        for i in range(n):
            for k in range(m):
                begin = after[i + 1][0] if k == 0 else add([scored[i, e][k - 1] + after[e][k] for e in starts[i]])
                for p in range(m):
                    x = done[i][p] + pairs[p][k] + begin - total
                    if x > -14:
                        grad["next", p, k] -= math.exp(min(0.0, x))
        for key, g in grad.items():
            memory[key] += g * g
            self.w[key] += rate * g / math.sqrt(memory[key] + 1e-8)
        return likelihood - total


# -- learning --------------------------------------------------------------------
#: Documents that the field is fitted on: in equal parts for each kind some that
#: hold it, and one such part more of documents that hold none.
FIT_DOCUMENTS = 600
FIT_EPOCHS = 4
SEED = 11


def _respell(kind: str, s: str, rng: random.Random) -> str:
    """The same datum as people also write it."""
    digits = re.sub("[^0-9]", "", s)
    if kind == "email":
        local, _, host = s.partition("@")
        return rng.choice([f"{local} @ {host}", f"{local}(at){host}", f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local}@{host}"])
    if kind == "phone":
        tail = digits[-10:]
        a, b, c = tail[:3], tail[3:6], tail[6:]
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10]} {a} {b} {c}", f"1-{a}-{b}-{c}", s])
    if kind == "card":
        return rng.choice([".".join(digits[i:i + 4] for i in range(0, len(digits), 4)), "-".join(digits[i:i + 4] for i in range(0, len(digits), 4)), s])
    return s


def _look_alike(rng: random.Random) -> str:
    r = rng.randint
    return rng.choice([
        f"{r(1900, 2030)}-{r(1, 12):02d}-{r(1, 28):02d}", f"{r(1, 28):02d}.{r(1, 12):02d}.{r(1900, 2030)}", f"{r(1, 28)}/{r(1, 12)}/{r(1900, 2030)}",
        f"{r(0, 20)}.{r(0, 20)}", f"{r(0, 20)}.{r(0, 20)}.{r(0, 90)}", f"{r(1900, 1999)}-{r(2000, 2030)}", f"{r(1000, 99999)}",
        f"{r(10 ** 6, 10 ** 9)}", f"{r(10 ** 9, 10 ** 12)}", f"{r(1, 999)} {r(100, 999)} {r(100, 999)}", f"{r(10, 99)}-{r(10, 99)}", f"{r(1000, 9999)} {r(1000, 9999)}",
        f"978-{r(0, 9)}-{r(100, 999)}-{r(10000, 99999)}-{r(0, 9)}", f"{r(256, 999)}.{r(0, 999)}.{r(0, 999)}.{r(0, 999)}", f"{r(10 ** 13, 10 ** 14 - 1)}{r(1, 8)}" ])


def _examples(texts: list[str], rng: random.Random):
    words = [w for t in texts for w in t.split()[:40] if w.isalpha()] or ["the"]
    for t in texts:
        spans = []
        for kind, a, b in base_spans(t):
            if not spans or a >= spans[-1][2]:
                spans.append((kind, a, b))
        yield t, spans
        for kind, a, b in spans:
            left = " ".join(rng.choices(words, k=rng.randint(1, 5)))
            right = " ".join(rng.choices(words, k=rng.randint(1, 5)))
            s = _respell(kind, t[a:b], rng)
            yield f"{left} {s}{rng.choice(['', '', ',', '.'])} {right}", [(kind, len(left) + 1, len(left) + 1 + len(s))]
            s = _look_alike(rng)
            if not base_spans(s):
                yield f"{left} {s}{rng.choice(['', '', ',', '.'])} {right}", []


def fit(texts: list[str], epochs: int = FIT_EPOCHS, seed: int = SEED) -> dict:
    """Weights learned from texts (see the module's head)."""
    rng, field, memory, data = random.Random(seed), Field(), defaultdict(float), []
    for text, spans in _examples(texts, rng):
        for lo, hi, tokens in windows(text):
            first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
            inside = [s for s in spans if s[1] < hi and s[2] > lo]
            segments = field.segments(text, tokens)
            gold = {(first.get(a), last.get(b), KINDS.index(k) + 1) for k, a, b in inside}
            if segments and all((i, j) in segments for i, j, _ in gold):
                data.append((len(tokens), segments, gold))
    for _ in range(epochs):
        rng.shuffle(data)
        for n, segments, gold in data:
            field.gradient_step(n, segments, gold, 0.3, memory)
    return {k: v for k, v in field.w.items() if abs(v) > 1e-6}


def find_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans).  A segment that touches a base span is no
    candidate, so base spans stay as they are."""
    base = base_spans(text)
    starts, ends = [], []  # the base spans' union
    for _, x, y in base:
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)
    added = []
    for _, _, tokens in windows(text):
        segments = field.segments(text, tokens)
        free = {}
        for (i, j), f in segments.items():
            k = bisect_left(starts, tokens[j - 1][1])  # unions that begin before the segment's end
            if not k or ends[k - 1] <= tokens[i][0]:
                free[i, j] = f
        for i, j, k in field.decode(len(tokens), free) if free else ():
            added.append((KINDS[k - 1], tokens[i][0], tokens[j - 1][1]))
    return base, added


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(weights: dict, out: str):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        field = Field(weights)
        for batch in batches:
            rows = []
            for t in strings(batch.column("text")):
                base, added = find_spans(t, field)
                known = set(base)
                rows.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in known} for k, a, b in ordered(base + added)])
            names = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rows, kind)], [*names, out])

    return run


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def _draws(most: int):
    """Per task and kind (none: 0) the smallest digests of texts that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        least: list[set[int]] = [set() for _ in range(len(KINDS) + 1)]

        def trim():
            for k, draws in enumerate(least):
                least[k] = set(heapq.nsmallest(most, draws))

        for batch in batches:
            for t, draw in zip(strings(batch.column("t")), batch.column("draw").to_pylist()):
                for k in {KINDS.index(kind) + 1 for kind, _, _ in base_spans(t)} or {0}:
                    least[k].add(draw)
            trim()
        rows = [(k, draw) for k, draws in enumerate(least) for draw in draws]
        yield pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.int64())], names=["kind", "draw"])

    return run


def learn(docs: DataFrame, *, text_col: str = "text", fit_documents: int = FIT_DOCUMENTS) -> dict:
    """The field's weights, the only thing learned, from the only bounded
    sample: for each kind ``fit_documents`` / 4 texts with a valid base span of
    it, however rare they are, and as many without any but with digits or
    at-signs.  A digest of the text chooses, so equal texts count once."""
    most = max(1, fit_documents // len(KINDS))
    some = docs.select(F.col(text_col).alias("t")).where(F.col("t").rlike("@|[0-9]")).withColumn("draw", F.xxhash64("t"))
    # tasks send their smallest digests per kind, not texts; equal texts share a digest
    draws = text_batches(some).mapInArrow(_draws(most), "kind int, draw long").distinct()
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("draw"))
    draws = [r.draw for r in draws.withColumn("nth", nth).where(F.col("nth") <= most).select("draw").distinct().collect()]
    if not draws:
        return fit([])
    chosen = docs.sparkSession.createDataFrame([(d,) for d in draws], "draw long")
    rows = some.join(F.broadcast(chosen), "draw", "left_semi").dropDuplicates(["draw"]).collect()
    return fit([r.t for r in sorted(rows, key=lambda r: (r.draw, r.t))])


def add_spans(docs: DataFrame, *, text_col: str = "text", weights: dict | None = None, out: str = "spans") -> DataFrame:
    """``docs`` with ``out`` (a column of that name is replaced): all personal data of the whole text by start,
    then kind, in code points, ``base`` telling pattern matches from added
    ones.  A null or empty text has none; rows are independent, so repeated
    rows repeat their spans; an empty table gives no rows."""
    weights = learn(docs, text_col=text_col) if weights is None else weights
    rows = text_batches(docs.withColumnRenamed(text_col, "text") if text_col != "text" else docs)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != out)
    return rows.mapInArrow(_scan(weights, out), f"{fields}`{out}` {SPANS}")


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts of base spans per kind, the digest of the base
    spans, all spans as text, and how many were added.  A null or empty text has
    none; other columns play no part, and repeated rows repeat their result."""
    rows = add_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.filter("spans", lambda s: s["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
                       written(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def redact(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle
    brackets (overlapping spans: one replacement, the first's kind), and
    ``n_chars``, where there is one, set anew.  Null texts and texts without
    spans stay as they are, and so does every other column, whatever its name;
    an empty table gives no rows."""
    fields, mark = docs.schema, f"spans {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = batch.column("text").to_pylist(), []
            for t, spans in zip(texts, batch.column(mark).to_pylist()):
                at, parts = 0, []
                for s in spans:
                    if s["start"] >= at:
                        parts += [t[at:s["start"]], f"<{s['kind']}>"]
                    at = max(at, s["end"])
                changed.append("".join([*parts, t[at:]]) if spans else t)
            out = {n: batch.column(n) for n in fields.names}
            out["text"] = pa.array(changed, pa.string())
            if "n_chars" in out:
                out["n_chars"] = pa.array([None if t is None else len(t) for t in changed], pa.int64()).cast(out["n_chars"].type)
            yield pa.RecordBatch.from_arrays([out[n] for n in fields.names], fields.names)

    return add_spans(docs, weights=weights, out=mark).mapInArrow(run, fields)
