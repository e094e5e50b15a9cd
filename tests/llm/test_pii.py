import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import pytest

from wardline.llm import pii
from wardline.llm.common import table
from tests.conftest import SF_SMALL

VALID = "4041894974608795"  # passes Luhn


def plain_base(text):
    out = []
    for k, (kind, p) in enumerate(pii.PATTERNS.items()):
        for m in re.finditer(p, text):
            d = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d))) % 10 == 0
            if (kind == "email" or kind == "ip" and max(map(int, m.group().split("."))) <= 255
                    or kind == "card" and 14 <= len(d) <= 19 and luhn or kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


@pytest.fixture(scope="module")
def field(spark):
    return pii.Field(pii.learn(table(spark, SF_SMALL.replace("0.001", "0.01"), "documents")))


TEXTS = ["a.b@c.de, x@y z@w.x", "1.2.3.4 and 1.2.3.4.5 256.1.1.1 0001.2.3.4", f"{VALID} 4041-8949-7460-8795 4041 8949 7460 8796",
         "+1 (988) 555-2485 +49 30 1234567890 +1 2", f"+{VALID[:12]}@x.de", "é🙂 +1 (988) 555-2485", "", "no data"]


def test_base_spans():
    for t in TEXTS:
        assert pii.base_spans(t) == plain_base(t)


def test_decode_and_gradient_equal_enumeration(field):
    text = "tel 988-555-2485 or 12.03.2021 x"
    (_, _, tokens), = pii.windows(text)
    segments = dict(itertools.islice(field.segments(text, tokens).items(), 6))
    n = len(tokens)

    def paths(i, prev, score):
        if i == n:
            yield score, ()
            return
        for s, rest in paths(i + 1, 0, score + field.w["next", prev, 0]):
            yield s, rest
        for (a, b), f in segments.items():
            if a == i:
                for k in field.kinds:
                    for s, rest in paths(b, k, score + field.w["next", prev, k] + field.score(f, k)):
                        yield s, ((a, b, k), *rest)

    every = list(paths(0, 0, 0.0))
    best = max(every)
    assert tuple(field.decode(n, segments)) == best[1]
    total = math.log(sum(math.exp(s - best[0]) for s, _ in every)) + best[0]
    gold = best[1]
    copy = pii.Field(dict(field.w))
    assert copy.gradient_step(n, segments, set(gold), 0.0, defaultdict(float)) == pytest.approx(best[0] - total, abs=1e-9)


def test_added_spans(field):
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.find_spans(t, field)[1]]
    assert found("call (988) 555-2485 today") == [("phone", "(988) 555-2485")]
    assert found("write to bob.smith (at) mail.example.com today") == [("email", "bob.smith (at) mail.example.com")]
    for clean in ("It was 2019-2020, or 12.03.2021.", "version 3.14.15 costs 1,234,567", "Licensed under CC BY-NC 4.0.", "ISBN 978-3-16-148410-0",
                  'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "password=e3b3ed3cc8548923d6", "chapter 12 of 345 pages"):
        assert pii.find_spans(clean, field)[1] == [], clean


def test_clean_documents_stay(spark, field):
    docs = [r for r in table(spark, SF_SMALL.replace("0.001", "0.01"), "documents").collect()]
    added = [pii.find_spans(r.text, field)[1] for r in docs]
    assert sum(map(len, added)) <= 0.01 * len(docs)


def test_digest_and_redact(spark, edge_docs, no_docs, field):
    more = spark.createDataFrame([(i + 100, t, "en", "s", len(t), None, None, None, None, None) for i, t in enumerate(TEXTS)], edge_docs.schema)
    docs = edge_docs.union(more)
    rows = docs.collect()
    got = pii.digest(docs).collect()
    want = []
    for r in rows:
        base = plain_base(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((r.doc_id, *(sum(k == x for k, _, _ in base) for x in pii.KINDS), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert len([s for s in r.spans.split(",") if s]) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
    clean = pii.redact(docs).collect()
    assert len(clean) == len(rows) and list(clean[0].asDict()) == docs.columns
    by_id = {r.doc_id: r for r in clean if r.doc_id and r.doc_id >= 100}
    assert by_id[103].text == "<phone> <phone> +1 2" and by_id[103].n_chars == len(by_id[103].text)
    for r in clean:
        assert not plain_base(r.text or "")
    assert {r.doc_id: r.text for r in clean}[3] is None
    assert pii.digest(no_docs).count() == 0 and pii.redact(no_docs, {}).count() == 0


def test_long_spellings_are_found_whole(field):
    """Every spelling that ``_respell`` makes is a candidate, however many
    labels the host has."""
    rng = random.Random(1)
    for base in ("jane.doe@cs.uni.edu", "bob@mail.example.co.uk", "a.b-c_d.e+f.g-h.i@x.y.z.uni.ac.uk",
                 "john.doe@mail.long-department-name.university-of-somewhere.state.example.com"):
        for s in {pii._respell("email", base, rng) for _ in range(40)}:
            text = f"please write to {s}, or call us"
            (_, _, tokens), = pii.windows(text)
            whole = {text[tokens[i][0]:tokens[j - 1][1]] for i, j in field.segments(text, tokens)}
            assert s in whole, s
    for s in ("jane.doe [at] cs [dot] uni [dot] edu", "bob [at] mail [dot] example [dot] co [dot] uk"):
        text = f"please write to {s} today"
        assert [(k, text[a:b]) for k, a, b in pii.find_spans(text, field)[1]] == [("email", s)]


def test_rare_kinds_are_learned(spark, no_docs):
    """A few cards and phones among many texts of years and prices, one of them
    copied many times."""
    rng = random.Random(4)
    rows = [f"in {rng.randint(1900, 2030)} it cost {rng.randint(100, 9999)} a piece, says number {i}" for i in range(9000)]
    rows += ["the same text of 2019 stands here very often"] * 6000
    rows += [f"call me on +1 ({rng.randint(201, 989)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} or never" for _ in range(12)]
    rows += [f"paid with {VALID[:4]} {VALID[4:8]} {VALID[8:12]} {VALID[12:]} on day {i}" for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    rare = pii.Field(pii.learn(docs))
    text = "call (988) 555-2485 today"
    assert [(k, text[a:b]) for k, a, b in pii.find_spans(text, rare)[1]] == [("phone", "(988) 555-2485")]
    assert pii.learn(no_docs) == {}


def test_long_runs_end_and_windows_do_not_overlap():
    import time

    from wardline.llm import pii

    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.1.2.3") == [("ip", 0, 5006)]
    assert pii.base_spans(f"9{zeros}.1.2.3") == []
    field = pii.Field({("bias", 4): 5.0})  # every number is a phone
    for n in (2, 4, 8):
        line = "我的号码是，" + "，或者、".join(f"555-123-45{i:02d}" for i in range(n)) + "。谢谢"
        spans = pii.find_spans(line, field)[1]
        assert len(spans) == len(set(spans)) and all(b <= c for (_, _, b), (_, c, _) in zip(spans, spans[1:]))
        pieces = list(pii.windows(line))
        assert all(hi <= lo for (_, hi, _), (lo, _, _) in zip(pieces, pieces[1:]))
    for line in ("5551234" * 14_000, "a1." * 30_000, "x@" + "b." * 40_000 + "org", "(" * 80_000 + "12", "号12345码" * 14_000, "a" * 100_000 + " @"):
        began = time.process_time()
        pii.find_spans(line, pii.Field())
        assert time.process_time() - began < 20


def test_faster_patterns_find_the_same_matches():
    import random

    from wardline.llm import pii

    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "b.c", "@", "%", "1", "23", ".", "-", "_", " ", "x@y.z", "1.2.3.4", "+"], k=rng.randint(1, 14)))
        for kind, pattern in pii._COMPILED.items():
            assert [m.span() for m in pii._matches(kind, text)] == [m.span() for m in pattern.finditer(text)], text


def test_draws_let_go_of_earlier_stages():
    from wardline.llm import common
    from wardline.llm.pii import _draws

    common.kept_in_worker("model of an earlier stage", object)
    list(_draws(1)(iter([])))
    assert not common._kept
