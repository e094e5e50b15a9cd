"""Token ids of whole texts with a public byte-level BPE vocabulary.

The vocabulary's pre-tokenizer never lets a token cross the border before a
single blank, so a text is cut there and every distinct piece goes through the
``tokenizers`` library once; a bounded dictionary keeps the ids of pieces seen.
"""

from __future__ import annotations

import os
from array import array
from itertools import chain, islice

import numpy as np
import public_tokenizers
import regex as re
from tokenizers import Tokenizer, pre_tokenizers

from wardline.llm.common import kept_in_worker

# Spark runs one task per core; threads inside a task would only compete.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "byte_bpe_50k.json"
#: A blank with no other blank beside it: the only place where texts are cut.
_LONE_BLANK = re.compile(r"(?<! ) (?! )")
_WORD_AND_SIGNS = re.compile(r"(\p{L}+)([^\s\p{L}\p{N}]+)")
_TWO_LINES = re.compile(r"(\p{L}+)([.,;:!?]*)\n(\p{L}+)([.,;:!?]*)")
_SIGNS = frozenset(".,;:!?")
#: Pieces kept per worker, and the longest piece worth keeping.
KEPT_PIECES = 500_000
KEPT_LENGTH = 48


#: The byte-level vocabulary's characters for bytes: printable Latin-1 stands
#: for itself, the others follow from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELT = np.arange(256, dtype="<u4")
_SPELT[sorted(set(range(256)) - _PRINTABLE)] = 0x100 + np.arange(256 - len(_PRINTABLE))
_SPELT[10] = 10  # cuts words apart


class PieceEncoder:
    """``encode(texts)``: for each text its ids as little-endian uint32 bytes.

    Strings of special tokens inside a text are ordinary text.  Pieces met a
    second time move from a small dictionary, which is emptied when full, to
    the large one, so words seen once do not fill it."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        blank = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        size = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(blank) for i in range(size)])
        self.lean = Tokenizer.from_file(path)
        self.lean.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.lean.encode_special_tokens = True
        self.line_end = array("I", self.tokenizer.encode("\n", add_special_tokens=False).ids).tobytes()
        self.kept = kept
        self.known: dict[str, bytes] = {}  # piece without its blank -> ids of the piece with it
        self.recent: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], blank: str = " ") -> list[bytes]:
        """Ids of ``blank`` + word for words of letters, which the vocabulary's
        pre-tokenizer never cuts: all in one text of words already spelt in its
        characters for bytes, which a copy of the tokenizer cuts at white space
        only.  Every word has a blank's or another known id in front, where the
        ids fall apart."""
        if not words:
            return []
        spelt = blank + ("\n" + blank).join(words)
        spelt = _SPELT[np.frombuffer(spelt.encode(), np.uint8)].tobytes().decode("utf-32-le")
        encode = self.lean.encode_batch_fast if blank else self.lean.encode_batch  # the fast one has no word numbers
        encoding = encode([spelt], add_special_tokens=False)[0]
        ids = np.asarray(encoding.ids, "<u4")
        at = np.flatnonzero(self.opens[ids]) if blank else np.flatnonzero(np.diff(np.asarray(encoding.word_ids, np.int64), prepend=-1))
        raw, at = ids.tobytes(), (4 * at).tolist()
        return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]

    def _look_up(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces not yet known.  A word with signs behind it is two
        tokens of the pre-tokenizer, so both are looked up alone; so are the
        two sides of a line end that has no other white space beside it."""
        words, others, parts, lines = set(), [], {}, {}
        for p in pieces:
            if p.isalpha():
                words.add(p)
            elif p[-1:] in _SIGNS and p[:-1].isalpha():
                parts[p] = p[:-1], p[-1]
            elif m := _WORD_AND_SIGNS.fullmatch(p):
                parts[p] = m.groups()
            elif m := _TWO_LINES.fullmatch(p):
                lines[p] = m.groups()
            else:
                others.append(p)
        words.update(w for w, _ in parts.values())
        words.update(w for w, _, _, _ in lines.values())
        signs = list({x for _, x in parts.values()} | {x for _, x, _, y in lines.values() for x in (x, y)})
        order = list(words.difference(self.known))
        found = dict(zip(order, self._words(order)))
        found.update(zip(others, self._whole([" " + p for p in others])))
        of_signs = dict(zip(signs, self._whole(signs)))
        heads = list({w for _, _, w, _ in lines.values()})
        of_heads = dict(zip(heads, self._words(heads, "")))
        word_ids = lambda w: found[w] if w in found else self.known[w]
        for p, (word, x) in parts.items():
            found[p] = word_ids(word) + of_signs[x]
        for p, (word, x, head, y) in lines.items():
            found[p] = word_ids(word) + of_signs[x] + self.line_end + of_heads[head] + of_signs[y]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") if "  " not in t else _LONE_BLANK.split(t) for t in texts]
        heads = self._whole([parts.pop(0) for parts in cut])
        flat = list(chain.from_iterable(cut))
        ids = list(map(self.known.get, flat))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            pieces = {flat[i] for i in missing}
            again = {p: self.recent[p] for p in pieces if p in self.recent}
            new = self._look_up(pieces.difference(again))
            new.update(again)
            for i in missing:
                ids[i] = new[flat[i]]
            self.known.update(islice(again.items(), max(0, self.kept - len(self.known))))
            if len(self.recent) > self.kept // 2:
                self.recent.clear()
            self.recent.update((p, x) for p, x in new.items() if len(p) <= KEPT_LENGTH)
        out, at = [], 0
        for head, parts in zip(heads, cut):
            out.append(head + b"".join(ids[at:at + len(parts)]))
            at += len(parts)
        return out


def encoder(name: str = VOCABULARY) -> PieceEncoder:
    """One per Python worker; ``name``: a public vocabulary or a path."""
    return kept_in_worker(f"pieces {name}", lambda: PieceEncoder(name if "/" in name else public_tokenizers.path(name)))
