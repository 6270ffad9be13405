"""Token ids of whole texts with the ``tokenizers`` library.

Text is mostly the same words again and again, and the library spends its time on each of them anew.  For tokenizers
whose pre-tokenizer provably never joins what a single space separates, the library therefore encodes each distinct
space-separated piece once per worker and the ids are joined; texts for which that does not hold (double spaces, other
white space next to a space, strings of special tokens), and all texts under any other tokenizer, are encoded whole.
The ids are the same in either case.
"""

from __future__ import annotations

import json
import os
from array import array
from operator import attrgetter
from string import punctuation

from . import store

#: Pieces that a worker keeps at most (half of them go when it is full), the longest piece kept, and the size of the
#: table that tells a piece's second appearance, from which on it is kept.
MEMO_PIECES, MEMO_CHARS, SEEN = 400_000, 64, 1 << 22
#: Stands between pieces that are encoded together under a tokenizer that drops spaces; digits are words of their own.
SEPARATOR = "0"

#: Letters that no normalizer here turns into anything but one letter; punctuation after them is always cut off.  (Others
#: are not safe: a capital I with a dot becomes a small i and a mark, which stays with the punctuation.)
LETTERS = frozenset(c for c in map(chr, range(256)) if c.isalpha())

_ID = attrgetter("id")
_ENCODERS: dict[str, Encoder] = {}


def tokenizer_path(name: str) -> str:
    """Place of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; made once."""
    store.claim("tokens", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _spacy(c: str) -> bool:
    return c.isspace() or c in "᠎​﻿"


def separable(spec: dict) -> str | None:
    """How a tokenizer file treats single spaces: ``lead`` (part of the next piece), ``drop`` (discarded) or ``None``.

    ``lead``: byte-level pre-tokenizer with its own regular expression, no normalizer.  ``drop``: normalizers that look
    at single characters only, and a split that keeps runs without white space.
    """
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return "lead"
    steps = pre.get("pretokenizers", [])
    norms = {n["type"] for n in (norm or {}).get("normalizers", [])}
    if (
        pre.get("type") == "Sequence"
        and len(steps) == 2
        and steps[0]["type"] == "Split"
        and steps[0].get("invert")
        and steps[0]["behavior"] == "Removed"
        and "\\s" in steps[0]["pattern"].get("Regex", "")
        and steps[1]["type"] == "ByteLevel"
        and not steps[1].get("use_regex", True)
        and not steps[1].get("add_prefix_space")
        and norms <= {"NFC", "Replace", "Lowercase"}
    ):
        return "drop"
    return None


class Encoder:
    """Whole texts to bytes of little-endian unsigned 32-bit ids; null counts as empty."""

    def __init__(self, path: str, memo: bool = True):
        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.mode = separable(spec) if memo else None
        self.memo: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.tokenize, self.lead = self.tokenizer.model.tokenize, "\u0120" if self.mode == "lead" else ""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level BPE
        self.alphabet = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.bare: dict[str, bytes] = {}  # pieces without a space before them
        self.seen = bytearray(SEEN)
        self.newline = self._ids("\n").tobytes()
        if self.mode == "lead":
            vocab = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin with a space
            self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        elif self.mode == "drop":
            got = self._ids(SEPARATOR)
            self.mode, self.between = ("drop", got[0]) if len(got) == 1 else (None, None)

    def _ids(self, text: str):
        import numpy as np

        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _together(self, pieces: list[str]) -> list[bytes] | None:
        """Ids of each piece from one call of the library, or None where the pieces do not come apart again."""
        import numpy as np

        if self.mode == "lead":
            if not all(p and not _spacy(p[0]) and not _spacy(p[-1]) for p in pieces):
                return None
            ids = self._ids(" " + " ".join(pieces))
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(pieces):
                return None
            cuts = [*(cuts * 4).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            return [data[a:b] for a, b in zip(cuts, cuts[1:])]
        if any(SEPARATOR in p for p in pieces):
            return [self._ids(p).tobytes() for p in pieces]
        ids = self._ids(f" {SEPARATOR} ".join(pieces))
        cuts = np.flatnonzero(ids == self.between)
        if len(cuts) != len(pieces) - 1:
            return None
        data, cuts = ids.tobytes(), (cuts * 4).tolist()
        return [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)])]

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.mode is None or any(s in text for s in self.special):
            return self._ids(text).tobytes()
        pieces = text.split(" ")
        head = b""
        if self.mode == "lead":
            first = pieces.pop(0)
            if not first or _spacy(first[-1]):
                return self._ids(text).tobytes()
            head = self._piece(first, self.bare, "")
        get = self.memo.get
        parts = list(map(get, pieces))
        if None in parts:
            gaps, asked, tails = [], [], []
            seen, memo, word, lead = self.seen, self.memo, self._word, self.lead
            for i in [i for i, p in enumerate(parts) if p is None]:
                stem = piece = pieces[i]
                tail = ids = None
                if piece.isalpha():
                    ids = word(piece, lead)
                elif "\n" in piece:
                    ids = self._lines(piece)
                    if ids is not None:
                        parts[i] = ids
                        continue
                else:
                    stem = piece.rstrip(punctuation)
                    if stem is not piece and stem[-1:] in LETTERS:
                        tail = self._tail(piece[len(stem) :])
                        ids = get(stem)
                        if ids is not None:
                            stem, ids, tail = piece, ids + tail, None
                        elif stem.isalpha():
                            ids = word(stem, lead)
                    else:
                        stem = piece
                if ids is None:
                    gaps.append(i)
                    asked.append(stem)
                    tails.append(tail or b"")
                    continue
                parts[i] = ids + tail if tail else ids
                slot = hash(stem) & (SEEN - 1)  # as in _keep, which is too slow to call here
                if not seen[slot]:
                    seen[slot] = 1
                elif len(memo) < MEMO_PIECES and len(stem) <= MEMO_CHARS:
                    memo[stem] = ids
                else:
                    self._keep(stem, ids, memo)
            found = self._together(asked) if asked else []
            if found is None:
                return self._ids(text).tobytes()
            for i, stem, ids, tail in zip(gaps, asked, found, tails):
                parts[i] = ids + tail
                self._keep(stem, ids, self.memo)
        return head + b"".join(parts)

    def _lines(self, piece: str) -> bytes | None:
        """Ids of a piece with line ends between other characters: each line end is a word of its own (or dropped), and
        what follows begins without a space.  None where white space stands next to a line end.
        """
        lines = piece.split("\n")
        if self.mode == "drop":
            return b"".join([self._piece(x, self.memo, "") for x in lines])
        # the same parts without any white space: none stands at a line's end; only then are single characters looked at
        if (piece.split() != lines or not piece.isascii()) and not all(x and not _spacy(x[0]) and not _spacy(x[-1]) for x in lines):
            return None
        bare = self.bare
        ids = [self.memo.get(lines[0]) or self._piece(lines[0], self.memo, self.lead)]
        ids += [bare.get(x) or self._piece(x, bare, "") for x in lines[1:]]
        return self.newline.join(ids)

    def _piece(self, piece: str, memo: dict[str, bytes], lead: str) -> bytes:
        """Ids of one piece that stands after a space (``lead``) or at the beginning of a line or text."""
        ids = memo.get(piece)
        if ids is None:
            stem = piece.rstrip(punctuation)
            tail = b""
            if stem[-1:] in LETTERS:
                tail = self._tail(piece[len(stem) :]) if len(stem) < len(piece) else b""
            else:
                stem = piece
            ids = memo.get(stem)
            if ids is None:
                ids = self._word(stem, lead) if stem.isalpha() else None
                if ids is None:
                    ids = self._ids(f" {stem}" if lead else stem).tobytes()
            ids += tail
            self._keep(piece, ids, memo)
        return ids

    def _word(self, stem: str, lead: str) -> bytes | None:
        """Ids of a piece of Latin-1 letters: one word to either kind of pre-tokenizer, so the library's model alone is
        asked, with the bytes written in its alphabet.  None for other letters.
        """
        if self.mode == "drop":
            stem = stem.lower()
        if not stem.isascii():
            try:
                stem.encode("latin-1")
            except UnicodeEncodeError:
                return None
            stem = stem.encode().decode("latin-1").translate(self.alphabet)
        return array("I", map(_ID, self.tokenize(lead + stem))).tobytes()

    def _tail(self, marks: str) -> bytes:
        """Ids of punctuation that ends a piece after one of LETTERS: both kinds of pre-tokenizer always cut there."""
        ids = self.tails.get(marks)
        if ids is None:
            ids = self._ids(marks).tobytes()
            if len(marks) <= MEMO_CHARS and len(self.tails) < 10_000:
                self.tails[marks] = ids
        return ids

    def _keep(self, piece: str, ids: bytes, memo: dict[str, bytes]) -> None:
        slot = hash(piece) & (SEEN - 1)
        if not self.seen[slot]:
            self.seen[slot] = 1
        elif len(piece) <= MEMO_CHARS:
            if len(memo) >= MEMO_PIECES:
                for old in list(memo)[: MEMO_PIECES // 2]:
                    del memo[old]
            memo[piece] = ids
