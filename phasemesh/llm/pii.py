"""Personal data in whole texts, also where it is disguised: e-mail and IP addresses, card and phone numbers.

A text goes through transducers, each of which rewrites it and keeps, for every character that it gives, the range of
source characters that it stands for: look-alike letters, foreign digits, odd spaces and invisible characters are folded;
spelled digits become digits; ``[at]`` and ``dot`` become ``@`` and ``.``.  Identifiers are detected in what comes out and
their spans are mapped back to the source, so that what is redacted is the disguised text itself.

Base spans are those that fixed patterns find in the text as written.  They always stay.  Spans that only the transducers
(or a look at the groups of a chain of digits that failed as a whole) bring to light are added to them, unless a base span
of the same kind holds them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

KINDS = ("email", "ip", "card", "phone")

#: Letters that look like the Latin ones under them.
LOOK_ALIKES = (
    ("АВЕКМНОРСТУХІЈЅаеорсухіјѕһԁԛԝ", "ABEKMHOPCTYXIJSaeopcyxijshdqw"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυχι", "ABEZHIKMNOPTYXavopuxi"),
    ("·•‧∙⋅。｡․۔", "........."),
)
#: Digits in words.
SPELLED = {
    "0": ("zero", "null", "cero", "zéro"),
    "1": ("one", "eins", "uno", "un"),
    "2": ("two", "zwei", "zwo", "dos", "deux"),
    "3": ("three", "drei", "tres", "trois"),
    "4": ("four", "vier", "cuatro", "quatre"),
    "5": ("five", "fünf", "cinco", "cinq"),
    "6": ("six", "sechs", "seis"),
    "7": ("seven", "sieben", "siete", "sept"),
    "8": ("eight", "acht", "ocho", "huit"),
    "9": ("nine", "neun", "nueve", "neuf"),
}
TIMES = {"double": 2, "triple": 3}
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punto", "punkt", "point")
#: Last labels of domains that an address in plain words ("me at site dot org") must end in.
TOP_LABELS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "dev", "app", "io", "ai", "co", "tv", "eu",
    "uk", "us", "de", "fr", "es", "it", "nl", "be", "ch", "at", "cz", "pl", "pt", "se", "no", "dk", "fi", "ie", "ru", "ua",
    "cn", "jp", "kr", "in", "br", "mx", "ar", "ca", "au", "nz", "za",
)

_DELETED = 0xFFFFFFFF


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What each character is folded to, and what lower case alone makes of it."""
    lower = np.arange(0x110000, dtype=np.uint32)
    fold = lower.copy()
    for c in range(0x20000):
        char = chr(c)
        small = char.lower()
        if len(small) == 1:
            lower[c] = ord(small)
        if c < 128:
            continue
        kind, like = unicodedata.category(char), unicodedata.normalize("NFKC", char)
        if kind == "Cf":
            fold[c] = _DELETED
        elif kind == "Zs":
            fold[c] = 32
        elif kind == "Pd" or char == "−":
            fold[c] = 45
        elif kind == "Nd":
            fold[c] = 48 + unicodedata.decimal(char)
        elif len(like) == 1 and ord(like) < 128:
            fold[c] = ord(like)
    for odd, plain in LOOK_ALIKES:
        for a, b in zip(odd, plain, strict=True):
            fold[ord(a)] = ord(b)
    seen = fold != _DELETED
    fold[seen] = lower[fold[seen]]
    return fold, lower


class Tape(NamedTuple):
    """A rewritten text and, for each of its characters, the source range it stands for (None: the same place)."""

    text: str
    start: np.ndarray | None = None
    end: np.ndarray | None = None

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source range of the characters from ``a`` to before ``b``."""
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")


def fold(text: str) -> tuple[Tape, bool]:
    """Lower-cased text without look-alikes, and whether more than its case changed."""
    table, lower = _tables()
    codes = _codes(text)
    folded = table[codes]
    if text.isascii() or np.array_equal(folded, lower[codes]):
        return Tape(_text(folded)), False
    keep = np.flatnonzero(folded != _DELETED).astype(np.int32)
    if len(keep) == len(codes):
        return Tape(_text(folded)), True
    return Tape(_text(folded[keep]), keep, keep + 1), True


def rewrite(tape: Tape, edits: Iterator[tuple[int, int, str]]) -> Tape:
    """The tape with ranges replaced, ``(from, to, characters)`` in ascending order; each new character stands for the
    source of the whole range, unless there are as many new characters as parts of the range are given one by one.
    """
    texts, starts, ends, at = [], [], [], 0
    n = len(tape.text)
    start = np.arange(n, dtype=np.int32) if tape.start is None else tape.start
    end = start + 1 if tape.end is None else tape.end
    for a, b, new in edits:
        if a < at or (b == a and not new):
            continue
        texts += [tape.text[at:a], new]
        starts += [start[at:a], np.full(len(new), start[a], np.int32)]
        ends += [end[at:a], np.full(len(new), end[b - 1], np.int32)]
        at = b
    if not texts:
        return tape
    texts.append(tape.text[at:])
    return Tape("".join(texts), np.concatenate([*starts, start[at:]]), np.concatenate([*ends, end[at:]]))


def _any(words) -> str:
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


_VALUE = {word: digit for digit, words in SPELLED.items() for word in words}
_WORD = re.compile(rf"\b(?:(?P<times>{_any(TIMES)})[ -])?(?P<word>{_any(_VALUE)})\b")
_BEFORE_RUN = re.compile(rf"(?:[0-9]|\b(?P<word>{_any(DOT_WORDS)}|plus))[ -]?\Z")
_AFTER_RUN = re.compile(rf"[ -]?(?:[0-9]|(?P<word>{_any(DOT_WORDS)})\b)")
_PLUS = re.compile(r"\bplus ?(?=[0-9])")
_AROUND = r"[ \t]{0,3}"
_BRACKETED = re.compile(rf"{_AROUND}[\[({{<]{_AROUND}(?:(?P<at>{_any(AT_WORDS)}|@)|(?:{_any(DOT_WORDS)}|\.)){_AROUND}[\])}}>]{_AROUND}")
_SPACED = re.compile(r"(?<=[a-z0-9_-])[ \t]{1,3}@[ \t]{1,3}(?=[a-z0-9])|(?<=[a-z0-9_-])[ \t]{1,3}@(?=[a-z0-9])|(?<=[a-z0-9_-])@[ \t]{1,3}(?=[a-z0-9])")
_DIGIT_DOT = re.compile(rf"(?<=[0-9])[ \t]{{0,3}}\b(?:{_any(DOT_WORDS)})\b[ \t]{{0,3}}(?=[0-9])|(?<=[0-9])[ \t]{{1,3}}(?:{_any(DOT_WORDS)})[ \t]{{1,3}}(?=[0-9])")
_DOT = re.compile(rf"[ \t]{{1,3}}(?:{_any(DOT_WORDS)})[ \t]{{1,3}}")
_AT = re.compile(rf"[ \t]{{1,3}}(?:{_any(AT_WORDS)})[ \t]{{1,3}}")
_LOCAL = re.compile(rf"(?:[a-z0-9_%+-]{{1,64}}(?:{_DOT.pattern}|\.)){{0,4}}[a-z0-9_%+-]{{1,64}}\Z")
_DOMAIN = re.compile(rf"[a-z0-9-]{{1,63}}(?:(?:{_DOT.pattern}|\.)[a-z0-9-]{{1,63}}){{1,6}}")
#: Characters before a plain "at" that are looked at for the name.
_BEFORE = 330


def _runs(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Edits of each run of spelled digits; the space or hyphen before a digit belongs to it, so that it goes."""
    run: list[tuple[int, int, str]] = []
    for m in _WORD.finditer(text):
        first, last = m.start(), run[-1][1] if run else -1
        if run and text[last:first] in (" ", "-"):
            first = last
        elif run and text[last:first] in (" oh ", "-oh-"):
            run.append((last, first - 1, "0"))
            first -= 1
        elif run:
            yield run
            run = []
        run.append((first, m.end(), _VALUE[m["word"]] * TIMES.get(m["times"], 1)))
    if run:
        yield run


def spelled_digits(tape: Tape) -> Tape:
    """``four double two`` becomes ``422``, ``plus 4`` becomes ``+4``; spaces and hyphens between spelled digits go.

    A lone word for a digit stays a word unless ``dot`` or ``plus`` is beside it, or digits are on both sides.
    """
    text = tape.text

    def meant(run: list) -> bool:
        before, after = _BEFORE_RUN.search(text[max(0, run[0][0] - 8) : run[0][0]]), _AFTER_RUN.match(text, run[-1][1])
        return len(run) > 1 or bool(before and before["word"] or after and after["word"] or before and after)

    chosen = (run for run in _runs(text) if meant(run))
    out = rewrite(tape, (edit for run in chosen for edit in run))
    return rewrite(out, ((m.start(), m.end(), "+") for m in _PLUS.finditer(out.text))) if "plus" in text else out


def disguises(tape: Tape) -> Tape:
    """``(at)`` and ``[dot]`` anywhere; ``dot`` in words between digits; and both in plain words where all of it reads as
    an address that ends in one of TOP_LABELS.  At-signs lose the spaces around them.
    """
    text = tape.text
    if any(c in text for c in "[({<"):
        tape = rewrite(tape, ((m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)))
    if any(w in tape.text for w in DOT_WORDS):
        tape = rewrite(tape, ((m.start(), m.end(), ".") for m in _DIGIT_DOT.finditer(tape.text)))
        if _DOT.search(tape.text):
            tape = rewrite(tape, _plain(tape.text))
    if "@" in tape.text:
        tape = rewrite(tape, ((m.start(), m.end(), "@") for m in _SPACED.finditer(tape.text) if _top(tape.text, m.end())))
    return tape


def _top(text: str, at: int) -> bool:
    """Whether a domain that ends in a known label stands here."""
    m = _DOMAIN.match(text, at)
    return bool(m) and re.split(r"[. \t]", m[0])[-1] in TOP_LABELS


def _plain(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits of addresses that are written with ``dot`` in words after ``at`` (or after an at-sign)."""
    for m in re.finditer(rf"{_AT.pattern}|{_AROUND}@{_AROUND}", text):
        low = max(0, m.start() - _BEFORE)
        name, domain = _LOCAL.search(text[low : m.start()]), _DOMAIN.match(text, m.end())
        if not name or not domain or not _DOT.search(domain[0]):
            continue
        # the domain ends at its last known label
        ends = [d for d in re.finditer(r"[a-z0-9-]+", domain[0]) if d[0] in TOP_LABELS and d.start()]
        if not ends:
            continue
        stop = m.end() + ends[-1].end()
        for d in _DOT.finditer(text, low + name.start(), m.start()):
            yield d.start(), d.end(), "."
        yield m.start(), m.end(), "@"
        for d in _DOT.finditer(text, m.end(), stop):
            yield d.start(), d.end(), "."


# --- detection --------------------------------------------------------------------------------------------------------

_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SITE = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]+")
#: How card numbers are printed in groups.
CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 5), (6, 13))

Found = Iterator[tuple[int, int]]


def emails(text: str) -> Found:
    """Linear in the text: every at-sign is looked at once, the name before it no further than the last match."""
    at, free = text.find("@"), 0
    while at >= 0:
        first = at
        while first > free and text[first - 1] in _NAME:
            first -= 1
        site = _SITE.match(text, at + 1) if first < at else None
        if site:
            yield first, site.end()
            free = site.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Found:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def _chain(m: re.Match, low: int, high: int) -> str | None:
    """The digits of a match if there are from ``low`` to ``high``; their number is known without building long texts."""
    digits = "".join(_GROUP.findall(m[0])) if m.end() - m.start() <= 64 * high else ""
    return digits if low <= len(digits) <= high else None


def cards(text: str) -> Found:
    for m in _CARD.finditer(text):
        if (digits := _chain(m, 13, 19)) and luhn(digits):
            yield m.span()


def phones(text: str) -> Found:
    for m in _PHONE.finditer(text):
        if _count(m[0], 16) in range(9, 16):
            yield m.span()


def _count(text: str, stop: int) -> int:
    """Digits in a text, counted up to ``stop``."""
    n = 0
    for _ in re.finditer("[0-9]", text):
        n += 1
        if n == stop:
            break
    return n


def grouped_cards(text: str) -> Found:
    """Cards within chains of digits that fail as a whole: one group of 13 to 19 digits, or groups as cards print them."""
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13 or ((digits := _chain(m, 13, 19)) and luhn(digits)):
            continue
        groups, k = list(_GROUP.finditer(text, m.start(), m.end())), 0
        while k < len(groups):
            sizes = [g.end() - g.start() for g in groups[k : k + 5]]
            shapes = [1] * (13 <= sizes[0] <= 19) + [len(s) for s in CARD_GROUPS if tuple(sizes[: len(s)]) == s]
            n = next((n for n in sorted(shapes, reverse=True) if luhn("".join(g[0] for g in groups[k : k + n]))), 0)
            if n:
                yield groups[k].start(), groups[k + n - 1].end()
            k += n or 1


def grouped_phones(text: str) -> Found:
    """Phone numbers at the beginning of chains that fail as a whole: as many groups as 15 digits allow, 9 at least, and
    none from where a card begins.
    """
    long = [m for m in _PHONE.finditer(text) if _count(m[0], 16) > 15]
    begun = {a for find in (cards, grouped_cards) for a, _ in find(text)} if long else ()
    for m in long:
        n, stop = 0, None
        for g in _GROUP.finditer(text, m.start(), m.end()):
            n += g.end() - g.start()
            if n > 15 or g.start() in begun:
                break
            if n >= 9:
                stop = g.end()
        if stop:
            yield m.start(), stop


BASE: dict[str, Callable[[str], Found]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}
MORE: dict[str, Callable[[str], Found]] = {"card": grouped_cards, "phone": grouped_phones}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool


def normalize(text: str) -> Tape | None:
    """The text after all transducers; None where nothing but its case changes."""
    folded, changed = fold(text)
    out = disguises(spelled_digits(folded))
    return out if changed or out is not folded else None


def _alone(text: str, a: int, b: int) -> bool:
    """Whether no letter of another alphabet touches the range: what was folded is then no part of a foreign word."""
    before, after = text[a - 1 : a], text[b : b + 1]
    return not (before > "\x7f" and before.isalnum()) and not (after > "\x7f" and after.isalnum())


def spans(text: str | None) -> list[Span]:
    """All spans of a text by kind, then start, then end; positions are code points, ends exclusive."""
    text = text or ""
    tape = normalize(text)
    out = []
    for kind in KINDS:
        base = list(BASE[kind](text))
        added = set(MORE.get(kind, lambda t: ())(text))
        if tape is not None:
            for find in (BASE[kind], MORE.get(kind)):
                added |= {tape.source(a, b) for a, b in (find(tape.text) if find else ()) if _alone(tape.text, a, b)}
        kept, i = [], 0
        for a, b in sorted(added):
            while i < len(base) and base[i][1] <= a:
                i += 1
            if not (i < len(base) and base[i][0] <= a and b <= base[i][1]):
                kept.append(Span(kind, a, b, False))
        out += sorted([*(Span(kind, a, b, True) for a, b in base), *kept])
    return out


# --- tables -----------------------------------------------------------------------------------------------------------

_SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


class _Annotate:
    def __init__(self, redacted: bool):
        self.redacted = redacted

    def __call__(self, batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [spans(t.as_py()) for t in texts]
            columns = [batch.column(0), pa.array([[s._asdict() for s in f] for f in found], _ARROW_SPANS)]
            if self.redacted:
                columns.append(pa.array([None if not t.is_valid else redact_text(t.as_py(), f) for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "text"][: len(columns)])


def redact_text(text: str, found: list[Span]) -> str:
    """The text with every span, and what overlaps it, replaced by the kind of the first in brackets."""
    out, at = [], 0
    for s in sorted(found, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def annotate(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs(doc_id, text)``, and ``text`` with the spans blanked out if asked for.

    Rows that repeat a doc_id, or have none, are judged one by one; a null or empty text has no spans (and stays null or
    empty); other columns are left out, also those whose names differ only by case; an empty table gives no rows.  Texts
    are read whole, and each in time that grows with its length alone.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    kind = docs.schema[store.only(docs, "doc_id").columns[0]].dataType.simpleString()
    return store.only(docs, "doc_id", "text").mapInArrow(_Annotate(redacted), f"doc_id {kind}, spans {_SPANS}" + ", text string" * redacted)


def _listed(found: Column) -> Column:
    """``kind:start:end`` of all, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, the numbers of base spans of each kind, the hash of all base spans, all spans, and how many were added."""
    found = annotate(docs)
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[F.expr(f"bigint(size(filter(spans, s -> s.base AND s.kind = '{k}'))) AS n_{k}") for k in KINDS],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
