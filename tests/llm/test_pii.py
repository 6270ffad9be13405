"""Personal data: base spans against plain patterns, disguises planted in random texts, hostile rows."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phasemesh.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def base(text):
    return [s[:3] for s in pii.spans(text) if s.base]


@settings(max_examples=1500, deadline=None)
@given(st.text("ab@@..-_+ 0123456789()é\n", max_size=60))
def test_base_equals_the_patterns(text):
    assert base(text) == plain_base(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    found = pii.spans(text)
    assert [s[:3] for s in found if s.base] == plain_base(text)
    assert all(0 <= s.start < s.end <= len(text) for s in found)
    assert found == sorted(found, key=lambda s: (pii.KINDS.index(s.kind), s.start, s.end))


WORDS = {d: words[0] for d, words in pii.SPELLED.items()}


def disguised(rng, kind):
    """An identifier and a disguise of it."""
    name, site = "".join(rng.choices("acdeghjpqx", k=6)) + str(rng.randrange(10, 99)), "".join(rng.choices("acehjpqx", k=7))
    if kind == "email":
        plain = f"{name}@{site}.example.org"
        way = rng.randrange(5)
        if way == 0:
            at, dot = rng.choice([" [at] ", "(at)", " { arroba } ", "<at>", "[@]"]), rng.choice([" [dot] ", "(dot)", " (punto) ", "[.]"])
            return plain.replace("@", at).replace(".", dot)
        if way == 1:
            return plain.replace("@", " at ").replace(".", " dot ")
        if way == 2:
            table = {"a": "а", "c": "с", "e": "е", "p": "р", "x": "х", "o": "о"}
            hidden = "".join(table.get(c, c) for c in plain)
            return hidden if hidden != plain else plain.replace("@", "＠")
        if way == 3:
            return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in plain)
        return plain.replace("@", "​@­")
    if kind == "ip":
        plain = ".".join(str(rng.randrange(256)) for _ in range(4))
        if rng.random() < 0.5:
            return plain.replace(".", rng.choice(["[.]", " dot ", " (dot) ", "。"]))
        return " dot ".join(" ".join(WORDS[d] for d in part) for part in plain.split("."))
    if kind == "card":
        while not luhn(digits := "4" + "".join(rng.choices("0123456789", k=15))):
            pass
        if rng.random() < 0.5:
            return " ".join(WORDS[d] for d in digits)
        return "".join(chr(0x660 + int(d)) for d in digits)
    digits = "49" + "".join(rng.choices("0123456789", k=9))
    if rng.random() < 0.5:
        return "plus " + "-".join(WORDS[d] for d in digits)
    return "＋" + "".join(chr(0x966 + int(d)) for d in digits)


@pytest.mark.parametrize("kind", pii.KINDS)
def test_planted_disguises(kind):
    """What is planted among words is found with its exact place, and nothing else."""
    rng = random.Random(kind)
    vocabulary = ["blether", "anou", "thin", "été", "größer", "niño", "at", "the", "dot", "un", "Москва", "one", "(see)", "\n"]
    for _ in range(400):
        hidden = disguised(rng, kind)
        # a joint that no transducer reads as part of the identifier stands on both sides
        before, after = (" ".join(rng.choices(vocabulary, k=rng.randrange(8))) for _ in range(2))
        text = f"{before} ; {hidden} ; {after}"
        start = len(before) + 3
        assert [(s.kind, text[s.start : s.end], s.start) for s in pii.spans(text) if s.kind == kind] == [(kind, hidden, start)], text


def test_left_alone():
    for text in (
        "look at the dot and so on", "we met at noon dot then left", "мама@почта.рф", "see (at) home", "version 2 dot one", "un deux trois",
        "buy shoes at example.com", "4 of 5 at 6 dot 7", "one two three four five", "a at b dot zzz", "sale @ noon. Then",
    ):
        assert pii.spans(text) == [], text


def test_base_stays_and_more_is_added():
    chain = "+1 (269) 555-3296 4111 1111 1111 1111"
    assert [(s.kind, chain[s.start : s.end], s.base) for s in pii.spans(chain)] == [("card", "4111 1111 1111 1111", False), ("phone", "+1 (269) 555-3296", False)]
    longer = "me@example.com (dot) uk"
    assert [(longer[s.start : s.end], s.base) for s in pii.spans(longer)] == [("me@example.com", True), ("me@example.com (dot) uk", False)]
    assert pii.redact_text(longer, pii.spans(longer)) == "[email]"
    assert pii.redact_text("a me@x.de b ME [at] x [dot] de", pii.spans("a me@x.de b ME [at] x [dot] de")) == "a [email] b [email]"


@pytest.mark.parametrize("piece", ["a", "9", "9 ", "+1 ", "@", "a@", "a.", "1.", " at ", " dot ", "one ", "[", " ", "x@y."])
def test_time_grows_with_the_text_alone(piece):
    took = []
    for n in (40_000, 320_000):
        text = piece * (n // len(piece))
        pii.spans(text[:100])
        start = time.perf_counter()
        pii.spans(text)
        took.append(time.perf_counter() - start)
    assert took[1] < 40 * max(took[0], 0.02)


def test_rows(spark, docs):
    texts = ["mail me@example.com or 10.0.0.1", None, "", "mail me@example.com or 10.0.0.1", "card 4111111111111111, +49 30 1234567", "x " * 50_000 + "you (at) example (dot) com"]
    got = pii.digests(docs(*texts, ids=[1, 2, 3, 1, None, 6])).collect()
    assert len(got) == 6
    want = []
    for i, t in zip([1, 2, 3, 1, None, 6], texts):
        found = plain_base(t)
        counts = [sum(k == kind for k, *_ in found) for kind in pii.KINDS]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        spans = listed if i != 6 else "email:100000:100026"
        want.append((i, *counts, hashlib.sha256(listed.encode()).hexdigest(), spans, int(i == 6)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pii.digests(docs("a").limit(0)).collect() == []
    redacted = {r.doc_id: r.text for r in pii.annotate(docs(*texts, ids=range(6)), redacted=True).collect()}
    assert redacted[0] == "mail [email] or [ip]" and redacted[1] is None and redacted[2] == "" and redacted[4] == "card [card], [phone]"
    assert redacted[5] == "x " * 50_000 + "[email]"


def test_query(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op11_pii_spans(spark, tiny).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        found = plain_base(texts[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k, a, b in found]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in found) for kind in pii.KINDS)
        assert set(listed) <= set(filter(None, r.spans.split(",")))
