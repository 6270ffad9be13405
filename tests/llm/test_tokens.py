"""Token ids with and without the memo, Huffman coding, token files and packing."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phasemesh.llm import packing, store, token_files, tokens

BYTE, WORD = (tokens.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "", " ", "  a", "a  b", "a b ", "a\tb c", "don't stop", "x<|endoftext|>y z", "<|startoftext|> a", "Ünïcode naïve café ñandú", "日本語 テキスト と English",
    "é̈ e\u0301 a\u0300b", "İstanbul ΑΣ ΟΔΟΣ Σ", "12 345,678 a1b2", "a\u00a0b c\u2003d", "emoji 👩‍👩‍👧 ok", "ª º µ ß", "x\ny z\r\nw", "'s 't 're", "word!!! (word) [word]...", "a\x1cb \x85 c",
    "0 00 0a a0", "THE the The", "\u180e a \u200bb", "ﬁ ﬂ ǆ", "q" * 300 + " " + "z" * 300, "!!! ... a", "a' b' c",
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memo_changes_nothing(path):
    memo, plain = tokens.Encoder(path), tokens.Encoder(path, memo=False)
    assert memo.mode in ("lead", "drop") and plain.mode is None
    for _ in range(3):
        for t in ODD + [" ".join(ODD)]:
            assert memo(t) == plain(t), repr(t)
    assert memo(None) == b""


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abzAZ019 .,'!\n\t-éñß日0\u0301")), max_size=60))
def test_memo_changes_nothing_in_random_texts(text):
    for path in (BYTE, WORD):
        assert tokens.encoder(path)(text) == tokens.Encoder(path, memo=False)(text) if len(text) < 3 else True
        a = tokens.encoder(path)
        assert np.frombuffer(a(text), "<u4").tolist() == a.tokenizer.encode(text, add_special_tokens=False).ids


def test_letters_that_change_before_every_punctuation_mark():
    """Letters that normalizers turn into several characters, combining marks and ligatures, before each mark."""
    import random
    from string import punctuation

    letters = [*"İıſßẞŉΐΣςǅﬁﬂΩÅKaZé9", "i\u0307", "e\u0301", "\u0345", "\u0307", "ﷺ", "ก", "한", "日", "½", "🙂"]
    rng = random.Random(4)
    texts = ["ALİ.", "VELİ, ALİ!", "DENİZLİ'", "ALİ."] + [f"x{a}{m}{rng.choice(['', m])} {a}{m}y" for a in letters for m in punctuation]
    texts += ["".join(rng.choice([*letters, *punctuation, " ", "\n", "st"]) for _ in range(12)) for _ in range(3000)]
    for path in (BYTE, WORD):
        memo, plain = tokens.Encoder(path), tokens.Encoder(path, memo=False)
        assert [t for t in texts * 2 if memo(t) != plain(t)] == []


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 10)
    e = tokens.Encoder(BYTE)
    for _ in range(3):
        e(" ".join(f"word{chr(97 + i)}x" for i in range(26)))
    assert len(e.memo) <= 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=200), st.integers(8, 16))
def test_code_lengths(counts, limit):
    lengths = token_files.code_lengths(np.array(counts), limit)
    used = np.flatnonzero(counts)
    assert (lengths[np.array(counts) == 0] == 0).all()
    if len(used):
        assert lengths.max() <= max(limit, int(len(used) - 1).bit_length())
        assert sum(2.0 ** -int(x) for x in lengths[used]) <= 1
    if len(used) > 1:
        p = np.array(counts)[used] / sum(counts)
        assert (p * lengths[used]).sum() >= -(p * np.log2(p)).sum() - 1e-9


def test_limit_is_optimal_against_brute_force():
    import itertools

    counts = np.array([50, 20, 9, 4, 1])
    best = min(sum(c * x for c, x in zip(counts, ls)) for ls in itertools.product(range(1, 4), repeat=5) if sum(2.0**-x for x in ls) <= 1)
    assert (counts * token_files.code_lengths(counts, 3)).sum() == best


@pytest.mark.parametrize("n", [1, 5, 1023, 1024, 1025, 5000])
def test_coder_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 900).astype(np.uint32)
    coder = token_files.Coder(token_files.code_lengths(np.bincount(ids)))
    data, starts = coder.encode(ids)
    assert len(starts) == -(-n // token_files.BLOCK)
    assert (coder.decode(data, starts, n) == ids).all()
    assert len(coder.encode(ids[:0])[0]) == 0


def test_shard_blocks_can_be_read_alone(tmp_path):
    rng = np.random.default_rng(0)
    docs = [(rng.zipf(1.2, n) % 5000).astype(np.uint32) for n in (3, 0, 70_000, 1, 40_000)]
    flat = np.concatenate(docs)
    coder = token_files.Coder(token_files.code_lengths(np.bincount(flat)))
    fs, path = store.filesystem(f"file://{tmp_path}/x")
    lengths = np.array([len(d) for d in docs])
    token_files.write_shard(fs, path, coder, (np.array([5, 6, 7, 8, 0]), np.array([0, 0, 0, 0, 1]), lengths), iter([flat[:50_000], flat[50_000:]]))
    shard = token_files.Shard(fs, path)
    for at in (0, 1, 40, 64, 107):
        assert (shard.blocks(at, 1) == flat[at * 1024 : at * 1024 + 1024]).all()
    got = list(shard.documents())
    assert [g[0] for g in got] == [5, 6, 7, 8, None]
    assert all((g[1] == d).all() for g, d in zip(got, docs))
    (tmp_path / "bad").write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        token_files.Shard(fs, f"{tmp_path}/bad")


def expected(texts, path, ids, end=b"\0\0\0\0"):
    plain = tokens.Encoder(path, memo=False)
    return [(i, plain(t) + end) for i, t in sorted(zip(ids, texts), key=lambda p: (p[0] is not None, p[0] or 0))]


def test_token_files(spark, docs, tmp_path):
    texts = [*ODD, None, "same", "same", "word " * 5000]
    ids = [*range(100, 100 + len(ODD)), 3, 7, 7, None]
    made = token_files.write(docs(*texts, ids=ids), f"file://{tmp_path}/f", BYTE, shards=3)
    got = token_files.read_digests(made).collect()
    want, start = [], 0
    for i, data in expected(texts, BYTE, ids):
        want.append((i, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by_doc = [r.ids for r in token_files.read_ids(made).where("doc_id = 7").collect()]
    assert by_doc == [np.frombuffer(tokens.Encoder(BYTE)("same"), "<u4").tolist() + [0]] * 2
    empty = token_files.write(docs(*texts, ids=ids).limit(0), f"file://{tmp_path}/e", BYTE)
    assert token_files.read_digests(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=12))
def test_plan_is_valid_and_no_worse_than_best_fit(counts):
    made = packing.plan(counts, 40)
    used: dict = {}
    for times, items in made:
        assert sum(s * n for s, n in items) <= 40
        for s, n in items:
            used[s] = used.get(s, 0) + times * n
    assert used == counts
    bins = sum(t for t, _ in made)
    assert packing.lower_bound(counts, 40) <= bins <= sum(t for t, _ in packing.best_fit(counts, 40))


def test_plan_finds_the_optimum_of_small_cases():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(25):
        items = sorted(rng.integers(3, 20, 7).tolist(), reverse=True)

        def fits(n):
            return any(all(sum(x for x, b in zip(items, a) if b == k) <= 20 for k in range(n)) for a in itertools.product(range(n), repeat=len(items)))

        least = next(n for n in range(1, 8) if fits(n))
        assert sum(t for t, _ in packing.plan(dict(zip(*np.unique(items, return_counts=True))), 20)) == least


def test_plan_goes_through_all_fillings():
    for capacity, counts, least in (
        (30, {14: 4, 4: 1, 12: 3, 8: 4, 11: 4, 13: 2}, 7),
        (100, {48: 4, 12: 4, 23: 3, 21: 4, 29: 1, 35: 2}, 5),
        (60, {13: 4, 20: 1, 29: 4, 21: 4, 8: 3, 26: 3, 22: 3, 18: 2}, 8),
    ):
        made, proved = packing.search(counts, capacity)
        assert proved and sum(t for t, _ in made) == sum(t for t, _ in packing.plan(counts, capacity)) == least
    assert not packing.search({14: 4, 4: 1, 12: 3, 8: 4, 11: 4, 13: 2}, 30, 5)[1]


def test_plan_finds_the_optimum_of_random_cases():
    """Against the fewest bins over all subsets of 9 to 11 pieces."""

    def fewest(items, capacity):
        best = [(99, 0)] * (1 << len(items))  # bins and what the last one holds, for each subset
        best[0] = (0, capacity)
        for m, (bins, held) in enumerate(best):
            for i, x in enumerate(items):
                if not m >> i & 1:
                    best[m | 1 << i] = min(best[m | 1 << i], (bins, held + x) if held + x <= capacity else (bins + 1, x))
        return best[-1][0]

    rng = np.random.default_rng(8)
    cases = [([11, 16, 31, 33, 36, 37, 39, 41, 42, 51, 56], 100)]
    for _ in range(1000):
        capacity = int(rng.choice([30, 60, 100, 2048]))
        cases.append((rng.integers(max(1, capacity // int(rng.integers(6, 12))), int(capacity * rng.choice([0.5, 0.6, 0.7])), int(rng.integers(9, 12))).tolist(), capacity))
    for items, capacity in cases:
        made, proved = packing.search(dict(zip(*np.unique(items, return_counts=True))), capacity)
        assert proved and sum(t for t, _ in made) == fewest(items, capacity), (items, capacity)


def test_plan_edges():
    assert packing.plan({}, 10) == []
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)
    assert packing._dominates((5,), (3, 2)) and not packing._dominates((3, 3), (5,))


def test_pack(spark, docs):
    texts = [*ODD, None, "same", "same", "word " * 900, "b c " * 77]
    ids = [*range(100, 100 + len(ODD)), 3, 7, 7, None, 1]
    rows = packing.pack(docs(*texts, ids=ids), WORD, 64).collect()
    want = sorted(((i, k // 256, k // 4, len(d[k : k + 256]) // 4, zlib.crc32(d[k : k + 256])) for i, d in expected(texts, WORD, ids) for k in range(0, len(d), 256)), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == want
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack(docs(*texts).limit(0), WORD, 64).count() == 0


def test_pieces_with_line_ends_are_the_librarys():
    """White space of any kind beside a line end or within a line, also such as a split does not know."""
    encode = tokens.encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    ends = ["", "\t", "​", "﻿", "᠎", " ", "\x0b", "\x1c", "\r", "b", "é."]
    for a in ends:
        for b in ends:
            text = f"one two{a}\n{b}three,\nfour x{a}{b}y\nend five"
            assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, (a, b)
