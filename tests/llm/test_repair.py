"""Repair of conversations: least costs against all edits of short ones, blocks against whole ones, the query against SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from phasemesh.llm import oracles, queries, repair

FORM = re.compile(r"(s?(ua)+)?")


def all_edits(kinds):
    """(cost, letters) of every way to a good form with at most four insertions."""
    spots = len(kinds) + 1
    rows = []
    for k in kinds:
        ways = [("D", "", 4)]
        if k != "x":
            more = 3 * k.isupper()
            ways += [("K", k.lower(), more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        rows.append(ways)
    added = [("I" * n, "".join(r), 3 * n) for n in range(4) for r in itertools.product("ua", repeat=n)]
    for chosen in itertools.product(*rows):
        for ins in itertools.product(added, repeat=spots):
            if sum(len(i[0]) for i in ins) > 4:
                continue
            steps = [ins[0], *itertools.chain(*zip(chosen, ins[1:]))]
            if FORM.fullmatch("".join(s[1] for s in steps)):
                yield sum(s[2] for s in steps), "".join(s[0] for s in steps)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_least_of_all_edits(n):
    layers = repair.Layers()
    for kinds in itertools.product("xsuaoSUAO", repeat=n):
        assert layers.repair("".join(kinds)) == min(all_edits(kinds)), kinds


def plain_repair(kinds):
    """The least (cost, letters) of every state, one row after the other."""
    lead = {"": "u", "s": "u", "u": "a", "a": "u"}

    def opened(best):
        for _ in range(3):
            for p, (c, t) in list(best.items()):
                best[lead[p]] = min(best.get(lead[p], (1 << 60, "")), (c + 3, t + "I"))
        return best

    best = opened({"": (0, "")})
    for k in kinds:
        new, more, i = {}, 3 * k.isupper(), k.lower()
        for p, (c, t) in best.items():
            ways = [(p, c + 4, t + "D")]
            if k != "x":
                ways.append((lead[p], c + 3 + more, t + "R"))
                if (i, p) == ("s", "") or i == lead[p]:
                    ways.append((i, c + more, t + "K"))
            for q, c2, t2 in ways:
                new[q] = min(new.get(q, (1 << 60, "")), (c2, t2))
        best = opened(new)
    return min(best[p] for p in ("", "a") if p in best)


def test_longer_ones_and_tight_arcs():
    rng, layers = random.Random(5), repair.Layers()
    for _ in range(3000):
        kinds = "".join(rng.choices(rng.choice(["xsuaoSUAO", "ssux", "xa", "sxSU", "uaUAx", "oO"]), k=rng.randrange(40)))
        assert layers.repair(kinds) == plain_repair(kinds)
    # every letter of the answer lies on an arc that both directions call tight
    kinds = "".join(rng.choices("xsuaoSUAO", k=300))
    ahead, behind = [layers.first()[0]], [layers.last()[0]]
    for k in kinds:
        ahead.append(layers.forward(ahead[-1], k)[0])
    for k in reversed(kinds):
        behind.append(layers.backward(behind[-1], k)[0])
    behind.reverse()
    said, _ = layers.walk(kinds, ahead[0], behind[-1], 1)
    for i, (k, letters) in enumerate(zip(kinds, said)):
        assert set(letters) <= {a.letter for a in layers.tight(ahead[i], k, behind[i], behind[i + 1])}


def plain_report(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, letters, hash) of a conversation's rows ``(turn, role, text)``."""
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    counts, kinds, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, "", set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        initial = role[:1] if role[:1] in tuple("sua") else "o"
        kinds += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
    cost, letters = plain_repair(kinds)
    out, last, row = [], "", 0
    for c in letters:
        if c != "D":
            role = rows[row][1] if c == "K" else "assistant" if last == "u" else "user"
            out.append(f"{role}:{'' if c == 'I' else rows[row][2]}")
            last = role[:1]
        row += c != "I"
    assert FORM.fullmatch("".join(o[:1] for o in out))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *counts.values(), illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest(), out


def plain_damage(rows):
    """``{conv_id: rows}`` after damage, of rows ``(conv_id, turn, role, text)``."""
    found = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kept = found.setdefault(conv, [])
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        kept += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return found


def hostile(rng, conversations, turns):
    rows = []
    for conv in [None, *range(conversations)]:
        for t in range(rng.randrange(turns)):
            turn = rng.choice([t, t, t, t + 2, None, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "ünder"])
            text = rng.choice(["One.", "Two!", "cut", "", " \t\n", None, "é" * 3000 + "?", "Same.", "a\nb.", "-.", "x. \x0b", "y?\x85"])
            rows += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 1, 2])
    return rows


FIELDS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limit, bits", [(10_000, 16), (0, 2), (6, 3), (20, 1)])
def test_reports_and_edits(spark, monkeypatch, limit, bits):
    """Whole conversations, blocks of a few rows, and some of each; hostile rows and a clashing column."""
    monkeypatch.setattr(repair, "WHOLE_ROWS", limit)
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = hostile(random.Random(limit), 25, 30)
    df = spark.createDataFrame([(*r, 1) for r in rows], f"{FIELDS}, TEXT2 int").withColumnRenamed("TEXT2", "TEXT").repartition(3)
    want = {c: plain_report(r) for c, r in plain_damage(rows).items()}
    damaged = repair.damage(df)
    got = {r.conv_id: tuple(r)[1:] for r in repair.reports(damaged).collect()}
    assert got == {c: w[:-1] for c, w in want.items()}
    found = {}
    for r in repair.edits(damaged).orderBy("conv_id", "place").collect():
        found.setdefault(r.conv_id, []).append(r)
    assert {c: "".join(r.edit for r in f) for c, f in found.items()} == {c: w[6] for c, w in want.items() if w[6]}
    assert {c: [f"{r.role}:{r.text}" for r in f if r.edit != "D"] for c, f in found.items()} == {c: w[-1] for c, w in want.items() if w[6]}
    assert all((r.turn is None and r.text == "") for f in found.values() for r in f if r.edit == "I")


def test_one_long_conversation(spark, monkeypatch):
    """Most rows in one conversation, many of them equal, in blocks."""
    monkeypatch.setattr(repair, "WHOLE_ROWS", 100)
    monkeypatch.setattr(repair, "BLOCK_BITS", 6)
    rng = random.Random(2)
    rows = [(7, rng.choice([None, 1, k]), rng.choice(["user", "assistant"]), rng.choice(["Again.", f"{k}.", f"{k}", ""])) for k in range(3000)] + [(8, 0, "user", "A.")]
    got = {r.conv_id: tuple(r)[1:] for r in repair.reports(spark.createDataFrame(rows, FIELDS).repartition(4)).collect()}
    for c in (7, 8):
        assert got[c] == plain_report([r[1:] for r in rows if r[0] == c])[:-1]


def test_no_rows(spark):
    none = spark.createDataFrame([], FIELDS)
    assert repair.reports(repair.damage(none)).collect() == [] and repair.edits(none).collect() == []
    lost = next(i for i in range(500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (r,) = repair.reports(repair.damage(spark.createDataFrame([(lost, 0, "user", "A.")], FIELDS))).collect()
    assert tuple(r) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query(same_as_sql):
    same_as_sql(queries.op12_conversation_repair, oracles.SQL["op12_conversation_repair"])
