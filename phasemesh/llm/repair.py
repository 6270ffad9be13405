"""Repair of conversations: the cheapest edits after which roles read ``(s?(ua)+)?`` by their initials.

A conversation is a row of kinds, one letter each: ``x`` for a row that must go (blank or a duplicate), else the role's
initial (``o`` if it is none of s, u, a), in upper case if the text is truncated.  Edits are arcs of a layered graph: a node
is the number of rows passed and the role that was given last.  Minimum costs from the start (forward) and to the end
(backward) tell which arcs are tight, that is on a cheapest path: an arc is so where forward cost, own cost and backward
cost add up to the total.  A frontier of nodes then walks along tight arcs only and takes the least letter at each step.

Costs: Keep 0, Rerole 3, Insert 3, Delete 4; a truncated row that stays adds 3.  Edits of equal cost and letters are the
same edits: from a node each letter leads to one node only, so that a frontier of one start always holds one node and a
block of rows maps states to states.  That is what lets a conversation of any length be cut into blocks: a block is a
matrix of costs from state to state, matrices are combined, and blocks are walked apart from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import store

#: Costs of edits, and the letters of edits in the order that decides between equal costs.
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
LETTERS = "DIKR"
#: A conversation of more rows, or more bytes of text, is cut into blocks; others are repaired whole, one after the other.
WHOLE_ROWS, WHOLE_BYTES = 10_000, 32 << 20
#: Rows of a block, as a power of two, and bytes of text in a partition of large conversations.
BLOCK_BITS, PART_BYTES = 16, 64 << 20

SPACE = " \t\n\x0b\x0c\r"
_STATES = range(4)  # start, s, u, a
_AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_NEXT = (2, 2, 3, 2)  # where a given role leads: to u, or from u to a
_NEVER = 1 << 40
Costs = tuple[int, int, int, int]

START: Costs = (0, _NEVER, _NEVER, _NEVER)
END: Costs = (0, _NEVER, _NEVER, 0)


class Arc(NamedTuple):
    letter: str
    source: int
    target: int
    cost: int


INSERTS = tuple(Arc("I", p, _NEXT[p], INSERT) for p in _STATES)


def row_arcs(kind: str) -> list[Arc]:
    """The edits of a row of this kind, from every state."""
    arcs = [Arc("D", p, p, DELETE) for p in _STATES]
    if kind != "x":
        more = TRUNCATED * kind.isupper()
        kept = _AFTER.get(kind.lower(), (None,) * 4)
        arcs += [Arc("K", p, kept[p], KEEP + more) for p in _STATES if kept[p] is not None]
        arcs += [Arc("R", p, _NEXT[p], REROLE + more) for p in _STATES]
    return arcs


#: A forward cost this much over the least is on no cheapest path: two insertions lead from any state to ``a``, and from
#: there all goes on as from the start, but for one system row that has to be deleted.
_BEHIND = 2 * INSERT + DELETE


def _less(costs: list[int], limit: int = _NEVER) -> tuple[Costs, int]:
    """Costs relative to the least, and the least; there are few such vectors, so what is done with them is remembered."""
    low = min(costs)
    return tuple(c - low if c - low <= limit and c < _NEVER else _NEVER for c in costs), low


def _opened(costs: list[int], backward: bool) -> list[int]:
    """With insertions before the next row (forward) or after the last (backward); two in a row reach every state."""
    for _ in range(2):
        for _, p, q, c in INSERTS:
            if backward:
                costs[p] = min(costs[p], costs[q] + c)
            else:
                costs[q] = min(costs[q], costs[p] + c)
    return costs


class Layers:
    """Steps through layers of the graph, remembered by cost vector and kind."""

    def __init__(self):
        self.arcs = {k: row_arcs(k) for k in "xsuaoSUAO"}
        self._forward: dict[tuple, tuple[Costs, int]] = {}
        self._backward: dict[tuple, tuple[Costs, int]] = {}
        self._steps: dict[tuple, tuple[str, int]] = {}

    def first(self, costs: Costs = START) -> tuple[Costs, int]:
        return _less(_opened(list(costs), False), _BEHIND)

    def last(self, costs: Costs = END) -> tuple[Costs, int]:
        return _less(_opened(list(costs), True))

    def forward(self, before: Costs, kind: str) -> tuple[Costs, int]:
        found = self._forward.get((before, kind))
        if found is None:
            costs = [_NEVER] * 4
            for _, p, q, c in self.arcs[kind]:
                costs[q] = min(costs[q], before[p] + c)
            found = self._forward[before, kind] = _less(_opened(costs, False), _BEHIND)
        return found

    def backward(self, after: Costs, kind: str) -> tuple[Costs, int]:
        found = self._backward.get((after, kind))
        if found is None:
            costs = [_NEVER] * 4
            for _, p, q, c in self.arcs[kind]:
                costs[p] = min(costs[p], after[q] + c)
            found = self._backward[after, kind] = _less(_opened(costs, True))
        return found

    def tight(self, before: Costs, kind: str, here: Costs, after: Costs) -> list[Arc]:
        """All optimal arcs of a layer: insertions in front of the row, and the row's edits."""
        out = []
        for arcs, costs in ((INSERTS, here), (self.arcs.get(kind, ()), after)):
            least = min(before[p] + (here[p] if arcs is INSERTS else min(c + after[q] for _, s, q, c in arcs if s == p)) for p in _STATES) if arcs else 0
            out += [a for a in arcs if before[a.source] + a.cost + costs[a.target] == least]
        return out

    def step(self, before: Costs, kind: str, here: Costs, after: Costs, frontier: int) -> tuple[str, int]:
        """The letters from a frontier (a set of states as bits) past the row, the least one each time, and where they lead."""
        key = (before, kind, here, after, frontier)
        found = self._steps.get(key)
        if found is None:
            arcs, said = self.tight(before, kind, here, after), ""
            while not said or said[-1] == "I":
                letter = min(a.letter for a in arcs if frontier >> a.source & 1)
                frontier = sum({1 << a.target for a in arcs if a.letter == letter and frontier >> a.source & 1})
                said += letter
            found = self._steps[key] = said, frontier
        return found

    def finish(self, before: Costs, frontier: int) -> str:
        """The insertions after the last row."""
        here, said = self.last()[0], ""
        while not any(frontier >> p & 1 for p in _STATES if END[p] == 0):
            frontier = sum({1 << a.target for a in self.tight(before, "", here, here) if frontier >> a.source & 1})
            said += "I"
        return said

    def walk(self, kinds: str, start: Costs, end: Costs, frontier: int) -> tuple[list[str], int]:
        """The letters of each row between a forward and a backward cost vector, and the frontier after them."""
        ahead = [start]
        for k in kinds:
            ahead.append(self.forward(ahead[-1], k)[0])
        behind = [end]
        for k in reversed(kinds):
            behind.append(self.backward(behind[-1], k)[0])
        behind.reverse()
        said = []
        for i, k in enumerate(kinds):
            letters, frontier = self.step(ahead[i], k, behind[i], behind[i + 1], frontier)
            said.append(letters)
        return said, frontier

    def repair(self, kinds: str) -> tuple[int, str]:
        """The least cost of a whole conversation and the letters of its edits."""
        costs, total = self.first()
        for k in kinds:
            costs, more = self.forward(costs, k)
            total += more
        end, _ = self.last()
        said, frontier = self.walk(kinds, self.first()[0], end, 1)
        total += min(costs[p] + END[p] for p in _STATES)
        return total, "".join(said) + self.finish(costs, frontier)

    def matrix(self, kinds: str) -> list[int]:
        """Least costs of passing a block from each state to each, without insertions in front of its first row."""
        out = []
        for p in _STATES:
            costs, total = tuple(0 if q == p else _NEVER for q in _STATES), 0
            for k in kinds:
                costs, more = self.forward(costs, k)
                total += more
            out += [total + c if c < _NEVER else _NEVER for c in costs]
        return out


def roles(letters: str, state: int = 0, initials: str = "") -> Iterator[tuple[str, str | None]]:
    """Each letter with the role that it gives, which for a kept row is None; ``initials`` are those of the rows passed."""
    row = 0
    for letter in letters:
        if letter == "D":
            yield letter, None
        else:
            state = _AFTER[initials[row]][state] if letter == "K" else _NEXT[state]
            yield letter, None if letter == "K" else ("user", "assistant")[state - 2]
        row += letter != "I"


def follow(letters: str, state: int, initials: str) -> int:
    """The state after these letters."""
    row = 0
    for letter in letters:
        if letter != "D":
            state = _AFTER[initials[row]][state] if letter == "K" else _NEXT[state]
        row += letter != "I"
    return state


_LEGAL = ("su", "ua", "au")


def fault(role: str, text: str, seen: set) -> str:
    """``blank``, ``duplicate``, ``truncated`` or nothing; what was seen is remembered in ``seen``."""
    bare = text.rstrip(SPACE)
    if not bare:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    seen.add((role, text))
    return "" if bare[-1] in ".!?" else "truncated"


def kind_of(role: str, fault: str) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial


class Report(NamedTuple):
    gaps: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    cost: int
    audit: str
    repaired_sha256: str


def whole(layers: Layers, turns: list, said: list[tuple[str, str]]) -> tuple[Report, list[tuple[str, int | None, str, str]]]:
    """A conversation's report, and its edits as ``(letter, row, role, text)``; deleted rows come as they were."""
    seen: set = set()
    faults = [fault(role, text, seen) for role, text in said]
    initials = "".join(kind_of(role, "") for role, _ in said)
    cost, audit = layers.repair("".join(kind_of(role, f) for (role, _), f in zip(said, faults)))
    edits, row = [], 0
    for letter, role in roles(audit, 0, initials):
        if letter == "I":
            edits.append((letter, None, role, ""))
        else:
            edits.append((letter, row, role or said[row][0], said[row][1]))
            row += 1
    known = {t for t in turns if t is not None}
    gaps = min(max(known) - min(known) + 1 - len(known), (1 << 63) - 1) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in _LEGAL for a, b in zip(said, said[1:]))
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for letter, _, role, text in edits if letter != "D").encode("utf-8", "surrogatepass"))
    report = Report(gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest.hexdigest())
    return report, edits


# --- tables -----------------------------------------------------------------------------------------------------------

_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_EDITS = "place long, edit string, turn long, role string, text string"


def clean(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with a space for a missing role or text."""
    rows = store.only(rows, "conv_id", "turn", "role", "text")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])


def damage(rows: DataFrame) -> DataFrame:
    """The rows with faults planted by a hash of ``conv_id:turn``; dropped rows stay as ``lost``, so that no conversation is
    forgotten.
    """
    crc = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    text = F.when(F.col("_d").isin(0, 1), "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    out = clean(rows).withColumn("_d", crc).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_d") == 0).alias("lost"), (F.col("_d") == 3).alias("_twice"))
    twice = F.when(F.col("_twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", "role", "text", "lost", F.explode(twice).alias("_copy")).drop("_copy")


def _key() -> Column:
    return F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))


#: The order of rows: by turn (none first), and of rows of one turn by role and then by a hash of the text.
_ORDER = ("_key", "turn", "role", "_tie")


def _keyed(rows: DataFrame) -> DataFrame:
    lost = F.col("lost") if "lost" in rows.columns else F.lit(False).alias("lost")
    return rows.select("conv_id", "turn", "role", "text", lost).select(_key().alias("_key"), "*", F.md5(F.col("text").cast("binary")).alias("_tie"))


class _Whole:
    """Conversations that come as adjacent rows, each held as a whole."""

    def __init__(self, reports: bool, schema: pa.Schema):
        self.reports, self.schema = reports, schema

    def __call__(self, batches) -> Iterator[pa.RecordBatch]:
        layers, held, out, size = Layers(), [], [], 0

        def close() -> None:
            nonlocal size
            kept = [h for h in held if not h[5]]
            report, edits = whole(layers, [h[2] for h in kept], [h[3:5] for h in kept])
            if self.reports:
                out.append((held[0][1], *report))
                size += len(report.audit) + 200
            else:
                for k, (letter, row, role, text) in enumerate(edits):
                    out.append((held[0][1], k, letter, None if row is None else kept[row][2], role, text))
                    size += len(text) + 50

        def given() -> pa.RecordBatch:
            nonlocal size
            made = pa.RecordBatch.from_pylist([dict(zip(self.schema.names, row)) for row in out], self.schema)
            out.clear()
            size = 0
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    close()
                    held.clear()
                    if size > 4 << 20:
                        yield given()
                held.append(row)
        if held:
            close()
        if out:
            yield given()


class _Blocks:
    """What a block of a large conversation costs, between which states; or its letters, once the states are known."""

    def __init__(self, letters: bool):
        self.letters = letters

    def __call__(self, frames) -> Iterator[pd.DataFrame]:
        layers = Layers()
        for f in frames:
            if self.letters:
                said = [layers.walk(k, tuple(a), tuple(b), 1 << s)[0] for k, a, b, s in zip(f["kinds"], f["ahead"], f["behind"], f["state"])]
                tail = [layers.finish(tuple(a), 1 << s) if last else "" for a, s, last in zip(f["after"], f["final"], f["is_last"])]
                yield pd.DataFrame({"_key": f["_key"], "block": f["block"], "first": f["first"], "initials": f["initials"], "state": f["state"], "said": said, "tail": tail})
            else:
                matrix = [layers.matrix(k) for k in f["kinds"]]
                illegal = [sum(a + b not in _LEGAL for a, b in zip(i, i[1:])) for i in f["initials"]]
                yield pd.DataFrame({"_key": f["_key"], "block": f["block"], "first": f["first"], "kinds": f["kinds"], "initials": f["initials"], "matrix": matrix, "illegal": illegal})


class _Ends:
    """Where each state leads through a block that lies between known costs."""

    def __call__(self, frames) -> Iterator[pd.DataFrame]:
        layers = Layers()
        for f in frames:
            ends = []
            for kinds, initials, ahead, behind in zip(f["kinds"], f["initials"], f["ahead"], f["behind"]):
                ahead, behind = tuple(ahead), tuple(behind)
                first = behind
                for k in reversed(kinds):
                    first = layers.backward(first, k)[0]
                least = min(a + b for a, b in zip(ahead, first))
                # only states on a cheapest path are walked from
                ends.append([follow("".join(layers.walk(kinds, ahead, behind, 1 << p)[0]), p, initials) if ahead[p] + first[p] == least else -1 for p in _STATES])
            yield f.assign(ends=ends)


def _between(f: pd.DataFrame) -> pd.DataFrame:
    """Forward costs in front of, and backward costs behind, every block of one conversation: one short row a block."""
    f = f.sort_values("block", ignore_index=True)
    layers = Layers()
    costs, total = layers.first()
    ahead, after = [], []
    for m in f["matrix"]:
        ahead.append(list(costs))
        costs, more = _less(_opened([min(costs[p] + m[4 * p + q] for p in _STATES) for q in _STATES], False), _BEHIND)
        total += more
        after.append(list(costs))
    total += min(costs[p] + END[p] for p in _STATES)
    costs, behind = layers.last()[0], []
    for m in reversed(f["matrix"].tolist()):
        behind.append(list(costs))
        costs = _less(_opened([min(m[4 * p + q] + costs[q] for q in _STATES) for p in _STATES], True))[0]
    said = f["initials"].tolist()
    joints = sum(a[-1] + b[0] not in _LEGAL for a, b in zip(said, said[1:]))
    return f[["_key", "block"]].assign(ahead=ahead, after=after, behind=behind[::-1], cost=total, joints=joints)


def _chained(f: pd.DataFrame) -> pd.DataFrame:
    """The state at the start and end of every block of one conversation."""
    f = f.sort_values("block", ignore_index=True)
    state, states, final = 0, [], []
    for ends in f["ends"]:
        states.append(state)
        state = int(ends[state])
        final.append(state)
    return f[["_key", "block"]].assign(state=states, final=final, is_last=[*[False] * (len(f) - 1), True])


class _Hash:
    """sha256 of repaired rows that come in order, text by text; the only step that one conversation cannot share out."""

    def __call__(self, batches) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple[str, str]] = []
        for batch in batches:
            for key, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if state is not None:
            done.append((now, state.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["_key", "repaired_sha256"])


class _Split(NamedTuple):
    """Large conversations: their numbered rows, the kinds of blocks, and the letters of blocks."""

    rows: DataFrame
    counts: DataFrame
    letters: DataFrame


def _split(rows: DataFrame, size: int, tmp: Scratch) -> _Split:
    """The graph of large conversations, block by block.  Rows are put in order over ranges (equal ones too, by a number of
    their own), so that neither a conversation nor a turn has to fit into one task.
    """
    raw = tmp.save(rows.where("not lost").withColumn("_n", F.monotonically_increasing_id()), "large")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, size // PART_BYTES)
    by = [*(F.col(c).asc_nulls_first() for c in _ORDER), F.col("_n")]
    ordered = tmp.save(raw.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_n", "lost", "_tie").withColumn("pos", F.monotonically_increasing_id()), "ordered")
    tmp.discard(raw)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"(?s)[.!?][\x20\x09-\x0D]*\z")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    thin = ordered.select("_key", "pos", initial.alias("initial"), blank.alias("blank"), cut.alias("cut"), F.sha2(F.concat_ws("\0", "role", "text").cast("binary"), 256).alias("same"))
    firsts = thin.where("not blank").groupBy("_key", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "", F.col("initial")).otherwise(F.upper("initial"))
    known = thin.drop("same").join(firsts, "pos", "left").withColumn("fault", fault).withColumn("kind", kind)
    listed = F.array_sort(F.collect_list(F.struct("pos", "kind", "initial")))
    blocks = known.groupBy("_key", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(
        listed.alias("l"), F.min("pos").alias("first"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    blocks = blocks.select("_key", "block", "first", *[F.array_join(f"l.{c}", "").alias(n) for c, n in (("kind", "kinds"), ("initial", "initials"))], "blank", "duplicate", "truncated")
    blocks = tmp.save(blocks, "blocks")
    base = "_key string, block long, first long, kinds string, initials string"
    costs = tmp.save(blocks.select("_key", "block", "first", "kinds", "initials").mapInPandas(_Blocks(False), f"{base}, matrix array<long>, illegal long"), "costs")
    between = tmp.save(
        costs.select("_key", "block", "matrix", F.concat(F.substring("initials", 1, 1), F.substring("initials", -1, 1)).alias("initials"))
        .groupBy("_key").applyInPandas(_between, "_key string, block long, ahead array<long>, after array<long>, behind array<long>, cost long, joints long"),
        "between",
    )
    placed = costs.drop("matrix", "illegal").join(between.drop("cost", "joints"), ["_key", "block"])
    ends = tmp.save(placed.mapInPandas(_Ends(), f"{base}, ahead array<long>, after array<long>, behind array<long>, ends array<long>"), "ends")
    states = ends.select("_key", "block", "ends").groupBy("_key").applyInPandas(_chained, "_key string, block long, state int, final int, is_last boolean")
    letters = tmp.save(ends.drop("ends").join(states, ["_key", "block"]).mapInPandas(_Blocks(True), "_key string, block long, first long, initials string, state int, said array<string>, tail string"), "letters")
    turns = ordered.groupBy("_key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    sums = blocks.groupBy("_key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    inside = costs.groupBy("_key").agg(F.sum("illegal").alias("illegal"))
    cost = between.groupBy("_key").agg(F.first("cost").alias("cost"), F.first("joints").alias("joints"))
    counts = turns.join(sums, "_key").join(inside, "_key").join(cost, "_key")
    counts = counts.select("_key", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.col("joints")).alias("illegal"), "cost")
    return _Split(ordered, counts, letters)


class _Steps:
    """One row for each letter of a block."""

    def __call__(self, frames) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, block, first, initials, state, said, tail in zip(*(f[c] for c in ("_key", "block", "first", "initials", "state", "said", "tail"))):
                out, row = [], 0
                for k, (letter, role) in enumerate(roles("".join(said) + tail, state, initials)):
                    out.append((key, block, k, letter, None if letter == "I" else first + row, role))
                    row += letter != "I"
                made = pd.DataFrame(out, columns=["_key", "block", "k", "edit", "pos", "given"])
                yield made.assign(pos=made["pos"].astype("Int64"))


def _edits(split: _Split) -> DataFrame:
    """All edits of large conversations with their texts."""
    steps = split.letters.mapInPandas(_Steps(), "_key string, block long, k long, edit string, pos long, given string")
    joined = steps.join(split.rows.select("pos", "conv_id", "turn", "role", "text"), "pos", "left")
    return joined.select("_key", "conv_id", "block", "k", "edit", "turn", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _sizes(rows: DataFrame, tmp: Scratch) -> tuple[DataFrame, int]:
    """Keys of large conversations, and their bytes."""
    sizes = rows.groupBy("_key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    large = tmp.save(sizes.where((F.col("n") > WHOLE_ROWS) | (F.col("bytes") > WHOLE_BYTES)), "sizes")
    return large.select("_key"), large.agg(F.sum("bytes")).first()[0] or 0


def _arrow(rows: DataFrame, fields: str) -> tuple[str, pa.Schema]:
    kind = rows.schema["conv_id"].dataType
    types = {"long": pa.int64(), "string": pa.string()}
    from pyspark.sql.pandas.types import to_arrow_type

    listed = [f.split() for f in fields.split(", ")]
    return f"conv_id {kind.simpleString()}, {fields}", pa.schema([("conv_id", to_arrow_type(kind)), *((n, types[t]) for n, t in listed)])


def _one_by_one(rows: DataFrame, reports: bool) -> DataFrame:
    """Conversations of bounded size, dealt out by their key and held one at a time."""
    store.bounded_batches(rows.sparkSession)
    schema, arrow = _arrow(rows, _REPORT if reports else _EDITS)
    dealt = rows.repartition("_key").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in _ORDER))
    return dealt.select("_key", "conv_id", "turn", "role", "text", "lost").mapInArrow(_Whole(reports, arrow), schema)


def _apart(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of other conversations, and those of large ones."""
    few = large.count() <= store.BROADCAST_IDS
    ids = F.broadcast(large) if few else large
    return rows.join(ids, "_key", "left_anti"), rows.join(ids, "_key", "left_semi")


def edits(rows: DataFrame, tmp: Scratch | None = None) -> DataFrame:
    """Every edit of every conversation: ``conv_id, place, edit, turn, role, text``, in the order of ``place``.

    ``rows(conv_id, turn, role, text)``, and ``lost`` for rows that only name their conversation.  The repaired conversation
    is what is not deleted (``edit <> 'D'``); inserted rows have no turn and an empty text.  A missing role or text counts
    as one space; rows without a conv_id are one conversation; rows of one turn are in the order of role and a hash of the
    text; rows without a turn come first; other columns are left out; an empty table gives no rows.
    """
    spark = rows.sparkSession
    own = tmp or Scratch(spark, "repair")
    rows = _keyed(rows)
    large, size = _sizes(rows, own)
    if not size:
        out = _one_by_one(rows, False)
    else:
        small, big = _apart(rows, large)
        found = _edits(_split(big, size, own))
        names = found.where("conv_id is not null").groupBy("_key").agg(F.first("conv_id").alias("conv_id"))
        found = found.drop("conv_id").join(names, "_key", "left")
        place = F.shiftleft("block", BLOCK_BITS + 2) + F.col("k")  # a row has three letters at most
        out = _one_by_one(small, False).unionByName(found.select("conv_id", place.alias("place"), "edit", "turn", "role", "text"))
    result = own.result(out)
    if tmp is None:
        own.close()
    return result


def reports(rows: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, the least cost, the letters of its edits and the hash of what they give.

    Rows as for :func:`edits`.  A conversation all of whose rows are lost has zeros, no letters, and the hash of nothing.
    """
    spark = rows.sparkSession
    rows = _keyed(rows)
    with Scratch(spark, "repair") as tmp:
        large, size = _sizes(rows, tmp)
        if not size:
            return tmp.result(_one_by_one(rows, True))
        small, big = _apart(rows, large)
        split = _split(big, size, tmp)
        kept = _edits(split).where("edit <> 'D'").repartition("_key").sortWithinPartitions("_key", "block", "k").select("_key", "role", "text")
        hashes = kept.mapInArrow(_Hash(), "_key string, repaired_sha256 string")
        said = split.letters.select("_key", "block", F.concat(F.array_join("said", ""), "tail").alias("s"))
        audits = said.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("block", "s"))).alias("l")).select("_key", F.array_join("l.s", "").alias("audit"))
        names = big.groupBy("_key").agg(F.first("conv_id", True).alias("conv_id"))
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        out = names.join(split.counts, "_key", "left").join(audits, "_key", "left").join(hashes, "_key", "left")
        zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        out = out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
        return tmp.result(_one_by_one(small, True).unionByName(out))
