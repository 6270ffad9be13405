"""Best-fit packing by bin completion with branch and bound.

Only the lengths of the pieces matter for how few sequences hold them, and there are at most ``capacity`` lengths, so
the search runs on the histogram of lengths: it takes the largest piece left, enumerates the undominated fillings of
the room beside it, applies the chosen filling as often as the histogram allows, and goes on.  Branches are cut when
the room wasted so far exceeds what a better solution than the incumbent may waste; the incumbent is at first the
best-fit packing.  A first search tries a few fillings beside each largest piece; if it meets no lower bound, a second
one goes through all undominated fillings, applied once as well as often, and so ends with a proof unless its steps run
out.  The plan (a few thousand rows at most, whatever the input) then gives each piece its sequence by its
rank among the pieces of its length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import store, tokens

#: Fillings tried beside a largest piece by the first search, and steps each search takes before the incumbent stands.
WIDTH, STEPS = 6, 60_000

Plan = list[tuple[int, tuple[tuple[int, int], ...]]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: total size, and for every threshold the pieces too large to share (Martello, Toth)."""
    total = sum(s * c for s, c in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for t in [s for s in sizes if s <= capacity // 2]:
        alone = sum(c for s, c in counts.items() if s > capacity - t)
        half = sum(c for s, c in counts.items() if capacity // 2 < s <= capacity - t)
        room = half * capacity - sum(s * c for s, c in counts.items() if capacity // 2 < s <= capacity - t)
        small = sum(s * c for s, c in counts.items() if t <= s <= capacity // 2)
        best = max(best, alone + half + max(0, -(-(small - room) // capacity)))
    return max(best, sum(c for s, c in counts.items() if s > capacity // 2))


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` fit into bins as large as the pieces of ``a``, each used once."""
    rooms = sorted(a, reverse=True)

    def place(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for k, room in enumerate(rooms):
            if room >= b[i] and room not in tried:
                tried.add(room)
                rooms[k] -= b[i]
                if place(i + 1):
                    return True
                rooms[k] += b[i]
        return False

    return sum(b) <= sum(a) and place(0)


def fillings(room: int, sizes: list[int], counts: dict[int, int], width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` by pieces at hand, fullest first.  ``sizes``: those at hand, descending.

    A piece of exactly this size dominates all else.  Else pairs that fill the room are looked up; else best-fit
    (always the largest piece that fits) is run from each of the largest starting pieces, and two pieces are chosen
    for the last place where they fill it better.
    """
    if counts.get(room):
        return [(room,)]
    fit = sizes[np.searchsorted(-np.array(sizes), -room) :] if sizes else []
    if not fit:
        return [()]
    exact = []
    for a in fit:
        b = room - a
        if b > a:
            break
        if counts.get(b) and (a != b or counts[a] > 1):
            exact.append((a, b))
            if len(exact) == width:
                break
    if exact:
        return exact
    found: dict[tuple[int, ...], None] = {}
    for start in fit[: 2 * width]:
        chosen, left, used = [start], room - start, {start: 1}
        while True:
            at = next((s for s in fit if s <= left and counts[s] > used.get(s, 0)), None)
            if at is None:
                break
            if at != left:
                pair = next(((a, left - a) for a in fit if a < left and left - a <= a and counts.get(left - a, 0) > used.get(left - a, 0) + (a == left - a) and counts[a] > used.get(a, 0)), None)
                if pair:
                    chosen += pair
                    break
            chosen.append(at)
            used[at] = used.get(at, 0) + 1
            left -= at
        found[tuple(sorted(chosen, reverse=True))] = None
    ranked, kept = sorted(found, key=lambda f: (-sum(f), len(f))), []
    for f in ranked:
        if not any(_dominates(k, f) for k in kept if len(f) <= 12):
            kept.append(f)
    return kept[:width]


def sums(room: int, sizes: list[int], have: list[int]) -> Iterator[tuple[int, ...] | None]:
    """Every choice of pieces with just the sum ``room``, larger ones first; None for each step between.  ``sizes``:
    descending, ``have``: pieces of each.
    """
    below = [-s for s in sizes]
    rest = list(accumulate([s * n for s, n in zip(reversed(sizes), reversed(have))]))[::-1]
    chosen: list[int] = []
    used = [0] * len(sizes)
    k, left = 0, room
    while True:
        if not left:
            yield tuple(sizes[j] for j in chosen)
            k = len(sizes)
        yield None
        k = max(k, bisect_left(below, -left))
        if k < len(sizes) and used[k] == have[k]:
            k += 1
        if k < len(sizes) and rest[k] >= left:
            chosen.append(k)
            used[k] += 1
            left -= sizes[k]
        elif chosen:
            k = chosen.pop()
            used[k] -= 1
            left += sizes[k]
            k += 1
        else:
            return


def all_fillings(room: int, sizes: list[int], have: list[int], spare: Callable[[], int]) -> Iterator[tuple[int, ...] | None]:
    """Every undominated filling of ``room`` that wastes at most ``spare()``, fullest first; None for each step between."""
    kept: list[tuple[int, ...]] = []
    at = dict(zip(sizes, range(len(sizes))))
    lost = 0
    while lost <= min(room, spare()):
        for f in sums(room - lost, sizes, have):
            if f is None:
                yield None
            elif any(have[at[s]] > f.count(s) for s in sizes[bisect_left(sizes, -lost, key=lambda s: -s) :]):
                continue  # another piece fits
            elif not any(_dominates(k, f) for k in kept if len(f) <= 12):
                kept.append(f)
                yield f
        lost += 1


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on the histogram: pieces of a size go to the fullest bins that have room, bins alike together."""
    rooms: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            room = min((r for r in rooms if r >= s), default=None)
            if room is None:
                per = min(capacity // s, n)
                times, items = n // per, ((s, per),)
                n -= times * per
                left = capacity - per * s
            else:
                have, items = rooms[room].pop()
                times = min(n, have)
                if have > times:
                    rooms[room].append((have - times, items))
                if not rooms[room]:
                    del rooms[room]
                n -= times
                items = (*items[:-1], (s, items[-1][1] + 1)) if items[-1][0] == s else (*items, (s, 1))
                left = room - s
            rooms.setdefault(left, []).append((times, items))
    return [bins for group in rooms.values() for bins in group]


def plan(counts: dict[int, int], capacity: int, steps: int = STEPS) -> Plan:
    """Bins as (how many alike, ((size, pieces of it), ...)).  ``counts``: pieces by size, all of 1 to ``capacity``."""
    return search(counts, capacity, steps)[0]


def search(counts: dict[int, int], capacity: int, steps: int = STEPS) -> tuple[Plan, bool]:
    """A plan, and whether it is proved that none has fewer bins; else the steps ran out."""
    counts = {int(s): int(c) for s, c in counts.items() if c}
    if not counts:
        return [], True
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("sizes must be from 1 to the capacity")
    least, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    for whole in (False, True):
        if sum(t for t, _ in best) == least:
            return best, True
        best, ended = _branch(dict(counts), capacity, best, least, steps, whole)
    return best, ended or sum(t for t, _ in best) == least


def _branch(counts: dict[int, int], capacity: int, best: Plan, least: int, steps: int, whole: bool) -> tuple[Plan, bool]:
    """The best plan found from the incumbent ``best``, and whether all branches were seen.  ``whole``: with every
    undominated filling, applied as often as the histogram allows and also once; else with few, as often as it allows.
    """
    total, left = sum(s * c for s, c in counts.items()), steps
    best_bins = sum(t for t, _ in best)
    path: list[tuple[int, tuple[tuple[int, int], ...], int]] = []
    sizes = sorted(counts, reverse=True)
    waste = 0

    def choices() -> Iterator[tuple[tuple[int, ...], int] | None]:
        top = sizes[0]
        counts[top] -= 1
        at_hand = [s for s in sizes if counts[s]]
        if whole:
            found = all_fillings(capacity - top, at_hand, [counts[s] for s in at_hand], lambda: (best_bins - 1) * capacity - total - waste)
        else:
            found = iter(fillings(capacity - top, at_hand, counts))
        counts[top] += 1
        for f in found:
            if f is None:
                yield None
                continue
            most = min(counts[s] // n for s, n in Counter((top, *f)).items())
            yield (top, *f), most
            if whole and most > 1:
                yield (top, *f), 1

    stack = [choices()]
    while stack:
        choice = next(stack[-1], ())
        if choice == ():
            stack.pop()
            if path:
                times, items, lost = path.pop()
                waste -= lost
                for s, n in items:
                    counts[s] += times * n
                sizes = sorted((s for s in counts if counts[s]), reverse=True)
            continue
        left -= 1
        if left < 0:
            return best, False
        if choice is None:
            continue
        filling, times = choice
        items = tuple((s, filling.count(s)) for s in dict.fromkeys(filling))
        lost = times * (capacity - sum(filling))
        if waste + lost > (best_bins - 1) * capacity - total:
            continue
        for s, n in items:
            counts[s] -= times * n
        sizes = [s for s in sizes if counts[s]]
        path.append((times, items, lost))
        waste += lost
        if sizes:
            stack.append(choices())
            continue
        best, best_bins = [(t, i) for t, i, _ in path], sum(t for t, _, _ in path)
        if best_bins == least:
            return best, True
        stack.append(iter(()))
    return best, True


class Places:
    """Gives the piece of rank r among those of its length its sequence and its offset there."""

    def __init__(self, made: Plan):
        rows: list[tuple[int, int, int, int, int]] = []
        ranks: dict[int, int] = {}
        base = 0
        for times, items in made:
            offset = 0
            for size, n in items:
                rows.append((size, ranks.get(size, 0), n, base, offset))
                ranks[size] = ranks.get(size, 0) + times * n
                offset += size * n
            base += times
        rows.sort()
        self.size, self.rank, self.per, self.base, self.offset = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        self.bins = base

    def __call__(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted((self.size << 40) + self.rank, (size << 40) + rank, "right") - 1
        within = rank - self.rank[at]
        return self.base[at] + within // self.per[at], self.offset[at] + within % self.per[at] * size


class _Pieces:
    """Cuts documents into pieces and ranks them by length within the task."""

    def __init__(self, tokenizer: str, end_id: int | None, capacity: int):
        self.tokenizer, self.end_id, self.capacity = tokenizer, end_id, capacity

    def __call__(self, batches: Iterable):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = tokens.encoder(self.tokenizer)
        end = b"" if self.end_id is None else np.array([self.end_id], "<u4").tobytes()
        part, step = TaskContext.get().partitionId(), 4 * self.capacity
        ranks: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    data = encode(text) + end
                    for k in range(0, len(data), step):
                        ids = data[k : k + step]
                        n = len(ids) // 4
                        rank = ranks.get(n, 0)
                        ranks[n] = rank + 1
                        rows.append((doc, k // step, k // 4, n, store.crc32(ids), part, rank))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])


class _Assign:
    def __init__(self, places):
        self.places = places

    def __call__(self, batches: Iterable):
        import pyarrow as pa

        for b in batches:
            seq, off = self.places.value(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, solve: Callable[[dict[int, int], int], Plan] = plan) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``capacity`` token ids; one row per piece.

    A document is its ids and ``end_id``; only one longer than the capacity is cut, and its last piece may be shorter.
    Null and empty texts are the end id alone (no piece without one); null and repeated doc_ids keep their rows; other
    columns are ignored; an empty table gives no rows.  Texts are encoded once and never shuffled; one long document is
    held by one task while it is cut.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    rows = store.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    with Scratch(spark, "packing") as tmp:
        made = tmp.save(
            rows.mapInArrow(_Pieces(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"), "pieces"
        )
        parts = made.groupBy("length", "part").agg(F.count("*").alias("n"))
        counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
        places = spark.sparkContext.broadcast(Places(solve(counts, capacity)))
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        ranked = made.join(parts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
        return tmp.result(ranked.mapInArrow(_Assign(places), SCHEMA))
