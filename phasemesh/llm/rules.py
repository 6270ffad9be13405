"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once for each text; the ledger keeps the measurements and one bit for each rule that failed.
Policies are versioned masks over these bits, applied later without another look at the texts, and ablations (what a
policy would keep without one of its rules) are sums over the distinct ledgers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Words lie between runs of these characters.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` never changes once a ledger has been written."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("short_words", 4, "n_words > 0 and word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 15 * n_words"),
    Rule("upper_case", 6, "2 * n_upper > n_letters"),
    Rule("stutter", 7, "10 * n_stutter > 3 * n_words"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a text that fails any of them is dropped."""

    name: str
    version: int
    rules: tuple[str, ...] = field(default=tuple(r.name for r in RULES))

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[n] for n in self.rules)


DEFAULT = Policy("default", 1)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in windows that occur twice or more: windows are hashed, sorted with their places and compared with their
    neighbours; the covered words are counted from the sorted places of those that repeat.
    """
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, WINDOW)).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        # get() is null beyond either end
        repeated = F.filter(s, lambda x, k: F.coalesce((F.get(s, k + 1)["h"] == x["h"]) | (F.get(s, k - 1)["h"] == x["h"]), F.get(s, k + 1)["h"] == x["h"], F.get(s, k - 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(n >= WINDOW + 1, _let(_let(F.sort_array(windows), places), covered)).otherwise(F.lit(0).cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per row: ``doc_id``, measurements and ``failed`` (a bit for each failed rule).

    Measurements: n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines
    (such lines equal to an earlier one), n_repeat_words (words in 8-word windows found twice or more), n_stutter (words
    equal to the word before), n_letters (A-Z and a-z) and n_upper (A-Z).  A null or empty text has none of anything and fails ``few_words``; null and
    repeated doc_ids keep their rows; other columns are ignored; an empty table gives no rows.  Texts are never moved;
    a very long text is measured by one task.
    """
    rows = store.only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.rtrim(x, F.lit(" \t\x0b\f\r")) != "")
    made = rows.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    long = lambda c: c.cast("long")
    made = made.select(
        "doc_id",
        "words",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.length(F.regexp_replace("text", "[^A-Za-z]+", ""))).alias("n_letters"),
        long(F.length(F.regexp_replace("text", "[^A-Z]+", ""))).alias("n_upper"),
    )
    stutter = F.filter("words", lambda w, i: F.get(F.col("words"), i - 1) == w)
    made = made.select("*", long(F.size(stutter)).alias("n_stutter"), _repeat_words(F.col("words"), F.size("words")).alias("n_repeat_words")).drop("words")
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return made.select("*", failed.alias("failed"))


def apply(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Ledger rows with ``base_failed`` and ``kept`` under a policy, its name and version, and ``alone``: the rule of the
    policy that is the only one to drop the row, else null.  The base rules always count.
    """
    base = Policy("base", 1, BASE).mask
    here = F.col("failed").bitwiseAND(F.lit(policy.mask | base))
    alone = F.lit(None).cast("string")
    for r in RULES:
        alone = F.when(here == 1 << r.bit, F.lit(r.name)).otherwise(alone)
    return entries.select(
        "*",
        (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        (here == 0).alias("kept"),
        F.lit(policy.name).alias("policy"),
        F.lit(policy.version).alias("policy_version"),
        alone.alias("alone"),
    )


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = (DEFAULT,)) -> DataFrame:
    """For each policy, and each policy without one of its rules: rows kept, and rows that this rule alone drops.

    The ledger is first counted by its distinct masks (``2 ** rules`` at most), so texts are not looked at again.
    """
    masks = entries.groupBy("failed").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    bits = {r.name: 1 << r.bit for r in RULES}
    asked = [(p.name, p.version, without, p.mask, p.mask & ~bits.get(without, 0)) for p in policies for without in (None, *p.rules)]
    table = entries.sparkSession.createDataFrame(asked, "policy string, version int, without string, full int, mask int")
    met = masks.join(F.broadcast(table), F.lit(True))  # one row for each rule of each policy: bounded by the policies
    kept = F.col("failed").bitwiseAND(F.col("mask")) == 0
    alone = kept & (F.col("failed").bitwiseAND(F.col("full")) != 0)
    return met.groupBy("policy", "version", "without").agg(
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("kept_docs"),
        F.sum(F.when(kept, F.col("words")).otherwise(0)).alias("kept_words"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("dropped_by_it_alone"),
    )
