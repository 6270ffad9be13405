"""URL allow and block lists as one trie over reversed host labels and then path segments.

A rule fits its host and all subdomains, where the URL's path starts with the rule's path (by characters, so a rule's
last segment may be the beginning of the URL's).  Of the rules that fit, the longest wins: more host labels first, then
the longer path; of an allow and a block entry for the same place, the block entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import store

#: Rules, and characters of all of them, that a broadcast trie may hold; longer lists are joined instead.  A trie takes
#: about 2.3 kB a rule in each Python worker if hardly any share a host (measured: 234 MB for 100,000 rules).
MAX_TRIE_RULES, MAX_TRIE_CHARS = 50_000, 5_000_000
#: Rows of one host suffix from which on a join spreads them, and its rules with them, over SALTS keys.
HOT, SALTS = 1_000_000, 64

Rule = tuple[str, str, str]  # host, path, "allow" or "block"

_UPPER = {c: c + 32 for c in range(65, 91)}
_URL = re.compile(r"([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as written; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host, path = _URL.match(url, at + 3).groups()
    return host.translate(_UPPER), path


class Trie:
    """Nested dicts: host labels from the last to the first, then whole path segments.

    Rules hang under the node of their last whole segment, by the length of the beginning of the next one and then by
    this beginning, so that finding the longest takes one look for each length, however many rules there are.
    """

    HOST, PATH, RULES = 0, 1, 2

    def __init__(self, rules: Iterable[Rule]):
        self.top: list = [{}, None, None]
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks; it says {verdict!r}")
            if not host:
                raise ValueError("a rule needs a host")
            node = self.top
            for label in reversed(host.translate(_UPPER).split(".")):
                node = node[self.HOST].setdefault(label, [{}, None, None])
            if node[self.PATH] is None:
                node[self.PATH] = [None, {}, {}]
            node = node[self.PATH]
            *whole, last = path.split("/")
            for segment in whole:
                node = node[self.PATH].setdefault(segment, [None, {}, {}])
            here = node[self.RULES].setdefault(len(last), {})
            if here.get(last, ("", "allow"))[1] == "allow":
                here[last] = (host.translate(_UPPER) + path, verdict)
        self._sort(self.top)

    def _sort(self, top: list) -> None:
        """Longer beginnings first."""
        stack = [top]
        while stack:
            node = stack.pop()
            if node[self.RULES]:
                node[self.RULES] = dict(sorted(node[self.RULES].items(), reverse=True))
            for below in (node[self.HOST], node[self.PATH]):
                stack += below.values() if isinstance(below, dict) else [below] if below else []

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning rule as ``(host and path, verdict)``."""
        if not host:
            return None
        node, best, segments = self.top, None, None
        for label in reversed(host.split(".")):
            node = node[self.HOST].get(label)
            if node is None:
                break
            if node[self.PATH] is not None:
                segments = path.split("/") if segments is None else segments
                best = self._path(node[self.PATH], segments) or best
        return best

    def _path(self, node: list, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for length, rules in node[self.RULES].items():
                if length <= len(segment) and (found := rules.get(segment[:length])):
                    best = found
                    break
            node = node[self.PATH].get(segment)
            if node is None:
                break
        return best


class _Judge:
    def __init__(self, trie, default: str):
        self.trie, self.default = trie, default

    def __call__(self, batches) -> Iterator:
        import pyarrow as pa

        trie = self.trie.value
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rows.append((host, path, *(trie.find(host, path) or (None, self.default))))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """One row per row of ``pages(page_id, url)``: ``page_id, host, path, rule, verdict``.

    A null URL, or one without ``://``, has an empty host and path; no rule fits an empty host, and where none fits the
    verdict is ``default`` and ``rule`` is null.  Null and repeated page_ids keep their rows; other columns are ignored;
    an empty table gives no rows.  More rules than ``MAX_TRIE_RULES``, or of more than ``MAX_TRIE_CHARS`` characters, are
    not broadcast but joined.
    """
    rules = list(rules)
    rows = store.only(pages, "page_id", "url").select(F.col("page_id").cast("long"), "url")
    if len(rules) > MAX_TRIE_RULES or sum(len(h) + len(p) for h, p, _ in rules) > MAX_TRIE_CHARS:
        return joined(rows, pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string"), default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    return rows.mapInArrow(_Judge(trie, default), "page_id long, host string, path string, rule string, verdict string")


def joined(rows: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same by joins, for lists that are too long to broadcast: each URL is met with the suffixes of its host."""
    url = F.substring("url", F.lit(1), F.length("url"))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    split = rows.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    with Scratch(rows.sparkSession, "urls") as tmp:
        split = tmp.save(split, "urls")
        suffixes = split.where("host <> ''").select("row", "path", F.split("host", r"\.").alias("l"))
        suffixes = suffixes.select("row", "path", F.explode(F.expr("transform(sequence(1, size(l)), i -> array_join(slice(l, i, size(l)), '.'))")).alias("suffix"))
        lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        known = rules.select(lower.alias("suffix"), F.col("path").alias("rule_path"), "verdict")
        hot = tmp.save(suffixes.groupBy("suffix").count().where(F.col("count") >= HOT).select("suffix", F.lit(SALTS).alias("salts")), "hot")
        salts = F.coalesce("salts", F.lit(1))
        suffixes = suffixes.join(hot, "suffix", "left").withColumn("salt", F.expr("pmod(xxhash64(row), coalesce(salts, 1))").cast("int")).drop("salts")
        known = known.join(hot, "suffix", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        rank = F.struct(F.size(F.split("suffix", r"\.")), F.length("rule_path"), F.when(F.col("verdict") == "block", 1).otherwise(0))
        won = suffixes.join(known, ["suffix", "salt"]).where(F.col("path").startswith(F.col("rule_path"))).groupBy("row")
        won = won.agg(F.max_by(F.struct(F.concat("suffix", "rule_path").alias("rule"), "verdict"), rank).alias("w"))
        out = split.join(won, "row", "left").select("page_id", "host", "path", F.col("w.rule").alias("rule"), F.coalesce("w.verdict", F.lit(default)).alias("verdict"))
        return tmp.result(out)
