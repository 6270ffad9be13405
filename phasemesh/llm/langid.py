"""Language of texts: script ranges narrow the candidates, then Viterbi over word scores labels spans.

Each word gets a log-likelihood under every language from hashed character n-grams learned from labelled texts.  The
script of its letters leaves only the languages written in that script.  A text's words are then labelled by the best
path through languages, where every change of language costs a penalty; so short foreign passages become spans of their
own and single odd words do not.  The text's language is the one with most letters.

A word is what stands between white space; one of more than ``LONGEST`` letters, as scripts without spaces have them, is
cut into pieces that are scored and labelled as words of their own, so that every letter is read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

BUCKETS, ORDERS = 1 << 16, (1, 2, 3, 4)
#: At most about so many labelled texts are learned from, chosen by a hash of their doc_id.
LEARN_ROWS = 6_000
PENALTY, SMOOTHING, FOREIGN = 12.0, 0.5, 60.0
MEMO_WORDS, LONGEST = 150_000, 64
#: Words labelled together, and letters whose n-grams are held at once.
BATCH_WORDS, LOT_LETTERS = 1_000_000, 400_000
#: Up to so many languages have a dense table, and their counts are held at once; with more, what is held together by
#: language (memo, batches, lots) shrinks in proportion.
DENSE = 64

#: Code point ranges of scripts (fixed values, from the Unicode blocks).
SCRIPTS = (
    ("Latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F),)),
    ("Armenian", ((0x530, 0x58F),)),
    ("Hebrew", ((0x590, 0x5FF),)),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("Devanagari", ((0x900, 0x97F),)),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Georgian", ((0x10A0, 0x10FF),)),
    ("Hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("Kana", ((0x3040, 0x30FF),)),
    ("Han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))),
)
_LOW, _HIGH, _WHICH = (np.array(x) for x in zip(*sorted((lo, hi, i) for i, (_, rs) in enumerate(SCRIPTS) for lo, hi in rs)))


def script_of(points: np.ndarray) -> np.ndarray:
    """Index in SCRIPTS of each code point; -1 for none."""
    at = np.maximum(np.searchsorted(_LOW, points, "right") - 1, 0)
    return np.where((points >= _LOW[at]) & (points <= _HIGH[at]), _WHICH[at], -1)


def _letters(word: str) -> str:
    if word.isalpha():
        return word.lower()
    return "".join([c if c.isalpha() else " " for c in word]).strip().lower()


def pieces(letters: str) -> list[str]:
    """A word's letters, cut if they are more than LONGEST: where the script changes, and after every LONGEST letters."""
    if len(letters) <= LONGEST:
        return [letters]
    script = script_of(np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), "<u4"))
    known = np.maximum.accumulate(np.where(script >= 0, np.arange(len(script)), 0))  # letters of other scripts stay with those before them
    edges = [0, *(np.flatnonzero(np.diff(script[known])) + 1).tolist(), len(letters)]
    return [letters[k : min(k + LONGEST, b)] for a, b in zip(edges, edges[1:]) for k in range(a, b, LONGEST)]


def _lots(words: list[str], letters: int):
    """Slices of words with about so many letters each."""
    held = first = 0
    for i, w in enumerate(words):
        held += len(w)
        if held >= letters:
            yield slice(first, i + 1)
            held, first = 0, i + 1
    if first < len(words):
        yield slice(first, len(words))


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of words of letters: the word's number, the order's number and the bucket of each.

    Words are set between spaces; n-grams may begin or end with one, but not hold one inside.
    """
    text = " " + " ".join(words) + " "
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = cp == 32
    starts = np.zeros(len(cp), np.int64)
    lengths = np.array([len(w) + 1 for w in words])
    starts[np.cumsum(lengths)[:-1]] = 1
    of = np.cumsum(starts)
    out_w, out_o, out_b = [], [], []
    for k, n in enumerate(ORDERS):
        if len(cp) < n:
            continue
        m = len(cp) - n + 1
        h = np.full(m, np.uint64(n))
        inner = np.zeros(m, bool)
        for i in range(n):
            h = (h ^ cp[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1:
                inner |= space[i : i + m]
        inner |= space[:m] if n == 1 else space[:m] & space[n - 1 :]
        good = np.flatnonzero(~inner)
        out_w.append(of[good])
        out_o.append(np.full(len(good), k))
        out_b.append((h[good] >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
    return np.concatenate(out_w), np.concatenate(out_o), np.concatenate(out_b)


def share(n: int, languages: int) -> int:
    """``n``, made smaller in proportion where there are more languages than DENSE."""
    return max(1, n * DENSE // max(languages, DENSE))


@dataclass
class Model:
    """Log-likelihoods of n-grams, and which scripts each language is written in.

    ``base[order, language]`` is that of an n-gram never heard; ``gain`` is what one heard has more, for the languages
    ``which`` of slot ``order * BUCKETS + bucket`` at ``start[slot]`` to ``start[slot + 1]``.  Its size is that of what
    was heard, for any number of languages.
    """

    languages: list[str]
    base: np.ndarray
    start: np.ndarray
    which: np.ndarray
    gain: np.ndarray
    scripts: np.ndarray
    penalty: float = PENALTY
    key: str = field(default="")

    def dense(self) -> np.ndarray | None:
        """``[order, bucket, language]``, if there are at most DENSE languages."""
        n = len(self.languages)
        if not 0 < n <= DENSE:
            return None
        table = np.repeat(self.base.astype(np.float32)[:, None, :], BUCKETS, 1)
        slot = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        table.reshape(-1, n)[slot, self.which] += self.gain
        return table

    def score(self, word: np.ndarray, order: np.ndarray, bucket: np.ndarray, words: int, dense: np.ndarray | None) -> np.ndarray:
        """Sums of log-likelihoods ``[word, language]`` of the n-grams."""
        n = len(self.languages)
        if dense is not None:
            values = dense[order, bucket]
            return np.stack([np.bincount(word, values[:, k], words) for k in range(n)], 1)
        slot = order * BUCKETS + bucket
        size = self.start[slot + 1] - self.start[slot]
        at = np.repeat(self.start[slot] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        heard = np.bincount(np.repeat(word, size) * n + self.which[at], self.gain[at], words * n).reshape(words, n)
        return np.bincount(word * len(ORDERS) + order, minlength=words * len(ORDERS)).reshape(words, -1) @ self.base + heard


class _Count:
    """Counts of n-grams and of scripts' letters by language."""

    def __call__(self, batches):
        import pyarrow as pa

        totals: dict[str, np.ndarray] = {}

        def drain():
            for lang, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["lang", "slot", "n"])
            totals.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                by: dict[str, dict[str, int]] = {}
                for text, lang in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    words = by.setdefault(lang, {})
                    for w in (text or "").split():
                        words[w] = words.get(w, 0) + 1
                for lang, words in by.items():
                    if lang not in totals and len(totals) == DENSE:
                        yield from drain()
                    total = totals.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS + len(SCRIPTS), np.int64))
                    kept = [(p, n) for w, n in words.items() if (x := _letters(w)) for p in pieces(x.replace(" ", ""))]
                    for lot in _lots([w for w, _ in kept], LOT_LETTERS):
                        plain, count = [w for w, _ in kept[lot]], np.array([n for _, n in kept[lot]])
                        word, order, bucket = ngrams(plain)
                        total[: len(ORDERS) * BUCKETS] += np.bincount(order * BUCKETS + bucket, count[word], len(ORDERS) * BUCKETS).astype(np.int64)
                        script = script_of(np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4"))
                        times = np.repeat(count, [len(w) for w in plain])
                        total[len(ORDERS) * BUCKETS :] += np.bincount(script[script >= 0], times[script >= 0], len(SCRIPTS)).astype(np.int64)
        yield from drain()


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """``text, lang``, one row for each of the ``rows`` pairs of a doc_id and its language with the lowest hashes (all, if
    there are fewer).

    Hashes are looked at in growing shares of all pairs until there are enough, without a look at the texts; ``rows`` of
    them reach the driver.  Of several texts of a pair the least is taken, so that a doc_id that most rows have counts once.
    """
    many = 1_000_003
    named = docs.where("lang is not null").withColumn("h", F.xxhash64("doc_id", "lang")).withColumn("m", F.pmod("h", F.lit(many)))
    total = named.count()
    part, last = 1.0 if total <= rows else 1.25 * rows / total, None
    while total > rows:
        lowest = named.where(F.col("m") < int(part * many) + 1).select("m", "h").distinct().orderBy("m", "h").limit(rows).collect()
        if len(lowest) == rows:
            last = lowest[-1]
        if last is not None or part >= 1:
            break
        part = min(1.0, 16 * part)
    if last is not None:
        named = named.where((F.col("m") < int(last["m"])) | (F.col("m") == int(last["m"])) & (F.col("h") <= int(last["h"])))
    return named.where("text is not null").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "lang")


def learn(docs: DataFrame, rows: int = LEARN_ROWS, penalty: float = PENALTY) -> Model:
    """A model from ``docs(doc_id, text, lang)``; rows without text or language are left out.

    ``rows`` whole texts are used at most, one of each doc_id and language (the least, where rows repeat them; rows without
    a doc_id count as one), those with the lowest hashes, and every language that they hold.  What reaches the driver is one
    number for each language and n-gram bucket heard.
    """
    known = _sample(docs, rows)
    counts = known.select("text", "lang").mapInArrow(_Count(), "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    size = len(ORDERS) * BUCKETS
    code = found.column("lang").combine_chunks().dictionary_encode()
    slot, n = (found.column(c).to_numpy().astype(np.int64) for c in ("slot", "n"))
    names = code.dictionary.to_pylist()
    which = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    del found, code
    languages = sorted(names[i] for i in np.unique(which[slot < size]))
    place = {x: i for i, x in enumerate(languages)}
    lang = np.array([place[x] for x in names], np.int64)[which] if names else which
    order = np.lexsort((lang, slot))
    lang, slot, n = lang[order], slot[order], n[order]
    del which, order
    store.give_back()
    grams = slot < size
    heard = np.bincount(slot[grams] // BUCKETS * len(languages) + lang[grams], n[grams], len(ORDERS) * len(languages)).reshape(len(ORDERS), len(languages))
    base = np.log(SMOOTHING / (heard + SMOOTHING * BUCKETS))
    gain = np.log1p(n[grams] / SMOOTHING).astype(np.float32)
    start = np.searchsorted(slot[grams], np.arange(size + 1))
    letters = np.zeros((len(languages), len(SCRIPTS)))
    letters[lang[~grams], slot[~grams] - size] = n[~grams]
    scripts = letters >= np.maximum(1, 0.01 * letters.sum(1, keepdims=True))
    import uuid

    return Model(languages, base, start, lang[grams].astype(np.int32), gain, scripts, penalty, uuid.uuid4().hex)


class Labeller:
    """Labels words of texts; keeps the scores of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.dense = model.dense()
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, int] = {}  # the row of a word, or -1 - k for the k-th of the runs
        self.runs: list[tuple[int, int]] = []  # the first row and the number of pieces of words that are cut
        n = len(self.model.languages)
        self.scores, self.letters = np.zeros((1024, n), np.float32), np.zeros(1024, np.int32)
        self.used = 1  # row 0: words without letters

    def _add(self, words: list[str]) -> None:
        """Scores of new words, piece by piece."""
        plain: list[str] = []
        for w in words:
            bare = _letters(w)
            if not bare:
                self.memo[w] = 0
                continue
            cut = pieces(bare.replace(" ", ""))
            if len(cut) == 1:
                self.memo[w] = self.used + len(plain)
            else:
                self.memo[w] = -1 - len(self.runs)
                self.runs.append((self.used + len(plain), len(cut)))
            plain += cut
        while self.used + len(plain) > len(self.letters):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        for lot in _lots(plain, share(LOT_LETTERS, len(self.model.languages))):
            some = plain[lot]
            rows = slice(self.used, self.used + len(some))
            self.scores[rows], self.letters[rows] = self._score(some), [len(p) for p in some]
            self.used += len(some)

    def _score(self, plain: list[str]) -> np.ndarray:
        n = len(plain)
        word, order, bucket = ngrams(plain)
        score = self.model.score(word, order, bucket, n, self.dense) / len(ORDERS)
        cp = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(n), [len(s) for s in plain])
        script = script_of(cp)
        seen = np.bincount(owner[script >= 0] * len(SCRIPTS) + script[script >= 0], minlength=n * len(SCRIPTS)).reshape(n, -1)
        main = np.where(seen.any(1), seen.argmax(1), -1)
        allowed = self.model.scripts.T[main]
        allowed[(main < 0) | ~allowed.any(1)] = True
        return score - np.where(allowed, 0.0, FOREIGN)

    def rows(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """For every word with letters between white space, or each piece of one that is cut: its score row, and the
        word's number.
        """
        words = (text or "").split() if self.model.languages else []
        found = list(map(self.memo.get, words))
        if None in found:
            self._add(list(dict.fromkeys(w for w, f in zip(words, found) if f is None)))
            found = list(map(self.memo.__getitem__, words))
        row = np.array(found, np.int32)
        place = np.flatnonzero(row)
        row = row[place]
        cut = np.flatnonzero(row < 0)
        if len(cut):
            first, size = row.copy(), np.ones(len(row), np.int64)
            first[cut], size[cut] = np.array([self.runs[-1 - k] for k in row[cut].tolist()]).T
            row = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            place = np.repeat(place, size)
        return row, place

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its words with letters (one of more than LONGEST stands once for each of its pieces): their
        places, their languages by number, and how many letters they have.
        """
        if self.used > share(MEMO_WORDS, len(self.model.languages)):
            self.reset()
        found = [self.rows(t) for t in texts]
        labels = viterbi([r for r, _ in found], self.scores, self.model.penalty)
        return [(p, said, self.letters[r]) for (r, p), said in zip(found, labels)]


def viterbi(sequences: list[np.ndarray], scores: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best labels of all sequences of score rows, one word of each at a time; ties go to the lower label.

    As every change costs the same, the best way to a label is to stay or to come from the best label overall.
    """
    size = np.array([len(s) for s in sequences], np.int64)
    total, n = int(size.sum()), scores.shape[1]
    kind = np.min_scalar_type(-max(n, 1))  # the smallest signed type that holds all labels
    if not total or not n:
        return [np.zeros(len(s), kind) for s in sequences]
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    flat = np.concatenate(sequences)
    longest = int(size.max())
    active = np.searchsorted(-size[order], -np.arange(longest), "left")  # sequences longer than t
    back = np.empty((total, n), kind)
    own = np.arange(n, dtype=kind)
    score = scores[flat[start[: active[0]]]].astype(np.float64)
    final = np.empty(len(sequences), kind)
    for t in range(1, longest):
        k = active[t]
        if k < len(score):
            final[k : len(score)] = score[k:].argmax(1)
            score = score[:k]
        at = start[:k] + t
        best = score.argmax(1)
        top = score[np.arange(k), best][:, None] - penalty
        stay = score >= top
        back[at] = np.where(stay, own, best[:, None])
        score = np.where(stay, score, top) + scores[flat[at]]
    final[: len(score)] = score.argmax(1)
    out = np.empty(total, kind)
    state = np.empty(len(sequences), kind)
    known = 0
    for t in range(longest - 1, -1, -1):
        k = active[t]
        if k > known:
            state[known:k] = final[known:k]
            known = k
        at = start[:k] + t
        out[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    ends = np.cumsum(size)
    return [out[e - s : e] for s, e in zip(size, ends)]


_LABELLERS: dict[str, Labeller] = {}


def _labeller(model: Model) -> Labeller:
    store.claim("langid", _LABELLERS.clear)
    if model.key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[model.key] = Labeller(model)
    return _LABELLERS[model.key]


def _batches(batch, at: int, languages: int):
    """Texts in lots of bounded size."""
    texts, rows, held = [], [], 0
    for i, text in enumerate(batch.column(at)):
        text = text.as_py()
        texts.append(text)
        rows.append(i)
        held += len(text or "") // 5
        if held > share(BATCH_WORDS, languages):
            yield texts, rows
            texts, rows, held = [], [], 0
    if texts:
        yield texts, rows


class _Predict:
    """Adds language and score to batches whose column ``at`` is the text."""

    def __init__(self, model, at: int):
        self.model, self.at = model, at

    def __call__(self, batches):
        import pyarrow as pa

        model = self.model.value
        labeller, n = _labeller(model), len(model.languages)
        for batch in batches:
            done = 0
            for texts, _ in _batches(batch, self.at, n):
                found, score = [], []
                for places, labels, letters in labeller.label(texts):
                    weight = np.bincount(labels, letters, n) if n and len(places) else None
                    if weight is None or not weight.sum():
                        found.append("und")
                        score.append(0.0)
                    else:
                        k = int(weight.argmax())
                        found.append(model.languages[k])
                        score.append(float(weight[k] / weight.sum()))
                some = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*(f"c{i}" for i in range(len(some.columns))), "lang_pred", "score"])


class _Spans:
    def __init__(self, model):
        self.model = model

    def __call__(self, batches):
        import pyarrow as pa

        model = self.model.value
        labeller = _labeller(model)
        for batch in batches:
            for texts, rows in _batches(batch, 1, len(model.languages)):
                key, lang, first, last = [], [], [], []
                if not model.languages:
                    continue
                for i, (places, labels, _) in zip(rows, labeller.label(texts)):
                    if len(places):
                        cuts = np.flatnonzero(np.diff(labels)) + 1
                        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(labels)]):
                            key.append(i)
                            lang.append(model.languages[labels[a]])
                            first.append(int(places[a]))
                            last.append(int(places[b - 1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(key, pa.int64())), pa.array(lang, pa.string()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["key", "lang", "first_word", "last_word"])


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with two more columns at its end, ``lang_pred`` and ``score``: the language with most letters and its share.

    A text that is null, empty or without letters, and any text if nothing was learned, is ``und`` with score 0; ties go
    to the language that sorts first.  All rows and columns are kept (of a name that stands twice, the first column is
    the text); an empty table gives no rows.  Whole texts are read, nothing is shuffled.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    fields = "".join(f"{c} {t}, " for c, t in plain.dtypes)
    out = plain.mapInArrow(_Predict(spark.sparkContext.broadcast(model), docs.columns.index("text")), fields + "lang_pred string, score double")
    return out.toDF(*docs.columns, "lang_pred", "score")


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score`` for each row of ``docs(key, text)``; see :func:`annotate`."""
    return annotate(store.only(docs, key, "text"), model).drop("text")


def spans(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key, lang, first_word, last_word``: the spans of one language; words are numbered between white space from 0.

    A word of more than LONGEST letters in which the language changes ends one span and begins the next.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    kind = dict(docs.dtypes)[key]
    return store.only(docs, key, "text").mapInArrow(_Spans(spark.sparkContext.broadcast(model)), f"`{key}` {kind}, lang string, first_word long, last_word long")


def held_out(key: Column) -> Column:
    """A fifth of the rows, which are not learned from; a null key counts as learned from."""
    return F.coalesce(store.crc_mod(key, 5) == 0, F.lit(False))


def identify(docs: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """Learn from the rows of ``docs(doc_id, text, lang)`` that are not held out and predict all:
    ``doc_id, held_out, lang_pred, score``.
    """
    model = learn(store.only(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), rows)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
