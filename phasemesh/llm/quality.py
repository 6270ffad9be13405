"""Quality of texts by a naive Bayes support vector machine on n-gram indicators.

Features are indicators of n-grams of words and of word forms (letter case, length, the marks a word ends with, whether
it repeats the word before).  Each is scaled by its class log-count ratio, each text's vector is brought to unit length,
and a linear hinge-loss model is fitted by dual coordinate descent.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import store

WORD_BITS, FORM_BITS, PAIR_BITS = 17, 16, 17
PAIRS = (1 << WORD_BITS) + 4 * (1 << FORM_BITS)
SIZE = PAIRS + (1 << PAIR_BITS)
#: The model is fitted on at most about so many labelled texts, chosen by a hash of their doc_id; they are read whole.
LEARN_ROWS = 8_000
#: Bytes of their features that the driver takes; of longer texts fewer are used, again by the hash.
LEARN_BYTES = 400 << 20
MEMO_WORDS = 150_000
EPOCHS, COST, SHARPNESS = 20, 1.0, 4.0

_WORDS: dict[str, int] = {}
_SEEN = np.zeros(SIZE, np.int32)


def _form(word: str) -> int:
    """Word hash and form hash of one word as one number."""
    core = word.strip("*$&%#!|.,;:?()[]\"'<>-")
    case = "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core.isalpha() else "d" if core.isdigit() else "-" if not core else "m"
    tail = word[len(word.rstrip("*$&%#!|.,;:?()[]\"'<>-")) :][:4]
    length = min(len(core).bit_length(), 5)
    return zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(f"{case}{length}{tail}".encode("utf-8", "surrogatepass"))


def features(text: str | None) -> np.ndarray:
    """The distinct n-grams of a whole text: words and word pairs, and forms in runs of one to four."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32)
    store.claim("quality", _WORDS.clear)
    codes = list(map(_WORDS.get, words))
    if None in codes:
        if len(_WORDS) > MEMO_WORDS:
            _WORDS.clear()
        for i, c in enumerate(codes):
            if c is None:
                codes[i] = c = _form(words[i])
                if len(words[i]) <= 64:
                    _WORDS[words[i]] = c
    both = np.array(codes, np.uint64)
    word, form = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
    same = np.zeros(len(word), np.uint32)
    same[1:] = word[1:] == word[:-1]
    form = (form ^ same * np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B)
    form ^= form >> np.uint32(15)
    parts = [(word * np.uint32(0x9E3779B1)) >> np.uint32(32 - WORD_BITS)]
    run = np.zeros(len(form), np.uint32)
    for n in range(4):
        if len(form) <= n:
            break
        run = (run[: len(form) - n] * np.uint32(0x01000193)) ^ form[n:]
        parts.append(((run * np.uint32(0xC2B2AE35)) >> np.uint32(32 - FORM_BITS)) + np.uint32((1 << WORD_BITS) + n * (1 << FORM_BITS)))
    pair = (word[:-1] * np.uint32(0x85EBCA6B)) ^ word[1:]
    pair ^= pair >> np.uint32(15)
    parts.append(((pair * np.uint32(0xC2B2AE35)) >> np.uint32(32 - PAIR_BITS)) + np.uint32(PAIRS))
    at = np.concatenate(parts).astype(np.int64)
    places = np.arange(len(at), dtype=np.int32)
    _SEEN[at] = places  # of equal features the last writer stays
    return at[_SEEN[at] == places].astype(np.int32)


@dataclass
class Model:
    """``ratio``: log-count ratios; ``weight``: of the scaled unit vectors; without classes to tell apart ``prior`` is all."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float | None
    key: str = ""

    def score(self, text: str | None) -> float:
        """0 to 1; 0.5 is on the line between the classes."""
        if self.prior is not None:
            return self.prior
        at = features(text)
        r = self.ratio[at]
        norm = float(np.sqrt((r * r).sum()))
        margin = self.bias + (float(self.product[at].sum()) / norm if norm > 0 else 0.0)
        return float(1 / (1 + np.exp(-np.clip(SHARPNESS * margin, -50, 50))))

    @property
    def product(self) -> np.ndarray:
        if not hasattr(self, "_product"):
            self._product = self.ratio * self.weight
        return self._product


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, cost: float = COST, seed: int = 0) -> Model:
    """Naive Bayes scaling and dual coordinate descent; both classes weigh alike in all."""
    labels = np.asarray(labels, np.int64)
    positive = int(labels.sum())
    if not len(rows) or positive in (0, len(rows)):
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, float(positive) / len(rows) if len(rows) else 0.5)
    counts = [np.full(SIZE, 1.0), np.full(SIZE, 1.0)]
    for at, y in zip(rows, labels):
        counts[y][at] += 1
    share = [counts[y] / (np.sum(labels == y) + 2) for y in (0, 1)]
    ratio = np.log(share[1] / share[0])
    once = counts[0] + counts[1] <= 3  # n-grams of a single text say nothing about others
    ratio[once] = 0
    vectors = []
    for at in rows:
        r = ratio[at]
        norm = np.sqrt((r * r).sum())
        vectors.append((at[r != 0], r[r != 0] / norm if norm > 0 else r[r != 0]))
    bound = np.where(labels == 1, cost * len(rows) / (2 * positive), cost * len(rows) / (2 * (len(rows) - positive)))
    y = np.where(labels == 1, 1.0, -1.0)
    square = np.array([v @ v for _, v in vectors]) + 1
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, v = vectors[i]
            slope = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), bound[i])
            step = new - alpha[i]
            if step:
                most = max(most, abs(step))
                alpha[i] = new
                w[at] += step * y[i] * v
                bias += step * y[i]
        if most < 1e-3:
            break
    return Model(ratio, w, bias, None, uuid.uuid4().hex)


def _collect_features(batches):
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            data = [features(t).astype("<i4").tobytes() for t in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(data, pa.binary())], names=["doc_id", "features"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    Labels other than 0 and 1, and null doc_ids, are left out; a doc_id with both labels is left out too.  About
    ``rows`` labelled doc_ids with the lowest hashes are used, one text each, and fewer if their features have more than
    LEARN_BYTES, so their broadcast and what reaches the driver are bounded.
    """
    store.bounded_batches(docs.sparkSession)
    known = store.only(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    with Scratch(docs.sparkSession, "quality") as tmp:
        known = tmp.save(known, "labels")
        total = known.count()
        bound = int((1.0 if total <= rows else rows / total) * 1_000_003) + 1
        chosen = known.where(hashed < bound)
        texts = store.only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
        seen = texts.mapInArrow(_collect_features, f"doc_id {dict(docs.dtypes)['doc_id']}, features binary").groupBy("doc_id").agg(F.min("features").alias("features"))
        seen = tmp.save(seen.join(F.broadcast(chosen), "doc_id"), "features")
        held = seen.agg(F.sum(F.length("features"))).first()[0] or 0
        found = seen.where(hashed < bound * min(1.0, LEARN_BYTES / max(held, 1))).toArrow().sort_by("doc_id")
    model = fit([np.frombuffer(f.as_buffer(), "<i4") for f in found.column("features")], found.column("quality").to_numpy())
    del found
    store.give_back()
    return model


class _Score:
    """Adds score and prediction to batches whose column ``at`` is the text."""

    def __init__(self, model, at: int):
        self.model, self.at = model, at

    def __call__(self, batches):
        import pyarrow as pa

        model = self.model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                scores = [model.score(t) for t in some.column(self.at).to_pylist()]
                added = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
                yield pa.RecordBatch.from_arrays([*some.columns, *added], names=[*(f"c{i}" for i in range(len(some.columns))), "score", "predicted"])


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with two more columns at its end, ``score`` and ``predicted``; texts that are null or empty are scored by
    the bias alone.

    All rows and columns are kept (of a name that stands twice, the first column is the text); an empty table gives no
    rows; if nothing could be learned every text gets the share of label 1 (0.5 without labels).  Whole texts are read,
    nothing is shuffled.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    fields = "".join(f"{c} {t}, " for c, t in plain.dtypes)
    out = plain.mapInArrow(_Score(spark.sparkContext.broadcast(model), docs.columns.index("text")), fields + "score double, predicted int")
    return out.toDF(*docs.columns, "score", "predicted")


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key, score, predicted`` for each row of ``docs(key, text)``; see :func:`annotate`."""
    return annotate(store.only(docs, key, "text"), model).drop("text")


def held_out(key: Column) -> Column:
    """A third of the rows, whose labels are not learned from; a null key is not among them."""
    return F.coalesce(store.crc_mod(key, 3) == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """Learn from the labels that are not held out and score all: ``doc_id, held_out, score, predicted``."""
    model = learn(docs, store.only(labels, "doc_id", "quality").where(~held_out(F.col("doc_id"))), rows)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
