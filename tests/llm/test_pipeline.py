"""The pipeline's stages on hostile rows and on the smallest tables."""

import re
import zlib
from collections import Counter

import numpy as np
import plain
import pytest
from test_dedup import brute_force
from test_rows import poisson, uniform

import corpus_pipeline as pipeline
from phasemesh import scratch
from phasemesh.llm import langid, packing, quality, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(pipeline.STAGES)


def test_contract():
    assert [n for n, _ in pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixing", "packing"]
    assert pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stage_on_odd_and_on_no_rows(name, spark, docs, tiny):
    d = docs(None, "", "  ", "a", "a", "word " * 20_000, "one two three four five six", ids=[0, None, 2, 3, 3, 5, None])
    out = STAGES[name](spark, d, tiny)
    rows = out.collect()
    if name != "packing":
        assert out.columns == COLUMNS
    assert STAGES[name](spark, d.limit(0), tiny).count() == 0
    if name == "language":
        assert all(r.text and re.search("[a-z]", r.text) for r in rows)


def test_language_and_quality_follow_their_models(spark, tiny):
    d = spark.read.parquet(f"{tiny}/documents.parquet").select(*COLUMNS)
    model = langid.learn(d)
    said = {r.doc_id for r in langid.predict(d, model).collect() if r.lang_pred != "und" and r.score >= pipeline.LEAST_SHARE}
    assert {r.doc_id for r in STAGES["language"](spark, d, tiny).collect()} == said
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    good = {r.doc_id for r in quality.predict(d, quality.learn(d, labels)).collect() if r.predicted}
    assert {r.doc_id for r in STAGES["quality"](spark, d, tiny).collect()} == good
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert all(known[i] == (i in good) for i in known if i in {r.doc_id for r in d.collect()})


def test_near_duplicates_keep_one_of_each_group(spark, docs, tiny):
    words = [f"w{i}" for i in range(60)]
    near = [*words]
    near[3] = "other"
    far = [f"x{i}" for i in range(60)]
    d = docs(" ".join(words), " ".join(near), " ".join(far), " ".join(far).upper(), None, "", " ".join(far), " ".join(near), ids=[9, 4, 7, 7, 1, 2, None, 9])
    rows = STAGES["near_duplicates"](spark, d, tiny).collect()
    assert sorted(((r.doc_id, (r.text or "")[:2].lower()) for r in rows), key=str) == [(1, ""), (2, ""), (4, "w0"), (7, "x0")]


def test_run(spark, tiny, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "root", lambda spark: f"file://{tmp_path}")
    rows = pipeline.run(spark, tiny).collect()
    assert [p.name.split("-")[:2] for p in tmp_path.iterdir()] == [["packing", "result"]]
    ends: dict = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in ends.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    again = pipeline.run(spark, tiny)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r[k] for k in key) for r in rows) == sorted(tuple(r) for r in again.select(*key).collect())


def test_run_equals_a_plain_version(spark, tiny):
    """All stages in loops over Python values, on the whole of a small table; places in sequences are checked above."""
    docs = sorted((r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect())
    model = plain.Languages([(t, x) for _, t, x, _ in docs])
    docs = [d for d in docs for lang, score in [model.say(d[1])] if lang != "und" and score >= pipeline.LEAST_SHARE]
    texts = {d[0]: d[1] for d in docs}
    labels = sorted((r.doc_id, r.quality) for r in spark.read.parquet(f"{tiny}/labels.parquet").collect() if r.doc_id in texts)
    model = plain.Quality([(texts[i], y) for i, y in labels])
    docs = [d for d in docs if model.score(d[1]) >= 0.5]
    kept = {i for i, _, _, first in brute_force([d[0] for d in docs], [d[1] for d in docs], pipeline.SIMILAR) if first}
    docs = [d for d in docs if d[0] in kept]
    size = Counter()
    for _, text, _, source in docs:
        size[source] += len(text)
    share = sum(np.sqrt(n) for n in size.values())
    rate = {x: sum(size.values()) * np.sqrt(n) / share / n for x, n in size.items()}
    encode, want = tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json"), memo=False), Counter()
    for i, text, _, source in docs:
        ids = encode(text) + b"\0" * 4
        for k in range(0, len(ids), 8192):
            want[i, k // 8192, k // 4, len(ids[k : k + 8192]) // 4, zlib.crc32(ids[k : k + 8192])] += poisson(uniform(7, i), rate[source])
    rows = pipeline.run(spark, tiny).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == +want
    assert len(rows) > 100 and len({r.sequence_id for r in rows}) == packing.lower_bound(Counter(r.length for r in rows), 2048)
