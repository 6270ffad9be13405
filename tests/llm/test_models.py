"""Language identification and the quality classifier."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasemesh.llm import langid, quality

import plain

EN = "the house and the garden are with this old man who was there for them when they went home"
DE = "der mann und die frau sind mit dem kind nicht in das haus gegangen weil es schon spät für sie war"
RU = "это было давно и мы пошли домой потому что там никого не было"


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(0)
    rows = []
    for lang, text in (("en", EN), ("de", DE), ("ru", RU)):
        words = text.split()
        rows += [(i, " ".join(rng.permutation(words)), lang) for i in range(30)]
    return langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_repeated_doc_ids_in_the_sample(spark):
    """A doc_id of most rows counts as one; the bound holds and is used up, whatever the hashes."""
    fields = "doc_id long, text string, lang string"
    one = langid.learn(spark.createDataFrame([(7, f"word{'abcdefgh'[k % 8] * 3}", "en") for k in range(60)], fields), rows=2)
    assert one.languages == ["en"]
    rows = [(0 if k < 300 else k, f"text{'abcdefgh'[k % 8]}", f"l{k}") for k in range(400)] + [(None, "none", f"n{k}") for k in range(50)]
    for n in (1, 5, 60, 449, 450, 1000):
        assert len(langid.learn(spark.createDataFrame(rows * 2, fields).repartition(3), rows=n).languages) == min(n, 450)


def test_scripts():
    cp = np.array([ord(c) for c in "aéЖα中あ한अ5 "])
    names = [langid.SCRIPTS[i][0] if i >= 0 else None for i in langid.script_of(cp)]
    assert names == ["Latin", "Latin", "Cyrillic", "Greek", "Han", "Kana", "Hangul", "Devanagari", None, None]


def test_predictions_and_odd_rows(spark, docs, model):
    texts = [EN, DE, RU, None, "", "12 34 !!", "\u4e2d\u6587", "x" * 100_000, EN]
    rows = langid.predict(docs(*texts, ids=[0, 1, 2, 3, 4, 5, 6, None, 0]), model).collect()
    got = [r.lang_pred for r in rows]
    assert got[:6] == ["en", "de", "ru", "und", "und", "und"] and got[8] == "en"
    assert got[6] in model.languages and got[7] in ("en", "de")
    assert all(0 <= r.score <= 1 for r in rows) and rows[3].score == 0
    out = langid.annotate(docs(*texts, extra=False), model)
    assert out.columns[-2:] == ["lang_pred", "score"] and out.count() == len(texts)
    assert langid.predict(docs("a").limit(0), model).count() == 0


def test_spans(spark, docs, model):
    mixed = f"{EN} 17 {DE} {RU}"
    spans = [(r.lang, r.first_word, r.last_word) for r in langid.spans(docs(mixed, None), model).orderBy("first_word").collect()]
    n, m, k = len(EN.split()), len(DE.split()), len(RU.split())
    assert spans == [("en", 0, n - 1), ("de", n + 1, n + m), ("ru", n + m + 1, n + m + k)]


def test_every_letter_of_text_without_spaces_is_read(spark, docs, model):
    rng = np.random.default_rng(3)
    glued = {lang: "".join(rng.permutation(text.split() * 200)) for lang, text in (("en", EN), ("de", DE), ("ru", RU))}
    texts = [EN.replace(" ", "")[:64] + glued[k] for k in ("de", "ru")] + [glued["de"] + " " + EN, glued["ru"][:3000] + glued["en"]]
    rows = langid.predict(docs(*texts), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["de", "ru", "de", "en"]
    assert rows[1].score == pytest.approx(1 - 64 / len(texts[1]), abs=1e-9)  # cut where the script changes
    assert rows[3].score == pytest.approx(1 - 3000 / len(texts[3]), abs=0.02)
    spans = [(r.lang, r.first_word, r.last_word) for r in langid.spans(docs(f"{EN} {glued['ru']}{glued['en']} {EN}"), model).collect()]
    n = len(EN.split())
    assert spans == [("en", 0, n - 1), ("ru", n, n), ("en", n, 2 * n)]
    assert [len(p) for p in langid.pieces("a" * 130 + "\u0431" * 3 + "\u13a0" + "a")] == [64, 64, 2, 4, 1]
    learned = langid.learn(spark.createDataFrame([(0, "a" * 64 + glued["ru"], "x"), (1, "a" * 64 + glued["de"], "y")], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in langid.predict(docs(RU, DE), learned).orderBy("doc_id").collect()] == ["x", "y"]


def test_every_language_learned_can_be_named(spark, docs, monkeypatch):
    rng = np.random.default_rng(4)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)] for _ in range(150)]
    rows = [(i, " ".join(w * (1 + i % 3)), f"l{i:03}") for i, w in enumerate(words)]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert learned.languages == [r[2] for r in rows]
    texts = [" ".join(rng.permutation(w)) for w in words]
    found = langid.predict(docs(*texts), learned).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score) for r in found] == [(r[2], 1.0) for r in rows]
    plain = [w for some in words for w in some]
    sparse = langid.Labeller(learned)._score(plain)
    monkeypatch.setattr(langid, "DENSE", 200)
    assert np.allclose(langid.Labeller(learned)._score(plain), sparse, atol=1e-4)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    scores = rng.standard_normal((9, 3)).astype(np.float32) * 2
    seqs = [rng.integers(0, 9, n) for n in (1, 6, 4, 0, 5)]
    for penalty in (0.0, 1.0, 5.0):
        for s, got in zip(seqs, langid.viterbi(seqs, scores, penalty)):
            def value(path):
                return sum(float(scores[w, x]) for w, x in zip(s, path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

            best = max((value(p) for p in itertools.product(range(3), repeat=len(s))), default=0)
            assert value(list(got)) == pytest.approx(best)


def test_nothing_to_learn_from(spark, docs):
    empty = docs("a b", None)
    rows = langid.identify(empty.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * 2


def test_languages_equal_a_plain_version(spark, tiny):
    """Word scores, script narrowing, paths and document scores on whole texts of a table with odd ones."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect() if r.text is None or len(r.text) < 6000]
    rows += [(9001, "\u4e2d\u6587" * 90 + "abc" * 40, "zh"), (9002, f"{RU} {EN} \u4e2d\u6587 12 x!y", None), (9003, RU * 3, "ru"), (9004, "\u65e5\u672c" * 70, None), (9005, "\u0130 " * 9, None), (9006, EN.replace(" ", ""), None), (9007, None, "en"), (9008, "\u0e01" * 70 + RU, None)]
    model = plain.Languages([(t, x) for i, t, x in rows if not plain.held_out(i, 5, 0)])
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) > 100
    for i, text, _ in rows:
        lang, score = model.say(text)
        assert got[i] == (plain.held_out(i, 5, 0), lang, pytest.approx(score)), (i, text)


def test_quality_equals_a_plain_version(spark, tiny):
    """Features, class ratios, the descent and scores of whole texts."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect() if r.text is None or len(r.text) < 6000}
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    known = sorted((r.doc_id, r.quality) for r in labels.collect() if r.doc_id in rows and not plain.held_out(r.doc_id, 3, 1))
    model = plain.Quality([(rows[i], y) for i, y in known])
    docs = spark.createDataFrame([*rows.items(), known[0][:1] + (rows[known[0][0]],)], "doc_id long, text string")  # one doc_id twice
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows) > 100 and len(known) > 30
    for i, text in rows.items():
        score = model.score(text)
        assert got[i] == (plain.held_out(i, 3, 1), pytest.approx(score, abs=1e-9), int(score >= 0.5))


def test_bytes_that_the_driver_takes_are_bounded(spark, tiny, monkeypatch):
    d, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    taken = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels: taken.append(sum(4 * len(r) for r in rows)))
    quality.learn(d, labels)
    monkeypatch.setattr(quality, "LEARN_BYTES", taken[0] // 3)
    quality.learn(d, labels)
    assert 0 < taken[1] < taken[0] / 2


def test_language_of_held_out_texts(spark, tiny):
    d = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    blind = langid.identify(d.where("true").withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))))
    assert sorted(tuple(r) for r in blind.select("doc_id", "lang_pred").collect()) == sorted((r.doc_id, r.lang_pred) for r in langid.identify(d).collect())


def test_features_are_distinct_and_see_form():
    at = quality.features("Word word word WORD!! a$ " * 40)
    assert len(set(at.tolist())) == len(at) and at.max() < quality.SIZE
    assert len(quality.features(None)) == len(quality.features(" \n")) == 0
    assert set(quality.features("a b c")) != set(quality.features("a b c!!"))


def test_features_see_word_pairs():
    one, other = (quality.features(x) for x in ("red cat big dog", "red dog big cat"))
    differ = set(one.tolist()) ^ set(other.tolist())
    assert len(differ) == 6 and min(differ) >= quality.PAIRS
    rows = [quality.features(x) for x in ("red cat big dog", "red dog big cat") for _ in range(5)]
    m = quality.fit(rows, np.repeat([1, 0], 5))
    assert m.score("red cat big dog") > 0.6 and m.score("red dog big cat") < 0.4


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 12) + 15 * y).astype(np.int32) for y in (0, 1) for _ in range(40)]
    labels = np.repeat([0, 1], 40)
    m = quality.fit(rows, labels, epochs=400)
    x = np.zeros((80, 64))
    for i, at in enumerate(rows):
        x[i, at] = m.ratio[at]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    y = 2.0 * labels - 1

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()

    w, b = m.weight[:64].copy(), m.bias
    best = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.standard_normal(64) * 0.05, b + rng.standard_normal() * 0.05) >= best - 1e-3


def test_quality_of_odd_rows(spark, docs, tiny):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (3, 7), (None, 1), (4, 1), (4, 0), (5, 0), (0, 1)], "doc_id long, quality int")
    d = docs("good text here", "BAD!! BAD!!", None, "", "x" * 50_000, "BAD!! TEXT!!", ids=[0, 1, None, 3, 4, 5])
    rows = quality.classify(d, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    alone = quality.classify(d, labels.limit(0)).collect()
    assert {r.score for r in alone} == {0.5}
    assert quality.classify(d.limit(0), labels).count() == 0


def test_quality_of_held_out_texts(spark, tiny):
    d, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    out = quality.classify(d, labels).cache()
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.95
    blind = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.classify(d, blind).collect())) == sorted(map(tuple, out.collect()))
