"""A corpus pipeline of five operators: language, quality, near-duplicates, mixing, packing.

Each stage takes the documents that its predecessor kept, decides on all of them, and returns those that it keeps with
the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemesh.llm import langid, minmax, mixing, packing, quality, store, tokens
from phasemesh.scratch import Scratch, delete_result

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose largest language has less than this share of its letters, or that has no letters, is rejected.
LEAST_SHARE = 0.4
#: Percent of shingles that near-duplicates share (40 bands of 6 miss 5 in a million pairs of just this similarity).
SIMILAR = 80


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in which no language stands out.

    Null and empty texts go; rows that repeat a doc_id are judged one by one; columns other than those of documents are
    left out; an empty table gives no rows, and so does one without any language to learn.
    """
    docs = store.only(docs, *COLUMNS)
    said = langid.annotate(docs, langid.learn(docs))
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality model, learned from the labels, takes for bad ones.

    Null and empty texts are judged by the model's bias; rows that repeat a doc_id, or have none, are judged one by one;
    without any label, or with those of one class, all get that share and stay if it is a half at least; an empty table
    gives no rows.
    """
    docs = store.only(docs, *COLUMNS)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.annotate(docs, model).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest doc_id; rows without words stay.

    Rows get a number of their own first, so that decisions on rows that repeat a doc_id, or have none, stay apart; of
    rows with the smallest doc_id of a group the first stays.  An empty table gives no rows.  The returned plan reads the
    numbered rows, so they stay in the shared folder until :func:`run` has written the stage's result.
    """
    tmp = Scratch(spark, "near-duplicates")
    rows = tmp.save(store.only(docs, *COLUMNS).select("*", F.monotonically_increasing_id().alias("_row")), "numbered")
    said = minmax.groups(rows.select(F.col("_row").alias("doc_id"), "text"), percent=SIMILAR, bands=40, rows=6)
    named = said.join(rows.select(F.col("_row").alias("doc_id"), F.col("doc_id").alias("id")), "doc_id")
    # of each group the row with the smallest doc_id (rows without one last), then the first of these rows
    best = named.groupBy("component_id").agg(F.min_by("doc_id", F.struct(F.col("id").isNull(), "id", "doc_id")).alias("_row"))
    chosen = tmp.save(best.select("_row"), "chosen")
    delete_result(said)
    kept = store.semi(rows, chosen, "_row").select(*COLUMNS)
    kept.scratch = tmp
    return kept


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources have shares in proportion to the square root of their sizes; shuffles all.

    Documents of a source without text get no copies; null is a source of its own; rows that repeat a doc_id draw alike
    and are each copied; an empty table gives no rows.
    """
    return mixing.replicate(store.only(docs, *COLUMNS), alpha=0.5, epochs=1.0, seed=7).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all copies into sequences of at most 2048 token ids.

    A null or empty text is the end id alone; every row, with whatever doc_id, is packed; an empty table gives no rows.
    """
    return packing.pack(docs, tokens.tokenizer_path("word_bpe_49k.json"), 2048)


STAGES = [
    ("language", languages),
    ("quality", good_texts),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The learned models and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on documents, each written as Parquet and read again by the next; a stage's table
    goes when the next one is written.
    """
    docs = store.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    with Scratch(spark, "pipeline") as tmp:
        for name, stage in STAGES[:-1]:
            made = stage(spark, docs, sf_dir)
            written = tmp.save(made, name)
            if hasattr(made, "scratch"):
                made.scratch.close()
            tmp.discard(docs)
            docs = written
        return STAGES[-1][1](spark, docs, sf_dir)
