"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, delete_result
from . import covertree, langid, minmax, mixing, oracles, packing, pii, quality, repair, rules, store, token_files, tokens, urls, warc

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return store.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "op1") as tmp:
        archives = warc.write(table(spark, sf_dir, "pages"), tmp.place("archives"))
        found = tmp.result(warc.read(archives, tmp=tmp).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
        delete_result(archives)
        return found


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    crc = F.crc32(F.col("text").cast("binary"))
    # the whole copies are shuffled and written; a row is given only for a copy whose text was read back as it was sent
    mixed = Scratch(spark, "mixed").result(mixing.replicate(docs.withColumn("crc", crc), alpha=0.5, epochs=1.0, seed=7))
    key = F.when(crc.eqNullSafe(F.col("crc")), F.col("shuffle_key")).otherwise(F.raise_error(F.lit("a copy's text has changed")))
    return mixed.select("doc_id", "source", "part", "copy", key.alias("shuffle_key")).orderBy("shuffle_key", "doc_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "op3") as tmp:
        made = token_files.write(table(spark, sf_dir, "documents"), tmp.place("token-files"), tokens.tokenizer_path(BYTE_BPE))
        found = tmp.result(token_files.read_digests(made))
        delete_result(made)
        return found


def op4_langid_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.tokenizer_path(WORD_BPE), 2048)


def op6_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.groups(table(spark, sf_dir, "documents"), percent=85)


def op7_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op9_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's measurements and verdict, and for texts that one rule alone drops this rule and how many it does so."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "policy", "policy_version", "alone"]
    with Scratch(spark, "op10") as tmp:
        entries = tmp.save(rules.ledger(table(spark, sf_dir, "documents")), "ledger")
        lost = rules.ablations(entries).where("without is not null").select(F.col("without").alias("alone"), F.col("dropped_by_it_alone").alias("alone_docs"))
        judged = rules.apply(entries).select(*columns).join(F.broadcast(lost), "alone", "left")  # one row for each rule
        return tmp.result(judged.select(*columns, "alone_docs"))


def op11_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.reports(repair.damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_warc_zip": op1_warc_zip,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_token_files": op3_token_files,
    "op4_langid_viterbi": op4_langid_viterbi,
    "op5_packing": op5_packing,
    "op6_minmax_dedup": op6_minmax_dedup,
    "op7_nbsvm_quality": op7_nbsvm_quality,
    "op8_cover_tree": op8_cover_tree,
    "op9_url_trie": op9_url_trie,
    "op10_rule_ledger": op10_rule_ledger,
    "op11_pii_spans": op11_pii_spans,
    "op12_conversation_repair": op12_conversation_repair,
}

ORACLES = oracles.SQL
