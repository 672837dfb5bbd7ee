"""Thin queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocation, convtrie, decontam, hpylm, langid, licenses, neardup, partenum, quality, secrets, tokenbin, vptree


def vocabulary(name: str) -> str:
    """Where a tokenizer file is: in TALLYLOOM_TOKENIZERS if set, else in the installed package."""
    import public_tokenizers

    return os.environ.get("TALLYLOOM_TOKENIZERS", "") and os.path.join(os.environ["TALLYLOOM_TOKENIZERS"], name) or public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out())
    found = langid.predict(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    spans = F.col("secrets")
    return found.select(
        "doc_id",
        *[secrets.count_of(spans, kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(F.encode(secrets.joined(spans, secrets.KINDS[:3]), "UTF-8"), 256).alias("base_sha256"),
        secrets.joined(spans, secrets.KINDS).alias("spans"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.good(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.resample(docs, F.col("target"))


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenbin.tokenize_to_files(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(_table(spark, sf_dir, "documents"), langid.held_out(parts=7))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(_table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("licenses.license"))), ",")
    spans = F.array_join(F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), names.alias("licenses"), spans.alias("spans"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.prefix_trie(convtrie.rebuilt(convtrie.turn_arrays(_table(spark, sf_dir, "conversations"))))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_classes(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language": op1_language,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_token_binary": op4_token_binary,
    "op5_language_model": op5_language_model,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_decontamination": op7_decontamination,
    "op8_nearest": op8_nearest,
    "op9_licenses": op9_licenses,
    "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op6_near_duplicates": neardup.ORACLE,
    "op7_decontamination": decontam.ORACLE,
    "op8_nearest": vptree.ORACLE,
    "op11_prefix_trie": convtrie.ORACLE,
    "op12_jaccard_join": partenum.ORACLE,
    "op13_collocations": collocation.ORACLE,
}
