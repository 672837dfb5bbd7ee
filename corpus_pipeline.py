"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's documents. All stages but the last return the
columns of the documents as they came, whatever further columns these have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontam, langid, neardup, secrets
from tallyloom.llm.base import save, small_side
from tallyloom.llm.queries import vocabulary

#: A predicted language's share of the softmax over all languages that is enough by itself.
LEAST_SCORE = 0.4
#: Log odds above which other texts are like no language (about 19 to 1).
STRANGE = 3.0
#: Near duplicates on word shingles take five words.
SHINGLE_WORDS = 5


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns under names that clash with nothing, and those names by column."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; texts without letters and texts like none go.

    A short text is near to no landmark, so a small share of its language is no reason to drop it:
    its n-grams must be ones that the landmarks don't have.
    The model learns from a bounded sample of the labelled documents.
    """
    model = langid.fit(docs)
    held, names = _numbered(docs)
    found = langid.predict(held, model, text_col=names["text"], keep=list(names.values()), strangeness=True)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & ((F.col("score") >= LEAST_SCORE) | (F.col("strangeness") <= STRANGE)))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def _with_row(held: DataFrame, id_col: str) -> DataFrame:
    """``_row``: the id where it is one row's alone, else a number larger than all ids."""
    own = F.col(id_col).cast("long")
    twice = save(held.select(own.alias("_id")).groupBy("_id").count().where("count > 1 or _id is null").select("_id"))
    if twice.isEmpty():
        return held.withColumn("_row", own)
    top = held.agg(F.max(own)).first()[0] or 0
    marked = held.join(small_side(twice.where("_id is not null")), own == F.col("_id"), "left")
    alone = own.isNotNull() & F.col("_id").isNull()
    return save(marked.withColumn("_row", F.when(alone, own).otherwise(F.lit(max(top, 0) + 1).cast("long") + F.monotonically_increasing_id())).drop("_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id; a null id is larger than all others.

    Rows with a null or repeated id get numbers of their own, beyond all ids, so rows repeated
    with the same id, and copies with a null id, leave one row, and different texts under
    the same id are different documents. Rows without words stand alone.
    """
    held, names = _numbered(docs)
    rows = _with_row(held, names["doc_id"])
    found = neardup.near_duplicates(rows, width=SHINGLE_WORDS, id_col="_row", text_col=names["text"])
    others = found.where(~F.col("kept")).select(F.col("doc_id").alias("_row"), "component_id")
    members = save(others.unionByName(others.select(F.col("component_id").alias("_row"), "component_id").distinct()))
    ids = rows.select("_row", F.col(names["doc_id"]).alias("id")).join(small_side(members), "_row")
    ids = save(ids.select("_row", "component_id", F.struct(F.col("id").isNull().alias("none"), "id", "_row").alias("place")))
    first = ids.groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first._row").alias("_row"))
    gone = save(ids.select("_row").join(small_side(save(first)), "_row", "left_anti"))
    return rows.join(small_side(gone), "_row", "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced, and ``n_chars`` to match."""
    held, names = _numbered(docs)
    found = secrets.find_secrets(held, text_col=names["text"], keep=[n for c, n in names.items() if c != "text"], redact=True)
    new = {"text": F.col("redacted"), "n_chars": F.coalesce(F.length("redacted").cast("long"), F.col(names.get("n_chars", "redacted")).cast("long"))}
    return found.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens``, ``ids``, and whether decoding gave the text back."""
    found = bpe.round_trip(docs, vocabulary("byte_bpe_50k.json"), keep=["doc_id", "lang", "source", "text"])
    same = F.coalesce(F.col("decoded") == F.col("text"), F.col("decoded") == "")
    return found.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("token_ids", token_ids),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
