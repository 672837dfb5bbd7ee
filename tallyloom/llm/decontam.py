"""Benchmark decontamination by size-partitioned MinHash containment search (operator 7).

Native: DataFrame functions only, no Python on the executors.

A short item inside a long document has a tiny Jaccard similarity, so plain
MinHash bands miss it. Items are therefore partitioned by shingle count (powers of
two), and each partition keeps of every item its k smallest min-wise hash values,
with k = floor((100 - percent) * largest count / 100) + 1. A document that contains
``percent`` of an item lacks fewer than k of its shingles, so at least one of
these values is among the document's hashes: the search can't miss. Candidates
are then verified by exact containment of full shingle sets.

The documents are read, hashed and probed where they lie. The items' values are
broadcast only when a count shows them to be few; beyond that both sides are
shuffled by hash, and no group of a document or item is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import save, small_side

WORDS = 5
PERCENT = 80


def shingle_hashes(text: Column, width: int = WORDS) -> Column:
    """Distinct 64-bit hashes of a text's word shingles.

    Words are runs without space and \\x09-\\x0D, lower-cased. Fewer than
    ``width`` words: the whole sequence as one shingle; none: an empty array.
    """
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def spans(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[w[i + k] for k in range(width)]))
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, F.array(F.xxhash64(w, F.size(w)))).otherwise(F.array().cast("array<bigint>"))

    one = F.transform(F.array(found), spans)
    return F.array_distinct(one[0])


def item_index(items: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``item_id``, ``shingles``, ``n_item``, ``keys``: an item's min-wise values.

    Rows with a null id or no words are left out; of rows with equal ids and
    texts one stays.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.array_sort(shingle_hashes(F.col("text"), width)).alias("shingles"))
    rows = rows.where(F.col("item_id").isNotNull() & (F.size("shingles") > 0)).distinct().withColumn("n_item", F.size("shingles").cast("long"))
    largest = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    k = F.floor(largest * (100 - percent) / 100).cast("int") + 1
    return rows.withColumn("keys", F.slice("shingles", 1, k))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item of which it contains ``percent`` or more.

    Returns ``doc_id``, ``item_id``, ``n_item`` (the item's distinct shingles),
    ``n_shared`` and ``containment`` (their ratio). Null texts and texts
    without words contain nothing and are contained nowhere; documents or items
    with a null id can't be named and give no pair. Rows with equal ids count
    as one document, whose shingles are all of theirs. Items of fewer words than ``width`` match only a
    document that is the same word sequence. Empty tables give no rows;
    other columns are not read.
    """
    index = save(item_index(items, width, percent))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    hashed = source.select("doc_id", F.explode(shingle_hashes(F.col("text"), width)).alias("h"))
    keys = save(index.select("item_id", F.explode("keys").alias("h")))
    pairs = save(hashed.join(small_side(keys), "h").select("doc_id", "item_id").distinct())

    ids = save(pairs.select("doc_id").distinct())
    suspects = source.join(small_side(ids), "doc_id", "left_semi")
    suspects = suspects.select("doc_id", F.explode(shingle_hashes(F.col("text"), width)).alias("h"))
    whole = save(index.select("item_id", "n_item", F.explode("shingles").alias("h")))
    shared = suspects.join(small_side(whole), "h").select("doc_id", "item_id", "n_item", "h").distinct()
    shared = shared.groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    found = shared.join(pairs, ["doc_id", "item_id"]).where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return found.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that contain no item; columns as they came, whatever their names.

    Rows with a null id or text stay. Rows with equal ids are one document: all of them
    stay or none, and repeated rows stay repeated. Without items all rows stay.
    """
    held = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    name = dict(zip(docs.columns, held.columns, strict=True))
    id_col, text_col = (name[options.pop(k, d)] for k, d in (("id_col", "doc_id"), ("text_col", "text")))
    found = contaminated(held, items, id_col=id_col, text_col=text_col, **options)
    bad = save(found.select(F.col("doc_id").alias("_bad")).distinct())
    return held.join(small_side(bad), F.col(id_col).cast("long") == F.col("_bad"), "left_anti").toDF(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * 80
"""
