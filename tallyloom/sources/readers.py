"""Sources and sinks (S4-S9, S12-S18). Network fetches are out of scope: Spark reads landed files."""

from __future__ import annotations

import io
import tomllib
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array or object each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, plain or gzipped; quoted fields may hold line ends and doubled quotes."""
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', enforceSchema=False).csv(path)


def union_years(frames: dict[str, DataFrame], tag: str = "year") -> DataFrame:
    """Yearly tables with varying columns as one, each row with its year."""
    out = None
    for year, frame in frames.items():
        frame = frame.withColumn(tag, F.lit(year))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The first CSV member of each archive, as strings; UTF-8 or else Windows-1252.

    One task an archive; ``path`` of the archive is kept with each row.
    """
    names = [*columns, "path"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    member = next((n for n in archive.namelist() if n.lower().endswith(".csv")), None)
                    if member is None:
                        continue
                    raw = archive.read(member)
                try:
                    text = raw.decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = raw.decode("cp1252")
                for chunk in pd.read_csv(io.StringIO(text), dtype=str, keep_default_na=False, chunksize=20_000):
                    chunk = chunk.reindex(columns=columns).astype(object)
                    yield chunk.where(chunk.notna(), None).assign(path=str(place))[names].astype(object)

    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)


def read_toml(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``json`` of each TOML document (S9); give ``json`` to ``from_json`` with a schema."""
    import json

    @F.pandas_udf("string")
    def to_json(content: pd.Series) -> pd.Series:
        return content.map(lambda b: json.dumps(tomllib.loads(bytes(b).decode("utf-8", "replace")), default=str))

    return spark.read.format("binaryFile").load(path).select("path", to_json("content").alias("json"))


def read_latin(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``text`` of files in Latin-1."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("text"))


def html_table_rows(pages: DataFrame, html: str, keep: list[str], tag: str = "tr") -> DataFrame:
    """Rows of the tables in a page (S12): comments dropped; ``row`` from 1, ``cells`` and ``href``. ``tag`` is what begins a row."""
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    parts = pages.select(*keep, F.posexplode(F.split(body, rf"(?i)<{tag}[^>]*>")).alias("row", "part")).where("row > 0")
    cells = F.transform(F.split("part", r"(?i)</td>\s*<td[^>]*>"), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"(?U)\s+", " ")))
    return parts.select(*keep, "row", cells.alias("cells"), F.regexp_extract("part", r"""(?i)href\s*=\s*["']?([^"'\s>]+)""", 1).alias("href"))


@F.udtf(returnType="row int, cells array<string>, href string")
class TableRows:
    """Rows of the tables in a page as a table function, for SQL: ``SELECT page_id, r.* FROM pages, LATERAL table_rows(html, 'tr') r``.

    The same rows as ``html_table_rows``, which stays inside the JVM; a null page has none.
    """

    def eval(self, html: str, tag: str):
        import re

        if html is None:
            return
        parts = re.split(rf"<{tag}[^>]*>", re.sub(r"<!--.*?-->", "", html, flags=re.S), flags=re.I)
        for row, part in enumerate(parts[1:], 1):
            cells = [re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", c)).strip(" ") for c in re.split(r"</td>\s*<td[^>]*>", part, flags=re.I)]
            href = re.search(r"""href\s*=\s*["']?([^"'\s>]+)""", part, re.I)
            yield row, cells, href[1] if href else ""


def register(spark: SparkSession) -> None:
    """Make the table function and the archive source known to a session."""
    from .archives import ZippedCsv

    spark.udtf.register("table_rows", TableRows)
    spark.dataSource.register(ZippedCsv)


GEOJSON = "features array<struct<properties:string,geometry:string>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature with a geometry (S14): ``properties`` (JSON) and ``parts``, the outer rings.

    Polygons and multipolygons alike give an array of outer rings; files without
    features, and features with a null or other geometry, give none.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", GEOJSON).alias("g"))
    each = raw.select(F.explode("g.features").alias("f")).select("f.properties", "f.geometry")
    kind = F.get_json_object("geometry", "$.type")
    shape = F.get_json_object("geometry", "$.coordinates")
    one = F.from_json(shape, "array<array<array<double>>>")
    many = F.from_json(shape, "array<array<array<array<double>>>>")
    parts = F.when(kind == "Polygon", F.array(one[0])).when(kind == "MultiPolygon", F.transform(many, lambda p: p[0]))
    return each.select("properties", parts.alias("parts")).where(F.col("parts").isNotNull())


def provenance(files: DataFrame, note: str) -> DataFrame:
    """A log row for each file of a ``binaryFile`` table."""
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.current_timestamp().alias("retrieved_utc"), F.lit(note).alias("note"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str], compressed: bool = False) -> None:
    """CSV parts with a header and a fixed order of columns and rows."""
    ready = df.select(*columns).orderBy(*order)
    ready.write.mode("overwrite").options(header=True, escape='"', **({"compression": "gzip"} if compressed else {})).csv(path)


def as_document(df: DataFrame, name: str) -> DataFrame:
    """A small mart as one JSON array in one row (C14)."""
    return df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name))


def joined(values: Column, separator: str = "; ") -> Column:
    """A list as one CSV field."""
    return F.array_join(values, separator)
