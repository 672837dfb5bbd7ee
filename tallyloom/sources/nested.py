"""Fields of nested documents, read by a schema that allows for what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is read of a bill; all else in the document is passed over.
BILL = (
    "meta struct<congress:int,bill_number:int,date_filed:string,title:string,long_title:string,congress_website_title:string,scope:string,congress_website_author_codes:array<string>>, "
    "history array<struct<action:string,date:string>>, status array<struct<status:string,date:string>>, committees array<struct<name:string>>"
)
PERSON = "id string, last_name string, first_name string, middle_name string, congress_website_author_keys array<string>, memberships array<struct<congress:int,subtype:string>>"
#: An act's number, and what says that a bill became one.
ACT = r"(?i)REPUBLIC\s+ACT\s*(?:NO\.?|NUMBER)?\s*([0-9]{3,5})"
APPROVED = r"(?i)(approved by the president|signed into law|enacted into law|lapsed into law|became (?:republic act|law))"


def first(values: Column) -> Column:
    """The first element; null for a list that is missing or empty."""
    return F.try_element_at(values, F.lit(1))


def last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def bills(documents: DataFrame, json: str, keep: list[str] | None = None) -> DataFrame:
    """One row a document: the fields of a bill with its first author, last status, first committee, and the act that it became.

    Missing and empty lists, and missing fields, give null (``n_authors`` 0); a text that is no JSON gives a row of nulls. The act is that of the last
    entry of the history that names one and is an approval, follows one, or names it in full.
    """
    doc = documents.select(*(keep or []), F.from_json(json, BILL, {"mode": "PERMISSIVE"}).alias("d")).select(*(keep or []), "d.*")
    m = F.col("meta")
    approved = lambda h: F.coalesce(h["action"].rlike(APPROVED), F.lit(False))
    entry = F.transform("history", lambda h, i: F.struct(F.regexp_extract(F.coalesce(h["action"], F.lit("")), ACT, 1).alias("ra"), h["date"].alias("date"), (approved(h) | (F.coalesce(i > 0, F.lit(False)) & approved(F.try_element_at(F.col("history"), F.greatest(i, F.lit(1))))) | F.upper(h["action"]).contains("REPUBLIC ACT NO")).alias("passed")))
    act = last(F.filter(entry, lambda e: (e["ra"] != "") & e["passed"]))
    codes = m["congress_website_author_codes"]
    return doc.select(
        *(keep or []), m["congress"].alias("congress"), m["bill_number"].alias("bill"), m["date_filed"].alias("date_filed"), F.trim(m["title"]).alias("title"), F.trim(F.coalesce(F.nullif(m["long_title"], F.lit("")), m["congress_website_title"])).alias("long_title"),
        m["scope"].alias("scope_house"), first(codes).alias("author_code"), F.coalesce(F.size(F.array_distinct(codes)), F.lit(0)).alias("n_authors"), last(F.col("status"))["status"].alias("status"), last(F.col("status"))["date"].alias("status_date"),
        act["ra"].cast("int").alias("ra"), act["date"].alias("ra_history_date"), first(F.col("committees"))["name"].alias("committee"),
    )


def people(documents: DataFrame, json: str, order: str) -> DataFrame:
    """``ord``, ``name``, ``keys`` and ``congresses`` of persons, as ``records.memberships`` takes them (C18): terms in the House alone, in order."""
    doc = documents.select(F.col(order).alias("ord"), F.from_json(json, PERSON).alias("d")).select("ord", "d.*")
    house = F.array_sort(F.transform(F.filter("memberships", lambda t: t["subtype"] == "house"), lambda t: t["congress"]))
    name = F.trim(F.concat_ws(" ", "first_name", "last_name"))
    return doc.select("ord", name.alias("name"), F.coalesce("congress_website_author_keys", F.array().cast("array<string>")).alias("keys"), F.coalesce(house, F.array().cast("array<int>")).alias("congresses"))
