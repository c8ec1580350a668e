"""Forms in which other systems take a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.index import tokens


def write_entries_jsonl(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


def percent_encode(text: Column) -> Column:
    """As for a URI component: form encoding, but blanks as %20 and ``~ ! ' ( )`` as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def export_set_members(entries: DataFrame) -> DataFrame:
    """(kind, set_key, id): the universe, and the members of each equality and presence set."""
    rows = tokens(entries)
    base = F.concat(F.when(F.col("kind") == "eq", "bench:eq:").otherwise("bench:pr:"), "scope", F.lit(":"), percent_encode(F.col("key")))
    key = F.when(F.col("kind") == "eq", F.concat(base, F.lit(":"), percent_encode(F.col("value")))).otherwise(base)
    return rows.select("kind", key.alias("set_key"), "id").unionByName(entries.select(F.lit("universe").alias("kind"), F.lit("bench:universe").alias("set_key"), "id"))


def _first(key: str) -> Column:
    return F.coalesce(F.get(F.col("attrs")[key], F.lit(0)), F.lit(""))


def _values(key: str) -> Column:
    return F.coalesce(F.col("attrs")[key], F.array().cast("array<string>"))


def export_flat_docs(entries: DataFrame) -> DataFrame:
    """One flat row per entry: single values, and lists joined by commas."""
    joined = lambda k: F.array_join(_values(k), ",").alias(k)
    return entries.select("id", "type", "namespace", *[_first(k).alias(k) for k in ("env", "status", "visibility")], *map(joined, ("tag", "capability", "endpoint")))


def export_directory_attrs(entries: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Names that a directory knows; empty values are null; a uid that exists already is left out."""
    some = lambda c: F.when(c != "", c)
    many = lambda k: F.when(F.size(_values(k)) > 0, _values(k))
    out = entries.select(
        F.col("id").alias("uid"), F.col("id").alias("cn"), some(F.col("type")).alias("ou"), some(F.col("namespace")).alias("o"), some(_first("env")).alias("l"),
        some(_first("status")).alias("title"), some(_first("visibility")).alias("employeeType"), many("tag").alias("businessCategory"),
        many("capability").alias("departmentNumber"), many("endpoint").alias("labeledURI"),
    ).dropDuplicates(["uid"])
    return out if existing is None else out.join(existing.select("uid"), "uid", "left_anti")
