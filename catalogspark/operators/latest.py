"""The newest revision of each id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.normalize import repair_double_encoded


def newest(rows: DataFrame, rank: list[str]) -> DataFrame:
    """The rows that no other of their id outranks, by the columns ``rank``.

    The winners are found on id and rank alone, added up before the shuffle, so an id with very many rows is no hot key;
    the rows are then met by (id, rank). So of the rows only columns that are asked for are read and moved, and a
    condition on the id reaches both scans."""
    top = rows.groupBy("id").agg(F.max(F.struct(*rank)).alias("_top")).select("id", *[F.col(f"_top.{c}").alias(c) for c in rank])
    return rows.join(top, ["id", *rank], "left_semi")


def latest_revisions(entries: DataFrame, repair: bool = True) -> DataFrame:
    """Newest revision of each id, doubly encoded JSON repaired. (id, rev) is the key of ``entries``."""
    out = newest(entries, ["rev"]).select(*entries.columns)
    return out.withColumns({c: repair_double_encoded(F.col(c)) for c in ("manifest", "meta")}) if repair else out


def merge_latest(latest: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert: an incoming revision replaces a stored one that isn't newer."""
    both = latest.withColumn("_new", F.lit(0)).unionByName(incoming.select(*latest.columns).withColumn("_new", F.lit(1)))
    return newest(both, ["rev", "_new"]).select(*latest.columns)
