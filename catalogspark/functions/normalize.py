"""Stored JSON into typed columns, with built-in variant functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CARD_KEYS = ("capability", "tag", "status", "env", "visibility", "endpoint", "owner", "auth")
_EMPTY = "cast(map() as map<string,array<string>>)"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _once_more(v: Column) -> Column:
    """A JSON string that holds an object or a list is read once more."""
    text = F.try_variant_get(v, "$", "string")
    inside = F.try_parse_json(text)
    return F.when((_kind(v) == "STRING") & F.substring(F.ltrim(text), 1, 1).isin("{", "["), F.coalesce(inside, v)).otherwise(v)


def _as_text(v: Column) -> Column:
    """A JSON scalar as text, null as ``null``, lists and objects as their JSON."""
    return F.when(v.isNull() | F.is_variant_null(v), "null").when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _values(v: Column) -> Column:
    """A list gives its items, null nothing, anything else itself."""
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), _as_text)
    none = F.array().cast("array<string>")
    return F.when(v.isNull() | F.is_variant_null(v), none).when(_kind(v).startswith("ARRAY"), items).otherwise(F.array(_as_text(v)))


def normalize_attrs(text: Column) -> Column:
    """JSON text of attributes as map<string, array<string>>; what isn't an object has no attributes."""
    fields = F.try_variant_get(_once_more(F.try_parse_json(text)), "$", "map<string,variant>")
    return F.coalesce(F.transform_values(fields, lambda _, v: _values(v)), F.expr(_EMPTY))


def repair_double_encoded(text: Column) -> Column:
    """JSON text whose string value holds an object or a list becomes that; null stays null, invalid text as it is."""
    return F.coalesce(F.to_json(_once_more(F.try_parse_json(text))), text)


def normalize_entries(raw: DataFrame) -> DataFrame:
    """Entry rows with attrs, manifest and meta as JSON text into ``ENTRY_SCHEMA``."""
    ms = lambda c: F.date_trunc("MILLISECOND", F.col(c).cast("timestamp"))
    return raw.select(
        "id", F.col("rev").cast("int").alias("rev"), "type", "namespace", "name", F.coalesce("description", F.lit("")).alias("description"), "version",
        normalize_attrs(F.col("attrs")).alias("attrs"), repair_double_encoded(F.col("manifest")).alias("manifest"), repair_double_encoded(F.col("meta")).alias("meta"),
        ms("created_at").alias("created_at"), ms("updated_at").alias("updated_at"),
    )


def card_view(entries: DataFrame) -> DataFrame:
    """The short form: eight columns, and of the attributes the CARD_KEYS that have values."""
    attrs = F.map_filter("attrs", lambda k, v: k.isin(*CARD_KEYS) & (F.size(v) > 0))
    return entries.select("id", "type", "name", "namespace", "rev", "version", "description", attrs.alias("attrs"))


def full_view(entries: DataFrame) -> DataFrame:
    return entries


def ids_view(entries: DataFrame) -> DataFrame:
    return entries.select("id")


VIEWS = {"card": card_view, "full": full_view, "ids": ids_view}


def _is_text(v: Column) -> Column:
    return F.coalesce(_kind(v) == "STRING", F.lit(False))


def validate_publish(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``): id, type, namespace and name not empty; attrs an object of texts or lists
    of texts; meta an object or null."""
    fields = F.try_variant_get(F.try_parse_json("attrs"), "$", "map<string,variant>")
    texts = lambda v: _is_text(v) | (_kind(v).startswith("ARRAY") & F.forall(F.try_variant_get(v, "$", "array<variant>"), _is_text))
    good_attrs = F.col("attrs").isNull() | (fields.isNotNull() & F.coalesce(F.forall(F.map_values(fields), lambda v: F.coalesce(texts(v), F.lit(False))), F.lit(False)))
    meta = F.try_parse_json("meta")
    good_meta = F.col("meta").isNull() | F.coalesce(F.is_variant_null(meta) | _kind(meta).startswith("OBJECT"), F.lit(False))
    reason = F.lit(None).cast("string")
    for problem, fails in [("meta", ~good_meta), ("attrs", ~good_attrs), *[(c, F.coalesce(F.col(c), F.lit("")) == "") for c in ("name", "namespace", "type", "id")]]:
        reason = F.when(fails, problem).otherwise(reason)
    judged = raw.withColumn("reason", reason)
    accepted = judged.where("reason is null").drop("reason").withColumn("description", F.coalesce("description", F.lit("")))
    return accepted, judged.where("reason is not null")


STATUSES = ("active", "deprecated", "disabled")


def validate_set_status(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a known status; the reason null or not empty."""
    good = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)) & (F.col("reason").isNull() | (F.col("reason") != ""))
    return raw.where(good), raw.where(~good)
