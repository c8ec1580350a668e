"""Deterministic synthetic entries and a small seed catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import ENTRY_COLUMNS, ENTRY_SCHEMA
from .adapters import pick

#: Fixed values, which the published statistics follow from.
TAGS = ("finance", "pdf", "docs", "search", "code", "support")
CAPABILITIES = ("summarize", "extract", "classify")
RAG_CAPABILITIES = ("retrieve", "embed", "rerank")
ENVIRONMENTS = ("prod", "staging", "dev")
GROUPS = ("eng", "finance", "ops")


def generate_entries(spark: SparkSession, n: int) -> DataFrame:
    """``n`` entries, each a function of its index alone."""
    return entries_of(spark.range(n).select(F.col("id").alias("i")))


def entries_of(rows: DataFrame) -> DataFrame:
    """The entry of each index of ``rows(i long)``."""
    i = F.col("i")
    kind = F.when(i % 10 < 6, "skill").when(i % 10 < 8, "rag").otherwise("mcp")
    seen = F.when(i % 20 == 0, "restricted").when(i % 8 == 0, "internal").otherwise("public")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    endpoint = text("https://", kind, ".bench.local/", i)
    capability = F.when(kind == "rag", pick(i, RAG_CAPABILITIES)).otherwise(pick(i, CAPABILITIES))
    always = {
        "capability": capability, "tag": pick(i * 5, TAGS), "env": pick(i * 7, ENVIRONMENTS), "status": F.lit("active"), "visibility": seen,
        "endpoint": endpoint, "owner": F.lit("bench-team"),
    }
    base = F.create_map(*[x for k, v in always.items() for x in (F.lit(k), F.array(v))])
    attrs = F.when(seen == "restricted", F.map_concat(base, F.create_map(F.lit("allowed_group"), F.array(pick(i * 11, GROUPS))))).otherwise(base)
    at = F.timestamp_add("SECOND", (i % 86400).cast("int"), F.lit("2026-01-01").cast("timestamp"))
    return rows.select(
        F.concat(kind, F.lit(":bench:"), F.format_string("%09d", i)).alias("id"), F.lit(1).alias("rev"), kind.alias("type"), F.lit("bench").alias("namespace"),
        text(F.upper(kind), " Bench ", i).alias("name"), text("Synthetic ", kind, " benchmark capability ", i).alias("description"), F.lit("1.0.0").alias("version"),
        attrs.alias("attrs"), F.to_json(F.struct(endpoint.alias("endpoint"), F.when(kind == "mcp", "mcp").otherwise("http").alias("protocol"))).alias("manifest"),
        F.to_json(F.struct(F.lit("bench-generate").alias("source"), i.alias("index"))).alias("meta"), at.alias("created_at"), at.alias("updated_at"),
    ).select(*ENTRY_COLUMNS)


#: Fixed values: (id, rev, name, version, attributes).
SEED = (
    ("skill:acme:pdf-summarize", 1, "PDF Summarize", "1.0.0", {"capability": ["summarize"], "tag": ["pdf", "nlp"], "visibility": ["public"], "owner": ["acme-ai"]}),
    ("skill:acme:pdf-summarize", 2, "PDF Summarize", "1.1.0", {"capability": ["summarize"], "tag": ["pdf", "nlp"], "visibility": ["public"], "owner": ["acme-ai"], "endpoint": ["https://api.acme.dev/skill/pdf-summarize/v2"]}),
    ("mcp:acme:finance-tools", 1, "Finance Tools MCP", "0.9.0", {"capability": ["calc", "finance"], "tag": ["finance"], "visibility": ["internal"], "auth": ["sso"]}),
    ("rag:acme:sec-filings", 1, "SEC Filings RAG", "2026.01", {"capability": ["retrieve"], "tag": ["finance", "compliance"], "visibility": ["restricted"], "allowed_group": ["finance", "compliance"]}),
    ("skill:acme:meeting-minutes", 1, "Meeting Minutes", "2.0.0", {"capability": ["summarize", "extract-action-items"], "tag": ["meetings", "productivity"], "visibility": ["public"], "env": ["prod"]}),
    ("mcp:acme:code-search", 1, "Code Search MCP", "0.4.1", {"capability": ["search"], "tag": ["code", "engineering"], "visibility": ["restricted"], "allowed_group": ["eng"]}),
)


def seed_entries(spark: SparkSession) -> DataFrame:
    rows = [(i, rev, i.split(":")[0], "acme", name, "", version, {**attrs, "status": ["active"]}, None, None, None, None) for i, rev, name, version, attrs in SEED]
    at = F.lit("2026-01-01").cast("timestamp")
    return spark.createDataFrame(rows, ENTRY_SCHEMA).withColumns({"created_at": at, "updated_at": at})
