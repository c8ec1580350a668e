"""Reading, appending and purging catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.normalize import normalize_entries
from ..schema import ENTRY_COLUMNS

_RAW = "id string, rev int, type string, namespace string, name string, description string, version string, attrs string, manifest string, meta string, created_at timestamp, updated_at timestamp"


def read_entries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line; blank lines are skipped, a line that isn't an entry stops the job when it is read."""
    return normalize_entries(spark.read.schema(_RAW).option("mode", "FAILFAST").json(path))


def append_revisions(existing: DataFrame, incoming: DataFrame, order_cols: list) -> DataFrame:
    """Stored revisions stay; of incoming rows with one (id, rev) the first by ``order_cols`` is added, if none is stored."""
    first = Window.partitionBy("id", "rev").orderBy(*order_cols)
    new = incoming.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return existing.unionByName(new.join(existing.select("id", "rev"), ["id", "rev"], "left_anti").select(*existing.columns))


def purge(entries: DataFrame, latest: DataFrame, changes: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without one namespace; its changes are known by their ids."""
    other = F.coalesce(F.col("namespace") != namespace, F.lit(True))
    owned = F.substring_index("id", ":", 2).isin(*[f"{t}:{namespace}" for t in ("mcp", "rag", "skill")]) & (F.size(F.split("id", ":")) > 2)
    return entries.where(other), latest.where(other), changes.where(~owned)


def load_snapshot(latest: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The latest table, and the last sequence number (0 without changes) as one row."""
    return latest.select(*ENTRY_COLUMNS), changes.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("last_seq"))


def read_bench_runs(spark: SparkSession, root: str, files: str = "run-*.json", lines: bool = False) -> DataFrame:
    """A row for each summary in the files below ``root`` whose names fit ``files``; ``ts`` is the instant of the run.

    A file is one run, or an array of runs. With ``lines`` each line is a run: large files are split among tasks, and a
    line that is none is dropped alone. Many runs are best kept so, as every file has to be listed and opened."""
    schema = (
        "generated_at string, dataset string, scenario string, summaries array<struct<target:string,endpoint:string,suite:string,"
        "p50_ms:double,p95_ms:double,p99_ms:double,avg_ms:double,req_per_sec_avg:double,bytes_per_sec_avg:double>>"
    )
    runs = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", files).option("multiLine", not lines).json(root)
    runs = runs.withColumn("path", F.input_file_name()).where("generated_at is not null and summaries is not null")
    flat = runs.select(
        F.coalesce("dataset", F.lit("unknown")).alias("dataset"), F.coalesce("scenario", F.lit("default")).alias("scenario"), F.try_to_timestamp("generated_at").alias("ts"), "path", F.explode("summaries").alias("s")
    )
    return flat.select("dataset", "scenario", "ts", "path", "s.*")
