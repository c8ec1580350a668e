"""Summaries of benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

GROUP = ["dataset", "scenario", "target", "suite"]


def warmup_drop(runs: DataFrame) -> DataFrame:
    """Without the earliest run of each group that has more than one."""
    own = Window.partitionBy(*GROUP)
    numbered = runs.withColumn("_k", F.row_number().over(own.orderBy("ts", "path"))).withColumn("_n", F.count("*").over(own))
    return numbered.where("_n = 1 or _k > 1").drop("_k", "_n")


def bench_report(runs: DataFrame) -> DataFrame:
    """Per group: samples, exact medians, and the endpoint of its earliest counted run."""
    median = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    medians = [median(c) for c in ("p50_ms", "p95_ms", "p99_ms", "req_per_sec_avg")]
    return warmup_drop(runs).groupBy(*GROUP).agg(F.count("*").alias("samples"), F.min_by("endpoint", F.struct("ts", "path")).alias("endpoint"), *medians)


def speedup(report: DataFrame, a: str, b: str) -> DataFrame:
    """(dataset, suite, ratio, best): requests a second of target ``a`` over ``b``; best marks the highest of a dataset."""
    sides = report.groupBy("dataset", "suite").agg(
        F.max(F.when(F.col("target") == a, F.col("req_per_sec_avg"))).alias("x"), F.max(F.when(F.col("target") == b, F.col("req_per_sec_avg"))).alias("y")
    )
    ratios = sides.where("x is not null and y <> 0").select("dataset", "suite", (F.col("x") / F.col("y")).alias("ratio"))
    top = ratios.groupBy("dataset").agg(F.max_by("suite", F.struct("ratio", "suite")).alias("top"))
    return ratios.join(top, "dataset").select("dataset", "suite", "ratio", (F.col("suite") == F.col("top")).alias("best"))
