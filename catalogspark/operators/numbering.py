"""Global row numbers without a window over the whole table: the columns of the order, and no others, are
range-partitioned, sorted and written, and each partition adds the sizes of those before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.storage import written

_ROW_BITS = 33


def _parts(order: list[str]) -> tuple[list[str], list]:
    """(columns, sort) of an order in which ``-`` before a name turns it round."""
    names = [c.removeprefix("-") for c in order]
    return names, [F.desc(n) if c.startswith("-") else F.asc(n) for c, n in zip(order, names, strict=True)]


def ranks(rows: DataFrame, order: list[str], name: str = "rank", carried: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the order, and narrow ones that are carried with them, with each row's 0-based place; equal rows have
    places of their own."""
    names, sort = _parts(order)
    names = [*names, *carried]
    placed = rows.select(*names).repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_m", F.monotonically_increasing_id())
    kept = written(placed, "numbered").withColumn("_p", F.shiftrightunsigned("_m", _ROW_BITS))
    # a row for each partition, however long the table
    sizes = kept.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    local = F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    out = kept.join(F.broadcast(before.select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))), "_p")
    return out.select(*names, (F.col("_before") + local).cast("long").alias(name))


def number_rows(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their 0-based place in ``order``, which should be total: rows that are equal in it follow each other
    in any way, and all of them meet in one task."""
    names, _ = _parts(order)
    if set(rows.columns) == set(names):
        return ranks(rows, order, name).select(*rows.columns, name)
    key = F.struct(*names).alias("_k")  # nulls in it are equal
    first = ranks(rows, order, "_first").groupBy(key).agg(F.min("_first").alias("_first"))
    met = rows.withColumn("_k", key).join(first, "_k")
    again = F.row_number().over(Window.partitionBy("_k").orderBy("_k")) - 1
    return met.withColumn(name, (F.col("_first") + again).cast("long")).select(*rows.columns, name)


def update_rank(latest: DataFrame) -> DataFrame:
    """Place of each entry, the newest first."""
    return number_rows(latest, ["-updated_at", "-id"])


def assign_seq(changes: DataFrame, batch: DataFrame) -> DataFrame:
    """Sequence numbers behind the last one, in order of ``ord``. Changes are narrow, so their columns go with the order
    instead of meeting it again."""
    last = changes.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))
    numbered = ranks(batch, ["ord"], "_k", tuple(c for c in batch.columns if c != "ord")).select(*batch.columns, "_k")
    return numbered.crossJoin(F.broadcast(last)).withColumn("seq", F.col("_last") + F.col("_k") + 1).drop("_k", "_last")
