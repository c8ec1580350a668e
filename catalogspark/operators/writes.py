"""Write commands as batch jobs: publishes, status changes, and ordered mixes of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CHANGE_COLUMNS, ENTRY_COLUMNS, State
from ..sources.storage import written
from .latest import merge_latest
from .numbering import assign_seq

_CONTENT = ["type", "namespace", "name", "description", "version", "attrs", "manifest", "meta"]


def next_revs(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, next_rev) of each id, 1 for a new one."""
    known = entries.groupBy("id").agg(F.max("rev").alias("m"))
    return ids.select("id").distinct().join(known, "id", "left").select("id", (F.coalesce("m", F.lit(0)) + 1).cast("int").alias("next_rev"))


def assign_revs(entries: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch(ord, id, ...)`` with ``rev``: behind the stored ones, in order of ``ord`` within each id."""
    first = next_revs(entries.join(batch.select("id").distinct(), "id", "left_semi"), batch)
    place = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    return batch.withColumn("_n", place).join(first, "id").withColumn("rev", (F.col("next_rev") + F.col("_n") - 1).cast("int")).drop("_n", "next_rev")


def _stamped(rows: DataFrame, now: Column) -> DataFrame:
    return rows.withColumns({"created_at": now, "updated_at": now})


def _committed(state: State, rows: DataFrame, now: Column) -> State:
    """``state`` with new revisions (ord, change_type, entry columns). Their changes are numbered, which writes a table,
    when the log is asked for."""
    entries = rows.select(*ENTRY_COLUMNS)

    def log() -> DataFrame:
        new = assign_seq(state.changes, rows.select("ord", "id", "rev", "change_type")).withColumn("changed_at", now)
        return state.changes.unionByName(new.select(*CHANGE_COLUMNS))

    return State(state.entries.unionByName(entries), merge_latest(state.latest, entries), log, rows.select("ord", "change_type", *ENTRY_COLUMNS))


def publish_batch(state: State, batch: DataFrame, now: Column) -> State:
    """New revisions for validated rows (ord, id, content columns)."""
    rows = _stamped(assign_revs(state.entries, batch), now).withColumn("change_type", F.lit("publish"))
    return _committed(state, rows, now)


def _with_status(attrs: Column, status: Column) -> Column:
    kept = F.map_filter(attrs, lambda k, _: k != "status")
    return F.map_concat(kept, F.create_map(F.lit("status"), F.array(status)))


def _with_reason(meta: Column, reason: Column) -> Column:
    """meta as an object, with the reason where there is one; an older reason stays otherwise."""
    fields = F.coalesce(F.try_variant_get(F.try_parse_json(meta), "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    others = F.map_filter(fields, lambda k, _: k != "reason")
    return F.to_json(F.when(reason.isNull(), fields).otherwise(F.map_concat(others, F.create_map(F.lit("reason"), reason.cast("variant")))))


def set_status_batch(state: State, batch: DataFrame, now: Column) -> tuple[State, DataFrame]:
    """(state, rejected) for validated commands (ord, id, status, reason), at most one per id; unknown ids are rejected."""
    commands = batch.select("ord", "id", F.col("status").alias("_s"), F.col("reason").alias("_r"))
    joined = commands.join(state.latest, "id", "left")
    rejected = joined.where("rev is null").select("ord", "id", F.col("_s").alias("status"), F.col("_r").alias("reason"))
    rows = joined.where("rev is not null").withColumns(
        {"rev": (F.col("rev") + 1).cast("int"), "attrs": _with_status(F.col("attrs"), F.col("_s")), "meta": _with_reason(F.col("meta"), F.col("_r")), "change_type": F.lit("set_status")}
    )
    return _committed(state, _stamped(rows, now), now), rejected


def _blocks(commands: DataFrame) -> DataFrame:
    """``commands`` with ``_block``: ranges of (id, ord), so that the commands of an id with very many are many blocks. They
    are written, so that blocks stay as they are."""
    return written(commands.repartitionByRange("id", "ord").withColumn("_block", F.spark_partition_id()), "commands")


def _within(blocks: DataFrame) -> DataFrame:
    """What a block alone tells: publishes of the id up to a command, the last one's content, the last status and reason
    behind it, and how many commands, of all and of those from the first publish on."""
    own = Window.partitionBy("_block", "id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    seg = Window.partitionBy("_block", "id", "_seg").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    publish = F.col("op") == "publish"
    rows = blocks.withColumn("_seg", F.count_if(publish).over(own))
    return rows.withColumns(
        {
            "_content": F.first(F.when(publish, F.struct(*_CONTENT))).over(seg),
            "_s": F.last(F.when(~publish, F.col("status")), ignorenulls=True).over(seg),
            "_r": F.last(F.when(~publish, F.col("reason")), ignorenulls=True).over(seg),
            "_k": F.count("*").over(own),
            "_from": F.count_if(F.col("_seg") > 0).over(own),
        }
    )


def _carried(within: DataFrame, stored: DataFrame) -> DataFrame:
    """(_block, id, _before): what an id has before each of its blocks: whether it is there, its revision, content, and
    the status and reason laid over it. An id has a row for each of its blocks here, however many its commands."""
    state = F.struct("_seg", "_content", "_s", "_r", "_k", "_from")
    ends = within.groupBy("_block", "id").agg(F.max_by(state, "ord").alias("e")).select("_block", "id", "e.*").withColumn("_pub", F.col("_seg") > 0)
    by_id = Window.partitionBy("id").orderBy("_block")
    before = by_id.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_id.rowsBetween(Window.unboundedPreceding, 0)
    rows = ends.join(stored, "id", "left")
    there = F.col("_rev").isNotNull() | F.coalesce(F.bool_or("_pub").over(before), F.lit(False))
    rows = rows.withColumns({"_there": there, "_group": F.count_if("_pub").over(upto)})
    since = Window.partitionBy("id", "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_s": F.last("_s", ignorenulls=True).over(since), "_r": F.last("_r", ignorenulls=True).over(since)})
    made = F.sum(F.when(F.col("_there"), F.col("_k")).otherwise(F.col("_from"))).over(before)
    content = F.coalesce(F.last(F.when(F.col("_pub"), F.col("_content")), ignorenulls=True).over(before), F.col("_stored"))
    return rows.select(
        "_block", "id",
        F.struct(
            F.col("_there").alias("there"), (F.coalesce("_rev", F.lit(0)) + F.coalesce(made, F.lit(0))).alias("rev"), content.alias("content"),
            F.lag("_s").over(by_id).alias("s"), F.lag("_r").over(by_id).alias("r"),
        ).alias("_before"),
    )


def apply_commands(state: State, commands: DataFrame, now: Column) -> tuple[State, DataFrame]:
    """(state, rejected) for an ordered mix (ord, op, id, content, status, reason), many to an id: the result of applying
    them one at a time.

    A publish replaces the content, a status command lays a status and perhaps a reason over it; so what some commands do
    is told by their last publish, the last status and reason behind it, and how many there are. That adds up: commands
    are ranged into blocks by (id, ord), each block is worked out alone, and what the blocks of an id do is carried to the
    next. An id with very many commands is many blocks."""
    within = _within(_blocks(commands))
    stored = state.latest.join(commands.select("id").distinct(), "id", "left_semi").select("id", F.col("rev").alias("_rev"), F.struct(*_CONTENT).alias("_stored"))
    rows = within.join(_carried(within, stored), ["_block", "id"])
    rows = rows.withColumn("_ok", (F.col("_seg") > 0) | F.col("_before.there"))
    rejected = rows.where(~F.col("_ok")).select(*commands.columns)
    own = F.col("_seg") > 0
    good = rows.where("_ok").withColumns(
        {
            "_base": F.when(own, F.col("_content")).otherwise(F.col("_before.content")),
            "_s": F.when(own, F.col("_s")).otherwise(F.coalesce("_s", "_before.s")),
            "_r": F.when(own, F.col("_r")).otherwise(F.coalesce("_r", "_before.r")),
            "rev": (F.col("_before.rev") + F.when(F.col("_before.there"), F.col("_k")).otherwise(F.col("_from"))).cast("int"),
        }
    )
    laid = good.select(
        "ord", "id", "rev", F.col("op").alias("change_type"), *[F.col(f"_base.{c}").alias(c) for c in _CONTENT if c not in ("attrs", "meta")],
        F.when(F.col("_s").isNull(), F.col("_base.attrs")).otherwise(_with_status(F.col("_base.attrs"), F.col("_s"))).alias("attrs"),
        F.when(F.col("op") == "publish", F.col("_base.meta")).otherwise(_with_reason(F.col("_base.meta"), F.col("_r"))).alias("meta"),
    )
    return _committed(state, _stamped(laid, now), now), rejected
