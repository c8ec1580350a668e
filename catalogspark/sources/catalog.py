"""A catalog in stored tables: commands add to it batch by batch, and statistics of its index are kept current.

A batch writes its own revisions and changes, and of the latest table the rows of its ids (see
:class:`~catalogspark.sources.runs.RunTable`); of what is there only these ids are looked up. Batches are numbered by who
calls; one that runs again writes the same again, as long as no later one has been written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.index import TOKEN, counts_delta
from ..operators.latest import newest
from ..operators.numbering import assign_seq
from ..operators.writes import apply_commands, publish_batch, set_status_batch
from ..schema import CHANGE_COLUMNS, CHANGE_SCHEMA, ENTRY_COLUMNS, ENTRY_SCHEMA, State
from .runs import RunTable

_REVISIONS = ["ord", "change_type", *ENTRY_COLUMNS]
_TOTALS = "batch long, docs long, eq_tokens long, presence_tokens long, cardinality long, last_seq long"


class StoredCatalog:
    """Revisions, changes, the latest table, and counts of tokens below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.latest = RunTable(spark, f"{self.path}/latest", ENTRY_SCHEMA)
        self.counts = RunTable(spark, f"{self.path}/counts", "id string, kind string, scope string, key string, value string, n long", rank=())

    def _totals(self, batch: int | None = None) -> tuple[int, ...]:
        """What is known after the newest batch, or the newest before one: a row for each batch."""
        try:
            rows = self.spark.read.schema(_TOTALS).parquet(f"{self.path}/totals")
            rows = rows.select("batch", "docs", "eq_tokens", "presence_tokens", "cardinality", "last_seq")
            row = (rows if batch is None else rows.where(F.col("batch") < batch)).orderBy(F.desc("batch")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        return (-1, 0, 0, 0, 0, 0) if row is None else tuple(row)

    def _batches(self, name: str, schema) -> DataFrame:
        last = self._totals()[0]
        if last < 0:
            return self.spark.createDataFrame([], schema)
        parts = self.spark.read.parquet(f"{self.path}/{name}").where(F.col("batch") <= last)
        return parts.select(*schema.fieldNames())

    def entries(self) -> DataFrame:
        return self._batches("revisions", ENTRY_SCHEMA)

    def changes(self) -> DataFrame:
        return self._batches("changes", CHANGE_SCHEMA)

    def stats(self) -> DataFrame:
        """What :func:`~catalogspark.operators.index.index_stats` gives, from the totals: nothing is scanned."""
        _, docs, eq, presence, cardinality, _ = self._totals()
        return self.spark.createDataFrame([(docs, eq, presence, cardinality, 4 * (cardinality + docs))], "docs long, eq_tokens long, presence_tokens long, cardinality long, memory_approx long")

    def token_counts(self) -> DataFrame:
        """Entries of each token, as of :func:`~catalogspark.operators.index.token_counts`."""
        return self.counts.rows().where("n > 0").select(*TOKEN, "n")

    def load(self, entries: DataFrame, batch: int = 0) -> None:
        """Revisions as they are, each with a change of its own in order of id and revision."""
        order = F.struct("id", "rev").alias("ord")
        self._commit(entries.select(order, F.lit("publish").alias("change_type"), *ENTRY_COLUMNS), F.col("updated_at"), batch)

    def publish(self, rows: DataFrame, now: Column, batch: int) -> None:
        self._run(lambda state: (publish_batch(state, rows, now), None), rows, now, batch)

    def set_status(self, rows: DataFrame, now: Column, batch: int) -> DataFrame:
        """The rejected commands, to be read before the next batch."""
        return self._run(lambda state: set_status_batch(state, rows, now), rows, now, batch)

    def apply(self, commands: DataFrame, now: Column, batch: int) -> DataFrame:
        """The rejected commands, to be read before the next batch."""
        return self._run(lambda state: apply_commands(state, commands, now), commands, now, batch)

    def _run(self, command: Callable[[State], tuple[State, DataFrame | None]], rows: DataFrame, now: Column, batch: int) -> DataFrame | None:
        # all that a command asks of an id is told by its newest revision
        known = self.latest.rows(batch, rows.select("id"))
        done, rejected = command(State(known, known, self.spark.createDataFrame([], CHANGE_SCHEMA)))
        self._commit(done.added, now, batch)
        return rejected

    def _commit(self, added: DataFrame, now: Column, batch: int) -> None:
        _, docs, eq, presence, cardinality, last_seq = self._totals(batch)
        at = f"{self.path}/revisions/batch={batch}"
        added.select(*_REVISIONS).write.mode("overwrite").parquet(at)
        rows = self.spark.read.parquet(at)
        known = self.spark.createDataFrame([(last_seq,)], "seq long")
        log = assign_seq(known, rows.select("ord", "id", "rev", "change_type", now.alias("changed_at")))
        log.select(*CHANGE_COLUMNS).write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")

        old = self.latest.rows(batch, rows.select("id")).persist()
        ranked = old.select(*ENTRY_COLUMNS).withColumn("_new", F.lit(0)).unionByName(rows.select(*ENTRY_COLUMNS).withColumn("_new", F.lit(1)))
        new = newest(ranked, ["rev", "_new"]).where("_new = 1").select(*ENTRY_COLUMNS).persist()
        moved = counts_delta(old, new)
        moved = moved.withColumn("id", F.to_json(F.array(*TOKEN), {"ignoreNullFields": "false"})).persist()
        before = self.counts.rows(batch, moved.select("id")).select("id", F.col("n").alias("_n"))
        counted = moved.join(before, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("n", F.col("_n") + F.col("d")).persist()
        turn = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, (F.col("n") > 0).cast("long") - (F.col("_n") > 0).cast("long"))), F.lit(0))
        made = counted.agg(turn("eq"), turn("present"), F.coalesce(F.sum("d"), F.lit(0))).first()
        fresh = new.select("id").join(old.select("id"), "id", "left_anti").count()
        totals = (batch, docs + fresh, eq + made[0], presence + made[1], cardinality + made[2], last_seq + rows.count())

        self.counts.upsert(counted, batch)
        self.latest.upsert(new, batch)
        self.spark.createDataFrame([totals[1:]], _TOTALS.removeprefix("batch long, ")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        for df in (counted, moved, new, old):
            df.unpersist()
