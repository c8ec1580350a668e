"""Stored tables that grow by small batches: runs of rows, merged when they are read and folded together in time.

A batch writes its own rows and nothing else, as a run of level 0. FANOUT runs of a level are folded into one of the next,
which keeps of each id only its newest rows; so a row is rewritten once for each level, however large the table is. What
is there is said by a list of runs for each batch: a batch that runs again starts from the list before it and writes the
same again. Runs that neither the newest list nor the one before it names are deleted."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.latest import newest
from .storage import delete

#: Runs of a level that are folded into one, and rows of a file.
FANOUT, FILE_ROWS = 8, 1_000_000
_LIST = "batch long, run string, level int, rows long"


class Run(NamedTuple):
    run: str
    level: int
    rows: int


def place_of(id_: Column) -> Column:
    """Where an id stands in the files of a run."""
    return F.xxhash64(id_)


class RunTable:
    """A table of rows by id below ``path``. ``rank`` (columns of ``schema``) tells newer rows of an id from older ones, of
    equal rank those of the later batch are newer; an id has all the rows of its newest rank."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, rank: tuple[str, ...] = ("rev",), fanout: int = FANOUT):
        self.spark, self.path, self.fanout, self.rank = spark, path.rstrip("/"), fanout, [*rank, "_batch"]
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self._full = StructType([*self.schema.fields, StructField("_batch", LongType()), StructField("_place", LongType())])

    def _lists(self) -> dict[int, list[Run]]:
        """The lists that are kept (three at most) by batch; a list has FANOUT runs for each level at most."""
        try:
            rows = self.spark.read.schema(_LIST).parquet(f"{self.path}/lists").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return {}
            raise
        lists: dict[int, list[Run]] = {}
        for r in rows:
            lists.setdefault(r["batch"], []).append(Run(r["run"], r["level"], r["rows"]))
        return lists

    def runs(self, batch: int | None = None) -> list[Run]:
        """The runs of the newest list, or of the newest before a batch."""
        lists = {b: runs for b, runs in self._lists().items() if batch is None or b < batch}
        return lists[max(lists)] if lists else []

    def _read(self, runs: list[Run]) -> DataFrame:
        paths = [f"{self.path}/runs/{r.run}" for r in runs]
        return self.spark.read.schema(self._full).parquet(*paths) if paths else self.spark.createDataFrame([], self._full)

    def rows(self, batch: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        """The table, or as it was before a batch; all of it or the rows of ``ids(id)``, which are met before anything is
        shuffled where they are few."""
        own = self._read(self.runs(batch))
        own = own if ids is None else own.join(ids.distinct(), "id", "left_semi")
        return newest(own, self.rank).select(*self.schema.fieldNames())

    def row(self, id_: str) -> DataFrame:
        """The rows of an id: files and row groups without its place are passed over."""
        own = self._read(self.runs()).where((F.col("id") == id_) & (F.col("_place") == place_of(F.lit(id_))))
        return newest(own, self.rank).select(*self.schema.fieldNames())

    def _put(self, rows: DataFrame, name: str, level: int, known: int | None = None) -> Run:
        """A run of ``rows``, sorted by place in files of FILE_ROWS; ``known`` says about how many rows there are."""
        counted = Observation()
        files = max(1, -(-known // FILE_ROWS)) if known is not None else None
        placed = rows.repartitionByRange(files, "_place").sortWithinPartitions("_place") if files else rows
        placed.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/runs/{name}")
        return Run(name, level, int(counted.get["n"]))

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Rows that are newer than what their ids have from this batch on. Batches come in order; one may come again."""
        lists = {b: runs for b, runs in self._lists().items() if b < batch}
        before = lists[max(lists)] if lists else []
        new = rows.select(*self.schema.fieldNames()).withColumns({"_batch": F.lit(batch).cast("long"), "_place": place_of(F.col("id"))})
        runs = self._folded([*before, self._put(new, f"{batch}-0", 0)], batch)
        made = self.spark.createDataFrame([(r.run, r.level, r.rows) for r in runs], "run string, level int, rows long")
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/batch={batch}")
        self._expire(lists, runs, before)

    def _folded(self, runs: list[Run], batch: int) -> list[Run]:
        level = 0
        while len(full := [r for r in runs if r.level == level]) >= self.fanout:
            rows = newest(self._read(full), self.rank)
            one = self._put(rows, f"{batch}-{level + 1}", level + 1, sum(r.rows for r in full))
            runs, level = [*[r for r in runs if r not in full], one], level + 1
        return runs

    def _expire(self, older: dict[int, list[Run]], runs: list[Run], before: list[Run]) -> None:
        needed = {r.run for r in [*runs, *before]}
        for number in sorted(older)[:-1]:
            for r in older[number]:
                if r.run not in needed:
                    delete(self.spark, f"{self.path}/runs/{r.run}")
            delete(self.spark, f"{self.path}/lists/batch={number}")
