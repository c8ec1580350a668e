"""The change feed, the latest table and the postings kept current by Structured Streaming.

No watermark: late and repeated changes are safe because a lower revision never replaces a higher one. Tables are
:class:`~catalogspark.sources.runs.RunTable`: a micro-batch writes the rows of the ids that it names and reads none of
what the table has; a batch that runs again does no harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.access import visible_to
from ..operators.index import TOKEN, tokens
from ..operators.latest import newest
from ..schema import ANONYMOUS, CHANGE_COLUMNS, CHANGE_SCHEMA, ENTRY_COLUMNS, ENTRY_SCHEMA, Requester
from ..sources.runs import RunTable

#: Entries of a bucket on average, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 500_000, 65_536
POSTING_SCHEMA = "id string, rev int, kind string, scope string, key string, value string"


def read_changes(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CHANGE_SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def stream_changes_feed(changes: DataFrame, entries: DataFrame, requester: Requester = ANONYMOUS) -> DataFrame:
    """The visible feed as a streaming DataFrame: a stream-static join and a filter, without state."""
    return changes.join(entries.select("id", "rev", "attrs"), ["id", "rev"]).where(visible_to(requester)).select(*CHANGE_COLUMNS)


def bucket_of(id_: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


def write_by_bucket(table: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``table(id, ...)`` written in as many buckets of ids as its size asks for, so that a batch reads its ids' alone.
    Their number stands in the path, in a column ``buckets``."""
    buckets = min(MOST_BUCKETS, max(1, -(-table.count() // bucket_rows)))
    parted = table.withColumns({"buckets": F.lit(buckets), "bucket": bucket_of(F.col("id"), buckets)})
    parted.repartition("bucket").write.partitionBy("buckets", "bucket").parquet(path)
    schema = StructType([*table.schema.fields, StructField("buckets", IntegerType()), StructField("bucket", IntegerType())])
    return table.sparkSession.read.schema(schema).parquet(path)


class _Revisions:
    """Entries by (id, rev), of which a batch reads only the buckets that it names, where they are written by bucket."""

    def __init__(self, entries: DataFrame):
        self.entries = entries
        first = entries.select("buckets").first() if "buckets" in entries.columns else None
        self.buckets = first[0] if first else None

    def named(self, batch: DataFrame) -> DataFrame:
        """The newest revision of each id that a batch names; changes without a revision are passed over."""
        asked = batch.select("id", "rev").distinct()
        known = self.entries
        if self.buckets:
            numbers = asked.select(bucket_of(F.col("id"), self.buckets).alias("b")).distinct().collect()  # MOST_BUCKETS at most
            known = known.where(F.col("bucket").isin(*[r["b"] for r in numbers])) if numbers else known.limit(0)
        return newest(asked.join(known, ["id", "rev"]).select(*ENTRY_COLUMNS), ["rev"]).select(*ENTRY_COLUMNS)


def _started(changes: DataFrame, each, checkpoint: str, once: bool) -> StreamingQuery:
    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def latest_table(spark: SparkSession, path: str) -> RunTable:
    return RunTable(spark, path, ENTRY_SCHEMA)


def postings_table(spark: SparkSession, path: str) -> RunTable:
    """Tokens of an id's newest revision; those of older ones are passed over when the table is read."""
    return RunTable(spark, path, POSTING_SCHEMA)


def stream_latest(changes: DataFrame, entries: DataFrame, out_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the latest table, a :func:`latest_table` at ``out_path``, current."""
    table, revisions = latest_table(entries.sparkSession, out_path), _Revisions(entries)

    def each(batch: DataFrame, number: int) -> None:
        slim = batch.select("id", "rev").persist()
        table.upsert(revisions.named(slim), number)
        slim.unpersist()

    return _started(changes, each, checkpoint, once)


def stream_postings(changes: DataFrame, entries: DataFrame, latest_path: str, postings_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the latest table and its postings, a :func:`postings_table`, current."""
    spark, revisions = entries.sparkSession, _Revisions(entries)
    latest, postings = latest_table(spark, latest_path), postings_table(spark, postings_path)

    def each(batch: DataFrame, number: int) -> None:
        slim = batch.select("id", "rev").persist()
        named = revisions.named(slim).persist()
        postings.upsert(tokens(named, "rev").select("id", "rev", *TOKEN), number)
        latest.upsert(named, number)
        named.unpersist()
        slim.unpersist()

    return _started(changes, each, checkpoint, once)
