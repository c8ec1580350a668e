"""The tables of a catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ATTRS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

#: Immutable revisions, key (id, rev). manifest and meta are JSON text.
ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("rev", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("attrs", ATTRS),
        T.StructField("manifest", T.StringType()),
        T.StructField("meta", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
ENTRY_COLUMNS = ENTRY_SCHEMA.fieldNames()

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("rev", T.IntegerType()),
        T.StructField("changed_at", T.TimestampType()),
        T.StructField("change_type", T.StringType()),
    ]
)
CHANGE_COLUMNS = CHANGE_SCHEMA.fieldNames()

#: Columns that filters and tokens know; any other filter key is an attribute.
TOP_COLUMNS = ("id", "type", "name", "namespace", "version", "rev")


@dataclass(frozen=True)
class Requester:
    """Who asks. Groups count only for an authenticated requester."""

    authenticated: bool = False
    groups: tuple[str, ...] = ()


ANONYMOUS = Requester()


class State:
    """A catalog: the revision history, the newest revision of each id, and the change log. ``changes`` may be a function
    that makes the log when it is asked for. ``added`` are the revisions of the last batch: ord, change_type and the entry
    columns."""

    def __init__(self, entries: DataFrame, latest: DataFrame, changes: DataFrame | Callable[[], DataFrame], added: DataFrame | None = None):
        self.entries, self.latest, self._changes, self.added = entries, latest, changes, added

    @cached_property
    def changes(self) -> DataFrame:
        return self._changes() if callable(self._changes) else self._changes
