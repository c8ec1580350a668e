"""Reads by id, one at a time or in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.access import visible_to
from ..functions.normalize import VIEWS
from ..schema import ANONYMOUS, Requester


def get_latest(latest: DataFrame, id: str, requester: Requester = ANONYMOUS, view: str = "full") -> DataFrame:
    return VIEWS[view](latest.where((F.col("id") == id) & visible_to(requester)))


def get_revision(entries: DataFrame, id: str, rev: int, requester: Requester = ANONYMOUS) -> DataFrame:
    """A revision, by its own visibility."""
    return entries.where((F.col("id") == id) & (F.col("rev") == rev) & visible_to(requester))


def list_versions(entries: DataFrame, ids: DataFrame | None = None, requester: Requester = ANONYMOUS) -> DataFrame:
    """(id, rev, version, updated_at) of ids whose latest revision is visible."""
    history = entries if ids is None else entries.join(ids.select("id").distinct(), "id", "left_semi")
    newest = history.groupBy("id").agg(F.max_by("attrs", "rev").alias("attrs"))
    shown = newest.where(visible_to(requester)).select("id")
    return history.select("id", "rev", "version", "updated_at").join(shown, "id", "left_semi")


def _asked(latest: DataFrame, requests: DataFrame, requester: Requester) -> DataFrame:
    """Entries that are asked for, each once, with whether they may be seen."""
    return latest.join(requests.select("id").distinct(), "id", "left_semi").withColumn("_seen", visible_to(requester))


def batch_get(latest: DataFrame, requests: DataFrame, requester: Requester = ANONYMOUS) -> DataFrame:
    """A row for each request (ord, id) whose entry exists and is visible, in order of ``ord``; repeated requests repeat
    it. Of the catalog only the entries asked for are shuffled; a request that very many make is one row on that side."""
    found = _asked(latest, requests, requester).where("_seen").drop("_seen")
    return requests.select("ord", "id").join(found, "id").orderBy("ord")


def batch_get_omitted(latest: DataFrame, requests: DataFrame, requester: Requester = ANONYMOUS) -> DataFrame:
    """How many requests were for hidden entries."""
    hidden = _asked(latest, requests, requester).where(~F.col("_seen")).select("id")
    asked = requests.groupBy("id").agg(F.count("*").alias("n"))  # added up before the join
    return asked.join(hidden, "id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("omitted"))
