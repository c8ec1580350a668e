"""The change feed: an ordered log joined to the revisions that it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.access import visible_to
from ..functions.filters import after_seq
from ..schema import ANONYMOUS, CHANGE_COLUMNS, Requester

#: Numbers of the log that a page looks at first, at least.
FIRST_RANGE = 1000
_LAST = (1 << 63) - 1


def changes_with_entries(changes: DataFrame, entries: DataFrame, how: str = "inner") -> DataFrame:
    """Changes with their revisions; ``left`` keeps changes whose revision is missing."""
    return changes.join(entries, ["id", "rev"], how)


def _slim(changes: DataFrame, entries: DataFrame, requester: Requester) -> DataFrame:
    return changes_with_entries(changes, entries.select("id", "rev", "attrs")).where(visible_to(requester)).select(*CHANGE_COLUMNS)


def _page_end(changes: DataFrame, entries: DataFrame, since: int, limit: int, requester: Requester) -> int | None:
    """A sequence number up to which there are ``limit`` visible events behind ``since``; None if there aren't so many.
    Ranges of the log are counted, each twice as wide as the one before; a range reads no file without its numbers."""
    low, width, found = since, max(FIRST_RANGE, 2 * limit), 0
    while True:
        high = min(low + width, _LAST)
        between = changes.where(after_seq(low) & (F.col("seq") <= high))
        found += _slim(between, entries, requester).limit(limit - found).count() if limit > found else 0
        if found >= limit:
            return high
        if high == _LAST or changes.where(after_seq(high)).isEmpty():
            return None
        low, width = high, 2 * width


def changes_feed(changes: DataFrame, entries: DataFrame, since: int = 0, limit: int = 100, requester: Requester = ANONYMOUS) -> DataFrame:
    """The first ``limit`` visible events behind ``since``; what counts is the visibility of the changed revision. The log
    is read as far as the page reaches, which is found out when the page is asked for; only a last page reads to the end."""
    high = _page_end(changes, entries, since, limit, requester)
    part = changes.where(after_seq(since) if high is None else after_seq(since) & (F.col("seq") <= high))
    return _slim(part, entries, requester).orderBy("seq").limit(limit)


def next_since(changes: DataFrame, entries: DataFrame, since: int = 0, limit: int = 100, requester: Requester = ANONYMOUS) -> DataFrame:
    """Where the next page starts: behind a full page, else behind the last change that has a revision, seen or not."""
    page = changes_feed(changes, entries, since, limit, requester).agg(F.count("*").alias("n"), F.max("seq").alias("page_last"))
    n, last = page.first()
    if n >= limit:
        return page.select(F.lit(last).cast("long").alias("next_since"))
    joined = changes_with_entries(changes.where(after_seq(since)), entries.select("id", "rev")).agg(F.max("seq").alias("last"))
    return joined.select(F.coalesce("last", F.lit(since)).cast("long").alias("next_since"))


def cache_refresh(cache: DataFrame, feed_page: DataFrame, latest: DataFrame) -> DataFrame:
    """(id, cached_rev, rev, state) of the ids on a page against a cache(id, rev): new, stale or unchanged."""
    now = feed_page.select("id").distinct().join(latest.select("id", "rev"), "id")
    joined = now.join(cache.select("id", F.col("rev").alias("cached_rev")), "id", "left")
    state = F.when(F.col("cached_rev").isNull(), "new").when(F.col("cached_rev") < F.col("rev"), "stale").otherwise("unchanged")
    return joined.select("id", "cached_rev", "rev", state.alias("state"))
