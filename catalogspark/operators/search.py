"""Filtered, visible, ordered pages of the latest table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.access import visible_to
from ..functions.filters import after_cursor, filter_expr, text_match
from ..functions.normalize import VIEWS
from ..schema import ANONYMOUS, Requester
from .numbering import update_rank


def matches(filter: str | None = None, q: str | None = None, requester: Requester = ANONYMOUS) -> Column:
    return (F.lit(True) if filter is None else filter_expr(filter)) & text_match(q) & visible_to(requester)


def search(
    latest: DataFrame,
    filter: str | None = None,
    q: str | None = None,
    requester: Requester = ANONYMOUS,
    limit: int = 20,
    cursor: tuple | None = None,
    sort: str = "updated_at_desc",
    view: str | None = "card",
) -> DataFrame:
    """A page. Everything is filtered before the limit, so a page is short only if matches run out; ordered pages are a
    top-k in which each task sends ``limit`` rows. ``cursor``: (updated_at, id) of the last row before the page.
    ``view`` None keeps all columns."""
    if sort not in ("updated_at_desc", "none"):
        raise ValueError(f"unknown sort {sort!r}")
    if cursor is not None and sort == "none":
        raise ValueError("a cursor needs a sorted search")
    found = latest.where(matches(filter, q, requester))
    if cursor is not None:
        found = found.where(after_cursor(*cursor))
    page = found.limit(limit) if sort == "none" else found.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)
    return VIEWS[view or "full"](page)


def next_cursor(page: DataFrame, limit: int) -> DataFrame:
    """One row (updated_at, id): the last of a full page, else nulls."""
    last = page.agg(F.count("*").alias("n"), F.min(F.struct("updated_at", "id")).alias("k"))
    full = F.col("n") >= limit
    return last.select(F.when(full, F.col("k.updated_at")).alias("updated_at"), F.when(full, F.col("k.id")).alias("id"))


def paginate(found: DataFrame, page_size: int) -> DataFrame:
    """Every match with its rank, page (from 0) and place in the page."""
    ranked = update_rank(found)
    return ranked.withColumn("page", F.floor(F.col("rank") / page_size).cast("long")).withColumn("place", F.col("rank") % page_size)


def search_ids_with_count(latest: DataFrame, filter: str, limit: int) -> DataFrame:
    """The first ids in order of id, each with the number of all matches."""
    found = latest.where(filter_expr(filter))
    count = found.agg(F.count("*").alias("count"))
    return found.select("id").orderBy("id").limit(limit).crossJoin(F.broadcast(count))


def search_many(latest: DataFrame, filters: Mapping[str, str], requester: Requester = ANONYMOUS) -> DataFrame:
    """(filter_name, id) for many filters in one scan."""
    hits = F.filter(F.array(*[F.when(filter_expr(text), F.lit(name)) for name, text in filters.items()]), lambda x: x.isNotNull())
    return latest.where(visible_to(requester)).select(F.explode(hits).alias("filter_name"), "id")


def filter_hits(latest: DataFrame, filters: Mapping[str, str], requester: Requester = ANONYMOUS) -> DataFrame:
    """(filter_name, hits), with filters that nothing matches."""
    names = list(filters)
    counts = latest.where(visible_to(requester)).agg(*[F.count_if(filter_expr(filters[n])).alias(f"c{k}") for k, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("filter_name"), F.col(f"c{k}").alias("hits")) for k, n in enumerate(names)])
    return counts.select(F.inline(rows))
