"""Visibility: public to all, internal to the authenticated, restricted to those who share a group with the entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import Requester


def visibility_of(attrs: Column | None = None) -> Column:
    """First value of the attribute; anything unknown or missing is public."""
    first = F.get((F.col("attrs") if attrs is None else attrs)["visibility"], F.lit(0))
    return F.when(first.isin("internal", "restricted"), first).otherwise("public")


def groups_of(attrs: Column | None = None) -> Column:
    return F.coalesce((F.col("attrs") if attrs is None else attrs)["allowed_group"], F.array().cast("array<string>"))


def visible_to(requester: Requester, attrs: Column | None = None) -> Column:
    seen = visibility_of(attrs)
    if not requester.authenticated:
        return seen == "public"
    shared = F.arrays_overlap(groups_of(attrs), F.array(*map(F.lit, requester.groups))) if requester.groups else F.lit(False)
    return (seen != "restricted") | F.coalesce(shared, F.lit(False))


def parse_requesters(raw: DataFrame, trusted: bool) -> DataFrame:
    """``raw(authorization, sub, groups, ...)`` with ``subject``, ``authenticated`` and ``group_list``: from headers that
    a trusted proxy set, else anonymous."""
    given = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    authenticated = (given("authorization") | given("sub")) & F.lit(trusted)
    names = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("groups", F.lit("")), ","), lambda g: F.trim(g)), lambda g: g != ""))
    return raw.withColumns(
        {
            "authenticated": authenticated,
            "subject": F.when(authenticated & given("sub"), F.trim("sub")),
            "group_list": F.when(authenticated, names).otherwise(F.array().cast("array<string>")),
        }
    )
