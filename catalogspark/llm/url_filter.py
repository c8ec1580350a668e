"""Allow and block lists of URLs: a trie over reversed host labels, then path segments; the longest entry wins. Lists too
long to be sent to every task are joined instead, with the same result."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .tables import stored

#: Entries that a broadcast trie may hold; longer lists are joined.
TRIE_RULES = 1_000_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class RuleTrie:
    """Nested dicts. Host labels lead from the right; below ``PATHS`` whole path segments, and at each node the
    unfinished last segments of entries whose path doesn't end in a slash."""

    PATHS, RULE, PARTIAL = 0, 1, 2  # no label or segment is an int

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.lower().split(".")) if rule.host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATHS, {})
            *whole, rest = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            slot, key = (node, self.RULE) if not rest else (node.setdefault(self.PARTIAL, {}), rest)
            if key not in slot or rule.verdict == "block":  # the same entry twice: block wins
                slot[key] = (rule.name, rule.verdict)

    def _in_path(self, node: dict, path: str) -> tuple[str, str] | None:
        best, segments = node.get(self.RULE), path.split("/")
        for at, segment in enumerate(segments):
            for stub in sorted(node.get(self.PARTIAL, ()), key=len):
                if segment.startswith(stub):
                    best = node[self.PARTIAL][stub]
            if at == len(segments) - 1 or segment not in node:
                break
            node = node[segment]
            best = node.get(self.RULE, best)
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(entry, verdict) of the longest entry that fits: the one with more host labels, then the longer path."""
        best, node = None, self.root
        labels = reversed(host.split(".")) if host else iter(())
        while True:
            if self.PATHS in node:
                best = self._in_path(node[self.PATHS], path) or best
            label = next(labels, None)
            if label is None or label not in node:
                return best
            node = node[label]


def url_parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path). Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
    what follows up to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    cut = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", F.coalesce(after, F.lit("")).alias("after"))
    cut = cut.withColumn("raw", F.regexp_extract("after", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(after, length(raw) + 1)"), "^[^?#]*", 0)
    return cut.select("page_id", F.translate("raw", upper, lower).alias("host"), path.alias("path"))


def _joined_rules(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """``parts(page_id, host, path)`` with ``found`` (rule, verdict) or null, for lists of any length: each distinct host and
    path meets the entries of its host's suffixes and its path's beginnings by equality. Beginnings are tried only in
    lengths that entries have."""
    block_wins = F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.when(F.col("verdict") == "block", 1).otherwise(0))
    own = rules.select(F.lower("host").alias("key"), "host", "path", "verdict").groupBy("key", F.col("path").alias("begin")).agg(block_wins.alias("found"))
    own = stored(own, "rules")
    # one number for each length of a path in the list
    lengths = F.broadcast(own.agg(F.array_sort(F.collect_set(F.length("begin"))).alias("lengths")))
    urls = stored(parts.select("host", "path").distinct(), "urls")
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    )
    tried = urls.crossJoin(lengths).select("host", "path", F.explode(suffixes).alias("key"), "lengths")
    begins = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    met = tried.select("host", "path", "key", F.explode(begins).alias("begin")).join(own, ["key", "begin"])
    depth = F.when(F.col("key") == "", 0).otherwise(F.size(F.split("key", r"\.")))
    best = met.groupBy("host", "path").agg(F.max_by("found", F.struct(depth, F.length("begin"))).alias("found"))
    return parts.join(stored(best, "judged"), ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages(page_id, url, ...)``.

    An entry fits its host and all subdomains if the path starts with the entry's path; the one with most host labels
    wins, then the longest path, then block. A url without an entry gets ``default`` and a null rule. Null and malformed
    urls have empty host and path and so get the default; repeated rows come back as often as they came; further columns
    are ignored. ``rules``: Rules, or a table (host, path, verdict) of any length; TRIE_RULES or fewer are broadcast."""
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        few = rules.select("host", "path", "verdict").limit(TRIE_RULES + 1).collect()  # bounded
        listed = [Rule(*r) for r in few] if len(few) <= TRIE_RULES else None
    else:
        listed = [Rule(*r) for r in rules]
        if len(listed) > TRIE_RULES:
            rules, listed = spark.createDataFrame(listed, "host string, path string, verdict string"), None
    if listed is None:
        found = _joined_rules(url_parts(pages), rules)
    else:
        trie = spark.sparkContext.broadcast(RuleTrie(listed))

        @F.pandas_udf("struct<rule:string,verdict:string>")
        def look_up(host: pd.Series, path: pd.Series) -> pd.DataFrame:
            found = [trie.value.match(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
            return pd.DataFrame(found, columns=["rule", "verdict"])

        found = url_parts(pages).withColumn("found", look_up("host", "path"))
    return found.select("page_id", "host", "path", "found.rule", F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
