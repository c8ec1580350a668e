"""Mixing documents to target weights over soft domain memberships.

A classifier fitted on a labelled table gives each document a posterior over domains; nonnegative rates of documents are
then fitted by projected-gradient least squares, so that the expected tokens of each domain meet its target. Only
built-in functions: the classifier is two tables of counts, of words and of bins, each gradient step one aggregate of as
many numbers as there are domains, and a document's rate follows from the few steps taken so far, so no table is
rewritten between steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .tables import scratch, stored

#: Classes of the labelled table.
DOMAINS = ("clean_high", "clean_low", "toxic")
#: Wanted shares of tokens.
TARGETS: Mapping[str, float] = {"clean_high": 0.75, "clean_low": 0.15, "toxic": 0.10}
#: The fit ends when all domains are off by less than this share of the total, or when no step gains more than this.
TOLERANCE = 1e-6
#: No document comes more often than this.
MOST = 4.0
#: Steps into which a posterior is cut for its calibration, and labelled documents that a cell is held to be worth before.
GRID, PRIOR_DOCS = 10, 2.0
_SMOOTH = 1.0
#: A word speaks for a domain if it is in so many labelled documents at least, and in so many standard deviations more of
#: the domain's than its share in all of them lets expect.
MIN_DOCS, MIN_DEVIATION = 3, 8.0
#: What is cut from both ends of a word.
_MARKS = ".,;:!?\"'()[]{}"


def label_domain() -> Column:
    """The domain that a row of ``labels(doc_id, quality, toxic)`` stands for."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean_high").when(F.col("quality") == 0, "clean_low")


def _features(docs: DataFrame, kept: Sequence[str] | None = None) -> DataFrame:
    """(_id, _row, doc_id, tokens, words, f): a number for each row, its columns (or those ``kept``), its tokens, hashes of its distinct
    words (32 bits), and an array of discrete features, one bin of each kind.

    Tokens are runs between blanks; words are such runs in lower case without punctuation at their ends. A null text
    counts as empty; nulls of lang and source are bins of their own."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?" if c != "text" else ""))
    out = docs.select(F.struct(*(docs.columns if kept is None else kept)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), named("text").alias("t"), named("lang").alias("lang"), named("source").alias("source"))
    spaced = F.lower("t")
    for c in "\n\t\r\f\v":  # then one character splits, which needs no pattern
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    out = out.withColumn("runs", F.filter(F.split(spaced, " "), lambda w: w != ""))
    out = out.withColumn("tokens", F.size("runs").cast("long"))
    words = F.array_distinct(F.transform("runs", lambda w: F.hash(F.btrim(w, F.lit(_MARKS)))))
    marks = lambda c: F.length("t") - F.length(F.replace("t", F.lit(c), F.lit("")))
    per = lambda n: F.floor(F.least(F.lit(9), 10 * n / F.greatest(F.col("tokens"), F.lit(1)))).cast("int")
    symbols = sum((marks(c) for c in "*$%|"), marks("#"))
    kinds = {
        "lang": F.col("lang"), "source": F.col("source"), "size": F.floor(F.log2(F.col("tokens") + 1)).cast("int"),
        "word": F.floor(F.least(F.lit(30), F.length("t") / F.greatest(F.col("tokens"), F.lit(1)))).cast("int"),
        "symbols": per(symbols), "stops": per(marks(".")), "lines": per(marks("\n")),
    }
    bins = F.array(*[F.concat(F.lit(k + "="), v.cast("string")) for k, v in kinds.items()])
    return out.select(F.monotonically_increasing_id().alias("_id"), "_row", "doc_id", "tokens", words.alias("words"), bins.alias("f"))


def _marked(labels: DataFrame, domain: Column | None, domains: Sequence[str]) -> DataFrame:
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (label_domain() if domain is None else domain).alias("d"))
    return marked.where(F.col("doc_id").isNotNull() & F.col("d").isin(list(domains)))


def word_evidence(held: DataFrame, labels: DataFrame, domain: Column | None = None, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """(h, k, s): the words that speak for a domain, its number and by how much they do.

    s is the logarithm of how much likelier the word is in the domain than in all labelled documents, divided by the
    number of words for the domain that stand in a document beside it, itself included, on average: words that come
    together don't count again and again."""
    marked = _marked(labels, domain, domains)
    own = marked.groupBy("doc_id").agg(F.collect_list("d").alias("ds"))
    seen = stored(held.select("_id", "doc_id", "words").join(own.hint("merge"), "doc_id").drop("doc_id"), "labelled", "zstd")
    of = {r["d"]: r["n"] for r in seen.select(F.explode("ds").alias("d")).groupBy("d").agg(F.count("*").alias("n")).collect()}  # a row for each domain
    all_ = float(sum(of.values()))
    times = lambda d: F.size(F.filter("ds", lambda x: x == d)).alias(f"n_{d}")
    each = seen.select("words", F.size("ds").alias("n"), *[times(d) for d in domains])
    counts = each.select("n", *[f"n_{d}" for d in domains], F.explode("words").alias("h")).groupBy("h")
    counts = counts.agg(F.sum("n").alias("df"), *[F.sum(f"n_{d}").alias(f"n{k}") for k, d in enumerate(domains)]).where(F.col("df") >= MIN_DOCS)
    share, found = F.col("df") / F.lit(all_ or 1.0), []
    for k, d in enumerate(domains):
        part = of.get(d, 0) / (all_ or 1.0)
        spread = F.sqrt(F.col("df") * part * (1 - part) * (1 - share))
        far = F.when(spread > 0, (F.col(f"n{k}") - F.col("df") * part) / spread).otherwise(0.0)
        gain = F.log((F.col(f"n{k}") + 2 * share) / (of.get(d, 0) + 2.0) / share)
        found.append(F.struct(far.alias("far"), F.lit(k).alias("k"), gain.alias("s")))
    best = counts.select("h", F.array_max(F.array(*found)).alias("b")).where((F.col("b.far") >= MIN_DEVIATION) & (F.col("b.s") > 0))
    chosen = stored(best.select("h", "b.k", "b.s"), "vocabulary")
    hits = stored(seen.select("_id", F.explode("words").alias("h")).join(chosen, "h").select("_id", "h", "k"), "hits")
    beside = hits.join(hits.groupBy("_id", "k").agg(F.count("*").alias("m")), ["_id", "k"]).groupBy("h").agg(F.avg("m").alias("m"))
    return stored(chosen.join(beside, "h").select("h", "k", (F.col("s") / F.col("m")).alias("s")), "evidence")


def with_words(held: DataFrame, evidence: DataFrame, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """(_id, doc_id, tokens, f): f with a bin for each domain of the sum of what a document's words say for it; a
    document without any such word is in bin 0."""
    sums = [F.sum(F.when(F.col("k") == k, F.col("s")).otherwise(0.0)).alias(f"e{k}") for k in range(len(domains))]
    said = held.select("_id", F.explode("words").alias("h")).join(evidence, "h").groupBy("_id").agg(*sums)
    level = lambda e: F.when(e > 0, 1 + F.least(F.lit(8), F.floor(4 * e))).otherwise(0).cast("string")
    bins = F.array(*[F.concat(F.lit(f"says {d}="), level(F.col(f"e{k}"))) for k, d in enumerate(domains)])
    return held.select("_id", "doc_id", "tokens", "f").join(said.hint("merge"), "_id", "left").select("_id", "doc_id", "tokens", F.concat("f", bins).alias("f"))


def posteriors(slim: DataFrame, labels: DataFrame, domain: Column | None = None, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """(_id, doc_id, tokens, p) per row of ``slim(_id, doc_id, tokens, f)``: the probabilities of each domain, which sum to 1.

    Naive Bayes over the bins of f: counts of all labelled rows, one row for each bin. A doc_id labelled twice counts
    with each label; labels without a document, of null or of no domain count nothing. Without any label all domains
    are equally likely."""
    k_of = range(len(domains))
    seen = slim.select("doc_id", "f").join(_marked(labels, domain, domains), "doc_id")
    bins = seen.select("d", F.explode("f").alias("b")).groupBy("b").agg(F.array(*[F.sum(F.when(F.col("d") == d, 1).otherwise(0)) for d in domains]).alias("n"))
    bins = stored(bins.withColumn("kind", F.split("b", "=")[0]), "bins")
    # a row for each kind of feature
    kinds = {r["kind"]: r for r in bins.groupBy("kind").agg(F.count("*").alias("size"), *[F.sum(F.col("n")[k]).alias(f"n{k}") for k in k_of]).collect()}
    some = next(iter(kinds.values()), None)
    prior = [float(np.log((some[f"n{k}"] if some else 0) + _SMOOTH)) for k in k_of]
    known, unseen = F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")
    for name, row in kinds.items():
        mass = [row[f"n{k}"] + _SMOOTH * (row["size"] + 1) for k in k_of]
        known = F.when(F.col("kind") == name, F.array(*[F.log((F.col("n")[k] + _SMOOTH) / mass[k]) for k in k_of])).otherwise(known)
        unseen = F.when(F.split("b", "=")[0] == name, F.array(*[F.lit(float(np.log(_SMOOTH / m))) for m in mass])).otherwise(unseen)
    each = slim.select("_id", "doc_id", "tokens", F.explode("f").alias("b")).join(bins.select("b", known.alias("s")), "b", "left")
    score = F.coalesce("s", unseen, F.array(*[F.lit(0.0)] * len(domains)))
    summed = each.select("_id", "doc_id", "tokens", score.alias("s")).groupBy("_id", "doc_id", "tokens").agg(*[(F.sum(F.col("s")[k]) + prior[k]).alias(f"z{k}") for k in k_of])
    top = F.greatest(*[F.col(f"z{k}") for k in k_of])
    odds = [F.exp(F.col(f"z{k}") - top) for k in k_of]
    return summed.select("_id", "doc_id", "tokens", F.array(*[o / sum(odds[1:], odds[0]) for o in odds]).alias("p"))


def calibrated(soft: DataFrame, labels: DataFrame, domain: Column | None = None, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """(_id, tokens, p) of ``soft(_id, doc_id, tokens, p)``: naive Bayes is too sure of itself, so the labelled tokens in
    each cell of a grid of posteriors say what the posterior is worth. A cell's posterior is the share of each domain in
    its labelled tokens and in PRIOR_DOCS documents of average length at the posterior before; so over the labelled
    documents of a cell expected and true tokens agree. The table of cells has at most (GRID + 2)^(domains - 1) rows."""
    marked = _marked(labels, domain, domains)
    cell = F.transform("p", lambda x: F.round(x * GRID).cast("int"))
    seen = soft.select("doc_id", "tokens", cell.alias("c")).join(marked, "doc_id")
    mean = seen.agg(F.avg("tokens")).first()[0]
    if not mean:
        return soft.select("_id", "tokens", "p")
    of = [F.sum(F.when(F.col("d") == d, F.col("tokens")).otherwise(0)) for d in domains]
    cells = stored(seen.groupBy("c").agg(F.array(*of).alias("n"), F.sum("tokens").alias("all")), "cells")
    prior = PRIOR_DOCS * float(mean)
    better = F.transform("p", lambda x, k: (F.get("n", k) + prior * x) / (F.col("all") + prior))
    met = soft.select("_id", "tokens", "p", cell.alias("c")).join(F.broadcast(cells), "c", "left")
    return met.select("_id", "tokens", F.when(F.col("all").isNotNull(), better).otherwise(F.col("p")).alias("p"))


def _cells(soft: DataFrame, k: int) -> DataFrame:
    """(tokens, p) of documents taken together by posteriors to three decimals: all their tokens, and the mean of their
    posteriors by tokens, so that sums over tokens stay the same."""
    near = [F.round(F.col("p")[i], 3).alias(f"q{i}") for i in range(k)]
    mean = [F.sum(F.col("tokens") * F.col("p")[i]) / F.sum("tokens") for i in range(k)]
    return soft.where("tokens > 0").groupBy(*near).agg(F.sum("tokens").alias("tokens"), F.array(*mean).alias("p")).select("tokens", "p")


def _rate(p: Column, steps: Sequence[Sequence[float]], most: float = MOST) -> Column:
    """Rate after the given steps from 1: each goes along the posterior and back to between zero and ``most``."""
    if not steps:
        return F.least(F.lit(1.0), F.lit(float(most)))
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    moved = lambda r, s: r - sum((p[k] * s[k] for k in range(1, len(steps[0]))), p[0] * s[0])
    return F.aggregate(moves, F.lit(1.0), lambda r, s: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), moved(r, s))))


def fit_rates(
    soft: DataFrame, targets: Mapping[str, float] = TARGETS, domains: Sequence[str] = DOMAINS, total: float | None = None, most: float = MOST
) -> tuple[list[list[float]], list[float], list[float]]:
    """(steps, expected tokens of each domain, their targets) for documents (tokens, p).

    Minimises the squared distance of ``sum(rate * tokens * p)`` from the targets over ``0 <= rate <= most``, starting at
    1. Each step goes along the gradient, scaled by the domains' second moments, and back into these bounds; a step that
    makes the distance no smaller is halved. It ends at the targets or, where rates within the bounds can't reach them, at
    the least distance: what is off then is told by the sums returned. ``total`` tokens, by default as many as there are."""
    k = len(domains)
    share = np.array([targets[d] for d in domains], float)
    share /= share.sum()
    cells = [F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]) for i in range(k) for j in range(i, k)]
    first = soft.agg(*[F.sum(F.col("tokens") * F.col("p")[i]) for i in range(k)], *cells).first()
    now = np.array([float(x or 0) for x in first[:k]])
    moment, at = np.zeros((k, k)), k
    for i in range(k):
        for j in range(i, k):
            moment[i, j] = moment[j, i] = float(first[at] or 0)
            at += 1
    wanted = share * (total if total is not None else now.sum())
    if not now.sum():
        return [], now.tolist(), wanted.tolist()
    now = now * min(1.0, most)
    scaled = np.linalg.pinv(moment + 1e-9 * np.trace(moment) * np.eye(k))
    steps: list[list[float]] = []
    pace = 1.0
    while np.abs(off := now - wanted).max() > TOLERANCE * wanted.sum() and pace > TOLERANCE:
        trial = steps + [(pace * scaled @ off).tolist()]
        sums = soft.withColumn("r", _rate(F.col("p"), trial, most)).agg(*[F.sum(F.col("r") * F.col("tokens") * F.col("p")[i]) for i in range(k)]).first()
        after = np.array([float(x) for x in sums])
        gain = 1 - np.linalg.norm(after - wanted) / np.linalg.norm(off)
        if gain > 0:
            steps, now = trial, after
        if gain <= TOLERANCE:
            pace /= 2
    return steps, now.tolist(), wanted.tolist()


def _rated(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], total: float | None, most: float, kept: Sequence[str] | None = None) -> tuple[DataFrame, float]:
    """((_row, tokens, p, rate), residual): the fit runs over cells of documents with nearly the same posterior; each
    document's rate follows from its own. Tables with a row for each document are joined by sorting at every size."""
    with scratch() as keep:
        held = keep(stored(_features(docs, kept), "features", "zstd"))
        slim = stored(with_words(held, word_evidence(held, labels)), "bins")
        soft = keep(stored(calibrated(stored(posteriors(slim, labels), "sure"), labels), "soft"))
        steps, now, wanted = fit_rates(stored(_cells(soft, len(DOMAINS)), "cells"), targets, total=total, most=most)
    off = float(np.abs(np.subtract(now, wanted)).max() / (sum(wanted) or 1.0))
    rated = soft.select("_id", "tokens", "p", _rate(F.col("p"), steps, most).alias("rate"))
    return held.select("_id", "_row").join(rated.hint("merge"), "_id").drop("_id"), off


def mixing_rates(
    docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, total: float | None = None, most: float = MOST, columns: Sequence[str] | None = None
) -> DataFrame:
    """``docs(doc_id, text, lang, source, ...)`` with ``tokens``, ``p`` (array over DOMAINS), ``rate`` (0 to ``most``), and
    ``residual``, the same on every row: by which share of all tokens the domain that is furthest off misses its target. A
    row per row.

    Empty documents have no tokens and take part like others at their posterior; repeated rows are rated each; an empty
    table gives no rows; columns of ``docs`` named tokens, p, rate or residual are replaced, all others kept, or
    those in ``columns``: without the texts there is far less to move."""
    added = ("tokens", "p", "rate", "residual")
    kept = [c for c in (docs.columns if columns is None else columns) if c not in added]
    rated, off = _rated(docs, labels, targets, total, most, kept)
    return rated.withColumn("residual", F.lit(off)).select(*[F.col(f"_row.{c}") for c in kept], *added)


def mixed(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, total: float | None = None, most: float = MOST) -> tuple[DataFrame, float]:
    """(``docs`` in the mixture, residual): each row as often as its rate says, the fraction decided by a hash of doc_id, so
    that the same documents are repeated whenever it runs, and none more often than ``most`` rounded up. All columns are
    kept. The residual is that of :func:`mixing_rates`: rates within the bounds may not reach the targets."""
    rated, off = _rated(docs, labels, targets, total, most)
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(-1)), F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    copies = F.floor(F.col("rate") + chance).cast("int")
    return rated.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).select("_row.*"), off
