"""Exact Jaccard join of texts on distinct word n-grams, by vertical partitioning of one global n-gram order.

1. A first global order follows the n-grams' hashes, with the ``COMMON_LIMIT`` most frequent ones last (a bounded list;
   which n-grams it holds changes the work and never the result). Texts with equal sets are one class. Of each class,
   the first ``n - ceil(t n) + 1`` n-grams go to an inverted index: two sets that reach the threshold share one of them.
   Classes without an index neighbour that sizes and shared counts allow are done.
2. Among the rest, n-grams are counted exactly and the order becomes rare first. N-grams that one class alone has bound
   the overlap of any pair: ``min(a - alone_a, b - alone_b)``; classes with too many of them are done.
3. Candidates come from prefixes of that order in two steps, so that a family of near copies isn't expanded into all
   its pairs: first along each index entry, each class with the one that has fewest rarer n-grams and with its neighbour; then
   only pairs from different components of what is linked by then. The sizes of 64 fragments cut pairs once more.
4. Overlaps are counted fragment by fragment, each (pair, fragment) by itself, and summed per pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .graph import connected_components
from .kernels import Words, list_array, shingle_sets, text_chunks
from .tables import drop_stored, scratch, stored

COMMON_LIMIT = 1 << 18
COMMON_LEAST = 12
PART_SHINGLES = 1 << 21
FRAGMENTS = 8
BROADCAST_IDS = 1 << 20
HOT_RUN = 2000
#: Rows of one n-gram that meet in a task; more are dealt to several. Rows of a class above which it is joined by broadcast.
DEALT, HOT_CLASS = 500, 100_000
OPEN_BLOCK = 64
BINS = 64
_S = np.int64


def _frequent_here(n: int):
    """(h, c): n-grams in two or more texts of a part of at most PART_SHINGLES n-grams."""

    def count(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(parts), return_counts=True)
        keep = c > 1
        return pa.record_batch({"h": h[keep].view(_S), "c": c[keep].astype(_S)})

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                own = [s for s in shingle_sets(Words(data, offsets), n) if len(s)]
                parts += own
                size += sum(map(len, own))
                if size >= PART_SHINGLES:
                    yield count(parts)
                    parts, size = [], 0
        if parts:
            yield count(parts)

    return run


def _profiles(n: int, percent: int, common: np.ndarray):
    """One row per text: set size, two fingerprints of the set, fragment sizes, first n-grams of the global order.

    ``common``: frequent n-grams, the least frequent first."""
    sorted_at = np.argsort(common)
    sorted_common = common[sorted_at]

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, offsets in text_chunks(batch.column("text")):
                sets = shingle_sets(Words(data, offsets), n)
                size = np.array([len(s) for s in sets], _S)
                flat = np.concatenate(sets)
                row = np.repeat(np.arange(b - a), size)
                fp1, fp2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                np.add.at(fp1, row, flat * np.uint64(0xA0761D6478BD642F))
                np.bitwise_xor.at(fp2, row, flat)
                bins = np.bincount(row * BINS + (flat >> np.uint64(58)).astype(_S), minlength=(b - a) * BINS).reshape(b - a, BINS)
                at = np.searchsorted(sorted_common, flat)
                is_common = (at < len(sorted_common)) & (sorted_common[np.minimum(at, max(len(sorted_common) - 1, 0))] == flat) if len(common) else np.zeros(len(flat), bool)
                starts = np.concatenate([[0], np.cumsum(size)])
                heads, last = [], np.zeros(b - a, _S)
                for d in range(b - a):
                    s, k = sets[d], int(size[d])
                    take = k - -(-percent * k // 100) + 1 if k else 0
                    mask = is_common[starts[d] : starts[d + 1]]
                    head = s[~mask] if mask.any() else s
                    if len(head) < take:
                        rank = sorted_at[at[starts[d] : starts[d + 1]][mask]]
                        last[d] = (1 << 62) + np.sort(rank)[take - len(head) - 1]
                        head = np.concatenate([head, s[mask][np.argsort(rank)]])
                    elif k:
                        last[d] = head[take - 1] >> np.uint64(2)
                    heads.append(head[:take].view(_S))
                yield pa.record_batch(
                    {
                        "doc_id": ids.slice(a, b - a),
                        "n": size,
                        "last": last,
                        "fp1": fp1.view(_S),
                        "fp2": fp2.view(_S),
                        "bins": pa.array([x.tobytes() for x in bins.astype(np.uint16 if bins.max(initial=0) < 65536 else np.uint32)], pa.binary()),
                        "head": list_array(heads, pa.int64()),
                    }
                )

    return run


def _least(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap with which sets of these sizes reach the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def _open(percent: int):
    """Ids in the runs of equal ``h`` that have a neighbour there which sizes and shared counts allow.

    Below the lower of their last index n-grams, two sets share at most ``min(shared)`` n-grams, and above it the set
    with that last n-gram has ``n - take`` left. Runs over HOT_RUN rows aren't looked into, all of them stay: these don't
    come here."""

    def of_run(ids, n, last, shared):
        order = np.argsort(last, kind="stable")
        ids, n, shared = ids[order], n[order], shared[order]
        left = -(-percent * n // 100) - 1
        found = np.zeros(len(n), bool)
        for at in range(0, len(n), OPEN_BLOCK):  # each row with those behind it, a block of rows at a time
            a, b = slice(at, at + OPEN_BLOCK), slice(at, None)
            need = _least(n[a, None], n[None, b], percent) - left[a, None]
            fits = (np.minimum(n[a, None], n[None, b]) * 100 >= np.maximum(n[a, None], n[None, b]) * percent) & (np.minimum(shared[a, None], shared[None, b]) >= need)
            fits &= np.arange(fits.shape[0])[:, None] < np.arange(fits.shape[1])[None, :]
            found[a] |= fits.any(1)
            found[b] |= fits.any(0)
        return ids[found]

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            h, *rest = (batch.column(k).to_numpy() for k in ("h", "id", "n", "last", "shared"))
            cuts = np.flatnonzero(np.diff(h)) + 1
            keep = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
                if held and held[0][0] != h[a]:
                    keep.append(of_run(*(np.concatenate(x) for x in zip(*(r[1] for r in held), strict=True))))
                    held = []
                held.append((h[a], [x[a:b] for x in rest]))
            if keep:
                yield pa.record_batch({"doc_id": np.unique(np.concatenate(keep))})
        if held:
            yield pa.record_batch({"doc_id": of_run(*(np.concatenate(x) for x in zip(*(r[1] for r in held), strict=True)))})

    return run


def _grams(n: int):
    """(h, id): all n-grams of each text."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_chunks(batch.column("text")):
                sets = shingle_sets(Words(data, offsets), n)
                yield pa.record_batch({"h": np.concatenate(sets).view(_S), "id": np.repeat(ids[a:b], [len(s) for s in sets]).astype(_S)})

    return run


def _segments(n: int):
    """(doc_id, fragment, seg): the sorted n-grams of a text that fall into each fragment of the hash order."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, data, offsets in text_chunks(batch.column("text")):
                rows = []
                for d, s in enumerate(shingle_sets(Words(data, offsets), n)):
                    cuts = np.searchsorted(s, (np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(61)))
                    rows += [(ids[a + d], f, part.tobytes()) for f, part in enumerate(np.split(s, cuts)) if len(part)]
                yield pa.record_batch(
                    {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "fragment": pa.array([r[1] for r in rows], pa.int32()), "seg": pa.array([r[2] for r in rows], pa.binary())}
                )

    return run


def _may_reach(percent: int):
    """Keep pairs whose fragment sizes allow the threshold."""

    def wide(column: pa.Array) -> np.ndarray:
        texts = column.to_pylist()
        return np.array([np.frombuffer(x, np.uint16 if len(x) == 2 * BINS else np.uint32) for x in texts], np.int64).reshape(-1, BINS)

    def run(batches):
        for batch in batches:
            most = np.minimum(wide(batch.column("abins")), wide(batch.column("bbins"))).sum(1)
            sizes = batch.column("an").to_numpy() + batch.column("bn").to_numpy()
            keep = 100 * most >= percent * (sizes - most)
            yield batch.select(["a", "b", "an", "bn"]).filter(pa.array(keep))

    return run


def _partial_overlaps(batches):
    for batch in batches:
        left, right = batch.column("aseg").to_pylist(), batch.column("bseg").to_pylist()
        part = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            part.append(int(np.count_nonzero(both[1:] == both[:-1])))
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "part": pa.array(part, pa.int64())})


def _of(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``table`` with a doc_id of the stored table ``ids``; these are broadcast up to BROADCAST_IDS."""
    return table.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _verified(pairs: DataFrame, profiles: DataFrame, source: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold, with both sizes. N-grams are read again for their texts alone."""
    side = lambda k: profiles.select(F.col("doc_id").alias(k), F.col("bins").alias(f"{k}bins"))
    may = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "an", "bn", "abins", "bbins").mapInArrow(_may_reach(percent), "a long, b long, an long, bn long")
    may = stored(may, "pairs")
    ids = stored(may.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "members")
    segments = stored(_of(source, ids).dropDuplicates(["doc_id"]).mapInArrow(_segments(n), "doc_id long, fragment int, seg binary"), "segments")
    seg = lambda k: segments.select(F.col("doc_id").alias(k), "fragment", F.col("seg").alias(f"{k}seg"))
    met = may.select("a", "b").join(seg("a"), "a").join(seg("b"), ["b", "fragment"]).select("a", "b", "aseg", "bseg")
    total = met.mapInArrow(_partial_overlaps, "a long, b long, part long").groupBy("a", "b").agg(F.sum("part").alias("o"))
    return total.join(may, ["a", "b"]).where(F.col("o") * 100 >= (F.col("an") + F.col("bn") - F.col("o")) * percent).select("a", "b", "o", "an", "bn")


def _near(percent: int):
    """The two sets may reach the threshold if the n-gram at places ``xat``, ``yat`` of their orders is the first that
    they share. A pair is thus found at its first shared n-gram, or not at all."""
    most = F.least(F.col("xn") - F.col("xat"), F.col("yn") - F.col("yat")) + 1
    return most * 100 >= (F.col("xn") + F.col("yn") - most) * percent


def _repeated(grams: DataFrame) -> DataFrame:
    """``grams(h, ...)`` with ``df``, how many rows have the same h, where that is more than one. Counts are added up before
    they are shuffled and joined back, so that a very common n-gram isn't one group."""
    counts = grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    return grams.join(counts, "h")


def _dealt(postings: DataFrame) -> DataFrame:
    """``postings`` with ``parts``, over how many tasks the rows of their n-gram are dealt, and ``part``, one of them."""
    counts = postings.groupBy("h").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    return postings.join(counts, "h").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def _with_classes(profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """Texts that have a class with other texts, with its columns; very large classes are broadcast, as they are few."""
    key = ["n", "fp1", "fp2"]
    hot, cold = classes.where(F.col("size") > HOT_CLASS), classes.where(F.col("size") <= HOT_CLASS)
    found = profiles.join(F.broadcast(hot), key)
    rest = profiles.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key, "left")
    return found.unionByName(rest)


def _grouped(docs: DataFrame, n: int, percent: int, links: bool) -> tuple[DataFrame, DataFrame]:
    """The profiles of all texts, and the classes that have copies or links: n, fp1, fp2, size, class_id, component_id."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    here = source.select("text").mapInArrow(_frequent_here(n), "h long, c long")
    often = here.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON_LEAST).orderBy(F.desc("c"), "h").limit(COMMON_LIMIT)
    common = often.select("h").toPandas()["h"].to_numpy(_S)[::-1].view(np.uint64)  # bounded by COMMON_LIMIT
    profile_schema = "doc_id long, n long, last long, fp1 long, fp2 long, bins binary, head array<long>"
    profiles = stored(source.mapInArrow(_profiles(n, percent, common), profile_schema), "profiles")
    full = profiles.where("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("class_id"), (F.count_distinct("doc_id") if links else F.count("*")).alias("size")), "classes")
    reps = full.select("doc_id", "n", "last", "bins", "head").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    # the first index, without entries that one class alone has
    index = reps.select(F.explode("head").alias("h"), F.col("doc_id").alias("id"))
    shared = stored(_repeated(index), "shared")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, as the work is more than its bytes tell
    sizes = reps.select(F.col("doc_id").alias("id"), "n", "last").join(shared.groupBy("id").agg(F.count("*").alias("shared")), "id")
    runs = shared.where(F.col("df") <= HOT_RUN).drop("df").join(sizes, "id").repartition(tasks, "h").sortWithinPartitions("h")
    hot = shared.where(F.col("df") > HOT_RUN).select(F.col("id").alias("doc_id"))
    open_ = stored(runs.mapInArrow(_open(percent), "doc_id long").unionByName(hot).distinct(), "open")

    # the rare-first order of what is open; ``n - alone`` n-grams are in other sets too
    grams = _of(source, open_).dropDuplicates(["doc_id"]).mapInArrow(_grams(n), "h long, id long")
    grams = stored(grams, "grams")
    counted = stored(_repeated(grams), "counted")
    drop_stored(grams)
    met = counted.groupBy("id").agg(F.count("*").alias("met")).join(reps.select(F.col("doc_id").alias("id"), "n"), "id")
    met = met.where(F.col("met") * 100 >= F.col("n") * percent)
    ranked = counted.join(met, "id").withColumn("at", F.col("n") - F.col("met") + F.row_number().over(Window.partitionBy("id").orderBy("df", "h")))
    take = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    postings = stored(ranked.where(F.col("at") <= take).select("h", "id", "n", "at"), "postings")
    drop_stored(counted)
    postings = stored(_dealt(postings), "dealt")
    known = reps.select("doc_id", "bins")

    # common n-grams are dealt in one way, so that the neighbours that they give are the same pairs again and again
    most = postings.agg(F.max("parts")).first()[0] or 1
    dealt = postings.withColumn("deal", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.lit(most))).otherwise(0))
    along = Window.partitionBy("h", "deal").orderBy("at", "n", "id")
    row = lambda get: [get(k).over(along).alias(f"x{k}") for k in ("id", "n", "at")] + [F.col(k).alias(f"y{k}") for k in ("id", "n", "at")]
    beside = dealt.select(*row(F.lag)).unionByName(dealt.where("parts = 1").select(*row(F.first)))
    hot = postings.where("parts > 1")
    tops = hot.groupBy("h").agg(F.min(F.struct("at", "n", "id")).alias("x"))
    beside = beside.unionByName(hot.join(tops, "h").select(*[F.col(f"x.{k}").alias(f"x{k}") for k in ("id", "n", "at")], *[F.col(k).alias(f"y{k}") for k in ("id", "n", "at")]))
    first = beside.where((F.col("xid") != F.col("yid")) & _near(percent)).select(F.col("xid").alias("x"), F.col("xn").alias("xn"), F.col("yid").alias("y"), F.col("yn").alias("yn"))
    ordered = lambda df: df.select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
        F.when(F.col("x") < F.col("y"), F.col("xn")).otherwise(F.col("yn")).alias("an"),
        F.when(F.col("x") < F.col("y"), F.col("yn")).otherwise(F.col("xn")).alias("bn"),
    ).distinct()
    tried = stored(ordered(first), "tried")
    linked = stored(_verified(tried, known, source, n, percent), "links")

    # what is linked by now needs no further pair inside, unless links are counted; pairs across are all tried
    placed = postings.withColumn("c", F.col("id"))
    if not links:
        joined = stored(connected_components(linked.select(F.col("a").alias("u"), F.col("b").alias("v"))), "joined")
        placed = postings.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    placed = stored(placed, "placed")
    spread = placed.groupBy("h").agg((F.min("c") != F.max("c")).alias("mixed")).where("mixed").select("h")
    mixed = stored(placed.join(spread, "h", "left_semi"), "mixed")
    side = lambda s: mixed.select("h", "parts", "part", *[F.col(k).alias(s + k) for k in ("id", "n", "at", "c")])
    every = side("y").drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # the smaller set of a pair needs no more than this much of its own prefix
    short = lambda s: F.col(s + "at") <= F.col(s + "n") - F.ceil(F.col(s + "n") * (2 * percent) / (100 + percent)) + 1
    in_reach = F.when(F.col("xn") < F.col("yn"), short("x")).when(F.col("xn") > F.col("yn"), short("y")).otherwise(short("x") | short("y"))
    across = side("x").drop("parts").join(every, ["h", "part"]).where((F.col("xc") < F.col("yc")) & _near(percent) & in_reach)
    across = across.select(F.col("xid").alias("x"), "xn", F.col("yid").alias("y"), "yn")
    rest = stored(ordered(across).join(tried, ["a", "b"], "left_anti"), "rest")
    more = _verified(rest, known, source, n, percent)
    edges = stored(linked.select("a", "b").unionByName(more.select("a", "b")), "edges")
    final = stored(connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")

    grouped = classes.join(final.withColumnRenamed("node", "class_id"), "class_id", "left")
    if links:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(classes.select(F.col("class_id").alias("b"), "size"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("size").alias("near"))
        grouped = grouped.join(near, "class_id", "left").withColumn("n_links", F.coalesce("near", F.lit(0)) + F.col("size") - 1)
    grouped = grouped.where("size > 1 or component is not null").select("n", "fp1", "fp2", "size", "class_id", F.coalesce("component", "class_id").alias("component_id"), *["n_links"] * links)
    return profiles, stored(grouped, "grouped")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, links: bool = False) -> DataFrame:
    """Groups of texts joined by links: two texts link when ``100 * |A ∩ B| >= percent * |A ∪ B|`` for their sets of
    distinct ``n``-word shingles (words: runs between blanks and controls 9-13; A-Z lower-cased; n-grams are compared
    by 64-bit hashes).

    ``docs``: (doc_id long, text string, ...). Returns (doc_id, n_shingles, class_id, component_id), a row per input
    row: class_id is the smallest doc_id with the same set, component_id the smallest reachable by links.
    Null or empty texts have no shingles and stand alone; a text under ``n`` words is one shingle; repeated rows come
    back as often as they came; a null doc_id stays null in every id column; an empty table gives an empty result;
    further columns are ignored.

    With ``links`` also n_links: the number of other documents that a document links with (doc_ids that repeat count
    once). Then pairs inside what is linked are looked at as well, so the work grows with the number of links."""
    with scratch() as kept:
        profiles, grouped = map(kept, _grouped(docs, n, percent, links))
    extra = ["n_links"] * links
    slim = profiles.select("doc_id", "n", "fp1", "fp2")
    alone = slim.where("n = 0 or doc_id is null").withColumns({c: F.lit(None).cast("long") for c in ["size", "class_id", "component_id", *extra]})
    placed = alone.unionByName(_with_classes(slim.where("n > 0 and doc_id is not null"), grouped))
    return placed.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in extra],
    )
