"""Quotation linking for chat data: quoted passages are taken out of messages, linked by hash to the earlier message of
the conversation that they come from, and the messages of a conversation are put in the order of their replies.

Only built-in functions. Messages of one conversation are never gathered: they are range-partitioned, so that a
conversation with a third of all rows lies in many partitions, and each partition needs a few numbers of those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import drop_stored, scratch, stored

#: Marks before a quoted line: one > for each level, with at most three blanks before and one behind each.
QUOTE_MARKS = r"^(?: {0,3}>)+ ?"
#: Bits of a row's number within its partition, and parts in which a conversation's messages meet its size.
_ROW_BITS, SALTS = 33, 16
#: What ends a sentence.
SENTENCES = r"[.!?]+\s+|\n+"


def quote_level(line: Column) -> Column:
    """Number of > before the text of a line; 0 if it isn't quoted."""
    marks = F.regexp_extract(line, QUOTE_MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def without_marks(line: Column) -> Column:
    return F.regexp_replace(line, QUOTE_MARKS, "")


def normal_form(text: Column) -> Column:
    """What two spellings of a passage share: lower case, letters and digits only, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _hash(text: Column) -> Column:
    form = normal_form(text)
    return F.when(form != "", F.xxhash64(form))


def split_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` with ``own`` (the text without quoted lines, blank ends cut) and ``lines`` (level, body) of messages
    that quote; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = messages.withColumn("text", text).withColumn("quotes", F.col("text").rlike("(?m)" + QUOTE_MARKS))
    parts = F.split("text", "\n")
    own = F.array_join(F.filter(parts, lambda s: quote_level(s) == 0), "\n")
    out = out.withColumn("own", F.regexp_replace(F.when(F.col("quotes"), own).otherwise(F.col("text")), r"^\s+|\s+$", ""))
    return out.withColumn("lines", F.when(F.col("quotes"), F.transform(parts, lambda s: F.struct(quote_level(s).alias("level"), without_marks(s).alias("body")))))


def quoted_passages(split: DataFrame) -> DataFrame:
    """(conv_id, turn, row, passage, level, body, h): each run of quoted lines of one level, and its hash."""
    lines = split.where("quotes").select("conv_id", "turn", "row", F.posexplode("lines").alias("at", "l")).select("conv_id", "turn", "row", "at", "l.level", "l.body")
    within = Window.partitionBy("row").orderBy("at")
    runs = lines.withColumn("new", F.when(F.col("level") != F.coalesce(F.lag("level").over(within), F.lit(-1)), 1).otherwise(0))
    runs = runs.withColumn("passage", F.sum("new").over(within)).where("level > 0")
    whole = runs.groupBy("conv_id", "turn", "row", "passage", "level").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("ls"))
    whole = whole.withColumn("body", F.array_join(F.transform("ls", lambda x: x["body"]), "\n")).drop("ls")
    return whole.withColumn("h", _hash(F.col("body"))).where("h is not null")


def _latest_before(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """``asked(conv_id, h, turn, ...)`` with ``original``: the latest turn before its own in ``keys(conv_id, h, turn)``.

    One scan in order of turn instead of a join of all pairs: both tables are range-partitioned together, each partition
    looks back in itself, and what is carried over from the ones before is a row for each partition and key."""
    rest = [c for c in asked.columns if c not in ("conv_id", "h", "turn")]
    none = [F.lit(None).cast(dict(asked.dtypes)[c]).alias(c) for c in rest]
    rows = asked.select("conv_id", "h", "turn", F.lit(0).alias("key"), *rest).unionByName(keys.select("conv_id", "h", "turn", F.lit(1).alias("key"), *none))
    dealt = rows.repartitionByRange("conv_id", "h", "turn", "key").sortWithinPartitions("conv_id", "h", "turn", "key")
    rows = stored(dealt.withColumn("part", F.spark_partition_id()), "scan")
    seen = F.when(F.col("key") == 1, F.col("turn"))
    back = Window.partitionBy("part", "conv_id", "h").orderBy("turn", "key").rowsBetween(Window.unboundedPreceding, 0)
    tails = rows.groupBy("conv_id", "h", "part").agg(F.max(seen).alias("last"))
    several = Window.partitionBy("conv_id", "h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("carried", F.last("last", ignorenulls=True).over(several)).where("carried is not null").select("conv_id", "h", "part", "carried")
    found = rows.withColumn("near", F.last(seen, ignorenulls=True).over(back)).where("key = 0").join(carried, ["conv_id", "h", "part"], "left")
    return found.select("conv_id", "h", "turn", *rest, F.coalesce("near", "carried").alias("original"))


def link_quotes(split: DataFrame) -> DataFrame:
    """(row, passage, level, body, original): the latest earlier turn of the conversation whose own text, one of its
    paragraphs, lines or sentences is the passage; if there is none, the turn that most words of the passage come from,
    sentence by sentence, each from the latest turn that has it (of equals the latest); null if no sentence is found."""
    passages = stored(quoted_passages(split), "passages")
    with_quotes = passages.select("conv_id").distinct()
    sources = split.select("conv_id", "turn", "own").join(with_quotes, "conv_id", "left_semi")
    texts = F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", "\n"), F.split("own", SENTENCES))
    keys = sources.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(texts, _hash))).alias("h")).where("h is not null and turn is not null")
    units = passages.select("conv_id", "turn", "row", "passage", F.explode(F.array_distinct(F.transform(F.split("body", SENTENCES), normal_form))).alias("form")).where("form <> ''")
    words = F.size(F.split("form", " ")).alias("words")
    asked = passages.select("conv_id", "h", "turn", "row", "passage", F.lit(None).cast("int").alias("words"))
    asked = asked.unionByName(units.select("conv_id", F.xxhash64("form").alias("h"), "turn", "row", "passage", words))
    wanted = asked.select("conv_id", "h").distinct()
    met = _latest_before(asked, keys.join(wanted, ["conv_id", "h"], "left_semi")).where("original is not null")
    said = met.groupBy("row", "passage", "original").agg(F.max(F.col("words").isNull()).alias("whole"), F.sum("words").alias("words"))
    best = said.groupBy("row", "passage").agg(F.max(F.struct("whole", "words", "original"))["original"].alias("original"))
    return passages.select("row", "passage", "level", "body").join(best, ["row", "passage"], "left")


def _siblings(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, row, parent)`` with ``next``, the next reply to the same message, and ``eldest``, whether it is the
    first. Replies follow each other within the partition that their rows were numbered in, and partitions one another by
    their first replies: a message with very many replies is as many groups as partitions hold some."""
    m = messages.withColumns({"up": F.coalesce("parent", F.lit(-1)), "part": F.shiftright("row", _ROW_BITS)})
    key = ["conv_id", "up", "part"]
    heads = m.groupBy(*key).agg(F.min("row").alias("head"))
    by_part = Window.partitionBy("conv_id", "up").orderBy("part")
    heads = heads.withColumns({"after": F.lead("head").over(by_part), "nth": F.row_number().over(by_part)})
    m = m.join(heads, key)
    here = Window.partitionBy(*key).orderBy("row")
    follows = F.coalesce(F.lead("row").over(here), "after")
    return m.withColumns({"next": follows, "eldest": (F.col("nth") == 1) & (F.col("row") == F.col("head"))}).select("conv_id", "row", "parent", "next", "eldest")


def _tree_places(messages: DataFrame) -> DataFrame:
    """(row, place): the place of each message of ``messages(conv_id, row, parent)`` in its conversation, every message before
    its replies and these, one after the other with all that follows from them, in order of row.

    The way round the trees of a conversation enters and leaves each message once. Each of these steps knows the next;
    doubling the reach of all of them in a round counts, in log(steps) rounds, how many messages are still to be entered
    after each. A message has two rows, however many replies it has."""
    m = _siblings(messages)
    first = m.where("eldest and parent is not null").select(F.col("parent").alias("row"), F.col("row").alias("child"))
    m = m.join(first, "row", "left")
    # a step: 2 * row for entering, 2 * row + 1 for leaving
    enter = m.select("conv_id", (2 * F.col("row")).alias("step"), F.coalesce(2 * F.col("child"), 2 * F.col("row") + 1).alias("to"), F.lit(1).cast("long").alias("left"))
    leave = m.select("conv_id", (2 * F.col("row") + 1).alias("step"), F.coalesce(2 * F.col("next"), 2 * F.col("parent") + 1).alias("to"), F.lit(0).cast("long").alias("left"))
    now = stored(enter.unionByName(leave), "tour")
    while now.where("to is not null").limit(1).count():
        ahead = now.select(F.col("step").alias("to"), F.col("to").alias("far"), F.col("left").alias("more"))
        new = stored(now.join(ahead, "to", "left").select("conv_id", "step", F.col("far").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "tour")
        drop_stored(now)
        now = new
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))  # a conversation with very many messages is met in so many parts
    sizes = messages.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("salt", salts)
    entered = now.where("step % 2 = 0").withColumn("salt", F.pmod(F.xxhash64("step"), F.lit(SALTS)).cast("int"))
    return entered.join(sizes, ["conv_id", "salt"]).select((F.col("step") / 2).cast("long").alias("row"), (F.col("n") - F.col("left")).alias("place"))


def _answered(messages: DataFrame) -> DataFrame:
    """A row per message in order of turn, with what it answers, and the turn before it (``last``)."""
    slim = messages.select("conv_id", "turn", "role", "text")
    split = split_quotes(slim)
    dealt = split.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = stored(dealt.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "messages")

    here = Window.partitionBy("part", "conv_id").orderBy("row")
    earlier_turn = Window.partitionBy("part", "conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    placed = rows.drop("lines", "quotes").withColumn("at", F.row_number().over(here) - 1).withColumn("before", F.max("turn").over(earlier_turn))
    # conversations that go on from one partition to the next: their numbers, a row for each partition
    last = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max("turn").alias("last"), F.min("turn").alias("first"))
    by_part = Window.partitionBy("conv_id").orderBy("part")
    tails = last.withColumn("offset", F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tails = stored(tails.withColumn("parts", F.count("*").over(Window.partitionBy("conv_id"))).where("parts > 1"), "tails")
    # the last turn before a partition's first is the last of some partition, or the greatest below one
    below = placed.join(tails.select("conv_id", "part", F.col("last").alias("turn")), ["conv_id", "part", "turn"], "left_semi").groupBy("conv_id", "part").agg(F.max("before").alias("below"))
    marks = tails.join(below, ["conv_id", "part"], "left").select("conv_id", F.explode(F.array("first", "last", "below")).alias("turn")).where("turn is not null").distinct()
    before = marks.withColumn("carried", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumnRenamed("turn", "first")
    carried = stored(tails.join(before, ["conv_id", "first"], "left").select("conv_id", "part", "offset", "carried"), "carried")
    placed = placed.join(carried, ["conv_id", "part"], "left")

    links = link_quotes(rows)
    per_row = links.groupBy("row").agg(
        F.count("*").alias("n_quotes"), F.count("original").alias("n_linked"), F.coalesce(F.max(F.when(F.col("level") == 1, F.col("original"))), F.max("original")).alias("quoted")
    )
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return stored(
        placed.join(stored(per_row, "quotes"), "row", "left").select(
            "row", "conv_id", "turn", "role", F.col("own").alias("text"), (F.col("at") + F.coalesce("offset", F.lit(0))).cast("long").alias("position"),
            F.when(known, F.coalesce("before", "carried")).alias("last"), F.when(known, F.coalesce("quoted", "before", "carried")).alias("reply_to"),
            F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        ),
        "answered",
    )


def reply_order(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, position, reply_to, n_quotes, n_linked, text) per row of ``messages(conv_id, turn, role,
    text, ...)``.

    ``text`` is the message without quoted lines; ``reply_to`` the latest turn that its first-level quotes come from,
    or else from any of its quotes, or else the last turn before it in the conversation, null for the first.
    ``position`` counts from 0 in reply order: in order of turn, role and text, but where a quote answers another turn
    than the last, the conversation's messages stand in the order of its reply tree, each behind what it answers with all
    that follows from it (a turn with several messages is answered at its first). Null texts are empty; rows with a null
    conv_id or turn keep their place (nulls first) and are linked with nothing; repeated rows come back as often as they
    came, each with a position; an empty table gives no rows; further columns are ignored."""
    out = ["conv_id", "turn", "role", "position", "reply_to", "n_quotes", "n_linked", "text"]
    with scratch() as kept:
        answered = kept(_answered(messages))
        trees = stored(answered.where("reply_to <> last").select("conv_id").distinct(), "trees")
        if not trees.limit(1).count():
            return answered.select(*out)
        within = answered.join(trees, "conv_id", "left_semi")
        firsts = within.where("turn is not null").groupBy("conv_id", F.col("turn").alias("reply_to")).agg(F.min("row").alias("parent"))
        tree = stored(within.select("conv_id", "row", "reply_to").join(firsts, ["conv_id", "reply_to"], "left").select("conv_id", "row", "parent"), "tree")
        places = kept(stored(_tree_places(tree), "places"))
    return answered.join(places, "row", "left").withColumn("position", F.coalesce("place", "position")).select(*out)


def chat_lines(ordered: DataFrame, template: str = "<|{role}|>\n{text}") -> DataFrame:
    """``ordered`` with ``formatted``: ``template`` filled with role and text; a null role is ``user``."""
    head, _, rest = template.partition("{role}")
    middle, _, tail = rest.partition("{text}")
    return ordered.withColumn("formatted", F.concat(F.lit(head), F.coalesce("role", F.lit("user")), F.lit(middle), F.col("text"), F.lit(tail)))
