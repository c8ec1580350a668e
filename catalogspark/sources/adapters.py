"""Catalog tables derived from the star-schema and text tables of the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CHANGE_COLUMNS, ENTRY_COLUMNS


def pick(number: Column, values: tuple[str, ...]) -> Column:
    """``values[number % len]``."""
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _attrs(**values: Column) -> Column:
    """Attributes by name, each a list or null for none."""
    pairs = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull()))


def _none() -> Column:
    return F.array().cast("array<string>")


def _event_attrs() -> Column:
    """What kind of event it is, and by its value who may see it."""
    kind, value, user = F.col("event_type"), F.col("value"), F.col("user_id").cast("string")
    closed = value >= 90
    return _attrs(
        tag=F.array(kind, F.when(value < 10, "small").otherwise("large")),
        capability=F.when(kind.isin("click", "view"), F.array(F.lit("browse"))).when(kind == "purchase", F.array(F.lit("pay"))),
        env=F.array(F.date_format("ts", "EEE")),
        status=F.array(F.when(kind == "error", "disabled").otherwise("active")),
        visibility=F.array(F.when(closed, "restricted").when(kind == "signup", "internal").otherwise("public")),
        allowed_group=F.when(closed, F.array(kind)),
        endpoint=F.when(kind == "click", F.array(F.concat(F.lit("app/"), user))),
        owner=F.when(kind == "error", _none()).otherwise(F.array(user)),
    )


def _document_attrs(revised: bool) -> Column:
    """Source and size as tags, the language's group for sources that not all may see."""
    lang, source, size = F.col("lang"), F.col("source"), F.col("n_chars")
    closed = source.isin("src3", "src11")
    length = F.when(size < 700, "short").when(size < 2500, "page").otherwise("long")
    return _attrs(
        tag=F.array(F.lit("revised")) if revised else F.array(source, length),
        capability=F.array(F.when(lang == "en", "quote").otherwise("translate")),
        env=F.array(F.lit("desk") if revised else F.when(size > 4000, "archive").otherwise("shelf")),
        status=F.array(F.when(size < 100, "disabled").otherwise("active")),
        visibility=F.array(F.when(closed, "restricted").when(lang == "es", "internal").otherwise("public")),
        allowed_group=F.when(closed, F.array(lang)),
        endpoint=F.when(lang != "fr", F.array(F.concat(source, F.lit("/"), F.col("doc_id").cast("string")))),
        owner=F.when(lang == "de", _none()).otherwise(F.array(source)),
    )


def _ms(ts: Column) -> Column:
    return F.date_trunc("MILLISECOND", ts.cast("timestamp"))


def _numbered_events(events: DataFrame) -> DataFrame:
    rev = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("int")
    return events.withColumn("id", F.concat(F.lit("user:"), F.col("user_id").cast("string"))).withColumn("rev", rev)


def entries_from_events(events: DataFrame) -> DataFrame:
    """A revision for each event of a user but every fiftieth, whose change has no entry. Of every sixth event meta is
    encoded twice: a JSON text that holds JSON."""
    k, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    rows = _numbered_events(events).where(k % 50 != 49)
    quoted = F.concat(F.lit('"'), F.replace(F.replace("props", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    meta = F.when(k % 6 == 0, quoted).otherwise(F.col("props"))
    return rows.select(
        "id", "rev", kind.alias("type"), F.concat(F.lit("ns"), (F.col("user_id") % 5).cast("string")).alias("namespace"),
        F.concat(F.lit("User "), user, F.lit(" "), kind).alias("name"), F.concat(kind, F.lit(" by user "), user).alias("description"),
        F.when(kind == "signup", "").when(kind != "error", F.floor(F.col("value") / 10).cast("string")).alias("version"),
        _event_attrs().alias("attrs"), F.lit(None).cast("string").alias("manifest"), meta.alias("meta"),
        _ms(F.col("ts")).alias("created_at"), _ms(F.col("ts")).alias("updated_at"),
    )


def changes_from_events(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "set_status").otherwise("publish")
    rows = _numbered_events(events).select(F.col("event_id").alias("seq"), "id", "rev", F.col("ts").cast("timestamp").alias("changed_at"), kind.alias("change_type"))
    return rows.select(*CHANGE_COLUMNS)


def entries_from_documents(documents: DataFrame) -> DataFrame:
    """Revision 1 of each document, and revision 2 of those in other languages than English."""
    k, size = F.col("doc_id"), F.col("n_chars")
    at = F.timestamp_add("HOUR", (size % 97).cast("int"), F.lit("2024-01-01").cast("timestamp"))

    def revision(rows: DataFrame, rev: int, when: Column) -> DataFrame:
        return rows.select(
            F.concat(F.lit("doc:"), F.col("lang"), F.lit(":"), k.cast("string")).alias("id"), F.lit(rev).alias("rev"), F.col("lang").alias("type"),
            F.col("source").alias("namespace"), F.concat(F.lit("Document "), k.cast("string")).alias("name"), F.col("text").alias("description"),
            F.when(F.col("lang") == "es", "").when(size >= 700, F.concat(F.floor(size / 1000).cast("string"), F.lit(".0"))).alias("version"),
            _document_attrs(rev == 2).alias("attrs"), F.lit(None).cast("string").alias("manifest"), F.lit(None).cast("string").alias("meta"),
            when.alias("created_at"), when.alias("updated_at"),
        )

    return revision(documents, 1, at).unionByName(revision(documents.where("lang <> 'en'"), 2, F.timestamp_add("DAY", F.lit(1), at)))


def commands_from_orders(orders: DataFrame) -> DataFrame:
    """Publish and set_status commands in order of ``ord``; every fifth is for an id that isn't stored."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    op = F.when(key % 3 == 0, "set_status").otherwise("publish")
    id_ = F.concat(F.lit("cust:"), F.col("o_custkey").cast("string"), F.when(key % 5 == 0, ":new").otherwise(""))
    attrs = F.create_map(F.lit("status"), F.array(F.lit("active")), F.lit("tag"), F.array("o_orderpriority"))
    return orders.select(
        key.alias("ord"), op.alias("op"), id_.alias("id"), F.lit("customer").alias("type"), F.lit("shop").alias("namespace"),
        F.concat(F.lit("Order "), key.cast("string")).alias("name"), F.lit("").alias("description"), F.lit(None).cast("string").alias("version"),
        attrs.alias("attrs"), F.lit(None).cast("string").alias("manifest"), F.lit(None).cast("string").alias("meta"),
        F.when(status == "P", "active").when(status == "O", "deprecated").otherwise("disabled").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("reason"),
    )


def entries_from_customers(customer: DataFrame) -> DataFrame:
    """A stored revision for every customer: what commands then meet."""
    k = F.col("c_custkey")
    at = F.lit("2024-01-01").cast("timestamp")
    return customer.select(
        F.concat(F.lit("cust:"), k.cast("string")).alias("id"), (k % 3 + 1).cast("int").alias("rev"), F.lit("customer").alias("type"), F.lit("shop").alias("namespace"),
        F.col("c_name").alias("name"), F.lit("").alias("description"), F.lit(None).cast("string").alias("version"),
        F.create_map(F.lit("status"), F.array(F.lit("active"))).alias("attrs"), F.lit(None).cast("string").alias("manifest"),
        F.when(k % 2 == 0, F.lit('{"reason":"stored"}')).alias("meta"), at.alias("created_at"), at.alias("updated_at"),
    ).select(*ENTRY_COLUMNS)


def requesters_from_customers(customer: DataFrame) -> DataFrame:
    """Header-like columns: groups by market segment, no subject for those in debt."""
    segment = F.col("c_mktsegment")
    groups = F.when(segment == "MACHINERY", "en,click").when(segment == "BUILDING", "de, fr").when(segment == "AUTOMOBILE", " fr ,,purchase").when(segment == "HOUSEHOLD", "law").otherwise("")
    subject = F.when(F.col("c_acctbal") >= 0, F.col("c_custkey").cast("string"))
    return customer.select(F.lit(None).cast("string").alias("authorization"), subject.alias("sub"), groups.alias("groups"), F.col("c_custkey").alias("requester"))


def batch_requests_from_orders(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("user:"), (F.col("o_custkey") % 200).cast("string")).alias("id"))


def bench_runs_from_events(events: DataFrame) -> DataFrame:
    """Rows like those of benchmark files."""
    v = F.col("value")
    return events.select(
        F.concat(F.lit("d"), (F.col("user_id") % 2).cast("string")).alias("dataset"), F.lit("default").alias("scenario"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("target"), F.concat(F.lit("http://"), F.col("event_id").cast("string")).alias("endpoint"),
        F.col("event_type").alias("suite"), v.alias("p50_ms"), (v * 2).alias("p95_ms"), (v * 3).alias("p99_ms"), (v + 1).alias("req_per_sec_avg"),
        F.col("event_id").alias("ts"), F.col("event_id").cast("string").alias("path"),
    )


def json_lines_from_events(events: DataFrame) -> DataFrame:
    """(value): an entry as a line of JSON for each event, in odd forms: attributes encoded twice or as plain values, a
    meta that is a text, no description, time zones."""
    k = F.col("event_id")
    text = lambda name, value: F.concat(F.lit(f'"{name}":"'), value.cast("string"), F.lit('"'))
    attrs = F.when(k % 3 == 0, F.concat(F.lit('{"tag":"t'), (k % 7).cast("string"), F.lit('","size":'), (k % 10).cast("string"), F.lit("}")))
    attrs = attrs.when(k % 3 == 1, F.concat(F.lit('"{\\"tag\\":[\\"t'), (k % 7).cast("string"), F.lit('\\"],\\"size\\":null}"'))).otherwise(F.lit("[1]"))
    meta = F.when(k % 4 == 0, F.lit("null")).when(k % 4 == 1, F.concat(F.lit('"{\\"n\\":'), k.cast("string"), F.lit('}"'))).otherwise(F.concat(F.lit('{"n":'), k.cast("string"), F.lit("}")))
    described = F.when(k % 5 != 0, F.concat(F.lit(","), text("description", F.col("event_type")))).otherwise("")
    time = F.concat(F.lit('"updated_at":"2024-02-03T04:05:06.'), F.lpad((k % 1000).cast("string"), 3, "0"), F.when(k % 2 == 0, "789Z").otherwise("789+02:00"), F.lit('"'))
    line = F.concat(
        F.lit("{"), text("id", F.concat(F.lit("line:"), k.cast("string"))), F.lit(',"rev":'), (k % 9).cast("string"), F.lit(","), text("type", F.col("event_type")),
        F.lit(',"attrs":'), attrs, F.lit(',"meta":'), meta, described, F.lit(","), time, F.lit("}"), F.when(k % 11 == 0, "\n").otherwise(""),
    )
    return events.select(line.alias("value"))


def bench_files_from_events(events: DataFrame) -> DataFrame:
    """(run, value): a benchmark run for each user as a line of JSON, with a summary for each type of event."""
    per = events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"), F.count("*").cast("double").alias("n"))
    summary = F.struct(
        F.concat(F.lit("t"), (F.col("user_id") % 2).cast("string")).alias("target"), F.lit("http://x").alias("endpoint"), F.col("event_type").alias("suite"),
        F.col("n").alias("p50_ms"), (F.col("n") * 2).alias("p95_ms"), (F.col("n") * 3).alias("p99_ms"), (F.col("last") % 100).cast("double").alias("req_per_sec_avg"),
    )
    u = F.col("user_id")
    # later by the clock face is earlier in time for every other user
    at = F.concat(F.lit("2024-01-01T"), F.lpad((u % 10 + 10).cast("string"), 2, "0"), F.lit(":00:00"), F.when(u % 2 == 0, "Z").otherwise("+09:00"))
    whole = F.to_json(F.struct(at.alias("generated_at"), F.when(u % 3 != 0, "d").alias("dataset"), F.col("summaries")))
    return per.groupBy("user_id").agg(F.sort_array(F.collect_list(summary)).alias("summaries")).select(u.alias("run"), whole.alias("value"))
