import json
import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalogspark.functions.normalize import card_view, normalize_attrs, repair_double_encoded, validate_publish
from catalogspark.operators import benchreport, feed, index, latest, numbering, reads, search, writes
from catalogspark.plans.registry import QUERIES
from catalogspark.schema import ANONYMOUS, ENTRY_COLUMNS, ENTRY_SCHEMA, Requester, State
from catalogspark.sources import loaders
from catalogspark.sources.generate import generate_entries, seed_entries
from catalogspark.sources.catalog import StoredCatalog
from catalogspark.sources.runs import RunTable
from catalogspark.sources.storage import shared_path
from catalogspark.streaming import streams


@pytest.fixture(scope="module")
def bench(spark):
    return generate_entries(spark, 10_000).unionByName(latest.latest_revisions(seed_entries(spark))).cache()


def test_published_statistics(bench):
    got = index.index_stats(bench).first()
    assert tuple(got) == (10_005, 30_059, 15, 261_119, 1_084_496)


def test_published_hits(bench):
    suite = {"a": "(&(type=skill)(capability=summarize)(env=prod))", "b": "(tag=support)", "c": "(endpoint=*)", "d": "(tag=__never__)"}
    everyone = Requester(True, ("eng", "finance", "ops", "compliance"))
    hits = {r.filter_name: r.hits for r in search.filter_hits(bench, suite, everyone).collect()}
    assert hits == {"a": 2001, "b": 1667, "c": 10_001, "d": 0}
    classes = {r["class"]: r.entries for r in index.visibility_counts(bench).where("allowed_group is null").collect()}
    assert classes == {"public": 8502, "internal": 1001, "restricted": 502}


def test_predicates_equal_postings(bench):
    text = "(&(type=rag)(|(tag=pdf)(!(env=prod))))"
    a = search.search(bench, text, limit=50, view="ids").collect()
    b = index.search_on_postings(index.build_postings(bench), bench, text, limit=50, view="ids").collect()
    assert a == b and len(a) == 50


def test_top_k_without_sort_and_python(bench):
    plan = search.search(bench, "(tag=pdf)")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_seed_versions(spark):
    seed = seed_entries(spark)
    assert reads.get_latest(latest.latest_revisions(seed), "skill:acme:pdf-summarize").first().rev == 2
    shown = reads.list_versions(seed).where("id = 'skill:acme:pdf-summarize'").orderBy(F.desc("rev")).collect()
    assert [r.rev for r in shown] == [2, 1]
    assert reads.list_versions(seed).where("id like 'rag:%'").count() == 0


def test_pages_join_up(bench):
    found = bench.where(search.matches("(tag=code)"))
    paged = {r.id: r.page for r in search.paginate(found.select("id", "updated_at"), 100).collect()}
    cursor, page = None, 0
    for page in range(3):
        rows = search.search(bench, "(tag=code)", limit=100, cursor=cursor, view=None)
        assert all(paged[r.id] == page for r in rows.collect())
        cursor = tuple(search.next_cursor(rows, 100).first())
    with pytest.raises(ValueError):
        search.search(bench, cursor=cursor, sort="none")


def test_numbering_is_gapless(bench):
    got = sorted((r["rank"], r.updated_at, r.id) for r in numbering.update_rank(bench.select("id", "updated_at")).collect())
    assert [g[0] for g in got] == list(range(len(got)))
    assert [g[1:] for g in got] == sorted((g[1:] for g in got), reverse=True)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{"a":"x"}', {"a": ["x"]}), ('{"a":["x","y"]}', {"a": ["x", "y"]}), ('{"a":null}', {"a": []}), ('{"a":5,"b":true}', {"a": ["5"], "b": ["true"]}),
        ('{"a":"[1]"}', {"a": ["[1]"]}), ('{"a":["m",null,3]}', {"a": ["m", "null", "3"]}), ('{"a":[]}', {"a": []}), ("[1]", {}), ("oops", {}), (None, {}),
        (json.dumps('{"a":["x"]}'), {"a": ["x"]}), ("", {}),
    ],
)
def test_attrs(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(normalize_attrs(F.col("t")).alias("a")).first().a == expected


def test_repair(spark):
    df = spark.createDataFrame([(json.dumps('{"a":1}'),), ('"plain"',), (None,), ("bad{",), ('{"b":2}',)], "t string")
    assert [r.t for r in df.select(repair_double_encoded(F.col("t")).alias("t")).collect()] == ['{"a":1}', '"plain"', None, "bad{", '{"b":2}']


def test_card(spark):
    seed = seed_entries(spark).where("id like 'mcp:acme:code%'")
    assert set(card_view(seed).first().attrs) == {"capability", "tag", "visibility", "status"}


def test_validation(spark):
    df = spark.createDataFrame([("a", "t", "n", "x", None, '{"k":["v"]}', None), ("", "t", "n", "x", "d", "{}", None), ("b", "t", "n", "x", "d", '{"k":[1]}', None), ("c", "t", "n", "x", "d", "{}", "[1]")], "id string, type string, namespace string, name string, description string, attrs string, meta string")
    good, bad = validate_publish(df)
    assert [r.description for r in good.collect()] == [""]
    assert {r.id: r.reason for r in bad.collect()} == {"": "id", "b": "attrs", "c": "meta"}


def _one_at_a_time(stored, commands):
    """The history that commands make one by one: (id, rev, name, status, reason)."""
    now, out, refused = dict(stored), [], []
    for c in sorted(commands, key=lambda c: c["ord"]):
        old = now.get(c["id"])
        if c["op"] == "publish":
            new = [old[0] + 1 if old else 1, c["name"], "active", None]
        elif old is None:
            refused.append(c["ord"])
            continue
        else:
            new = [old[0] + 1, old[1], c["status"], c["reason"] if c["reason"] is not None else old[3]]
        now[c["id"]] = new
        out.append((c["id"], *new))
    return out, refused


def test_replay(spark):
    import random

    random.seed(3)
    commands = [{"ord": k, "op": random.choice(["publish", "set_status", "set_status"]), "id": f"i{random.randrange(12)}", "name": f"n{k}", "status": random.choice(["active", "deprecated", "disabled"]), "reason": random.choice([None, "r1", "r2"])} for k in range(150)]
    rows = [(c["ord"], c["op"], c["id"], "t", "n", c["name"], "", None, {"status": ["active"]}, None, None, c["status"], c["reason"]) for c in commands]
    df = spark.createDataFrame(rows, "ord long, op string, id string, type string, namespace string, name string, description string, version string, attrs map<string,array<string>>, manifest string, meta string, status string, reason string")
    stored = seed_entries(spark).limit(1).withColumn("id", F.lit("i1")).withColumn("name", F.lit("old")).withColumn("rev", F.lit(4))
    state = State(stored, stored, spark.createDataFrame([], "seq long, id string, rev int, changed_at timestamp, change_type string"))
    done, refused = writes.apply_commands(state, df, F.lit("2026-01-01").cast("timestamp"))
    want, out = _one_at_a_time({"i1": [4, "old", "active", None]}, commands)
    got = done.entries.where("not (id = 'i1' and rev = 4)").select("id", "rev", "name", F.col("attrs")["status"][0], F.get_json_object("meta", "$.reason")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sorted(r.ord for r in refused.collect()) == out
    assert [r.seq for r in done.changes.orderBy("seq").collect()] == list(range(1, len(want) + 1))
    assert done.latest.count() == len({w[0] for w in want} | {"i1"})


def test_replay_of_one_id_in_many_blocks(spark):
    import random

    random.seed(4)
    hot = lambda k: "hot" if k % 3 else f"i{random.randrange(40)}"
    commands = [{"ord": k, "op": random.choice(["set_status"] * 30 + ["publish"]), "id": hot(k), "name": f"n{k}", "status": random.choice(["active", "deprecated", "disabled"]), "reason": random.choice([None, None, "r1", "r2"])} for k in range(3000)]
    rows = [(c["ord"], c["op"], c["id"], "t", "n", c["name"], "", None, {"status": ["active"]}, None, None, c["status"], c["reason"]) for c in commands]
    df = spark.createDataFrame(rows, "ord long, op string, id string, type string, namespace string, name string, description string, version string, attrs map<string,array<string>>, manifest string, meta string, status string, reason string").repartition(8)
    stored = seed_entries(spark).limit(1).withColumns({"id": F.lit("i1"), "name": F.lit("old"), "rev": F.lit(4)})
    state = State(stored, stored, spark.createDataFrame([], "seq long, id string, rev int, changed_at timestamp, change_type string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert writes._blocks(df).where("id = 'hot'").select("_block").distinct().count() > 1
        done, refused = writes.apply_commands(state, df, F.lit("2026-01-01").cast("timestamp"))
        got = done.entries.where("not (id = 'i1' and rev = 4)").select("id", "rev", "name", F.col("attrs")["status"][0], F.get_json_object("meta", "$.reason")).collect()
        out = sorted(r.ord for r in refused.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, rejected = _one_at_a_time({"i1": [4, "old", "active", None]}, commands)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and out == rejected and rejected


def test_a_page_reads_as_far_as_it_reaches(spark, tmp_path):
    seed = seed_entries(spark).where("id like 'skill:%' and rev = 1")
    log = spark.range(1, 50_001).select(F.col("id").alias("seq"), F.when(F.col("id") % 40 == 0, "skill:acme:pdf-summarize").otherwise("gone").alias("id"), F.lit(1).alias("rev"), F.lit(None).cast("timestamp").alias("changed_at"), F.lit("publish").alias("change_type"))
    log.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    page = feed.changes_feed(log, seed, since=1000, limit=60)
    assert [r.seq for r in page.collect()] == list(range(1040, 1000 + 61 * 40, 40))
    assert "LessThanOrEqual(seq,4000)" in _plan(page)  # ranges of 1000 and 2000 numbers
    assert feed.next_since(log, seed, since=1000, limit=60).first().next_since == 3400
    assert feed.changes_feed(log, seed, since=49_000, limit=60).count() == 25 and feed.next_since(log, seed, since=49_000, limit=60).first().next_since == 50_000


def test_feed_passes_hidden_events(spark):
    seed = seed_entries(spark)
    log = spark.createDataFrame([(5, "rag:acme:sec-filings", 1, None, "publish"), (6, "gone", 1, None, "publish")], "seq long, id string, rev int, changed_at timestamp, change_type string")
    assert feed.changes_feed(log, seed).count() == 0
    assert feed.next_since(log, seed).first().next_since == 5
    assert feed.next_since(log, seed, since=9).first().next_since == 9


def test_jsonl_round_trip(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"id":"a","rev":1,"type":"t","namespace":"n","name":"x","attrs":{"tag":"one","env":["p"]},"meta":{"k":1}}\n\n')
    got, *more = loaders.read_entries_jsonl(spark, str(tmp_path / "e.jsonl")).collect()
    assert not more and got.attrs == {"tag": ["one"], "env": ["p"]} and json.loads(got.meta) == {"k": 1} and got.description == ""


@pytest.mark.parametrize("line", ["not json", '{"id":"a","rev":1', '{"id":"a","rev":"x"}'])
def test_a_line_that_is_no_entry_stops_the_job(spark, tmp_path, line):
    (tmp_path / "e.jsonl").write_text('{"id":"a","rev":1}\n' + line + "\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        loaders.read_entries_jsonl(spark, str(tmp_path / "e.jsonl")).collect()


def test_bench_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for k in (1, 2, 3):
        (tmp_path / "a" / f"run-{k}.json").write_text(json.dumps({"generated_at": f"2026-01-0{k}", "summaries": [{"target": "core", "endpoint": f"e{k}", "suite": "s", "p50_ms": k, "p95_ms": k, "p99_ms": k, "req_per_sec_avg": 10 * k}]}))
    (tmp_path / "run-bad.json").write_text('{"summaries": 3}')
    got = benchreport.bench_report(loaders.read_bench_runs(spark, str(tmp_path))).first()
    assert (got.dataset, got.scenario, got.samples, got.endpoint, got.p50_ms, got.req_per_sec_avg) == ("unknown", "default", 2, "e2", 2.5, 25.0)


def test_bench_runs_by_the_line(spark, tmp_path):
    run = lambda k: json.dumps({"generated_at": f"2026-01-0{k}", "dataset": "d", "summaries": [{"target": "core", "suite": f"s{k}"}, {"target": "core", "suite": f"t{k}"}]})
    (tmp_path / "a").mkdir()
    (tmp_path / "run-1.json").write_text(f"{run(1)}\n{run(2)}\n")
    (tmp_path / "a" / "run-2.json").write_text(f"not json\n\n{run(3)}\n" + '{"summaries": 3}\n')
    (tmp_path / "a" / "other.json").write_text(run(4))
    assert sorted(r.suite for r in loaders.read_bench_runs(spark, str(tmp_path), lines=True).collect()) == ["s1", "s2", "s3", "t1", "t2", "t3"]
    (tmp_path / "array").mkdir()
    (tmp_path / "array" / "run-1.json").write_text(f"[{run(1)},\n{run(2)}]")
    assert sorted(r.suite for r in loaders.read_bench_runs(spark, str(tmp_path / "array")).collect()) == ["s1", "s2", "t1", "t2"]


def test_bench_files_do_not_grow_with_runs(spark, tmp_path):
    events = spark.range(600).selectExpr("id AS event_id", "id % 300 AS user_id", "IF(id < 300, 'click', 'view') AS event_type")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["read_bench_runs"](spark, str(tmp_path))
    assert len(got.inputFiles()) <= 32
    assert got.groupBy("suite").count().sort("suite").collect() == [("click", 300), ("view", 300)]


def test_stream_order_does_not_matter(spark):
    seed = seed_entries(spark)
    log = [(1, "skill:acme:pdf-summarize", 2), (2, "skill:acme:pdf-summarize", 1), (3, "mcp:acme:code-search", 1), (4, "nothing", 1)]
    results = []
    for groups in ([log], [[c] for c in log], [[c] for c in reversed(log)]):
        path, out = shared_path(spark, "log"), shared_path(spark, "out")
        for g in groups:
            spark.createDataFrame([(s, i, r, None, "publish") for s, i, r in g], streams.CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        streams.stream_latest(streams.read_changes(spark, path, 1), seed, out, shared_path(spark, "state"), once=True).awaitTermination()
        results.append(sorted((r.id, r.rev) for r in streams.latest_table(spark, out).rows().collect()))
    assert results[0] == results[1] == results[2] == [("mcp:acme:code-search", 1), ("skill:acme:pdf-summarize", 2)]


def _run_files(path):
    """(run, rows) of the runs that are there."""
    root = Path(path) / "runs"
    return {p.name: sum(pq.read_metadata(f).num_rows for f in p.glob("*.parquet")) for p in root.iterdir()} if root.exists() else {}


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    entries = generate_entries(spark, 400)
    ids = [r.id for r in entries.select("id").collect()]
    table = RunTable(spark, str(tmp_path), ENTRY_SCHEMA, fanout=3)
    table.upsert(entries, 0)
    want = dict.fromkeys(ids, 1)
    written = 0
    for number in range(1, 14):
        touched = ids[number * 3 : number * 3 + 6]  # three of the batch before and three others
        new = entries.where(F.col("id").isin(*touched)).withColumn("rev", F.lit(number + 1))
        for _ in range(2):  # a batch that runs again does the same
            table.upsert(new, number)
            want |= dict.fromkeys(touched, number + 1)
            assert {r.id: r.rev for r in table.rows().collect()} == want
        assert len(table._read([r for r in table.runs() if r.run == f"{number}-0"]).collect()) in (0, 6)
        written += 6
    runs = table.runs()
    assert len(runs) <= 2 * 4 and max(r.level for r in runs) >= 2 and sum(r.rows for r in runs) < 400 + written
    assert {r.run for r in runs} <= _run_files(tmp_path).keys() and len(_run_files(tmp_path)) <= 2 * len(runs) + 3
    assert all(_run_files(tmp_path)[r.run] == r.rows for r in runs)
    assert len(list((tmp_path / "lists").glob("batch=*"))) <= 3
    assert [r.rev for r in table.row(ids[4]).collect()] == [want[ids[4]]] and table.row("nobody").count() == 0
    assert {r.id: r.rev for r in table.rows(13).collect()} != want  # as it was before the last batch


def test_later_batches_win_among_equal_revisions(spark, tmp_path):
    seed = seed_entries(spark).limit(1)
    table = RunTable(spark, str(tmp_path), ENTRY_SCHEMA, fanout=2)
    assert table.rows().count() == 0
    for number, (rev, name) in enumerate([(3, "a"), (3, "b"), (2, "c"), (3, "d"), (1, "e")]):
        table.upsert(seed.withColumns({"rev": F.lit(rev), "name": F.lit(name)}), number)
        assert [r.name for r in table.rows().collect()] == [["a", "b", "b", "d", "d"][number]]


def test_postings_of_the_newest_revision_alone(spark, tmp_path):
    seed = seed_entries(spark)
    table = streams.postings_table(spark, str(tmp_path))
    for number, rev in enumerate((1, 2, 1)):
        table.upsert(index.tokens(seed.where(F.col("rev") == rev), "rev").select("id", "rev", *index.TOKEN), number)
        table.fanout = 2
    got = sorted(map(tuple, table.rows().select("id", *index.TOKEN).collect()), key=str)
    assert got == sorted(map(tuple, index.tokens(latest.latest_revisions(seed)).select("id", *index.TOKEN).collect()), key=str)


def test_entries_are_bucketed_by_their_number(spark, tmp_path):
    got = streams.write_by_bucket(generate_entries(spark, 100), str(tmp_path / "e"), bucket_rows=10)
    assert got.select("buckets").distinct().collect()[0][0] == 10 and got.count() == 100
    assert 1 < got.select("bucket").distinct().count() <= 10
    log = spark.createDataFrame([("skill:bench:000000001", 1), ("skill:bench:000000001", 2), ("nobody", 1)], "id string, rev int")
    assert [r.rev for r in streams._Revisions(got).named(log).collect()] == [1]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_and_columns_reach_the_scan(spark, tmp_path):
    generate_entries(spark, 50).write.parquet(str(tmp_path / "e"))
    newest = latest.latest_revisions(spark.read.parquet(str(tmp_path / "e")))
    plan = _plan(reads.get_latest(newest, "skill:bench:000000001"))
    scans = re.findall(r"FileScan parquet.*", plan)
    assert len(scans) == 2 and all("EqualTo(id,skill:bench:000000001)" in x for x in scans)
    hits = re.findall(r"FileScan parquet.*ReadSchema: (\S+)", _plan(search.filter_hits(newest, {"a": "(tag=pdf)"})))
    assert len(hits) == 2 and not any("description" in x or "manifest" in x or "name" in x for x in hits)


def test_change_log_is_numbered_when_asked_for(spark, monkeypatch):
    stored = seed_entries(spark)
    batch = stored.select(F.lit(1).alias("ord"), "id", "type", "namespace", "name", "description", "version", "attrs", "manifest", "meta").limit(1)
    asked = []
    monkeypatch.setattr(writes, "assign_seq", lambda changes, rows, real=writes.assign_seq: asked.append(1) or real(changes, rows))
    state = State(stored, latest.latest_revisions(stored), spark.createDataFrame([(7, "x", 1, None, "publish")], streams.CHANGE_SCHEMA))
    done = writes.publish_batch(state, batch, F.lit("2026-01-01").cast("timestamp"))
    assert done.entries.count() == stored.count() + 1 and not asked
    assert sorted(r.seq for r in done.changes.collect()) == [7, 8] and asked == [1]


def test_requests_keep_their_order(spark):
    newest = latest.latest_revisions(seed_entries(spark))
    asked = spark.createDataFrame([(3, "mcp:acme:code-search"), (2, "skill:acme:pdf-summarize"), (5, "nothing"), (1, "skill:acme:pdf-summarize"), (4, "mcp:acme:code-search")], "ord long, id string")
    assert [r.ord for r in reads.batch_get(newest, asked).collect()] == [1, 2]
    assert reads.batch_get_omitted(newest, asked).first().omitted == 2
    assert [r.ord for r in reads.batch_get(newest, asked, Requester(True, ("eng",))).collect()] == [1, 2, 3, 4]


def test_numbers_of_equal_and_null_keys(spark, tmp_path):
    rows = spark.createDataFrame([(2, "a", "x"), (None, "b", "y"), (2, "a", "z"), (1, None, "w"), (2, None, "v")], "k int, s string, wide string")
    got = sorted((r.n, r.k, r.s) for r in numbering.number_rows(rows, ["-k", "s"], "n").collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 4] and [g[1:] for g in got] == [(2, None), (2, "a"), (2, "a"), (1, None), (None, "b")]
    assert {r.wide for r in numbering.number_rows(rows, ["-k", "s"], "n").collect()} == set("vwxyz")
    only = numbering.ranks(rows, ["-k", "s"])
    assert only.columns == ["k", "s", "rank"] and sorted(r["rank"] for r in only.collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("text", ["(tag=pdf)", "(!(tag=pdf))", "(&(type=rag)(|(tag=pdf)(!(env=prod))))", "(!(&(endpoint=*)(!(capability=embed))))", "(tag=__never__)", "(!(tag=__never__))", "(&(rev=01)(name=*)(!(id=mcp:acme:finance-tools)))"])
def test_bitmaps_equal_predicates(spark, bench, text):
    more = bench.unionByName(generate_entries(spark, 45_000).where("id > 'skill' and substring(id, -5) >= '10000'"))  # more than a bucket
    numbered = index.number_documents(more).cache()
    found = index.eval_on_packed(index.pack_postings(numbered), index.pack_universe(numbered), text)
    assert sorted(r.doc for r in found.collect()) == sorted(r.doc for r in numbered.where(search.filter_expr(text)).select("doc").collect())
    numbered.unpersist()


def test_parts_are_as_large_as_what_they_hold(spark, bench):
    from catalogspark.operators import entitlements

    asks = spark.range(2000).select(F.col("id").alias("subject"), (F.col("id") % 4 != 0).alias("authenticated"), F.when(F.col("id") % 2 == 0, F.array(F.lit("eng"), F.lit("ops"))).otherwise(F.array(F.lit("ops"), F.lit("eng"), F.lit("eng"))).alias("groups"))
    asks = asks.unionByName(asks.where("subject = 3").withColumn("groups", F.array(F.lit("finance"))))  # a subject of two rows sees what either does
    members, parts = entitlements.entitlement_parts(bench, asks)
    assert {r.part for r in members.select("part").distinct().collect()} == {"public", "internal", "groups:eng,ops", "groups:eng,finance,ops"}
    assert parts.count() < 2 * 10_005 and parts.count() == parts.distinct().count()
    counts = {r.subject: r.n for r in entitlements.expand(members.where("subject < 4"), parts).groupBy("subject").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).where("n = d").collect()}
    seen = lambda *groups: bench.where(search.visible_to(Requester(True, groups))).count()
    assert counts == {0: bench.where(search.visible_to(ANONYMOUS)).count(), 1: seen("eng", "ops"), 2: seen("eng", "ops"), 3: seen("eng", "ops", "finance")}


def test_pairs_are_dealt_to_tasks_and_repeat_in_files(spark, tmp_path):
    from catalogspark.operators import entitlements

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    subjects = spark.range(9000).select(F.when(F.col("id") > 0, F.col("id")).alias("subject"), F.lit("public").alias("part"))
    parts = spark.range(1000).select(F.lit("public").alias("part"), F.concat(F.lit("entry:"), "id").alias("id"))
    members = subjects.unionByName(spark.createDataFrame([(1, "empty")], "subject long, part string"))
    entitlements.expand(members, parts).withColumn("task", F.spark_partition_id()).write.parquet(str(tmp_path / "pairs"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    got = pairs.agg(F.count("*"), F.countDistinct("subject", "id"), F.count_if(F.col("subject").isNull()), F.countDistinct("task")).first()
    assert tuple(got)[:3] == (9_000_000, 8_999_000, 1000) and got[3] > 1
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 9_000_000 * 0.3


def test_pairs_are_made_a_list_at_a_time(spark, monkeypatch):
    from catalogspark.operators import entitlements

    monkeypatch.setattr(entitlements, "IDS_LISTED", 4)
    monkeypatch.setattr(entitlements, "SUBJECTS_LISTED", 8)
    part = lambda n: F.when(F.col("id") < n, "public").otherwise("internal").alias("part")
    members = spark.range(200).select(F.when(F.col("id") > 0, F.col("id")).alias("subject"), part(129))
    parts = spark.range(60).select(part(59), F.concat(F.lit("entry:"), "id").alias("id"))
    pairs = entitlements.expand(members, parts)
    # where lists of both sides came out behind the join, all pairs of two lists were in memory at once
    assert pairs._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0].count("Generate explode") == 1
    got = pairs.agg(F.count("*"), F.countDistinct(F.coalesce("subject", F.lit(-1)), "id"), F.count_if(F.col("subject").isNull())).first()
    assert tuple(got) == (129 * 59 + 71, 129 * 59 + 71, 59)
    lists = [len(r.subject) for r in entitlements._listed(members, "subject", 8).collect()]
    assert max(lists) == 8 and min(lists) > 0 and sum(lists) == 200


def test_rows_of_a_part_never_meet_in_one_task(spark):
    from catalogspark.operators import entitlements

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    parts = spark.range(3).select(F.lit("public").alias("part"), F.concat(F.lit("entry:"), "id").alias("id"))
    pairs = entitlements.expand(spark.range(2).select(F.col("id").alias("subject"), F.lit("public").alias("part")), parts)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 6
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1 and "SortMergeJoin [key" in plan  # and none by part alone


def test_unpacked_bitmaps(spark):
    seed = latest.latest_revisions(seed_entries(spark))
    got = {tuple(r) for r in index.unpack_postings(index.packed_postings(seed)).collect()}
    doc = {r.id: k for k, r in enumerate(seed.orderBy("id").collect())}
    assert got == {(r.kind, r.scope, r.key, r.value, doc[r.id]) for r in index.tokens(seed).collect()}


def test_bitmaps_are_as_large_as_what_they_hold(spark):
    docs = [0, 1, 62, 63, 64, 32_767, 32_768, 32_769, 65_535, 65_536, 5_000_000_063]
    numbered = spark.createDataFrame([(f"rag:a:{d}", d) for d in docs], "id string, doc long")
    numbered = numbered.selectExpr("*", "'rag' AS type", "'x' AS name", "'a' AS namespace", "'' AS version", "1 AS rev", "map('tag', array(id, 'all')) AS attrs")
    packed, rows = index.pack_postings(numbered), index.tokens(numbered, "doc").drop("id")
    assert sorted(map(tuple, index.unpack_postings(packed).collect()), key=str) == sorted(((*r[1:], r.doc) for r in rows.collect()), key=str)
    sizes = {(r.value, r.bucket): (r.n, r.words) for r in packed.where("scope = 'attr' and kind = 'eq'").withColumn("words", F.size("bitmap")).collect()}
    assert {sizes[(f"rag:a:{d}", d // 32_768)] for d in docs} == {(1, 1)}  # whole bitmaps of a bucket have 512 words
    assert {b: x for (v, b), x in sizes.items() if v == "all"} == {0: (6, 3), 1: (3, 2), 2: (1, 1), 5_000_000_063 // 32_768: (1, 1)}
    assert sorted(map(tuple, index.pack_universe(numbered).select("bucket", "n").collect())) == [(0, 6), (1, 3), (2, 1), (5_000_000_063 // 32_768, 1)]


def test_tables_keep_their_columns(spark):
    assert seed_entries(spark).columns == ENTRY_COLUMNS and ANONYMOUS.groups == ()


def test_a_batch_adds_tokens_up_before_it_shuffles_them(spark, bench):
    changed = bench.where("id > 'skill'").withColumns({"rev": F.col("rev") + 1, "name": F.concat("name", F.lit("!"))})
    delta = index.counts_delta(bench, changed)
    many = index.postings_delta(bench, changed).groupBy(*index.TOKEN).agg(F.sum(F.when(F.col("change") == "added", 1).otherwise(-1)).alias("d")).where("d <> 0")
    assert sorted(map(tuple, delta.collect()), key=str) == sorted(map(tuple, many.collect()), key=str) != []
    plan = delta._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#\d+, kind", plan)
    log = numbering.assign_seq(spark.createDataFrame([(5,)], "seq long"), bench.select(F.col("id").alias("ord"), "rev"))
    assert "Join" not in log._jdf.queryExecution().optimizedPlan().toString().replace("Join Inner\n", "").replace("Join Cross", "") or log.count() == bench.count()


def test_a_stored_catalog_replays_and_counts(spark, tmp_path):
    import random

    random.seed(8)
    seed = latest.latest_revisions(seed_entries(spark))
    catalog = StoredCatalog(spark, str(tmp_path))
    assert catalog.entries().count() == catalog.changes().count() == 0 and tuple(catalog.stats().first()) == (0, 0, 0, 0, 0)
    catalog.load(seed)
    known = [r.id for r in seed.select("id").collect()]
    commands = [{"ord": k, "op": random.choice(["publish", "set_status"]), "id": random.choice([*known, "new:a", "new:b"]), "name": f"n{k}", "status": random.choice(["active", "disabled"]), "reason": random.choice([None, "r1"])} for k in range(60)]
    rows = [(c["ord"], c["op"], c["id"], "t", "n", c["name"], "", None, {"status": ["active"], "tag": [f"t{c['ord'] % 5}"]}, None, None, c["status"], c["reason"]) for c in commands]
    df = spark.createDataFrame(rows, "ord long, op string, id string, type string, namespace string, name string, description string, version string, attrs map<string,array<string>>, manifest string, meta string, status string, reason string")
    refused = []
    for batch, (a, b) in enumerate([(0, 20), (20, 21), (20, 45), (45, 60)], 1):
        number = batch if batch < 3 else batch - 1  # the third runs as the second again, with other rows
        lost = catalog.apply(df.where(f"ord >= {a} and ord < {b}"), F.lit("2026-01-01").cast("timestamp"), number)
        refused = [o for o in refused if o < a] + [r.ord for r in lost.collect()]
        now = catalog.latest.rows()
        assert tuple(catalog.stats().first()) == tuple(index.index_stats(now).first())
        counts = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert counts(catalog.token_counts()) == counts(index.token_counts(now))
    want, out = _one_at_a_time({r.id: [r.rev, r.name, "active", None] for r in seed.collect()}, commands)
    got = {(r.id, r.rev, r.name) for r in catalog.entries().collect()} - {(r.id, r.rev, r.name) for r in seed.collect()}
    assert got == {w[:3] for w in want} and sorted(refused) == out
    assert sorted(r.seq for r in catalog.changes().collect()) == list(range(1, len(known) + len(want) + 1))
    assert {r.id: r.rev for r in catalog.latest.rows().collect()} == {w[0]: w[1] for w in [(r.id, r.rev) for r in seed.collect()] + [w[:2] for w in want]}
