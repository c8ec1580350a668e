"""Embeddings, pages, conversations, the registered queries and the pipeline."""

import collections

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalogspark.llm import chat_quotes
from catalogspark.llm.chat_quotes import chat_lines, reply_order
from catalogspark.llm.embedding_dedup import links_between, near_duplicates
from catalogspark.llm.html_extract import extract, main_text
from catalogspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_links_are_all_found():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape), 3 * base])
    axes = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    i, j = links_between(x, x, axes, 0.93, True)
    n = np.linalg.norm(x, axis=1)
    want = {(a, b) for a, b in zip(*np.nonzero((x @ x.T) / np.outer(n, n) >= 0.93), strict=True) if a < b}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16)).astype("float32")
    rows = []
    for k in range(150):
        v = base[k % 30] + (0.1 * rng.normal(size=16) if k % 4 else 0)
        rows.append((1000 - k, [float(np.float32(x)) for x in v], k % 3))
    odd = [(1, None, 1), (2, [0.0] * 16, 1), (3, [float("nan")] * 16, 1), (4, [1.0, None] * 8, 1), (5, rows[0][1], None), (6, [], 1), (7, [1.0, 2.0], 1), (8, [2.0, 4.0], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd + rows[:2], "vec_id long, embedding array<float>, label int").withColumns({"n": F.lit(1), "key": F.lit(1), "tile": F.lit(1), "rep": F.lit(0)})
    got = near_duplicates(df, tile=16).collect()
    assert len(got) == len(rows) + len(odd) + 2
    links = {r[0]: set() for r in rows}
    for a, x, la in rows:
        for b, y, lb in rows:
            x_, y_ = np.array(x, float), np.array(y, float)
            if a != b and la == lb and x_ @ y_ >= 0.93 * np.linalg.norm(x_) * np.linalg.norm(y_):
                links[a].add(b)
    best = {a: a for a in links}
    for _ in rows:
        for a, near in links.items():
            best[a] = min([best[a], *(best[b] for b in near)])
    for r in got:
        if r.vec_id in links:
            assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), best[r.vec_id], best[r.vec_id] == r.vec_id)
        elif r.vec_id in (7, 8):
            assert (r.n_links, r.component_id) == (1, 7)
        else:
            assert (r.n_links, r.component_id) == (0, r.vec_id)
    assert near_duplicates(df.limit(0)).count() == 0


def test_extreme_magnitudes(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 1e200]), (4, [2e200, 2e200]), (5, [5e-324, 0.0]), (6, [1.7e308, 1.7e308]), (7, [1e200, 1e-200]), (8, [0.0, 3.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 5: (3, 1), 7: (3, 1), 3: (2, 3), 4: (2, 3), 6: (2, 3), 8: (0, 8)}


def test_hot_vector_and_blocks_of_tiles(spark, monkeypatch):
    from catalogspark.llm import embedding_dedup

    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 6))
    rows = [(k, (base[k % 12] + 0.2 * rng.normal(size=6) if k % 3 else base[0]).tolist(), 1) for k in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embedding_dedup, "HOT_ROWS", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK_TILES", 2)
    monkeypatch.setattr(embedding_dedup, "PARTNERS", 3)
    x = np.array([v for _, v, _ in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    got = near_duplicates(df, tile=8).collect()
    assert len(got) == 240 and all(r.n_links == near[r.vec_id].sum() for r in got)
    best = np.arange(240)
    for _ in range(240):
        best = np.minimum(best, np.where(near, best[None, :], 999).min(1))
    assert all(r.component_id == best[r.vec_id] for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; tail&nbsp;x</h1><p>One <b>bold</b> and
 two<p>Three<br>four &lt;b&gt; &copy<!-- no --><ul><li>i1<li>i2</ul><aside>side</aside><form><input>go</form><div class="ad">buy</div>
<div id="comments"><p>first!</p></div></article><footer>end</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Head & tail x\nOne bold and two\nThree four <b> ©\ni1\ni2"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("plain &lt; text") == "plain < text"
    assert main_text("<div>a</div><p>b" + "<p>c" * 1500).count("\n") == 1501
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("<article><p>x</article>y") == "x"


def test_style_tree_cuts_what_repeats(spark):
    rng = np.random.default_rng(3)
    page = lambda k: f"<body><div class='top'>Welcome to our site, please stay</div><div class='story'><p>{' '.join(map(str, rng.integers(0, 999, 40)))}</p></div></body>"
    rows = [(k, "http://a.com/x", page(k)) for k in range(20)] + [(50, None, None), (51, "http://b.com/", ""), (52, "http://b.com/", page(1))]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").withColumns({"host": F.lit("h"), "cut": F.lit(1), "text": F.lit("t")})
    got = extract(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.page_id < 20:
            assert "Welcome" not in r.text and len(r.text.split()) == 40 and r.n_chars == len(r.text)
        elif r.page_id == 52:
            assert r.text.startswith("Welcome")  # one page of a host tells nothing
        else:
            assert r.text == ""
    assert extract(df.limit(0)).count() == 0


def test_copies_are_not_boilerplate(spark):
    html = "<body><div class='wrap'><h1>Title</h1><div class='story'>Body text of the story</div></div></body>"
    df = spark.createDataFrame([(k, "http://a.com/x", html) for k in range(30)], "page_id long, url string, html string")
    assert {r.text for r in extract(df).collect()} == {"Title\nBody text of the story"}


def brute_replies(rows):
    """(conv, turn, role, text) to position, reply_to, own text by plain loops; rows without ties."""
    import re

    split = lambda s: [(len(m := re.match(r"^(?: {0,3}>)* ?", line)[0].strip()) and m.count(">"), line) for line in s.split("\n")]
    form = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()
    strip = lambda line: re.sub(r"^(?: {0,3}>)+ ?", "", line)
    out = {}
    own = {(c, t): "\n".join(line for level, line in split(s or "") if not level).strip() for c, t, _, s in rows}
    for c, t, _, s in rows:
        passages, last = [], 0
        for level, line in split(s or ""):
            if level and level == last:
                passages[-1][1].append(strip(line))
            elif level:
                passages.append((level, [strip(line)]))
            last = level
        linked = []
        for level, lines in passages:
            key = form("\n".join(lines))
            units = {u: {form(x) for x in [text, *re.split(r"\n\s*\n", text), *text.split("\n"), *re.split(r"[.!?]+\s+|\n+", text)]} for (d, u), text in own.items() if d == c and u < t}
            hits = [u for u, forms in units.items() if key and key in forms]
            if not hits:
                votes = {}
                for x in {form(x) for x in re.split(r"[.!?]+\s+|\n+", "\n".join(lines))} - {""}:
                    if at := [u for u, forms in units.items() if x in forms]:
                        votes[max(at)] = votes.get(max(at), 0) + len(x.split())
                hits = [max((n, u) for u, n in votes.items())[1]] if votes else []
            linked += [(level, max(hits))] if hits else []
        before = [u for d, u in own if d == c and u < t]
        first = [u for level, u in linked if level == 1] or [u for _, u in linked]
        out[c, t] = (max(first) if first else max(before, default=None), own[c, t], len(linked))
    places = {}
    for c in {c for c, _ in out}:
        def walk(t):
            places[c, t] = len([1 for d, _ in places if d == c])
            for u in sorted(u for d, u in out if d == c and out[d, u][0] == t):
                walk(u)

        for t in sorted(u for d, u in out if d == c and out[d, u][0] is None):
            walk(t)
    return {key: (places[key], *value) for key, value in out.items()}


def test_replies(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nSecond part: yes"), (1, 1, "assistant", "> hello THERE\nHi!"), (1, 2, "user", ">> Hello there.\n> Hi!\nBye"), (1, 5, "user", " > second part - yes\n>> unknown\nok"),
        (1, 7, "user", "> Bye\n\n> Hi!\nmulti"), (1, 8, "user", "> Second part: yes\n> not said by anyone\ntwo"),
        (1, 9, "user", "next"), (1, 10, "user", "> Bye\nagain"), (2, 0, "user", "> Hello there.\nother talk"), (2, 1, None, None), (2, 3, "user", ">\n> \nonly marks"),
    ]
    df = spark.createDataFrame(rows + [(None, 1, "user", "lost"), (3, None, "user", "> x")], "conv_id long, turn long, role string, text string").withColumns({"row": F.lit(1), "part": F.lit(1), "at": F.lit(1), "h": F.lit(1)})
    want = brute_replies(rows)
    got = reply_order(df.repartition(3)).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.conv_id in (1, 2):
            assert (r.position, r.reply_to, r.text, r.n_linked) == want[r.conv_id, r.turn]
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert values(con.execute(ORACLE_SQL["op8_chat_quotes"]).df()) == values(reply_order(df).toPandas())
    formatted = {(r.conv_id, r.turn): r.formatted for r in chat_lines(reply_order(df)).collect()}
    assert formatted[2, 0] == "<|user|>\nother talk" and formatted[2, 1] == "<|user|>\n"
    assert reply_order(df.limit(0)).count() == 0
    assert "Python" not in reply_order(df)._jdf.queryExecution().toString()


def test_hot_quotes_and_trees(spark):
    """One passage quoted all over one conversation, and replies to far messages, over several partitions."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(150):
        text = f"Point {k} is made. We all agree on this"
        if k % 3 == 0:
            text = "> We all agree on this\n" + text
        elif k % 7 == 0 and k:
            text = f"> Point {int(rng.integers(k))} is made.\n" + text
        rows.append((5, k, "user", text))
    want = brute_replies(rows)
    got = reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)).collect()
    assert {(r.conv_id, r.turn): (r.position, r.reply_to, r.text, r.n_linked) for r in got} == want


def test_one_hot_conversation(spark):
    rows = [(9, k // 2, "user", f"m{k}") for k in range(300)]
    got = reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert sorted(r.position for r in got) == list(range(300))
    assert all(r.reply_to == (r.turn - 1 if r.turn else None) for r in got)


def values(df):
    one = lambda v: None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6)
    return sorted((tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def test_pipeline(spark):
    import corpus_pipeline

    from catalogspark.llm.tables import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        seen.append(docs)
        if name != "packing":
            assert docs.columns == columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] > ids[1] >= ids[2] >= ids[3] >= ids[4] == ids[5]
    copies = collections.Counter(r.doc_id for r in seen[4].collect())
    assert max(copies.values()) <= corpus_pipeline.MOST_COPIES and len(copies) > 0.9 * len(ids[3])
    size = lambda d: d.agg(F.sum(F.length("text"))).first()[0]
    assert 0.85 < size(seen[4]) / size(seen[3]) < 1.15
    from test_text_operators import brute_components, brute_quality

    kept = {r.doc_id for r in seen[0].collect() if not fails(brute_quality(r.text))}
    assert ids[1] == kept
    rows = sorted((r.doc_id, r.text) for r in seen[2].collect())
    _, best = brute_components([t for _, t in rows], 5, 80)
    assert ids[3] == {rows[k][0] for k, b in enumerate(best) if b == k}


def test_columns_named_like_those_of_stages(spark, tmp_path):
    import corpus_pipeline

    named = ("n_words", "failures", "word_chars", "_key", "_row", "rate", "tokens", "p", "component_id", "score")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in named})
    docs.write.parquet(str(tmp_path / "d"))
    docs, columns = spark.read.parquet(str(tmp_path / "d")), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert docs.count() > 10 and all(r[c] == f"{c}{r.doc_id}" for r in docs.collect() for c in named)


def test_pipeline_goes_by_row(spark, tmp_path):
    """Rows without a doc_id or with another's are judged by their own texts."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    clean = lambda: " ".join(f"w{i}" for i in rng.integers(0, 300, 40))
    bad = lambda: clean() + " you idiot scum"
    copy = clean()
    rows = [(k, bad() if k % 2 else clean(), "en", "web") for k in range(200)]
    rows += [(None, bad(), "en", "web"), (None, clean(), "en", "odd"), (900, bad(), "en", "web"), (900, clean(), "en", "odd")]
    rows += [(None, copy, "en", "copy"), (None, copy, "en", "copy"), (901, copy, "en", "first"), (901, copy, "en", "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    spark.createDataFrame([(k, 1, k % 2) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()
    assert not [r for r in left if "idiot" in r.text] and sum(r.source == "odd" for r in left) == 2
    one = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).where(F.col("text") == copy).collect()
    assert [(r.doc_id, r.source) for r in one] == [(901, "first")]


def fails(m):
    n, chars, symbols, lines, dup, repeat = m
    return n < 10 or 100 * repeat > 20 * n or 10 * symbols > 3 * n or chars < 2 * n or chars > 25 * n or (dup >= 3 and 10 * dup > 3 * lines)


def test_pipeline_of_nothing_and_its_files(spark, tmp_path):
    """Empty tables give no rows, and a run leaves only what its result reads."""
    import os

    import corpus_pipeline

    from catalogspark.llm.tables import shared_dir

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    before = set(os.listdir(shared_dir(spark)))
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert {x.split("-")[0] for x in set(os.listdir(shared_dir(spark))) - before} <= {"pieces", "counts", "starts"}


def test_a_message_with_half_of_all_replies(spark):
    """Its replies are groups of their partitions; places equal a walk of the trees by plain loops."""
    rng = np.random.default_rng(6)
    rows, parent = [], {}
    for k in range(3000):
        row = (k % 6 << 33) + k // 6  # numbered in six partitions
        parent[row] = None if k < 6 and k % 6 == 0 else 0 if k % 2 else int(rng.choice(list(parent)))
        rows.append((1, row, parent[row]))
    rows += [(2, (7 << 33) + k, None if k == 0 else (7 << 33) + int(rng.integers(0, k))) for k in range(50)]
    parent |= {r: p for c, r, p in rows if c == 2}
    df = spark.createDataFrame(rows, "conv_id long, row long, parent long").repartition(5)
    groups = chat_quotes._siblings(df).groupBy("conv_id", F.coalesce("parent", F.lit(-1)), F.shiftright("row", 33)).count().agg(F.max("count")).first()[0]
    assert sum(p == 0 for p in parent.values()) > 1500 and groups < 600
    want, kids = {}, collections.defaultdict(list)
    for row, up in sorted(parent.items()):
        kids[up, row >> 33 == 7].append(row)
    for other in (False, True):
        open_, place = sorted(kids[None, other], reverse=True), 0
        while open_:
            row = open_.pop()
            want[row], place = place, place + 1
            open_ += sorted(kids[row, other], reverse=True)
    assert {r.row: r.place for r in chat_quotes._tree_places(df).collect()} == want
