"""Small cases of the text operators, each held against plain Python."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogspark.llm import graph, kernels, license_scan, mixing, packing, quality, toxicity
from catalogspark.llm.ngram_jaccard import jaccard_components
from catalogspark.llm.queries import word_tokenizer_path
from catalogspark.llm.url_filter import Rule, judge_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASH = ["n", "h", "id", "tokens", "p", "rate", "_t", "_w", "_row", "f", "row", "a", "b", "failures", "n_words", "host", "cut", "score", "last", "class_id"]

BASE = " ".join(f"word{k}" for k in range(60))
TEXTS = [
    BASE, BASE.upper(), BASE + " tail", BASE.replace("word30", "other"), "x " * 500, "", None, "one two three", "one two  three", "a\nb\nb\nb\nb",
    "é " + BASE, "same line here now\n" * 6, "# $ % & | < > *", "very " * 3000 + "long", "<|endoftext|> isn't Ünïcode 中文 ½ it's",
]


def docs(spark, texts, clash=False):
    df = spark.createDataFrame([(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None) for k, t in enumerate(texts)], DOCS)
    df = df.unionByName(df.where("doc_id = 1")).unionByName(spark.createDataFrame([(None, "no id", None, None, None)], DOCS))
    return df.withColumns({c: F.lit(1) for c in CLASH}) if clash else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def shingles(text, n):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and 100 * len(a & b) >= percent * len(a | b)]
    best, old = list(range(len(texts))), None
    while best != old:
        old = list(best)
        for i, j in links:
            best[i] = best[j] = min(best[i], best[j])
    return sets, best


def test_words_and_hashes():
    for gaps in (kernels.SPACE, kernels.NOT_ALNUM):
        import pyarrow as pa

        texts = ["Ab cd", None, "", " ab\tCD ", "cd"]
        (_, _, data, offsets), *rest = kernels.text_chunks(pa.array(texts))
        w = kernels.Words(data, offsets, gaps)
        assert not rest and np.diff(w.first).tolist() == [2, 0, 0, 2, 1]
        assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] == w.hash[4] != w.hash[0]


def test_chunks_cover_long_texts():
    import pyarrow as pa

    texts = ["x" * 50, "", "y" * 500, "z"] * 3
    assert [(a, b) for a, b, _, _ in kernels.text_chunks(pa.array(texts), 100)][0][0] == 0
    assert sum(b - a for a, b, _, _ in kernels.text_chunks(pa.array(texts), 100)) == 12


@pytest.mark.parametrize("clash", [False, True])
def test_jaccard(spark, clash):
    got = jaccard_components(docs(spark, TEXTS, clash), 4, 85).collect()
    sets, best = brute_components(TEXTS, 4, 85)
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.class_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), best[r.doc_id])
    assert jaccard_components(empty(spark), 4, 85).count() == 0


def test_jaccard_families(spark):
    import random

    random.seed(5)
    base = [f"w{random.randrange(400)}" for _ in range(120)]
    texts = []
    for k in range(90):
        own = list(base)
        for _ in range(random.randrange(9)):
            own[random.randrange(len(own))] = f"edit{random.randrange(60)}"
        texts.append(" ".join(own[: random.randrange(95, 121)]))
    got = {r.doc_id: r.component_id for r in jaccard_components(docs(spark, texts), 5, 80).where("doc_id is not null").collect()}
    assert [got[k] for k in range(90)] == brute_components(texts, 5, 80)[1]


_HOT = {"HOT_RUN": 3, "DEALT": 4, "HOT_CLASS": 2}


@pytest.mark.parametrize(
    ("limits", "links"), [({}, True), (_HOT, False), (_HOT, True), ({"COMMON_LIMIT": 5, "COMMON_LEAST": 2, "BROADCAST_IDS": 0}, False), ({"PART_SHINGLES": 1, "OPEN_BLOCK": 2}, False)]
)
def test_jaccard_limits_change_no_result(spark, monkeypatch, limits, links):
    import random

    from catalogspark.llm import ngram_jaccard

    for name, value in limits.items():
        monkeypatch.setattr(ngram_jaccard, name, value)
    random.seed(6)
    base, texts = [f"w{random.randrange(300)}" for _ in range(60)], []
    for k in range(60):
        own = list(base) if k % 3 else [f"w{random.randrange(300)}" for _ in range(50)] + base[:9]
        for _ in range(k % 5):
            own[random.randrange(len(own))] = f"edit{random.randrange(30)}"
        texts.append(" ".join(own))
    texts += [texts[0]] * 4 + ["", ""]
    sets, best = brute_components(texts, 4, 80)
    near = [{j for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 80 * len(a | b)} for i, a in enumerate(sets)]
    got = {r.doc_id: r for r in jaccard_components(docs(spark, texts), 4, 80, links=links).where("doc_id is not null").collect()}
    assert [got[k].component_id for k in range(len(texts))] == best
    if links:
        assert [got[k].n_links for k in range(len(texts))] == [len(x) for x in near]


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(300, 300), (400, 399), (400, 399)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 399: 399, 400: 399}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_quality(text):
    w, text = words(text), text or ""
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [s for s in text.split("\n") if words(s)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("clash", [False, True])
def test_quality(spark, clash):
    source = docs(spark, TEXTS, clash)
    book = quality.ledger(source)
    got = book.where("doc_id is not null").collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert tuple(r[m] for m in quality.MEASURES) == brute_quality(TEXTS[r.doc_id])
    assert quality.ledger(empty(spark)).count() == 0
    kept = book.where(quality.passes("v1")).count()
    lost = {r.rule: r for r in quality.ablations(book, "v1").collect()}
    for rule in quality.POLICIES["v1"]:
        without = [x for x in quality.POLICIES["v1"] if x != rule]
        assert lost[rule].kept_without == book.where(quality.passes(without)).count() == kept + lost[rule].alone
    plan = book.select("failures")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_packing(spark):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(word_tokenizer_path())
    reader.encode_special_tokens = True
    rows = packing.pack(docs(spark, TEXTS, True).repartition(3), word_tokenizer_path()).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for k, text in [*enumerate(TEXTS), (None, "no id")]:
        ids = np.array(reader.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        copies = 2 if k == 1 else 1
        assert sum(p[1] for p in pieces[k]) == copies * len(ids)
        for start, length, crc, total in pieces[k]:
            assert total == len(ids) and zlib.crc32(ids[start : start + length].tobytes()) == crc
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length, r.window))
    for own in sequences.values():
        at = 0
        for offset, length, window in sorted(own):
            assert offset == at
            at += length
        assert at == window <= 4096 and window & (window - 1) == 0
    assert packing.pack(empty(spark), word_tokenizer_path()).count() == 0
    groups = collections.Counter()
    for r in {(r.sequence_id, r.step_group, r.window) for r in rows}:
        groups[r[1]] += r[2]
    assert max(groups.values()) <= 65536


def test_step_groups_are_balanced(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(["word"] * int(n)) for n in np.concatenate([rng.integers(1, 700, 900), rng.integers(1000, 9000, 60)])]
    for parts in (1, 7):
        rows = packing.pack(docs(spark, texts).repartition(parts), word_tokenizer_path(), group_tokens=8192).collect()
        groups, windows, pieces = collections.Counter(), collections.defaultdict(set), collections.Counter(r.doc_id for r in rows)
        for sequence, group, window in {(r.sequence_id, r.step_group, r.window) for r in rows}:
            groups[group] += window
            windows[group].add(window)
        assert sorted(groups) == list(range(len(groups))) and all(groups[g] == 8192 for g in list(range(len(groups)))[:-1]) and groups[len(groups) - 1] <= 8192
        assert sum(len(w) > 1 for w in windows.values()) <= 13
        long = sum(-(-(len(t.split()) + 1) // 4096) for t in texts if len(t.split()) >= 4096)
        assert len(rows) - len(texts) - 2 < long + 0.25 * len(texts)  # few short documents are cut
    with pytest.raises(ValueError):
        packing.pack(docs(spark, texts), word_tokenizer_path(), group_tokens=5000)


def test_fast_letters_equal_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(word_tokenizer_path())
    reader.encode_special_tokens = True
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyzéèçüßñAÉ")
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 16))) + rng.choice(["", ",", ".", "'s", "...", "'", "9"]) for _ in range(60)) for _ in range(60)]
    texts += ["İstanbul ŞŒ ﬁ ª é  x\x1cy", "the the\tthe\r\nthe", "it's we'll'd <|startoftext|>", "ΑΣ ας"]
    for text, ids in zip(texts, packing.WordTokenizer(word_tokenizer_path())(pa.array(texts)), strict=True):
        assert ids.tolist() == reader.encode(text, add_special_tokens=False).ids + [2]


def toxic_docs(spark):
    rng = np.random.default_rng(0)
    plain = [f"plain{k}" for k in range(200)]
    rows = []
    for k in range(400):
        sentences = [" ".join(rng.choice(plain, 8)) for _ in range(6)]
        bad = k % 4 == 0
        if bad:
            sentences[int(rng.integers(6))] += " vile" + str(rng.choice(["ing", "ness", "ly"]))
        rows.append((k, ". ".join(sentences), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_docs(spark)
    source = spark.createDataFrame([(k, t, None, None, None) for k, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(k, None, y) for k, _, y in rows] + [(0, 1, None), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(source, labels, located=True).collect()}
    held = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in set(held)) for k, *_ in rows)
    assert np.mean([got[k].predicted == rows[k][2] for k in held]) >= 0.95
    for k, text, y in rows:
        for span in got[k].spans if y and got[k].predicted else []:
            assert "vile" in text[span.begin : span.end]


def brute_noisy_or(model, text):
    """Sentences of a text with their scores by plain loops over words, and the noisy-or of all."""
    import pyarrow as pa

    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    none, sentences = 1.0, []
    for piece in re.split(r"(?<=[\n!.?])", text):
        own = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", piece)
        if own:
            (_, _, data, offsets), *_ = kernels.text_chunks(pa.array([" ".join(own)]))
            chunk = kernels.Words(data, offsets, kernels.NOT_ALNUM)
            hashes = set(chunk.hash.tolist()).union(*(chunk.prefix_hash(n)[1].tolist() for n in toxicity.PREFIXES))
            p = 1 / (1 + np.exp(-model.bias - sum(weight.get(h, 0.0) for h in hashes)))
            none *= 1 - p
            at = text.index(piece)
            begin = at + piece.index(own[0])
            sentences.append((begin, at + piece.rindex(own[-1]) + len(own[-1]), p))
    return 1 - none, sentences


def test_noisy_or_equals_plain_loops(spark):
    rows = [(k, f"é{k} " + t + "!", y) for k, t, y in toxic_docs(spark)]
    source = spark.createDataFrame([(k, t, None, None, None) for k, t, _ in rows], DOCS)
    model = toxicity.train(source, spark.createDataFrame([(k, None, y) for k, _, y in rows], "doc_id long, quality int, toxic int"))
    for r in toxicity.score(source, model, located=True).collect():
        want, sentences = brute_noisy_or(model, rows[r.doc_id][1])
        assert abs(r.score - want) < 1e-9
        assert [(s.begin, s.end) for s in r.spans] == [(a, b) for a, b, p in sentences if p >= 0.5]


def test_gradient_equals_differences():
    rng = np.random.default_rng(6)
    labels, bags = np.array([1, 0, 1]), np.array([0, 0, 1, 2, 2])
    sentences, words = np.array([0, 0, 1, 2, 3, 4]), np.array([0, 2, 1, 2, 0, 1])
    w = rng.normal(size=4)

    def loss(w):
        z = np.bincount(sentences, w[words], 5) + w[-1]
        none = np.exp(np.bincount(bags, -np.logaddexp(0, z), 3))
        return -np.sum(np.where(labels > 0, np.log(1 - none), np.log(none)))

    steps = [(loss(w + 1e-6 * e) - loss(w - 1e-6 * e)) / 2e-6 for e in np.eye(4)]
    assert np.allclose(toxicity.gradient(labels, bags, sentences, words, w), steps, atol=1e-6)


def test_one_doc_id_with_two_texts_trains_the_same_model(spark):
    rows = [(k, t, y) for k, t, y in toxic_docs(spark)] + [(3, "another text " * 9, 0)]
    labels = spark.createDataFrame([(k, None, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    models = [toxicity.train(spark.createDataFrame([(k, t, None, None, None) for k, t, _ in order], DOCS).repartition(n), labels) for order, n in ((rows, 3), (rows[::-1], 5))]
    assert (models[0].words == models[1].words).all() and np.allclose(models[0].weights, models[1].weights, atol=1e-9)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, TEXTS, True), labels).collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert toxicity.toxicity(empty(spark), labels).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "w " * int(rng.integers(5, 60)) + ("$ " * 30 if k % 5 == 0 else ""), "en", f"s{k % 3}", None) for k in range(600)]
    source = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 5 != 0), int(k % 3 == 1)) for k in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    rated = mixing.mixing_rates(source, labels).collect()
    total = {d: sum(r.rate * r.tokens * r.p[k] for r in rated) for k, d in enumerate(mixing.DOMAINS)}
    for d, share in mixing.TARGETS.items():
        assert abs(total[d] / sum(total.values()) - share) < 0.01
    assert all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in rated)
    once, again = (sorted(r.doc_id for r in mixing.mixed(source, labels)[0].collect()) for _ in range(2))
    assert once == again
    copies, rates = collections.Counter(once), {r.doc_id: r.rate for r in rated}
    assert all(abs(copies[k] - rates[k]) < 1 for k in rates)


def test_mixing_reads_words(spark):
    """Posteriors of documents without labels, whose domains only words tell apart."""
    rng = np.random.default_rng(5)
    common, bad, spam = [f"word{i}" for i in range(400)], ["scum", "idiot", "trash", "moron"], ["click", "buy", "cheap", "deal"]
    rows, kind = [], []
    for k in range(1500):
        words = list(rng.choice(common, 40))
        kind.append(2 if k % 5 == 1 else 1 if k % 5 == 2 else 0)
        for place in rng.choice(40, 3, replace=False) if kind[-1] else ():
            words[place] = str(rng.choice(bad if kind[-1] == 2 else spam)) + "!"
        rows.append((k, "  ".join(words) + "\n\n ", "en", "web", None))
    source = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(kind[k] != 1), int(kind[k] == 2)) for k in range(1000)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mixing_rates(source, labels).collect()}
    assert {r.tokens for r in got.values()} == {40}
    held = [(kind[k], got[k].p) for k in range(1000, 1500)]
    for d in range(3):
        assert np.mean([np.argmax(p) == d for k, p in held if k == d]) > 0.95
        assert np.mean([p[d] for k, p in held if k == d]) > 0.9 and np.mean([p[d] for k, p in held if k != d]) < 0.05


def brute_mixing(held, labels, domains):
    """Posteriors by plain loops from rows (doc_id, words, f, tokens) and labels (doc_id, domain)."""
    import math

    by_doc = collections.defaultdict(list)
    for k, d in labels:
        if k is not None and d in domains:
            by_doc[k].append(d)
    seen = [(r, by_doc[r.doc_id]) for r in held if r.doc_id in by_doc]
    of = {d: sum(ds.count(d) for _, ds in seen) for d in domains}
    total = sum(of.values())
    counts = collections.defaultdict(lambda: [0] * len(domains))
    for r, ds in seen:
        for w in r.words:
            for k, d in enumerate(domains):
                counts[w][k] += ds.count(d)
    chosen = {}
    for w, n in counts.items():
        df = sum(n)
        if df >= mixing.MIN_DOCS:
            found = []
            for k, d in enumerate(domains):
                part, share = of[d] / total, df / total
                spread = math.sqrt(df * part * (1 - part) * (1 - share))
                found.append(((n[k] - df * part) / spread if spread > 0 else 0.0, k, math.log((n[k] + 2 * share) / (of[d] + 2.0) / share)))
            far, k, gain = max(found)
            if far >= mixing.MIN_DEVIATION and gain > 0:
                chosen[w] = (k, gain)
    beside = collections.defaultdict(list)
    for r, _ in seen:
        per = collections.Counter(chosen[w][0] for w in r.words if w in chosen)
        for w in r.words:
            if w in chosen:
                beside[w].append(per[chosen[w][0]])
    evidence = {w: (k, g / (sum(beside[w]) / len(beside[w]))) for w, (k, g) in chosen.items()}

    def bins(r):
        e = [sum(evidence[w][1] for w in r.words if evidence.get(w, (None,))[0] == k) for k in range(len(domains))]
        return [*r.f, *(f"says {d}={1 + min(8, math.floor(4 * x)) if x > 0 else 0}" for d, x in zip(domains, e, strict=True))]

    table = collections.defaultdict(lambda: [0] * len(domains))
    for r, ds in seen:
        for b in bins(r):
            for k, d in enumerate(domains):
                table[b][k] += ds.count(d)
    kinds = collections.defaultdict(list)
    for b, n in table.items():
        kinds[b.split("=")[0]].append(n)
    out = []
    for r in held:
        z = [math.log(of[d] + 1.0) for d in domains]
        for b in bins(r):
            rows = kinds[b.split("=")[0]]
            for k in range(len(domains)):
                z[k] += math.log((table[b][k] if b in table else 0) + 1.0) - math.log(sum(n[k] for n in rows) + len(rows) + 1.0)
        odds = [math.exp(x - max(z)) for x in z]
        out.append([o / sum(odds) for o in odds])
    # what labelled tokens say of each cell of the grid
    cell = lambda p: tuple(math.floor(x * mixing.GRID + 0.5) for x in p)
    marked = [(r.tokens, d, cell(p)) for r, p in zip(held, out, strict=True) for d in by_doc.get(r.doc_id, ())]
    told = collections.defaultdict(lambda: [0] * len(domains))
    for tokens, d, c in marked:
        told[c][domains.index(d)] += tokens
    prior = mixing.PRIOR_DOCS * sum(m[0] for m in marked) / len(marked)
    better = lambda p, n: [(n[k] + prior * p[k]) / (sum(n) + prior) for k in range(len(domains))]
    return [better(p, told[cell(p)]) if cell(p) in told else p for p in out], len(evidence)


def test_posteriors_and_rates_equal_plain_loops(spark):
    rng = np.random.default_rng(9)
    common = [f"word{i}" for i in range(120)]
    rows, labels = [], []
    for k in range(400):
        words = list(rng.choice(common, int(rng.integers(5, 40))))
        kind = k % 4
        if kind == 1:
            words[0] = "scum!"
        if kind == 2:
            words[1:3] = ["Buy,", "cheap."]
        rows.append((k, " ".join(words), "en" if k % 3 else None, f"s{k % 2}", None))
        if k % 2 or k % 5 == 0:
            labels.append((k, int(kind != 2), int(kind == 1)))
    labels += [(1, 0, 0), (None, 1, 1), (7, None, None)]
    source = spark.createDataFrame(rows, DOCS)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = mixing._features(source).select("doc_id", "words", "f", "tokens").collect()
    domain = lambda q, t: "toxic" if t == 1 else "clean_high" if q == 1 else "clean_low" if q == 0 else None
    want, n = brute_mixing(held, [(k, domain(q, t)) for k, q, t in labels], mixing.DOMAINS)
    assert n >= 3
    got = {r.doc_id: r for r in mixing.mixing_rates(source, marked).collect()}
    for r, p in zip(held, want, strict=True):
        assert np.allclose(got[r.doc_id].p, p, atol=1e-9) and got[r.doc_id].tokens == r.tokens
    # projected gradient descent by plain steps over single documents reaches the same sums
    tokens, p = np.array([r.tokens for r in held], float), np.array(want)
    share = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    present = (tokens[:, None] * p).sum(0)
    wanted = share * present.sum()
    rate, scale = np.ones(len(held)), np.linalg.inv((tokens[:, None, None] * p[:, :, None] * p[:, None, :]).sum(0))
    for _ in range(500):
        off = (rate[:, None] * tokens[:, None] * p).sum(0) - wanted
        rate = np.clip(rate - p @ (0.5 * scale @ off), 0, mixing.MOST)
    assert np.abs((rate[:, None] * tokens[:, None] * p).sum(0) - wanted).max() < 1e-5 * wanted.sum()
    sums = (np.array([got[r.doc_id].rate for r in held])[:, None] * tokens[:, None] * p).sum(0)
    assert np.abs(sums - wanted).max() < 2e-3 * wanted.sum()
    assert {r.residual <= mixing.TOLERANCE for r in got.values()} == {True}


def test_targets_out_of_reach_tell_what_is_off(spark):
    """No document is of the wanted domain: the fit ends at the least distance and says so."""
    soft = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (20, [0.9, 0.1, 0.0])], "tokens long, p array<double>")
    steps, now, wanted = mixing.fit_rates(soft, {"clean_high": 0.5, "clean_low": 0.0, "toxic": 0.5}, total=100.0, most=10.0)
    assert wanted == [50.0, 0.0, 50.0] and now[2] == 0 and abs(now[0] - 50) < 5 and now[1] < 1


def test_no_document_comes_more_often_than_allowed(spark):
    """Little is left of the domain that should be half of all: its few documents come as often as they may, not more."""
    rows = [(k, "plain words of a page " * 8, "en", "web", None) for k in range(400)] + [(400 + k, "scum trash idiot moron", "en", "web", None) for k in range(40)]
    source = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1, int(k >= 400)) for k in range(0, 440, 2)], "doc_id long, quality int, toxic int")
    targets = {"clean_high": 0.5, "clean_low": 0.0, "toxic": 0.5}
    for most in (3.0, 1.5, 0.5):
        rated = mixing.mixing_rates(source, labels, targets, most=most).collect()
        assert all(0 <= r.rate <= most + 1e-9 for r in rated) and rated[0].residual > 0.2
        assert min(r.rate for r in rated if r.doc_id >= 400) == pytest.approx(most)
        out, off = mixing.mixed(source, labels, targets, most=most)
        assert off == pytest.approx(rated[0].residual) and max(collections.Counter(r.doc_id for r in out.collect()).values()) <= -(-most // 1)


@pytest.mark.parametrize(("size", "near"), [("sf0.01", 0.07), ("sf0.1", 0.02)])
def test_mixture_of_test_tables(spark, size, near):
    """Targets met by expected tokens, nearly by true labels (of a sample); no document dropped whole or drawn often."""
    source, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mixing_rates(source.repartition(8), labels, columns=["doc_id"])
    rows = got.join(labels.withColumn("d", mixing.label_domain()), "doc_id", "left").select("d", "tokens", "p", "rate", "residual").collect()
    assert rows[0].residual <= mixing.TOLERANCE and 0.5 < min(r.rate for r in rows) and max(r.rate for r in rows) < mixing.MOST
    total = sum(r.rate * r.tokens for r in rows)
    for k, (d, share) in enumerate(mixing.TARGETS.items()):
        assert sum(r.rate * r.tokens * r.p[k] for r in rows) / total == pytest.approx(share, abs=1e-5)
        assert sum(r.rate * r.tokens for r in rows if r.d == d) / sum(r.rate * r.tokens for r in rows if r.d) == pytest.approx(share, abs=near)


def test_held_out_documents_of_sf01(spark):
    """Recall and log loss on a fifth of the labels, and shares by true labels after mixing."""
    sf = "/root/testdata/sf0.1"
    source, labels = spark.read.parquet(f"{sf}/documents.parquet").repartition(8), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = mixing.mixing_rates(source, labels.where(~held)).select("doc_id", "tokens", "p", "rate", "residual")
    rows = got.join(labels.withColumn("d", mixing.label_domain()).where("d is not null"), "doc_id").select("d", "tokens", "p", "rate", "residual", held.alias("out")).collect()
    k_of = {d: k for k, d in enumerate(mixing.DOMAINS)}
    out = [(k_of[r.d], np.array(r.p)) for r in rows if r.out]
    assert np.mean([np.argmax(p) == 2 for k, p in out if k == 2]) > 0.75
    assert np.mean([-np.log(max(p[k], 1e-12)) for k, p in out]) < 0.35
    tokens = np.zeros(3)
    for r in rows:
        tokens[k_of[r.d]] += r.rate * r.tokens
    assert np.abs(tokens / tokens.sum() - [mixing.TARGETS[d] for d in mixing.DOMAINS]).max() < 0.04
    assert rows[0].residual <= mixing.TOLERANCE


def test_mixing_edges(spark):
    labels = spark.createDataFrame([(0, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    source = docs(spark, TEXTS, True)
    got = mixing.mixing_rates(source, labels)
    assert got.count() == len(TEXTS) + 2 and {tuple(r.p) for r in got.collect()} == {(1 / 3,) * 3}
    assert mixing.mixed(source, labels)[0].columns == source.columns
    assert mixing.mixing_rates(empty(spark), labels).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses(spark):
    apache = license_scan.TEMPLATES["Apache-2.0"]
    changed = apache.replace("obtain a copy", "get one copy").replace("express or ", "")
    texts = ["é intro.\nReleased under the MIT License.\nmore", changed, "the license of licensed things", None, "", "Licensed under CC BY-NC 4.0. And again: Licensed under CC BY-NC 4.0.", "x " * 5000 + "Licensed under CC BY 4.0."]
    found = collections.defaultdict(list)
    for r in license_scan.scan_licenses(docs(spark, texts, True)).collect():
        found[r.doc_id].append((r.template, texts[r.doc_id][r.begin : r.end], round(r.coverage, 2)))
    assert found[0] == [("MIT-short", "Released under the MIT License", 1.0)]
    assert [f[0] for f in found[1]][:1] == ["Apache-2.0"] and found[1][0][2] > 0.9
    assert sorted(f[0] for f in found[5]) == ["CC-BY-NC-4.0-short"] * 2
    assert [f[0] for f in found[6]] == ["CC-BY-4.0-short"] and 2 not in found and 3 not in found
    assert license_scan.scan_licenses(empty(spark)).count() == 0


@pytest.mark.parametrize("way", ["trie", "table", "join"])
def test_urls(spark, monkeypatch, way):
    from catalogspark.llm import url_filter

    rules = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("org", "/a/b", "block"), Rule("org", "/", "allow")]
    cases = {
        "http://x.com/": ("com/", "allow"), "HTTP://A.Example.COM/en/1?q#f": ("example.com/en/", "block"), "http://www.example.com/en/": ("www.example.com/en/", "allow"),
        "http://b.www.example.com/en/z": ("www.example.com/en/", "allow"), "http://x.com": (None, "deny"), "http://x.com?/a": (None, "deny"), "http://badexample.com/en/": ("com/", "allow"),
        "ftp://q.net/es/": ("net/es/", "block"), "http://q.net/esp/": (None, "deny"), "http://q.org/a/bc/d": ("org/a/b", "block"), "http://q.org/a/c": ("org/", "allow"), "no url": (None, "deny"), None: (None, "deny"), "": (None, "deny"),
    }
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string").withColumns({"host": F.lit(1), "path": F.lit(2), "after": F.lit(3), "raw": F.lit(1)})
    if way != "trie":
        rules = spark.createDataFrame([*rules, Rule("example.com", "/en/", "allow")], "host string, path string, verdict string")
        monkeypatch.setattr(url_filter, "TRIE_RULES", 2 if way == "join" else 100)
    got = judge_urls(rows.unionByName(rows), rules, "deny").collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r.rule, r.verdict) == list(cases.values())[r.page_id]
    assert judge_urls(rows.limit(0), rules).count() == 0
