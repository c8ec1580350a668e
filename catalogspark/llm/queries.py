"""The registered queries of this subpackage: one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .chat_quotes import reply_order
from .embedding_dedup import near_duplicates
from .html_extract import extract
from .license_scan import scan_licenses
from .mixing import DOMAINS, mixing_rates
from .nearest import nearest
from .ngram_jaccard import jaccard_components
from .packing import pack
from .quality import ledger, passes
from .token_alignment import align
from .toxicity import toxicity
from .url_filter import Rule, judge_urls
from .whitening import whiten

#: Fixed by the contract of the query.
URL_RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(_table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "failures"
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), columns=["doc_id", "source"])
    return rated.select("doc_id", "source", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "residual")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), word_tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(_table(spark, sf_dir, "conversations"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), components=4)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = align(_table(spark, sf_dir, "documents"), a, b, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_chat_quotes": op8_chat_quotes,
    "op9_license_scan": op9_license_scan,
    "op10_url_filter": op10_url_filter,
    "op11_whitening": op11_whitening,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_token_alignment": op13_token_alignment,
}

_WORD = r"[^\x20\x09-\x0D]"

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        good AS (
            SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
        c AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
        n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
        SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
        FROM v JOIN c ON c.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id""",
    "op2_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        s AS (
            SELECT doc_id, t, regexp_extract_all(t, '{_WORD}+') AS w,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM s)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 5) AS o(k) GROUP BY doc_id),
        m AS (
            SELECT s.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
                   len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM s LEFT JOIN c USING (doc_id)),
        f AS (
            SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
                   + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 25 * n_words)::BIGINT
                   + 32 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT AS failures FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures
        FROM f""",
    "op4_ngram_jaccard": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+') AS w FROM documents),
        g AS (
            SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 85 * (x.n + y.n - o)),
        edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, b.v FROM reach r JOIN edges b ON r.v = b.u)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.v) AS component_id
        FROM d JOIN reach r ON r.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op8_chat_quotes": r"""
        WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
        l AS (
            SELECT rid, conv_id, turn, pos, line, regexp_extract(line, '^(?: {0,3}>)+ ?') AS marks
            FROM (SELECT rid, conv_id, turn, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM m)),
        v AS (SELECT *, length(marks) - length(replace(marks, '>', '')) AS level, substr(line, length(marks) + 1) AS body FROM l),
        own AS (
            SELECT m.rid, m.conv_id, m.turn, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS own
            FROM m LEFT JOIN v ON v.rid = m.rid GROUP BY ALL),
        runs AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY pos) AS passage FROM (
            SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY pos) THEN 1 ELSE 0 END AS new FROM v)),
        q AS (
            SELECT *, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) AS form
            FROM (SELECT rid, conv_id, turn, passage, level, string_agg(body, chr(10) ORDER BY pos) AS body FROM runs WHERE level > 0 GROUP BY ALL)),
        parts AS (
            SELECT conv_id, turn, unnest(list_concat([own], regexp_split_to_array(own, '\n\s*\n'), string_split(own, chr(10)), regexp_split_to_array(own, '[.!?]+\s+|\n+'))) AS p
            FROM own WHERE conv_id IN (SELECT conv_id FROM q)),
        keys AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')) AS form FROM parts),
        units AS (
            SELECT DISTINCT rid, conv_id, turn, passage, trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')) AS form
            FROM (SELECT rid, conv_id, turn, passage, unnest(regexp_split_to_array(body, '[.!?]+\s+|\n+')) AS u FROM q WHERE form <> '')),
        asked AS (
            SELECT rid, conv_id, turn, passage, form, true AS whole, 0 AS words FROM q WHERE form <> ''
            UNION ALL SELECT rid, conv_id, turn, passage, form, false, len(string_split(form, ' ')) FROM units WHERE form <> ''),
        met AS (
            SELECT a.rid, a.passage, a.form, a.whole, a.words, max(k.turn) AS original
            FROM asked a JOIN keys k ON k.conv_id = a.conv_id AND k.form = a.form AND k.turn < a.turn GROUP BY ALL),
        said AS (SELECT rid, passage, original, bool_or(whole) AS whole, sum(words) AS words FROM met GROUP BY ALL),
        best AS (SELECT rid, passage, arg_max(original, (whole, words, original)) AS original FROM said GROUP BY ALL),
        linked AS (SELECT q.rid, q.passage, q.level, b.original FROM q LEFT JOIN best b ON b.rid = q.rid AND b.passage = q.passage WHERE q.form <> ''),
        per AS (
            SELECT rid, count(*) AS n_quotes, count(original) AS n_linked, coalesce(max(original) FILTER (level = 1), max(original)) AS quoted FROM linked GROUP BY rid),
        o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, t) - 1 AS seat,
                   max(turn) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM m),
        a AS (
            SELECT o.rid, o.conv_id, o.turn, o.role, seat, earlier, CASE WHEN o.conv_id IS NOT NULL AND o.turn IS NOT NULL THEN coalesce(quoted, earlier) END AS reply_to,
                   coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, own.own AS text
            FROM o JOIN own ON own.rid = o.rid LEFT JOIN per ON per.rid = o.rid),
        bent AS (SELECT * FROM a WHERE conv_id IN (SELECT conv_id FROM a WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND reply_to <> earlier)),
        tree(conv_id, seat, path) AS (
            SELECT conv_id, seat, [seat] FROM bent WHERE reply_to IS NULL
            UNION ALL
            SELECT b.conv_id, b.seat, list_append(t.path, b.seat) FROM tree t
            JOIN (SELECT conv_id, turn, min(seat) AS seat FROM bent WHERE turn IS NOT NULL GROUP BY ALL) f ON f.conv_id = t.conv_id AND f.seat = t.seat
            JOIN bent b ON b.conv_id = f.conv_id AND b.reply_to = f.turn),
        places AS (SELECT conv_id, seat, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS place FROM tree)
        SELECT a.conv_id, a.turn, a.role, coalesce(place, a.seat) AS position, reply_to, n_quotes, n_linked, text
        FROM a LEFT JOIN places p ON p.conv_id = a.conv_id AND p.seat = a.seat""",
    "op10_url_filter": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut),
        rules(host, path, verdict) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                   ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        best AS (
            SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC NULLS LAST, length(r.path) DESC) AS k
            FROM parts p LEFT JOIN rules r
              ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1""",
}
