import pytest
from pyspark.sql import functions as F

from catalogspark.functions.access import parse_requesters, visible_to
from catalogspark.functions.filters import InvalidFilterError, filter_expr, filter_leaves, text_match
from catalogspark.schema import ANONYMOUS, ENTRY_SCHEMA, Requester


def rows(spark, *entries):
    full = [
        (e["id"], e.get("rev", 1), e.get("type", "skill"), "acme", e.get("name", e["id"]), e.get("description", "test entry"), e.get("version"), e.get("attrs"), None, None, None, None)
        for e in entries
    ]
    return spark.createDataFrame(full, ENTRY_SCHEMA)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.fixture(scope="module")
def six(spark):
    has = {
        1: {"capability": ["summarize"], "env": ["prod"], "endpoint": ["e"]}, 2: {"capability": ["summarize"], "tag": ["finance"], "endpoint": []},
        3: {"env": ["prod"], "endpoint": ["e"]}, 4: {"tag": ["finance"], "endpoint": ["e"]},
        5: {"capability": ["summarize"], "env": ["prod"], "endpoint": ["e"]}, 6: {"tag": ["finance"], "endpoint": ["e"]},
    }
    return rows(spark, *[{"id": str(k), "type": "skill" if k < 5 else "rag", "attrs": v} for k, v in has.items()])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("(&(type=skill)(capability=summarize)(env=prod))", "1"),
        ("(|(tag=finance)(capability=summarize))", "12456"),
        ("(!(tag=finance))", "135"),
        ("(&(endpoint=*)(!(tag=finance))(type=skill))", "13"),
        ("(tag=__never__)", ""),
        ("( & ( type = skill ) ( endpoint=* ) )", "1234"),
        ("(attrs.type=skill)", ""),
        ("(rev=01)", "123456"),
        ("(rev=99999999999999999999999)", ""),
        ("(!(rev=-99999999999999999999999))", "123456"),
        ("(rev=00000000000000000000001)", "123456"),
        ("(rev=2147483648)", ""),
        ("(!(version=1))", "123456"),
        ("(version=*)", ""),
        ("(description=*)", ""),
    ],
)
def test_filters_and_postings_agree(spark, six, text, expected):
    from catalogspark.operators.index import build_postings, eval_on_postings

    assert ids(six.where(filter_expr(text))) == list(expected)
    assert ids(eval_on_postings(build_postings(six), six, text)) == list(expected)


def test_values(spark):
    some = rows(spark, {"id": "a", "name": "hello()*"}, {"id": "b", "name": "*abc"}, {"id": "c", "name": "x' OR 1=1 --", "version": ""})
    assert ids(some.where(filter_expr(r"(name=hello\(\)\*)"))) == ["a"]
    assert ids(some.where(filter_expr("(name=*abc)"))) == ["b"]
    assert ids(some.where(filter_expr("(name=x' OR 1=1 --)"))) == ["c"]
    assert ids(some.where(filter_expr("(version=)"))) == []
    assert filter_leaves(r"(k=\*)")[0][:4] == ("eq", "attr", "k", "*")
    assert filter_leaves("(k= * )")[0][:4] == ("present", "attr", "k", "")
    assert filter_leaves("(k= a b )")[0][3] == "a b"


@pytest.mark.parametrize("text", ["", "(", "(a=b", "(&)", "(a=b)x", "(a=(b)", r"(a=\q)", "(rev=abc)", "(attrs.=x)", "(=x)", "a=b", "(a)"])
def test_invalid(text):
    with pytest.raises(InvalidFilterError) as found:
        filter_expr(text)
    assert 0 <= found.value.position <= len(text)


def test_text_is_literal(spark):
    some = rows(spark, {"id": "a", "name": "100% sure"}, {"id": "b", "name": "1000 sure"}, {"id": "c", "description": "100% TRUE"})
    assert ids(some.where(text_match(" 100% "))) == ["a", "c"]
    assert ids(some.where(text_match("  "))) == ["a", "b", "c"]


def test_visibility(spark):
    see = {"p": ["public"], "i": ["internal"], "r": ["restricted"], "o": ["odd"]}
    some = rows(spark, *[{"id": k, "attrs": {"visibility": v, "allowed_group": ["finance"]}} for k, v in see.items()], {"id": "n"}, {"id": "x", "attrs": {"visibility": ["restricted"]}})
    shown = lambda r: "".join(ids(some.where(visible_to(r))))
    assert shown(ANONYMOUS) == "nop"
    assert shown(Requester(True)) == "inop"
    assert shown(Requester(True, ("finance", "ops"))) == "inopr"
    assert shown(Requester(False, ("finance",))) == "nop"


def test_requesters(spark):
    raw = spark.createDataFrame([("Bearer x", None, " a ,,b,a"), (None, "", "a"), (None, "me", None)], "authorization string, sub string, groups string")
    known = parse_requesters(raw, True).select("authenticated", "subject", "group_list").collect()
    assert [tuple(r) for r in known] == [(True, None, ["a", "b"]), (False, None, []), (True, "me", [])]
    assert parse_requesters(raw, False).where(F.col("authenticated")).count() == 0
