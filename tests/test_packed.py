"""Packed fields: the grammar, its way back from broken quotes, and the operator."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zbior.operators.packed import Packed, split_packed


@pytest.mark.parametrize(
    ("kind", "text", "values"),
    [
        ("names", "Jan Lis;Ewa Żuk", ["Jan Lis", "Ewa Żuk"]), ("names", "Jan Lis, Ewa Żuk oraz Adam Wilk", ["Jan Lis", "Ewa Żuk", "Adam Wilk"]), ("names", '"Lis, Jan"', ["Lis, Jan"]),
        ("names", '["\\u017bak, Ewa", "Jan Lis"]', ["Żak, Ewa", "Jan Lis"]), ("names", "['Jan Lis']", ["Jan Lis"]), ("names", "Anna Lis; ;", ["Anna Lis"]), ("names", " ; Jan i Ewa", ["Jan", "Ewa"]),
        ("names", "Jan Lis & Ewa Żuk / Adam", ["Jan Lis", "Ewa Żuk", "Adam"]), ("tags", "dzieci i młodzież; post", ["dzieci i młodzież", "post"]), ("tags", '"sztuka, rzemiosło"; dom', ["sztuka, rzemiosło", "dom"]),
        ("tags", "a • b • c", ["a", "b", "c"]), ("tags", 'x; "say ""hi"" now"', ["x", 'say "hi" now']), ("urls", "http://a.pl/x  https://b.pl/y", ["http://a.pl/x", "https://b.pl/y"]),
        ("urls", "https://a.pl/?s=1;802", ["https://a.pl/?s=1;802"]), ("urls", '"https://a.pl/#c,4" | http://b.pl', ["https://a.pl/#c,4", "http://b.pl"]), ("urls", '["https:\\/\\/a.pl\\/x", "http://b.pl/#c,1"]', ["https://a.pl/x", "http://b.pl/#c,1"]),
        ("urls", "http://a.pl/1|| http://b.pl/2", ["http://a.pl/1", "http://b.pl/2"]), ("urls", "[]", []), ("tags", " \xa0", []), ("tags", None, []), ("tags", "", []), ("tags", '""', []),
    ],
)
def test_values(kind, text, values):
    assert [v for v, _ in Packed(kind).parse(text)] == values


@pytest.mark.parametrize(("text", "values"), [('"open; shut', ["open", "shut"]), ('["a", "b', ["a", "b"]), ('"a" b; c', ['a" b', "c"])])
def test_broken_quotes_are_taken_as_bare_and_flagged(text, values):
    found = Packed("tags").parse(text)
    assert [v for v, _ in found] == values
    assert any(bad for _, bad in found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs", "Cc", "Zs", "Cf")), min_size=1, max_size=12), max_size=5))
def test_json_lists_round_trip(values):
    for ascii_only in (True, False):
        assert [v for v, _ in Packed("tags").parse(json.dumps(values, ensure_ascii=ascii_only))] == values


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_ends_and_gives_no_empty_value(text):
    for kind in ("names", "tags", "urls"):
        assert all(v and v == v.strip() for v, _ in Packed(kind).parse(text))


def test_operator(spark):
    df = spark.createDataFrame([(1, "a; b", "x"), (1, "a; b", "x"), (2, None, "x"), (None, "c", "x"), (3, "[]", "x"), (4, "z" * 100_000 + "; y", "x")], "id long, val string, pos string")
    rows = {(r.rec_id, r.pos, r.val[:3]) for r in split_packed(df, "id", "val", "tags").collect()}
    assert rows == {("1", 0, "a"), ("1", 1, "b"), (None, 0, "c"), ("4", 0, "zzz"), ("4", 1, "y")}
    assert split_packed(df, "id", "val", "tags").count() == 7
    assert split_packed(df.limit(0), "id", "val", "tags").count() == 0
