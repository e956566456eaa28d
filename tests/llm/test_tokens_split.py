"""Encoding by tree reduction and splitting: against the library, and by their limits."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zbior.llm.split import Splitter, split_oversized
from zbior.llm.tokens import Bpe, bpe, encode_column

ODD = ["a" * 3000, " " * 500 + "x", "x\n\n \t y" * 400, "don't 's 'll " * 300, "​\xa0 " * 500, "日本語" * 700, "<|endoftext|> " * 200, "🙂🙏" * 500, "ł" * 999, "1 22 333 " * 300, "a \x1c b\x85c " * 300]


@pytest.mark.parametrize("leaf", [3, 16, 100, 4096])
def test_tree_equals_direct_encoding(leaf):
    tree = Bpe(leaf=leaf)
    for text in ODD:
        assert tree.encode(text) == tree.core.encode_ordinary(text)
        assert tree.decode(tree.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80), st.integers(2, 9))
def test_any_text(text, leaf):
    tree = Bpe.__new__(Bpe)
    tree.__dict__.update(bpe().__dict__, leaf=leaf)
    assert tree.encode(text) == tree.core.encode_ordinary(text)


def test_agrees_with_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in ODD:
        assert bpe().encode(text) == other.encode(text, add_special_tokens=False).ids


def test_column(spark):
    df = spark.createDataFrame([(1, "Ala ma kota"), (2, None), (3, ""), (None, "x"), (1, "Ala ma kota"), (5, "słowo " * 20_000)], "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids")
    rows = encode_column(df, "doc_id", "text").collect()
    assert len(rows) == 6
    got = {r.doc_id: r.ids for r in rows}
    assert got[2] == [] and got[3] == [] and bpe().decode(got[5]) == "słowo " * 20_000 and got[None] == bpe().encode("x")
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0


def check(splitter, text):
    pieces = splitter.split(text)
    n = len(splitter.encoder.encode(text))
    assert bool(pieces) == (n > splitter.limit)
    if pieces:
        assert pieces[0].start == 0 and pieces[-1].end == len(text)
        for p in pieces:
            assert p.tokens == len(splitter.encoder.encode(text[p.start : p.end])) <= splitter.limit
        for a, b in zip(pieces, pieces[1:]):
            assert a.start < b.start <= a.end < b.end
            assert len(splitter.encoder.encode(text[b.start : a.end])) <= splitter.overlap + 3
    return pieces


@pytest.mark.parametrize("text", [*ODD, "Zdanie pierwsze. Zdanie drugie!\n\nAkapit nowy. " * 150, "słowo " * 3000])
def test_pieces(text):
    check(Splitter(bpe(), 100, 10), text)
    check(Splitter(bpe(), 1000, 50), text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300), st.integers(4, 20))
def test_pieces_of_any_text(text, limit):
    check(Splitter(bpe(), limit, limit // 3), text)


def test_prefers_strong_boundaries_and_few_pieces():
    paragraph = "To jest zdanie o niczym, które ma kilka słów. " * 8
    text = "\n\n".join([paragraph.strip()] * 12)
    pieces = check(Splitter(bpe(), 400, 20), text)
    n = len(bpe().encode(text))
    assert len(pieces) <= -(-(n - 20) // 380) + 1
    assert all(text[: p.end].endswith("\n\n") for p in pieces[:-1])


def test_split_operator(spark):
    long = "Krótkie zdanie. " * 1000
    df = spark.createDataFrame([(1, long), (2, "krótki"), (3, None), (4, ""), (5, long)], "doc_id long, text string").selectExpr("*", "'x' as piece_no")
    rows = split_oversized(df).collect()
    assert {r.doc_id for r in rows} == {1, 5} and all(r.n_tokens <= 1000 and r.text == long[r.start_char : r.end_char] for r in rows)
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Splitter(bpe(), 10, 10)


def test_pieces_end_at_the_boundaries_there_are():
    run = "x7Kq9zLw" * 90
    text = " ".join([run] * 12)
    splitter = Splitter(bpe(), 1000, 50)
    pieces = splitter.split(text)
    assert len(pieces) > 1 and all(text[p.end - 1] == " " for p in pieces[:-1])
    assert pieces[0].start == 0 and pieces[-1].end == len(text) and all(b.start <= a.end < b.end for a, b in zip(pieces, pieces[1:])) and all(p.tokens <= 1000 for p in pieces)
