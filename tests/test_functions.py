"""Text, token and address functions on the rules' own examples."""

import re

import pytest
from pyspark.sql import functions as F

from zbior.functions import text as tx
from zbior.functions import tokens as tk
from zbior.functions import urls as ur


def value(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("html", "clean"),
    [
        ("<blockquote>x</blockquote>Tak<br/>nie <a href='u'>link</a> http://a.pl ISSN0014", "Tak nie ISSN 0014"), ('<div class="notice">n</div>a<img src="x">b', "ab"), (None, ""), ("", ""),
        ('<span class="postbody signature">s</span><b>x</b>\xa0 y', "x y"), ("ETYKAtom koniecPoczątek", "ETYKA tom koniec Początek"), ("Dodano po 5 minutach: tekst", "tekst"),
    ],
)
def test_clean_post(spark, html, clean):
    assert value(spark, tx.clean_post(F.col("h")), h=html) == clean


def test_nested_quote_leaves_the_outer_tail(spark):
    assert value(spark, tx.strip_quotes(F.col("h")), h="<blockquote>a<blockquote>b</blockquote>c</blockquote>d") == "c</blockquote>d"


def test_links_keep_their_text_on_the_other_boards(spark):
    assert value(spark, tx.clean_post_keeping_links(F.col("h")), h='a <a href="u">b</a><span class="biblia">zzz') == "a b"


@pytest.mark.parametrize(("g", "out"), [(" Mężczyzna ", "M"), ("kobieta", "K"), ("k", "K"), ("x", None), (None, None)])
def test_gender(spark, g, out):
    assert value(spark, tx.gender(F.col("g")), g=g) == out


def test_counters(spark):
    assert value(spark, tx.counter(F.col("t")), t="1623 Odpowiedzi") == 1623
    assert value(spark, tx.counter(F.col("t"), "Odpowiedzi:"), t="x 5 Odpowiedzi: 14") == 14
    assert value(spark, tx.counter(F.col("t")), t=None) == 0
    assert value(spark, tx.post_number(F.col("t")), t="viewtopic.php?p=77#p77") == 77


def test_tokens_agree_with_a_plain_statement(spark):
    text = "Święty Bóg, a²b 12 x_y\nŻÓŁW"
    assert value(spark, tk.tokens(F.col("t")), t=text) == re.findall(r"\w+", text.lower())
    assert value(spark, tk.tokens(F.col("t"), True, 3), t=text) == ["święty", "bóg", "a²b", "x_y", "żółw"]
    assert value(spark, tk.tokens(F.col("t")), t=None) == []


def test_sentiment_and_readability(spark):
    s = value(spark, tk.sentiment(F.col("w")), w=["miłość", "grzech", "bóg", "x"])
    assert (s.polarity, s.subjectivity) == (0.0, 0.625)
    s = value(spark, tk.sentiment(F.col("w")), w=["bóg", "x"])
    assert (s.polarity, s.subjectivity) == (0.0, 0.5)
    assert value(spark, tk.readability(F.lit(0), F.lit(0), F.lit(0))) == 0.0
    assert value(spark, tk.readability(F.lit(10), F.lit(1), F.lit(20))) == pytest.approx(27.485)


@pytest.mark.parametrize(("u", "d"), [("www.Onet.PL/a", "onet.pl"), ("https://u:p@www.x.pl:80/", "u:p@www.x.pl:80"), ("", None), (None, None), ("https:///x", None)])
def test_domain(spark, u, d):
    assert value(spark, ur.domain(F.col("u")), u=u) == d


def test_categories_overlap_and_types_have_an_order(spark):
    assert value(spark, ur.domain_category(F.col("d")), d="radiomaryja.pl") == "religious"
    assert value(spark, ur.is_media(F.col("d")), d="radiomaryja.pl")
    assert value(spark, ur.url_type(F.col("u")), u="https://x.pl/video/a.jpg") == "video"
    s = value(spark, ur.url_stats(F.col("u")), u=["http://radiomaryja.pl/1", "http://radiomaryja.pl/2", "x.edu", None, " "])
    assert (s.total_urls, s.unique_domains, s.religious_urls, s.media_urls, s.educational_urls, s.unknown_urls) == (5, 2, 1, 1, 1, 0)


def test_links(spark):
    assert value(spark, ur.without_session(F.col("u")), u="viewtopic.php?sid=1&t=2") == "viewtopic.php?t=2"
    assert value(spark, ur.without_session(F.col("u")), u="v.php?t=2&sid=1#p3") == "v.php?t=2#p3"
    assert value(spark, ur.query_param(F.col("u"), "t"), u="v.php?start=12&t=3") == "3"
    assert value(spark, ur.query_param(F.col("u"), "t"), u="v.php?start=12") is None
    assert value(spark, ur.join_url(F.lit("https://a.pl/b/c"), F.lit("../d"))) == "https://a.pl/d"


def test_extract_urls(spark):
    html = '<a href="/in">i</a><a href="https://b.pl/x">b</a> https://b.pl/x/longer www.c.pl <a href="#z">z</a><a href="mailto:a@b">m</a> https://own.pl/q'
    assert value(spark, ur.extract_urls(F.col("h"), F.lit("https://own.pl/p/q")), h=html) == ["https://b.pl/x", "www.c.pl"]
    assert value(spark, ur.extract_urls(F.col("h"), F.lit("https://own.pl/")), h=None) == []
