"""Queries that leave no row out: against brute force on rows that are easily lost."""

import datetime
import inspect
import json

import pytest

from zbior.plans import QUERIES
from zbior.sources import pages

AT = datetime.datetime(2025, 8, 1)


def stored(spark, folder, name, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pages_of_every_post(spark, tmp_path):
    posts = [
        ("p1", "Jan  Kowal", "a < b && c > d &amp; <b>x</b>", "16 mar 2005, 11:07"), ("p2", "Ola", "Dobry\n\twieczór", "wczoraj"), ("p3", "<i>&lt;", "x", " "), ("p4", "Ela\xa0M", "", None),
        ("p5", None, "x", "dziś"), ("p6", " \x0b", "x", "dziś"), ("p7", "Iza", None, "5 maj\x85 2010"), ("p8", "Adam", "</div></td><blockquote>y", "1"),
    ]
    folder = stored(spark, tmp_path, "forum_posts", "id string, username string, content string, post_date string, updated_at timestamp_ntz", [(*p, AT) for p in posts])
    plain = lambda s: " ".join((s or "").split())
    want = {(i, plain(u), plain(c), plain(d) or None) for i, u, c, d in posts if plain(u)}
    got = [tuple(r) for r in QUERIES["post_pages"](spark, folder).collect()]
    assert len(got) == 6 and set(got) == want


def test_more_than_fifty_addresses_of_a_post_count(spark, tmp_path):
    links = [f"https://d{i}.example/a" for i in range(70)]
    folder = stored(spark, tmp_path, "forum_posts", "id string, content_urls string, updated_at timestamp_ntz", [("p1", json.dumps(links), AT), ("p2", None, AT)])
    got = {r.id: (r.total_urls, r.unique_domains) for r in QUERIES["post_url_stats"](spark, folder).collect()}
    assert got["p1"] == (70, 70)


def test_discovery_goes_on_to_the_end(spark):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(5)], "src string, dst string")
    root = spark.createDataFrame([("0",)], "url string")
    with pytest.raises(RuntimeError):
        pages.discover(links, root, 3)
    assert pages.discover(links, root, 5).count() == 6
    assert inspect.signature(pages.discover).parameters["most_rounds"].default is None


def test_addresses_of_posts_that_name_some(spark, tmp_path):
    contents = {"p1": "patrz http://a.example/x i www.b.example", "p2": '<a href="https://c.example/q">tu</a>', "p3": "nic", "p4": None}
    folder = stored(spark, tmp_path, "forum_posts", "id string, username string, content string, url string, updated_at timestamp_ntz", [(k, "Ola", c, "https://f.example/1", AT) for k, c in contents.items()])
    own, last = "https://f.example/1", "www.x.example/y"
    got = {r.id: r.urls for r in QUERIES["outgoing_urls"](spark, folder).collect()}
    assert got == {"p1": [own, "http://a.example/x", "www.b.example", last], "p2": ["https://c.example/q", own, last], "p3": [own, last]}


def test_latest_of_null_keys_and_orders(spark, monkeypatch):
    """The same rows, however many partitions there are and however many keys are sent."""
    from zbior.sources import tables

    rows = [(None, "a", 1), (None, "b", 2), ("k", "c", None), ("k", "c", None), ("m", "d", None), ("m", "e", 3), ("n", "f", 4), ("o", "g", None), ("p", "h", 5), ("p", "h", 5)]
    want = {(None, "b", 2), ("k", "c", None), ("m", "e", 3), ("n", "f", 4), ("o", "g", None), ("p", "h", 5)}
    for parts in (1, 8):
        for most in (0, 10**6):
            monkeypatch.setattr(tables, "BROADCAST_KEYS", most)
            got = [tuple(r) for r in tables.latest_wide(spark.createDataFrame(rows, "id string, v string, seq int").repartition(parts), "id", "seq").collect()]
            assert set(got) == want and len(got) == len(want), (parts, most)


# Markup and what is to be left of it, written by hand.
CLEANED = [
    ("a<br />b", "a b", "a b"), ("<blockquote>stare</blockquote>nowe", "nowe", "nowe"), ('x <a href="u">link</a> y', "x y", "x link y"), ("ISSN0014 ETYKAtom", "ISSN 0014 ETYKA tom", "ISSN0014 ETYKAtom"),
    ('<img src="a.png"/>tekst http://a.example/b?c=d koniec', "tekst koniec", "tekst koniec"), ('<div class="notice">Ostatnio</div>po', "po", "po"), ("jedenDwa", "jeden Dwa", "jedenDwa"), (None, "", ""), ("", "", ""),
    ("<blockquote>a<blockquote>b</blockquote>c</blockquote>d", "cd", "cd"), ('<div class="quotewrapper">Ala</div>Ola', "Ola", "Ala Ola"),
]
UNQUOTED = [
    ("<blockquote>a</blockquote>b", "b"), ("<blockquote>a<blockquote>b</blockquote>c</blockquote>d", "c</blockquote>d"), ('<div class="x quote y">a</div>b', "b"), ("<cite>kto</cite>co", "co"),
    ('<table class="quotebox"><tr><td>a</td></tr></table>b', "b"), ("zostaje <b>to</b>", "zostaje <b>to</b>"), (None, ""),
]
DATED = [  # text, by the board's parser, by the store's; fetched 2025-01-02 03:04:05
    ("Śr mar 16, 2005 11:07 pm", "2005-03-16 23:07:00", None), ("27 lip 2025, 16:46", "2025-07-27 16:46:00", "2025-07-27 16:46:00"), ("21 maja 2022, 17:58", "2022-05-21 17:58:00", "2022-05-21 17:58:00"),
    ("dzisiaj, 8:12", "2025-01-02 08:12:05", "2025-01-02 08:12:05"), ("wczoraj, 17:30", "2025-01-01 17:30:05", "2025-01-01 17:30:05"), ("So lip 20, 2024 20:57", None, "2024-07-20 20:57:00"),
    ("2022-07-11, 09:07", None, "2022-07-11 09:07:00"), ("3 stycznia 2020, 10:00", None, None), ("", None, None), (None, None, None),
]


def test_rules_against_results_written_by_hand(spark):
    from pyspark.sql import functions as F

    from zbior.functions import dates, text

    df = spark.createDataFrame([(h,) for h, _, _ in CLEANED], "h string").select(text.clean_post(F.col("h")), text.clean_post_keeping_links(F.col("h")))
    assert [tuple(r) for r in df.collect()] == [(a, b) for _, a, b in CLEANED]
    df = spark.createDataFrame([(h,) for h, _ in UNQUOTED], "h string").select(text.strip_quotes(F.col("h")))
    assert [r[0] for r in df.collect()] == [b for _, b in UNQUOTED]
    at = datetime.datetime(2025, 1, 2, 3, 4, 5)
    df = spark.createDataFrame([(d, at) for d, _, _ in DATED], "d string, at timestamp_ntz").select(dates.board_date(F.col("d"), F.col("at")), dates.stored_date(F.col("d"), F.col("at")))
    assert [tuple(r) for r in df.collect()] == [(a, b) for _, a, b in DATED]
    lines = ["przez Ala » 2021-05-03, 7:08 · odpowiedz", "2021-05-03T17:08", "przez Ala", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(dates.author_line_date(F.col("x"))).collect()] == ["2021-05-03 07:08", "2021-05-03 17:08", None, None]
