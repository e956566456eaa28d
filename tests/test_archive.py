"""Pages to tables, their sinks, analyzers that fail, streams that merge."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from zbior import archive
from zbior.analyzers import register, run
from zbior.analyzers.config import AnalysisConfig, AnalyzerConfig
from zbior.sources import versioned
from zbior.streaming.upsert import current, upsert_stream

AT, LATER = datetime.datetime(2025, 8, 1), datetime.datetime(2025, 8, 2)
HOST = "https://forum.example"
POST = (
    '<tr class="row1"><td><b class="postauthor">{0}</b><span class="postdetails"><b>Dołączył(a):</b> 1 maj 2010, 10:00<br /><b>Posty:</b> {1}<br /><b>wyznanie:</b> katolik</span></td>'
    '<td><span class="postdate">{2}</span><a href="viewtopic.php?p={3}">#</a><div class="postbody">Treść {3} http://a.example/{3}</div></td></tr>'
)
LIST = '<table><tr><td class="row1"><a class="topictitle" href="viewtopic.php?f=1&t={0}&sid=q">Temat {0}</a></td><td class="replies">1623 Odpowiedzi</td><td class="views">7</td></tr></table>'
PAGES = [
    (1, f"{HOST}/index.php", '<a class="forumlink" href="viewforum.php?f=1&sid=x">Wiara</a><a class="forumlink" href="/kontakt">Kontakt</a>', AT),
    (2, f"{HOST}/viewforum.php?f=1", LIST.format(5), AT), (3, f"{HOST}/viewforum.php?f=1", LIST.format(5).replace("Temat", "Nowy temat"), LATER), (4, f"{HOST}/viewforum.php?f=9", LIST.format(6), AT),
    (5, f"{HOST}/viewtopic.php?t=5", "<table>" + POST.format("Ala", 3, "27 lip 2025, 16:46", 10) + POST.format("Ola", 8, "dzisiaj, 8:12", 11) + "</table>", AT),
    (6, f"{HOST}/viewtopic.php?t=5", "<table>" + POST.format("Ala", 4, "27 lip 2025, 16:46", 10) + "</table>", LATER),
    (7, f"{HOST}/viewtopic.php?p=12", "<table>" + POST.format("Ela", 1, "wczoraj, 9:00", 12) + '</table><a href="viewtopic.php?f=1&amp;t=7">temat</a>', AT),
    (8, f"{HOST}/viewtopic.php?p=13", "<table>" + POST.format("Iza", 1, "x", 13) + "</table>", AT), (9, f"{HOST}/viewtopic.php?t=8", None, AT), (10, f"{HOST}/index.php", "", AT),
]


def test_pages_to_tables_and_sinks(spark, tmp_path):
    raw = spark.createDataFrame(PAGES, "page_id long, url string, html string, fetched_at timestamp_ntz")
    board = archive.Board("proba", "Próba", "tables")
    t = archive.tables_of_pages(raw, board)
    got = {name: df.collect() for name, df in t.items()}
    assert [(r.spider_name, r.title, r.updated_at) for r in got["forums"]] == [("proba", "Próba", LATER)]
    assert [(r.title, r.url) for r in got["sections"]] == [("Wiara", "viewforum.php?f=1")]
    threads = {r.title: r for r in got["threads"]}
    assert set(threads) == {"Nowy temat 5", None} and threads["Nowy temat 5"].replies == 1623 and threads["Nowy temat 5"].section_title == "Wiara"
    assert len(got["threads"]) == 2 and threads[None].url.endswith("p=12")
    assert sorted((r.username, r.posts_count, r.religion) for r in got["users"]) == [("Ala", 4, "katolik"), ("Ela", 1, "katolik"), ("Ola", 8, "katolik")]
    posts = {r.post_number: r for r in got["posts"]}
    assert set(posts) == {10, 11, 12} and posts[11].post_date == "2025-08-01 08:12:00" and posts[10].content_urls == ["http://a.example/10"] and posts[10].content == "Treść 10"
    assert {(r.table, r.reason) for r in got["rejected"]} == {("posts", "no thread"), ("threads", "unknown section")}
    ids = {r.id for r in got["threads"]}
    assert all(r.thread_id in ids for r in got["posts"]) and {r.user_id for r in got["posts"]} == {r.id for r in got["users"]}
    for _ in range(3):  # storing again changes nothing, and old versions go
        archive.store(str(tmp_path), t)
    assert {n: versioned.current(spark, f"{tmp_path}/{n}").count() for n in ("forums", "sections", "threads", "users", "posts")} == {"forums": 1, "sections": 1, "threads": 2, "users": 3, "posts": 3}
    assert '["http://a.example/10"]' in {r.content_urls for r in versioned.current(spark, f"{tmp_path}/posts").collect()}
    assert len(versioned.versions(spark, f"{tmp_path}/posts")) == versioned.KEPT and not (tmp_path / "rejected").exists()
    none = archive.tables_of_pages(raw.limit(0), board)
    assert [none[n].count() for n in ("sections", "threads", "users", "posts", "rejected")] == [0] * 5


def test_weeklies_are_kept_by_their_natural_keys(spark, tmp_path):
    issue = lambda n, url, at: ("Tygodnik", n, 2024, url, at)
    schema = "weekly_name string, issue_number long, issue_year long, issue_url string, scraped_at timestamp_ntz"
    archive.store(str(tmp_path), {"issues": spark.createDataFrame([issue(1, "a", AT), issue(2, "b", AT)], schema)})
    archive.store(str(tmp_path), {"issues": spark.createDataFrame([issue(1, "c", LATER), issue(3, "d", AT)], schema)})
    assert {r.issue_url for r in versioned.current(spark, f"{tmp_path}/issues").collect()} == {"b", "c", "d"}


def test_an_analyzer_that_fails_does_not_stop_the_others(spark):
    calls = []

    @register
    class Broken:
        name = "broken"

        def setup(self):
            calls.append("setup")

        def apply(self, df):
            return df.select("no_such_column")

        def close(self):
            calls.append("close")

    df = spark.createDataFrame([("1", "Pan Kowalski, dobra parafia Łąka.", ["https://x.pl/a", "https://x.pl/b"])], "id string, content string, content_urls array<string>")
    r = run(df, AnalysisConfig(analyzers=[AnalyzerConfig("broken"), AnalyzerConfig("spacy_analyzer"), AnalyzerConfig("url_analyzer")])).first()
    assert r.broken is None and "broken" in r.analysis_errors and calls == ["setup", "close"]
    tokens = {t.token: t for t in r.spacy_analyzer.tokens}
    assert tokens[","].is_punct and tokens[","].pos == "PUNCT" and tokens["Pan"].morph_features["Gender"] == "Masc" and not tokens["Pan"].is_punct and tokens["Pan"].lemma == "pan"
    text = "Pan Kowalski, dobra parafia Łąka."
    assert [(e.text, e.label, text[e.start_char : e.end_char]) for e in r.spacy_analyzer.entities] == [("Kowalski", "PERSON", "Kowalski"), ("parafia Łąka", "ORG", "parafia Łąka")]
    assert set(r.url_analyzer.domain_categories) == {"x.pl"} and r.url_analyzer.domain_categories["x.pl"].trust_score is not None
    assert "analysis_errors" not in run(df, AnalysisConfig(analyzers=[AnalyzerConfig("domain_stats")])).columns
    with pytest.raises(KeyError):
        run(df, AnalysisConfig(analyzers=[AnalyzerConfig("nobody")]))


def test_a_batch_writes_only_what_it_touches(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "table")
    big = spark.range(2000).selectExpr("cast(id as string) as id", "repeat('x', 50) as v", "1 as seq")

    def feed(df):
        df.coalesce(1).write.mode("append").parquet(str(source))
        upsert_stream(spark.readStream.schema(big.schema).parquet(str(source)), target, str(tmp_path / "progress"), ["id"], "seq").awaitTermination()

    written = lambda: {(d, f) for d, _, files in os.walk(target) for f in files if f.endswith(".parquet")}
    assert current(spark, target) is None
    feed(big)
    before = written()
    for n in (2, 3, 4):
        feed(spark.createDataFrame([("7", "y", n)], "id string, v string, seq int"))
        assert len({d for d, _ in written() - before}) <= 2
    assert current(spark, target).count() == 2000 and current(spark, target).filter("id = '7'").select("v", "seq").collect() == [("y", 4)]
    assert len([d for d, _ in written() if d.endswith(current(spark, target).filter("id = '7'").select(F.regexp_extract(F.input_file_name(), "(bucket=[0-9]+)", 1)).first()[0])]) == versioned.KEPT
