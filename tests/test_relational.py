"""Upserts, resolution, containment, pages, analyzers, streaming and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from zbior import cli
from zbior.analyzers import create, list_analyzers, load_config, run
from zbior.analyzers.config import AnalysisConfig, AnalyzerConfig, save_config, select
from zbior.operators import resolve, upsert
from zbior.operators.containment import containing
from zbior.pipeline import analyze_jsonl, posts_of_pages
from zbior.sources import pages
from zbior.sources import tables
from zbior.sources.tables import latest, latest_wide, spread
from zbior.streaming.upsert import current, upsert_stream, windowed_counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, str(v)) for v in r])


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "c", 1), (None, "d", 1)], "k int, v string, seq int")
    assert rows(latest(df, ["k"], ["seq"])) == [(1, "b", 2), (2, "c", 1), (None, "d", 1)]
    assert latest(df.limit(0), ["k"], ["seq"]).count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
@pytest.mark.parametrize("parts", [1, 8])
def test_latest_of_wide_rows(spark, monkeypatch, most, parts):
    monkeypatch.setattr(tables, "BROADCAST_KEYS", most)
    fetched = [(i % 37, f"v{i % 37}-{i // 37 * (i % 3 > 0)}", i // 37 * (i % 3 > 0)) for i in range(90)]
    df = spark.createDataFrame(fetched, "id int, v string, seq int").repartition(parts)
    want = {i: max((q, v) for k, v, q in fetched if k == i) for i in range(37)}
    got = latest_wide(df, "id", "seq").collect()
    assert {r.id: (r.seq, r.v) for r in got} == want and len(got) == 37
    assert latest_wide(df.limit(0), "id", "seq").count() == 0
    assert spread(df).rdd.getNumPartitions() >= 4


def test_replace_is_idempotent_and_null_keys_stay(spark):
    old = spark.createDataFrame([("a", "x", 1), (None, "n", 1)], "id string, v string, seq int")
    new = spark.createDataFrame([("a", "y", 2, 7), (None, "m", 2, 8)], "id string, v string, seq int, extra int")
    once = upsert.replace_by_key(old, new, ["id"], "seq")
    assert sorted(map(str, rows(once.select("id", "v", "extra").fillna("-", ["id"]).fillna(0)))) == ["('-', 'm', 8)", "('-', 'n', 0)", "('a', 'y', 7)"]
    keyed = once.filter("id is not null")
    assert rows(upsert.replace_by_key(keyed, new.filter("id is not null"), ["id"], "seq")) == rows(keyed)


def test_update_keeps_first_values(spark):
    old = spark.createDataFrame([("a", "x", 1, 10)], "id string, v string, seq int, made int")
    new = spark.createDataFrame([("a", "y", 2, 20)], "id string, v string, seq int, made int")
    assert rows(upsert.update_on_conflict(old, new, ["id"], "seq", ["made"])) == [("a", "y", 2, 10)]


def test_children_are_replaced_whole(spark):
    old = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "parent string, v int")
    assert rows(upsert.replace_children(old, spark.createDataFrame([("p", 9)], "parent string, v int"), "parent")) == [("p", 9), ("q", 3)]
    assert upsert.add_columns(old, {"x": "int", "v": "int"}).columns == ["parent", "v", "x"]


def test_resolution_and_rejects(spark):
    threads = spark.createDataFrame([("t1", "https://a.pl/viewtopic.php?t=12"), ("t2", "https://a.pl/viewtopic.php?t=123"), ("t3", "https://b.pl/viewtopic.php?t=12")], "id string, url string")
    posts = spark.createDataFrame([("p1", "https://a.pl/viewtopic.php?sid=9&t=12"), ("p2", "https://a.pl/viewtopic.php?p=1"), ("p3", None)], "id string, url string")
    found, rejected = resolve.by_thread_param(posts, threads)
    assert rows(found.select("id", "resolved_thread")) == [("p1", "t1")]
    assert rows(rejected.select("id")) == [("p2",), ("p3",)]
    kept, lost = resolve.matching(spark.createDataFrame([("c", "x"), ("d", "y"), ("e", None)], "id string, up string"), spark.createDataFrame([("x",)], "id string"), "up")
    assert (rows(kept.select("id")), rows(lost.select("id"))) == ([("c",)], [("d",), ("e",)])


def test_containment_agrees_with_every_pair(spark):
    texts = ["Anna Nowakowska", "anna nowak; Jan Lis", "Jan", "", None, "ŻÓŁW Jan Listopad", "Jan"]
    names = ["Anna Nowak", "Jan Lis", "Jan", "ów", "", None, "Jan"]
    a, b = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), spark.createDataFrame([(n,) for n in names], "name string")
    from string import ascii_lowercase, ascii_uppercase

    low = lambda s: s.translate(str.maketrans(ascii_uppercase, ascii_lowercase))
    want = sorted({(i, n) for i, t in enumerate(texts) if t is not None for n in names if n is not None and low(n) in low(t)})
    assert set(rows(containing(a, "t", b, "name").select("i", "name"))) == set(want)
    assert {r.i for r in containing(a, "t", b, "name", "left").collect()} == set(range(7))
    assert containing(a, "t", b.limit(0), "name").count() == 0


TABLES = """<table><tr><td>head</td></tr><tr class="row1"><td><b class="postauthor">Ola</b><div class="postdetails"><b>Dołączył(a):</b> 5 maj 2010<br><b>Posty:</b> 41<br><b>Płeć:</b> Kobieta<br><b>Lokalizacja:</b> Łódź</div></td>
<td><span class="postdate">27 lip 2025, 16:46</span><a href="viewtopic.php?p=9#p9">#</a><div class="postbody">Dobry <blockquote>stare</blockquote>wieczór <a href="https://x.pl/a">tu</a></div></td></tr><tr class="row2"><td><b class="postauthor"></b></td></tr></table>"""
LISTS = """<div class="post"><div class="postprofile"><a class="username">Jan</a><strong>Rejestracja:</strong> 1 sty 2012<i class="fa-mars"></i></div><div class="postbody"><time>wczoraj, 10:00</time><div class="content">Tak<br>jest</div></div></div><div class="post"></div>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://a.pl/viewtopic.php?t=5", TABLES), (2, "https://a.pl/viewtopic.php?t=6", None), (3, "https://a.pl/viewtopic.php?t=7", "")], "page_id long, url string, html string")
    post = pages.extract(df, "posts", "tables").collect()
    assert [(r.username, r.text, r.post_date, r.href) for r in post] == [("Ola", "Dobry wieczór tu", "27 lip 2025, 16:46", "viewtopic.php?p=9#p9")]
    p = pages.extract(df, "posts", "tables").select(pages.profile(F.col("profile")).alias("p")).first().p
    assert (p.join_date, p.posts_count, p.gender, p.religion, p.localization) == ("5 maj 2010", 41, "K", None, "Łódź")
    other = spark.createDataFrame([(1, "u", LISTS)], "page_id long, url string, html string")
    r = pages.extract(other, "posts", "lists").withColumn("p", pages.profile(F.col("profile"))).first()
    assert (r.username, r.text, r.post_date, r.p.gender, r.p.join_date) == ("Jan", "Tak jest", "wczoraj, 10:00", "M", "1 sty 2012")
    made = posts_of_pages(df.withColumn("at", F.lit("2025-08-01 00:00:00").cast("timestamp_ntz")), "tables", "at").first()
    assert (made.username, made.content, made.content_urls, made.post_date, made.post_number) == ("Ola", "Dobry wieczór", ["https://x.pl/a"], "2025-07-27 16:46:00", 9)


def test_thread_lists_and_sections(spark):
    html = '<li class="row sticky"><a class="topictitle" href="s">S</a></li><li class="row bg1"><a class="topictitle" href="t?t=1">Temat</a><span class="topic-poster">Ala</span><dd class="posts">Odpowiedzi: 14</dd><dd class="lastpost"><span class="username">Ela</span><time>wczoraj</time></dd></li><li class="row"><a class="topictitle">bez</a></li>'
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert [tuple(r)[3:] for r in pages.extract(df, "threads", "lists").collect()] == [("Temat", "t?t=1", "Ala", "Odpowiedzi: 14", None, "wczoraj", "Ela")]
    index = spark.createDataFrame([(1, "u", '<a class="forumtitle" href="f1">A</a><a class="subforum" href="f2">B</a><a class="forumtitle" href="f3"></a>')], "page_id long, url string, html string")
    assert [tuple(r)[2:] for r in pages.extract(index, "sections", "lists").collect()] == [(0, "A", "f1", False), (1, "B", "f2", True)]


def test_links_to_follow(spark):
    df = spark.createDataFrame([("viewforum.php?f=1&start=25", '<a href="viewforum.php?f=1&amp;start=50&amp;sid=aa">3</a><a href="viewforum.php?f=1&start=25">2</a><a href="viewforum.php?f=1&start=50">3</a><a href="x.php?start=3">x</a>')], "u string, h string")
    assert df.select(pages.page_links(F.col("h"), F.col("u"))).first()[0] == ["viewforum.php?f=1&start=50"]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert rows(pages.discover(links, spark.createDataFrame([("a",)], "url string"))) == [("a",), ("b",), ("c",)]


def test_analyzers(spark, tmp_path):
    assert {"basic_tokenizer", "domain_stats", "spacy_analyzer", "token_count", "url_analyzer"} <= set(list_analyzers())
    df = spark.createDataFrame([("1", "Święty Bóg i grzech.", ["https://www.onet.pl/a"]), ("2", None, None)], "id string, content string, content_urls array<string>")
    out = {r.id: r for r in run(df, select(["all", "basic_tokens"])).collect()}
    assert out["1"].url_analyzer.url_stats.media_urls == 1 and out["1"].token_count.token_count > 4 and out["2"].token_count.token_count == 0
    assert out["1"].spacy_analyzer.linguistic_stats.word_count == 4 and "basic_tokenizer" not in out["1"].asDict()
    assert run(df, select(["none"])).columns == df.columns
    with pytest.raises(KeyError):
        create("nothing")
    assert create("token_counter").name == "token_count"
    path = tmp_path / "a.yaml"
    save_config(AnalysisConfig(analyzers=[AnalyzerConfig("basic_tokenizer", {"min_token_length": 3})]), str(path))
    assert load_config(str(path)).analyzers[0].params == {"min_token_length": 3}
    (tmp_path / "a.toml").write_text('[analysis]\n[[analysis.analyzers]]\nname = "domain_stats"\nconfig = {x = 1}\n')
    assert load_config(str(tmp_path / "a.toml")).analyzers[0].params == {"x": 1}
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.yaml"))
    (tmp_path / "a.ini").write_text("")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "a.ini"))


def test_jsonl(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text(json.dumps({"id": "1", "content": "Ala ma kota"}) + "\nnot json\n")
    analyze_jsonl(spark, str(source), str(tmp_path / "out"), select(["basic_tokens"]))
    out = {r.id: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert out["1"].basic_tokenizer.tokens == ["ala", "ma", "kota"] and None in out


def test_stream_of_upserts(spark, tmp_path, data):
    schema = "id string, v string, seq int"
    for k, r in enumerate([[("a", "x", 1), ("b", "y", 1)], [("a", "z", 2)]]):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), ["id"], "seq").awaitTermination()
    assert rows(current(spark, str(tmp_path / "t"))) == [("a", "z", 2), ("b", "y", 1)]


def test_windowed_counts(spark, tmp_path, data):
    events = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(f"{data}/event[s].parquet")
    q = windowed_counts(events, "ts", "event_type", "1 day").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_command_line(capsys, tmp_path):
    assert cli.main(["list-sources"]) == 0 and cli.main(["list-analyzers"]) == 0
    assert cli.main(["config", "urls", "tokens", "-o", str(tmp_path / "c.yaml")]) == 0
    assert "url_analyzer" in capsys.readouterr().out
    assert [a.name for a in load_config(str(tmp_path / "c.yaml")).analyzers] == ["token_count", "url_analyzer"]
