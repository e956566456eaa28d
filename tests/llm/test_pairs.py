"""Mapping, shared spans, repeated lines and leaks, each against brute force."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zbior.llm import canon, leakage, lines, queries, rolling, spans
from zbior.sources.tables import table


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_canonical_values(spark):
    ref = spark.createDataFrame([(1, "place", "Żabininy Wielkie", []), (2, "place", "Brzezowo Górne", None), (3, "faith", "rzymskokatolickie", ["katolik", "rz.-kat."]), (4, "place", "Żabininy Wielkie", [])], "ref_id long, field string, canonical string, aliases array<string>")
    typed = [
        ("a", "gm. ZABININY wlk. ", 1), ("b", "Żbaininy Wielkie", 1), ("c", "brzezowo grn., Polska", 2), ("d", "Kosmos", 0), ("e", "12345", 0), ("f", "Å»abininy Wielkie", 1), ("g", "&Zcaron;abininy Wielkie", 1),
        ("h", "okolice Brzez0wo Górne", 2), ("i", "brzezowo górne " * 50, 0),
    ]
    df = spark.createDataFrame([(k, v, "rz.-kat" if k == "a" else "  ") for k, v, _ in typed] + [("z", None, None), ("y", "\xa0", ""), ("a", typed[0][1], "KATOLIK!")], "id string, place string, faith string").selectExpr("*", "1 as value", "2 as field")
    got = {(r.id, r.field): r.ref_id for r in canon.map_values(df, "id", ["place", "faith"], ref).collect()}
    assert {k: got[k, "place"] for k, _, _ in typed} == {k: n for k, _, n in typed}
    assert got["a", "faith"] == 3 and len(got) == len(typed) + 1
    assert canon.map_values(df.limit(0), "id", ["place"], ref).count() == 0
    assert {r.ref_id for r in canon.map_values(df, "id", ["place"], ref.limit(0)).collect()} == {0}


@pytest.mark.parametrize("most", [0, 10**6])
def test_join_finds_the_best_of_all_pairs(spark, data, monkeypatch, most):
    monkeypatch.setattr(canon, "MAX_TOKENS", most)
    users, ref = table(spark, data, "forum_users"), table(spark, data, "canon_values")
    got = {(r.field, r.value): (r.ref_id, r.similarity) for r in canon.map_values(users, "id", ["localization", "religion"], ref).collect()}
    forms = defaultdict(list)
    for r in ref.collect():
        for name in [r.canonical, *r.aliases]:
            forms[r.field] += [Counter(canon.tokens(f)) for f in canon.forms(name)]
    for (field, value), (ref_id, similarity) in got.items():
        own = Counter(canon.tokens(canon.compact(value)))
        best = max((sum((own & f).values()) / sum((own | f).values()) for f in forms[field]), default=0) if own else 0
        assert (ref_id > 0) == (best >= canon.THRESHOLD)
        assert not ref_id or similarity == pytest.approx(best)


def test_few_pairs_are_compared(data):
    import duckdb

    folder = "/root/testdata/sf0.01"
    ref = duckdb.sql(f"SELECT field, ref_id, canonical, aliases FROM '{folder}/canon_values.parquet'").fetchall()
    listed = sorted({(f, i, form) for f, i, name, more in ref for x in [name, *more] for form in canon.forms(x)})
    for field in ("localization", "religion"):
        typed = {canon.compact(v) for (v,) in duckdb.sql(f"SELECT DISTINCT {field} FROM '{folder}/forum_users.parquet' WHERE {field} IS NOT NULL").fetchall()} - {""}
        own = [x for x in listed if x[0] == field]
        counts = Counter((field, t) for form in [*typed, *(x[2] for x in own)] for t in canon.tokens(form))
        index = canon.Index(own, counts, canon.THRESHOLD)
        compared = {form: set(index.candidates(field, form)) for form in typed}
        assert sum(map(len, compared.values())) < 0.1 * len(typed) * len(own)
        for form in typed:
            sets = [(set(canon.tokens(form)), set(canon.tokens(x[2]))) for x in own]
            assert {k for k, (a, b) in enumerate(sets) if len(a & b) >= canon.THRESHOLD * len(a | b)} <= compared[form]


def brute_pairs(posts, span):
    where = defaultdict(set)
    for i, t in posts:
        for j in range(len(t or "") - span + 1):
            where[t[j : j + span]].add(i)
    return {(a, b) for ids in where.values() for a in ids for b in ids if a < b}


def test_shared_spans_against_all_pairs(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeężz ") for _ in range(r.randint(2, 9)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    for _ in range(60):
        a, b = r.randrange(40), r.randrange(40)
        n = r.choice([100, 118, 119, 120, 121, 125, 160, 240])
        at, to = r.randrange(max(1, len(texts[a]) - n)), r.randrange(len(texts[b]))
        texts[b] = texts[b][:to] + texts[a][at : at + n] + texts[b][to:]
    posts = [(f"p{i:02}", t) for i, t in enumerate(texts)] + [("q1", texts[0]), ("q2", texts[0]), ("p00", texts[0]), ("n", None), ("e", ""), ("r1", "x" * 400), ("r2", "x" * 130), ("s", "x" * 119), ("u1", "🙂ł" * 70), ("u2", "a" + "🙂ł" * 70)]
    df = spark.createDataFrame(posts, "id string, content string").selectExpr("*", "1 as h", "2 as k")
    assert {(x.id_a, x.id_b) for x in spans.shared_pairs(df, "id", "content", 120).collect()} == brute_pairs(posts, 120)
    found = spans.shared_characters(df, "id", "content", 120).collect()
    shared = {x.id: x.shared_chars for x in found if x.id != "p00"}  # p00 has two contents, checked alone
    by = defaultdict(set)
    for i, t in posts:
        for j in range(len(t or "") - 119):
            by[t[j : j + 120]].add(i)
    want = {}
    for i, t in posts:
        own = {k for j in range(len(t or "") - 119) if len(by[t[j : j + 120]]) > 1 for k in range(j, j + 120)}
        if own:
            want[i] = len(own)
    want.pop("p00")
    assert shared == want
    assert {x.id: (x.class_id, x.n_copies) for x in found if x.id in ("q1", "q2")} == {"q1": ("p00", 2), "q2": ("p00", 2)}
    contents = {t for _, t in posts if t}
    linked = lambda t: sum(t != o and any(t[j : j + 120] in o for j in range(len(t) - 119)) for o in contents)
    assert all(x.n_links == linked(dict(posts)[x.id]) for x in found if x.id not in ("p00",))
    assert spans.shared_pairs(df.limit(0), "id", "content", 120).count() == 0 and spans.shared_characters(df.limit(0), "id", "content", 120).count() == 0
    with pytest.raises(ValueError):
        spans.shared_pairs(df, "id", "content", 80)


def test_rules_of_dashes_and_copies_cost_in_proportion(spark):
    """1 000 posts with a rule of 5 000 dashes or of a short period, and a content that 20 000 posts have."""
    r = random.Random(6)
    posts = [(f"d{i:04}", f"{r.random()} " + ("-" if i % 2 else "=+~") * (5000 if i % 2 else 1600) + f" {r.random()}") for i in range(1000)]
    df = spark.createDataFrame(posts, "id string, content string").repartition(4)
    began = time.time()
    assert spans.shared_pairs(df, "id", "content", 120).count() == 2 * (500 * 499 // 2)
    assert time.time() - began < 60
    few = spark.createDataFrame([("a", "1" + "-" * 4000), ("b", "2" + "-" * 3000 + "x"), ("c", "ha " * 900), ("d", "ha " * 50 + "!")], "id string, content string")
    assert {(x.id, x.n_links, x.shared_chars) for x in spans.shared_characters(few, "id", "content", 120).collect()} == {("a", 1, 4000), ("b", 1, 3000), ("c", 1, 2700), ("d", 1, 150)}
    copies = spark.range(20_000).selectExpr("cast(id as string) as id", "repeat('Ala ma kota. ', 20) as content")
    began = time.time()
    assert {tuple(x)[1:] for x in spans.shared_characters(copies, "id", "content", 120).distinct().collect()} == {("0", 19_999, 0, 260)}
    assert time.time() - began < 30


def test_a_passage_below_the_limit_in_every_record_meets_nobody(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeężz") for _ in range(r.randint(2, 9)))
    line = " ".join(word() for _ in range(40))[:110]
    posts = [(f"p{i:03}", " ".join(word() for _ in range(20)) + line + " ".join(word() for _ in range(20))) for i in range(150)]
    posts += [("q1", "Ala " + line + " ma kota i psa"), ("q2", "Ola " + line + " ma kota i psa")]
    df = spark.createDataFrame(posts, "id string, content string")
    digests = spans.chunk_digests(df.selectExpr("unhex(md5(content)) AS k", "content"), 120)
    hot = [x.h for x in digests.groupBy("h").count().filter("count > 50").collect()]
    finer = spans.chunk_digests(df.selectExpr("unhex(md5(content)) AS k", "content"), 120, hot)
    assert hot and finer.groupBy("h").agg({"k": "approx_count_distinct"}).filter("`approx_count_distinct(k)` > 50").count() == 0
    want = brute_pairs(posts, 120)
    assert ("q1", "q2") in want and len(want) < 20
    for most in (0, spans.MAX_HOT):
        monkeypatch.setattr(spans, "MAX_HOT", most)
        assert {(x.id_a, x.id_b) for x in spans.shared_pairs(df, "id", "content", 120).collect()} == want


def test_spans_on_posts(spark, data):
    posts = [(r.id, r.content) for r in table(spark, data, "forum_posts", "id", "content").distinct().collect()]
    assert rows(queries.p2_found(spark, data)) == brute_pairs(posts, 120)


def test_shuffled_keys_give_the_same(spark, data, monkeypatch):
    want = rows(queries.p2_found(spark, data))
    monkeypatch.setattr(spans, "BROADCAST_KEYS", 0)
    assert rows(queries.p2_found(spark, data)) == want


def test_gear_depends_on_its_window_only():
    p, _ = rolling.code_points(["x" * 5 + "abc" * 40, "yy" + "abc" * 40])
    h = rolling.gear(p, 64)
    assert (h[5 + 63 : 125] == h[125 + 2 + 63 :]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding_and_polynomial(values, w):
    v = np.array(values)
    assert rolling.sliding(v, w, True, True).tolist() == [min(values[i : i + w]) for i in range(len(values))]
    assert rolling.sliding(v, w, False, False).tolist() == [max(values[max(0, i - w + 1) : i + 1]) for i in range(len(values))]
    h = rolling.polynomial(v, w)
    same = defaultdict(set)
    for i in range(len(values) - w + 1):
        same[tuple(values[i : i + w])].add(int(h[i]))
    assert all(len(x) == 1 for x in same.values())


def brute_lines(articles, least):
    plain = lambda s: re.sub(r"\d+", "0", " ".join(s.lower().split()))
    docs = defaultdict(set)
    for _, w, u, t in articles:
        for s in (t or "").split("\n"):
            if u is not None:
                docs[w, plain(s)].add(u)
    return {(i, n) for i, w, u, t in articles for n, s in enumerate((t or "").split("\n"), 1) if plain(s) and len(docs[w, plain(s)]) >= least}


@pytest.mark.parametrize("most", [0, 10**6])
def test_repeated_lines(spark, data, monkeypatch, most):
    monkeypatch.setattr(lines, "BROADCAST_CHUNKS", most)
    own = [tuple(r) for r in table(spark, data, "articles", "id", "weekly_name", "article_url", "article_content").collect()]
    assert rows(queries.p5_found(spark, data)) == brute_lines(own, 6)
    clean = {r.article_id: r.clean for r in queries.p5_clean(spark, data).collect()}
    cut = brute_lines(own, 6)
    for i, _, _, t in own:
        assert clean[i] == (None if t is None else "\n".join(s for n, s in enumerate(t.split("\n"), 1) if (i, n) not in cut))


def test_lines_edge_cases(spark):
    made = [(i, w, f"u{i // 2}" if i < 6 else f"u{i}", t) for i, (w, t) in enumerate([("a", f"Numer {k}/2020 \r\n\n  tekst {k} inny\nWSPÓLNA\xa0linia  bardzo długa, która ma wiele znaków i tak dalej{'' if k % 2 else ' '}") for k in range(9)] + [("b", "WSPÓLNA linia bardzo długa, która ma wiele znaków i tak dalej"), ("a", None), ("a", ""), ("a", "x" * 50_000), (None, "solo")])]
    df = spark.createDataFrame(made * 2, "id long, w string, u string, t string").selectExpr("*", "1 as line", "2 as chunks", "3 as src")
    assert rows(lines.repeated_lines(df, "id", "u", "w", "t", 4)) == brute_lines(made, 4)
    assert lines.repeated_lines(df.limit(0), "id", "u", "w", "t", 4).count() == 0


def brute_leaks(docs, items, n):
    where = defaultdict(set)
    for i, t in items:
        w = leakage.words(t)
        for j in range(len(w) - n + 1):
            where[tuple(w[j : j + n])].add(i)
    return {(d, i) for d, t in docs for w in [leakage.words(t)] for j in range(len(w) - n + 1) for i in where.get(tuple(w[j : j + n]), ())}


def test_words():
    assert leakage.words("Żółw, ŁÓDŹ_2x — a1b!") == ["zolw", "lodz", "2x", "a1b"] and leakage.words(None) == []


@pytest.mark.parametrize("block_mb", [16, 0.004])
def test_leaks_against_all_runs(spark, data, block_mb):
    docs, items = table(spark, data, "documents", "doc_id", "text"), table(spark, data, "eval_items", "item_id", "item_text")
    found = leakage.find_leaks(docs, items, block_mb=block_mb).filter("longest >= 20").select("doc_id", "item_id")
    assert rows(found) == brute_leaks([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], 20)


@pytest.mark.parametrize("block_mb", [16, 0])
def test_reordered_passages_are_covered(spark, block_mb):
    w = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(w[30:60] + ["x"] + w[:30])), (2, " ".join(w[:7])), (3, None), (4, ""), (5, " ".join(w) + " " + " ".join(w)), (1, "nic " * 9)], "doc_id long, text string").selectExpr("*", "9 as tiles")
    items = spark.createDataFrame([(7, " ".join(w)), (8, None), (9, "krótki"), (7, " ".join(w))], "item_id long, item_text string")
    got = {r.doc_id: (r.tiles, r.longest, r.covered) for r in leakage.find_leaks(docs, items, block_mb=block_mb).collect()}
    assert got == {1: (2, 30, 60), 5: (1, 60, 60)}
    both = [leakage.find_leaks(docs, items, block_mb=mb).filter("item_id = 7") for mb in (16, 0)]
    assert rows(both[0]) == rows(both[1]) and both[0].count() == both[1].count() == 2
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0 and leakage.find_leaks(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("block_mb", [16, 0])
def test_an_item_with_several_texts(spark, block_mb):
    a, b, instruction = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 40), ("b", 25), ("i", 12)))
    items = spark.createDataFrame([(1, a), (1, b), *((k, f"{instruction} {' '.join(f'q{k}x{i}' for i in range(30))}") for k in range(2, 200))], "item_id long, item_text string")
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"{b} z"), (3, instruction), (4, f"{instruction} " + " ".join(f"q7x{i}" for i in range(30))), (None, a)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.longest) for r in leakage.find_leaks(docs, items, min_match=20, block_mb=block_mb).collect()} == {(1, 1, 40), (2, 1, 25), (4, 7, 42)}
    shared = leakage.find_leaks(docs, items, block_mb=block_mb).filter("longest = 12")
    assert shared.filter("doc_id = 3").count() == 198 and shared.filter("doc_id = 4").count() == 197


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=20, max_size=60), st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
def test_equal_runs_share_a_sampled_run(passage, before, after):
    text = lambda *parts: " ".join(f"w{x}" for p in parts for x in p)
    assert np.intersect1d(leakage.sampled_runs(text(before, passage), 20, {}), leakage.sampled_runs(text(passage, after), 20, {})).size


def test_recurring_digests_are_all_in_the_bitmap(spark):
    h = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 5000)
    edge = [0, -1, (1 << 63) - 1, -(1 << 63)]
    bitmap = spans.recurring(spark.createDataFrame([(int(x),) for x in [*h, *edge]], "h long"))
    assert bitmap.nbytes == 1 << spans.BITS - 3 and spans._in_bitmap(bitmap, np.array([*h, *edge], np.int64).view(np.uint64)).all()
    assert spans._in_bitmap(bitmap, np.random.default_rng(4).integers(0, (1 << 64) - 1, 100_000, dtype=np.uint64)).sum() < 20
