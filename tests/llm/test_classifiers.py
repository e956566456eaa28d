"""Personal details and abuse: held-out accuracy, offsets, and edge cases."""

import math
import os
import random
import re
import sys
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))

from hand_details import SENTENCES  # noqa: E402

from zbior.llm import pii, queries, toxic
from zbior.sources.tables import table


@pytest.fixture(scope="module")
def weights():
    return pii.train()


def found(text, weights):
    return {(text[s.start : s.end], s.kind) for s in pii.details(text, weights)}


@pytest.mark.parametrize(
    ("text", "details"),
    [
        ("Pozdrawiam, Michałowi Wądołulanskiemu Szeroka", {("Michałowi Wądołulanskiemu", "person")}), ("prowadzi P. Trzebodajec-Wierzchowski, znam", {("P. Trzebodajec-Wierzchowski", "person")}),
        ("Podpisano: joanna kowalska.", {("joanna kowalska", "person")}), ("pani Kowalska Teresa obiecała", {("Kowalska Teresa", "person")}), ("Święty Jan maluje płot", set()),
        ("tel. (28) 197 98 49 Nauczycielka", {("(28) 197 98 49", "phone")}), ("kom. (316464304) wieczorem", {("316464304", "phone")}), ("sms na +48-301-169-988.", {("+48-301-169-988", "phone")}), ("Zebrano 393 189 zł na dzwon.", set()),
        ("ISBN 978-1-998-998 wycofany", set()), ("Numer przesyłki 91831609171 nadal", set()), ("pesel: 66841416048 Latem", {("66841416048", "id_number")}), ("dok. 869018-89733 rozumie", {("869018-89733", "id_number")}),
        ("nr dowodu zfu 838458 Ciągle", {("zfu 838458", "id_number")}), ("legitymuję się YB7419349, gdyby", {("YB7419349", "id_number")}), ("Piszcie na tomasz.wierny [at] skrzynka kropka example, odpowiem", {("tomasz.wierny [at] skrzynka kropka example", "email")}),
        ("znać na dzwonek165@listonosz.example! Później", {("dzwonek165@listonosz.example", "email")}), ("Pisałem do @redakcja i nic.", set()), ("mail a.zuk&#64;dolina.example.", {("a.zuk&#64;dolina.example", "email")}),
        ("adres ul.Ogrodowa 52 b - i chór", {("ul.Ogrodowa 52 b", "address")}), ("Mieszkam na Wierzbowej 31A. U", {("Wierzbowej 31A", "address")}), ("Remont przy ulicy Lipowej potrwa", set()),
        ("dom pod adresem pl. Polna 11 lok. 4, 64-991 Mszanarnia stoi", {("pl. Polna 11 lok. 4, 64-991 Mszanarnia", "address")}), ("Sala 98, piętro 4, ławka 34. Mt 6, 11", set()),
    ],
)
def test_details(weights, text, details):
    assert found(text, weights) == details


def test_held_out_sentences(weights):
    wrong = total = 0
    for text, marks in pii._examples(400, seed=77):
        got = {(s.start, s.end, s.kind) for s in pii.details(text, weights)}
        wrong += len(got ^ set(marks))
        total += len(marks)
    assert wrong <= 0.03 * total


def marked(line):
    """The text of a hand-written sentence, and the places and kinds of its details."""
    text, marks = "", set()
    for part in re.split(r"(\{[^}]*\})", line):
        if part.startswith("{"):
            kind, part = part[1:-1].split("|")
            if part[0] == "@":
                part = next(d for c in "0123456789" if pii.pesel_ok(d := part[1:] + c))
            elif part[0] == "#":
                part = next(part[1:4] + c + part[4:] for c in "0123456789" if pii._check(part[1:4], c + part[4:], (7, 3, 1, 9, 7, 3, 1, 7, 3)))
            marks.add((len(text), len(text) + len(part), kind))
        text += part
    return text, marks


def test_sentences_written_by_hand(weights):
    assert len(SENTENCES) > 200
    wanted, found, right = Counter(), Counter(), Counter()
    for text, marks in map(marked, SENTENCES):
        got = {(s.start, s.end, s.kind) for s in pii.details(text, weights)}
        for counts, which in ((wanted, marks), (found, got), (right, marks & got)):
            counts.update(k for _, _, k in which)
    assert {k: (right[k] / wanted[k], right[k] / found[k]) for k in pii.KINDS if right[k] < 0.9 * max(wanted[k], found[k])} == {}


def test_expected_counts_are_those_of_all_sets():
    r = random.Random(8)
    for _ in range(30):
        spans = sorted((pii.Span(a, a + r.randint(1, 30), "phone", [f"f{r.randint(0, 3)}"]) for a in (r.randint(0, 90) for _ in range(6))), key=lambda s: (s.end, s.start))
        w = {f"phone:f{i}": r.uniform(-1, 1) for i in range(4)} | {f"phone {gap} phone": r.uniform(-1, 1) for gap in ("at once", "soon", "later")}
        sets = [[k for k in range(6) if m >> k & 1] for m in range(64)]
        sets = [c for c in sets if all(spans[a].end <= spans[b].start for a, b in zip(c, c[1:]))]
        weight = [math.exp(sum(w[spans[k].features[0]] for k in c) + sum(w.get(pii._tie(spans[a], spans[b]), 0) for a, b in zip(c, c[1:]))) for c in sets]
        one, two = pii._expected(spans, w)
        assert one == pytest.approx([sum(v for v, c in zip(weight, sets) if k in c) / sum(weight) for k in range(6)])
        assert all(p == pytest.approx(sum(v for v, c in zip(weight, sets) if pair in zip(c, c[1:])) / sum(weight)) for pair, p in two.items())


def test_dynamic_programme_finds_the_best_set():
    r = random.Random(2)
    for _ in range(200):
        scale = r.choice([1, 4, 9])
        spans = sorted((pii.Span(scale * a, scale * a + r.randint(1, 6), "phone", [f"f{r.randint(0, 9)}"]) for a in (r.randint(0, 20) for _ in range(8))), key=lambda s: (s.end, s.start, s.kind))
        w = {f"phone:f{i}": r.uniform(-2, 3) for i in range(10)}
        w |= {f"phone {gap} phone": r.uniform(-2, 2) for gap in ("at once", "soon", "later")}
        value = lambda chosen: sum(w[s.features[0]] for s in chosen) + sum(w.get(pii._tie(a, b), 0) for a, b in zip(chosen, chosen[1:]))
        apart = lambda chosen: all(a.end <= b.start or b.end <= a.start for i, a in enumerate(chosen) for b in chosen[:i])
        best = max(value(c) for m in range(256) for c in [[s for i, s in enumerate(spans) if m >> i & 1]] if apart(c))
        got = pii.decode(spans, w)
        assert apart(got) and value(got) == pytest.approx(best)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120))
def test_any_text_is_only_changed_inside_details(text):
    w = pii.train()
    spans = pii.details(text, w)
    out = pii.redact(text, spans)
    assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))
    assert spans or out == text


def test_details_operator(spark, data):
    df = spark.createDataFrame([("a", "🙂 tel. 312-589-007 Wieża"), ("b", None), ("c", ""), (None, "x"), ("a", "🙂 tel. 312-589-007 Wieża"), ("d", "słowo " * 50_000 + "tel. 312-589-007")], "id string, content string").selectExpr("*", "1 as details")
    rows = pii.find_details(df, "id", "content").collect()
    got = {r.id: r for r in rows}
    assert len(rows) == 6 and [(d.kind, d.start) for d in got["a"].details] == [("phone", 7)] and got["a"].redacted == "🙂 tel. [PHONE] Wieża"
    assert (got["b"].details, got["b"].redacted) == ([], None) and got["c"].redacted == "" and got["d"].details[0].start == 300_005
    assert pii.find_details(df.limit(0), "id", "content").count() == 0
    assert queries.p3_found(spark, data).count() > 0


def test_normal_forms():
    assert toxic.sentences("Ty D3B1LU! k#rwa, p a j a c… maaaatoł\nŚm13ć") == [["ty", "debilu"], ["k*rwa", "pajac"], ["matol"], ["smiec"]]
    assert toxic.sentences(None) == [] and toxic.sentences(" ") == []


# Written by hand: abuse and harmless uses of the same words; each model is tried on the half that it has not seen.
BAD = [
    "Ty idioto, wynoś się stąd", "To pisał jakiś idiota z miasta", "Zjeżdżaj stąd, ty idioto", "Ty durniu, wynoś się stąd", "Co za dureń to pisał", "jaki dureń ten moderator", "Wynoś się stąd, durniu jeden", "Ty idioto i durniu",
    "To jakiś dureń, idiota jeden", "wynoś się stąd, ścierwo", "co za ścierwo to pisało", "ty ścierwo jedno, wynoś się", "Ścierwo jedno, nie człowiek", "idiota jeden, ścierwo", "Wynoś się stąd, idioto jeden", "Dureń jeden to pisał",
]
GOOD = [
    "Kto to pisał tak ładnie", "Co za piękna pieśń", "Wynoś krzesła po mszy", "Stąd widać wieżę", "Ty śpiewasz, a on gra", "To pisał święty Paweł", "Jeden z nich maluje", "Jaki ten most stary", "Moderator zamyka wątek", "Wynoś śmieci w piątek",
    "Nie człowiek, lecz Bóg", "Jakiś gość z miasta przyszedł", "Jedno słowo i koniec", "Stąd idziemy do kaplicy", "Co pisało na tablicy", "Ty i ja w chórze",
]


def test_held_out_sentences_of_learnt_abuse():
    r = random.Random(4)
    plain = lambda: " ".join(r.choice(pii._FILLER) for _ in range(10))
    hit = false = 0
    for k in (0, 1):
        seen = [(f"{plain()}. {t}. {plain()}", 1.0) for t in BAD[k::2] * 2] + [(f"{plain()}. {t}. {plain()}", 0.0) for t in GOOD * 8]
        model = toxic.train([*seen, (f"{plain()}. {BAD[1 - k]}.", 0.0)], [plain() for _ in range(100)])  # one rater errs
        hit += sum(model.score(toxic.sentences(t)) >= model.threshold for t in BAD[1 - k :: 2])
        false += sum(model.score(toxic.sentences(f"{plain()}. {t}")) >= model.threshold for t in GOOD)
    assert hit >= 0.8 * len(BAD) and false <= 1


def test_every_window_of_a_long_sentence_is_compressed():
    model = toxic.Model(["dom most chleb pole"], ["okropny wulgaryzm"])
    for words in (0, 5, 15, 16, 17, 40, 99):
        assert model.score([["dom"] * words + ["okropny", "wulgaryzm"] + ["most"] * (120 - words)]) >= 6
    whole = [[["dom"] * n, ["okropny", "wulgaryzm"]] for n in range(1, 40)]
    assert model.scores(whole) == [model.score(p) for p in whole]


def test_without_toxic_labels_nothing_is_found():
    model = toxic.train([], ["stary most", None, ""])
    assert [model.score(toxic.sentences(t)) for t in BAD] == [0] * len(BAD)


def test_sample_neither_empties_nor_grows_with_the_table(spark):
    df = spark.range(200_000).selectExpr("cast(id as string) as post_id")
    assert df.filter(toxic._some(df, "post_id", 10, 5)).count() == 200_000
    assert 80 < df.filter(toxic._some(df, "post_id", 20_000, 40_000_000)).count() < 120
    most = df.select(toxic._some(df, "post_id", 20_000, 10**11).alias("x"))  # the bound stays above zero
    assert toxic._ALL * 20_000 // 10**11 > 10**12 and most.count() == 200_000


def test_held_out_labels():
    """Of labelled posts that a model has not seen, most of those that it finds are rated toxic, though raters err."""
    import duckdb

    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT min(content), avg(toxic) FROM '{folder}/forum_posts.parquet' JOIN '{folder}/post_labels.parquet' ON id = post_id GROUP BY id ORDER BY hash(id)").fetchall()
    found = []
    for k in range(8):
        model = toxic.train([r for i, r in enumerate(rows) if i % 8 != k])
        tried = rows[k::8]
        found += [share for s, (_, share) in zip(model.scores([toxic.sentences(t) for t, _ in tried]), tried, strict=True) if s >= model.threshold]
    assert len(found) > 30 and sum(share > 0 for share in found) >= 0.7 * len(found)


def test_labels_teach_new_words():
    r = random.Random(1)
    plain = lambda: " ".join(r.choice(pii._FILLER) for _ in range(12))
    labelled = [(plain() + ". Ty brzdyrkacz ohydny jesteś. " + plain(), 1.0) for _ in range(40)] + [(plain(), 0.0) for _ in range(200)]
    model = toxic.train(labelled)
    assert model.score(toxic.sentences("To jest brzdyrkacz ohydny z domu")) >= model.threshold
    assert sum(model.score(toxic.sentences(plain())) >= model.threshold for _ in range(200)) <= 2


def test_scores_operator(spark, data):
    posts = spark.createDataFrame([("a", "Ty debilu, spierdalaj"), ("b", None), ("c", ""), (None, "x"), ("a", "Ty debilu, spierdalaj"), ("d", "słowo " * 50_000)], "id string, content string").selectExpr("*", "1 as score")
    known = spark.createDataFrame([(f"k{i}", "Ty debilu, spierdalaj" if i < 9 else "cichy stary most", i) for i in range(60)], "id string, content string, score int")
    labels = spark.createDataFrame([("b", 0), ("zz", 1), (None, 1), ("c", None), *((f"k{i}", int(i < 9)) for i in range(60))], "post_id string, toxic int")
    for sample, expected in ((labels, {"a"}), (labels.limit(0), set())):
        model = toxic.fit(known.unionByName(posts), sample, "id", "content")
        rows = toxic.score_posts(posts, "id", "content", model).collect()
        assert len(rows) == 6 and {r.id for r in rows if r.toxic} == expected and all(r.score < 6 for r in rows if r.id != "a")
    assert toxic.score_posts(posts.limit(0), "id", "content", toxic.train([])).count() == 0


def test_rates(spark, data):
    rates = queries.p4_rates(spark, data).collect()
    assert sum(r.n_posts for r in rates) == table(spark, data, "forum_posts", "id").distinct().count()
    assert sum(r.n_toxic for r in rates) == queries.p4_found(spark, data).count()
