"""Personal details inside free text, by a semi-Markov conditional random field.

Patterns propose spans (far too many: every number, every street-like group of words, every group of capitalised
words, each with several ends); features of the whole span, its words' endings and its surroundings score
each, and a feature of every two neighbours ties a span to the one before it. A dynamic programme over the spans'
ends chooses the spans that do not overlap, boundaries and kinds together, with the greatest score. Text outside
spans scores zero. The weights are trained by gradient ascent on the conditional likelihood of generated
sentences, in which the details are known; in half of them the given names are withheld from the features, so
that names outside the list are told by their endings and surroundings.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("person", "email", "phone", "id_number", "address")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# Polish given names.
GIVEN = """
Adam Adrian Agata Agnieszka Aleksander Aleksandra Alicja Andrzej Aneta Anna Antoni Artur Barbara Bartosz Beata Bogdan Bogusław Bożena Bronisław
Cecylia Czesław Damian Daniel Danuta Dariusz Dawid Dominik Dorota Edward Elżbieta Emilia Eugeniusz Ewa Filip Franciszek Gabriel Gabriela Genowefa
Grażyna Grzegorz Halina Hanna Helena Henryk Ignacy Irena Iwona Izabela Jacek Jadwiga Jakub Jan Janina Janusz Jarosław Jerzy Joanna Jolanta Józef
Julia Julian Justyna Kamil Karol Karolina Katarzyna Kazimierz Kinga Klaudia Konrad Krystyna Krzysztof Leszek Lidia Lucyna Łucja Łukasz Maciej Magda
Magdalena Małgorzata Marcin Marek Maria Marian Marianna Mariusz Marta Mateusz Michał Mieczysław Mikołaj Monika Natalia Norbert Olga Patryk Paulina
Paweł Piotr Przemysław Radosław Rafał Robert Roman Ryszard Sebastian Sławomir Stanisław Stefan Stefania Sylwia Szymon Tadeusz Tamara Teresa Tomasz
Urszula Waldemar Wanda Wacław Weronika Wiesław Wiktor Wiktoria Władysław Włodzimierz Wojciech Zbigniew Zdzisław Zenon Zofia Zuzanna Zygmunt
""".split()
# Words after which a person, a number and the like often follows, and words that speak against it.
CUES = {
    "person": "pan pani pana panu panią panem p ks dr prof pozdrawiam podpisano prowadzi śpiewa jak o się rana sąsiad sąsiadka organista ka autor napisał napisała".split(),
    "phone": "tel telefon telefonu kom komórka nr numer dzwonić dzwońcie sms na czego zadzwoń fax".split(),
    "id_number": "pesel dowód dowodu dok dokument paszport paszportu nr numer się podałem podałam legitymacja seria".split(),
    "address": "adres adresem przy na to mnie wysyłajcie mieszkam mieszka zamieszkały ulica dom jest".split(),
    "email": "mail e pisz piszcie kontakt na to adres zgłoszenia".split(),
}
AGAINST = set("isbn przesyłki paczki konta wersja sala pokój piętro ławka mt mk łk ps psalm rozdział rok roku pieśń strona poz zebrano kosztowało zobaczcie".split())
# Words for a street or square, and words that never name one.
STREET = r"(?:ul|al|os|pl)\.?|ulic[aąyęe]|alej[aeiąę]|alei|aleje|osiedl[eau]|osiedlu|plac[ua]?|ryn(?:ek|ku)|skwer(?:u|ze)?|bulwar(?:u|ze)?|szos[aąyęie]+"
NOT_STREET = set("sala numer nr pesel mt mk łk ps isbn wersja pieśń piętro ławka psalm rok zebrano kosztowało dokument dok dowód tel kom telefon sms na w po za od do o z i a to dla numeru czego strona".split())

# Words before a name that speak for or against a personal detail.
TITLES = set("p pan pani pana panu panią panem ks dr prof mgr inż siostra brat s o br kolega koleżanka sąsiad sąsiadka podpisano pozdrawiam nazywam".split())
HOLY = set("św święty święta świętego świętej świętemu świętą świętym bł błogosławiony błogosławiona matka matki matkę ojciec".split())
# Words that begin or end names of institutions, feasts, places, writings and saints.
COMMON = set("""
akcja kościół kościoła radio rada msza gazeta uniwersytet matka boska boskiej biblia konferencja caritas polska polski polskie rzeczpospolita wojsko straż dom morze góry góra puszcza plac boże boży ciało wielki wielka wielkie post czwartek piątek
sobota niedziela święty święta święte świętego świętej rodzina rodziny mikołaj jezus chrystus duch pan bóg pismo stary stara nowy nowa nowe testament księga rodzaju dzieje apostolskie gość niedzielny tygodnik powszechny list listy ewangelia psalm
zielona czarna biała biały nowenna droga krzyżowa koło żywego różańca narodzenie wniebowstąpienie zesłanie wszystkich świętych dzień zaduszny rok jubileuszowy stolica apostolska ojciec ojca nasz zdrowaś maryja maryjo panna najświętsza liga mistrzów
szkoła podstawowa liceum ogólnokształcące urząd miasta gminy sąd rejonowy bank polskiej unia europejska stany zjednoczone dolina modlitwy forum redakcja moderator admin kaplica serca serce miłosierdzie boskie ruch światło życie odnowa papież franciszek
""".split())

# Prepositions before places.
AT = set("w we z ze do na koło pod nad przez spod".split())

_given: frozenset[str] | None = None


def given_forms() -> frozenset[str]:
    """The given names in all cases, by rule, lower-case."""
    global _given
    if _given is None:
        out = set()
        for name in (n.lower() for n in GIVEN):
            out.add(name)
            if name.endswith("a"):
                s = name[:-1]
                soft = next((s[: -len(x)] + y for x, y in (("k", "ce"), ("g", "dze"), ("r", "rze"), ("d", "dzie"), ("t", "cie"), ("ł", "le")) if s.endswith(x)), s + ("e" if s[-1] in "lj" else "i" if s[-1] == "i" else "ie"))
                out |= {s + e for e in ("y", "i", "ę", "ą", "o", "ie", "u")} | {soft, s.rstrip("i") + "ii"}
            else:
                s = name[:-2] + name[-1] if name.endswith(("ek", "eł", "ec")) else name[:-1] if name.endswith(("y", "i")) else name
                out |= {s + e for e in ("a", "owi", "em", "iem", "ie", "u", "ego", "emu", "ze")}
        _given = frozenset(out)
    return _given


_L = r"[^\W\d_]"
_GAP = r"[  ]"
_EMAIL = re.compile(
    rf"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*\s?(?:@|&\#64;|[\[(]\s?(?:at|małpa|malpa)\s?[\])]|(?<=\s)(?:at|małpa|malpa)(?=\s))\s?"
    rf"[\w-]+(?:(?:\.|\s?[\[(]\s?(?:dot|kropka)\s?[\])]\s?|\s(?:dot|kropka)\s)[\w-]+)+",
    re.I,
)
_AT = re.compile(r"@|&#64;|\bat\b|ma[łl]pa", re.I)
_COUNTRY = rf"(?:\((?:\+|00){_GAP}?\d{{1,3}}\)|(?:\+|00){_GAP}?(?:48|\d{{2}}(?=[ \xa0.(-])|\d{{3}}(?=[ \xa0.(-])|\d(?=[ \xa0.(-])))"
_NUMBER = re.compile(rf"(?<![\w+])(?:{_COUNTRY})?{_GAP}?[.-]?(?:\(\d{{2,3}}\)|\d)(?:{_GAP}?[./-]?{_GAP}?\d){{6,}}")
_PREFIX = re.compile(_COUNTRY)
_LONG = re.compile(r"(?<![\w+])\d(?:[  .-]?\d){10}(?![ .-]?\d)")
_CARD = re.compile(r"(?<!\w)(?:[^\W\d_]{3}[  -]?\d(?:[  -]?\d){5}|[^\W\d_]{2}[  -]?\d(?:[  -]?\d){6})(?![ -]?\d|\w)")
_FLAT = rf"(?:{_GAP}?/{_GAP}?\d{{1,4}}(?:[A-Za-z](?!\w))?|,?{_GAP}(?:m|lok|mieszk|miesz)\.?{_GAP}?\d{{1,4}})"
_HOUSE = re.compile(
    rf"(?<!\w)((?:(?:{STREET}){_GAP}?(?:\d{{1,2}}{_GAP}(?=[^\W\d_]))?)?)((?:[^\W\d_][\w'’-]*\.?{_GAP}){{1,5}})(\d{{1,4}}(?:[a-z](?!\w)|{_GAP}[b-h](?!\w|\.?{_GAP}?\d))?{_FLAT}?)(?!\w)"
    rf"((?:[,;]?\s{{1,2}}\d{{2}}-\d{{3}}{_GAP}[^\W\d_][\w-]*(?:{_GAP}(?:nad{_GAP}[^\W\d_]+|{_L}\w*))?)?)",
    re.I,
)
_TYPE = re.compile(rf"(?:{STREET})$", re.I)
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_INITIAL = re.compile(rf"(?<![\w.])([^\W\d_])\.{_GAP}?(?:([^\W\d_])\.{_GAP}?)?([^\W\d_]{{2,}}(?:-[^\W\d_]+)?)")
_CAPITAL = r"[^\W\d_a-ząćęłńóśźż][^\W\d_]+(?:-[^\W\d_a-ząćęłńóśźż][^\W\d_]+)?"
_CAPITALS = re.compile(rf"(?<![\w@.+/-]){_CAPITAL}(?:{_GAP}{_CAPITAL})+(?![\w@/+])")
_STOP = re.compile(r"(?:^|[.!?…:;\n(„\"–-])\s*$")
_SURNAME = re.compile(r"(?:[sczd]k(?:i|a|iego|iemu|im|iej|ą|ich|imi)|(?:iuk|czuk|uk|czyk|ik|ak|ek|ec|icz|ow|ew|cz)(?:a|owi|iem|em|u|ow|ie)?)$", re.I)
_SKI = re.compile(r"[sczd]k(?:i|a|iego|iemu|im|iej|ą)$", re.I)
_DIGIT = re.compile(r"\d")
_CUE = re.compile(r"([^\W\d_]+)[\W\d_]*$")


def pesel_ok(digits: str) -> bool:
    return len(digits) == 11 and sum(int(d) * w for d, w in zip(digits, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1), strict=True)) % 10 == 0


def _check(letters: str, digits: str, weights: tuple[int, ...]) -> bool:
    if not letters.isascii():
        return False
    values = [ord(c) - 55 for c in letters.upper()] + [int(d) for d in digits]
    return sum(v * w for v, w in zip(values, weights, strict=True)) % 10 == 0


def _case(word: str) -> str:
    return "upper" if word.isupper() and len(word) > 1 else "title" if word[:1].isupper() else "lower"


def _cue(text: str, start: int) -> str:
    m = _CUE.search(text, max(0, start - 24), start)
    return m[1].lower() if m else ""


class Span:
    __slots__ = ("start", "end", "kind", "features")

    def __init__(self, start: int, end: int, kind: str, features: list[str]) -> None:
        self.start, self.end, self.kind, self.features = start, end, kind, [f"{kind}:{f}" for f in features]


def _around(text: str, start: int, end: int, kind: str) -> list[str]:
    cue = _cue(text, start)
    return ["bias", "cue" if cue in CUES[kind] else "against" if cue in AGAINST else "nocue"]


def _persons(text: str, given: frozenset[str]) -> Iterator[Span]:
    """Given names in any case next to another word, initials with a surname, and every two and three capitalised words in a row."""
    words = [(m.start(), m.end(), m[0]) for m in _WORDS.finditer(text)]
    for i, (s, e, w) in enumerate(words):
        if w.lower() not in given:
            continue
        near = text[s - 1 : s] + text[e : e + 1]
        if any(c in "@+_.-/" or c.isdigit() for c in near[:1]) and s or text[e : e + 1] in ("@", "+", "_"):
            continue
        for n in (1, 2):
            if i + n < len(words) and all(text[words[j - 1][1] : words[j][0]] in (" ", "\xa0") for j in range(i + 1, i + n + 1)) and (n == 1 or words[i + 1][2].lower() in given):
                yield _person(text, s, words[i + n][1], given)
        if i and text[words[i - 1][1] : s] in (" ", "\xa0"):
            yield _person(text, words[i - 1][0], e, given)
    for m in _CAPITALS.finditer(text):
        if m[0].isupper():  # a sentence in capitals; names in it are told by given names alone
            continue
        row = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"[^ \xa0]+", m[0])]
        for i in range(len(row)):
            for n in (1, 2):
                if i + n < len(row) and not text[row[i][0] : row[i + n][1]].isupper():
                    yield _person(text, row[i][0], row[i + n][1], given)
    for m in _INITIAL.finditer(text):
        surname, starts = m[3], [(m.start(), m[1])] + ([(m.start(2), m[2])] if m[2] else [])
        for start, letter in starts:
            features = [*_before(text, start), "initial", f"initial {_case(letter * 2)}", f"initial surname {_case(surname)}", _ending(surname), "initial " + ("short" if len(surname) < 4 else "long"), f"initial {_ending(surname)} {_case(surname)}"]
            if m[2]:
                features.append(f"two initials {_case(m[1] * 2)} {'whole' if start == m.start() else 'left out'}")
            yield Span(start, m.end(), "person", features + (["initial common"] if surname.lower() in COMMON else []))


def _before(text: str, start: int) -> list[str]:
    cue = _cue(text, start)
    near = text[max(0, start - 24) : start]
    how = "title" if cue in TITLES else "holy" if cue in HOLY else "cue" if cue in CUES["person"] else "against" if cue in AGAINST else "place" if cue in AT else "nocue"
    return ["bias", how, "start" if _STOP.search(near) else "inside"]


def _ending(word: str) -> str:
    parts = word.split("-")
    return "ski" if all(_SKI.search(p) for p in parts) else "suffix" if all(_SURNAME.search(p) for p in parts) else "half" if any(_SURNAME.search(p) for p in parts) else "no suffix"


def _person(text: str, start: int, end: int, given: frozenset[str]) -> Span:
    words = re.split(r"[ \xa0]", text[start:end])
    lower = [w.lower() for w in words]
    first, last = words[0], words[-1]
    known = ["given" if w in given else "common" if w in COMMON else "other" for w in lower]
    cases = [_case(w) for w in words]
    before, ending = _before(text, start), _ending(last)
    shape = cases[0] if len(set(cases)) == 1 else "mixed"
    out = [*before, f"{len(words)} words", "row " + " ".join(known), f"shape {shape}", f"shape {shape} {' '.join(known)}", f"surname {cases[-1]}", ending, f"{ending} {shape}", f"{ending} {' '.join(known)}", f"{before[1]} {' '.join(known)}", f"{before[2]} {known[0]}"]
    if len(words) > 2:
        out.append(f"{_ending(first)} {' '.join(known)} {ending}")
    out += [f"first ..{lower[0][-2:]}", f"first ..{lower[0][-3:]}", f"last ..{lower[-1][-2:]}", f"last ..{lower[-1][-3:]}"]
    if known[0] != "given":
        out.append(f"first unknown, {_ending(first)} then {ending}")
    if len(last) < 5:
        out.append(f"short {known[0]}")
    if text[start - 2 : start - 1].isalpha() and text[start - 1 : start] in (" ", "\xa0") and re.search(rf"{_CAPITAL}$", text[max(0, start - 20) : start - 1]):
        out.append("capital before")
    if re.match(rf"{_GAP}{_CAPITAL}", text[end : end + 20]):
        out.append("capital after")
    elif re.match(rf"{_GAP}[IVX]+(?!\w)", text[end : end + 8]):
        out.append("numeral after")
    return Span(start, end, "person", out)


def _numbers(text: str) -> Iterator[Span]:
    for m in _NUMBER.finditer(text):
        start = m.start() + len(m[0]) - len(m[0].lstrip("  .-"))
        prefix = _PREFIX.match(text, start)
        body = prefix.end() if prefix else start
        digits = [x.start() for x in _DIGIT.finditer(text, body, m.end())]
        following = text[m.end() : m.end() + 12].lower()
        features = _around(text, start, m.end(), "phone")
        features += ["no prefix" if not prefix else "prefix" if re.sub(r"\D", "", prefix[0]).endswith("48") else "foreign prefix", f"{len(digits) if 8 < len(digits) < 12 else 'other'} digits"]
        gaps = re.sub(r"\d+", "9", text[body : m.end()])
        kinds = set(re.sub(r"[9()]", "", gaps))
        features.append("plain" if not kinds else "one mark" if len(kinds) == 1 else "marks")
        groups = [len(g) for g in re.findall(r"\d+", text[body : m.end()])]
        features.append("groups " + ("good" if groups in ([9], [3, 3, 3], [2, 3, 2, 2], [3, 6], [3, 2, 2, 2], [6, 3], [2, 7], [3, 3, 2, 1], [1, 2, 3, 3]) else "odd"))
        if re.match(r"\s*(zł|gr|eur|pln|%|m2)", following):
            features.append("money")
        yield Span(start, m.end(), "phone", features)
    for m in _LONG.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        gaps = re.findall(r"\d+", m[0])
        yield Span(m.start(), m.end(), "id_number", [*_around(text, m.start(), m.end(), "id_number"), "pesel good" if pesel_ok(digits) else "pesel bad", "groups good" if [len(g) for g in gaps] in ([11], [6, 5]) else "groups odd"])
    for m in _CARD.finditer(text):
        letters, digits = re.sub(r"[\W\d_]", "", m[0]), re.sub(r"\D", "", m[0])
        good = _check(letters, digits, (7, 3, 1, 9, 7, 3, 1, 7, 3))
        features = [f"{len(letters)} letters", "check good" if good else "check bad", f"letters {'upper' if letters.isupper() else 'lower' if letters.islower() else 'mixed'}", "ascii" if letters.isascii() else "not ascii"]
        yield Span(m.start(), m.end(), "id_number", [*_around(text, m.start(), m.end(), "id_number"), *features, "a word" if letters.islower() and letters in NOT_STREET else "no word", "compact" if len(m[0]) <= 10 else "spread"])


def _addresses(text: str) -> Iterator[Span]:
    for m in _HOUSE.finditer(text):
        words = m[2].split()
        for skip in range(len(words)):  # the name may be any tail of the words before the number
            start = m.start(2) + m[2].index(words[skip]) if skip or not m[1] else m.start()
            if skip:
                start, at = m.start(2), 0
                for w in words[:skip]:
                    at = m[2].index(w, at) + len(w)
                start = m.start(2) + len(m[2][:at]) + len(m[2][at:]) - len(m[2][at:].lstrip())
            own = words[skip:]
            typed = (bool(m[1].strip()) and not skip) or bool(_TYPE.match(own[0])) and len(own) > 1
            name = own[1:] if typed and not m[1].strip() or skip and typed else own
            if not name and not re.match(r"ryn", own[0], re.I):
                continue
            name = name or own
            features = [*_around(text, start, m.end(), "address"), "typed" if typed else "untyped", f"{min(len(name), 3)} words"]
            features.append("type again" if any(_TYPE.match(w) for w in name) else "type once")
            features.append(f"name {_case(name[0])}" if all(_case(w) == _case(name[0]) or re.fullmatch("[IVX]+", w) for w in name) else "name mixed")
            features.append(f"{features[2]} {len(name)} words {features[-1]}")
            if skip and not typed:
                features.append("capital left out" if words[skip - 1][:1].isupper() else "word left out")
            if skip and not typed and any(_TYPE.match(w) for w in words[:skip]):
                features.append("type left out")
            if not typed:
                by_form = _case(name[-1]) == "title" and len(name) == 1 and bool(re.search(r"(?:ej|ą|cisze)$", name[-1], re.I))
                features.append(("street by form " if by_form else "no street by form ") + ("cue" if "cue" in features else "nocue"))
            features.append("adjective" if re.search(r"(?:iej|ej|a|cisze|owa)$", name[-1], re.I) else "other name")
            features.append("not a street" if any(w.lower().strip(".") in NOT_STREET for w in name) else "maybe a street")
            ends = {m.end(3)} | ({m.end(4)} if m[4] else set())
            if m[4]:
                tail = m[4].rsplit(None, 1)
                if len(tail) == 2 and re.search(r"\d{2}-\d{3}\s\S+$", tail[0]):
                    ends.add(m.start(4) + len(tail[0]))
            for end in ends:
                if end == m.end(3):
                    how = "no town" if not m[4] else "town left out"
                else:
                    last = text[start:end].split()[-1]
                    two = not re.search(r"\d{2}-\d{3}\s\S+$", text[start:end])
                    how = ("two words of town " + ("title" if last[:1].isupper() or text[start:end].split()[-2].lower() == "nad" else "lower")) if two else "one word of town"
                yield Span(start, end, "address", [*features, how])


def candidates(text: str, given: frozenset[str] | None = None) -> list[Span]:
    """Every span that might be a detail; ``given`` are the given names that are known."""
    spans = list(_persons(text, given_forms() if given is None else given))
    if _DIGIT.search(text):
        spans += _numbers(text)
        spans += _addresses(text)
    if _AT.search(text):
        spans += [Span(m.start(), m.end(), "email", [*_around(text, m.start(), m.end(), "email"), "sign" if "@" in m[0] else "disguised", "spaced" if " " in m[0] else "compact", "dots" if "." in m[0] else "words"]) for m in _EMAIL.finditer(text)]
    unique = {(s.start, s.end, s.kind): s for s in spans}
    return sorted(unique.values(), key=lambda s: (s.end, s.start, s.kind))


#: Characters between two details up to which the first bears on the second.
NEAR = 40


def _tie(a: Span, b: Span) -> str | None:
    """The feature of two details that follow each other, None if they are far apart."""
    gap = b.start - a.end
    return f"{a.kind} {'at once' if gap < 4 else 'soon' if gap < 16 else 'later'} {b.kind}" if gap <= NEAR else None


def decode(spans: list[Span], weights: dict[str, float]) -> list[Span]:
    """The spans without overlap that score best with the ties between neighbours, in order.

    By the last span chosen; only spans that end near the start of the next are tried one by one, of those further
    off the best is known.
    """
    ends = [s.end for s in spans]
    best, back = [], []  # of the sequences that end with each span
    top: list[tuple[float, int]] = [(0.0, -1)]  # of those that end with one of the first k spans
    for k, s in enumerate(spans):
        far = bisect.bisect_left(ends, s.start - NEAR, 0, k)
        value, at = top[far]
        for j in range(far, bisect.bisect_right(ends, s.start, far, k)):
            tied = best[j] + weights.get(_tie(spans[j], s), 0.0)
            if tied > value:
                value, at = tied, j
        value += sum(weights.get(f, 0.0) for f in s.features)
        best.append(value)
        back.append(at)
        top.append((value, k) if value > top[-1][0] else top[-1])
    out, k = [], top[-1][1]
    while k >= 0:
        out.append(spans[k])
        k = back[k]
    return out[::-1]


def _expected(spans: list[Span], weights: dict[str, float]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """The marginal probability of each span, and of each two that follow each other nearby, by forward sums and their derivatives."""
    n = len(spans)
    scores = [sum(weights.get(f, 0.0) for f in s.features) for s in spans]
    total, ways = [0.0] * n, []  # log sums over the sequences that end with each span
    for k, s in enumerate(spans):
        own = [(-1, 0.0)] + [(j, total[j] + weights.get(_tie(spans[j], s), 0.0)) for j in range(k) if spans[j].end <= s.start]
        most = max(v for _, v in own)
        total[k] = scores[k] + most + math.log(sum(math.exp(v - most) for _, v in own))
        ways.append(own)
    most = max([0.0, *total])
    whole = most + math.log(math.exp(-most) + sum(math.exp(t - most) for t in total))
    out, pairs = [math.exp(t - whole) for t in total], {}
    for k in range(n - 1, -1, -1):
        for j, v in ways[k]:
            if j >= 0:
                p = out[k] * math.exp(v + scores[k] - total[k])
                out[j] += p
                if _tie(spans[j], spans[k]):
                    pairs[j, k] = p
    return out, pairs


# Pieces of the sentences from which the weights are learnt.
_STREETS = "Lipowa Polna Cicha Jesionowa Młyńska Kwietna Ogrodowa Słoneczna Kościelna Szkolna Zacisze Leśna Krótka Brzozowa".split()
_TOWNS = ["Olszyny", "Brzeziny Dolne", "Lipiny Stare", "Kamień nad Rzeką", "Dąbrowa", "Rudka Leśna", "Wola Górna"]
_STEMS = "Kowal Wiśniew Zieliń Szymań Dąbrow Kozłow Jankow Mazur Wojciechow Kwiatkow Piotrow Grabow Pawłow Michal Krawczyń".split()
_ENDS = "ski ska cki cka ec iuk czyk ak ek icz skiego skiemu ską skiej ecowi iuka".split()
# Polish surnames with other endings.
_SURNAMES = """Nowak Wójcik Kowalczyk Kamiński Lewandowska Zając Król Wróbel Dudek Adamczyk Sikora Baran Szewczyk Tomaszewski Pietrzak Marciniak Wrona Bąk Kaczmarek Pawlak Walczak Michalak Kubiak Mazur Krawczyk Piątek Stępień Górski Jasińska
Sadowska Witkowski Borowska Sobczak Kołodziej Gajda Kania Urban Wilk Duda Polak Cieślak Kasprzak Głowacki Zalewska Laskowski Makowski Kozioł Sroka Kruk Gołąb Bednarz Banaś Wojtkiewicz Jurkiewicz Stankiewicz Sienkiewicz""".split()
# Names of institutions, feasts, places and writings, which are no personal details.
_NO_PERSONS = """Akcja Katolicka; Matka Boska Częstochowska; Kościół Katolicki; Radio Watykańskie; Rada Parafialna; Msza Święta; Uniwersytet Jagielloński; Biblia Tysiąclecia; Konferencja Episkopatu Polski; Caritas Polska; Rzeczpospolita Polska; Wojsko Polskie;
Straż Pożarna; Dom Kultury; Morze Bałtyckie; Góry Świętokrzyskie; Puszcza Białowieska; Boże Ciało; Wielki Post; Wielki Piątek; Święta Rodzina; Święty Mikołaj; Jezus Chrystus; Duch Święty; Pan Bóg; Jan Paweł II; Pismo Święte; Stary Testament;
Nowy Testament; Księga Rodzaju; Dzieje Apostolskie; Gość Niedzielny; Tygodnik Powszechny; Zielona Góra; Nowy Sącz; Stara Wola; Droga Krzyżowa; Boże Narodzenie; Wszystkich Świętych; Stolica Apostolska; Ojciec Święty; Ojcze Nasz; Zdrowaś Maryjo;
Najświętsza Panna; Szkoła Podstawowa; Urząd Miasta; Sąd Rejonowy; Unia Europejska; Stany Zjednoczone; Dolina Modlitwy; Serce Jezusa; Miłosierdzie Boże; Odnowa Duchu; Papież Franciszek; Jan Chrzciciel; Maria Panna; Maria Magdalena; Marcin Luter; Adam Ewa;
Koło Żywego Różańca; Liceum Ogólnokształcące; Rok Jubileuszowy; Święty Jan; Święta Teresa; Matka Teresa; Bielsko Biała; Nowa Huta; Jasna Góra; Kalwaria Zebrzydowska; Ostrów Wielkopolski; Gorzów Wielkopolski; Piotrków Trybunalski; Ewangelia Jana;
List Piotra; Prawo Kanoniczne; Drogi Krzyżowej; Matki Boskiej; Bożego Ciała; Nowego Testamentu; Ojca Świętego; Uniwersytetu Warszawskiego; Kościoła Katolickiego; Panu Bogu; Dzień Dobry; Serdeczne Pozdrowienia; Szczęść Boże; Dobry Wieczór""".split(";")
# Words that begin a sentence before a name.
_STARTERS = "Szukam Pamiętam Przemawiał Przemawiała Zeznawał Mówił Mówiła Prosił Prosiła Pytam Spotkałem Spotkałam Dyrektor Nauczycielka Organista Burmistrz Sołtys Prezes Lekarka Autor Tak Wczoraj Potem Dzisiaj Jestem Nazywam Witam Zaprosił Napisała Odpowiedział Śpiewa Mieszka Tylko Kiedyś Znam Może Czy Ale Wiem".split()
# Places after a preposition.
_PLACES = "Nowej Wsi; Zielonej Górze; Nowego Targu; Białej Podlaskiej; Nowym Mieście; Starego Miasta; Stalowej Woli; Rudzie Śląskiej; Jeleniej Góry; Dolnym Śląsku; Małej Wsi; Bielskiem Podlaskim; Ostrowie Wielkopolskim; Rawie Mazowieckiej; Górnego Śląska; Starej Lubowli; Kazimierzu Dolnym; Nowego Jorku; Ziemi Świętej; Sanktuarium Maryjnego; Domu Kultury; Domu Pielgrzyma; Polsce Ludowej".split(";")
_FILLER = "stary most prowadzi cicho do kaplicy kiedy babcia piecze chleb a sąsiad maluje płot w ogrodzie bo wiosna czeka na ludzi oraz dzwon woła ojca przy stole".split()


def _examples(n: int, seed: int = 5) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Generated texts with the places and kinds of their details."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    declined = {g: sorted(f.title() for f in given_forms() if f[:3] == g.lower()[:3] and abs(len(f) - len(g)) < 3) for g in GIVEN}

    def phone() -> str:
        d = r.choice("2345678") + digits(8)
        body = r.choice([d, f"{d[:3]} {d[3:6]} {d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"({d[:2]}) {d[2:5]} {d[5:7]} {d[7:]}", f"{d[:2]}/{d[2:5]}-{d[5:7]}-{d[7:]}", f"{d[:3]} {d[3:]}", f"{d[:3]} {d[3:5]} {d[5:7]} {d[7:]}"])
        if r.random() < 0.1:
            return f"+{r.choice(['44 20', '49 30', '33 1', '1 212', '420 2', '39 06'])} {digits(4)} {digits(4)}"
        return r.choice(["", "", "+48 ", "+48", "(+48) ", "0048 ", "+48-"]) + body

    def pesel(good: bool) -> str:
        while True:
            d = digits(11)
            if pesel_ok(d) == good:
                return r.choice([d, d, f"{d[:6]} {d[6:]}", f"{d[:6]}-{d[6:]}"])

    def card() -> str:
        letters = "".join(r.choice("ABCDEFGHXYZ") for _ in range(r.choice((2, 3))))
        letters = r.choice([letters, letters, letters.lower()])
        while True:
            d = digits(9 - len(letters))
            if len(letters) == 2 or _check(letters, d, (7, 3, 1, 9, 7, 3, 1, 7, 3)):
                return letters + r.choice(["", " "]) + d

    def surname() -> str:
        if r.random() < 0.5:
            return r.choice(_STEMS) + r.choice(_ENDS)
        s = r.choice(_SURNAMES)
        if r.random() < 0.7:
            return s
        if s.endswith(("ska", "cka")):
            return s[:-1] + r.choice(["iej", "ą"])
        if s.endswith(("ski", "cki")):
            return s + r.choice(["ego", "emu", "m"])
        if s.endswith("a"):
            return s[:-1] + r.choice(["y", "ę", "ą"]) if s[-2] not in "ki" else s
        return (s[:-2] + "k" if s.endswith("ek") else s) + r.choice(["a", "owi", "em"])

    def person() -> str:
        g, s = r.choice(GIVEN), surname()
        if r.random() < 0.3:
            g = r.choice(declined[g])
        if r.random() < 0.1:
            s += "-" + surname()
        name = r.choice([f"{g} {s}", f"{g} {s}", f"{g} {s}", f"{g} {r.choice(GIVEN)} {s}", f"{s} {g}", f"{s} {g}", f"{g[0]}. {s}", f"{g[0]}. {s}", f"{g[0]}. {r.choice(GIVEN)[0]}. {s}"])
        return r.choice([name] * 6 + [name.upper(), name.lower() if "." not in name else name])

    def email() -> str:
        u, d = r.choice(["jan.kowal", "anna+forum", "maly_wilk7", "sowa12", "zielony-piotr"]), r.choice(["poczta", "mail.skrzynka", "parafia-wola"])
        at, dot = r.choice(["@", "@", " @ ", "@ ", "(at)", " [at] ", "(małpa)", " małpa ", "&#64;"]), r.choice([".", ".", " kropka ", "[dot]", " (kropka) "])
        out = f"{u}{at}{d}{dot if at != '@' else '.'}{r.choice(['pl', 'example', 'invalid'])}"
        return r.choice([out] * 4 + [out.upper() if "@" in out else out])

    def address() -> str:
        s = r.choice(_STREETS)
        case = re.sub("a$", "ej", s)
        if r.random() < 0.25:
            long = r.choice(["Jana Pawła II", "Świętego Jana", "św. Floriana", "Armii Krajowej", "Wojska Polskiego", "Marii Skłodowskiej", "Adama Mickiewicza", "ks. Piotra Ściegiennego", "Trzech Krzyży", "3 Maja", "11 Listopada", "Świętego Jana Pawła II", f"{r.choice(['ks. ', 'gen. ', 'św. ', ''])}{r.choice(declined[r.choice(GIVEN)])} {surname()}"])
            return r.choice(["ul. ", "ul. ", "al. ", "pl. ", "ulicy ", "os. "]) + f"{long} {r.randint(1, 150)}" + r.choice(["", f"/{r.randint(1, 90)}", f", {digits(2)}-{digits(3)} {r.choice(_TOWNS)}"])
        if r.random() < 0.08:
            return r.choice(["Rynek", "Rynku", "Rynek Główny", "Rynku Głównym", "Rynku Starym", "Placu Wolności", "Alejach Jerozolimskich"]) + f" {r.randint(1, 60)}" + r.choice(["", f", {digits(2)}-{digits(3)} {r.choice(_TOWNS)}"])
        street = r.choice([case, case, case, re.sub("a$", "ą", s) if s.endswith("a") else case, f"ul. {s}", f"ul.{s}", f"Ul. {s}", f"os. {s}", f"al. {s}", f"pl. {s}", f"ulica {s}", f"ulicy {case}", f"alei {case}", f"ul. {case}", case, case])
        house = str(r.randint(1, 150)) + r.choice(["", "", "A", " b", f"/{r.randint(1, 90)}", f" m. {r.randint(1, 90)}", f" lok. {r.randint(1, 90)}"])
        return f"{street} {house}" + r.choice(["", "", "", f", {digits(2)}-{digits(3)} {r.choice(_TOWNS)}", f"\n{digits(2)}-{digits(3)} {r.choice(_TOWNS)}", f"; {digits(2)}-{digits(3)} {r.choice(_TOWNS)}"])

    makers = {"phone": (phone, CUES["phone"]), "email": (email, CUES["email"]), "person": (person, CUES["person"]), "address": (address, CUES["address"])}
    makers["id_number"] = (lambda: r.choice([pesel(True), card()]), CUES["id_number"])
    harmless = [
        lambda: f"Numer przesyłki {pesel(False)} nadal", lambda: f"ISBN 978-{digits(1)}-{digits(3)}-{digits(3)} wycofany", lambda: f"Zebrano {digits(3)} {digits(3)} zł na dzwon",
        lambda: f"Kosztowało to {digits(2)} zł", lambda: f"Zobaczcie Mt {digits(1)}, {digits(2)} oraz Łk {digits(1)}, {digits(2)}", lambda: f"Sala {digits(2)}, piętro {digits(1)}, ławka {digits(2)}",
        lambda: f"Wersja programu {digits(1)}.{digits(2)}.{digits(2)} nie działa", lambda: "Pisałem do @redakcja i nic", lambda: f"Remont przy ulicy {re.sub('a$', 'ej', r.choice(_STREETS))} potrwa do jesieni",
        lambda: f"Pieśń nr {digits(3)} ze śpiewnika", lambda: f"W roku {r.randint(1990, 2024)} było {digits(3)} osób", lambda: f"numer {digits(2)}/{r.randint(2000, 2024)} gazety",
        lambda: f"{r.choice(_FILLER)} {r.choice(sorted(AT))} {r.choice(_PLACES).strip()} {r.choice(_FILLER)}", lambda: f"{r.choice(_STARTERS)} {r.choice(_NO_PERSONS).strip()} {r.choice(_FILLER)}",
        lambda: r.choice(_NO_PERSONS).strip(), lambda: f"{r.choice(_FILLER)} {r.choice(_NO_PERSONS).strip()} {r.choice(_FILLER)}", lambda: f"{r.choice(_FILLER)} {r.choice(_NO_PERSONS).strip()}, {r.choice(_FILLER)}",
        lambda: f"{r.choice(_FILLER).title()} {r.choice(_NO_PERSONS).strip()} {r.choice(_FILLER)}", lambda: f"{r.choice(_FILLER)} {r.choice(_TOWNS)} {r.choice(_FILLER)}", lambda: f"{r.choice(_FILLER)} ul. {r.choice(_STREETS)} {r.choice(_FILLER)}",
        lambda: " ".join(r.choice(_FILLER) for _ in range(r.randint(2, 7))).upper(), lambda: " ".join(r.choice(_FILLER) for _ in range(r.randint(2, 7))).upper() + "! " + r.choice(_FILLER).upper(), lambda: f"{r.choice(['w Piśmie', 'na mszy'])}. {r.choice(_FILLER).title()} {r.choice(GIVEN)} {r.choice(_FILLER)}",
        lambda: f"{r.choice(GIVEN)} {r.choice(_FILLER)} {r.choice(_FILLER)}", lambda: f"święta {r.choice(GIVEN)} modli się", lambda: f"stało {digits(2)} b. {r.choice(_FILLER).title()} {r.choice(_FILLER)}", lambda: f"konto {digits(26)} banku", lambda: f"{r.choice(_FILLER)} {r.choice('abcdekmnst')}. {r.choice(_FILLER).title()}", lambda: f"na {digits(7)} sztuk", lambda: f"psalm {digits(2)} i {digits(3)} osób",
    ]
    for _ in range(n):
        text, marks = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(r.choice(_FILLER) for _ in range(r.randint(0, 5)))
            if r.random() < 0.3:
                text = text[:1].upper() + text[1:] + r.choice([". ", "! ", "\n", ", "]) + r.choice(harmless)() + ". "
                continue
            kind = r.choice((*KINDS, "person", "person", "person", "address"))
            make, cues = makers[kind]
            value = make()
            if kind == "address" and not re.match(STREET, value, re.I):
                text += " " + r.choice(["mieszkam na", "na", "byliśmy na", "przy"]) + " "
            elif kind == "person" and r.random() < 0.6:  # as the subject of a sentence, or after any word
                text = text.rstrip() + r.choice([". ", "! ", "\n", *" " * 7, ", ", f" {r.choice(sorted(AT))} ", f". {r.choice(_FILLER).title()} ", *[f". {r.choice(_STARTERS)} " for _ in range(3)]]) if text.strip() else r.choice(["", "", f"{r.choice(_STARTERS)} "])
            else:
                text += r.choice([" ", " ", " – ", ", ", " ("])
                if r.random() < 0.7:
                    text += r.choice(cues + ["p."] * (kind == "person")) + r.choice([" ", ": ", ". " if kind != "address" else " "])
            marks.append((len(text), len(text) + len(value), kind))
            text += value + r.choice([" ", " ", " ", ", ", ". ", ") ", "\n", " – "])
            if kind == "person" and r.random() < 0.25:  # the next sentence begins without a mark between
                text = text.rstrip() + " " + r.choice(_FILLER).title() + " "
        yield text, marks


@lru_cache(maxsize=1)
def train(examples: int = 6000, rounds: int = 10, rate: float = 0.4, decay: float = 2e-4) -> dict[str, float]:
    """Weights of the features; the same every time."""
    data, withheld = [], random.Random(3)
    for n, (text, marks) in enumerate(_examples(examples)):
        given = given_forms() if n % 2 else frozenset(g for g in sorted(given_forms()) if withheld.random() < 0.2)
        spans, wanted = candidates(text, given), set(marks)
        if spans:
            gold = [float((s.start, s.end, s.kind) in wanted) for s in spans]
            row = [k for k, g in enumerate(gold) if g]
            data.append((spans, gold, {(j, k): 1.0 for j, k in zip(row, row[1:]) if _tie(spans[j], spans[k])}))
    weights: dict[str, float] = defaultdict(float)
    order = random.Random(1)
    for step in range(rounds):
        order.shuffle(data)
        pace = rate / (1 + step)
        for spans, gold, tied in data:
            one, two = _expected(spans, weights)
            changes = [(s.features, g - p) for s, g, p in zip(spans, gold, one, strict=True)]
            changes += [([_tie(spans[j], spans[k])], tied.get((j, k), 0.0) - two.get((j, k), 0.0)) for j, k in sorted(two.keys() | tied.keys())]
            for features, change in changes:
                if abs(change) > 1e-4:
                    for f in features:
                        weights[f] += pace * change - decay * weights[f]
    return {f: round(w, 4) for f, w in weights.items()}


def details(text: str | None, weights: dict[str, float]) -> list[Span]:
    """The personal details of a text in order; none for null and empty texts."""
    return decode(candidates(text), weights) if text else []


def redact(text: str, found: list[Span]) -> str:
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], PLACEHOLDER[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


def find_details(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``details`` (array of kind, start, end in code points) and ``redacted`` of every row.

    Null texts have null details' text and an empty array; empty texts stay empty. Row by row: repeated rows
    come out again, a null key is kept, an empty table gives no row. Texts are read whole.
    """
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [details(t, weights) for t in texts]
            rows = [[{"kind": s.kind, "start": s.start, "end": s.end} for s in f] for f in found]
            clean = [redact(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, item), pa.array(clean, pa.string())], [key, "details", "redacted"])

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, details array<struct<kind:string,start:int,end:int>>, redacted string")
