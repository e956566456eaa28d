"""Tokens, their statistics, sentiment, readability and rule-based annotation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"

# The sentiment lexicon.
POSITIVE = "dobry świetny wspaniały piękny radość szczęście błogosławiony miłość pokój nadzieja wiara łaska zbawienie święty boży duchowy modlitwa dziękuję".split()
NEGATIVE = "zły okropny straszny smutek ból cierpienie grzech diabeł piekło przekleństwo nienawiść złość rozpacz lęk strach wątpliwość kłamstwo zdrada".split()
RELIGIOUS = "bóg jezus chrystus maryja duch kościół papież ksiądz biskup kardynał msza eucharystia".split()
# Words that carry no topic, and words of closed classes.
STOP = "a aby albo ale bez bo by był była było co czy dla do gdy i ich ja jak jako je jednak jest jeśli już kiedy która które który lub ma mi mnie moim mówiąc na nad nas nie o od oraz po pod przed przy się są spod tak także tam ten to tu tylko tym u w we więc z za zatem ze że zza żeby".split()
PREPOSITIONS = "bez dla do koło ku mimo na nad o obok od oprócz po pod podczas ponad przed przez przy spod u w we według wśród z za zamiast ze zza".split()
CONJUNCTIONS = "a aby albo ale bo choć czy dlatego gdy i jednak jeśli kiedy lecz lub oraz ponieważ więc zatem że żeby".split()
# Endings by which the rule-based annotator tells word classes, cases and genders.
ADJECTIVE = "(?:ski|ska|skie|cki|cka|ckie|ny|na|ne|ego|emu|ych|ymi|ły|wy|wa|we|ty|ta|te)$"
VERB = "(?:uje|uję|ywa|ąć|ać|eć|ić|yć|ał|ała|ało|ali|ił|iła|ili|ia|zi|zy|sze)$"
ADVERB = "(?:nie|zo|ko|no|wo|cie)$"

# Patterns of the default entity annotator.
ENTITIES = {
    "PERSON": r"\p{Lu}\p{Ll}+(?:ski|cki|ska|cka|iuk|ec)\b",
    "ORG": r"(?:redakcja|kaplica|parafia|szkoła|biblioteka|drużyna) \p{L}+",
    "GPE": r"[0-9]{2}-[0-9]{3} \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}


def tokens(text: Column, lower: bool = True, least: int = 1) -> Column:
    """Words of ``text`` in order; null and empty texts have none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    found = F.transform(found, F.lower) if lower else found
    return F.filter(found, lambda t: F.length(t) >= least) if least > 1 else found


def token_stats(words: Column) -> Column:
    """Struct of total, unique and mean length; all 0 without words."""
    n = F.size(words)
    total = F.aggregate(words, F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    return F.struct(n.cast("long").alias("total_tokens"), F.size(F.array_distinct(words)).cast("long").alias("unique_tokens"), F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("avg_token_length"))


def sentiment(words: Column) -> Column:
    """Struct of polarity and subjectivity by lexicon; words are lower-case."""
    hits = lambda lexicon: F.size(F.filter(words, lambda t: t.isin(lexicon)))
    p, n, r, size = hits(POSITIVE), hits(NEGATIVE), hits(RELIGIOUS), F.size(words)
    polarity = F.when(p + n > 0, (p - n) / (p + n)).otherwise(F.lit(0.0))
    subjectivity = F.when(p + n > 0, F.least(F.lit(1.0), (p + n + 0.5 * r) / size)).when(r > 0, F.least(F.lit(1.0), r / size)).otherwise(F.lit(0.0))
    return F.struct(polarity.alias("polarity"), subjectivity.alias("subjectivity"))


def sentence_count(text: Column) -> Column:
    """Stretches with a word between sentence ends."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[.!?…]+"), lambda s: s.rlike(r"[\p{L}\p{N}]"))).cast("long")


def readability(words: Column, sentences: Column, chars: Column) -> Column:
    """206.835 - 1.015 words/sentences - 84.6 chars/words, clamped to 0..100; 0 without words or sentences."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw_readability(words, sentences, chars)))


def raw_readability(words: Column, sentences: Column, chars: Column) -> Column:
    """The same before the clamp, which hides most texts."""
    return F.when((words > 0) & (sentences > 0), 206.835 - 1.015 * (words / sentences) - 84.6 * (chars / words)).otherwise(F.lit(0.0))


def word_class(token: Column) -> Column:
    """A coarse word class of a lower-case token by closed lists and endings (the default annotator)."""
    return (
        F.when(token.rlike(r"^[0-9]+$"), "NUM").when(token.isin(PREPOSITIONS), "ADP").when(token.isin(CONJUNCTIONS), "CCONJ")
        .when(token.rlike(ADJECTIVE), "ADJ").when(token.rlike(VERB), "VERB").when(token.rlike(ADVERB), "ADV").otherwise("NOUN")
    )


def morphology(token: Column) -> Column:
    """JSON of Case and Gender by endings, for nouns and adjectives; null for others."""
    case = F.when(token.rlike("(?:owi|emu)$"), "Dat").when(token.rlike("(?:ach|ech|ych)$"), "Loc").when(token.rlike("(?:ami|em|ymi)$"), "Ins").when(token.rlike("(?:ów|ego|y|i)$"), "Gen").when(token.rlike("ę$"), "Acc").otherwise("Nom")
    kind = F.when(token.rlike("(?:a|ej|ą|ę)$"), "Fem").when(token.rlike("(?:o|e)$"), "Neut").otherwise("Masc")
    return F.when(word_class(token).isin("NOUN", "ADJ"), F.concat(F.lit('{"Case":"'), case, F.lit('","Gender":"'), kind, F.lit('"}')))


def found_at(text: Column, pattern: str, label: str) -> Column:
    """Array of structs of what ``pattern`` finds in ``text``, in order: text, label, start and end (offsets from 0)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<text:string,label:string,start_char:int,end_char:int>>")

    def add(out: Column, e: Column) -> Column:
        after = F.coalesce(F.try_element_at(out, F.lit(-1))["end_char"], F.lit(0))
        start = (after + F.instr(F.substring(text, after + 1, F.length(text)), e) - 1).cast("int")
        return F.concat(out, F.array(F.struct(e.alias("text"), F.lit(label).alias("label"), start.alias("start_char"), (start + F.length(e)).cast("int").alias("end_char"))))

    return F.aggregate(found, empty, add)
