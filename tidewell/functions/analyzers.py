"""Pluggable analyzers: the built-in one, Porter stems, lemma tables, entities.

Porter (1980) runs over the distinct vocabulary and is joined back; lemmas and
synonyms are tables; entities are runs of capitalised words, a heuristic that
is off by default."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import config
from tidewell.functions import text as tx
from tidewell.runtime import ship

_VOWEL = "aeiou"

# Fixed values of the published algorithm: suffix rules of its steps.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWEL:
        return False
    return not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(stem: str) -> int:
    """Vowel-consonant sequences of a stem."""
    kinds = re.sub(r"(.)\1+", r"\1", "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem))))
    return kinds.count("vc")


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


def porter(word: str) -> str:
    """Stem of a lower-case ASCII word."""
    w = word
    if len(w) < 3:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(end)] for end in ("ed", "ing") if w.endswith(end) and _has_vowel(w[: -len(end)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    return words.map(porter)


def stem_vocabulary(tokens: DataFrame, column: str = "token", analyzer: str = "suffix", lemmas: DataFrame | None = None) -> DataFrame:
    """(token, lemma, stem) of the distinct tokens; ``lemmas`` (token, lemma) overrides the identity."""
    ship(tokens.sparkSession)
    words = tokens.select(F.col(column).alias("token")).distinct()
    if lemmas is not None:
        words = words.join(lemmas.select("token", "lemma"), "token", "left").withColumn("lemma", F.coalesce("lemma", "token"))
    else:
        words = words.withColumn("lemma", F.col("token"))
    if analyzer == "porter":
        return words.withColumn("stem", porter_stem("lemma"))
    if analyzer == "suffix":
        return words.withColumn("stem", tx.stem(F.col("lemma")))
    raise ValueError(f"no analyzer {analyzer!r}")


# Frequent function words by language, for pages that name none.
FUNCTION_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "für", "den", "von"],
    "en": ["the", "and", "of", "to", "is", "that", "in", "it", "for", "was", "with", "as"],
    "es": ["el", "los", "las", "y", "que", "del", "una", "por", "con", "para", "es", "en"],
    "fr": ["le", "les", "et", "des", "est", "que", "une", "dans", "pour", "qui", "du", "pas"],
}
#: Share of the words that a language's function words have at least.
LANGUAGE_SHARE = 0.1


def stop_word_language(text: Column) -> Column:
    """The language whose function words are most among the words, empty below LANGUAGE_SHARE.
    A heuristic: any detector over a text column may stand in for it."""
    w = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")
    share = lambda words: F.size(F.filter(w, lambda x: x.isin(words))) / F.greatest(F.size(F.filter(w, lambda x: x != "")), F.lit(1))
    best = F.array_max(F.array(*[F.struct(share(words).alias("share"), F.lit(name).alias("name")) for name, words in FUNCTION_WORDS.items()]))
    return F.when(best["share"] >= LANGUAGE_SHARE, best["name"]).otherwise(F.lit(""))


def capitalised_entities(pages: DataFrame) -> DataFrame:
    """(doc_id, entity, entity_type, frequency): runs of two capitalised words or more
    in the first NER_TEXT_LIMIT characters of title, description, headings and content,
    the first MAX_ENTITIES_PER_DOC of a page."""
    levels = F.col("headings")
    if isinstance(pages.schema["headings"].dataType, T.MapType):
        levels = F.flatten(F.map_values(levels))
    text = F.substring(F.concat_ws(". ", "title", "description", F.concat_ws(" ", levels), "content"), 1, config.NER_TEXT_LIMIT)
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0)))
    lower = F.array_distinct(F.transform(runs, lambda x: F.lower(x)))
    firsts = F.transform(lower, lambda k: F.filter(runs, lambda r: F.lower(r) == k)[0])
    rows = pages.select(F.col("id").alias("doc_id"), F.explode(F.slice(firsts, 1, config.MAX_ENTITIES_PER_DOC)).alias("entity"))
    return rows.select("doc_id", "entity", F.lit("NAME").alias("entity_type"), F.lit(1).alias("frequency"))
