"""Text functions as Column expressions.

The built-in analyzer: ASCII word tokens, stop words and length filter, the
token as its own lemma, and a suffix-stripping stem.  Everything stays in the
JVM and has the same meaning in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell import config

TOKEN = r"[a-zA-Z]+(?:['-][a-zA-Z]+)*"
STEM = "^(.{3,})(" + "|".join(config.SUFFIXES) + ")$"


def tokenize(text: Column) -> Column:
    """Lower-cased ASCII words, compounds kept together."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def stop_words() -> Column:
    return F.array(*[F.lit(w) for w in config.STOP_WORDS])


def is_clean(token: Column) -> Column:
    """All letters (a token has apostrophes and hyphens besides), of allowed length, no stop word."""
    return F.length(token).between(config.MIN_WORD_LENGTH, config.MAX_WORD_LENGTH) & ~token.contains("'") & ~token.contains("-") & ~token.isin(config.STOP_WORDS)


def clean_tokens(text: Column) -> Column:
    return F.filter(tokenize(text), is_clean)


def stem(token: Column) -> Column:
    return F.regexp_replace(token, STEM, "$1")


def stem_of_letters(token: Column) -> Column:
    """As ``stem``, of a token of letters alone: no suffix ends in another, so one at most fits."""
    out = token
    for x in config.SUFFIXES:
        out = F.when(token.endswith(x) & (F.length(token) >= 3 + len(x)), F.substring(token, F.lit(1), F.length(token) - len(x))).otherwise(out)
    return out


def process(text: Column) -> Column:
    """Stems of the clean tokens, in order, repeats kept."""
    return F.transform(clean_tokens(text), stem)


def distinct_stems(text: Column) -> Column:
    """The distinct stems of the clean tokens; each distinct token is stemmed once."""
    return F.array_distinct(F.transform(F.array_distinct(clean_tokens(text)), stem))


def stem_positions(text: Column) -> Column:
    """map stem -> positions in the clean token stream."""
    at = F.transform(process(text), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    stems = F.array_distinct(process(text))
    return F.map_from_arrays(stems, F.transform(stems, lambda s: F.transform(F.filter(at, lambda x: x["s"] == s), lambda x: x["i"])))


def pos_class(tag: Column) -> Column:
    """Word class of a Penn tag's first letter, else null."""
    return F.when(tag.startswith("J"), "a").when(tag.startswith("V"), "v").when(tag.startswith("N"), "n").when(tag.startswith("R"), "r")


def words(text: Column) -> Column:
    """White-space separated words."""
    spaces = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    return F.filter(F.split(F.coalesce(text, F.lit("")), spaces), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def syllables(word: Column) -> Column:
    """Vowel groups, a final e not counted, at least one."""
    w = F.lower(word)
    n = F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0)))
    return F.greatest(F.when(w.endswith("e") & (n > 1), n - 1).otherwise(n), F.lit(1))


def reading_ease(text: Column) -> Column:
    """Flesch reading ease, 0 to 100; 0 without words."""
    return reading_ease_of(tokenize(text), text)


def reading_ease_of(w: Column, text: Column) -> Column:
    """As ``reading_ease``, of a text whose tokens are at hand."""
    n = F.size(w)
    sentences = F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^.!?]*[^.!?\s][^.!?]*")), F.lit(1))
    total = F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x))
    ease = F.lit(206.835) - F.lit(1.015) * (n / sentences) - F.lit(84.6) * (total / F.greatest(n, F.lit(1)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease)))


def keyword_density(text: Column, keywords: list[str]) -> Column:
    """Share of the processed tokens whose stem is a keyword's."""
    stems = process(text)
    wanted = F.transform(F.array(*[F.lit(k.lower()) for k in keywords]), stem)
    return F.coalesce(F.try_divide(F.size(F.filter(stems, lambda s: F.array_contains(wanted, s))), F.size(stems)), F.lit(0.0))


def bigrams(stems: Column) -> Column:
    """Neighbouring pairs of an array."""
    n = F.size(stems)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(stems, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(stems, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def url_terms(url: Column) -> Column:
    """Distinct stems of the path's words."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#;]*)", 1)
    return F.array_distinct(process(F.array_join(F.split(path, r"[^a-zA-Z]+"), " ")))


def snippet(w: Column, stems: Column, window: int = config.SNIPPET_WINDOW) -> Column:
    """Up to twice ``window`` words around the chunk with most query stems.

    ``w`` are the content's words as a column of the row (it is read once a
    chunk).  Only all-letter words of a chunk count; the earliest best chunk
    wins, the first if none holds a stem; an ellipsis marks each cut."""
    n = F.size(w)
    starts = F.sequence(F.lit(0), F.greatest(F.least(n, F.lit(config.SNIPPET_WORDS)) - 1, F.lit(0)), F.lit(window))

    def hits(at):
        chunk = F.filter(F.slice(w, at + 1, F.lit(window)), lambda x: x.rlike(r"^\p{L}+$"))
        return F.size(F.array_intersect(F.transform(chunk, lambda x: stem(F.lower(x))), stems))

    ranked = F.transform(starts, lambda at: F.struct((-hits(at)).alias("h"), at.alias("at")))
    best = F.array_min(ranked)["at"]
    start = F.greatest(F.lit(0), best - window // 2)
    end = F.least(n, start + 2 * window)
    body = F.array_join(F.slice(w, start + 1, end - start), " ")
    first = F.substring(body, 1, 1)
    lead = F.when((start > 0) & ~((first == F.upper(first)) & (first != F.lower(first))), F.lit("…")).otherwise(F.lit(""))
    return F.when(n == 0, F.lit("")).otherwise(F.concat(lead, body, F.when(end < n, F.lit("…")).otherwise(F.lit(""))))
