"""Text as columns: tokens, normal forms, similarity. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """The words of a text: lower-case runs of letters, marks and digits, in order. Null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+"), lambda t: t != "")


def stem(word: Column) -> Column:
    """Plural forms of words of more than four letters: -ies to -y, else a final s goes."""
    long = F.length(word) > 4
    return F.when(long & word.endswith("ies"), F.concat(F.substring(word, 1, F.length(word) - 3), F.lit("y"))).when(
        long & word.endswith("s"), F.substring(word, 1, F.length(word) - 1)).otherwise(word)


def stems(text: Column, stop: Sequence[str] = ()) -> Column:
    """The distinct stems of a text's words, without stop words."""
    return F.array_distinct(F.transform(F.filter(tokens(text), lambda t: ~t.isin(list(stop))) if stop else tokens(text), stem))


def plain(text: Column) -> Column:
    """A text for comparing: no zero-width characters, straight quotes and dashes, single blanks, lower case.

    Composition of accents is not done here; it needs Python (see the training-data operators for exact forms).
    """
    t = F.regexp_replace(text, "[\\u200B-\\u200D\\u2060\\uFEFF\\u00AD]", "")
    t = F.translate(t, "‘’‚‛“”„‟–—−‐‑", "''''\"\"\"\"-----")
    return F.lower(F.trim(F.regexp_replace(t, "[\\s\\u00A0\\u2000-\\u200A\\u202F\\u3000]+", " ")))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's words, each word padded with two blanks before and one after."""
    words = tokens(text)
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all of both (Jaccard), 0 if both have none."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def has_all(tokens_of: Column, wanted: Sequence[str]) -> Column:
    """All wanted words are among the tokens."""
    out = F.lit(True)
    for word in wanted:
        out = out & F.array_contains(tokens_of, word)
    return out


def has_phrase(tokens_of: Column, phrase: Sequence[str]) -> Column:
    """The words of the phrase follow one another among the tokens."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens_of, " "), F.lit(" ")), F.lit(" " + " ".join(phrase) + " "))


def bare_name(text: Column) -> Column:
    """A name without punctuation and symbols at its ends, with single blanks, in lower case."""
    t = F.regexp_replace(F.regexp_replace(text, "^[\\p{P}\\p{S}\\s]+", ""), "[\\p{P}\\p{S}\\s]+$", "")
    return F.lower(F.regexp_replace(t, "\\s+", " "))


def key_of(name: Column, year: Column, term: Column) -> Column:
    """A key of name, year and term: letters and digits of the name without a leading article, `-year`, `-lsN`."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "^the\\s+", ""), "[^\\p{L}\\p{N}]", "")
    return F.concat(bare, F.lit("-"), year.cast("string"), F.lit("-ls"), term.cast("string"))


def once(column: Column) -> Column:
    """The column's value behind a generator, which keeps the optimizer from repeating it wherever it is used."""
    return F.explode(F.array(column))
