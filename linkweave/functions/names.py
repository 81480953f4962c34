"""Native column rules for titles and publishers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _plain() -> tuple[str, str]:
    """Letters that decompose to one letter and marks, with those letters; then the marks, which go. Up to U+30FF, by Unicode's canonical decomposition."""
    found, marks = {}, []
    for code in (*range(0x80, 0x3100), *range(0xFE20, 0xFE30)):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if bare != c and len(bare) == 1:
            found[c] = bare
    return "".join(found) + "".join(marks), "".join(found.values())


#: What ``translate`` needs: characters, and those that take their place; others without one are removed.
ACCENTED, PLAIN = _plain()


def fold(c: Column) -> Column:
    """Letters without their accents and other marks."""
    return F.translate(c, ACCENTED, PLAIN)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# What a text has that squeezing, folding and the rules of strict names, endings and publishers change; most have none of it, and one look is cheaper than to rewrite them.
UNSQUEEZED = r"  |\A | \z"
FOREIGN, LOOSE, ENDED, COMPANY = rf"[^\x20-\x7e]|{UNSQUEEZED}", rf"[^A-Za-z0-9 ]|{UNSQUEEZED}", r"(?i)\(|vol|ii|annual", r"[\s(]"


def strip_volume(c: Column) -> Column:
    """Without a trailing ``, Vol. n``."""
    return F.regexp_replace(c, r"(?i),\s*vol\.?\s*\d+\s*$", "")


# Endings that a collection's titles have and the catalog's don't, in the order in which they are cut.
ENDINGS = (r"(?i)\s*\((?:Marvel|Comic Books|Cartoon Books)[^)]*\)\s*$", r"(?i),?\s*(?:Vol\.?|Volume)\s*\d+(?=\s|$)", r"(?i)\s+(?:II|III)\s*$", r"(?i),?\s*Annual\s*$", r"\s*\(\d{4}\)\s*$")


def collection_name(c: Column) -> Column:
    """A collection's title as the catalog may have it."""
    cut = c
    for ending in ENDINGS:
        cut = F.regexp_replace(cut, ending, "")
    return F.trim(F.when(c.rlike(ENDED), cut).otherwise(c))


def base_name(c: Column) -> Column:
    """What stands before the first colon or long dash."""
    return F.trim(F.regexp_extract(c, "^([^:–—]*)", 1))


def normalized(c: Column) -> Column:
    """Without publisher or year in parentheses, volume, roman numeral or ``Annual`` at the end."""
    c = F.regexp_replace(c, r"(?i)\s*\([^)]*(comics|publishing)[^)]*\)", "")
    c = F.regexp_replace(c, r"(?i),?\s*vol(ume)?\.?\s*\d+\s*$", "")
    c = F.regexp_replace(c, r"\s+I{2,3}\s*$", "")
    c = F.regexp_replace(c, r"(?i)\s+annual\s*$", "")
    return squeeze(F.regexp_replace(c, r"\s*\(\d{4}\)\s*$", ""))


def strict(c: Column) -> Column:
    """Folded lower case, ``&`` as and, only ASCII letters, digits and single spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(fold(c)), "&", "and"), r"[^a-z0-9\s]", "")
    return F.when(c.rlike(LOOSE), squeeze(bare)).otherwise(F.lower(c))


def key(c: Column) -> Column:
    """The exact key: folded lower case."""
    return F.lower(F.when(c.rlike(FOREIGN), fold(squeeze(c))).otherwise(c))


def word_key(c: Column) -> Column:
    """Distinct words of the lower-cased name in order; null with fewer than two."""
    found = F.sort_array(F.array_distinct(F.split(key(c), " ")))
    return F.when(F.size(found) >= 2, F.array_join(found, " "))


def comma_key(c: Column) -> Column:
    """Key with ``: `` written as ``, ``; null if nothing changes."""
    return F.when(F.instr(c, ": ") > 0, F.replace(key(c), F.lit(": "), F.lit(", ")))


def article_key(c: Column) -> Column:
    """Key without a leading article, or with one if it has none."""
    k = key(c)
    return F.when(k.startswith("the "), F.substring(k, F.lit(5), F.length(k))).otherwise(F.concat(F.lit("the "), k))


def search_term(k: Column) -> Column:
    """Key without a leading article, and without the letters of `` the`` at its end."""
    return F.regexp_replace(F.regexp_replace(k, "^(?:the|a|an) ", ""), "[ the]+$", "")


def publisher(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    cut = F.regexp_replace(F.regexp_replace(c, r"(?i)\s+and\s+.*$", ""), r"\s*\([^)]*\)", "")
    cut = squeeze(F.regexp_replace(cut, r"(?i)\s+(publishing|comics|entertainment)\s*$", ""))
    return F.lower(F.when(c.rlike(COMPANY), cut).otherwise(c))


def words(c: Column) -> Column:
    """Distinct words."""
    return F.array_distinct(F.split(c, " "))


def similarity(a: Column, b: Column, a_words: Column | None = None, b_words: Column | None = None) -> Column:
    """1 if equal; contained: by length, more at the front; else Jaccard of the words, which may be given."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    ratio = F.length(short) / F.length(long)
    x, y = words(a) if a_words is None else a_words, words(b) if b_words is None else b_words
    shared = F.size(F.array_intersect(x, y))
    jaccard = shared / (F.size(x) + F.size(y) - shared)
    return F.when(a == b, F.lit(1.0)).when(F.startswith(long, short), F.least(F.lit(0.9), 1.4 * ratio)).when(F.contains(long, short), 0.8 * ratio).otherwise(jaccard)
