"""Text as it is compared: normalised, parted into words, stemmed. All functions take and give columns.

Null text behaves as empty text. ``normalise`` decomposes by the ICU library that Spark ships, which the planner takes
for not deterministic, so it belongs into a projection, not into a join condition or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that editors put in unasked, and what they stand for; the last two vanish.
TIDIED = {
    "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " ", " ": " ",
    "​": "", "﻿": "",
}

# Words without meaning of their own, English and Italian.
EMPTY_WORDS = (
    "a an and are as at be by for from has have how i in is it me of on or that the this to was what when where which you"
    " your al alla alle che come con da dei del della delle di e gli i il in la le lo mi nel per più piu quale quali si su"
    " sul un una uno"
).split()

# Endings in the order they are tried, and how many characters must stay.
ENDINGS = ("ings", "ing", "edly", "ed", "est", "es", "s")
STEM_LEAST = 4

EDGES = r"(?<![^ ])[^\p{L}\p{N} ]+|[^\p{L}\p{N} ]+(?![^ ])"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tidied(c: Column) -> Column:
    return F.translate(or_empty(c), "".join(TIDIED), "".join(TIDIED.values()))


def normalise(c: Column) -> Column:
    """Tidied, without accents and compatibility forms, lower case, single spaces, trimmed."""
    plain = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), tidied(c), F.lit(True))
    plain = F.when(c.rlike(r"[^\x00-\x7f]"), F.regexp_replace(plain, r"[\x{300}-\x{36f}]+", "")).otherwise(or_empty(c))
    return F.trim(F.regexp_replace(F.lower(plain), r"(?U)[\s\x{feff}]+", " "))


def split_normalised(n: Column) -> Column:
    """Words of a normalised text, without what is no letter or digit at their ends; some may be empty."""
    return F.split(F.regexp_replace(n, EDGES, ""), " ")


def words(n: Column) -> Column:
    """Words of a normalised text."""
    return F.filter(split_normalised(n), lambda w: w != "")


def is_empty_word(w: Column) -> Column:
    return w.isin(EMPTY_WORDS)


def stem(w: Column) -> Column:
    """The word without the first ending that leaves enough characters."""
    out = None
    for ending in ENDINGS:
        fits = w.endswith(ending) & (F.length(w) >= len(ending) + STEM_LEAST)
        cut = F.left(w, F.length(w) - len(ending))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(w)


def meaningful(w: Column, least: int = 3) -> Column:
    """Whether a word is worth searching for; tested before stemming."""
    return (F.length(w) >= least) & ~is_empty_word(w)


def meaningful_words(n: Column, least: int = 3) -> Column:
    """Stems of the meaningful words of a normalised text, in order, repeats kept."""
    return F.transform(F.filter(words(n), lambda w: meaningful(w, least)), stem)


def page_words(pages: Column) -> Column:
    """Ascending page numbers as a reader says them: "page 2", "pages 2 and 5", "pages 1 to 39 and 41".

    Runs of three or more are said as a range. A page opens a part unless it continues a run of three or more.
    """
    at = lambda i: F.get(pages, i)

    def one(p: Column, i: Column) -> Column:
        # The length of the run that ends before p decides whether p stands inside a range.
        in_run = (at(i - 1) == p - 1) & ((at(i + 1) == p + 1) | (at(i - 2) == p - 2))
        starts = (at(i + 1) == p + 1) & (at(i + 2) == p + 2) & F.coalesce(at(i - 1) != p - 1, F.lit(True))
        ends = (at(i - 1) == p - 1) & (at(i - 2) == p - 2) & F.coalesce(at(i + 1) != p + 1, F.lit(True))
        alone = ~F.coalesce(in_run, F.lit(False)) & ~F.coalesce(starts, F.lit(False))
        return F.when(starts, F.concat(p.cast("string"), F.lit(" to "))).when(ends, F.concat(p.cast("string"), F.lit(","))).when(
            alone | F.coalesce((at(i - 1) == p - 1) & F.coalesce(at(i - 2) != p - 2, F.lit(True)) & F.coalesce(at(i + 1) != p + 1, F.lit(True)), F.lit(False)),
            F.concat(p.cast("string"), F.lit(",")),
        ).otherwise("")

    parts = F.filter(F.split(F.array_join(F.transform(pages, one), ""), ","), lambda s: s != "")
    n = F.size(parts)
    said = F.when(n == 1, F.get(parts, F.lit(0))).otherwise(
        F.concat(F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(parts, n - 1)))
    return F.when(F.size(pages) > 0, F.concat(F.when(F.size(pages) == 1, "page ").otherwise("pages "), said))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, which is what limits on characters count."""
    return F.octet_length(F.encode(or_empty(c), "UTF-16BE")) / 2
