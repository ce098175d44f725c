"""One written form for text that reads the same.

``with_form`` adds the one form of a text column by built-in expressions only, so that every operator of this
subpackage can compare texts without a Python worker.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks other than the plain space (line breaks are no blanks).
BLANKS = "\t\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

# Scripts and signs in which the two joiners change what a reader sees; elsewhere they show nothing.
JOINERS = r"[\x{200c}\x{200d}]"
JOINING = r"[\p{IsArabic}\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsMalayalam}\p{IsKannada}\p{IsSinhala}\p{So}\p{Sk}]"

# Fillers and selectors that show nothing although Unicode does not class them as format characters.
FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"

# Letters of other alphabets that look like a plain Latin letter. Letters that stand for units (mu, omega)
# and letters that a reader tells apart are not in it.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s",
    "і": "i", "ј": "j", "Ү": "Y", "ү": "y", "һ": "h", "Ԁ": "D", "ԁ": "d", "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w",
    # Armenian
    "Տ": "S", "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "օ": "o",
    # phonetic letters that are drawn like a plain one
    "ɑ": "a", "ɡ": "g", "ɩ": "i",
}

# Signs drawn like the hyphen-minus, and the micro sign.
SAME_SIGNS = {"‐": "-", "‑": "-", "µ": "μ"}

# Joined Latin letters.
LIGATURES = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "Ĳ": "IJ", "ĳ": "ij",
}


def _signs() -> dict[str, str]:
    """Full-width, half-width and styled characters, by the Unicode tables, with the plain one each shows."""
    out = {}
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        kind = unicodedata.decomposition(chr(code)).partition(" ")[0]
        if kind in ("<wide>", "<narrow>", "<font>") and len(plain := unicodedata.normalize("NFKC", chr(code))) == 1:
            out[chr(code)] = plain
    return out | dict.fromkeys(BLANKS, " ") | SAME_SIGNS


def _hidden() -> str:
    """Characters that show nothing: control and format characters but line breaks and joiners, selectors, fillers."""
    codes = [*range(0x3000), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0001, 0xE0080), *range(0xE0100, 0xE01F0)]
    shown = "\t\n\x0b\x0c\r\x85\u200c\u200d\u2028\u2029"
    return FILLERS + "".join(
        c for c in map(chr, codes) if c not in shown and (unicodedata.category(c) in ("Cc", "Cf") or ord(c) >= 0xFE00)
    )


SIGNS = _signs()
HIDDEN = _hidden()
for _c in FILLERS:
    SIGNS.pop(_c, None)
_FROM = "".join(SIGNS) + "".join(dict.fromkeys(HIDDEN))
_TO = "".join(SIGNS.values())  # characters past its end are deleted

# Regular expressions that scan whole texts use single characters below U+0100 and at most two ranges: classes of many
# ranges are an order of magnitude slower. Each only decides which rows get a closer look.
_LOW = "".join(rf"\x{ord(c):02x}" for c in SIGNS | dict.fromkeys(HIDDEN) if ord(c) < 0x80 or c in "\xa0\xad\xb5")
ODD = rf"[{_LOW}]|[\x{{132}}-\x{{133}}\x{{250}}-\x{{10ffff}}]"
ODD_FLAG = "__odd"
NEAR_LIGATURES = r"[\x{132}-\x{133}\x{fb00}-\x{fb06}]"
#: Combining marks, letters of the lending alphabets, and signs that Unicode defines as equal to a letter.
UNSETTLED = r"[\x{250}-\x{58f}\x{1ab0}-\x{212b}]"
NEAR_LOOKALIKES = r"[\x{250}-\x{2af}\x{370}-\x{58f}]"
#: Greek, Cyrillic and Armenian letters but those for units; in a text without look-alikes, letters proper to them.
FOREIGN = r"[\x{370}-\x{3a8}\x{3aa}-\x{3bb}\x{3bd}-\x{3c8}\x{3ca}-\x{58f}]"
#: Any letter of the blocks that lend look-alikes, in a text as it was typed, and the styled ones that fold to them.
BORROWED = r"[\x{250}-\x{2af}\x{370}-\x{58f}]|[\x{1f00}-\x{1fff}]|[\x{213c}-\x{213f}\x{1d6a8}-\x{1d7cb}]"
LATIN = r"[A-Za-z\x{c0}-\x{24f}]"


def plain_letters(c: Column) -> Column:
    """Look-alikes as the Latin letters they are drawn like."""
    return F.translate(c, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


def _tokenwise(c: Column) -> Column:
    """Look-alikes repaired only in tokens that mix them with Latin letters and hold no letter proper to their alphabet."""
    tokens = F.regexp_extract_all(c, F.lit(r"\s+|\S+"), F.lit(0))
    mixed = lambda t: t.rlike(LATIN) & ~plain_letters(t).rlike(FOREIGN)
    return F.array_join(F.transform(tokens, lambda t: F.when(mixed(t), plain_letters(t)).otherwise(t)), "")


def _icu(method: str, c: Column) -> Column:
    """Canonical (de)composition by the ICU library that Spark ships for its collations: no Python worker is needed."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), c, F.lit(False))


def with_folded(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``text`` without hidden characters, with plain blanks, widths and joined letters, and accents decomposed where
    a look-alike may carry them; also a flag of the rows that need more work.

    Each step is a projection of its own, so that no step's expression is repeated inside the next. Null gives null.
    """
    t, o, odd = F.col(text), F.col(out), F.col(ODD_FLAG)
    df = df.withColumn(ODD_FLAG, F.coalesce(t.rlike(ODD), F.lit(False)))
    df = df.withColumn(out, F.when(odd, F.translate(t, _FROM, _TO)).otherwise(t))
    df = df.withColumn(out, F.when(odd & o.rlike(JOINERS), F.regexp_replace(o, f"(?<!{JOINING}){JOINERS}+", "")).otherwise(o))
    joined = o
    for k, v in LIGATURES.items():
        joined = F.replace(joined, F.lit(k), F.lit(v))
    df = df.withColumn(out, F.when(odd & o.rlike(NEAR_LIGATURES), joined).otherwise(o))
    df = df.withColumn(ODD_FLAG, odd & o.rlike(UNSETTLED))
    return df.withColumn(out, F.when(odd, _icu("decompose", o)).otherwise(o))


def with_form(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the one form of ``text`` as ``out``: what a reader sees, written with ordinary characters.

    Look-alike letters are repaired by script alone: in a text with Latin letters and without any letter proper to another
    alphabet all of them, else only those in tokens that also hold Latin letters. ``unify_text`` adds the vocabulary to that decision.
    Null gives null, empty gives empty; line breaks, case, accents and raised digits stay.
    """
    o, plain, odd = F.col(out), F.col("__plain"), F.col(ODD_FLAG)
    df = with_folded(df, text, out).withColumn("__plain", F.when(odd & o.rlike(NEAR_LOOKALIKES), plain_letters(o)))
    df = df.withColumn(out, F.when(plain.isNull(), o).when(~plain.rlike(FOREIGN) & o.rlike(LATIN), plain).otherwise(_tokenwise(o)))
    return df.withColumn(out, F.when(odd, _icu("compose", o)).otherwise(o)).drop(ODD_FLAG, "__plain")
