"""What kind of question is asked: does it stand alone, must something in it match letter for letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import EMPTY_WORDS, is_empty_word, meaningful_words, normalise, or_empty, words

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Words that point at something said before, in a normalised question.
POINTING = (
    r"it|its|that|those|these|this|the same|the other|the previous|the above|as said|as mentioned",
    r"quest[oaie]|quell[oaie]|quel|stess[oaie]|precedent[ei]|suddetto|come detto|di cui sopra",
)
POINTS_BACKWARDS = "|".join(f"{_B}({p}){_E}" for p in POINTING)

# Shapes that must match letter for letter: codes, calls and operators, back-quoted text, capitals.
LITERAL_SHAPES = (
    rf"{_B}(?:0[xX][0-9a-fA-F]{{4,}}|[A-Z]{{1,5}}[-_]?\d{{3,}}[A-Z]?){_E}",
    r"[A-Za-z_][A-Za-z0-9_]*\s*\(|::|->|=>",
    r"`[^`]+`",
    rf"{_B}[A-Z][A-Z0-9_]{{3,}}{_E}",
)
FEW_WORDS, FEW_CARRYING = 4, 1


def leaning(n: Column) -> Column:
    """struct(yes, why) of a normalised question: whether it leans on what came before."""
    pointing = F.regexp_extract(n, POINTS_BACKWARDS, 0)
    spoken = words(n)
    carrying = F.size(F.filter(spoken, lambda w: ~is_empty_word(w)))
    verdict = lambda yes, why: F.struct(F.lit(yes).alias("yes"), why.alias("why"))
    few = F.concat(F.lit("only "), carrying.cast("string"), F.when(carrying == 1, " word").otherwise(" words"), F.lit(" in it carries any meaning, so it is not about anything yet"))
    return (
        F.when(n == "", verdict(True, F.lit("there is no question")))
        .when(pointing != "", verdict(True, F.concat(F.lit('it says "'), pointing, F.lit('", which points at something said earlier'))))
        .when((F.size(spoken) <= FEW_WORDS) & (carrying <= FEW_CARRYING), verdict(True, few))
        .otherwise(verdict(False, F.lit("it names what it is about")))
    )


def literal(question: Column) -> Column:
    """struct(yes, term, why): the first match of the first shape that matches."""
    q = or_empty(question)
    term = F.coalesce(*[F.nullif(F.regexp_extract(q, shape, 0), F.lit("")) for shape in LITERAL_SHAPES])
    why = F.when(term.isNull(), "nothing in it has to match letter for letter").otherwise(F.concat(F.lit('"'), term, F.lit('" is a literal, not a meaning')))
    return F.struct(term.isNotNull().alias("yes"), term.alias("term"), why.alias("why"))


def literal_terms(question: Column) -> Column:
    """All matches of all shapes, each once, the longest first, equal lengths in the order they were found."""
    q = or_empty(question)
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(q, F.lit(shape), F.lit(0)) for shape in LITERAL_SHAPES]))
    keyed = F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("short"), i.alias("at"), t.alias("term")))
    return F.transform(F.array_sort(keyed), lambda s: s["term"])


def variants_of(code: Column) -> Column:
    """Spellings of a part number: letters and digits with a slash, a hyphen, a space, nothing; else its normal form."""
    together = F.regexp_replace(or_empty(code), r"(?U)\s+", "")
    letters, digits = F.lower(F.regexp_replace(together, "[^A-Za-z]", "")), F.regexp_replace(together, "[^0-9]", "")
    plain = F.filter(F.array(normalise(code)), lambda n: n != "")
    spelled = F.array(*[F.concat(letters, F.lit(sign), digits) for sign in ("/", "-", " ", "")])
    return F.when((letters != "") & (digits != ""), spelled).otherwise(plain)


def ways_of_writing(n: Column, variants: Column) -> Column:
    """The ways a normalised name is written: whole, its first word, its last two and three words, and ``variants``."""
    w = words(n)
    last = lambda k: F.array_join(F.slice(w, F.greatest(F.size(w) - (k - 1), F.lit(1)), k), " ")
    first = F.coalesce(F.get(w, F.lit(0)), F.lit(""))
    ways = F.concat(F.array(n, first, last(2), last(3)), variants)
    return F.array_distinct(F.filter(ways, lambda x: (F.length(x) >= 3) & ~x.isin(EMPTY_WORDS)))


def classify(df: DataFrame, question: str = "question", history: str = "history") -> DataFrame:
    """Add stands_alone, leaning, literal, terms, meaningful and last_question to a batch of questions.

    Null or empty histories have no last question; a null question is an empty one. A pure projection.
    """
    q, lean, lit = F.col(question), F.col("leaning"), F.col("literal")
    df = df.withColumn("__n", normalise(q)).withColumn("leaning", leaning(F.col("__n"))).withColumn("literal", literal(q))
    last = F.when(F.size(history) > 0, F.element_at(F.col(history), -1))
    return df.withColumns({
        "stands_alone": ~lean["yes"],
        "terms": F.when(lit["yes"], literal_terms(q)).otherwise(F.array().cast("array<string>")),
        "meaningful": meaningful_words(F.col("__n")),
        "last_question": last,
    }).drop("__n")


def carried(df: DataFrame, question: str = "question") -> DataFrame:
    """Add ``asked``: the question, followed by the meaningful words of the last one that it lacks, unless it stands alone.

    Needs the columns of ``classify``.
    """
    df = df.withColumn("__p", meaningful_words(normalise(F.col("last_question"))))
    more = F.filter("__p", lambda w: ~F.array_contains("meaningful", w))
    leans = ~F.col("stands_alone") & F.coalesce(F.col("last_question") != "", F.lit(False)) & (F.size(more) > 0)
    q = or_empty(F.col(question))
    return df.withColumn("asked", F.when(leans, F.concat_ws(" ", q, F.array_join(more, " "))).otherwise(q)).drop("__p")
