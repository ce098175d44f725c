"""Words and terms of texts, and the records of a chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.forms import with_form

#: White space with the signs beside it: what lies between words. One pass both parts a text and trims its words.
BETWEEN = r"[^\p{L}\p{N}\s]*+\s[^\p{L}\p{N}]*"


def records(df: DataFrame, key: str = "chunk_id", *columns: str, text: str = "text") -> DataFrame:
    """The distinct records: rows with a key and a text, repeated rows once. Other columns do not count.

    Grouping by all columns keeps the texts out of aggregate buffers and combines copies before the shuffle. A key whose
    rows have different texts counts as one record for each text.
    """
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, *columns, text).distinct()


#: A word as ``BETWEEN`` leaves it.
WORD = r"[\p{L}\p{N}](?:\S*[\p{L}\p{N}])?"


def split_words(form: Column) -> Column:
    """Like ``words``, but empty strings may be among them."""
    return F.split(F.concat(F.lit(" "), F.lower(form), F.lit(" ")), BETWEEN)


def words(form: Column) -> Column:
    """Runs between white space in lower case, without what is no letter or digit at their ends; empty runs are none."""
    return F.regexp_extract_all(F.lower(form), F.lit(WORD), F.lit(0))


def term_rows(recs: DataFrame, *keep: str, text: str = "text", least: int = 3, whole: bool = False) -> DataFrame:
    """Terms of at least ``least`` characters: ``keep``, ``term`` and ``first``.

    Every occurrence is a row with ``first`` 0, and every distinct term of a record one more row with ``first`` 1, so
    one aggregation counts occurrences and records without a group per record. All of it runs in generated code. With
    ``whole`` every record has one more row with the empty term and ``first`` 1, so that the records are counted too.
    """
    df = with_form(recs, text, "__form").select(*keep, split_words(F.col("__form")).alias("__t"))
    lists = F.array(F.struct(F.lit(0).alias("first"), F.col("__t").alias("t")), F.struct(F.lit(1).alias("first"), F.array_distinct("__t").alias("t")))
    if whole:
        lists = F.array_append(lists, F.struct(F.lit(2).alias("first"), F.array(F.lit("")).alias("t")))
    df = df.select(*keep, F.inline(lists)).select(*keep, "first", F.explode("t").alias("term"))
    if not whole:
        return df.where(F.length("term") >= least)
    df = df.where((F.length("term") >= least) | (F.col("first") == 2))
    return df.withColumn("first", F.least("first", F.lit(1)))
