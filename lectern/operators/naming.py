"""What each document is called, and which document a question names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import is_empty_word, normalise, or_empty, split_normalised, stem, words
from lectern.operators.chunking import trimmed
from lectern.operators.questions import variants_of

# The shortest name worth matching, how many words of its own a document is called by, a part number.
LONG_ENOUGH, MOST_WORDS = 4, 4
PART_NUMBER = r"(?<![A-Za-z0-9_])[A-Za-z]{1,5}[-_ ]?\d{2,}(?![A-Za-z0-9_])"


def document_names(docs: DataFrame, key: str = "ord", text: str = "text") -> DataFrame:
    """key, name, name_ord: the spellings of the part numbers in the title, then at most four words of the title and the
    opening sentence that no other document uses, the longest first.

    How many documents use a word is counted over whole texts by one aggregation; the words of titles and openings are
    joined to the words used once. ``key`` must tell documents apart; null text has no names.
    """
    t = or_empty(F.col(text))
    title = F.regexp_replace(F.substring_index(t, "\n", 1), r"^#+\s*", "")
    body = trimmed(F.replace(F.when(F.contains(t, F.lit("\n")), F.substring(t, F.length(F.substring_index(t, "\n", 1)) + 2, F.length(t))).otherwise(""), F.lit("\n"), F.lit(" ")))
    opening = F.get(F.split(body, r"(?<=[.!?])\s", 2), F.lit(0))
    rows = docs.select(key, title.alias("title"), normalise(title).alias("t"), normalise(opening).alias("o"))

    used = docs.select(key, normalise(F.col(text)).alias("n")).select(key, F.explode(split_normalised(F.col("n"))).alias("w")).where("w <> ''")
    once = used.select(key, stem(F.col("w")).alias("name")).groupBy("name").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x = y").select("name")

    codes = rows.select(key, F.posexplode(F.regexp_extract_all("title", F.lit(PART_NUMBER), F.lit(0))).alias("i", "code"))
    spelled = codes.select(key, "i", F.posexplode(variants_of(F.col("code"))).alias("j", "name"))
    spelled = spelled.groupBy(key, "name").agg(F.min(F.struct(F.lit(0).alias("g"), F.col("i"), F.col("j"))).alias("at"))

    kept = lambda c: F.filter(words(F.col(c)), lambda w: (F.length(w) >= LONG_ENOUGH) & ~is_empty_word(w))
    own = rows.select(key, F.posexplode(F.concat(kept("t"), kept("o"))).alias("i", "w")).select(key, "i", stem(F.col("w")).alias("name"))
    own = own.groupBy(key, "name").agg(F.min("i").alias("i")).join(once, "name", "left_semi")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.length("name")), "i"))
    own = own.withColumn("j", rank).where(F.col("j") <= MOST_WORDS)
    own = own.select(key, "name", F.struct(F.lit(1).alias("g"), F.lit(0).alias("i"), F.col("j")).alias("at"))
    both = spelled.unionByName(own).groupBy(key, "name").agg(F.min("at").alias("at"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    return both.select(key, "name", order.alias("name_ord"))


def route(questions: DataFrame, names: DataFrame, qid: str = "qid", question: str = "question", key: str = "ord") -> DataFrame:
    """qid, document (null if none or a tie), weight, on: the document whose names the question says.

    A word and a name match if one begins with the other. Instead of holding every word against every name, both are
    met by equality: every beginning of a name with every word, and every beginning of a word with every name, so the
    join needs no nested loop and its cost grows with the text, not with the product. Equal best weights name nothing.
    """
    said = questions.select(qid, normalise(F.col(question)).alias("n")).select(qid, F.explode(F.array_distinct(split_normalised(F.col("n")))).alias("w"))
    said = said.where(F.length("w") >= LONG_ENOUGH).select(qid, stem(F.col("w")).alias("w")).distinct()
    begins = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.left(F.col(c), n)))
    by_name = said.join(names.where("name <> ''").select(key, "name", "name_ord", begins("name").alias("w")), "w").select(qid, key, "name", "name_ord")
    by_word = said.select(qid, begins("w").alias("name")).join(names.select(key, "name", "name_ord"), "name").select(qid, key, "name", "name_ord")
    hits = by_name.unionByName(by_word).distinct()
    weighed = hits.groupBy(qid, key).agg(F.sum(F.length("name")).alias("weight"), F.sort_array(F.collect_set(F.struct("name_ord", "name"))).alias("on"))
    best = Window.partitionBy(qid).orderBy(F.desc("weight"), key)
    ranked = weighed.withColumn("r", F.row_number().over(best)).withColumn("next", F.lead("weight").over(best)).where("r = 1")
    alone = F.col("next").isNull() | (F.col("next") < F.col("weight"))
    return ranked.select(qid, F.when(alone, F.col(key)).alias("document"), "weight", F.when(alone, F.transform("on", lambda x: x["name"])).otherwise(F.array().cast("array<string>")).alias("on"))
