"""Text that reads the same, brought to one form with the vocabulary of the collection as witness (problem 1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.shared import written
from lectern.llm.forms import BORROWED, FOREIGN, LATIN, NEAR_LOOKALIKES, ODD, ODD_FLAG, _icu, plain_letters, with_folded

#: What parts tokens of a text; everything else, signs inside words included, belongs to a token.
GAPS = r"[\s.,;:!?()\[\]{}<>|\x22#*]+"
PIECES = r"[\s.,;:!?()\[\]{}<>|\x22#*]+|[^\s.,;:!?()\[\]{}<>|\x22#*]+"


@dataclass
class Unified:
    """``rows``: the input with the new column. ``tokens``: every suspicious token with what was decided and why; tokens
    whose ``decision`` is not ``kept`` are repaired, all others stay as they are."""

    rows: DataFrame
    tokens: DataFrame


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, GAPS), lambda w: w != "")


def unify_text(df: DataFrame, text: str, out: str = "form", vocabulary: DataFrame | None = None) -> Unified:
    """Bring ``text`` to one form: hidden characters gone, blanks, widths and joined letters plain, accents composed,
    look-alike letters repaired.

    Look-alikes are decided per token. A token is suspicious when it holds a look-alike; its dominant script comes from
    the letters only one alphabet has. A token with a letter proper to another alphabet is a word of that alphabet and
    stays. Of the others, those that mix in Latin letters, and those of look-alikes alone in a text of mostly Latin
    letters, are repaired if the result is in the vocabulary (decision ``vocabulary``): the tokens without look-alikes of
    the whole collection, or of ``vocabulary`` (a column ``token``), in any case of their letters.

    The vocabulary cannot know codes and part numbers that occur once. Two exits repair a token whose result is
    unknown, only in texts without any letter proper to another alphabet: ``script``, if it mixes look-alikes with Latin
    letters, and ``code``, if it is made of look-alikes and digits. Everything else stays, such as an unknown word of
    look-alikes alone, which may be a word of the other alphabet.

    Tokens are decided once each, however often they occur, by a join with the vocabulary, which is combined before the
    shuffle; what is repaired in a text comes back to it by a 128-bit hash. Rows without look-alikes are a projection.

    Nulls give null, empty and blank texts stay, rows are kept as often as they occur, other columns pass unchanged. An
    empty table gives an empty result. ``df`` must not have a column named ``out``.
    """
    o, odd, raw, token = F.col(out), F.col(ODD_FLAG), F.col(text), F.col("token")
    looks = lambda c: c.rlike(NEAR_LOOKALIKES) & (plain_letters(c) != c)

    def base(rows: DataFrame) -> DataFrame:
        return with_folded(rows, text, out).withColumn("__odd_letters", F.coalesce(odd & looks(o), F.lit(False)))

    def composed_form(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.when(odd, _icu("compose", o)).otherwise(o))

    def composed(rows: DataFrame) -> DataFrame:
        return composed_form(rows).select(*df.columns, out)

    clear = composed(base(df).where(~F.col("__odd_letters")))
    # The filter on the raw text lets the scan drop most rows before any other work on them.
    doubtful = base(df.where(raw.rlike(BORROWED))).where(F.col("__odd_letters"))
    doubtful = doubtful.withColumns({"__h1": F.xxhash64(out), "__h2": F.xxhash64(F.lit(1), out), "__plain": plain_letters(o)})
    count = lambda letters: F.length("__plain") - F.length(F.regexp_replace("__plain", letters, ""))
    texts = doubtful.withColumns({"__foreign": F.col("__plain").rlike(FOREIGN), "__latin": count(f"{LATIN}+") >= count(f"{FOREIGN}+")})
    held = texts.select("__h1", "__h2", "__foreign", "__latin", F.explode(F.filter(F.array_distinct(_tokens(o)), looks)).alias("token"))
    suspects = held.groupBy("token", "__foreign", "__latin").agg(F.count(F.lit(1)).alias("texts")).withColumn("plain", plain_letters(token))
    # Composition is marked as not deterministic, so it stands in a projection of its own, after the aggregation.
    suspects = suspects.withColumn("candidate", _icu("compose", F.col("plain"))).withColumn("__word", F.lower("candidate"))
    if vocabulary is None:
        # Every row has words to give, also those with characters to fold.
        clean = df.where(~raw.rlike(ODD)).select(F.explode(_tokens(raw)).alias("token"))
        words = F.when(F.col("__odd_letters"), F.filter(_tokens(o), lambda w: ~looks(w))).otherwise(_tokens(o))
        vocabulary = clean.unionByName(composed_form(base(df.where(raw.rlike(ODD)))).select(F.explode(words).alias("token")))
    known = vocabulary.select(F.lower("token").alias("__word")).distinct().withColumn("known", F.lit(True))
    mixed, own = token.rlike(LATIN), F.col("plain").rlike(FOREIGN)
    decision = (
        F.when(own, "kept").when(F.col("known") & (mixed | F.col("__latin")), "vocabulary")
        .when(F.col("__foreign"), "kept").when(mixed, "script").when(token.rlike(r"\p{N}"), "code").otherwise("kept")
    )
    # Written, as both results read it, and so that the planner knows how few they are.
    decided = written(suspects.join(known, "__word", "left").select("token", "__foreign", "__latin", "plain", "candidate", "texts", decision.alias("decision")), "look-alikes")
    repairs = decided.where("decision <> 'kept'").select("token", "__foreign", "__latin", "plain")
    found = (
        held.distinct().join(repairs, ["token", "__foreign", "__latin"])
        .groupBy("__h1", "__h2").agg(F.map_from_entries(F.collect_list(F.struct("token", "plain"))).alias("__repairs"))  # at most the tokens of one text
    )
    pieces = F.regexp_extract_all(o, F.lit(PIECES), F.lit(0))
    repaired = F.array_join(F.transform(pieces, lambda t: F.coalesce(F.element_at("__repairs", t), t)), "")
    joined = doubtful.join(found, ["__h1", "__h2"], "left").withColumn(out, F.when(F.col("__repairs").isNull(), o).otherwise(repaired))
    return Unified(clear.unionByName(composed(joined)), decided.select("token", "candidate", "texts", "decision"))


def same_form_pairs(df: DataFrame, key: str, text: str, *within: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """``within`` columns, id_a, id_b, the smaller first: rows of the same ``within`` whose texts differ in characters but
    have the same one form.

    Null and blank texts and null keys are left out, repeated rows count once, identical texts are no pair. Rows meet by
    two hashes of the form, 128 bits together, so the texts themselves are not shuffled; forms written in only one way
    are dropped before rows meet, and members of forms with very many rows are spread over salts.
    """
    rows = df.where(F.col(key).isNotNull() & (F.trim(text) != "")).select(*within, F.col(key).alias("id"), F.col(text).alias("text"))
    unified = unify_text(rows, "text", vocabulary=vocabulary).rows.where(~F.col("form").rlike(r"^\s*$"))
    same = [*within, "f1", "f2"]
    hashed = unified.select(*within, "id", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(1), "form").alias("f2"), F.xxhash64("text").alias("raw")).distinct()
    hashed = written(hashed, "form-hashes")
    several = hashed.groupBy(*same).agg(F.min("raw").alias("x"), F.max("raw").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    salts = F.ceil(F.col("n") / 1000).cast("int")
    members = hashed.join(several.select(*same, salts.alias("salts")), same)
    a = members.select(*same, F.col("id").alias("id_a"), F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    b = members.select(*same, F.col("id").alias("id_b"), F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return a.join(b, [*same, "salt"]).where("id_a < id_b and raw_a <> raw_b").select(*within, "id_a", "id_b").distinct()
