"""The queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.shared import built_once
from lectern.llm.distinctive import concentrated, log_entropy
from lectern.llm.leaks import PositionalIndex
from lectern.llm.mixing import mix
from lectern.llm.near_duplicates import NearDuplicates, Sketching
from lectern.llm.spam import score_pages
from lectern.llm.splitting import split_oversized
from lectern.llm.term_counts import TermCounts
from lectern.llm.unify import same_form_pairs, unify_text


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark, d):
    """Both fields of problem 1 as rows field, id, text; their tokens are one vocabulary."""
    fields = (("chunk.text", "chunk", "chunk_id", "text"), ("request.question", "request", "request_id", "question"))
    a, b = (_table(spark, d, t).select(F.lit(field).alias("field"), F.col(key).alias("id"), F.col(text).alias("text")) for field, t, key, text in fields)
    return a.unionByName(b)


def p1_found(spark, d):
    return same_form_pairs(_texts(spark, d), "id", "text", "field")


def p1_tokens(spark, d):
    """The tokens of both fields that hold look-alike letters, with what was decided about each."""
    tokens = unify_text(_texts(spark, d), "text").tokens
    return tokens.groupBy("token", "candidate", "decision").agg(F.sum("texts").alias("texts"))


#: The case of problem 2 in this project's data: word triples, half of them shared.
TRIPLES = Sketching(shingle=3, threshold=0.5)


def p2_found(spark, d):
    return NearDuplicates(_table(spark, d, "chunk"), how=TRIPLES).pairs()


def p2_groups(spark, d):
    return NearDuplicates(_table(spark, d, "chunk"), how=TRIPLES).groups().select(F.col("key").alias("chunk_id"), "class", "copies", "links")


def p3_found(spark, d):
    return concentrated(_table(spark, d, "chunk"), min_records=4, percent=80).select("document", "term")


def p3_terms(spark, d):
    """The ten most characteristic terms of each document; a top-k report."""
    from pyspark.sql import Window

    w = Window.partitionBy("document").orderBy(F.desc("weight"), "term")
    weighed = log_entropy(_table(spark, d, "chunk")).withColumn("weight", F.round("weight", 6))
    return weighed.withColumn("place", F.row_number().over(w)).where("place <= 10")


def p4_found(spark, d):
    return split_oversized(_table(spark, d, "chunk")).where("piece = 0").select("chunk_id", "boundary")


def p4_pieces(spark, d):
    return split_oversized(_table(spark, d, "chunk"))


def p5_found(spark, d):
    counts = TermCounts(spark).apply(added=_table(spark, d, "chunk"))
    return counts.marked().where(F.col("mark").isNotNull()).select("term", "mark")


def p5_changes(spark, d):
    """The counts after a life of changes: all chunks and all questions are added, a batch comes twice, then every chunk is
    changed from its text to its heading."""
    chunk, request = _table(spark, d, "chunk"), _table(spark, d, "request")
    counts = TermCounts(spark).apply(added=chunk, batch=1)
    for _ in range(2):
        counts.apply(added=request, key="request_id", text="question", batch=2)
    headed = chunk.where(F.col("text").isNotNull()).select("chunk_id", F.coalesce("heading", F.lit("")).alias("text"))
    counts.apply(added=headed, deleted=chunk, batch=3)
    return counts.marked()


def _leaks(spark, d):
    documents = _table(spark, d, "documents")
    return built_once("leak-index", lambda: PositionalIndex(documents), documents)


def p6_found(spark, d):
    return _leaks(spark, d).phrases(_table(spark, d, "eval_item")).select("doc_id", "item_id").distinct()


def p6_near(spark, d):
    return _leaks(spark, d).near(_table(spark, d, "eval_item"))


def p7_mix(spark, d):
    return mix(_table(spark, d, "documents"), _table(spark, d, "mix_target")).chosen


def p7_shares(spark, d):
    return mix(_table(spark, d, "documents"), _table(spark, d, "mix_target")).shares


def p8_found(spark, d):
    return score_pages(_table(spark, d, "documents")).where("spam").select("doc_id")


def p8_scores(spark, d):
    return score_pages(_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_tokens, p2_found, p2_groups, p3_found, p3_terms, p4_found, p4_pieces, p5_found, p5_changes, p6_found, p6_near, p7_mix, p7_shares, p8_found, p8_scores)}
