"""How often the right passage comes first, per kind of question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def found(hits: DataFrame, gold: DataFrame, index, name: str) -> DataFrame:
    """qid, <name> (the first hit is of the gold document and heading), <name>_at_all (any hit is)."""
    shown = hits.join(index.chunks.select("doc", "chunk_ord", F.col("document").alias("d"), F.col("heading").alias("h")), ["doc", "chunk_ord"])
    right = shown.join(gold.select("qid", "document", "heading"), "qid")
    ok = F.col("d").eqNullSafe(F.col("document")) & F.col("h").eqNullSafe(F.col("heading"))
    seen = right.groupBy("qid").agg(F.max(ok & (F.col("rank") == 1)).alias(name), F.max(ok).alias(f"{name}_at_all"))
    return gold.select("qid").join(seen, "qid", "left").na.fill(False, [name, f"{name}_at_all"])


def outcomes(plain: DataFrame, better: DataFrame, gold: DataFrame, index) -> DataFrame:
    """gold rows with plain, plain_at_all, aware, aware_at_all."""
    return gold.join(found(plain, gold, index, "plain"), "qid").join(found(better, gold, index, "aware"), "qid")


def by_kind(results: DataFrame) -> DataFrame:
    """kind (null for all), plain, aware, of: right answers of both searches per kind and in total, kinds in the order
    they first appear."""
    hit = lambda c: F.sum(F.col(c).cast("int")).alias(c)
    rolled = results.rollup("kind").agg(hit("plain"), hit("aware"), F.count(F.lit(1)).alias("of"), F.min("qid").alias("first"), F.grouping("kind").alias("total"))
    return rolled.orderBy("total", "first").select("kind", "plain", "aware", "of")


def disagreements(results: DataFrame) -> DataFrame:
    return results.where("plain <> aware")


def misses(results: DataFrame) -> DataFrame:
    """Questions the aware search gets wrong; aware_at_all tells whether the passage was among its hits."""
    return results.where(~F.col("aware"))


def regressions(results: DataFrame, kind: str = "ordinary") -> DataFrame:
    """Ordinary questions that similarity alone got right and the aware search gets wrong; the gate is that none is."""
    return results.where((F.col("kind") == kind) & F.col("plain") & ~F.col("aware"))


def gate(results: DataFrame) -> bool:
    return regressions(results).isEmpty()
