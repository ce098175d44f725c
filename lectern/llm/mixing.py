"""Sources mixed to target shares of tokens, by Pareto order sampling (problem 7)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.shared import written

#: Where the files of public tokenizers lie, and the one that counts.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
LARGEST_RANKS = 64 << 20
# Fixed value: how the byte-level vocabulary above parts a text before merging.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Order scores are looked up by bin first, so that only the documents of one bin are ever sorted together.
BINS = 16384


def token_counter(spark: SparkSession, folder: str = TOKENIZERS, ranks: str = RANKS):
    """A column function: the number of tokens of a text. The driver reads the vocabulary and sends it to the workers,
    which need no file of their own and prepare it once each."""
    with open(f"{folder}/{ranks}", "rb") as f:
        held = f.read()
    if len(held) > LARGEST_RANKS:
        raise ValueError(f"{ranks} is larger than the {LARGEST_RANKS} bytes that are sent to the workers")
    sent = spark.sparkContext.broadcast(held)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encoder = tiktoken.Encoding("counting", pat_str=PARTS, mergeable_ranks=known, special_tokens={})
        for texts in batches:
            tokens = encoder.encode_ordinary_batch(texts.fillna("").tolist(), num_threads=1)
            yield pd.Series([len(t) for t in tokens], dtype="Int64").where(texts.notna().to_numpy())

    return count


def same_source(c: Column) -> Column:
    """Spellings of a source that differ in case, outer blanks and the sign between words are one."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


@dataclass
class Mix:
    """``chosen``: key, source, tokens, copies. ``shares``: one row per target with what was asked and what it got."""

    chosen: DataFrame
    shares: DataFrame


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        total: float | None = None, seed: int = 7, count=None) -> Mix:
    """Choose documents, some more than once, so that each source has its target share of all tokens.

    ``total`` tokens are aimed at; by default the most at which every source that has documents can still keep its
    share with no document used more than its ``max_repeats`` times. Targets of sources without documents are shared out
    in proportion. With a larger ``total`` a source gives all it may, and ``shares`` tells what it fell short.

    Within a source a document should appear in inverse proportion to the number of documents with the same text, at
    most ``max_repeats`` times. The whole part of that expectation is certain; the fraction is the odds in a Pareto
    sample: documents are ranked by their own random odds u / (1 - u) over the odds of being included, and taken in that
    order until the source's remaining tokens are filled, to within half a document. The random numbers are hashes of
    ``seed`` and the key, so a rerun or a lost executor changes nothing.

    The order is found without sorting a source: scores are summed by ``BINS`` bins, whole bins below the quota are
    taken, and only the documents of the bin that crosses it are sorted.

    Nulls: documents with a null key, text or source, or a source that has no target, are left out; texts without tokens
    too. Repeated rows count once. Empty tables give no choice and zero shares. Other columns are ignored.
    """
    goal = targets.where(F.col("source").isNotNull() & F.col("target_share").isNotNull()).select(
        same_source(F.col("source")).alias("__s"), F.col("source").alias("proper"), "target_share", "max_repeats").dropDuplicates(["__s"])
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), same_source(F.col(source)).alias("__s"), F.col(text).alias("text"))
    rows = rows.join(goal.select("__s"), "__s", "left_semi")
    sized = rows.select("key", "__s", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), (count or token_counter(docs.sparkSession))(F.col("text")).alias("tokens"))
    sized = written(sized.where("tokens > 0"), "mix-sizes").distinct()
    same = sized.groupBy("__s", "h1", "h2").agg(F.count(F.lit(1)).alias("same"))
    sized = written(sized.join(same, ["__s", "h1", "h2"]).drop("h1", "h2"), "mix-same")

    # What each source has, by number of equal texts: a table of few rows.
    by_same = sized.groupBy("__s", "same").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("docs"))
    has = by_same.groupBy("__s").agg(F.sum("t").alias("has_tokens"), F.sum("docs").alias("has_docs"))
    plan = goal.join(has, "__s", "left").na.fill(0, ["has_tokens", "has_docs"])
    everyone = Window.partitionBy()
    asked = F.when(F.col("has_tokens") > 0, F.col("target_share"))
    plan = plan.withColumn("__w", F.try_divide(asked, F.sum(asked).over(everyone)))
    most = F.min(F.when(F.col("__w") > 0, F.col("has_tokens") * F.col("max_repeats") / F.col("__w"))).over(everyone)
    plan = plan.withColumn("budget", F.least((F.lit(float(total)) if total else most) * F.col("__w"), F.col("has_tokens") * F.col("max_repeats")))
    plan = written(plan, "mix-plan")

    # The level so that tokens * least(max_repeats, level / same) adds up to the budget: scarce texts reach the cap first.
    steps = by_same.join(plan.select("__s", "budget", "max_repeats"), "__s")
    upto = Window.partitionBy("__s").orderBy("same").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("__s").orderBy("same").rowsBetween(0, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("t").over(upto), F.lit(0)) * F.col("max_repeats")
    level = (F.col("budget") - capped) / F.sum(F.col("t") / F.col("same")).over(after)
    steps = steps.withColumn("level", level).where(F.col("level") <= F.col("max_repeats") * F.col("same") * (1 + 1e-12))
    levels = steps.groupBy("__s").agg(F.min_by("level", "same").alias("level"))
    levels = plan.join(levels, "__s").select("__s", "level", "max_repeats", "budget", "proper")

    u = (F.xxhash64(F.lit(seed), "key").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    expected = F.least(F.col("max_repeats").cast("double"), F.col("level") / F.col("same"))
    d = sized.join(levels, "__s").withColumn("e", F.when(F.abs(expected - F.round(expected)) < 1e-9, F.round(expected)).otherwise(expected))
    d = d.withColumn("whole", F.floor("e").cast("int")).withColumn("p", F.col("e") - F.floor("e")).withColumn("u", u)
    score = F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + F.col("p") * (1 - F.col("u")))  # odds q as q / (1 + q)
    d = d.withColumn("score", F.when(F.col("p") > 0, score)).withColumn("bin", F.floor(F.col("score") * BINS).cast("int"))
    d = written(d.select("key", "__s", "tokens", "whole", "p", "score", "bin", "proper"), "mix-scored")
    bins = d.where("bin is not null").groupBy("__s", "bin").agg(F.sum("tokens").alias("t"))
    need = d.groupBy("__s").agg(F.sum(F.col("tokens") * F.col("p")).alias("quota"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("__s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = bins.withColumn("before", before).join(need, "__s").where(F.col("before") < F.col("quota")).select("__s", "bin", "t", "before", "quota")
    part = d.join(edges, ["__s", "bin"], "left")
    inner = F.col("before") + F.col("t") <= F.col("quota")
    sure = part.where(F.col("bin").isNull() | F.col("before").isNull() | inner).withColumn("more", F.coalesce(inner, F.lit(False)).cast("int"))
    order = Window.partitionBy("__s", "bin").orderBy("score", "key").rowsBetween(Window.unboundedPreceding, -1)
    edge = part.where(F.col("before").isNotNull() & ~inner)
    so_far = F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0)) + F.col("tokens") / 2
    edge = edge.withColumn("more", (so_far <= F.col("quota")).cast("int"))
    chosen = sure.unionByName(edge).withColumn("copies", F.col("whole") + F.col("more")).where("copies > 0")
    chosen = written(chosen.select("key", "proper", "tokens", "copies"), "mix-chosen")

    got = chosen.groupBy("proper").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    shares = plan.join(got, "proper", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    shares = shares.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(everyone)), F.lit(0.0)))
    return Mix(
        chosen.select(F.col("key").alias(key), F.col("proper").alias("source"), "tokens", "copies"),
        shares.select(F.col("proper").alias("source"), "target_share", "max_repeats", "has_docs", "has_tokens", "documents", "most_copies", "tokens", "share"),
    )
