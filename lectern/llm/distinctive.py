"""Terms that set a document apart, by log-entropy weights (problem 3)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.shared import written
from lectern.llm.terms import term_rows

#: An owner with more rows than this is hot and is cut into slices of about so many rows, whatever the collection's size.
SLICE_ROWS = 50_000
#: The names of at most so many hot owners are broadcast; more are left to the planner, which splits skewed joins.
MOST_BROADCAST = 10_000


def _local(df: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """owner, term, occurrences, records of each owner and term, from the distinct records.

    Records are brought together by owner before they become terms, so terms of all but hot owners are counted without
    a shuffle of their own. Hot owners are spread over salts by their key and summed in a second step.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, owner, text)
    sizes = rows.groupBy(owner).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE_ROWS)
    hot = written(sizes.select(F.col(owner).alias("__hot"), F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias("__salts")), "hot-owners")
    few = hot.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    marked = rows.join(F.broadcast(hot) if few else hot, F.col(owner).eqNullSafe(F.col("__hot")), "left").drop("__hot")
    sums = (F.sum(1 - F.col("first")).alias("occurrences"), F.sum("first").alias("records"))
    cold = marked.where(F.col("__salts").isNull()).select(key, owner, text).repartition(owner).distinct()
    cold = term_rows(cold, owner, text=text).groupBy(owner, "term").agg(*sums)
    salted = marked.where(F.col("__salts").isNotNull()).withColumn("__salt", F.pmod(F.xxhash64(key), F.col("__salts")))
    salted = salted.select(key, owner, text, "__salt").repartition(owner, "__salt").distinct()
    salted = term_rows(salted, owner, text=text).groupBy(owner, "term").agg(*sums)
    return cold.unionByName(salted)


def _weighed(df: DataFrame, key: str, owner: str, text: str, min_records: int, by: str) -> DataFrame:
    """What ``log_entropy`` gives, with the number of owners in ``__owners``."""
    local = written(_local(df, key, owner, text), "owner-terms")
    owned = F.col(owner).isNotNull()
    f = F.when(owned, F.col(by))
    spread = local.groupBy("term").agg(F.sum("records").alias("all_records"), F.sum(f).alias("__f"), F.sum(f * F.ln(f)).alias("__flnf"))
    owners = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).agg(F.countDistinct(owner).alias("__owners"))
    entropy = F.ln("__f") - F.col("__flnf") / F.col("__f")
    share = F.when(F.col("__owners") > 1, F.greatest(F.lit(0.0), entropy / F.ln("__owners"))).otherwise(0.0)
    return (
        local.where(owned & (F.col("records") >= min_records))
        .join(spread, "term")
        .crossJoin(F.broadcast(owners))
        .select(owner, "term", "occurrences", "records", "all_records", (F.log1p(by) * (1 - share)).alias("weight"), "__owners")
    )


def log_entropy(df: DataFrame, key: str = "chunk_id", owner: str = "document", text: str = "text", min_records: int = 1, by: str = "occurrences") -> DataFrame:
    """Every owner with its terms and how characteristic each is: owner, term, occurrences, records, all_records, weight.

    The weight is ln(1 + local frequency in the owner) times one minus the entropy of the term's spread over the owners,
    as a share of the entropy of an even spread over all of them: 1 for a term of one owner only, near 0 for a term used
    evenly everywhere. The frequency is that of ``by``: ``occurrences`` or ``records``. Two aggregations compute it:
    occurrences and records per owner and term, written once, then entropy per term from those sums. No group is ever
    collected, and the join back on the term is left to the planner, which splits hot terms.

    ``min_records`` drops owner-term rows below that many records after the statistics are taken over all of them.
    Records without an owner count in ``all_records`` but own no row and take no part in the entropy. Null keys or texts are no records, blank texts
    have no terms, repeated rows count once, an empty table gives an empty result, other columns are ignored. With a
    single owner every entropy is 0 and every spread factor 1.
    """
    return _weighed(df, key, owner, text, min_records, by).drop("__owners")


def least_weight(min_records: int, percent: int, owners: Column) -> Column:
    """The least weight of a term of which an owner holds at least ``percent`` of the records, and ``min_records`` of them.

    With a share p of one owner, the entropy is largest if the rest is spread evenly over all other owners:
    h(p) + (1 - p) * ln(owners - 1), with h the entropy of two parts; from p = 1 / owners on it falls with p.
    """
    p = percent / 100
    two = -sum(x * math.log(x) for x in (p, 1 - p) if x > 0)
    most = two + (1 - p) * F.ln(F.greatest(owners - 1, F.lit(1)))
    spread = F.when((owners > 1) & (owners * p >= 1), F.greatest(F.lit(0.0), 1 - most / F.ln(owners))).when(owners > 1, 0.0).otherwise(1.0)
    return math.log1p(min_records) * spread


def concentrated(df: DataFrame, key: str = "chunk_id", owner: str = "document", text: str = "text", min_records: int = 4, percent: int = 80) -> DataFrame:
    """The rows of ``log_entropy`` by records whose owner holds at least ``percent`` of all records of the term.

    The weight selects: a term spread more widely than such a concentration allows weighs too little and is dropped. Of
    those left, the share itself is tested, because a large owner may weigh as much with a smaller share.
    """
    scored = _weighed(df, key, owner, text, min_records, "records")
    heavy = scored.where(F.col("weight") >= least_weight(min_records, percent, F.col("__owners")) - 1e-9)
    return heavy.where(F.col("records") * 100 >= F.col("all_records") * percent).drop("__owners")
