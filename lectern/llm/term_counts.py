"""Occurrences and records of every term, kept up to date by signed changes (problem 5)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.shared import new_place
from lectern.llm.terms import records, term_rows

SCHEMA = "term string, occurrences bigint, records bigint, bucket int"
#: About so many bytes of text to a bucket, and how many buckets there may be.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 16, 1 << 16
#: The names of the last so many batches are remembered; one of them that comes again changes nothing.
REMEMBERED = 10_000


class TermCounts:
    """A persistent table of term counts in a folder, partitioned by a hash of the term.

    ``apply`` takes only the records that were added, changed or deleted; their counts enter with a sign and are merged
    into the buckets that hold their terms. Other buckets are neither read nor written. The empty term counts the records.

    A merge writes the touched buckets as a new version, then a manifest that names the version of every bucket, so a job
    that fails leaves the last complete state in force and is simply repeated. What a merge replaced is removed by the next
    one, so that tables already read stay readable until then. Terms whose records fall to zero leave the table. A
    ``batch`` that was applied before is a no-op, so a stream may repeat its last batch. One writer at a time.

    Nulls: a record with a null key or text does not exist. Empty and blank texts count as records and hold no term.
    Repeated rows count once. Empty tables give an empty table and no records. Other columns are ignored.
    """

    def __init__(self, spark: SparkSession, place: str | None = None, buckets: int | None = None):
        self.spark, self.place = spark, place or new_place(spark, "term-counts")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = {"version": 0, "buckets": buckets, "live": {}, "records": 0, "batches": [], "replaced": []}
        named = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.place))] if self._fs.exists(self._path(self.place)) else []
        if manifests := sorted(n for n in named if n.startswith("manifest-")):
            self.state = json.loads(spark.read.text(f"{self.place}/{manifests[-1]}", wholetext=True).first()[0])

    def _live(self, only: list[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        by_version: dict[int, list[int]] = {}
        for bucket, version in self.state["live"].items():
            if only is None or int(bucket) in only:
                by_version.setdefault(version, []).append(int(bucket))
        out = self.spark.createDataFrame([], SCHEMA)
        for version, buckets in by_version.items():
            out = out.unionByName(self.spark.read.schema(SCHEMA).parquet(f"{self.place}/v{version}").where(F.col("bucket").isin(buckets)))
        return out

    def counts(self) -> DataFrame:
        """term, occurrences, records."""
        return self._live().where("term <> ''").drop("bucket")

    def total(self) -> int:
        """The number of records."""
        return self.state["records"]

    def _suited(self, df: DataFrame) -> int:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, size // BUCKET_BYTES).bit_length()))

    def _written_buckets(self, df: DataFrame, to: str) -> list[int]:
        """Write rows by bucket, all of a bucket by one task, and tell which buckets there are."""
        df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(to)
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(to))]
        return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]

    def apply(self, added: DataFrame | None = None, deleted: DataFrame | None = None, key: str = "chunk_id", text: str = "text", batch: str | int | None = None) -> TermCounts:
        """Merge changes. A changed record is its old row in ``deleted`` and its new row in ``added``."""
        state = self.state
        if batch is not None and str(batch) in state["batches"]:
            return self
        n, buckets = state["version"] + 1, state["buckets"] or self._suited(added if added is not None else deleted)
        parts = [records(df, key, text=text).withColumn("sign", F.lit(sign)) for df, sign in ((added, 1), (deleted, -1)) if df is not None]
        changed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        delta = term_rows(changed, "sign", text=text, whole=True).groupBy("term").agg(
            F.sum(F.col("sign") * (1 - F.col("first"))).alias("occurrences"), F.sum(F.col("sign") * F.col("first")).alias("records"))
        delta = delta.where("records <> 0 or occurrences <> 0").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        live, new = dict(state["live"]), f"{self.place}/v{n}"
        if live:
            touched = self._written_buckets(delta, f"{self.place}/delta-{n}")
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.place}/delta-{n}").unionByName(self._live(touched))
            merged = rows.groupBy("bucket", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
            written = self._written_buckets(merged.where("records <> 0 or occurrences <> 0"), new)
        else:
            touched = written = self._written_buckets(delta, new)
        replaced = [f"v{live.pop(str(b))}/bucket={b}" for b in touched if str(b) in live]
        live |= {str(b): n for b in written}
        gone = {r.split("/")[0] for r in replaced} - {f"v{v}" for v in live.values()}
        self.state = state | {"version": n, "buckets": buckets, "live": live, "replaced": [*replaced, *sorted(gone), f"delta-{n}"], "batches": [*state["batches"], *([str(batch)] if batch is not None else [])][-REMEMBERED:]}
        home = self._live([self.spark.range(1).select(F.pmod(F.xxhash64(F.lit("")), F.lit(buckets)).cast("int")).first()[0]])
        self.state["records"] = int(home.where("term = ''").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0])
        self._record(n)
        for old in state["replaced"]:
            self._fs.delete(self._path(f"{self.place}/{old}"), True)
        if n > 2:
            self._fs.delete(self._path(f"{self.place}/manifest-{n - 2:010d}"), False)
        return self

    def _record(self, n: int) -> None:
        """Write the manifest under another name first: a name with a number stands for a whole file."""
        part, whole = self._path(f"{self.place}/part-manifest"), self._path(f"{self.place}/manifest-{n:010d}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        if not self._fs.rename(part, whole):
            raise OSError(f"the manifest of version {n} is there already: another writer changed {self.place}")

    def marked(self, rare_below: int = 3, common_above: int = 5) -> DataFrame:
        """Counts with ``mark``: rare under ``rare_below`` records, common in more than one of ``common_above`` records,
        else null. A term that is both, in a very small collection, is rare.
        """
        marked = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_above > F.lit(self.total()), "common")
        return self.counts().withColumn("mark", marked)
