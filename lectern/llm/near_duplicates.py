"""Near-duplicate records by banded MinHash and odd sketches (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.shared import discard, new_place, written
from lectern.llm.forms import with_form
from lectern.llm.terms import words

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Sketching:
    """``shingle`` words per shingle; ``samples`` MinHash values a text; ``bands`` of ``rows`` samples; odd sketches of
    ``bits`` bits.

    Two texts of similarity J share a band with probability 1 - (1 - J ** rows) ** bands. Where bands and rows are not
    given, they follow from the threshold: a pair that is just at it shares no band with a probability of about
    ``missed``, by the most rows, up to five, for which 160 bands are enough. Bands draw their samples at random and may
    share some. A candidate pair is kept when its sketches differ in no more bits than those of a pair at the threshold
    do, plus ``errors`` standard errors. Buckets of more than ``large`` texts are compared sketch by sketch in blocks
    instead of being written out as pairs.
    """

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 0
    rows: int = 0
    samples: int = 288
    bits: int = 768
    errors: float = 3.3
    missed: float = 0.01
    large: int = 32

    def __post_init__(self):
        needed = lambda rows: int(np.ceil(np.log(self.missed) / np.log1p(-min(self.threshold, 0.999) ** rows)))
        rows = self.rows or next((r for r in (5, 4, 3, 2) if needed(r) <= 160), 1)
        object.__setattr__(self, "rows", rows)
        object.__setattr__(self, "bands", self.bands or max(10, needed(rows)))

    @property
    def flips(self) -> int:
        """The samples that go into an odd sketch; more would fill its bits."""
        return min(self.samples, self.bits * 3 // 8)

    @property
    def most_odd(self) -> int:
        """The most differing bits with which a pair stays a candidate. Of n bits, k flips leave (1 - exp(-4 k (1 - J) / n)) / 2
        of them different; the error is that of so many bits and that of k samples."""
        n, k, j = self.bits, self.flips, self.threshold
        left = np.exp(-4 * k * (1 - j) / n)
        part = (1 - left) / 2
        error = np.sqrt(n * part * (1 - part) + (2 * k * left) ** 2 * j * (1 - j) / k)
        return int(np.ceil(n * part + self.errors * error))

    def members(self) -> np.ndarray:
        """Which samples each band is made of: bands x rows."""
        rng = np.random.default_rng(20240301)
        if self.bands * self.rows <= self.samples:
            return rng.permutation(self.samples)[: self.bands * self.rows].reshape(self.bands, self.rows)
        return np.array([rng.choice(self.samples, self.rows, replace=False) for _ in range(self.bands)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(flat: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` neighbouring word hashes in each text, concatenated, and how many each text has."""
    if len(flat) < k:
        return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64)
    run = flat[: len(flat) - k + 1].copy()
    for i in range(1, k):
        run = mixed(run) + flat[i : len(flat) - k + 1 + i] * np.uint64(2 * i + 1)
    counts = np.maximum(sizes - k + 1, 0)
    ends = np.cumsum(sizes)
    inside = np.ones(len(flat), bool)
    for i in range(1, k):  # runs that would reach over the end of their text
        at = ends - i
        inside[at[(at >= ends - sizes) & (at >= 0)]] = False
    return mixed(run[inside[: len(run)]]), counts


def sketches(flat: np.ndarray, counts: np.ndarray, how: Sketching) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands, 64 bits) and odd sketches (texts x bits / 64) of texts with at least one shingle each."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    factor = np.random.default_rng(20240229).integers(0, 2**32, how.samples, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    members, start = how.members().T, np.arange(how.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    apart = np.arange(how.flips, dtype=np.uint64) << np.uint64(32)
    keys = np.empty((len(counts), how.bands), np.uint64)
    odd = np.empty((len(counts), how.bits // 64), np.uint64)
    for at in range(0, len(counts), 128):  # few texts at a time, so that all that is made of them stays in the cache
        begin = starts[at : at + 128]
        least = np.empty((len(begin), how.samples), np.uint32)
        some = slice(begin[0], starts[at + 128] if at + 128 < len(counts) else None)
        one, two, inner = low[some], high[some], begin - begin[0]
        work = np.empty_like(one)
        for i in range(how.samples):
            np.multiply(one, factor[i], out=work)
            np.add(work, two, out=work)
            least[:, i] = np.minimum.reduceat(work, inner)
        key = np.tile(start, (len(begin), 1))
        for samples in members:
            key = mixed(key + least[:, samples])
        keys[at : at + 128] = key
        # Every sample flips one bit; samples are told apart by their number, so equal values of two of them do not cancel.
        spot = mixed(least[:, : how.flips].astype(np.uint64) + apart) % np.uint64(how.bits)
        spot = spot.astype(np.int64) + (np.arange(len(begin)) * how.bits)[:, None]
        flips = np.bincount(spot.ravel(), minlength=len(begin) * how.bits).reshape(len(begin), -1)
        odd[at : at + 128] = np.packbits((flips & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")
    return keys, odd


#: About so many band keys meet in one task.
MEETING = 1_000_000
#: Texts of a large bucket are compared in blocks of about so many.
BLOCK = 512


def packed(keys: np.ndarray, width: int) -> np.ndarray:
    """Ascending keys as the gaps between them; a gap of the largest number of ``width`` bytes or more is several of it."""
    top = np.uint64(2 ** (8 * width) - 1)
    gaps = np.diff(keys, prepend=np.uint64(0))
    more = (gaps // top).astype(np.int64)
    out = np.full(len(keys) + more.sum(), top, f"<u{width}")
    out[np.cumsum(more + 1) - 1] = gaps % top
    return out


def unpacked(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.uint64)[gaps != np.iinfo(gaps.dtype).max]


def ascending(keys: np.ndarray, tags: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order with their tags, each less than 2 ** ``room``; those of equal keys ascend too. Both are sorted as
    one number where they fit it, which takes a fraction of the time of sorting by index."""
    if len(keys) and int(keys.max()).bit_length() + room > 64:
        order = np.lexsort((tags, keys))
        return keys[order], tags[order]
    both = keys << np.uint64(room) | tags.astype(np.uint64)
    both.sort()
    return both >> np.uint64(room), (both & np.uint64(2**room - 1)).astype(tags.dtype)


def _sketched(how: Sketching, bits: int, parts: int):
    """Two kinds of rows: texts (id, rep, odd), and their band keys (part, at, gaps, who), packed by part of the key space.

    An id is the number of the batch and the place in it; ids are stored, so it does not matter how batches come to be.
    """
    width = next(w for w in (2, 4, 8) if w == 8 or 2 ** max(0, bits - 20) < 2 ** (8 * w - 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        pieces = (whole.slice(at, 10_000) for whole in batches for at in range(0, len(whole), 10_000))
        for number, batch in enumerate(pieces):
            lists = batch.column("words")
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            hashes, counts = shingle_hashes(np.asarray(lists.flatten()).view(np.uint64), sizes, how.shingle)
            some = counts > 0
            if not some.any():
                continue
            keys, odd = sketches(hashes, counts[some], how)
            at, n = (task << 20) | number, len(keys)
            none = lambda kind, k=n: pa.nulls(k, kind)
            words = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * odd.shape[1], pa.array(odd.view(np.int64).ravel()))
            ids = pa.array((np.int64(at) << 16) | np.arange(n))
            names = ["kind", "id", "rep", "odd", "part", "at", "gaps", "who"]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), ids, batch.column("rep").filter(pa.array(some)), words, none(pa.int32()), none(pa.int64()), none(pa.binary()), none(pa.binary())], names)
            keys = (keys >> np.uint64(64 - bits)).ravel()
            keys, who = ascending(keys, np.repeat(np.arange(n, dtype="<u2"), how.bands), 16)
            span = (np.uint64(1) << np.uint64(bits)) // np.uint64(parts) + np.uint64(1)
            edges = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) * span)
            held = np.flatnonzero(np.diff(edges))
            gaps = [packed(keys[edges[p] : edges[p + 1]] - np.uint64(p) * span, width).tobytes() for p in held]
            whose = [who[edges[p] : edges[p + 1]].tobytes() for p in held]
            k = len(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), none(pa.int64(), k), none(batch.schema.field("rep").type, k), none(words.type, k), pa.array(held.astype(np.int32)), pa.array(np.full(k, at, np.int64)), pa.array(gaps, pa.binary()), pa.array(whose, pa.binary())], names)

    return run, width


def _met(how: Sketching, width: int):
    """Of the band keys of one part: a and b, the ids of pairs that share a small bucket; a and bucket, the members of large
    buckets."""

    def run(table: pa.Table) -> pa.Table:
        gaps = [np.frombuffer(g, f"<u{width}") for g in table.column("gaps").to_pylist()]
        who = [np.frombuffer(w, "<u2") for w in table.column("who").to_pylist()]
        ends, who = np.cumsum([len(w) for w in who]), np.concatenate(who)
        keys, place = ascending(np.concatenate([unpacked(g) for g in gaps]), np.arange(len(who)), len(who).bit_length())
        same = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
        shared = np.flatnonzero(same[1:] | same[:-1])  # few keys are shared; all that follows is done for these alone
        keys, place = keys[shared], place[shared]
        ids = (np.asarray(table.column("at"))[np.searchsorted(ends, place, "right")] << 16) | who[place].astype(np.int64)
        first = np.flatnonzero(~same[shared])
        size = np.diff(np.append(first, len(keys)))
        many = np.repeat(size, size)
        part = np.int64(table.column("part")[0].as_py())
        large = many > how.large
        buckets = (part << 40) | np.repeat(np.arange(len(first)), size)[large]
        members = ids[large]
        keys, ids = keys[~large], ids[~large]
        texts, ids = np.unique(ids, return_inverse=True)  # pairs are told apart by one number made of the places of both ids
        met = []
        for apart in range(1, min(how.large, int(many[~large].max(initial=1)))):
            two = np.flatnonzero(keys[apart:] == keys[:-apart])
            a, b = ids[two], ids[two + apart]
            met.append(np.minimum(a, b)[a != b] * len(texts) + np.maximum(a, b)[a != b])
        pairs = np.unique(np.concatenate([*met, np.empty(0, np.int64)]))
        pairs = np.stack([texts[pairs // max(1, len(texts))], texts[pairs % max(1, len(texts))]], 1)
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({
            "a": pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(members)]),
            "b": pa.concat_arrays([pa.array(pairs[:, 1]), none(len(buckets))]),
            "bucket": pa.concat_arrays([none(len(pairs)), pa.array(buckets)]),
        })

    return run


def _compared_blocks(most_odd: int):
    """Of two blocks of a large bucket, or one with itself: the pairs of texts whose sketches are close enough."""

    def run(table: pa.Table) -> pa.Table:
        slot = np.asarray(table.column("slot"))
        reps = table.column("rep").combine_chunks()
        odd = np.asarray(table.column("odd").combine_chunks().flatten()).view(np.uint64).reshape(len(slot), -1)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(slot == i), np.flatnonzero(slot == j)
        a, b = [], []
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            apart = np.bitwise_count(odd[some][:, None, :] ^ odd[right][None]).sum(-1, dtype=np.int64)
            x, y = np.nonzero((apart <= most_odd) & ((i != j) | (some[:, None] < right[None])))
            a.append(some[x])
            b.append(right[y])
        at = lambda x: reps.take(pa.array(np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)))
        return pa.table({"a": at(a), "b": at(b)})

    return run


def shingles(words_column: str, k: int) -> Column:
    """The distinct runs of ``k`` consecutive words of an array column, as 64-bit hashes (those of slices, without cutting any)."""
    w = F.col(words_column)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
    return F.when(F.size(w) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


class NearDuplicates:
    """Classes of equal texts, and links between classes whose shingle sets are similar.

    ``members``: key and class (the least key of the records with the same text). ``links``: pairs of classes with their
    exact Jaccard similarity, at or over the threshold. Copies are never compared with each other and never expanded
    here: one record per class is sketched. Candidates are pairs that share a band and whose odd sketches are close; an
    exact comparison of the texts follows. The candidate search is probabilistic, no bucket is cut short.

    Nulls: rows with a null key or text are no records. Texts with fewer words than a shingle belong to a class but have
    no link. Repeated rows count once. An empty table gives empty results. Other columns are ignored.
    """

    def __init__(self, df: DataFrame, key: str = "chunk_id", text: str = "text", how: Sketching = Sketching()):
        self.how = how
        rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
        rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
        self.keyed = written(rows.groupBy("key", "h1", "h2").agg(F.count(F.lit(1)).alias("n")), "near-keys")
        # Of the classes only those of more than one row are told; every other row is a class by itself.
        classes = self.keyed.groupBy("h1", "h2").agg(F.min("key").alias("class"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"))
        self.many = written(classes.where("n > 1").drop("n"), "near-copies")
        self.reps = self._representatives(rows)
        self.links = self._links()
        self.members = written(self.keyed.join(self.many, ["h1", "h2"], "left").select("key", F.coalesce("class", "key").alias("class")), "near-members")

    def _representatives(self, rows: DataFrame) -> DataFrame:
        """rep, text: each class once. Only rows of classes that occur more than once meet a shuffle of their texts."""
        many = self.many.select("h1", "h2", F.lit(True).alias("many"))
        marked = rows.join(many, ["h1", "h2"], "left").select("key", "text", F.coalesce("many", F.lit(False)).alias("many"))
        once = marked.where(~F.col("many")).select(F.col("key").alias("rep"), "text")
        merged = marked.where("many").groupBy("text").agg(F.min("key").alias("rep")).select("rep", "text")
        return once.unionByName(merged)

    def _links(self) -> DataFrame:
        how, spark = self.how, self.keyed.sparkSession
        hashed = with_form(self.reps, "text", "form").select("rep", F.transform(words(F.col("form")), lambda w: F.xxhash64(w)).alias("words"))
        kind = hashed.schema["rep"].dataType.simpleString()
        # Key space and parts follow the number of texts, so that chance meetings and the work of a task do not grow with it.
        copies = self.many.agg(F.sum(F.col("keys") - 1)).first()[0] or 0
        keys = max(1, (self.keyed.count() - copies) * how.bands)
        bits, parts = min(62, keys.bit_length() + 8), max(1, keys // MEETING)
        run, width = _sketched(how, bits, parts)
        place = new_place(spark, "near-sketches")
        schema = f"kind int, id bigint, rep {kind}, odd array<bigint>, part int, at bigint, gaps binary, who binary"
        hashed.mapInArrow(run, schema).write.partitionBy("kind").parquet(place)
        rows = spark.read.schema(schema).parquet(place)
        self.sketched = texts = rows.where("kind = 0").select("id", "rep", "odd")
        tasks = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
        met = rows.where("kind = 1").select("part", "at", "gaps", "who").repartition(tasks, "part").groupBy("part").applyInArrow(_met(how, width), "a bigint, b bigint, bucket bigint")
        met_place = new_place(spark, "near-met")
        met.write.parquet(met_place)
        met = spark.read.schema(met.schema).parquet(met_place)
        discard(spark, f"{place}/kind=1")
        pairs = met.where("bucket is null").select("a", "b").repartition(tasks, "a").distinct()  # laid out for the next join
        near = pairs.join(texts.toDF("a", "rep_a", "odd_a"), "a").repartition(tasks, "b").join(texts.toDF("b", "rep_b", "odd_b"), "b")
        apart = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        near = near.where(apart <= how.most_odd).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        near = near.unionByName(self._large(met.where("bucket is not null"), texts, kind))
        near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near = written(near, "near-candidates")
        discard(spark, met_place)
        ends = near.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        # Written, so that only the texts of candidates are brought to one form and parted, and each once.
        texts = with_form(self.reps.join(ends, "rep", "left_semi"), "text", "form").select("rep", words(F.col("form")).alias("words"))
        texts = written(texts.select("rep", shingles("words", how.shingle).alias("shingles")), "near-texts")
        return self._compared(near, texts).where(F.col("similarity") >= how.threshold)

    def _large(self, members: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
        """a, b: pairs of texts in large buckets whose sketches are close. Buckets are cut into blocks, and every two
        blocks are one task's work, so no task holds a whole bucket and no pair is written before its sketches met."""
        blocks = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        rows = members.join(blocks, "bucket").join(texts.withColumnRenamed("id", "a"), "a")
        rows = rows.withColumn("slot", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("bucket", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "rep", "odd")
        return rows.groupBy("bucket", "i", "j").applyInArrow(_compared_blocks(self.how.most_odd), f"a {kind}, b {kind}")

    def _compared(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """a, b, similarity: the exact Jaccard similarity of the shingles of pairs of texts."""
        both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
        shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
        # Written before any threshold, which would else be pushed down and repeat the expressions under it.
        return written(shared.select("a", "b", (F.col("i") / (F.col("s") - F.col("i"))).alias("similarity")), "near-links")

    def groups(self) -> DataFrame:
        """key, class, copies (records of the class), links (classes it is linked to)."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
        sizes = self.members.groupBy("class").agg(F.countDistinct("key").alias("copies"))
        stats = sizes.join(ends, "class", "left").na.fill(0, ["links"])
        return self.members.join(stats, "class")

    def pairs(self) -> DataFrame:
        """All pairs of records, the smaller key first: copies of a class with each other, and across linked classes.

        The number of rows is what the question asks for; a class of n copies has n * (n - 1) / 2. Members of large
        classes are spread over salts, so that no task holds all pairs of one class.
        """
        m = self.members
        long = self.sketched.select(F.col("rep").alias("class"))  # texts with at least one shingle
        size = m.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(long, "class", "left_semi")
        salts = size.select("class", F.ceil(F.col("n") / 1000).cast("int").alias("salts"))
        inside = m.join(salts, "class")
        left = inside.select("class", F.col("key").alias("chunk_a"), F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"))
        right = inside.select("class", F.col("key").alias("chunk_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        copies = left.join(right, ["class", "salt"]).where("chunk_a < chunk_b").select("chunk_a", "chunk_b")
        across = (
            self.links.select("a", "b")
            .join(m.toDF("key_a", "a"), "a").join(m.toDF("key_b", "b"), "b")
            .select(F.least("key_a", "key_b").alias("chunk_a"), F.greatest("key_a", "key_b").alias("chunk_b"))
        )
        return copies.unionByName(across)
