"""Held-out passages inside a corpus, by a positional inverted index of it (problem 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.functions.shared import written
from lectern.llm.forms import with_form

#: Items are sent to the workers in blocks of at most so many words, for ``near`` alone; more items mean more passes over
#: their lists in the index.
BLOCK_WORDS = 1_000_000
#: Documents whose places share a list; a place is the number of the document in its block, and the number of the word.
BLOCK_BITS = 13
#: Lists of more places than this are spread over the files of the index by block.
LONG_LIST = 1024


def tokens(form: Column) -> Column:
    """Runs of letters and digits, in lower case; empty strings may stand at both ends."""
    return F.split(F.lower(form), r"[^\p{L}\p{N}]+")


def tokenised(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, words. Null keys and texts have no row."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return with_form(rows, "text", "form").select("key", F.array_remove(tokens(F.col("form")), "").alias("words"))


@dataclass
class Block:
    """Items as the workers hold them: term numbers of all items in a row, and the words that are among the rarest of a
    window of ``run`` words, sorted by term."""

    run: int
    items: list
    starts: np.ndarray  # of each item in ``terms``; one more than items
    terms: np.ndarray
    window_item: np.ndarray
    anchor_terms: np.ndarray  # anchors x 1
    anchor_offs: np.ndarray
    anchor_windows: np.ndarray  # anchors x run: of which of the windows around it each is an anchor
    anchor_around: np.ndarray  # anchors x (2 * run - 1): the words around it, rarest first


def _anchors(block_terms: list[np.ndarray], used: np.ndarray, run: int, depth: int) -> tuple[np.ndarray, ...]:
    """Item, term and offset of every word that is among the ``depth`` rarest of a window, with those of the ``run``
    windows around it of which it is, the earliest first, and the words around it in the order of their rarity."""
    parts = []
    for i, t in enumerate(block_terms):
        if len(t) < run:
            continue
        order = np.argsort(used[np.lib.stride_tricks.sliding_window_view(t, run)], axis=1, kind="stable")[:, :depth]
        start = np.repeat(np.arange(len(order)), order.shape[1])
        off = start + order.ravel()
        windows = np.zeros((len(t), run), bool)
        windows[off, start - off + run - 1] = True
        off = np.flatnonzero(windows.any(axis=1) & (used[t] > 0))
        around = off[:, None] + np.arange(1 - run, run)
        rarity = np.where((around >= 0) & (around < len(t)), used[t[np.clip(around, 0, len(t) - 1)]], np.iinfo(np.int64).max)
        parts.append((np.full(len(off), i), t[off], off, windows[off], np.argsort(rarity, axis=1, kind="stable").astype(np.int16)))
    if not parts:
        return np.empty(0, np.int64), np.empty((0, 1), np.int64), np.empty((0, 1), np.int64), np.empty((0, run), bool), np.empty((0, 2 * run - 1), np.int16)
    item, terms, offs, windows, around = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(terms, kind="stable")
    return item[order], terms[order, None], offs[order, None], windows[order], around[order]


class Postings:
    """The lists of the wanted terms for some documents, in the order of documents and places."""

    def __init__(self, term: np.ndarray, places: np.ndarray):
        order = np.argsort(places, kind="stable")
        self.at, self.term = places[order], term[order]
        self.rows, self.pos = self.at >> 32, self.at & 0xFFFFFFFF
        self.by_term = None

    def near(self, rows: np.ndarray, pos: np.ndarray, term: np.ndarray, slop: int) -> np.ndarray:
        """Whether each term stands at most ``slop`` places from its place."""
        if not len(self.at):
            return np.zeros(len(rows), bool)
        if self.by_term is None:
            self.room, self.terms = int(self.pos.max()) + 1, int(self.term.max()) + 1
            self.by_term = np.sort((self.rows * self.terms + self.term) * self.room + self.pos)
        low, high = np.maximum(pos - slop, 0), np.minimum(pos + slop, self.room - 1)
        line = (rows * self.terms + term) * self.room
        i = np.searchsorted(self.by_term, line + low)
        return (low <= high) & (term < self.terms) & (i < len(self.by_term)) & (self.by_term[np.minimum(i, len(self.by_term) - 1)] <= line + high)


def _first(p: Postings, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, window and shift wherever the rarest term of a window stands."""
    lead = block.anchor_terms[:, 0]
    low, high = np.searchsorted(lead, p.term, "left"), np.searchsorted(lead, p.term, "right")
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
    return p.rows[which], window, p.pos[which] - block.anchor_offs[window, 0]


def _close(p: Postings, block: Block, slop: int, least: int) -> list[tuple]:
    """Row, item and the most words of a window, at least ``least``, that stand within ``slop`` of where one of its
    anchors puts them."""
    rows, anchors, shifts = _first(p, block)
    sizes = np.diff(block.starts)
    best: dict[tuple, int] = {}
    for at in range(0, len(rows), 100_000):
        row, anchor, shift = rows[at : at + 100_000], anchors[at : at + 100_000], shifts[at : at + 100_000]
        # What each window may still reach: every word that is not there takes one, the rarest words are looked up first.
        left = np.where(block.anchor_windows[anchor], block.run, 0).astype(np.int16)
        for k in range(2 * block.run - 1):
            item, around = block.window_item[anchor], block.anchor_around[anchor, k].astype(np.int64)
            off = block.anchor_offs[anchor, 0] + around - block.run + 1
            inside = (off >= 0) & (off < sizes[item])
            term = block.terms[block.starts[item] + np.where(inside, off, 0)]
            gone = ~(inside & p.near(row, shift + off, term, slop))
            first = around[:, None] - np.arange(block.run)
            left -= gone[:, None] & (first >= 0) & (first < block.run)
            stay = left.max(axis=1, initial=0) >= least
            row, anchor, shift, left = row[stay], anchor[stay], shift[stay], left[stay]
        for r, i, n in zip(row.tolist(), block.window_item[anchor].tolist(), left.max(axis=1, initial=0).tolist()):
            best[r, i] = max(best.get((r, i), 0), n)
    return [(r, i, w) for (r, i), w in best.items()]


class PositionalIndex:
    """A positional inverted index of a corpus: for every term the places where it stands.

    ``tokens``: doc, key, words of every document. ``postings``: term, at, n, places: the places of a term in a block of
    documents, each the number of the document in its block and the number of the word, in ascending order. All words
    of all documents are in it, so it serves any set of items and is built once. Workers turn whole batches of documents
    into lists, so that what is shuffled is lists and not words; lists come together by term, the long ones of frequent
    terms are spread by block.

    Nulls: rows with a null key or text are left out. Empty texts match nothing. Repeated rows give each match once.
    Empty tables give empty results, other columns are ignored.
    """

    def __init__(self, corpus: DataFrame, key: str = "doc_id", text: str = "text"):
        self.key, self.spark = key, corpus.sparkSession
        # Numbered once: the table is read back, so a lost executor cannot number documents anew.
        self.tokens = written(tokenised(corpus, key, text).withColumn("doc", F.monotonically_increasing_id()), "leak-tokens")
        lists = self.tokens.select("doc", "words").mapInArrow(_inverted, "term string, at bigint, n int, places array<bigint>")
        spread = F.when(F.col("n") > LONG_LIST, F.col("at")).otherwise(-1)
        self.postings = written(lists.repartition(F.col("term"), spread).sortWithinPartitions("term"), "leak-postings")

    def _items(self, items: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame]:
        """item, words; and term, used: how often each term of the items stands in the corpus."""
        held = written(tokenised(items, item, text).distinct().withColumnRenamed("key", "item"), "leak-items")
        terms = held.select(F.explode("words").alias("term")).distinct()
        used = self.postings.select("term", "n").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("used"))
        return held, written(used, "leak-used")

    def phrases(self, items: DataFrame, item: str = "item_id", text: str = "text", run: int = 10) -> DataFrame:
        """key, item, doc_pos, item_pos, length: every maximal run of at least ``run`` consecutive words in both.

        Each window of ``run`` words of an item is looked up by its three rarest terms: the list of the rarest one, less
        its offset in the item, intersected with those of the next two, block by block. A run of that length holds all
        terms of its windows, so none is missed; the few places left are held against the words of item and document.
        """
        held, used = self._items(items, item, text)
        depth = min(3, run)
        words = held.select("item", F.posexplode("words").alias("off", "term")).join(used, "term", "left")
        words = words.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("off", F.coalesce("used", F.lit(0)).alias("used"), "term"))).alias("w"))  # the words of one item
        rare = lambda s: F.slice(F.array_sort(F.transform(F.slice("w", s + 1, run), lambda x: F.struct(x["used"], x["off"], x["term"]))), 1, depth)
        windows = words.where(F.size("w") >= run).select("item", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - run), rare))).alias("a"))
        anchors = written(windows.where(F.col("a")[0]["used"] > 0).select("item", "a"), "leak-anchors")
        wanted = anchors.select(F.explode("a.term").alias("term")).distinct()
        lists = written(self.postings.select("term", "at", "places").join(wanted, "term", "left_semi"), "leak-lists")
        less = lambda c, k: F.transform(c, lambda x: x - F.col("a")[k]["off"])
        met = anchors.withColumn("term", F.col("a")[0]["term"]).join(lists, "term").select("item", "a", "at", less("places", 0).alias("shifts"))
        for k in range(1, depth):
            met = met.withColumn("term", F.col("a")[k]["term"]).join(lists, ["term", "at"])
            met = met.select("item", "a", "at", F.array_intersect("shifts", less("places", k)).alias("shifts")).where(F.size("shifts") > 0)
        first = F.col("shift") + F.col("a")[0]["off"]
        places = met.select("item", "a", "at", F.explode("shifts").alias("shift"))
        places = places.select("item", (F.shiftleft("at", BLOCK_BITS) + F.shiftright(first, 32)).alias("doc"), (first.bitwiseAND(F.lit(0xFFFFFFFF)) - F.col("a")[0]["off"]).cast("int").alias("shift"))
        places = written(places.distinct(), "leak-places")
        both = places.join(self.tokens, "doc").join(held.withColumnRenamed("words", "said"), "item")
        same = F.transform("said", lambda w, i: F.coalesce((i + F.col("shift") >= 0) & (F.get("words", F.greatest(i + F.col("shift"), F.lit(0))) == w), F.lit(False)))
        both = both.select("key", "item", "shift", same.alias("same"))
        starts = F.filter(F.sequence(F.lit(0), F.size("same") - 1), lambda i: F.get("same", i) & ~F.coalesce(F.get("same", i - 1), F.lit(False)))
        end = lambda i: F.array_position(F.slice("same", i + 1, F.size("same")), False)
        runs = F.transform(starts, lambda i: F.struct(i.alias("item_pos"), F.when(end(i) > 0, end(i) - 1).otherwise(F.size("same") - i).cast("int").alias("length")))
        found = both.select("key", "item", "shift", F.explode(runs).alias("r")).where(F.col("r.length") >= run)
        found = found.select(F.col("key").alias(self.key), F.col("item").alias(item), (F.col("shift") + F.col("r.item_pos")).alias("doc_pos"), "r.item_pos", "r.length")
        return found.distinct()

    def _blocks(self, held: DataFrame) -> Iterator[list]:
        """Items with their words, in blocks; the driver holds one block at a time."""
        block, size = [], 0
        for r in held.toLocalIterator():
            block.append((r["item"], r["words"]))
            size += len(r["words"])
            if size >= BLOCK_WORDS:
                yield block
                block, size = [], 0
        if block:
            yield block

    def near(self, items: DataFrame, item: str = "item_id", text: str = "text", run: int = 10, slop: int = 3, share: float = 0.8) -> DataFrame:
        """key, item, words: documents that hold at least ``share`` of some ``run`` words of an item, each at most
        ``slop`` places from where one of its rarest words puts it: passages with words changed, dropped or put in.

        If so many words may be missing, one of that many and one more rarest words is there, whichever was changed; all
        of them are looked up, so names and numbers that no document has need not be among the words found. Only the
        lists of the items' words are read from the index; they are intersected by block of documents.
        """
        held, used = self._items(items, item, text)
        least = max(1, math.ceil(share * run - 1e-9))
        depth = min(run, max(1, run - least + 1))
        kind = held.schema["item"].dataType.simpleString()
        found = self.spark.createDataFrame([], f"doc bigint, item {kind}, words int")
        for block in self._blocks(held):
            vocabulary = sorted({w for _, ws in block for w in ws})
            number = {w: i for i, w in enumerate(vocabulary)}
            terms = self.spark.createDataFrame(pa.table({"term": pa.array(vocabulary, pa.string()), "number": pa.array(range(len(vocabulary)), pa.int32())}))
            often = np.zeros(len(vocabulary), np.int64)
            for r in used.join(terms, "term").select("number", "used").collect():  # as many as the block's terms
                often[r["number"]] = r["used"]
            numbers = [np.array([number[w] for w in ws], np.int64) for _, ws in block]
            starts = np.concatenate([[0], np.cumsum([len(t) for t in numbers])]).astype(np.int64)
            held_block = (run, [k for k, _ in block], starts, np.concatenate([*numbers, np.empty(0, np.int64)]), *_anchors(numbers, often, run, depth))
            sent = self.spark.sparkContext.broadcast(held_block)
            lists = self.postings.select("term", "at", "places").join(terms, "term").select("number", "at", "places")
            found = found.unionByName(lists.groupBy("at").applyInArrow(_searching(sent, slop, least, to_arrow_type(held.schema["item"].dataType)), f"doc bigint, item {kind}, words int"))
        keyed = found.join(self.tokens.select("doc", "key"), "doc")
        return keyed.groupBy(F.col("key").alias(self.key), F.col("item").alias(item)).agg(F.max("words").alias("words"))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of a batch of documents: term, at, n, places."""
    for batch in batches:
        lists = batch.column("words")
        sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        doc = np.asarray(batch.column("doc")).astype(np.int64)
        at = np.repeat(doc >> BLOCK_BITS, sizes)
        pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        places = (np.repeat(doc & ((1 << BLOCK_BITS) - 1), sizes) << 32) | pos
        for block in np.unique(at):
            some = at == block
            code, held = np.asarray(coded.indices)[some].astype(np.int64), places[some]
            order = np.argsort(code, kind="stable")  # places stay in order within a term
            code, held = code[order], held[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            n = np.diff(np.append(first, len(code))).astype(np.int32)
            parted = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(held))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), pa.array(np.full(len(n), block)), pa.array(n), parted], ["term", "at", "n", "places"])


def _searching(sent, slop: int, least: int, kind: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        block, at = Block(*sent.value), table.column("at")[0].as_py()
        lists = table.column("places").combine_chunks()
        term = np.repeat(np.asarray(table.column("number")), np.asarray(pc.list_value_length(lists))).astype(np.int64)
        found = _close(Postings(term, np.asarray(lists.flatten())), block, slop, least)
        rows, items, words = zip(*found) if found else ((), (), ())
        return pa.table({"doc": pa.array([(at << BLOCK_BITS) + r for r in rows], pa.int64()), "item": pa.array([block.items[i] for i in items], kind), "words": pa.array(words, pa.int32())})

    return run
