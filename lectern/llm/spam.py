"""Keyword-stuffed pages and link lists, by the perplexity of their word classes under an n-gram model of prose (problem 8)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.shared import written
from lectern.llm.forms import with_form

# Common function words of several languages of Latin script.
FUNCTION_WORDS = {
    "en": "a after all an and any are as at be because before but by can do for from has have if in into is it its more must"
    " no not of on only or other out over should so than that the their then there they this to until use was what when"
    " where which while will with without you your",
    "de": "aber alle als am an auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat"
    " im ist kann können man mit muss nach nicht noch nur oder ohne sich sie sind sobald sonst so über um und unter vom von"
    " vor wenn wer wird zu zum zur",
    "fr": "à au aux avant avec ce ces cette dans de des dès du elle en est et faut il jamais la le les leur mais ne on ou par"
    " pas peut plus pour quand que qui sa sans se semble ses si son sur trop un une",
    "it": "agli ai al alla anche che chi come con da dal dalla dei del della delle di dopo dove e gli i il in la le lo ma nel"
    " nella non o ogni oltre per perché più poi prima può quando se senza si sia sono sul un una uno è",
    "es": "al antes aunque cada como con cuando de del desde donde el ella en es esta este hasta hay la las lo los más no o"
    " para pero por porque puede que se ser si sin sobre son su también un una y ya",
    "pt": "ao antes até com como da das de do dos e em entre essa esse está foi isso mais mas na não nas no nos o os ou para"
    " pela pelo pode por quando que se sem ser seu sua também um uma",
    "nl": "aan als bij dan dat de deze die dit door een en er het hij in is kan maar met moet naar niet nog of om onder ook op"
    " over te tot uit van voor wanneer wat werd wordt zijn zo zonder",
    "sv": "av att den det där efter eller en ett för från har i inte kan med men måste när och om på ska som till utan var vid är",
    "pl": "aby ale bez dla do gdy i jak jest już lub może na nie o od oraz po pod przed przez przy się są tak to w z za że",
}
# Signs with a class of their own; other signs share one, but those that only mark up quotes and emphasis
# have none.
SIGNS = ".,;:!?|-–()[]\"'/#&=+"
MARKUP = ">*"

_WORDS = sorted({w for words in FUNCTION_WORDS.values() for w in words.split()})
PARAGRAPH, FUNCTION, NUMBER, CODE, LINK, TAG, CAPITAL, LOWER, CAPITAL_AGAIN, LOWER_AGAIN, OTHER = range(11)
FIRST_SIGN = OTHER + 1
CLASSES = FIRST_SIGN + len(SIGNS)  # a class is one byte
#: Added to the class of a first or second mention of what is said again later.
AHEAD = 128
#: From the class of a content word to that of its repetition.
TO_AGAIN = LOWER_AGAIN - LOWER
#: How many words back the last function word, figure or full stop lies counts up to here.
LONGEST = 7
#: Numbers of a model.
SIZE = (LONGEST + 1) * CLASSES**3
#: A text is read twice: the first two mentions of what is said again count as plain words, then as repetitions too.
READINGS = 2
IS_WORD = np.array([FUNCTION <= c <= LOWER_AGAIN for c in range(CLASSES)])
ENDS_RUN = np.array([c in (PARAGRAPH, FUNCTION, NUMBER) or (c >= FIRST_SIGN and SIGNS[c - FIRST_SIGN] in ".!?") for c in range(CLASSES)])


@dataclass(frozen=True)
class Spam:
    """``window``: tokens of a piece. ``memory``: how many words back two mentions of a pair of neighbouring words make
    the next one a repetition. ``above``, ``below``: how many standard deviations of the pieces of prose make the
    perplexity of a piece abnormally high or low; shorter pieces may be off by more. ``share``: the part of a page's words
    in abnormal pieces that makes it spam. ``least``: pages of fewer words cannot be judged."""

    window: int = 24
    memory: int = 150
    above: float = 6.0
    below: float = 4.5
    share: float = 0.5
    least: int = 8


#: Tables that a Python worker makes once.
_MADE: dict = {}


def _made(make):
    if make.__name__ not in _MADE:
        _MADE[make.__name__] = make()
    return _MADE[make.__name__]


def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every character below U+10000: its kind (0 sign, 1 letter, 2 digit, 3 blank, 4 line break), its lower case, and
    its class if it is a sign."""
    kind, lower, sign = np.zeros(65536, np.uint8), np.arange(65536, dtype=np.uint32), np.full(65536, OTHER, np.uint8)
    for i in range(65536):
        c = chr(i)
        kind[i] = 4 if c == "\n" else 3 if c.isspace() or i == 0 else 1 if c.isalpha() or c == "_" or unicodedata.category(c)[0] == "M" else 2 if c.isalnum() else 0
        if len(low := c.lower()) == 1 and ord(low) < 65536:
            lower[i] = ord(low)
    for i, c in enumerate(SIGNS):
        sign[ord(c)] = FIRST_SIGN + i
    return kind, lower, sign


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _hashes(lower: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the characters of each word; words start at ``starts`` and follow each other in ``lower``."""
    place = np.arange(len(lower)) - np.repeat(starts, sizes)
    return _mixed(np.add.reduceat(_mixed(lower.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63] + place.astype(np.uint64), starts)) if len(starts) else np.empty(0, np.uint64)


def _function_words() -> np.ndarray:
    chars = np.frombuffer("".join(_WORDS).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) for w in _WORDS])
    return np.sort(_hashes(chars, np.cumsum(sizes) - sizes, sizes))


def classes(texts: list[str], memory: int = 150, ahead: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The class of every token of every text in a row, and the number of tokens of each text.

    Words are runs of letters and digits with single joining signs inside; a sign is a token, of white space only a blank
    line is. Content words whose pair with the content word before was said twice within the last ``memory`` words have
    classes of their own; with ``ahead`` those two mentions have ``AHEAD`` added to theirs. All texts are worked on together,
    character by character, by array operations.
    """
    kinds, lowers, signs = _made(_characters)
    joined = "\0".join(texts) + "\0"
    chars = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)
    kind = kinds[chars]
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    alnum = (kind == 1) | (kind == 2)
    before, after = np.concatenate([[False], alnum[:-1]]), np.concatenate([alnum[1:], [False]])
    slash = (chars == 47) | (chars == 58)  # / and :, which may follow each other in an address
    slash_before, slash_after = np.concatenate([[False], slash[:-1]]), np.concatenate([slash[1:], [False]])
    digit = kind == 2
    digit_before, digit_after = np.concatenate([[False], digit[:-1]]), np.concatenate([digit[1:], [False]])
    joins = ((chars == 45) | (chars == 39) | (chars == 0x2019) | (chars == 46)) & before & after
    joins |= (chars == 44) & digit_before & digit_after
    joins |= slash & (before | slash_before) & (after | slash_after) & ~((chars == 58) & after & ~digit_after)
    inside = alnum | joins
    first = inside & ~np.concatenate([[False], inside[:-1]])
    space = (kind == 3) | (kind == 4)
    gap = space & ~np.concatenate([[False], space[:-1]])
    lone = ~inside & ~space
    at = np.flatnonzero(first | gap | lone)
    token = np.full(len(at), OTHER, np.int16)
    is_word, is_gap = first[at], gap[at]
    token[lone[at]] = signs[chars[at[lone[at]]]]
    # white space
    run = np.flatnonzero(space)
    breaks = np.add.reduceat((kind[run] == 4).astype(np.int32), np.flatnonzero(gap[run])) if len(run) else np.empty(0, np.int32)
    token[is_gap] = np.where(breaks > 1, PARAGRAPH, -1)
    # words
    body = np.flatnonzero(inside)
    starts = np.flatnonzero(first[body])
    if len(starts):
        sizes = np.diff(np.append(starts, len(body)))
        low = lowers[chars[body]]
        hashes = _hashes(low, starts, sizes)
        some = lambda flags: np.add.reduceat(flags.astype(np.int32), starts) > 0
        letters, digits, slashes, dots = some(kind[body] == 1), some(digit[body]), some(chars[body] == 47), some(chars[body] == 46)
        place = at[is_word]
        capital = lowers[chars[body]] != chars[body]
        upper = capital[starts] & ((np.add.reduceat(capital.astype(np.int32), starts) < sizes) | (sizes == 1))  # words in capitals count as plain ones
        tag = (place > 0) & (chars[np.maximum(place - 1, 0)] == 35)
        link = slashes & dots
        number, code = digits & ~letters, digits & letters
        known = _made(_function_words)
        function = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
        # a word whose pair with the word before was said twice among the last words of its text
        text = np.searchsorted(ends, place, "right")
        nth = np.arange(len(hashes))
        pair = _mixed(np.concatenate([[np.uint64(0)], hashes[:-1]]) + hashes * np.uint64(3) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(pair, kind="stable")
        back = np.concatenate([order[:2], order[:-2]])
        again, first_ones = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        third = (pair[order] == pair[back]) & (nth[order] - nth[back] <= memory) & (nth[order] > nth[back])
        again[order] = third
        again[1:] &= ~function[:-1]
        if ahead:
            later = np.append(third, [False] * 2)
            first_ones[order] = (later[1:-1] | later[2:]) & ~third
            first_ones[1:] &= ~function[:-1]
        cls = np.where(upper, np.where(again, CAPITAL_AGAIN, CAPITAL), np.where(again, LOWER_AGAIN, LOWER)).astype(np.int16)
        cls[code] = CODE
        cls[number] = NUMBER
        cls[function] = FUNCTION
        cls[link] = LINK
        cls[tag] = TAG
        cls[first_ones & ((cls == CAPITAL) | (cls == LOWER))] += AHEAD
        token[is_word] = cls
        hash_sign = place[tag] - 1  # belongs to its tag
        drop = np.searchsorted(at, hash_sign)
        token[drop] = -1
    keep = (token >= 0) & ~np.isin(chars[at], [ord(c) for c in MARKUP])
    counts = np.bincount(np.searchsorted(ends, at[keep], "right"), minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
    return token[keep].astype(np.uint8), counts


class Pieces:
    """Token sequences of some pages in a row, parted into pieces: paragraphs, the long ones cut into about equal parts of
    about ``window`` tokens. ``keys``: the context and class of every token, its trigram and how many words before it the
    last function word, figure or full stop stands, for each reading."""

    def __init__(self, marked: np.ndarray, counts: np.ndarray, how: Spam):
        some = counts > 0
        begin = (np.cumsum(counts) - counts)[some]
        second = begin[counts[some] > 1] + 1
        first_ones = marked >= AHEAD
        seq = marked & (AHEAD - 1)

        def trigrams(seq: np.ndarray) -> np.ndarray:
            one, two = np.concatenate([[PARAGRAPH], seq[:-1]]).astype(np.int64), np.concatenate([[PARAGRAPH] * 2, seq[:-2]])[: len(seq)].astype(np.int64)
            one[begin] = two[begin] = PARAGRAPH
            two[second] = PARAGRAPH
            return (two * CLASSES + one) * CLASSES + seq

        word = IS_WORD[seq]
        opens = np.zeros(len(seq), bool)
        opens[begin] = True
        so_far = np.cumsum(word) - word
        since = np.maximum.accumulate(np.where(opens, so_far, 0))
        since = np.maximum(since, np.concatenate([[0], np.maximum.accumulate(np.where(ENDS_RUN[seq], so_far + word, 0))[:-1]]))
        runs = np.minimum(so_far - since, LONGEST) * CLASSES**3
        self.keys = [runs + trigrams(seq)]
        self.keys.append(runs + trigrams(np.where(first_ones, seq + TO_AGAIN, seq)) if first_ones.any() else self.keys[0])
        opens |= np.concatenate([[False], seq[:-1] == PARAGRAPH])
        paragraph = np.flatnonzero(opens)
        long = np.diff(np.append(paragraph, len(seq)))
        parts = np.maximum(1, (long + how.window // 2) // how.window)
        which = np.repeat(np.arange(len(paragraph)), long)
        piece = (np.cumsum(parts) - parts)[which] + (np.arange(len(seq)) - paragraph[which]) * parts[which] // long[which]
        self.starts = np.flatnonzero(np.diff(piece, prepend=-1))
        self.sizes = np.diff(np.append(self.starts, len(seq)))
        self.seq, self.page, self.how, self.pages = seq, np.searchsorted(np.cumsum(counts), self.starts, "right"), how, len(counts)
        self.words = self.count(word)

    def count(self, flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), self.starts)

    def prose(self) -> np.ndarray:
        """Which pieces the model learns from: at least ten words, a fifth of them function words before a full stop, or a
        fifth of them figures (rows of data are read as such), hardly a repetition."""
        of = lambda *c: self.count(np.isin(self.seq, c))
        stop = of(*(FIRST_SIGN + SIGNS.index(c) for c in ".!?")) > 0
        spoken = (of(FUNCTION) * 5 >= self.words) & stop
        data = (of(NUMBER, CODE) * 5 >= self.words) & (of(LINK, TAG) == 0)
        again, content = of(CAPITAL_AGAIN, LOWER_AGAIN), of(CAPITAL, LOWER, CAPITAL_AGAIN, LOWER_AGAIN)
        return (self.words >= 10) & (spoken | data) & (again * 8 <= content)

    def bits(self, surprise: np.ndarray, reading: int) -> np.ndarray:
        """The mean surprise of the tokens of every piece: the logarithm of its perplexity."""
        return np.add.reduceat(surprise[self.keys[reading]].astype(np.float64), self.starts) / self.sizes


def surprise_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of every trigram with its run, interpolated with shorter contexts, from their counts in prose."""
    longest = np.zeros((LONGEST + 1) * CLASSES**3)
    np.add.at(longest, keys, counts)
    longest = longest.reshape(LONGEST + 1, CLASSES, CLASSES, CLASSES)
    three = longest.sum(0)
    two = three.sum(0)
    p = (two.sum(0) + 0.5) / (two.sum() + 0.5 * CLASSES)
    for seen in (two, three, longest):
        p = (seen + 2 * p) / (seen.sum(-1, keepdims=True) + 2)
    return -np.log2(p).ravel().astype(np.float32)


def _batches(batches: Iterator[pa.RecordBatch], how: Spam) -> Iterator[tuple[pa.RecordBatch, Pieces | None]]:
    """Some pages at a time, with their pieces, if they have any tokens."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            raw = part.column("classes").to_pylist()
            seq = np.frombuffer(b"".join(raw), np.uint8)
            yield part, Pieces(seq, np.array([len(r) for r in raw]), how) if len(seq) else None


def train(sequences: DataFrame, how: Spam) -> list[tuple[np.ndarray, float, float]]:
    """For each reading the model, and the mean and standard deviation of the bits of a piece, all from the prose of the
    whole collection.

    There are at most READINGS * SIZE counts, whatever the size of the collection.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((READINGS, SIZE), np.int64)
        for _, pieces in _batches(batches, how):
            if pieces:
                prose = np.repeat(pieces.prose(), pieces.sizes)
                for reading, keys in enumerate(pieces.keys):
                    found, n = np.unique(keys[prose], return_counts=True)
                    sums[reading, found] += n
        reading, key = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(reading), pa.array(key), pa.array(sums[reading, key])], ["reading", "key", "n"])

    counted = sequences.select("classes").mapInArrow(count, "reading bigint, key bigint, n bigint").groupBy("reading", "key").agg(F.sum("n").alias("n")).toPandas()
    of = [counted[counted["reading"] == reading] for reading in range(READINGS)]
    models = [surprise_of(c["key"].to_numpy(np.int64), c["n"].to_numpy(np.int64)) for c in of]
    sent = sequences.sparkSession.sparkContext.broadcast(models)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((READINGS, 3))
        for _, pieces in _batches(batches, how):
            if pieces:
                limits = pieces.prose() & (pieces.sizes >= how.window // 2)
                for reading, surprise in enumerate(sent.value):
                    bits = pieces.bits(surprise, reading)[limits]
                    sums[reading] += len(bits), bits.sum(), (bits**2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(READINGS)), *map(pa.array, sums.T)], ["reading", "n", "s", "q"])

    summed = sequences.select("classes").mapInArrow(moments, "reading bigint, n double, s double, q double").groupBy("reading").agg(F.sum("n"), F.sum("s"), F.sum("q"))
    out = {}
    for reading, n, s, q in summed.collect():
        mean = s / n if n else 0.0
        out[reading] = models[reading], mean, float(np.sqrt(max(q / n - mean**2, 1e-9))) if n else 1.0
    return [out.get(reading, (models[reading], 0.0, 1.0)) for reading in range(READINGS)]


def score_pages(df: DataFrame, key: str = "doc_id", text: str = "text", how: Spam = Spam()) -> DataFrame:
    """key, bits (surprise per token), abnormal (share of words in pieces of abnormal perplexity), spam.

    Texts become sequences of function words and word classes; a trigram model of them is trained on all prose of the
    collection, and so are the limits of what is normal: the perplexity of a piece is abnormal if it lies further from that
    of prose than ``how`` allows, on either side. The first mentions of a phrase that is said over and over belong to it as
    well, but in a reading from the front they are plain words, and the first piece of a page of keywords passes for normal;
    so each piece is read twice, the second time with these as repetitions too, by a model and limits that read the same
    prose in this way, and is abnormal if it is so in either reading. A page is spam if more than ``how.share`` of its words
    stand in abnormal pieces, and by nothing else. One pass over the texts, three over the sequences, which take a byte a
    token; nothing is shuffled but the counts of the models.

    Nulls: rows with a null key or text are left out. Empty and blank texts have no words and are no spam. Repeated rows
    give repeated rows. A collection without prose gives a flat model and no spam. Other columns are ignored.
    """
    kind, memory = df.schema[key].dataType.simpleString(), how.memory
    rows = with_form(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "form")

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):  # so many texts stay in the cache
                part = batch.slice(at, 200)
                seq, counts = classes([t.replace("\r", "").replace("\0", " ") for t in part.column("form").to_pylist()], memory, ahead=True)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                listed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(seq)])
                yield pa.RecordBatch.from_arrays([part.column("key"), listed], ["key", "classes"])

    sequences = written(rows.select("key", "form").mapInArrow(classify, f"key {kind}, classes binary"), "spam-classes")
    sent = df.sparkSession.sparkContext.broadcast(train(sequences, how))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pieces in _batches(batches, how):
            words, tokens, bits, odd = (np.zeros(len(part)) for _ in range(4))
            if pieces:
                each, abnormal = pieces.bits(sent.value[0][0], 0), False
                for reading, (surprise, mean, spread) in enumerate(sent.value):
                    scale, read = spread * np.sqrt(np.maximum(how.window / pieces.sizes, 1)), pieces.bits(surprise, reading)
                    abnormal |= (read > mean + how.above * scale) | (read < mean - how.below * scale)
                total = lambda x: np.bincount(pieces.page, x, len(part))  # noqa: B023, E731
                words, tokens, bits, odd = total(pieces.words), total(pieces.sizes), total(each * pieces.sizes), total(pieces.words * abnormal)
            share = odd / np.maximum(words, 1)
            spam = (share > how.share) & (words >= how.least)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(bits / np.maximum(tokens, 1)), pa.array(share), pa.array(spam)], ["key", "bits", "abnormal", "spam"])

    return sequences.mapInArrow(score, f"key {kind}, bits double, abnormal double, spam boolean").withColumnRenamed("key", key)
