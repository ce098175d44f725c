"""Oversized records cut at natural boundaries with overlap (problem 4)."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.forms import with_form

#: Where each level of the hierarchy parts a text; a cut lies at the end of the match. Characters are the last resort.
LEVELS = {
    "section": re.compile(r"\n\s*(?=#{1,6}[ \t]+\S)"),
    "paragraph": re.compile(r"\n\s*\n\s*"),
    "sentence": re.compile(r"[\r\n]\s*|(?<=[.!?])\s+"),
    "word": re.compile(r"\s+"),
}


def hierarchy(text: str, room: int) -> tuple[dict[str, list[int]], str]:
    """The cuts of every level, those of coarser levels among them, and how deep the text has to be parted: the first of
    paragraph, sentence and word at which every part, trimmed, fits the room; else none.

    Only parts that do not fit are parted again at the next level. Sections give cuts but do not count as a depth.
    """
    cuts, seen, open_parts, depth = {}, set(), [text], None
    for level, pattern in LEVELS.items():
        seen = seen | {m.end() for m in pattern.finditer(text)}
        cuts[level] = sorted(seen)
        if level != "section" and depth is None:
            open_parts = [part for whole in open_parts for part in pattern.split(whole) if len(part.strip()) > room]
            depth = None if open_parts else level
    return cuts, depth or "none"


def spans(text: str, room: int, overlap: int, cuts: dict[str, list[int]] | None = None) -> list[tuple[int, int, str]]:
    """Start, end and the level of the end of each piece.

    A piece ends at the last cut of the coarsest level that has one within reach, so whole sections are packed before
    paragraphs, these before sentences, and so on; without any cut it ends after ``room`` characters. A cut within the
    first ``overlap`` characters is out of reach, as the next piece, which starts ``overlap`` characters before the end,
    would hold all of this one. Blanks at both ends of the text and before a cut are left out. The overlap is at most
    half of the room.
    """
    cuts, overlap = cuts if cuts is not None else hierarchy(text, room)[0], max(0, min(overlap, (room - 1) // 2))
    at, last, found = len(text) - len(text.lstrip()), len(text.rstrip()), []
    while last - at > room:
        end, how = at + room, "character"
        for level, places in cuts.items():
            i = bisect_right(places, min(at + room + 1, last)) - 1
            while i >= 0 and places[i] > at and len(text[at : places[i]].rstrip()) > room:
                i -= 1
            if i >= 0 and places[i] > at and (stop := at + len(text[at : places[i]].rstrip())) > at + overlap:
                end, how = stop, level
                break
        found.append((at, end, how))
        at = end - overlap
    found.append((at, last, "end"))
    return found


def split_oversized(df: DataFrame, key: str = "chunk_id", text: str = "text", heading: str = "heading", limit: int = 900, overlap: int = 180) -> DataFrame:
    """Pieces of the records whose one form, with its heading and a line break, is longer than ``limit``.

    Rows: key, heading (one form), boundary (how deep the text had to be parted), piece (from 0), start, end (in the
    one form), ends_at (level of the cut), text (heading, line break and piece; at most ``limit`` characters). Pieces
    hold every character of the one form but blanks at its ends, neighbours share exactly ``overlap`` characters, and no
    piece lies within another. Length is tested before Python sees a row, so only oversized records leave the JVM.

    Records that fit have no rows. Null keys or texts are no records; null or blank headings take no room. A heading
    that leaves less than twice the overlap is not repeated in the pieces, but still counts for ``boundary``. Repeated
    rows count once; a record whose rows differ in heading gives pieces for each. Other columns are ignored, an empty
    table gives an empty result.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(heading).alias("__heading"))
    rows = with_form(with_form(rows, "__text", "__form"), "__heading", "__head")
    rows = rows.withColumn("__head", F.when(~F.col("__head").rlike(r"^\s*$"), F.col("__head")))
    rows = rows.withColumn("__room", F.lit(limit) - F.coalesce(F.length("__head") + 1, F.lit(0)))
    over = rows.where(F.length("__form") > F.col("__room")).select("__key", "__head", "__form", "__room").distinct()
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, head, form, room in batch.itertuples(index=False):
                kept = f"{head}\n" if isinstance(head, str) and room >= 2 * overlap else ""
                cuts, depth = hierarchy(form, room)
                out += [(k, head, depth, i, a, b, how, kept + form[a:b]) for i, (a, b, how) in enumerate(spans(form, limit - len(kept), overlap, cuts))]
            yield pd.DataFrame(out, columns=["key", "heading", "boundary", "piece", "start", "end", "ends_at", "text"])

    pieces = over.mapInPandas(cut, f"key {kind}, heading string, boundary string, piece int, start int, end int, ends_at string, text string")
    return pieces.withColumnRenamed("key", key)
