"""Documents cut into sections at headings and sections into overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import or_empty

# What a heading looks like, how far back a window looks for the end of a sentence and what it must keep.
HEADING = r"^(#{1,6}\s+\S.*|[A-Z][^.!?\n]{2,70})$"
LOOK_BACK = 120
LEAST_STOP = 20
SIZE, OVERLAP, LEAST_WIDTH = 900, 180, 120

#: Windows are cut out of slabs of so many steps, as finding a place in a text takes time in proportion to the place.
SLAB = 64

BLANKS = r"^(?U)[\s\x{feff}]+|(?U)[\s\x{feff}]+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section_at, heading, text: each heading with the lines under it; text before the first has a null heading.

    A line is a heading if it has hashes, or starts with a capital, has no sentence end and stands before a blank line
    or the end. All work on a document is on its own array of lines; nothing is shuffled. Null text has no sections,
    extra columns are dropped, repeated rows give repeated sections.
    """
    lines = F.split(or_empty(F.col(text)), r"\r?\n")
    rows = docs.select(key, F.transform(lines, lambda x: F.struct(x.alias("line"), trimmed(x).alias("bare"))).alias("__l"))

    def marked(x: Column, i: Column) -> Column:
        after = F.coalesce(F.get(F.col("__l"), i + 1)["bare"], F.lit(""))
        return F.struct(x["line"].alias("line"), x["bare"].alias("bare"), (x["bare"].rlike(HEADING) & (x["bare"].startswith("#") | (after == ""))).alias("head"))

    rows = rows.select(key, F.transform("__l", marked).alias("__l"))
    start = F.filter(F.transform("__l", lambda x, i: F.when(x["head"], i)), lambda i: i.isNotNull())
    rows = rows.select(key, "__l", F.concat(F.array(F.lit(-1)), start).alias("__s"))

    def section(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("__s"), k + 1), F.size("__l"))
        body = trimmed(F.array_join(F.transform(F.slice(F.col("__l"), at + 2, end - at - 1), lambda x: x["line"]), "\n"))
        heading = F.when(at >= 0, F.regexp_replace(F.get(F.col("__l"), at)["bare"], r"^#+\s*", ""))
        whole = F.when(F.coalesce(heading, F.lit("")) == "", body).when(body == "", heading).otherwise(F.concat_ws("\n", heading, body))
        return F.struct(heading.alias("heading"), trimmed(whole).alias("text"))

    kept = F.filter(F.transform("__s", section), lambda s: s["text"] != "")
    return rows.select(key, F.posexplode(kept).alias("section_at", "__x")).select(key, "section_at", "__x.heading", "__x.text")


def window_array(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The overlapping pieces of a text, as an array.

    Windows start at fixed steps. A start inside a word drops that word's rest; an end that is not the text's moves back
    to the last sentence or line end of its last stretch, if the piece keeps enough. Blank text has no pieces.
    """
    wide = max(LEAST_WIDTH, size or SIZE)
    over = max(0, overlap or 0)
    step = wide - (wide // 4 if over >= wide else over)
    clean = F.replace(or_empty(text), F.lit("\r"), F.lit(""))

    def cut(whole: Column, n: Column) -> Column:
        last = F.when(n > wide, F.ceil((n - wide) / step) * step).otherwise(0).cast("int")

        def piece(slab: Column, at: Column, first: Column) -> Column:
            # A slab begins one character before its first window, so that every window sees the one before it.
            here = at - first + F.when(first > 0, 1).otherwise(0)
            raw = F.substring(slab, here + 1, F.lit(wide))
            inside = (at > 0) & F.substring(slab, here, F.lit(1)).rlike("[A-Za-z0-9_]") & raw.rlike("^[A-Za-z0-9_]")
            began = F.when(inside, F.regexp_replace(raw, r"(?s)^[^\s\x{a0}\x{feff}\x{2000}-\x{200a}\x{202f}\x{3000}]*[\s\x{a0}\x{feff}\x{2000}-\x{200a}\x{202f}\x{3000}]", "")).otherwise(raw)
            tail = F.right(began, F.lit(LOOK_BACK))
            stop = F.length(F.regexp_extract(tail, r"(?s)^(.*(?:\.(?= )|\n))", 1))
            ended = F.when((at + wide < n) & (stop > LEAST_STOP + 1), F.left(began, F.length(began) - F.length(tail) + stop)).otherwise(began)
            return trimmed(ended)

        def of_slab(first: Column) -> Column:
            held = F.struct(F.substring(whole, F.greatest(first, F.lit(1)), F.lit(SLAB * step + wide + 1)).alias("t"), first.alias("first"))
            ats = lambda x: F.sequence(x["first"], F.least(x["first"] + (SLAB - 1) * step, last), F.lit(step))
            return F.flatten(F.transform(F.array(held), lambda x: F.transform(ats(x), lambda at: piece(x["t"], at, x["first"]))))

        pieces = F.flatten(F.transform(F.sequence(F.lit(0), last, F.lit(SLAB * step)), of_slab))
        return F.filter(pieces, lambda p: p != "")

    bound = F.transform(F.array(F.struct(clean.alias("t"), F.length(clean).alias("n"))), lambda x: cut(x["t"], x["n"]))
    return F.flatten(bound)


def windows(df: DataFrame, *keep: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns, window, text: one row per piece."""
    return df.select(*keep, F.posexplode(window_array(F.col(text), size, overlap)).alias("window", "text"))


def cut_up(docs: DataFrame, key: str = "doc_id", name: str = "name", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, name, id (name#ordinal), chunk_ord, section_at, heading, text: all pieces of all documents.

    The ordinal counts within one row of ``key``, so documents of the same name stay apart. Numbering is a window over
    one document, which is bounded by that document.
    """
    named = sections(docs.withColumn("__key", F.struct(F.col(key), F.col(name))), "__key", text)
    cut = windows(named, "__key", "section_at", "heading", size=size, overlap=overlap)
    ordinal = (F.row_number().over(Window.partitionBy("__key").orderBy("section_at", "window")) - 1).alias("chunk_ord")
    pieces = cut.select(F.col("__key")[key].alias(key), F.col("__key")[name].alias(name), ordinal, "section_at", "heading", "text")
    return pieces.withColumn("id", F.concat_ws("#", F.col(name), F.col("chunk_ord").cast("string")))


def title_of(text: Column) -> Column:
    """The first line without hashes; null if there is nothing."""
    first = trimmed(F.regexp_replace(F.substring_index(or_empty(text), "\n", 1), r"^#+\s*", ""))
    return F.when(first != "", first)
