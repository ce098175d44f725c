"""SQL that checks the queries of this subpackage, where SQL can express them. It is written from the definitions and takes
nothing from the code it checks."""

from __future__ import annotations

import unicodedata


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Letters of other alphabets and what they look like.
LENT = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϲϳϹͿЅІЈАВЕКМНОРСТХаеорсухѕіјҮүһԀԁԚԛԜԝՏՕհոսօɑɡɩ"
SEEN = "ABEZHIKMNOPTYXvocjCJSIJABEKMHOPCTXaeopcyxsijYyhDdQqWwSOhnuoagi"
# Signs and joined letters that are written with other characters than those they show.
WRITTEN, SHOWN = "‐‑µ", "--μ"
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}


def _shown() -> dict[str, str]:
    """Every character that shows one other, plainer one: blanks, widths, styles and borrowed letters with their accents."""
    out = dict(zip(WRITTEN, SHOWN)) | dict(zip(LENT, SEEN))
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        how, flat = unicodedata.decomposition(c).partition(" ")[0], unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Zs":
            out[c] = " "
        elif how in ("<wide>", "<narrow>", "<font>") and len(flat) == 1:
            out[c] = out.get(flat, flat)
        elif len(apart := unicodedata.normalize("NFD", c)) > 1 and apart[0] in LENT and 0x370 <= code < 0x590:
            if len(whole := unicodedata.normalize("NFC", out[apart[0]] + apart[1:])) == 1:
                out[c] = whole
    return out | {"\t": " "}


FROM_TO = _shown()
HIDDEN = r"[\x{00}-\x{08}\x{0e}-\x{1f}\x{7f}-\x{84}\x{86}-\x{9f}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{e0001}-\x{e007f}\x{e0100}-\x{e01ef}]"


def form(x: str) -> str:
    """The one form of a text, all borrowed letters taken as plain ones."""
    out = f"regexp_replace({x}, {q(HIDDEN)}, '', 'g')"
    for k, v in JOINED.items():
        out = f"replace({out}, {q(k)}, {q(v)})"
    return f"nfc_normalize(translate({out}, {q(''.join(FROM_TO))}, {q(''.join(FROM_TO.values()))}))"


def words(x: str) -> str:
    """Runs between white space in lower case, without what is no letter or digit at both ends."""
    bare = f"list_transform(string_split_regex(lower({x}), '\\s+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))"
    return f"list_filter({bare}, lambda w: w <> '')"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


REC = "rec AS (SELECT DISTINCT chunk_id, document, text FROM chunk WHERE chunk_id IS NOT NULL AND text IS NOT NULL)"
TERMS = f"every AS (SELECT chunk_id, document, text, list_filter({words('f')}, lambda w: length(w) >= 3) AS l FROM (SELECT *, {form('text')} AS f FROM rec))"


def counted(parts: str) -> str:
    """term, occurrences, records of rows (k, x)."""
    return f"""SELECT term, count(*) AS occurrences, count(DISTINCT (k, x)) AS records FROM (SELECT k, x, unnest(list_filter({words(form('x'))}, lambda w: length(w) >= 3)) AS term FROM ({parts})) GROUP BY term"""


def fits(parts: str) -> str:
    return f"list_max(list_transform({parts}, lambda p: length({trimmed('p')}))) <= room"


CHANGED = """SELECT DISTINCT 'q' || request_id AS k, question AS x FROM request WHERE request_id IS NOT NULL AND question IS NOT NULL
UNION ALL SELECT DISTINCT 'c' || chunk_id, coalesce(heading, '') FROM chunk WHERE chunk_id IS NOT NULL AND text IS NOT NULL"""
TRIPLES = f"""texts AS (SELECT text, min(chunk_id) AS rep, count(DISTINCT chunk_id) AS copies FROM chunk WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY text),
said AS (SELECT rep, {words(form('text'))} AS w FROM texts),
tri AS (SELECT DISTINCT rep, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT rep, w, unnest(range(1, len(w) - 1)) AS i FROM said WHERE len(w) >= 3)),
sizes AS (SELECT rep, count(*) AS n FROM tri GROUP BY rep),
linked AS (SELECT a, b FROM (SELECT x.rep AS a, y.rep AS b, count(*) AS i FROM tri x JOIN tri y ON x.t = y.t AND x.rep < y.rep GROUP BY ALL) JOIN sizes p ON p.rep = a JOIN sizes q ON q.rep = b WHERE 2 * i >= p.n + q.n - i),
keys AS (SELECT DISTINCT chunk_id, rep FROM chunk JOIN texts USING (text) WHERE chunk_id IS NOT NULL)"""
ROOM = f"""rec AS (SELECT DISTINCT chunk_id, {form('text')} AS f, nullif({form('heading')}, '') AS h FROM chunk WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
over AS (SELECT chunk_id, f, 900 - CASE WHEN {trimmed("coalesce(h, '')")} = '' THEN 0 ELSE length(h) + 1 END AS room FROM rec)"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH texts AS (
  SELECT 'chunk.text' AS field, chunk_id AS id, text FROM chunk UNION SELECT 'request.question', request_id, question FROM request),
forms AS (SELECT field, id, text, {form('text')} AS f FROM texts WHERE id IS NOT NULL AND trim(text) <> '')
SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM forms a JOIN forms b ON a.field = b.field AND a.f = b.f AND a.id < b.id AND a.text <> b.text WHERE {trimmed('a.f')} <> ''""",
    "p2_found": f"""WITH {TRIPLES}
SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b FROM keys a JOIN keys b ON a.rep = b.rep AND a.chunk_id < b.chunk_id WHERE a.rep IN (SELECT rep FROM sizes)
UNION SELECT least(x.chunk_id, y.chunk_id), greatest(x.chunk_id, y.chunk_id) FROM linked JOIN keys x ON x.rep = a JOIN keys y ON y.rep = b""",
    "p2_groups": f"""WITH {TRIPLES}
SELECT chunk_id, rep AS class, copies, (SELECT count(*) FROM linked WHERE a = keys.rep OR b = keys.rep) AS links FROM keys JOIN texts USING (rep)""",
    "p3_found": f"""WITH {REC}, {TERMS}, held AS (SELECT document, term, count(*) AS n FROM (SELECT document, unnest(list_distinct(l)) AS term FROM every) GROUP BY ALL)
SELECT document, term FROM (SELECT *, sum(n) OVER (PARTITION BY term) AS whole FROM held) WHERE document IS NOT NULL AND n >= 4 AND 10 * n >= 8 * whole""",
    "p3_terms": f"""WITH {REC}, {TERMS}, held AS (SELECT document, term, count(*) AS occurrences, count(DISTINCT (chunk_id, text)) AS records FROM (SELECT document, chunk_id, text, unnest(l) AS term FROM every) GROUP BY ALL),
owners AS (SELECT count(DISTINCT document) AS k FROM rec),
spread AS (SELECT term, sum(records)::BIGINT AS all_records FROM held GROUP BY term),
parts AS (SELECT *, occurrences / sum(occurrences) OVER (PARTITION BY term) AS p FROM held WHERE document IS NOT NULL),
entropy AS (SELECT term, -sum(p * ln(p)) AS h FROM parts GROUP BY term),
weighed AS (SELECT document, term, occurrences, records, all_records, round(ln(1 + occurrences) * (1 - CASE WHEN k > 1 THEN greatest(0, h / ln(k)) ELSE 0 END), 6) AS weight FROM parts JOIN spread USING (term) JOIN entropy USING (term), owners)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY weight DESC, term) AS place FROM weighed) WHERE place <= 10""",
    "p4_found": f"""WITH {ROOM} SELECT DISTINCT chunk_id, CASE WHEN {fits("string_split_regex(f, '\\n\\s*\\n\\s*')")} THEN 'paragraph'
  WHEN {fits("string_split_regex(regexp_replace(f, '([.!?])\\s+', '\\1' || chr(1), 'g'), '[\\r\\n\\x01]')")} THEN 'sentence'
  WHEN {fits("string_split_regex(f, '\\s+')")} THEN 'word' ELSE 'none' END AS boundary FROM over WHERE length(f) > room""",
    "p5_found": f"""WITH {REC}, counts AS ({counted('SELECT chunk_id AS k, text AS x FROM rec')})
SELECT term, mark FROM (SELECT term, CASE WHEN records < 3 THEN 'rare' WHEN records * 5 > (SELECT count(*) FROM rec) THEN 'common' END AS mark FROM counts) WHERE mark IS NOT NULL""",
    "p5_changes": f"""WITH rows AS ({CHANGED}), counts AS ({counted('SELECT k, x FROM rows')})
SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records * 5 > (SELECT count(*) FROM rows) THEN 'common' END AS mark FROM counts""",
    "p6_found": f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower({form('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower({form('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_item),
asked AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS s FROM i WHERE len(w) >= 10)),
there AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 9], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS s FROM d WHERE len(w) >= 10))
SELECT DISTINCT doc_id, item_id FROM there JOIN asked USING (run)""",
}
