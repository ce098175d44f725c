"""The core queries as SQL for another engine, written from the definitions and not from the Spark code."""

from __future__ import annotations

import unicodedata

# Fixed values, stated here once more so that a wrong entry in the engine shows: characters tidied away, words without
# meaning of their own, and words that point backwards.
TIDIED = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-",
    "\u00a0": " ", "\u202f": " ", "\u200b": "", "\ufeff": "",
}
EMPTY_WORDS = (
    "a an and are as at be by for from has have how i in is it me of on or that the this to was what when where which you your"
    " al alla alle che come con da dei del della delle di e gli i il in la le lo mi nel per più piu quale quali si su sul un una uno"
).split()
POINTING = (
    "it|its|that|those|these|this|the same|the other|the previous|the above|as said|as mentioned",
    "quest[oaie]|quell[oaie]|quel|stess[oaie]|precedent[ei]|suddetto|come detto|di cui sopra",
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _plain() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters and the one they decompose to without marks; the few that become several."""
    one, many = {}, []
    for code in [*range(0x80, 0x3100), *range(0xF900, 0xFFF0)]:
        c = chr(code)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not "̀" <= x <= "ͯ")
        if d == c or "̀" <= c <= "ͯ":
            continue
        if len(d) == 1:
            one[c] = d
        elif d and c in "ﬀﬁﬂﬃﬄﬅﬆ…™½¼¾ĳĲ":
            many.append((c, d))
    return "".join(one), "".join(one.values()), many


FROM, TO, MANY = _plain()


def norm(x: str) -> str:
    kept, gone = {k: v for k, v in TIDIED.items() if v}, [k for k, v in TIDIED.items() if not v]
    out = f"translate(coalesce({x}, ''), {q(''.join(kept))}, {q(''.join(kept.values()))})"
    for c in gone:
        out = f"replace({out}, {q(c)}, '')"
    for c, d in MANY:
        out = f"replace({out}, {q(c)}, {q(d)})"
    out = f"regexp_replace(translate({out}, {q(FROM)}, {q(TO)}), '[\\x{{300}}-\\x{{36f}}]', '', 'g')"
    return f"trim(regexp_replace(lower({out}), '[\\s\\x{{0b}}\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'))"


def words(n: str) -> str:
    bare = f"list_transform(string_split({n}, ' '), lambda w: regexp_replace(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', ''))"
    return f"list_filter({bare}, lambda w: w <> '')"


def stem(w: str) -> str:
    cases = " ".join(f"WHEN {w} LIKE '%{e}' AND length({w}) >= {len(e) + 4} THEN left({w}, length({w}) - {len(e)})" for e in ("ings", "ing", "edly", "ed", "est", "es", "s"))
    return f"CASE {cases} ELSE {w} END"


EMPTY = "(" + ", ".join(q(w) for w in EMPTY_WORDS) + ")"


def terms(n: str) -> str:
    return f"list_transform(list_filter({words(n)}, lambda w: length(w) >= 3 AND w NOT IN {EMPTY}), lambda w: {stem('w')})"


LEAN = "|".join(rf"\b({p})\b" for p in POINTING)
SHAPES = (
    r"\b(?:0[xX][0-9a-fA-F]{4,}|[A-Z]{1,5}[-_]?\d{3,}[A-Z]?)\b",
    r"[A-Za-z_][A-Za-z0-9_]*\s*\(|::|->|=>",
    r"`[^`]+`",
    r"\b[A-Z][A-Z0-9_]{3,}\b",
)

CHUNKS = "chunks AS (SELECT DISTINCT coalesce(document, '') AS doc, chunk_id AS chunk_ord, id, document, heading, text FROM chunk WHERE chunk_id IS NOT NULL AND text IS NOT NULL)"
MANUALS = "manuals AS (SELECT name AS doc, min(text) AS text FROM manual WHERE name IS NOT NULL AND text IS NOT NULL GROUP BY name)"
REQUESTS = "requests AS (SELECT DISTINCT request_id AS qid, coalesce(question, '') AS question, history FROM request WHERE request_id IS NOT NULL)"
COUNTS = f"counts AS (SELECT doc, chunk_ord, term, count(*) AS tf FROM (SELECT doc, chunk_ord, unnest({terms('n')}) AS term FROM (SELECT doc, chunk_ord, {norm('text')} AS n FROM chunks)) GROUP BY ALL)"
VOCAB = "vocab AS (SELECT term, count(*) AS df, ln(1 + greatest((SELECT count(*) FROM chunks), 1) / count(*)) AS idf FROM counts GROUP BY term)"
RAW = "raw AS (SELECT doc, chunk_ord, term, (1 + ln(tf)) * idf AS x FROM counts JOIN vocab USING (term))"
POSTINGS = "postings AS (SELECT doc, chunk_ord, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc, chunk_ord)) AS weight FROM raw)"
INDEX = ", ".join((CHUNKS, COUNTS, VOCAB, RAW, POSTINGS))
KINDS = f"""kinds AS (
  SELECT qid, question, n, w, pointing, carrying, t1, shown, terms, meaningful, last_question,
    NOT (n = '' OR pointing <> '' OR (len(w) <= 4 AND carrying <= 1)) AS stands_alone,
    CASE WHEN n = '' THEN 'there is no question'
      WHEN pointing <> '' THEN 'it says "' || pointing || '", which points at something said earlier'
      WHEN len(w) <= 4 AND carrying <= 1 THEN 'only ' || carrying || CASE WHEN carrying = 1 THEN ' word' ELSE ' words' END || ' in it carries any meaning, so it is not about anything yet'
      ELSE 'it names what it is about' END AS lean_why
  FROM (SELECT *, {words('n')} AS w, regexp_extract(n, {q(LEAN)}) AS pointing, len(list_filter({words('n')}, lambda w: w NOT IN {EMPTY})) AS carrying,
      coalesce({', '.join(f"nullif(regexp_extract(question, {q(s)}), '')" for s in SHAPES)}) AS t1,
      list_transform(list_sort(list_transform(range(1, len(found) + 1), lambda i: {{'short': -length(found[i]), 'at': i, 'term': found[i]}})), lambda s: s.term) AS shown,
      CASE WHEN t1 IS NULL THEN []::VARCHAR[] ELSE shown END AS terms, {terms('n')} AS meaningful
    FROM (SELECT qid, question, {norm('question')} AS n, history[len(history)] AS last_question,
        list_filter(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN list_position(f, f[i]) = i THEN f[i] END), lambda t: t IS NOT NULL) AS found
      FROM (SELECT *, list_concat({f"regexp_extract_all(question, {q(SHAPES[0])}), list_concat(regexp_extract_all(question, {q(SHAPES[1])}), list_concat(regexp_extract_all(question, {q(SHAPES[2])}), regexp_extract_all(question, {q(SHAPES[3])})))"}) AS f FROM requests))))"""
CARRIED = f"""carried AS (SELECT *, CASE WHEN NOT stands_alone AND coalesce(last_question, '') <> '' AND len(more) > 0 THEN question || ' ' || array_to_string(more, ' ') ELSE question END AS asked
  FROM (SELECT *, list_filter({terms(norm('last_question'))}, lambda t: NOT list_contains(meaningful, t)) AS more FROM kinds))"""
VARIANTS = """CASE WHEN letters <> '' AND digits <> '' THEN [letters || '/' || digits, letters || '-' || digits, letters || ' ' || digits, letters || digits] ELSE list_filter([plain], lambda x: x <> '') END"""


def variants(rows: str, code: str) -> str:
    return f"SELECT *, {VARIANTS} AS variants FROM (SELECT *, lower(regexp_replace({code}, '[^A-Za-z]', '', 'g')) AS letters, regexp_replace({code}, '[^0-9]', '', 'g') AS digits, {norm(code)} AS plain FROM {rows})"


TITLE = "regexp_replace(string_split(text, chr(10))[1], '^#+\\s*', '')"
NAMES = f"""heads AS (SELECT doc, {TITLE} AS title, {norm(TITLE)} AS t,
    regexp_extract(trim(replace(CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END, chr(10), ' '), ' ' || chr(9) || chr(13)), '^(?s:(.*?[.!?])\\s|(.*)$)', 0) AS o FROM manuals),
once AS (SELECT name FROM (SELECT DISTINCT doc, {stem('w')} AS name FROM (SELECT doc, unnest({words('n')}) AS w FROM (SELECT doc, {norm('text')} AS n FROM manuals))) GROUP BY name HAVING count(*) = 1),
codes AS (SELECT doc, i, c[i] AS code FROM (SELECT doc, unnest(range(1, len(c) + 1)) AS i, c FROM (SELECT doc, regexp_extract_all(title, '\\b[A-Za-z]{{1,5}}[-_ ]?\\d{{2,}}\\b') AS c FROM heads))),
spelled AS (SELECT doc, name, min([0, i, j]) AS place FROM (SELECT doc, i, unnest(range(1, len(variants) + 1)) AS j, unnest(variants) AS name FROM ({variants('codes', 'code')})) GROUP BY doc, name),
own AS (SELECT doc, name, [1, 0, row_number() OVER (PARTITION BY doc ORDER BY length(name) DESC, i)] AS place FROM (
  SELECT doc, name, min(i) AS i FROM (SELECT doc, i, {stem('w')} AS name FROM (SELECT doc, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS w FROM (
    SELECT doc, list_filter(list_concat({words('t')}, {words(norm('o'))}), lambda w: length(w) >= 4 AND w NOT IN {EMPTY}) AS l FROM heads)))
  WHERE name IN (SELECT name FROM once) GROUP BY doc, name)),
names AS (SELECT doc, name, row_number() OVER (PARTITION BY doc ORDER BY place) - 1 AS name_ord FROM (
  SELECT doc, name, min(place) AS place FROM (SELECT * FROM spelled UNION ALL SELECT * FROM own WHERE place[3] <= 4) GROUP BY doc, name))"""


def routed(name: str, rows: str, text: str) -> str:
    return f"""{name}_w AS (SELECT DISTINCT qid, {stem('w')} AS w FROM (SELECT qid, unnest({words(norm(text))}) AS w FROM {rows}) WHERE length(w) >= 4),
{name}_h AS (SELECT DISTINCT qid, doc, name FROM {name}_w JOIN names ON starts_with(w, name) OR starts_with(name, w)),
{name} AS (SELECT qid, CASE WHEN coalesce(weight > next, true) THEN doc END AS document, weight FROM (
  SELECT *, lead(weight) OVER o AS next, row_number() OVER o AS r FROM (SELECT qid, doc, sum(length(name)) AS weight FROM {name}_h GROUP BY qid, doc) WINDOW o AS (PARTITION BY qid ORDER BY weight DESC, doc)) WHERE r = 1)"""


def vectors_of(name: str, rows: str, text: str) -> str:
    return f"""{name} AS (SELECT qid, term, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS weight FROM (
  SELECT qid, term, (1 + ln(tf)) * idf AS x FROM (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({terms(norm(text))}) AS term FROM {rows}) GROUP BY ALL) JOIN vocab USING (term)))"""


def best(rows: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc, chunk_ord) AS rank FROM {rows}) WHERE rank <= {k}"


ASKED = "asked AS (SELECT * FROM requests WHERE trim(question) <> '')"
PLAIN = f"""{vectors_of('qv', 'asked', 'question')}, plain AS ({best('(SELECT qid, doc, chunk_ord, sum(a.weight * b.weight) AS score FROM qv a JOIN postings b USING (term) GROUP BY ALL HAVING sum(a.weight * b.weight) > 0)', 4)})"""
AWARE = f"""{routed('route_q', 'carried', 'question')}, {routed('route_a', "(SELECT * FROM carried WHERE asked <> question)", 'asked')},
sent AS (SELECT qid, coalesce(a.document, b.document) AS document FROM carried LEFT JOIN route_q a USING (qid) LEFT JOIN route_a b USING (qid)),
titled AS (SELECT chunks.*, {norm("coalesce(heading, '') || ' ' || text")} AS normalised, {norm('heading')} AS h, title FROM chunks LEFT JOIN (SELECT doc, nullif(trim({TITLE}, ' ' || chr(9) || chr(13)), '') AS title FROM manuals) USING (doc)),
wanted AS (SELECT qid, i, {norm('raw')} AS term FROM (SELECT qid, unnest(range(1, len(terms) + 1)) AS i, unnest(terms) AS raw FROM carried)),
hits AS (SELECT qid, doc, chunk_ord, n + CASE WHEN contains(h, first) THEN 1 ELSE 0 END AS score, CASE WHEN contains(h, first) THEN 'headed "' || heading || '"' ELSE 'contains "' || first || '"' END AS why FROM (
  SELECT qid, doc, chunk_ord, any_value(h) AS h, any_value(heading) AS heading, count(*) AS n, arg_min(term, i) AS first FROM wanted JOIN titled ON contains(normalised, term) JOIN sent USING (qid)
  WHERE term <> '' AND (sent.document IS NULL OR sent.document = doc) GROUP BY qid, doc, chunk_ord)),
letter AS ({best('hits', 4)}),
rest AS (SELECT * FROM carried WHERE qid NOT IN (SELECT qid FROM letter)),
{vectors_of('av', 'rest', 'asked')},
said AS (SELECT DISTINCT qid, unnest({terms(norm('asked'))}) AS term FROM rest),
heads_of AS (SELECT doc, chunk_ord, list_filter({terms('h')}, lambda w: NOT list_contains({terms(norm('title'))}, w)) AS l FROM titled WHERE heading IS NOT NULL AND heading IS DISTINCT FROM title),
bonus AS (SELECT qid, doc, chunk_ord, 0.35 * count(*) / any_value(k) AS bonus FROM (SELECT doc, chunk_ord, len(l) AS k, unnest(l) AS term FROM heads_of) JOIN said USING (term) GROUP BY qid, doc, chunk_ord),
near AS ({best('''(SELECT qid, doc, chunk_ord, sum(s) AS score, sum(more) AS more FROM (SELECT qid, doc, chunk_ord, a.weight * b.weight AS s, 0 AS more FROM av a JOIN postings b USING (term) UNION ALL SELECT qid, doc, chunk_ord, bonus, bonus FROM bonus)
  JOIN sent USING (qid) WHERE document IS NULL OR document = doc GROUP BY qid, doc, chunk_ord HAVING sum(s) > 0)''', 4)}),
aware AS (SELECT qid, doc, chunk_ord, score, rank, why FROM letter UNION ALL
  SELECT qid, doc, chunk_ord, score, rank, 'nearest by meaning' || CASE WHEN more > 0 THEN ', and headed "' || heading || '"' ELSE '' END FROM near JOIN chunks USING (doc, chunk_ord)),
said_on AS (SELECT qid, string_agg('"' || name || '"', ', ' ORDER BY name_ord) AS names FROM (
    SELECT h.qid, doc, name FROM route_q_h h JOIN route_q USING (qid) WHERE doc = document UNION
    SELECT h.qid, doc, name FROM route_a_h h JOIN route_a USING (qid) WHERE doc = document AND qid NOT IN (SELECT qid FROM route_q WHERE document IS NOT NULL)) JOIN names USING (doc, name) GROUP BY qid),
branched AS (SELECT qid, asked, terms, stands_alone, s.document, (SELECT any_value(c.document) FROM chunks c WHERE c.doc = s.document) AS called, names,
    CASE WHEN qid IN (SELECT qid FROM letter) THEN 'letter' WHEN t1 IS NOT NULL THEN 'nothing contains' ELSE 'meaning' END AS branch
  FROM carried JOIN sent s USING (qid) LEFT JOIN said_on USING (qid)),
quoted AS (SELECT *, list_transform(terms, lambda t: '"' || t || '"') AS q FROM branched)"""
ALL = f"WITH {INDEX}, {MANUALS}, @requests@, {KINDS}, {CARRIED}, {NAMES}, {PLAIN}, {AWARE} "
OVER_REQUESTS = ALL.replace("@requests@", "all_requests AS (SELECT DISTINCT request_id AS qid, coalesce(question, '') AS question, history FROM request WHERE request_id IS NOT NULL), asked AS (SELECT * FROM all_requests WHERE qid % 50 = 0 AND trim(question) <> ''), requests AS (SELECT * FROM asked)")
OVER_ALL_REQUESTS = OVER_REQUESTS.replace("qid % 50 = 0 AND ", "")
OVER_GOLD = ALL.replace("@requests@", "golden AS (SELECT DISTINCT qid, kind, ask, history, document, heading FROM gold), asked AS (SELECT qid, ask AS question, history FROM golden), requests AS (SELECT * FROM asked)")

JUDGED = """judged AS (SELECT g.qid, g.kind, coalesce(bool_or(p.rank = 1 AND p.doc IS NOT DISTINCT FROM g.document AND pc.heading IS NOT DISTINCT FROM g.heading), false) AS plain,
    coalesce(bool_or(a.rank = 1 AND a.doc IS NOT DISTINCT FROM g.document AND ac.heading IS NOT DISTINCT FROM g.heading), false) AS aware,
    coalesce(bool_or(a.doc IS NOT DISTINCT FROM g.document AND ac.heading IS NOT DISTINCT FROM g.heading), false) AS aware_at_all
  FROM golden g LEFT JOIN plain p USING (qid) LEFT JOIN chunks pc ON pc.doc = p.doc AND pc.chunk_ord = p.chunk_ord
  LEFT JOIN aware a USING (qid) LEFT JOIN chunks ac ON ac.doc = a.doc AND ac.chunk_ord = a.chunk_ord GROUP BY g.qid, g.kind)"""
OVER_FIVE = OVER_GOLD.replace("WHERE rank <= 4", "WHERE rank <= 5")
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
GAP = r"\s\x{a0}\x{feff}\x{2000}-\x{200a}\x{202f}\x{3000}"
SECTIONS = r"""lines AS (SELECT doc_id, i, l[i] AS line, trim(l[i], chr(32) || chr(9) || chr(160) || '　') AS bare, coalesce(trim(l[i + 1], chr(32) || chr(9) || chr(160) || '　'), '') AS after FROM (
  SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM docs))),
marked AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM (
  SELECT *, regexp_matches(bare, '^(#{1,6}\s+\S.*|[A-Z][^.!?\n]{2,70})$') AND (starts_with(bare, '#') OR after = '') AS head FROM lines)),"""

SQL: dict[str, str] = {
    "normalise_text": f"WITH {CHUNKS} SELECT chunk_ord AS chunk_id, {norm('text')} AS normalised FROM chunks",
    "token_counts": f"WITH {CHUNKS} SELECT word, count(*) AS n FROM (SELECT unnest({words('n')}) AS word FROM (SELECT {norm('text')} AS n FROM chunks)) GROUP BY word",
    "meaningful_terms": f"WITH {CHUNKS}, {COUNTS} SELECT term, sum(tf)::BIGINT AS n, count(*) AS chunks FROM counts GROUP BY term",
    "titles": f"WITH {MANUALS} SELECT doc AS name, nullif(trim({TITLE}, ' ' || chr(9) || chr(13)), '') AS title FROM manuals",
    "idf": f"WITH {CHUNKS}, {COUNTS}, {VOCAB} SELECT term, df, round(idf, 6) AS idf FROM vocab",
    "tfidf_vectors": f"WITH {INDEX} SELECT chunk_ord AS chunk_id, term, round(weight, 6) AS weight FROM postings",
    "similarity_topk": f"WITH {INDEX}, {REQUESTS}, {ASKED}, {PLAIN} SELECT qid, chunk_ord AS chunk_id, rank, round(score, 6) AS score FROM plain",
    "dense_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)
SELECT qid, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS qid, b.vec_id, list_dot_product(a.v, b.v) / (coalesce(nullif(a.n, 0), 1) * coalesce(nullif(b.n, 0), 1)) AS score FROM u a, u b WHERE a.vec_id % 50 = 0) WHERE score > 0) WHERE rank <= 5""",
    "question_kind": f"WITH {REQUESTS}, {KINDS} SELECT qid, stands_alone, lean_why, t1 AS literal, array_to_string(terms, ' | ') AS terms, array_to_string(meaningful, ' ') AS meaningful FROM kinds",
    "carry_subject": f"WITH {REQUESTS}, {KINDS}, {CARRIED} SELECT qid, asked FROM carried",
    "code_variants": f"WITH literals AS (SELECT DISTINCT unnest(regexp_extract_all(question, {q(SHAPES[0])})) AS code FROM request) SELECT code, array_to_string(variants, ' | ') AS variants FROM ({variants('literals', 'code')})",
    "document_names": f"WITH {MANUALS}, {NAMES} SELECT doc AS document, name, name_ord FROM names",
    "route_questions": f"WITH {MANUALS}, {REQUESTS}, {NAMES}, {routed('r', 'requests', 'question')} SELECT qid, document, weight::BIGINT AS weight FROM r",
    "letter_search": OVER_REQUESTS + "SELECT qid, chunk_ord AS chunk_id, rank, score::DOUBLE AS score FROM letter",
    "aware_search": OVER_ALL_REQUESTS + "SELECT qid, chunk_ord AS chunk_id, rank, round(score, 6)::DOUBLE AS score FROM aware",
    "compare_searches": OVER_ALL_REQUESTS + """SELECT qid, p.chunk_ord AS plain_id, a.chunk_ord AS aware_id, (p.doc IS NOT DISTINCT FROM a.doc AND p.chunk_ord IS NOT DISTINCT FROM a.chunk_ord) AS same
FROM asked LEFT JOIN (SELECT * FROM plain WHERE rank = 1) p USING (qid) LEFT JOIN (SELECT * FROM aware WHERE rank = 1) a USING (qid)""",
    "eval_by_kind": OVER_FIVE + f""", {JUDGED} SELECT kind, sum(plain::INT)::BIGINT AS plain, sum(aware::INT)::BIGINT AS aware, count(*) AS "of" FROM judged GROUP BY ROLLUP (kind)""",
    "eval_misses": OVER_FIVE + f", {JUDGED} SELECT qid, kind, plain, aware_at_all FROM judged WHERE NOT aware",
    "eval_disagreements": OVER_FIVE + f", {JUDGED} SELECT qid, kind, plain, aware FROM judged WHERE plain <> aware",
    "eval_regressions": OVER_FIVE + f", {JUDGED} SELECT qid, plain, aware FROM judged WHERE kind = 'ordinary' AND plain AND NOT aware",
    "verdicts": OVER_REQUESTS + """SELECT qid, asked, CASE WHEN branch <> 'letter' THEN called END AS document, branch,
  CASE branch WHEN 'letter' THEN 'letter for letter, on ' || array_to_string(q, ' and ') WHEN 'nothing contains' THEN 'nothing contains ' || array_to_string(q, ' or ') || ', so by meaning instead'
    ELSE CASE WHEN document IS NULL AND stands_alone THEN 'by meaning alone: nothing literal in it, no document named, no subject carried, so plain similarity gives the same'
      ELSE concat_ws(', ', 'by meaning', 'within ' || called || ', because it says ' || names, CASE WHEN NOT stands_alone THEN 'with the subject carried from the question before' END) END END AS how FROM quoted""",
    "answers": OVER_ALL_REQUESTS + "SELECT qid, rank, id, document, heading, text, round(score, 4)::DOUBLE AS score, why FROM aware JOIN chunks USING (doc, chunk_ord)",
    "ways_of_writing": f"""WITH {MANUALS}, titles AS (SELECT doc, {norm(TITLE)} AS n, regexp_extract({TITLE}, '\\b[A-Za-z]{{1,5}}[-_ ]?\\d{{2,}}\\b') AS code FROM manuals), v AS ({variants('titles', 'code')}),
w AS (SELECT *, {words('n')} AS l FROM v)
SELECT doc AS document, array_to_string(list_transform(list_filter(list_transform(range(1, len(x) + 1), lambda i: {{'i': i, 't': x[i], 'first': list_position(x, x[i]) = i}}), lambda s: s.first), lambda s: s.t), ' | ') AS ways FROM (
  SELECT doc, list_filter(list_concat([n, coalesce(l[1], ''), array_to_string(l[greatest(len(l) - 1, 1):], ' '), array_to_string(l[greatest(len(l) - 2, 1):], ' ')], variants), lambda t: length(t) >= 3 AND t NOT IN {EMPTY}) AS x FROM w)""",
    "windows": f"""WITH docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {SECTIONS}
bodies AS (SELECT doc_id, sec, max(CASE WHEN head THEN regexp_replace(bare, '^#+\\s*', '') END) AS heading,
  regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), ''), '^{SPACE}+|{SPACE}+$', '', 'g') AS body FROM marked GROUP BY doc_id, sec),
whole AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_at, heading, replace(t, chr(13), '') AS t FROM (
  SELECT doc_id, sec, heading, CASE WHEN coalesce(heading, '') = '' THEN body WHEN body = '' THEN heading ELSE heading || chr(10) || body END AS t FROM bodies) WHERE t <> ''),
started AS (SELECT doc_id, section_at, heading, t, length(t) AS n, unnest(range(0, CASE WHEN length(t) > 900 THEN (ceil((length(t) - 900) / 720) * 720)::BIGINT ELSE 0 END + 1, 720)) AS spot FROM whole),
raw AS (SELECT *, substr(t, spot + 1, 900) AS r FROM started),
began AS (SELECT *, CASE WHEN spot > 0 AND regexp_matches(substr(t, spot, 1), '[A-Za-z0-9_]') AND regexp_matches(r, '^[A-Za-z0-9_]') THEN regexp_replace(r, '^[^{GAP}]*[{GAP}]', '') ELSE r END AS b FROM raw),
tails AS (SELECT *, right(b, 120) AS tail FROM began),
stops AS (SELECT *, greatest(CASE WHEN contains(tail, '. ') THEN length(regexp_extract(tail, '(?s)^(.*)\\. ', 1)) + 1 ELSE 0 END, length(regexp_extract(tail, '(?s)^(.*\\n)', 1))) AS stop FROM tails),
cut AS (SELECT *, regexp_replace(CASE WHEN spot + 900 < n AND stop > 21 THEN left(b, length(b) - length(tail) + stop) ELSE b END, '^{SPACE}+|{SPACE}+$', '', 'g') AS text FROM stops)
SELECT doc_id, doc_id::VARCHAR AS name, doc_id || '#' || chunk_ord AS id, chunk_ord, section_at, heading, text FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_at, spot) - 1 AS chunk_ord FROM cut WHERE text <> '')""",
    "sections": f"""WITH docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {SECTIONS}
parts AS (SELECT doc_id, sec, max(CASE WHEN head THEN regexp_replace(bare, '^#+\\s*', '') END) AS heading,
  regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), ''), '^[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}\\x{{feff}}]+|[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}\\x{{feff}}]+$', '', 'g') AS body FROM marked GROUP BY doc_id, sec)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_at, heading, text FROM (
  SELECT doc_id, sec, heading, CASE WHEN coalesce(heading, '') = '' THEN body WHEN body = '' THEN heading ELSE heading || chr(10) || body END AS text FROM parts) WHERE text <> ''""",
    "clean_name": r"""SELECT doc_id, nullif(left(trim(regexp_replace(regexp_replace(regexp_replace(trim(product), '\.[A-Za-z0-9]+$', ''), '[^\p{L}\p{N} _-]+', ' ', 'g'), '\s+', ' ', 'g')), 80), '') AS name
FROM (SELECT doc_id, coalesce(source, '') || ' (' || coalesce(product, '') || ').v2.pdf' AS product FROM documents)""",
    "corpus_listing": f"""WITH {CHUNKS}, {MANUALS}, {NAMES} SELECT doc AS name, length(text) AS characters, (SELECT count(*) FROM chunks WHERE chunks.doc = manuals.doc) AS pieces,
(SELECT string_agg(name, ' | ' ORDER BY name_ord) FROM names WHERE names.doc = manuals.doc) AS names FROM manuals""",
    "unread_summary": """WITH m AS (SELECT DISTINCT name, unread FROM manual WHERE name IS NOT NULL AND len(unread) > 0),
p AS (SELECT name, unnest(range(1, len(unread) + 1)) AS i, unnest(unread) AS u FROM m), f AS (SELECT name, i, u.page AS page, u.why AS why FROM p)
SELECT name, why, count(*) AS pages, string_agg(part, ',' ORDER BY low) AS runs FROM (
  SELECT name, why, page, low, CASE WHEN page = low THEN CASE WHEN k >= 3 THEN low || ' to ' || high WHEN k = 2 THEN low || ',' || high ELSE low::VARCHAR END END AS part FROM (
    SELECT name, why, page, min(page) OVER g AS low, max(page) OVER g AS high, count(*) OVER g AS k FROM (
      SELECT *, page - row_number() OVER (PARTITION BY name, why ORDER BY page) AS isle FROM f) WINDOW g AS (PARTITION BY name, why, isle))) GROUP BY name, why""",
    "pdf_round_trip": f"WITH {CHUNKS} SELECT chunk_ord AS chunk_id, true AS same FROM chunks WHERE {norm('text')} <> ''",
    "pdf_manners": f"""WITH {CHUNKS}, n AS (SELECT chunk_ord AS chunk_id, {norm('text')} AS t FROM chunks),
m AS (SELECT unnest(['plain', 'deflated', 'mapped', 'wide', 'scan', 'backwards', 'unmapped', 'encrypted', 'missing_page']) AS manner)
SELECT chunk_id, manner, CASE WHEN manner IN ('mapped', 'wide') THEN t WHEN manner IN ('unmapped', 'encrypted', 'missing_page') THEN '' ELSE regexp_replace(t, '[^\\x20-\\x7e]', '?', 'g') END AS text,
  CASE manner WHEN 'scan' THEN 'no text layer — a scan, or text drawn as shapes' WHEN 'unmapped' THEN 'text in a font whose codes cannot be turned into characters (/F1: a CID font, Identity-H, with no ToUnicode map)'
    WHEN 'encrypted' THEN 'it is encrypted, and this reader does not decrypt' WHEN 'missing_page' THEN 'its page tree names pages this reader could not find, so it cannot say which it missed' ELSE '' END AS reason
FROM n, m WHERE t <> ''""",
}
