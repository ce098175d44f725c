"""The operators of a collection, each against plain Python or expectations worked out by hand."""

import base64
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, evaluate, naming, questions, retrieve, vectors
from lectern.operators import corpus as collection
from lectern.operators.corpus import NO_NAME, NOT_BASE64, TOO_LONG, TOO_MUCH, Corpus, clean_name, unread_said
from lectern.sources.pdf import character_map, from_pdf, read_pdf, read_pdfs, said_pages
from lectern.sources.pdf_writer import pdf_of, write_pdfs


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


# --- text -------------------------------------------------------------------------------------------------------------

def normal(t):
    t = t or ""
    for a, b in T.TIDIED.items():
        t = t.replace(a, b)
    t = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", t)).lower()
    return re.sub(r"\s+", " ", t).strip()


TEXTS = ["Città È “quoted”", "a b​c", "x – y — z", "ﬁne ２ ½", "  many \n\t blanks ", "", None, "Straße naïve", "été", "A" * 5000]


@pytest.mark.parametrize("t", TEXTS)
def test_normalise(spark, t):
    assert one(spark, T.normalise, t) == normal(t)


@pytest.mark.parametrize("word, stem", [("things", "thing"), ("cleaned", "clean"), ("Cleaning".lower(), "clean"), ("bed", "bed"), ("settings", "sett"), ("boxes", "boxes"[:-1]), ("repeatedly", "repeat"), ("smallest", "small"), ("is", "is")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem, word) == stem


def test_words(spark):
    n = lambda t: one(spark, lambda c: T.words(c), t)
    assert n("(tp-60), range. wide-format ... 'x") == ["tp-60", "range", "wide-format", "x"] and n("") == []
    assert one(spark, T.meaningful_words, "the cleaned rollers of an ab roller") == ["clean", "roller", "roller"]


@pytest.mark.parametrize("pages, said", [([2], "page 2"), ([2, 5], "pages 2 and 5"), ([1, 2, 3, 9], "pages 1 to 3 and 9"), ([1, 2, 4, 5, 6], "pages 1, 2 and 4 to 6"), ([3, 4, 5, 6], "pages 3 to 6"), ([1, 3, 5], "pages 1, 3 and 5"), ([7, 8], "pages 7 and 8")])
def test_page_words(spark, pages, said):
    assert one(spark, T.page_words, pages, "array<int>") == said == said_pages(pages)


# --- chunking ---------------------------------------------------------------------------------------------------------

def sections(spark, t):
    df = spark.createDataFrame([(1, t, "extra")], "doc_id int, text string, heading string")
    return [(r.heading, r.text) for r in chunking.sections(df).orderBy("section_at").collect()]


def test_sections(spark):
    assert sections(spark, "before\n\n# One\nbody\r\n\r\nTwo of them\n\nmore\n## Three") == [
        (None, "before"), ("One", "One\nbody"), ("Two of them", "Two of them\nmore"), ("Three", "Three")]
    assert sections(spark, "A line that looks like one\nbut goes on here") == [(None, "A line that looks like one\nbut goes on here")]
    assert sections(spark, "") == sections(spark, None) == []


LONG_TEXTS = ["Some sentence here. " * 60, "aaaa " * 200, "x" * 3000, "line one\nline two\n" * 90, "one clause, another clause, " * 40, "ab. " * 500, "Ends here.\n\nStarts there, and goes on " * 30]


@pytest.mark.parametrize("text", LONG_TEXTS)
@pytest.mark.parametrize("size, overlap", [(900, 180), (300, 60), (200, 200), (200, 5000), (120, 0)])
def test_windows_keep_the_bounds(spark, text, size, overlap):
    """What windows promise, whatever their text: bounded, in order, whole words at the front, natural ends, nothing lost."""
    got = one(spark, lambda c: chunking.window_array(c, size, overlap), text)
    step = size - (size // 4 if overlap >= size else overlap)
    assert len(got) == 1 + max(0, -(-(len(text) - size) // step)) and all(0 < len(w) <= size and w == w.strip() for w in got)
    starts, at = [], 0
    for k, w in enumerate(got):
        at = text.index(w, k * step)  # a window lies in its own stretch of the text
        assert k * step <= at and at + len(w) <= k * step + size + 1
        starts.append(at)
        inside = at and text[at - 1].isalnum() and text[at].isalnum()
        assert not inside or " " not in text[k * step : k * step + size].strip()  # only a word longer than a window is cut into
        cut = text[at + len(w) :].lstrip(" ")
        stretch = text[k * step : k * step + size][-100:]
        assert not cut or w[-1] == "." or cut[0] == "\n" or not any(x in stretch for x in (". ", "\n"))
    lost = [word for word in set(text.split()) if len(word) <= 20 and not any(word in w for w in got)]
    assert not lost and starts == sorted(starts)


def test_windows_of_little(spark):
    for text in ("", "  \n ", None, "\r\n"):
        assert one(spark, chunking.window_array, text) == []
    assert one(spark, chunking.window_array, " short\r\ntext ") == ["short\ntext"]
    # 900 characters end at the stop before; the next window starts 180 before that end, at a whole word.
    text = "The valve opens at once. " * 50
    first, second = one(spark, chunking.window_array, text)
    assert first == ("The valve opens at once. " * 36).strip() and text.index(second, 720) == 725 and second.endswith("once.")


def test_windows_of_very_long_texts(spark):
    # More windows than a slab has: each must be what the same stretch gives by itself, and the time must stay linear.
    text = " ".join(f"word{i}." if i % 9 == 0 else f"word{i}" for i in range(400_000))
    began = time.time()
    got = one(spark, chunking.window_array, text)
    assert time.time() - began < 60 and len(got) == 1 + -(-(len(text) - 900) // 720)
    for k in (0, 1, 63, 64, 65, 128, 3000):
        alone = one(spark, chunking.window_array, text[k * 720 - 720 if k else 0 : k * 720 + 2000])
        assert got[k] == alone[1 if k else 0]


def test_cut_up_keeps_documents_of_one_name_apart(spark):
    docs = spark.createDataFrame([(1, "a", "# T\n" + "word. " * 300), (2, "a", "# T\nshort")], "doc_id int, name string, text string")
    rows = chunking.cut_up(docs).collect()
    assert {r.id for r in rows if r.doc_id == 2} == {"a#0"} and [r.chunk_ord for r in sorted(rows) if r.doc_id == 1] == list(range(sum(r.doc_id == 1 for r in rows)))


# --- questions --------------------------------------------------------------------------------------------------------

LEANS = ["so does this bend", "are those washable", "e quello si lava", "come detto, quanto dura", "tell me more about the above", "but how?", "its colour", "   ", "", None]
STANDS = ["torque of the spindle nut", "KX-31 fuse rating", "which oil suits the gearbox in winter", "quanto pesa il mandrino lungo", "cleaning interval?", "la pòsit resta ferma"]


def test_leaning(spark):
    df = spark.createDataFrame([(q, None) for q in [*LEANS, *STANDS]], "question string, history array<string>")
    assert [r.leaning.yes for r in questions.classify(df).collect()] == [True] * len(LEANS) + [False] * len(STANDS)


@pytest.mark.parametrize("q, term", [("is K-9075 bad", "K-9075"), ("log shows WRN_881A twice", "WRN_881A"), ("code 0xDEAD42", "0xDEAD42"), ("does spinUp( block", "spinUp("), ("where is Lid::open used", "::"), ("x -> y", "->"), ("set OIL_LEVEL to two", "OIL_LEVEL"), ("type `low oil`", "`low oil`"), ("can I grease the lid", None), ("A-12 is too short", None), (None, None)])
def test_literal(spark, q, term):
    got = one(spark, questions.literal, q)
    assert got.term == term and got.yes == (term is not None)


def test_literal_terms_longest_first(spark):
    assert one(spark, questions.literal_terms, "K-9075, then OIL_LEVEL, K-9075 and Q-1234") == ["OIL_LEVEL", "K-9075", "Q-1234"]


def test_spellings(spark):
    v = lambda c: one(spark, questions.variants_of, c)
    assert v("q_7781") == ["q/7781", "q-7781", "q 7781", "q7781"] and v("Spindle") == ["spindle"] and v("88") == ["88"] and v("") == v(None) == []
    ways = one(spark, lambda c: questions.ways_of_writing(c, questions.variants_of(F.lit("q_7781"))), "long wood lathe spindle")
    assert ways == ["long wood lathe spindle", "long", "lathe spindle", "wood lathe spindle", "q/7781", "q-7781", "q 7781", "q7781"]
    assert one(spark, lambda c: questions.ways_of_writing(c, F.array().cast("array<string>")), "lid") == ["lid"]


# --- vectors ----------------------------------------------------------------------------------------------------------

def test_vectors_are_unit_and_rare_terms_weigh_more(spark):
    df = spark.createDataFrame([(1, "printer tray printer"), (2, "printer margin"), (3, ""), (4, None), (5, "the of")], "id int, text string")
    counts = vectors.term_counts(df, "id")
    vocab = vectors.learn(counts, df.agg(F.count("*").alias("n")))
    idf = {r.term: r.idf for r in vocab.collect()}
    assert idf["tray"] > idf["printer"]
    rows = vectors.vectors(counts, vocab, "id").collect()
    for i in (1, 2):
        assert sum(r.weight**2 for r in rows if r.id == i) == pytest.approx(1, abs=1e-9)
    assert {r.id for r in rows} == {1, 2}


def test_dense_and_providers(spark):
    assert one(spark, vectors.unit, [3.0, 4.0], "array<double>") == [0.6, 0.8] and one(spark, vectors.unit, [0.0, 0.0], "array<double>") == [0.0, 0.0]
    dense = vectors.DenseProvider(lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert one(spark, dense.column, "abc") == pytest.approx([3 / 10**0.5, 1 / 10**0.5])
    assert vectors.provider().lexical and vectors.provider("openai", "key").name == "openai"
    for args in (("openai",), ("other", "key")):
        with pytest.raises(ValueError):
            vectors.provider(*args)


# --- a collection -----------------------------------------------------------------------------------------------------

MANUALS = [
    ("fault-list", "# Veldt lathe: fault list\n\nEvery number shown by the panel. Look it up here.\n\n## E-1001\n\nThe lid is open. Close the lid.\n\n## E-1002\n\nThe belt slipped. Tighten the belt."),
    ("vl10", "# Veldt VL-10 bench lathe\n\nThe compact lathe for the hobby bench. It turns wood.\n\n## Cleaning\n\nClean the chuck with a brush every week.\n\n## Speed\n\nThe speed is set with SPEED_MODE on the panel."),
    ("vl20", "# Veldt VL-20 floor lathe\n\nThe heavyweight lathe for workshops. It turns metal.\n\n## Cleaning\n\nClean the gearbox with oil every month.\n\n## Speed\n\nThe speed is set with SPEED_MODE on the pedestal."),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark, spark.createDataFrame(MANUALS, "name string, text string"))


def asked(spark, *qs):
    return spark.createDataFrame([(i, q, h) for i, (q, h) in enumerate(qs)], "qid int, question string, history array<string>")


def test_names(corpus):
    names = {}
    for r in corpus.index.names.orderBy("doc", "name_ord").collect():
        names.setdefault(r.doc, []).append(r.name)
    assert names[2][:4] == ["vl/10", "vl-10", "vl 10", "vl10"] and names[3][:4] == ["vl/20", "vl-20", "vl 20", "vl20"]
    assert "heavyweight" in names[3] and "lathe" not in names[2] and "fault" in names[1]


def test_routing(spark, corpus):
    q = asked(spark, ("how fast is the VL-20", None), ("the lathe", None), ("VL-10 or VL-20", None), ("", None), (None, None))
    got = {r.qid: r.document for r in naming.route(q, corpus.index.names, "qid", "question", "doc").collect()}
    assert got.get(0) == 3 and got.get(1) is None and got.get(2) is None and 3 not in got


def test_aware_search(spark, corpus):
    q = asked(spark, ("what is E-1002", []), ("how often should I do the cleaning of the VL-20", []), ("and the VL-10?", ["how do I clean the VL-20"]), ("what does SPEED_MODE do", []), ("zzz qqq xxx", []), ("what is ERR_99999", None), ("", []))
    answers = corpus.ask(q)
    first = {r.qid: (r.document, r.heading) for r in answers["aware"].where("rank = 1").collect()}
    assert first[0] == ("fault-list", "E-1002") and first[1] == ("vl20", "Cleaning") and first[2] == ("vl10", "Cleaning") and first[3] == ("vl10", "Speed")
    assert 4 not in first
    said = {r.qid: r for r in answers["verdicts"].collect()}
    assert said[0].how == 'letter for letter, on "E-1002"' and said[0].document is None
    assert said[2].how.endswith("with the subject carried from the question before") and said[2].document == "vl10"
    assert said[5].how.startswith('nothing contains "ERR_99999"')
    assert [r.qid for r in answers["refused"].collect()] == [6]
    assert {r.qid: r.same for r in answers["compared"].collect()}[4] is True


def test_evaluation(spark, corpus):
    gold = spark.createDataFrame([(0, "literal", "what is E-1002", [], "fault-list", "E-1002"), (1, "ordinary", "cleaning the VL-20", [], "vl20", "Cleaning"), (2, "ordinary", "nothing here", [], "vl20", "Speed")], "qid int, kind string, ask string, history array<string>, document string, heading string")
    q = gold.select("qid", F.col("ask").alias("question"), "history")
    results = evaluate.outcomes(retrieve.by_similarity(q, corpus.index), retrieve.aware(q, corpus.index)[0], gold, corpus.index)
    table = [(r.kind, r.aware, r.of) for r in evaluate.by_kind(results).collect()]
    assert table == [("literal", 1, 1), ("ordinary", 1, 2), (None, 2, 3)]
    assert evaluate.gate(results) and evaluate.misses(results).count() == 1


def test_changes(spark, corpus):
    before = corpus.describe().first()
    assert (before.documents, before.provider, before.lexical) == (3, "local", True)
    got = corpus.add("My kettle (v2).md", "# Kettle KT-55\n\nThe kettle boils water.\n\n## Descaling\n\nUse vinegar.")
    assert got["ok"] and got["name"] == "My kettle v2" and not got["replaced"] and got["renamed"] == []
    assert corpus.add("My kettle v2.txt", "# Kettle KT-55\n\nChanged.")["replaced"] and corpus.describe().first().documents == 4
    q = asked(spark, ("what about the kettle", []))
    assert corpus.ask(q)["verdicts"].first().document == "My kettle v2"
    for args in (("???.md", "text"), ("x", "  "), ("x", "y" * (4 * 1024 * 1024 + 1))):
        assert not corpus.add(*args)["ok"]
    assert not corpus.remove("vl10")["ok"] and "stay" in corpus.remove("vl10")["why"] and not corpus.remove("nothing")["ok"]
    assert corpus.remove("My kettle v2")["ok"] and corpus.describe().first().documents == 3
    with pytest.raises(ValueError):
        Corpus(spark, spark.createDataFrame([("a", "")], "name string, text string"))


def test_failed_change_changes_nothing(corpus, monkeypatch):
    index, count = corpus.index, corpus.describe().first().documents
    monkeypatch.setattr(retrieve, "build_index", lambda *_: (_ for _ in ()).throw(RuntimeError("no")))
    with pytest.raises(RuntimeError):
        corpus.add("a", "some text")
    assert corpus.index is index and corpus.describe().first().documents == count


def test_ingest(spark, corpus, tmp_path):
    from lectern.streaming.ingest import ingest

    spark.createDataFrame([("streamed one", "# Streamed SO-77\n\nText."), ("", "x"), ("blank", " ")], "name string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, text string").parquet(str(tmp_path / "in"))
    ingest(corpus, stream, str(tmp_path / "check")).awaitTermination(120)
    assert {r.name for r in corpus.documents().where("not given").collect()} == {"streamed one"}
    corpus.reset()
    assert corpus.documents().count() == 3


def test_ingest_keeps_what_is_refused(spark, corpus, tmp_path):
    from lectern.streaming.ingest import ingest

    spark.createDataFrame([("fine", "# Fine FN-1\n\nText."), ("???.md", "lost"), ("long", "y" * (4 * 1024 * 1024 + 1))], "name string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, text string").parquet(str(tmp_path / "in"))
    ingest(corpus, stream, str(tmp_path / "check")).awaitTermination(120)
    refused = {r.name: (len(r.text), r.why) for r in spark.read.parquet(str(tmp_path / "check-refused")).collect()}
    assert refused == {"???.md": (4, NO_NAME), "long": (4 * 1024 * 1024 + 1, TOO_LONG)}
    corpus.reset()


def test_upload(spark, corpus, monkeypatch):
    """Text, PDF and base64 in one batch, with every refusal as a row, and the limits of all documents together."""
    monkeypatch.setattr(collection, "MOST_ONE", 1000)
    monkeypatch.setattr(collection, "MOST_ALL", 2500)
    scan, mixed = pdf(SCAN), pdf(shown(b"The crank CR-88 turns."), SCAN)
    rows = [("crank.pdf", None, mixed, None), ("scan.pdf", None, scan, None), ("coded.pdf", None, None, base64.b64encode(pdf(shown(b"Coded words"))).decode()), ("bad.pdf", None, None, "no base64 at all!"), ("none", None, None, None)]
    rows += [(f"big{i}", "z " * 490, None, None) for i in range(4)]
    got = {r.name: r for r in corpus.add_all(spark.createDataFrame(rows, "name string, text string, bytes binary, base64 string")).collect()}
    assert {n for n, r in got.items() if r.ok} == {"crank", "coded", "big0", "big1"} and got["bad"].why == NOT_BASE64 and got["big3"].why == TOO_MUCH
    assert got["crank"].pages == 2 and [u.page for u in got["crank"].unread] == [2] and got["crank"].not_read.startswith("Page 2 was not read") and "no page this can read" in got["scan"].why
    assert corpus.added_characters() == 2 * 980 + len("The crank CR-88 turns.") + len("Coded words") <= 2500
    one_more = corpus.add("big3", "z " * 490)
    assert one_more == {"ok": False, "why": TOO_MUCH} and corpus.add("b64", base64=base64.b64encode(scan).decode())["ok"] is False
    corpus.reset()
    assert corpus.added_characters() == 0 and corpus.describe().first().documents == 3


def counting(texts):
    """An offline stand-in for a service: how often each of 512 classes of words stands in a text."""
    out = []
    for t in texts:
        v = np.zeros(512)
        for w in re.findall(r"[a-z0-9][a-z0-9_-]{3,}", t.lower()):
            v[zlib.crc32(w.encode()) % 512] += 1
        out.append(v)
    return out


def test_dense_collection(spark):
    dense = Corpus(spark, spark.createDataFrame(MANUALS, "name string, text string"), vectors.DenseProvider(counting))
    said = dense.describe().first()
    assert (said.provider, said.lexical) == ("dense", False)
    q = asked(spark, ("what is E-1002", []), ("how often should I do the cleaning of the VL-20", []), ("brush every week", []), ("zzzz qqqq", []))
    answers = dense.ask(q)
    first = {r.qid: (r.document, r.heading, r.why) for r in answers["aware"].where("rank = 1").collect()}
    assert first[0][:2] == ("fault-list", "E-1002") and first[1] == ("vl20", "Cleaning", 'nearest by meaning, and headed "Cleaning"') and first[2][:2] == ("vl10", "Cleaning")
    # Against plain numpy: every score of the plain search.
    held = counting([r.text for r in dense.index.chunks.collect()])
    for qid, question in ((1, "how often should I do the cleaning of the VL-20"), (2, "brush every week")):
        a = counting([question])[0]
        want = sorted((round(float(a @ v / np.linalg.norm(a) / np.linalg.norm(v)), 4) for v in held if a @ v > 0), reverse=True)[:4]
        assert [r.score for r in answers["plain"].where(f"qid = {qid}").orderBy("rank").collect()] == pytest.approx(want)
    # Documents that arrive later are searched too; a service that fails changes nothing.
    assert dense.add("kettle", "# Kettle KT-55\n\n## Descaling\n\nUse vinegar against chalk.")["ok"]
    assert dense.ask(asked(spark, ("vinegar against chalk", [])))["plain"].first().document == "kettle"

    def down(texts):
        raise RuntimeError("the service answered 503")

    index, dense.provider = dense.index, vectors.DenseProvider(down)
    with pytest.raises(Exception, match="503"):
        dense.add("other", "some text")
    assert dense.index is index and {r.name for r in dense.documents().collect()} == {"fault-list", "vl10", "vl20", "kettle"}


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (60, 8)).astype(float)
    v[7] = v[8] = v[9] = v[3] * 2  # ties
    monkeypatch.setattr(retrieve, "BLOCK_NUMBERS", 16)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (98, []), (97, [0.0] * 8)], "vec_id int, embedding array<double>")
    got = retrieve.by_dense(rows.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "qid"), rows, 4)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = {(i, k + 1): j for i in range(0, 60, 3) for k, j in enumerate([j for j in sorted(range(60), key=lambda j: (-round(float(u[i] @ u[j]), 9), j)) if u[i] @ u[j] > 1e-12][:4])}
    assert {(r.qid, r.rank): r.vec_id for r in got.collect()} == true


@pytest.mark.parametrize("at_a_time", [40, 1 << 20])
@pytest.mark.parametrize("letters", [False, True])
def test_best_of_postings_is_brute_force(spark, monkeypatch, at_a_time, letters):
    import random

    from lectern.operators import retrieve

    monkeypatch.setattr(retrieve, "BLOCK_POSTINGS", at_a_time)
    monkeypatch.setattr(retrieve, "BLOCK_NUMBERS", 300)
    r = random.Random(5)
    chunks = [(f"d{min(9, r.randrange(20))}", i) for i in range(200)]
    value = (lambda: 1.0) if letters else (lambda: r.choice([0.125, 0.25, 0.5, 0.75]))  # many ties
    postings = [(*c, f"t{t}", value(), 0) for c in chunks for t in r.sample(range(30), r.choice([1, 4, 12]))]
    headings = {c: r.choice(["t1 t2", "t7", "t11 t5", None]) for c in chunks}
    asked = [(q, r.choice([None, None, "d3", "d9", "none"]), f"t{t}", value(), at) for q in range(60) for at, t in enumerate(r.sample(range(32), r.choice([1, 3, 6])))]
    want = set()
    for q in range(60):
        own, scores, seen = sorted((a for a in asked if a[0] == q), key=lambda a: a[4]), {}, set()
        to = own[0][1]
        own = [(q, to, *a[2:]) for a in own]
        for _, _, t, w, _ in own:
            for d, o, term, v, _ in postings:
                if term == t and to in (None, d):
                    scores[d, o] = scores.get((d, o), 0.0) + w * v + (letters and (d, o) not in seen and term in (headings[d, o] or ""))
                    seen.add((d, o))
        for rank, ((d, o), s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4], 1):
            want.add((q, d, o, rank, round(s, 9)))
    to_of = {}
    asked = [(q, to_of.setdefault(q, to), t, w, at) for q, to, t, w, at in asked]
    found = retrieve.best_of_postings(
        spark.createDataFrame(asked, "gid bigint, to string, term string, weight double, at int"),
        spark.createDataFrame([p[:4] for p in postings], "doc string, chunk_ord bigint, term string, weight double").repartition(3), 4,
        spark.createDataFrame([(*c, h) for c, h in headings.items()], "doc string, chunk_ord bigint, heading string") if letters else None)
    assert {(x["gid"], x["doc"], x["chunk_ord"], x["rank"], round(x["score"], 9)) for x in found.collect()} == want


def test_index_leaves_no_table_that_nothing_reads(spark, monkeypatch, tmp_path):
    from lectern.functions import shared
    from lectern.operators import retrieve

    chunks = spark.createDataFrame([("a", 0, "a#0", "a", "Rolls", "paper rolls")], "doc string, chunk_ord bigint, id string, document string, heading string, text string")
    docs = spark.createDataFrame([("a", "a", "Rolls", "Rolls")], "doc string, name string, text string, title string")
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    retrieve.build_index(chunks, docs)
    assert "index-counts" not in {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}


def test_endpoint_asks_in_batches(monkeypatch):
    import io
    import json
    import urllib.error
    import urllib.request

    asked_for, fails = [], [503, 429]

    def urlopen(request, timeout):
        body = json.loads(request.data)
        if fails:
            raise urllib.error.HTTPError(request.full_url, fails.pop(), "busy", {}, io.BytesIO(b"busy"))
        asked_for.append((len(body["input"]), timeout))
        return io.BytesIO(json.dumps({"data": [{"index": i, "embedding": [len(t)]} for i, t in reversed(list(enumerate(body["input"])))]}).encode())

    monkeypatch.setattr(urllib.request, "urlopen", urlopen)
    monkeypatch.setattr(time, "sleep", lambda s: None)
    texts = ["x" * i for i in range(5)]
    assert vectors.asked_endpoint(texts, "http://x", "k", "m", 2, 7.0, 4) == [[0], [1], [2], [3], [4]] and asked_for == [(2, 7.0), (2, 7.0), (1, 7.0)]
    fails.extend([401])
    with pytest.raises(RuntimeError, match="401"):
        vectors.asked_endpoint(texts, "http://x", "k", "m", 2, 7.0, 4)


def test_settings_and_log(capsys):
    import json
    import logging

    from lectern.settings import Settings, log_to

    assert Settings.from_environment({}).provider().lexical
    chosen = Settings.from_environment({"EMBEDDINGS": "openai", "OPENAI_API_KEY": "k", "EMBEDDING_MODEL": "m", "DOCUMENTS": "here"})
    assert (chosen.documents, chosen.provider().model) == ("here", "m")
    with pytest.raises(ValueError):
        Settings.from_environment({"EMBEDDINGS": "openai"}).provider()
    handler = log_to()
    logging.getLogger("lectern.x").warning("partly read", extra={"detail": {"name": "a"}})
    logging.getLogger("lectern").removeHandler(handler)
    line = json.loads(capsys.readouterr().out)
    assert (line["level"], line["message"], line["name"]) == ("warning", "partly read", "a") and line["at"].endswith("+00:00")


def test_folder(spark, tmp_path):
    from lectern.sources.folder import read_folder, read_pdf_folder

    (tmp_path / "b.md").write_bytes(b"two\r\nlines")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "c.csv").write_text("no")
    (tmp_path / "d.pdf").write_bytes(pdf_of([["hello"]]))
    assert sorted(map(tuple, read_folder(spark, str(tmp_path)).collect())) == [("a", "one"), ("b", "two\r\nlines")]
    assert [(r.name, r.text) for r in read_pdf_folder(spark, str(tmp_path)).collect()] == [("d", "hello")]


def test_clean_name_and_unread(spark):
    assert [one(spark, clean_name, n) for n in ("a/b.c.PDF", "  .md", None, "x" * 99, "é_-1")] == ["a b c", None, None, "x" * 80, "é_-1"]
    docs = spark.createDataFrame([("a", [(2, "no text layer")]), ("b", [(1, "x"), (2, "x"), (4, "y")]), ("c", []), ("d", None)], "name string, unread array<struct<page: int, why: string>>")
    said = {r.name: r.not_read for r in unread_said(docs).collect()}
    assert said["a"].startswith("Page 2 was not read: it has no text layer. Nothing on it is in the index")
    assert said["b"].startswith("Pages 1, 2 and 4 were not read: pages 1 and 2 have x; page 4 has y. Nothing on them")
    assert said["c"] is None and said["d"] is None


# --- PDF --------------------------------------------------------------------------------------------------------------

HELVETICA = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"


def pdf(*pages, font=HELVETICA, more=b"", trailer=b"/Root 1 0 R", backwards=False):
    """Pages are contents, or contents with something for the dictionary of their stream."""
    ids = [10 + 2 * i for i in range(len(pages))]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] >>" % b" ".join(b"%d 0 R" % i for i in ids), 3: font}
    for i, page in zip(ids, pages):
        content, extra = page if isinstance(page, tuple) else (page, b"")
        objects[i] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (i + 1)
        objects[i + 1] = b"<< %s /Length %d >>\nstream\n%s\nendstream" % (extra, len(content), content)
    listed = sorted(objects, reverse=backwards)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, objects[i]) for i in listed) + more + b"trailer\n<< %s >>\n%%%%EOF" % trailer


def shown(words):
    return b"BT /F1 12 Tf 72 720 Td (%s) Tj ET" % words


SCAN, BLANK = b"q 612 0 0 792 0 0 cm /Im1 Do Q", b"q 0 0 612 792 re W n Q"


def test_pdf_pages():
    got = read_pdf(pdf(shown(b"one"), SCAN, BLANK, shown(b"four"), backwards=True))
    assert got["text"] == "one\n\nfour" and [p for p, _ in got["unread"]] == [2] and "page 3 is blank" in got["why"]
    assert not from_pdf(pdf(SCAN), "scan")["ok"] and from_pdf(pdf(shown(b"x")), "x")["text"] == "x"
    assert "encrypted" in read_pdf(pdf(shown(b"x"), trailer=b"/Root 1 0 R /Encrypt 9 0 R"))["why"]
    assert read_pdf(b"hello")["why"] == "this is not a PDF" and "no objects" in read_pdf(b"%PDF-1.4")["why"]
    assert "could not find" in read_pdf(pdf(shown(b"x")).replace(b"/Kids [10 0 R]", b"/Kids [10 0 R 77 0 R]"))["why"]
    assert read_pdf(pdf((zlib.compress(shown(b"packed")), b"/Filter /FlateDecode")))["text"] == "packed"
    assert read_pdf(pdf((b"\x00", b"/Filter /LZWDecode"), shown(b"x")))["unread"] == [(1, "content this reader cannot decode")]


def test_pdf_layout():
    text = lambda c: read_pdf(pdf(b"BT /F1 10 Tf 0 700 Td " + c + b" ET"))["text"]
    assert text(b"(a) Tj 0 -12 Td (b) Tj") == "a\nb" and text(b"[(a) -300 (b) -20 (c)] TJ") == "a bc"
    assert text(b"(a) Tj 50 0 Td (b) Tj") == "a b" and text(b"12 TL (a) Tj T* (b) Tj (c) '") == "a\nb\nc"
    assert text(rb"(\101\(x\) \\ (in) \n) Tj") == "A(x) \\ (in)" and text(b"<414243> Tj") == "ABC"
    assert read_pdf(pdf(b"BT /F1 10 Tf 1 2 (a) \" ET"))["unread"][0][1] == "text shown in a way this reader does not parse"


def test_pdf_fonts():
    cmap = b"begincodespacerange <00> <ff> endcodespacerange beginbfchar <01> <0041> endbfchar beginbfrange <02> <03> <0042> <04> <05> [<0058> <0059>] endbfrange"
    chars, width = character_map(cmap)
    assert chars == {1: "A", 2: "B", 3: "C", 4: "X", 5: "Y"} and width == 1
    stream = b"5 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(cmap), cmap)
    font = b"<< /Type /Font /Subtype /Type1 /ToUnicode 5 0 R >>"
    got = read_pdf(pdf(b"BT /F1 9 Tf <0102030405> Tj ET", font=font, more=stream))
    assert got["text"] == "ABCXY" and got["fonts"] == 1
    assert "cannot be turned into characters" in read_pdf(pdf(b"BT /F1 9 Tf <09> Tj ET", font=font, more=stream))["unread"][0][1]
    two = cmap.replace(b"<00> <ff>", b"<0000> <ffff>")
    assert character_map(two)[1] == 2
    cid = b"<< /Type /Font /Subtype /Type0 /Encoding /%s >>"
    assert "with no ToUnicode map" in read_pdf(pdf(shown(b"ab"), font=cid % b"Identity-H"))["unread"][0][1]
    assert read_pdf(pdf(b"BT /F1 9 Tf <00410042> Tj ET", font=cid % b"UniGB-UCS2-H"))["text"] == "AB"


@pytest.mark.parametrize("content", [b"BI " * 60000, b"(" * 120000, b"[" * 120000, b"[" * 60000 + b"]" * 60000, b"<<" * 60000, b"(a) Tj " * 60000, b"(abc Tj " * 30000])
def test_pdf_hostile_content_is_linear(content):
    began = time.time()
    read_pdf(pdf(content))
    assert time.time() - began < 1.5


def test_pdf_hostile_files_are_linear():
    began = time.time()
    read_pdf(b"%PDF-1.4\n" + b"".join(b"%d 0 obj [" % i for i in range(30000)) + b"endobj")
    character_map(b"beginbfrange <00> " * 20000)
    kids = b" ".join(b"%d 0 R" % i for i in range(300000))
    read_pdf(pdf(shown(b"x")).replace(b"/Kids [10 0 R]", b"/Kids [" + kids + b"]"))
    assert time.time() - began < 4


def test_pdf_inflation_is_bounded():
    began = time.time()
    got = read_pdf(pdf((zlib.compress(b"A" * (64 << 20)), b"/Filter /FlateDecode"), shown(b"x")))
    assert got["unread"] == [(1, "content this reader cannot decode")] and time.time() - began < 2.5


def test_pdf_table(spark):
    made = write_pdfs(spark.createDataFrame([("a", "some words here"), ("b", "word " * 2000)], "name string, text string"))
    files = made.select("name", "bytes").unionByName(spark.createDataFrame([("n", None)], "name string, bytes binary"))
    got = {r.name: r for r in read_pdfs(files).collect()}
    assert got["a"].text == "some words here" and len(got["b"].pages) > 1 and got["b"].text.split() == ["word"] * 2000
    assert got["n"].why == "this is not a PDF"


def test_without_llm():
    """Nothing outside the subpackage imports it."""
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "lectern"
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] != "llm":
            assert "lectern.llm" not in path.read_text(), path
