"""Each operator against a brute-force version on a small fixture, with nulls, empties, repeats, long texts and extra columns."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import forms, near_duplicates, spam, terms
from lectern.llm.distinctive import concentrated, least_weight, log_entropy
from lectern.llm.leaks import PositionalIndex
from lectern.llm.mixing import mix
from lectern.llm.near_duplicates import NearDuplicates, Sketching
from lectern.llm.queries import TRIPLES
from lectern.llm.spam import score_pages
from lectern.llm.splitting import LEVELS, hierarchy, spans, split_oversized
from lectern.llm.term_counts import TermCounts
from lectern.llm.unify import same_form_pairs, unify_text

CHUNK = "chunk_id bigint, document string, heading string, text string, form string, term string, key string"


def chunks(spark, rows):
    """Chunks with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, d, h, t, "x", "y", "z") for i, d, h, t in rows], CHUNK)


def one_form(t):
    """The one form of the characters the fixtures use, by the Unicode tables of Python."""
    out = []
    for c in t:
        if c in "­​‌‍⁠﻿":
            continue
        if unicodedata.category(c) == "Zs" or c == "\t":
            c = " "
        elif 0xFF01 <= ord(c) <= 0xFF5E:
            c = chr(ord(c) - 0xFEE0)
        out.append({"ﬁ": "fi", "ﬂ": "fl", "‑": "-", "‐": "-", "µ": "μ"}.get(c, c))
    d = unicodedata.normalize("NFD", "".join(out))
    return unicodedata.normalize("NFC", "".join(forms.LOOKALIKES.get(c, c) for c in d))


def words(t):
    return [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x) for x in one_form(t).lower().split()) if w]


DIRTY = ["plain text", "ｆｕｌｌ　ｗｉｄｔｈ", "zero​width­", "non breaking", "été", "été", "аѕ Τhe", "ﬁne ﬂoat", "10 kΩ", "10 kΩ", "mm² stays", "a‑b", "", " ", None, "tab\there\r\nline", "x" * 50000 + "​"]


def test_one_form(spark):
    df = spark.createDataFrame([(t,) for t in DIRTY], "t string")
    got = forms.with_form(df, "t", "f").collect()
    assert [r.f for r in got] == [None if t is None else one_form(t) for t in DIRTY]


def test_other_alphabets_stay(spark):
    texts = ["Это русский текст о машине", "слово Τhe слово", "Ελληνικά"]
    got = [r.f for r in forms.with_form(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "f").collect()]
    assert got == ["Это русский текст о машине", "слово The слово", "Ελληνικά"]


def test_unify_asks_the_vocabulary(spark):
    # In a text with Russian words a mixed token is only repaired if the collection knows the result.
    rows = [(1, "the machine is fine"), (2, "это mаchine и хqzw"), (3, "mаchine"), (4, "qzwхy"), (5, None), (6, "")]
    u = unify_text(spark.createDataFrame(rows, "id bigint, text string"), "text")
    assert {r.id: r.form for r in u.rows.collect()} == {1: "the machine is fine", 2: "это machine и хqzw", 3: "machine", 4: "qzwxy", 5: None, 6: ""}
    decided = {(r.token, r.decision) for r in u.tokens.collect()}
    assert {("mаchine", "vocabulary"), ("хqzw", "kept"), ("qzwхy", "script")} <= decided


def test_unify_leaves_words_of_other_alphabets(spark):
    # Words of look-alikes alone are repaired only where the collection has the result; codes by the exit.
    rows = [(1, "Sugar is Сахар here"), (2, "the СОАТ is red"), (3, "a red coat"), (4, "хор сор"), (5, "see Е-4412 now")]
    u = unify_text(spark.createDataFrame(rows, "id bigint, text string"), "text")
    assert {r.id: r.form for r in u.rows.collect()} == {1: "Sugar is Сахар here", 2: "the COAT is red", 3: "a red coat", 4: "хор сор", 5: "see E-4412 now"}
    assert {(r.token, r.decision) for r in u.tokens.collect()} == {("Сахар", "kept"), ("СОАТ", "vocabulary"), ("хор", "kept"), ("сор", "kept"), ("Е-4412", "code")}
    nothing = spark.createDataFrame([], "token string")
    assert {r.id: r.form for r in unify_text(spark.createDataFrame(rows, "id bigint, text string"), "text", vocabulary=nothing).rows.collect()}[2] == "the СОАТ is red"
    same = spark.createDataFrame([(1, "red COAT"), (2, "red СОАТ"), (3, "coat")], "id bigint, text string")
    assert [tuple(r) for r in same_form_pairs(same, "id", "text").collect()] == [(1, 2)] and same_form_pairs(same, "id", "text", vocabulary=nothing).isEmpty()


def test_unify_takes_words_from_every_row(spark):
    """A word is known although it only stands in texts with other characters to fold: signs, blanks, widths, accents, look-alikes."""
    holders = ["a coat – red", "a\u00a0coat", "a\tcoat", "ａ ｃｏａｔ", "a co\u200bat", "a coat of 10 kΩ", "a coat, сomplete", "a coat, это"]
    for holder in holders:
        df = spark.createDataFrame([(1, holder), (2, "the СОАТ – red")], "id bigint, text string")
        assert {r.id: r.form for r in unify_text(df, "text").rows.collect()}[2] == "the COAT – red", holder
    pairs = spark.createDataFrame([(2, "the СОАТ – red"), (3, "the COAT – red")], "id bigint, text string")
    assert [tuple(r) for r in same_form_pairs(pairs, "id", "text").collect()] == [(2, 3)]
    # A word with an accent is known in its composed form, once, however it was typed.
    rows = [(1, "CAFE\u0301 – noir"), (2, "CAFÉ noir"), (3, "le САFÉ"), (4, "А\u0301 CAFÉ"), (5, "le Е\u0301Е"), (6, "ÉE – oui")]
    u = unify_text(spark.createDataFrame(rows, "id bigint, text string"), "text")
    got = {r.id: r.form for r in u.rows.collect()}
    assert len(got) == u.rows.count() == 6 and got[3] == "le CAFÉ" and got[5] == "le ÉE"
    # Tokens that hold look-alikes themselves are no witnesses.
    alone = spark.createDataFrame([(1, "red СОАТ – x"), (2, "the СОАТ")], "id bigint, text string")
    assert {r.decision for r in unify_text(alone, "text").tokens.collect()} == {"kept"}


def test_unify_keeps_every_row(spark):
    # Styled Greek letters are folded to Greek ones; every character that is must be seen in the text as it was typed.
    styled = [c for c, plain in forms.SIGNS.items() if re.search("[\u0370-\u03ff]", plain)]
    rows = [(i, f"{c} = \U0001d708") for i, c in enumerate(styled)] + [(9000, "\U0001d6fc = \U0001d708"), (9000, "\U0001d6fc = \U0001d708"), (9001, "\U0001d6fc"), (9002, "\u213d and \U0001d7b6"), (9003, None), (9004, "plain")]
    u = unify_text(spark.createDataFrame(rows, "id bigint, text string"), "text")
    got = [(r.id, r.form) for r in u.rows.collect()]
    assert sorted(i for i, _ in got) == sorted(i for i, _ in rows) and (9000, "α = ν") in got
    assert ("ν", "kept") in {(r.token, r.decision) for r in u.tokens.collect()}


def test_same_form_pairs(spark):
    rows = [(i, t) for i, t in enumerate(DIRTY)] + [(50, "plain text"), (51, "plain text"), (51, "plain text"), (52, "рlain text"), (None, "plain text​"), (53, "Plain text")]
    df = spark.createDataFrame(rows, "k bigint, t string").withColumn("form", F.lit(1))
    true = {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations({r for r in rows if r[0] is not None and r[1] and r[1].strip()}, 2) if a != b and x != y and one_form(x) == one_form(y)}
    got = [tuple(r) for r in same_form_pairs(df, "k", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == true and true


def sentence(rng):
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randrange(9)) for _ in range(40))


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        base = sentence(rng).split()
        rows.append((i, " ".join(base)))
        for j in range(rng.randrange(4)):
            edited = base[:]
            for _ in range(rng.randrange(6)):
                edited[rng.randrange(len(edited))] = "new"
            rows.append((1000 + 10 * i + j, " ".join(edited)))
    rows += [(9001, rows[0][1]), (9002, rows[0][1]), (9002, rows[0][1]), (9003, "two words"), (9004, "two words"), (9005, None), (9006, ""), (None, "x y z"), (9007, "long " * 30000)]
    return rows, NearDuplicates(chunks(spark, [(i, None, None, t) for i, t in rows]), how=Sketching(shingle=3, threshold=0.5))


def test_near_duplicates(near):
    rows, op = near
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows if i is not None and t is not None for w in [words(t)]}
    true = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    got = [tuple(r) for r in op.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) <= true
    assert len(set(got)) >= 0.97 * len(true) > 20


def test_near_duplicate_groups(near):
    rows, op = near
    groups = {r.key: r for r in op.groups().collect()}
    assert len(groups) == len({i for i, t in rows if i is not None and t is not None})
    assert groups[9002]["class"] == groups[0]["class"] == 0 and groups[0].copies == 3
    assert groups[9003].links == 0 and groups[9003].copies == 2


def test_near_duplicates_just_over_the_threshold(spark):
    # Pairs without a third similar text: 60 triples each, of which 40 to 42 are shared, so J is 0.50, 0.52 or 0.54.
    rows = []
    for i in range(400):
        shared = [f"s{i}x{k}" for k in range(42 + i % 3)]
        rows += [(2 * i + j, " ".join([*shared, *(f"{'ab'[j]}{i}x{k}" for k in range(62 - len(shared)))])) for j in (0, 1)]
    op = NearDuplicates(spark.createDataFrame(rows, "chunk_id bigint, text string"), how=TRIPLES)
    got = {tuple(r) for r in op.pairs().collect()}
    assert got <= {(2 * i, 2 * i + 1) for i in range(400)} and len(got) >= 388


def test_near_duplicates_in_large_buckets(spark, near, monkeypatch):
    # Every bucket of more than two texts is compared sketch by sketch, in blocks of three: the links must be the same.
    monkeypatch.setattr(near_duplicates, "BLOCK", 3)
    rows, op = near
    blocks = NearDuplicates(chunks(spark, [(i, None, None, t) for i, t in rows]), how=Sketching(shingle=3, threshold=0.5, large=2))
    assert {tuple(r) for r in blocks.links.collect()} == {tuple(r) for r in op.links.collect()}


def test_packed_keys():
    keys = np.sort(np.random.default_rng(3).integers(0, 2**22, 500, dtype=np.uint64))
    for width in (2, 4, 8):
        assert (near_duplicates.unpacked(near_duplicates.packed(keys, width)) == keys).all()


def test_keys_ascend_with_their_tags():
    rng = np.random.default_rng(5)
    for bits in (12, 40, 62):  # the last do not fit one number with their tags
        keys, tags = rng.integers(0, 2**bits, 3000, dtype=np.uint64), rng.integers(0, 2**16, 3000).astype("<u2")
        got = near_duplicates.ascending(keys, tags, 16)
        assert got[1].dtype == tags.dtype and list(zip(*(x.tolist() for x in got))) == sorted(zip(keys.tolist(), tags.tolist()))
    assert [len(x) for x in near_duplicates.ascending(keys[:0], tags[:0], 16)] == [0, 0]


def test_near_duplicates_do_no_work_twice(spark, near):
    # Members are read as written, not grouped again by each use, and shingles are hashed where they stand, not cut out.
    _, op = near
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Join|Aggregate", plan(op.members))
    df = spark.createDataFrame([("a b c d a b c",), ("a b c",), ("a b",), ("",)], "t string").select(F.split("t", " ").alias("w"))
    runs = df.select("w", near_duplicates.shingles("w", 3).alias("s"))
    assert "slice(" not in plan(runs)
    hashed = [F.xxhash64(F.slice("w", i, 3)) for i in range(1, 5)]
    for r in runs.select("w", "s", F.array(*hashed).alias("h")).collect():
        assert r.s == r.h[: min(4, max(0, len(r.w) - 2))]


def test_words_are_what_stands_between(spark):
    rng = random.Random(6)
    signs = ["a", "Bc", "é", "İ", "中", "😀", "𝒜", "1", "²", " ", " ", "\n", "\t", "\x0b", "\x85", "\u2028", "\xa0", ".", ",", "-", "_", "'", "\u0301", "("]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(2000)] + ["", " ", "a" + "." * 100000, "a." * 50000, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(terms.words(F.col("t")).alias("x"), F.filter(terms.split_words(F.col("t")), lambda w: w != "").alias("y"))
    assert "split(" not in both.select("x")._jdf.queryExecution().executedPlan().toString()
    assert both.where("not (x <=> y)").count() == 0


def test_odd_sketch_decides():
    # Pairs just over the threshold stay under the limit; pairs of little similarity, which bands let through, do not.
    how, rng = Sketching(shingle=3, threshold=0.5, samples=384, bits=1024), np.random.default_rng(4)
    apart = {}
    for shared in (0.1, 0.2, 0.5, 0.9):
        for _ in range(60):
            same = rng.integers(0, 2**63, int(200 * shared), dtype=np.uint64)
            a, b = (np.concatenate([same, rng.integers(0, 2**63, (200 - len(same)) // 2, dtype=np.uint64)]) for _ in range(2))
            _, odd = near_duplicates.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]), how)
            apart.setdefault(shared, []).append(int(np.bitwise_count(odd[0] ^ odd[1]).sum()))
    assert max(apart[0.5] + apart[0.9]) <= how.most_odd and np.mean(np.array(apart[0.1]) > how.most_odd) > 0.95 and np.mean(np.array(apart[0.2]) > how.most_odd) > 0.9


def term_table(rows):
    return {(i, t): [w for w in words(t) if len(w) >= 3] for i, t in rows if i is not None and t is not None}


TEXTS = [(1, "a", "Alpha beta, beta gamma. it"), (1, "a", "Alpha beta, beta gamma. it"), (2, "a", "alpha (delta) alpha"), (3, "b", "alpha epsilon"), (4, None, "gamma gamma"), (5, "b", ""), (6, "b", None), (None, "b", "nothing"), (7, "b", "ｅpsilon​ — alpha"), (8, "c", "word " * 20000)]


def test_term_counts_by_changes(spark):
    df = chunks(spark, [(i, d, None, t) for i, d, t in TEXTS])
    counts = TermCounts(spark, buckets=3).apply(added=df.where("chunk_id < 3")).apply(added=df.where("chunk_id >= 3"))
    whole = {r.term: (r.occurrences, r.records) for r in counts.counts().collect()}
    table = term_table([(i, t) for i, _, t in TEXTS])
    every = {w for t in table.values() for w in t}
    assert whole == {w: (sum(t.count(w) for t in table.values()), sum(w in t for t in table.values())) for w in every}
    assert counts.total() == len(table)
    # Record 1 goes, record 3 changes: the state must be that of a recount.
    counts.apply(added=chunks(spark, [(3, "b", None, "zeta alpha")]), deleted=df.where("chunk_id in (1, 3)"))
    after = {k: v for k, v in table.items() if k[0] not in (1, 3)} | {(3, "zeta alpha"): ["zeta", "alpha"]}
    every = {w for t in after.values() for w in t}
    assert {r.term: (r.occurrences, r.records) for r in counts.counts().collect()} == {w: (sum(t.count(w) for t in after.values()), sum(w in t for t in after.values())) for w in every}
    assert {r.term: r.mark for r in counts.marked(2, 5).collect()}["alpha"] == "common"
    # Another handle on the same folder sees the last version.
    assert TermCounts(spark, counts.place).total() == len(after)


def test_term_counts_touch_few_buckets(spark):
    import os

    words = [f"word{i}" for i in range(3000)]
    counts = TermCounts(spark, buckets=64).apply(added=chunks(spark, [(i, None, None, " ".join(words[i::30])) for i in range(30)]), batch="a")
    before = {tuple(r) for r in counts.counts().collect()}
    counts.apply(added=chunks(spark, [(99, None, None, "word1 other")]), batch="b")
    place = counts.place.removeprefix("file://")
    assert len([b for b in os.listdir(f"{place}/v2") if b.startswith("bucket=")]) <= 3  # two terms and the number of records
    same = counts.apply(added=chunks(spark, [(99, None, None, "word1 other")]), batch="b")
    assert same.state["version"] == 2 and {tuple(r) for r in counts.counts().collect()} == before - {("word1", 1, 1)} | {("word1", 2, 2), ("other", 1, 1)}
    counts.apply(deleted=chunks(spark, [(99, None, None, "word1 other")]), batch="c")
    assert {tuple(r) for r in counts.counts().collect()} == before and counts.total() == 30
    for i in range(3):
        counts.apply(added=chunks(spark, [(200 + i, None, None, "word1")]))
    assert len([v for v in os.listdir(place) if v.startswith(("v", "delta"))]) <= 5  # replaced versions are removed
    counts.apply(deleted=chunks(spark, [(i, None, None, " ".join(words[i::30])) for i in range(30)]), batch="d")
    assert {tuple(r) for r in counts.counts().collect()} == {("word1", 3, 3)} and counts.total() == 3


def test_log_entropy(spark):
    import math

    df = chunks(spark, [(i, d, None, t) for i, d, t in TEXTS])
    got = {(r.document, r.term): r for r in log_entropy(df).collect()}
    table = {(i, d, t): [w for w in words(t) if len(w) >= 3] for i, d, t in TEXTS if i is not None and t is not None}
    owners = {d for _, d, _ in table if d is not None}
    true = {}
    for d in owners:
        for w in {w for (_, o, _), t in table.items() if o == d for w in t}:
            f = {o: sum(t.count(w) for (_, x, _), t in table.items() if x == o) for o in owners}
            total = sum(f.values())
            entropy = -sum(v / total * math.log(v / total) for v in f.values() if v) / math.log(len(owners))
            true[d, w] = math.log(1 + f[d]) * (1 - entropy), sum(w in t for t in table.values())
    assert set(got) == set(true)
    for k, (weight, records) in true.items():
        assert got[k].weight == pytest.approx(weight) and got[k].all_records == records


def test_concentrated(spark):
    # Against the plain definition, with owners of all sizes; the weights decide and lose no true row.
    import math

    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), None, " ".join({f"t{int(rng.paretovariate(0.4))}" for _ in range(8)} | {f"own{i % 5}"})) for i in range(400)]
    table = {(i, d, t): {w for w in t.split() if len(w) >= 3} for i, d, _, t in rows}
    true = set()
    for w in {w for t in table.values() for w in t}:
        every = [d for (_, d, _), t in table.items() if w in t]
        true |= {(d, w) for d in set(every) - {None} if every.count(d) >= 4 and every.count(d) >= 0.8 * len(every)}
    rows += [(1000 + i, "e", None, f"only{i % 3} rest") for i in range(12)]
    true |= {("e", f"only{i}") for i in range(3)} | {("e", "rest")}
    got = concentrated(chunks(spark, rows))
    assert {(r.document, r.term) for r in got.collect()} == true and len(true) > 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "ln(" in plan and "log1p(" in plan.lower()
    bound = spark.range(1).select(least_weight(4, 80, F.lit(5)).alias("x")).first().x
    light = log_entropy(chunks(spark, rows), min_records=4, by="records").where(F.col("weight") < bound)
    assert not light.isEmpty() and bound == pytest.approx(math.log(5) * (1 - (-0.8 * math.log(0.8) - 0.2 * math.log(0.2) + 0.2 * math.log(4)) / math.log(5)))


def test_spans_round_trip():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["word", "a", ". ", "\n", "\n\n", " ", "x" * rng.randrange(300), "\n\n## Head\n", "! "]) for _ in range(rng.randrange(120)))
        room, overlap = rng.choice([(900, 180), (300, 60), (120, 30)])
        pieces = spans(text, room, overlap)
        assert all(b - a <= room for a, b, _ in pieces)
        end = 0
        for a, b, _ in pieces:
            assert not text[end:a].strip() and b >= end
            end = max(end, b)
        assert not text[end:].strip()
        for (a, b, _), (c, d, _) in itertools.pairwise(pieces):
            assert b - c == overlap and a < c and d > b
        assert hierarchy(text, room)[1] == next((level for level in ("paragraph", "sentence", "word") if all(len(p.strip()) <= room for p in LEVELS[level].split(text))), "none")


def test_split_oversized(spark):
    long_word, long_text = "x" * 2000, "One sentence here. " * 100
    rows = [(1, "d", "Head", long_text), (1, "d", "Head", long_text), (2, "d", None, long_word), (3, "d", " ", "short"), (4, None, None, None), (5, "d", "H" * 880, "y" * 30), (6, "d", None, ""), (7, "d", "Head", "para one. " * 40 + "\n\n" + "para two. " * 60)]
    got = split_oversized(chunks(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_id, []).append(r)
    assert set(by) == {1, 2, 5, 7}
    assert by[1][0].boundary == "sentence" and by[2][0].boundary == "none" and by[7][0].boundary == "paragraph"
    assert all(len(r.text) <= 900 for r in got)
    assert all(r.text.startswith("Head\n") for r in by[1]) and len(by[1]) == len({r.piece for r in by[1]})
    assert by[1][0].text.endswith(".")


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 30)))) for i in range(15)]
    docs = []
    for i in range(60):
        body = [rng.choice(vocabulary) for _ in range(40)]
        if i % 3 == 0:
            w = rng.choice(items)[1].split()
            a = rng.randrange(max(1, len(w) - 9))
            body[7:7] = [x.upper() for x in w[a : a + rng.randrange(8, 25)]]
        docs.append((i, ", ".join(body)))
    docs += [(99, None), (98, ""), (97, docs[0][1]), (97, docs[0][1])]
    index = PositionalIndex(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit(1)))
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in index.phrases(asked).collect()}
    runs = lambda w: {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    true = {(d, i) for d, t in docs if t for i, x in items if runs(tokens(t)) & runs(tokens(x))}
    assert got == true and true
    assert {(d, i) for d, i in true} <= {(r.doc_id, r.item_id) for r in index.near(asked).collect()}
    # The same index serves other items, and says where every maximal run lies.
    other = spark.createDataFrame([("x", "w1 " + " ".join(docs[1][1].upper().split(", ")[5:20]))], "item_id string, text string")
    assert (1, "x", 5, 1, 15) in {tuple(r) for r in index.phrases(other).collect()}


def test_near_holds_every_exact_passage(spark):
    # Ten words from anywhere in a long item: most of them stand before the two rarest words of their window.
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    often = [1 / (i + 1) for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, often, k=60))) for i in range(20)]
    docs = [(1000 * i + a, " ".join(["before", "it", *x.split()[a : a + 10], "after", "it"])) for i, x in items for a in range(51)]
    docs += [(100_000 + i, " ".join(rng.choices(vocabulary, often, k=80))) for i in range(100)]
    index, asked = PositionalIndex(spark.createDataFrame(docs, "doc_id bigint, text string")), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.words for r in index.near(asked).collect()}
    assert [d for d, _ in docs if d < 100_000 and got.get((d, d // 1000)) != 10] == []


def test_near_without_the_rarest_words(spark):
    # Every word and every two words of a passage changed in turn, its name and number, which no other text has, too.
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    item = [*rng.sample(vocabulary, 12), "zebrano", "4711", *rng.sample(vocabulary, 12)]
    changes = [(a, c) for a in (6, 8, 11) for n in (1, 2, 3) for c in itertools.combinations(range(10), n)]
    docs = [(k, " ".join(["x1", "x2", *("changed" if j in c else w for j, w in enumerate(item[a : a + 10])), "x3"])) for k, (a, c) in enumerate(changes)]
    items = [(1, " ".join(item)), (2, "unknown " + " ".join(item[:9])), (3, "un known words " + " ".join(item[:7]))]
    docs.append((5000, " ".join(item[:9])))
    index, asked = PositionalIndex(spark.createDataFrame(docs, "doc_id bigint, text string")), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.words for r in index.near(asked).collect()}
    assert {k: got.get((k, 1)) for k in range(len(changes))} == {k: 10 - len(c) if len(c) < 3 else None for k, (_, c) in enumerate(changes)}
    assert got[5000, 2] == 9 and (5000, 3) not in got


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, f"{'abc'[i % 3]} text {i} " * rng.randrange(1, 30), ["A-one", "a_one ", "b"][i % 3]) for i in range(600)]
    docs += [(1000 + i, "copied text", "b") for i in range(50)] + [(2000, None, "b"), (2001, "", "b"), (2002, "no source", None), (0, docs[0][1], docs[0][2])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("key", F.lit("x"))
    targets = spark.createDataFrame([("a_one", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    got = mix(df, targets, count=lambda c: F.size(F.split(c, " ")).cast("bigint"))
    shares = {r.source: r for r in got.shares.collect()}
    assert shares["none"].tokens == 0 and shares["a_one"].share == pytest.approx(5 / 9, abs=0.02) and shares["b"].share == pytest.approx(4 / 9, abs=0.02)
    chosen = got.chosen.collect()
    assert len({r.doc_id for r in chosen}) == len(chosen) and all(1 <= r.copies <= {"a_one": 1, "b": 3}[r.source] for r in chosen)
    assert max(shares["a_one"].tokens / shares["a_one"].has_tokens, shares["b"].tokens / (3 * shares["b"].has_tokens)) > 0.97
    again = mix(df, targets, count=lambda c: F.size(F.split(c, " ")).cast("bigint")).chosen.collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in chosen}


def test_spam(spark, monkeypatch):
    rng = random.Random(4)
    parts = "valve hopper belt roller nozzle tray shroud gasket".split()
    frames = [
        "Check that the {} is dry before you open the {}.", "It takes a fitter {} minutes to clean the {} by hand.", "When the {} makes a noise, the cause lies near the {}.",
        "A worn {} is the usual reason why the unit stops after {} hours.", "Do not use oil on the {}, because it turns sticky and the {} slows down.", "Our trials ran for {} days and only the {} became loose.",
        "First lift the {}, then let the {} cool for a while.", "Leave the {} open so that air can pass to the {}.", "On older machines the {} is found below the {}.", "Readings over {} bar mean that the {} is blocked.",
    ]
    fill = lambda f: f.format(rng.choice(parts), rng.choice(parts))
    prose = lambda: " ".join(fill(f) for f in rng.sample(frames, 8))
    rows = [(i, prose()) for i in range(200)]
    rows += [(900 + i, "\n".join(f"buy {rng.choice(parts)} pump" for _ in range(60))) for i in range(3)]
    rows += [(910, " ".join(f"#{rng.choice(parts)}_{i}" for i in range(40))), (911, "\n".join(f"https://shop.test/{p}/1" for p in parts * 4)), (912, " | ".join(p.title() for p in parts * 8))]
    rows += [(920, None), (921, ""), (922, prose() + "\n\nSee https://docs.test/1"), (923, "\n".join(f"| PE-{i} | {rng.choice(parts)}, dry to the touch | {i}.2 kg |" for i in range(30)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1))
    got = {r.doc_id: r.spam for r in score_pages(df).collect()}
    assert {i for i, s in got.items() if s} == {900, 901, 902, 910, 911, 912} and 920 not in got and got[921] is False
    # Perplexity alone decides: under a flat model, where every class is as likely, no page is spam.
    monkeypatch.setattr(spam, "surprise_of", lambda keys, counts: np.full((spam.LONGEST + 1) * spam.CLASSES**3, 5, np.float32))
    assert score_pages(df).where("spam").isEmpty()


def test_spam_counts_first_mentions(spark):
    """A short page of keywords is spam from its first word on, though its phrases are no repetitions yet."""
    rng = random.Random(5)
    small, word = "the of a in for with and not pas to".split(), lambda: "".join(rng.choice("ba re ko li nu ta se mo di fa pe ro".split()) for _ in range(3))
    plain = lambda: " ".join([rng.choice(small), *(word() for _ in range(rng.choice([1, 1, 1, 1, 12])))])
    mixed = lambda: rng.choice([rng.choice(small), word(), word().title(), str(rng.randint(1, 99)), ", " + word(), "(" + word(), ": " + word()])
    prose = lambda part, parts, n: " ".join(" ".join(part() for _ in range(parts)) + "." for _ in range(n))
    rows = [(i, prose(plain, 6, 4) if i % 2 else prose(mixed, 22, 3)) for i in range(300)]
    offers, goods = ["pas cher", "acquista", "kaufen", "sconto"], ["duskley bench pump", "duskley coffee grinder"]
    rows += [(900 + i, " ".join(f"{rng.choice(offers)} {rng.choice(goods)}" for _ in range(13))) for i in range(40)]
    got = score_pages(spark.createDataFrame(rows, "doc_id bigint, text string")).where("spam").collect()
    assert {r.doc_id for r in got} == {900 + i for i in range(40)}


def test_spam_marks_first_mentions():
    text = "buy red pump now buy red pump then buy red pump"
    seq, _ = spam.classes([text, "buy red pump"], ahead=True)
    low, again, ahead, fun = spam.LOWER, spam.LOWER_AGAIN, spam.LOWER + spam.AHEAD, spam.FUNCTION
    assert seq.tolist() == [low, ahead, ahead, low, low, ahead, ahead, fun, low, again, again, low, low, low]
    far, _ = spam.classes([text], memory=6, ahead=True)
    assert spam.AHEAD not in (far & spam.AHEAD) and (far == spam.classes([text], memory=6)[0]).all()
    plain, _ = spam.classes([text, "buy red pump"])
    assert ((seq & (spam.AHEAD - 1)) == plain).all()


def test_spam_classes():
    text = "The drive belt, the drive belt and the Drive belt!\n\nSee https://shop.test/p/1 #lock_nut E-42 7.5 kg\n> ABC"
    seq, counts = spam.classes(["", text, "x"])
    assert counts.tolist() == [0, len(seq) - 1, 1]
    comma, full = spam.FIRST_SIGN + spam.SIGNS.index(","), spam.FIRST_SIGN + spam.SIGNS.index("!")
    fun, low, cap = spam.FUNCTION, spam.LOWER, spam.CAPITAL
    assert seq[:-1].tolist() == [fun, low, low, comma, fun, low, low, fun, fun, cap, spam.LOWER_AGAIN, full, spam.PARAGRAPH, cap, spam.LINK, spam.TAG, spam.CODE, spam.NUMBER, low, low]


def test_empty_tables(spark):
    none = chunks(spark, [])
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id bigint, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert same_form_pairs(none, "chunk_id", "text").isEmpty() and NearDuplicates(none).pairs().isEmpty() and NearDuplicates(none).groups().isEmpty()
    assert log_entropy(none).isEmpty() and split_oversized(none).isEmpty() and TermCounts(spark).apply(added=none).counts().isEmpty()
    assert PositionalIndex(docs).phrases(items).isEmpty() and score_pages(docs).isEmpty()
    empty = mix(docs, targets, count=lambda c: F.length(c).cast("bigint"))
    assert empty.chosen.isEmpty() and empty.shares.first().tokens == 0
