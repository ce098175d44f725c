"""The core queries by name, over whole tables. Searches answer all requests; only ``letter_search`` and ``verdicts`` show those
whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.shared import built_once
from lectern.functions.text import meaningful_words, normalise, or_empty, page_words, words
from lectern.operators import chunking, evaluate, naming, questions, retrieve, vectors
from lectern.operators.corpus import clean_name, listing, unread_said
from lectern.plans.sql import SQL  # noqa: F401


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark, d) -> DataFrame:
    """Distinct chunks; documents are told apart by name, and come in the order of their names."""
    rows = table(spark, d, "chunk").where("chunk_id is not null and text is not null")
    return rows.select(or_empty(F.col("document")).alias("doc"), F.col("chunk_id").alias("chunk_ord"), "id", "document", "heading", "text").distinct()


def manuals(spark, d) -> DataFrame:
    rows = table(spark, d, "manual").where("name is not null and text is not null").groupBy(F.col("name").alias("doc")).agg(F.min("text").alias("text"))
    return rows.withColumn("title", chunking.title_of(F.col("text")))


def requests(spark, d) -> DataFrame:
    return table(spark, d, "request").where("request_id is not null").select(F.col("request_id").alias("qid"), or_empty(F.col("question")).alias("question"), "history").distinct()


def asked(spark, d) -> DataFrame:
    return requests(spark, d).where(F.trim("question") != "")


def shown_asked(spark, d) -> DataFrame:
    return asked(spark, d).where("qid % 50 = 0")


def index(spark, d) -> retrieve.Index:
    """The index of all chunks, built once for a state of the tables and read by all searches."""
    tables = table(spark, d, "chunk"), table(spark, d, "manual")
    return built_once("index", lambda: retrieve.build_index(chunks(spark, d), manuals(spark, d)), *tables)


def normalise_text(spark, d):
    return chunks(spark, d).select(F.col("chunk_ord").alias("chunk_id"), normalise(F.col("text")).alias("normalised"))


def token_counts(spark, d):
    rows = chunks(spark, d).select(normalise(F.col("text")).alias("n"))
    return rows.select(F.explode(words(F.col("n"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def meaningful_terms(spark, d):
    counts = vectors.term_counts(chunks(spark, d), "doc", "chunk_ord")
    return counts.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("chunks"))


def titles(spark, d):
    return manuals(spark, d).select(F.col("doc").alias("name"), "title")


def sections(spark, d):
    return chunking.sections(table(spark, d, "documents").where("text is not null"))


def windows(spark, d):
    """All pieces of all documents, with their ids."""
    docs = table(spark, d, "documents").where("text is not null").withColumn("name", F.col("doc_id").cast("string"))
    return chunking.cut_up(docs)


def idf(spark, d):
    return index(spark, d).vocab.select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_vectors(spark, d):
    return index(spark, d).postings.select(F.col("chunk_ord").alias("chunk_id"), "term", F.round("weight", 6).alias("weight"))


def _shown(hits):
    return hits.select("qid", F.col("chunk_ord").alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


def similarity_topk(spark, d):
    return _shown(retrieve.by_similarity(asked(spark, d), index(spark, d), most=retrieve.MOST_ASKED))


def dense_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    hits = retrieve.by_dense(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid"), e)
    return hits.select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


def question_kind(spark, d):
    kinds = questions.classify(requests(spark, d))
    return kinds.select("qid", "stands_alone", F.col("leaning.why").alias("lean_why"), F.col("literal.term").alias("literal"), F.array_join("terms", " | ").alias("terms"), F.array_join("meaningful", " ").alias("meaningful"))


def carry_subject(spark, d):
    return questions.carried(questions.classify(requests(spark, d))).select("qid", "asked")


def code_variants(spark, d):
    codes = requests(spark, d).select(F.explode(F.regexp_extract_all("question", F.lit(questions.LITERAL_SHAPES[0]), F.lit(0))).alias("code")).distinct()
    return codes.select("code", F.array_join(questions.variants_of(F.col("code")), " | ").alias("variants"))


def document_names(spark, d):
    return naming.document_names(manuals(spark, d), "doc").select(F.col("doc").alias("document"), "name", "name_ord")


def route_questions(spark, d):
    names = naming.document_names(manuals(spark, d), "doc")
    return naming.route(requests(spark, d), names, "qid", "question", "doc").select("qid", "document", "weight")


def letter_search(spark, d):
    kinds = questions.carried(questions.classify(shown_asked(spark, d)))
    ix = index(spark, d)
    return _shown(retrieve.by_the_letter(kinds, ix, most=retrieve.MOST_ASKED, routed=retrieve.routes(kinds, ix)))


def aware_search(spark, d):
    return _shown(retrieve.aware(asked(spark, d), index(spark, d), retrieve.MOST_ASKED)[0])


def verdicts(spark, d):
    """What the aware search decided about each question, in words."""
    return retrieve.aware(shown_asked(spark, d), index(spark, d), retrieve.MOST_ASKED)[1].select("qid", "asked", "document", "branch", "how")


def compare_searches(spark, d):
    ix, q = index(spark, d), asked(spark, d)
    both = retrieve.compare(retrieve.by_similarity(q, ix, most=retrieve.MOST_ASKED), retrieve.aware(q, ix, retrieve.MOST_ASKED)[0], q)
    return both.select("qid", F.col("plain.chunk_ord").alias("plain_id"), F.col("aware.chunk_ord").alias("aware_id"), "same")


def _outcomes(spark, d):
    gold = table(spark, d, "gold").distinct()
    ix, q = index(spark, d), gold.select("qid", F.col("ask").alias("question"), "history")
    plain = retrieve.by_similarity(q, ix, most=retrieve.MOST)
    return evaluate.outcomes(plain, retrieve.aware(q, ix, retrieve.MOST)[0], gold, ix)


def eval_by_kind(spark, d):
    return evaluate.by_kind(_outcomes(spark, d))


def eval_misses(spark, d):
    return evaluate.misses(_outcomes(spark, d)).select("qid", "kind", "plain", "aware_at_all")


def eval_disagreements(spark, d):
    return evaluate.disagreements(_outcomes(spark, d)).select("qid", "kind", "plain", "aware")


def eval_regressions(spark, d):
    return evaluate.regressions(_outcomes(spark, d)).select("qid", "plain", "aware")


def answers(spark, d):
    """What the aware search answers, with the reason for each passage."""
    ix = index(spark, d)
    return retrieve.as_answers(retrieve.aware(asked(spark, d), ix, retrieve.MOST_ASKED)[0], ix)


def ways_of_writing(spark, d):
    title = F.coalesce("title", F.lit(""))
    code = F.regexp_extract(title, naming.PART_NUMBER, 0)
    ways = questions.ways_of_writing(F.col("n"), questions.variants_of(F.col("code")))
    return manuals(spark, d).select("doc", normalise(title).alias("n"), code.alias("code")).select(F.col("doc").alias("document"), F.array_join(ways, " | ").alias("ways"))


def clean_names(spark, d):
    raw = F.concat(or_empty(F.col("source")), F.lit(" ("), or_empty(F.col("product")), F.lit(").v2.pdf"))
    return table(spark, d, "documents").select("doc_id", clean_name(raw).alias("name"))


def corpus_listing(spark, d):
    docs = manuals(spark, d).select(F.col("doc").alias("name"), "text", F.lit(True).alias("given"), F.array().cast("array<struct<page: int, why: string>>").alias("unread"))
    listed = listing(docs, index(spark, d), "name")
    return listed.select("name", "characters", "pieces", F.nullif(F.array_join("names", " | "), F.lit("")).alias("names"))


def unread_summary(spark, d):
    """Unread pages by reason, runs of three or more as ranges."""
    rows = table(spark, d, "manual").where("name is not null and size(unread) > 0").select("name", "unread").distinct()
    pages = rows.select("name", F.explode("unread").alias("u")).groupBy("name", F.col("u.why").alias("why")).agg(F.array_sort(F.collect_list("u.page")).alias("p"))
    said = F.regexp_replace(F.regexp_replace(page_words(F.col("p")), "^pages? ", ""), ", | and ", ",")
    return pages.select("name", "why", F.size("p").cast("bigint").alias("pages"), said.alias("runs"))


def pdf_round_trip(spark, d):
    """Texts put into PDFs and read again: chunk_id, same."""
    from lectern.sources.pdf import read_pdfs
    from lectern.sources.pdf_writer import write_pdfs

    made = write_pdfs(chunks(spark, d).select(F.col("chunk_ord").cast("string").alias("name"), normalise(F.col("text")).alias("text")).where("text <> ''"))
    read = read_pdfs(made.select("name", "bytes"))
    return made.select("name", "text").join(read.select("name", F.col("text").alias("back")), "name").select(F.col("name").cast("bigint").alias("chunk_id"), (F.regexp_replace("back", r"\s+", " ") == F.regexp_replace("text", r"[^\x20-\x7e]", "?")).alias("same"))


def pdf_manners(spark, d):
    """Texts put into PDFs in every manner and read again: what was read, and the first reason for what was not."""
    from lectern.sources.pdf import read_pdfs
    from lectern.sources.pdf_writer import write_pdfs_in_all_manners

    texts = chunks(spark, d).select(F.col("chunk_ord").cast("string").alias("name"), normalise(F.col("text")).alias("text")).where("text <> ''")
    made = write_pdfs_in_all_manners(texts).select(F.concat_ws(" ", "name", "manner").alias("name"), "bytes")
    read = read_pdfs(made)
    parts = F.split("name", " ")
    reason = F.when(F.size("unread") > 0, F.col("unread")[0]["why"]).when(F.col("text") == "", F.col("why")).otherwise("")
    return read.select(parts[0].cast("bigint").alias("chunk_id"), parts[1].alias("manner"), F.regexp_replace("text", r"\s+", " ").alias("text"), reason.alias("reason"))


QUERIES = {f.__name__: f for f in (
    normalise_text, token_counts, meaningful_terms, titles, sections, windows, idf, tfidf_vectors, similarity_topk, dense_topk, question_kind,
    carry_subject, code_variants, document_names, route_questions, letter_search, aware_search, verdicts, compare_searches, eval_by_kind, eval_misses,
    eval_disagreements, eval_regressions, answers, ways_of_writing,
    corpus_listing, unread_summary, pdf_round_trip, pdf_manners,
)} | {"clean_name": clean_names}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return aware_search(spark, d)
