"""Passages: chunking, vector and term scores, hybrid top-k search.

chunks: document_id, chunk_index, content, topic_ids, plus `terms` (stemmed
words, see `with_terms`) and `embedding` where a search needs them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from paperfold.functions.text import SNIPPET_CHARS, let_sql, tokens_sql
from paperfold.functions.vectors import cosine_sql
from paperfold.operators.scope import scope_by_topics
from paperfold.operators.text_index import KEY, TextIndex, inverse_frequency, scaled, term_part
from paperfold.operators.vector_index import VectorIndex, kth
from paperfold.session import as_table, let_go, shared_folder
from paperfold.sources.elements import html_blocks, per_document, text_elements_sql

VECTOR_WEIGHT = 0.6
TEXT_WEIGHT = 0.4
TOP_K = 8
MAX_CHUNK_CHARS = 500
# Questions that meet a bundle of the vector index together.
QUESTION_BLOCK = 4_096
# Scores are compared at this precision, so equal chunks tie on any hardware.
SCORE_DIGITS = 9

# English words that carry no content in a question.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in",
    "is", "it", "its", "of", "on", "or", "that", "the", "their", "this", "to", "was", "were",
    "what", "which", "will", "with",
)


def chunk_by_title(docs: DataFrame, text: str = "text", max_chars: int = MAX_CHUNK_CHARS) -> DataFrame:
    """(document_id, chunk_index, section, content, page_number, element_types).

    A title starts a section, no chunk spans two sections, and elements fill a
    chunk up to `max_chars`; a longer element is cut. A document is one cell, so
    all of it happens inside the row: no shuffle, and no group to gather.
    """
    pieces = (
        f"flatten(transform({text_elements_sql(text)}, e -> transform("
        f"sequence(0, CAST((length(e.text) - 1) DIV {max_chars} AS INT)), n -> named_struct("
        f"'opens', e.type = 'Title' AND n = 0, 'type', e.type,"
        f" 'text', substring(e.text, n * {max_chars} + 1, {max_chars})))))"
    )
    # Folds over the pieces, noting where each chunk starts and in which section.
    starts = (
        "aggregate(transform(ps, (p, i) -> named_struct('i', i, 'opens', p.opens, 'n', length(p.text))),"
        " named_struct('starts', CAST(array() AS ARRAY<STRUCT<at: INT, section: INT>>), 'size', 0, 'section', 0),"
        f" (acc, p) -> CASE WHEN p.i = 0 OR p.opens OR acc.size + 2 + p.n > {max_chars}"
        " THEN named_struct('starts', array_append(acc.starts, named_struct('at', p.i, 'section', acc.section + CAST(p.opens AS INT))),"
        " 'size', p.n, 'section', acc.section + CAST(p.opens AS INT))"
        " ELSE named_struct('starts', acc.starts, 'size', acc.size + 2 + p.n, 'section', acc.section) END, acc -> acc.starts)"
    )
    spans = (
        "transform(ss, (s, j) -> named_struct('section', s.section, 'pieces',"
        " slice(ps, s.at + 1, coalesce(get(ss, j + 1).at, size(ps)) - s.at)))"
    )
    chunked = let_sql("ps", pieces, let_sql("ss", starts, spans))
    return docs.select("document_id", F.expr(f"posexplode({chunked}) AS (chunk_index, c)")).select(
        "document_id",
        "chunk_index",
        F.col("c.section").alias("section"),
        F.expr("array_join(transform(c.pieces, p -> p.text), '\\n\\n')").alias("content"),
        F.lit(None).cast("int").alias("page_number"),
        F.expr("array_sort(array_distinct(transform(c.pieces, p -> p.type)))").alias("element_types"),
    )


def _packed(pieces: Iterable[tuple], max_chars: int) -> Iterator[tuple]:
    """Chunks (number, section, content, page, element types) of pieces (opens, type, text, page)."""
    number, section, size, held = 0, 0, 0, []

    def chunk():
        texts, types = [p[2] for p in held], sorted({p[1] for p in held})
        return number, section, "\n\n".join(texts), held[0][3], types

    for piece in pieces:
        opens, _, text, _ = piece
        if held and (opens or size + 2 + len(text) > max_chars):
            yield chunk()
            number, held = number + 1, []
        section += opens
        size = size + 2 + len(text) if held else len(text)
        held.append(piece)
    if held:
        yield chunk()


def chunk_html(docs: DataFrame, column: str = "html", max_chars: int = MAX_CHUNK_CHARS) -> DataFrame:
    """`chunk_by_title` for HTML documents, with the page a chunk begins on.

    Blocks are read and packed in one pass over a document: no shuffle. A table
    is chunked by its words.
    """

    def pieces(source: str | None) -> Iterator[tuple]:
        page = 1
        for kind, text, _ in html_blocks(source):
            if kind == "PageBreak":
                page += 1
            for start in range(0, len(text), max_chars):
                yield kind == "Title" and start == 0, kind, text[start : start + max_chars], page

    names = ["chunk_index", "section", "content", "page_number", "element_types"]
    types = ["int", "int", "string", "int", "array<string>"]
    return per_document(docs, column, lambda source: _packed(pieces(source), max_chars), names, types)


def stem_sql(w: str) -> str:
    """Plural endings removed (S-stemmer, Harman 1991)."""
    return (
        f"CASE WHEN {w} LIKE '%ies' AND NOT ({w} LIKE '%eies' OR {w} LIKE '%aies')"
        f" THEN concat(substring({w}, 1, length({w}) - 3), 'y')"
        f" WHEN {w} LIKE '%es' AND NOT ({w} LIKE '%aes' OR {w} LIKE '%ees' OR {w} LIKE '%oes')"
        f" THEN substring({w}, 1, length({w}) - 1)"
        f" WHEN {w} LIKE '%s' AND NOT ({w} LIKE '%us' OR {w} LIKE '%ss')"
        f" THEN substring({w}, 1, length({w}) - 1) ELSE {w} END"
    )


def terms_sql(text: str) -> str:
    # Every ending of a plural is an s.
    return f"transform({tokens_sql(text, STOP_WORDS)}, w -> if(endswith(w, 's'), {stem_sql('w')}, w))"


def with_terms(df: DataFrame, text: str = "content") -> DataFrame:
    """Adds `terms`. Worth persisting with the chunks: it depends on them only."""
    return df.withColumn("terms", F.expr(f"coalesce({terms_sql(text)}, array())"))


def vector_score(vector: list[float]) -> Column:
    literal = "array(" + ", ".join(f"{v!r}D" for v in vector) + ")"
    return F.expr(cosine_sql("embedding", literal))


def text_score(chunks: DataFrame, terms: list[str], output: str = "text_score") -> DataFrame:
    """BM25 (Robertson & Zaragoza 2009) of the question's terms, scaled to [0, 1).

    All terms must occur, as in a plain full-text query; a chunk without them
    scores 0 and stays in the result. Corpus figures come from one aggregated
    row, used as a scalar. This reads every chunk; `TextIndex` reads postings.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return chunks.withColumn(output, F.lit(0.0))
    holds = [F.array_contains("terms", t) for t in terms]
    figures = chunks.agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.avg(F.size("terms")).alias("length"),
            *[F.count_if(h).cast("double").alias(f"df{i}") for i, h in enumerate(holds)],
        ).alias("figures")
    )
    scored = chunks.withColumn("__f", figures.scalar())
    parts = []
    for i, term in enumerate(terms):
        tf = F.size("terms").cast("double") - F.size(F.array_remove("terms", term))
        idf = inverse_frequency(F.col("__f.n"), F.col(f"__f.df{i}"))
        parts.append(idf * term_part(tf, F.size("terms"), F.col("__f.length")))
    total, every = parts[0], holds[0]
    for part, held in zip(parts[1:], holds[1:], strict=True):
        total, every = total + part, every & held
    return scored.withColumn(output, F.when(every, scaled(total)).otherwise(0.0)).drop("__f")


def in_topics(chunks: DataFrame, topic_ids: list[str] | None) -> DataFrame:
    """No topic list means no scope; otherwise the lists must overlap."""
    return scope_by_topics(chunks, topic_ids) if topic_ids else chunks


def hybrid_score(vector: str = "vector_score", text: str = "text_score") -> Column:
    # A chunk without a vector (no words to embed) is judged by its text alone.
    return F.round(VECTOR_WEIGHT * F.coalesce(F.col(vector), F.lit(0.0)) + TEXT_WEIGHT * F.col(text), SCORE_DIGITS)


class PassageIndex:
    """Passages ready to be searched by words and by vectors, in one folder.

    `build` reads the passages once; searches read the index alone.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.text = TextIndex(spark, f"{folder}/text")
        self.vectors = VectorIndex(spark, f"{folder}/vectors")

    @classmethod
    def build(cls, chunks: DataFrame, folder: str) -> PassageIndex:
        """chunks: document_id, chunk_index, terms, embedding, topic_ids."""
        index = VectorIndex.build(chunks, f"{folder}/vectors", kept=("terms",))
        TextIndex.build(index.vectors(), f"{folder}/text")
        let_go(chunks.sparkSession)
        return cls(chunks.sparkSession, folder)

    def search(self, questions: DataFrame, k: int = TOP_K, matches: DataFrame | None = None) -> DataFrame:
        """The k best passages of every question, exactly. `matches`: what `matches_many`
        gives for the questions, where the caller has it.

        Two ranked lists are merged by bounds. Passages that hold all terms of a
        question come out of the postings and are scored in full. Any other passage
        has a text score of 0, so it is among the k best only if its cosine is among
        the k highest and reaches the k-th score of the first list: the vector index
        gives those, and no other pair is scored.
        """
        worded, others, asked = self._pairs(questions, k, matches)
        plain = self.vectors.scored(others, asked).withColumn("text_score", F.lit(0.0)).withColumn("score", hybrid_score())
        columns = ["question_id", *KEY, "vector_score", "text_score", "score"]
        order = W.partitionBy("question_id").orderBy(F.col("score").desc(), *KEY)
        every = worded.select(*columns).unionByName(plain.select(*columns))
        return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def scored_pairs(self, questions: DataFrame, k: int = TOP_K) -> DataFrame:
        """question_id, document_id, chunk_index of the pairs `search` scores by their vectors."""
        worded, others, _ = self._pairs(questions, k)
        return worded.select("question_id", *KEY).unionByName(others)

    def _pairs(self, questions: DataFrame, k: int, matches: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pairs that hold all terms, scored; other pairs that can be among the best; the questions."""
        asked = as_table(questions.select("question_id", "terms", "embedding", "topic_ids"), "questions")
        worded = as_table(self._worded(asked, matches), "matches")
        # Rounding may lift a score to the k-th by half a digit.
        floors = kth(worded, "score", k).select("question_id", ((F.col("kth") - 10.0**-SCORE_DIGITS) / VECTOR_WEIGHT).alias("floor"))
        near = self.vectors.candidates(asked, k, floors, QUESTION_BLOCK).select("question_id", *KEY)
        return worded, near.join(worded.select("question_id", *KEY), ["question_id", *KEY], "left_anti"), asked

    def _worded(self, asked: DataFrame, matches: DataFrame | None = None) -> DataFrame:
        """The pairs with all terms, in scope, scored in full."""
        matches = self.text.matches_many(asked) if matches is None else matches
        pairs = matches.join(self.text.passages().select(*KEY, "topic_ids"), KEY)
        scope = F.coalesce(F.col("scope"), F.array().cast("array<string>"))
        scoped = pairs.join(asked.select("question_id", F.col("topic_ids").alias("scope")), "question_id").filter(
            (F.size(scope) == 0) | F.arrays_overlap("topic_ids", scope)
        )
        return self.vectors.scored(scoped.drop("topic_ids", "scope"), asked).withColumn("score", hybrid_score())


def hybrid_search(
    chunks: DataFrame,
    documents: DataFrame,
    terms: list[str],
    vector: list[float],
    topic_ids: list[str] | None = None,
    k: int = TOP_K,
    index: PassageIndex | None = None,
) -> DataFrame:
    """The k best chunks for one question, with filename and page.

    Term figures cover all chunks, so a chunk scores the same under any scope.
    """
    spark = chunks.sparkSession
    question = spark.createDataFrame(
        [(0, list(terms), list(vector), list(topic_ids or []))], "question_id int, terms array<string>, embedding array<double>, topic_ids array<string>"
    )
    best = as_table(hybrid_search_many(chunks, question, k, index).drop("question_id", "rank"), "best")
    # At most k rows: chunks and documents of other ids are left where they lie.
    mine = F.col("document_id").isin([r.document_id for r in best.select("document_id").distinct().collect()])
    shown = best.join(chunks.drop("terms", "embedding").filter(mine), KEY)
    return shown.join(documents.select("document_id", "filename").filter(mine), "document_id")


def hybrid_search_many(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, index: PassageIndex | None = None) -> DataFrame:
    """The k best chunks for every question of a table, exactly.

    questions: question_id, terms, embedding, topic_ids (NULL or empty: no scope).
    Without an `index` the chunks are indexed for this one search.
    """
    ready = index or PassageIndex.build(chunks, shared_folder(chunks.sparkSession, "passage-index"))
    return ready.search(questions, k)


def relax(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, index: PassageIndex | None = None) -> DataFrame:
    """Search with a second, unscoped pass for auto-detected scopes that found nothing.

    questions also carry auto_detected; an explicit scope stays as it is.
    """
    ready = index or PassageIndex.build(chunks, shared_folder(chunks.sparkSession, "passage-index"))
    # Which passages hold a question's terms does not depend on its scope. Rows under one
    # id are one question there, so they are asked about anew if only some of them relax.
    alone = questions.count() == questions.select("question_id").distinct().count()
    matches = as_table(ready.text.matches_many(questions), "all-matches") if alone else None
    first = ready.search(questions, k, matches).withColumn("scoped", F.lit(True))
    scope = F.size(F.coalesce("topic_ids", F.array().cast("array<string>"))) > 0
    # A scope finds nothing exactly when no chunk carries any of its topics.
    reachable = (
        questions.filter(scope)
        .select("question_id", F.explode("topic_ids").alias("topic_id"))
        .join(ready.text.passages().select(F.explode("topic_ids").alias("topic_id")).distinct(), "topic_id", "left_semi")
        .select("question_id")
        .distinct()
    )
    missed = questions.filter(scope & F.col("auto_detected")).join(reachable, "question_id", "left_anti")
    again = ready.search(missed.withColumn("topic_ids", F.lit(None).cast("array<string>")), k, matches).withColumn("scoped", F.lit(False))
    return first.unionByName(again)


def source_cards(hits: DataFrame, snippet_chars: int = SNIPPET_CHARS) -> DataFrame:
    """snippet: the first characters; page_number: an int only if it is digits."""
    return hits.withColumns(
        {
            "snippet": F.substring("content", 1, snippet_chars),
            "page_number": F.when(F.col("page_number").rlike("^[0-9]+$"), F.col("page_number").try_cast("int")),
        }
    )


def context_block(hits: DataFrame) -> DataFrame:
    """Numbered sources per question, joined by a blank line (at most k each)."""
    line = F.concat(
        F.lit("[source "), F.col("rank").cast("string"), F.lit(" | document "), F.col("document_id").cast("string"),
        F.lit(" | chunk "), F.col("chunk_index").cast("string"), F.lit("]\n"), "content",
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("question_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["line"]), "\n\n").alias("context")
    )


def resync_chunk_topics(chunks: DataFrame, document_topics: DataFrame) -> DataFrame:
    """Chunks with topic_ids rewritten from the links; `changed` marks rewrites that differ.

    A document without links gets an empty array, never NULL.
    """
    links = document_topics.groupBy("document_id").agg(F.sort_array(F.collect_set("topic_id")).alias("__topics"))
    fresh = F.coalesce("__topics", F.array().cast("array<string>"))
    return (
        chunks.join(links, "document_id", "left")
        .withColumn("changed", ~F.array_sort("topic_ids").eqNullSafe(fresh))
        .withColumn("topic_ids", fresh)
        .drop("__topics")
    )


def ann_search(index: VectorIndex, questions: DataFrame, k: int = TOP_K, **settings) -> DataFrame:
    """Up to k near chunks per question, approximately: question_id, document_id,
    chunk_index, score, rank. settings: those of `VectorIndex.nearest`."""
    found = index.nearest(questions, k, **settings).withColumn("score", F.round("vector_score", SCORE_DIGITS)).drop("vector_score")
    order = W.partitionBy("question_id").orderBy(F.col("score").desc(), *KEY)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
