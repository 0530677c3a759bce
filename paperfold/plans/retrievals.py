"""Passages: chunking, scores, hybrid search and what is shown of it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from paperfold.functions import vectors
from paperfold.operators import retrieval
from paperfold.operators.vector_index import RERANK, VectorIndex
from paperfold.plans import fixtures as fx
from paperfold.plans.registry import Tables, query
from paperfold.plans.sources import _ELEMENTS
from paperfold.session import as_table, shared_folder, spread
from paperfold.sources.elements import text_elements_sql

MAX_CHARS = retrieval.MAX_CHUNK_CHARS


@query(
    "title_chunks",
    f"""WITH RECURSIVE {_ELEMENTS}, cut AS (SELECT document_id, seq, type, n, substr(text, n * {MAX_CHARS} + 1, {MAX_CHARS}) AS text
      FROM (SELECT *, unnest(range(0, (length(text) - 1) // {MAX_CHARS} + 1)) AS n FROM els) q),
    p AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY seq, n) AS i, type, text,
      type = 'Title' AND n = 0 AS opens FROM cut),
    pack AS (SELECT document_id, i, 0 AS chunk_index, CAST(opens AS INT) AS section, length(text) AS size FROM p WHERE i = 1
      UNION ALL SELECT p.document_id, p.i,
        CASE WHEN p.opens OR k.size + 2 + length(p.text) > {MAX_CHARS} THEN k.chunk_index + 1 ELSE k.chunk_index END,
        k.section + CAST(p.opens AS INT),
        CASE WHEN p.opens OR k.size + 2 + length(p.text) > {MAX_CHARS} THEN length(p.text) ELSE k.size + 2 + length(p.text) END
      FROM pack k JOIN p ON p.document_id = k.document_id AND p.i = k.i + 1)
    SELECT document_id, chunk_index, section, string_agg(text, chr(10) || chr(10) ORDER BY i) AS content,
      string_agg(DISTINCT type, ',' ORDER BY type) AS element_types
    FROM pack JOIN p USING (document_id, i) GROUP BY 1, 2, 3""",
)
def title_chunks(t):
    docs = t.documents.selectExpr("doc_id AS document_id", "text")
    return retrieval.chunk_by_title(docs).drop("page_number").withColumn("element_types", F.array_join("element_types", ","))


@query(
    "html_chunks",
    "SELECT doc_id AS document_id, CAST(n AS INT) AS chunk_index, CAST(n AS INT) + 1 AS page_number, 'part ' || n || ' of ' || doc_id || chr(10) || chr(10) || 'row ' || n AS content"
    " FROM documents, (SELECT unnest(range(0, 3)) AS n) q",
)
def html_chunks(t):
    page = "concat('<h2>part ', n, ' of ', doc_id, '</h2><table><tr><td>row<td>', n, '</table><hr>')"
    docs = t.documents.selectExpr("doc_id AS document_id", f"array_join(transform(sequence(0, 2), n -> {page}), '') AS html")
    return retrieval.chunk_html(docs).select("document_id", "chunk_index", "page_number", "content")


# Text of a page as a reader sees it, without white space: what is no text goes first.
_SEEN = "html"
for _gone in ("<!--.*?-->", "<script.*?</script>", "<style.*?</style>", "<[^>]*>"):
    _SEEN = f"regexp_replace({_SEEN}, '{_gone}', '', 'gs')"
# The entities that occur in pages.
_ENTITIES = {"&copy;": "©", "&middot;": "·", "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"'}
for _entity, _sign in _ENTITIES.items():
    _SEEN = f"replace({_SEEN}, '{_entity}', '{_sign}')"
_SEEN = f"regexp_replace({_SEEN}, '&amp;?', '&', 'g')"  # a page may end inside one
_SEEN = f"regexp_replace({_SEEN}, '[\\x20\\x09-\\x0D\\xA0]+', '', 'g')"


@query(
    "page_chunks",
    f"""SELECT page_id AS document_id, length({_SEEN}) AS chars, sha256({_SEEN}) AS text_sha256, true AS in_size, true AS in_order FROM pages""",
)
def page_chunks(t):
    """The chunks of every page hold all of its text, in order, and none is too long."""
    chunked = retrieval.chunk_html(t.pages.selectExpr("page_id AS document_id", "html"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "")
    pages = chunked.groupBy("document_id").agg(
        F.regexp_replace(joined, r"[\x20\x09-\x0D\xA0]+", "").alias("text"),
        (F.max(F.length("content")) <= MAX_CHARS).alias("in_size"),
        (F.max("chunk_index") + 1 == F.count(F.lit(1))).alias("in_order"),
    )
    return pages.select("document_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"), "in_size", "in_order")


@query("embedded_documents", "SELECT doc_id, 384 AS size, 1.0::DOUBLE AS norm FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]')")
def embedded_documents(t):
    embedded = vectors.embed(t.documents.select("doc_id", "text"), "text").filter(F.size("embedding") > 0)
    norm = F.round(F.expr(vectors.norm_sql("embedding")), 5)
    return embedded.select("doc_id", F.size("embedding").alias("size"), norm.alias("norm"))


_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query(
    "cosine_scores",
    f"""SELECT vec_id, round({_COS.format(a='e.embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 6) AS score FROM embeddings e""",
)
def cosine_scores(t):
    vector = t.embeddings.filter("vec_id = 0").first()["embedding"]
    return t.embeddings.select("vec_id", F.round(retrieval.vector_score(vector), 6).alias("score"))


# Each block of a document is a chunk; vectors are dealt out over the chunks.
def chunks(t: Tables):
    blocks = spread(t.documents, "doc_id").selectExpr("doc_id AS document_id", "array(lang) AS topic_ids", f"inline({text_elements_sql('text')})").selectExpr(
        "document_id", "seq AS chunk_index", "text AS content", "topic_ids"
    )
    keyed = t.sql(
        "SELECT *, (document_id * 31 + chunk_index) % (SELECT max(vec_id) + 1 FROM {embeddings}) AS vec_id FROM {blocks}",
        embeddings=t.embeddings,
        blocks=blocks,
    )
    full = keyed.join(t.embeddings.select("vec_id", "embedding"), "vec_id").drop("vec_id")
    return retrieval.with_terms(full)


def questions(t: Tables):
    """User turns; their content words and a vector are the question.

    A third of the conversations ask within English, a third within a topic no
    chunk has, detected or explicit, and a third without a scope.
    """
    asked = t.sql(
        "SELECT conv_id, conv_id * 1000 + turn AS question_id, text AS content,"
        " (conv_id * 17 + turn) % (SELECT max(vec_id) + 1 FROM {embeddings}) AS vec_id FROM {conversations} WHERE role = 'user'",
        embeddings=t.embeddings,
        conversations=t.conversations,
    )
    ready = retrieval.with_terms(asked.join(t.embeddings.select("vec_id", "embedding"), "vec_id"))
    return ready.selectExpr(
        "question_id",
        "terms",
        "embedding",
        "CASE conv_id % 3 WHEN 0 THEN array('en') WHEN 1 THEN array('nowhere') END AS topic_ids",
        "conv_id % 2 = 0 AS auto_detected",
    )


_INDEXES: dict[tuple, object] = {}


def indexed(t: Tables, kind: str, build):
    """An index is built once per application and table folder; searches read it."""
    key = (t.spark.sparkContext.applicationId, t.folder, kind)
    if key not in _INDEXES:
        _INDEXES[key] = build(shared_folder(t.spark, kind))
    return _INDEXES[key]


def passage_index(t: Tables) -> retrieval.PassageIndex:
    return indexed(t, "passage-index", lambda folder: retrieval.PassageIndex.build(chunks(t), folder))


def embedded_index(t: Tables) -> retrieval.PassageIndex:
    """Passages with vectors of their own words."""
    plain = chunks(t).drop("embedding")
    return indexed(t, "embedded-index", lambda folder: retrieval.PassageIndex.build(vectors.embed(plain, "content"), folder))


def document_index(t: Tables) -> VectorIndex:
    """Whole documents with vectors of their own words."""
    docs = vectors.embed(spread(t.documents, "doc_id").selectExpr("doc_id AS document_id", "0 AS chunk_index", "array(lang) AS topic_ids", "text"), "text")
    return indexed(t, "document-index", lambda folder: VectorIndex.build(docs.filter("size(embedding) > 0"), folder))


_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
_TERMS = (
    "list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'),"
    " lambda w: w <> '' AND w NOT IN (" + _STOP + ")), lambda w: " + retrieval.stem_sql("w") + ")"
)
CHUNKS = f"""{_ELEMENTS}, chunks AS (SELECT e.document_id, e.seq AS chunk_index, e.text AS content, lang,
    {_TERMS.format(x='e.text')} AS terms, v.embedding FROM els e JOIN documents d ON d.doc_id = e.document_id
    JOIN embeddings v ON v.vec_id = (e.document_id * 31 + e.seq) % (SELECT max(vec_id) + 1 FROM embeddings)),
  corpus AS (SELECT count(*) AS n, avg(len(terms)) AS length FROM chunks),
  tf AS (SELECT document_id, chunk_index, term, count(*) AS tf, any_value(n) AS n FROM
    (SELECT document_id, chunk_index, len(terms) AS n, unnest(terms) AS term FROM chunks) q GROUP BY 1, 2, 3),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""
_QUESTIONS = f"""questions AS (SELECT conv_id, conv_id * 1000 + turn AS question_id, list_distinct({_TERMS.format(x='text')}) AS terms,
    v.embedding AS qv, CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'nowhere' END AS topic, conv_id % 2 = 0 AS auto
    FROM conversations c JOIN embeddings v ON v.vec_id = (conv_id * 17 + turn) % (SELECT max(vec_id) + 1 FROM embeddings) WHERE role = 'user')"""
_BM25 = """(ln(1 + (corpus.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * tf.n / length)))"""
_TEXT = f"""qt AS (SELECT question_id, len(terms) AS wanted, unnest(terms) AS term FROM questions),
  bm AS (SELECT question_id, document_id, chunk_index, sum({_BM25}) AS s, count(*) AS found, any_value(wanted) AS wanted
    FROM qt JOIN tf USING (term) JOIN df USING (term), corpus GROUP BY 1, 2, 3),
  ts AS (SELECT question_id, document_id, chunk_index, s / (1 + s) AS text_score FROM bm WHERE found = wanted)"""
_SCORED = f"""scored AS (SELECT q.question_id, q.topic, q.auto, c.document_id, c.chunk_index, c.lang, c.content,
    round(0.6 * {_COS.format(a='c.embedding', b='q.qv')} + 0.4 * COALESCE(text_score, 0), 9) AS score
    FROM questions q CROSS JOIN chunks c LEFT JOIN ts ON ts.question_id = q.question_id AND ts.document_id = c.document_id
      AND ts.chunk_index = c.chunk_index)"""


@query(
    "text_scores",
    f"""WITH {CHUNKS}, questions AS (SELECT 0 AS question_id, list_distinct({_TERMS.format(x='text')}) AS terms FROM conversations
      WHERE role = 'user' ORDER BY conv_id, turn LIMIT 1), {_TEXT}
    SELECT c.document_id, c.chunk_index, round(COALESCE(text_score, 0), 9) AS text_score FROM chunks c
    LEFT JOIN ts ON ts.document_id = c.document_id AND ts.chunk_index = c.chunk_index""",
)
def text_scores(t):
    first = t.conversations.filter("role = 'user'").orderBy("conv_id", "turn").limit(1)
    terms = retrieval.with_terms(first, "text").first()["terms"]
    return passage_index(t).text.scores(terms).select("document_id", "chunk_index", F.round("text_score", 9).alias("text_score"))


_TWO_WORDS = f"""questions AS (SELECT 0 AS question_id, list_distinct({_TERMS.format(x='text')}[1:2]) AS terms FROM documents
      WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE lang = 'en' AND len({_TERMS.format(x='text')}) > 1))"""


@query(
    "best_text_matches",
    f"""WITH {CHUNKS}, {_TWO_WORDS}, {_TEXT}
    SELECT document_id, chunk_index, round(text_score, 9) AS text_score FROM ts ORDER BY round(text_score, 9) DESC, document_id, chunk_index LIMIT 20""",
)
def best_text_matches(t):
    """The twenty best passages for two words, from the slots whose bounds allow it."""
    english = retrieval.with_terms(t.documents.filter("lang = 'en'"), "text").filter(F.size("terms") > 1)
    terms = english.orderBy("doc_id").select(F.slice("terms", 1, 2).alias("terms")).first()["terms"]
    return passage_index(t).text.top(terms, 20)


@query(
    "hybrid_search",
    f"""WITH {CHUNKS}, {_QUESTIONS}, {_TEXT}, one AS (SELECT min(question_id) AS question_id FROM questions), {_SCORED}
    SELECT document_id, chunk_index, score, 'doc_' || document_id AS filename FROM scored JOIN one USING (question_id)
    WHERE lang = 'en' ORDER BY score DESC, document_id, chunk_index LIMIT 8""",
)
def hybrid_search(t):
    question = questions(t).orderBy("question_id").first()
    documents = t.documents.selectExpr("doc_id AS document_id", "'doc_' || doc_id AS filename")
    best = retrieval.hybrid_search(chunks(t), documents, question["terms"], question["embedding"], ["en"], index=passage_index(t))
    return best.select("document_id", "chunk_index", "score", "filename")


@query(
    "hybrid_search_many",
    f"""WITH {CHUNKS}, {_QUESTIONS}, {_TEXT}, {_SCORED}
    SELECT question_id, document_id, chunk_index, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id, chunk_index) AS rank FROM scored
      WHERE topic IS NULL OR topic = lang) q WHERE rank <= 8""",
)
def hybrid_search_many(t):
    hits = passage_index(t).search(questions(t))
    return hits.select("question_id", "document_id", "chunk_index", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "relaxed_search",
    f"""WITH {CHUNKS}, {_QUESTIONS}, {_TEXT}, {_SCORED}
    SELECT question_id, document_id, chunk_index, score, scoped FROM (
      SELECT *, topic IS NULL OR topic = 'en' AS scoped, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id, chunk_index) AS rank
      FROM scored WHERE topic IS NULL OR topic = lang OR (topic = 'nowhere' AND auto)) q WHERE rank <= 8""",
)
def relaxed_search(t):
    return retrieval.relax(chunks(t), as_table(questions(t), "questions"), index=passage_index(t)).select(
        "question_id", "document_id", "chunk_index", "score", "scoped"
    )


_PAGE = "CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR(20)) WHEN 1 THEN 'iv' END"


@query(
    "source_cards",
    f"""SELECT doc_id AS document_id, substr(text, 1, 280) AS snippet, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS INT) END AS page_number FROM documents""",
)
def source_cards(t):
    hits = t.documents.selectExpr("doc_id AS document_id", "text AS content", f"{_PAGE} AS page_number")
    return retrieval.source_cards(hits).select("document_id", "snippet", "page_number")


@query(
    "context_blocks",
    """WITH h AS (SELECT conv_id AS question_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, text FROM conversations)
    SELECT question_id, string_agg('[source ' || rank || ' | document ' || question_id || ' | chunk ' || turn || ']' || chr(10) || text,
      chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY 1""",
)
def context_blocks(t):
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    hits = t.conversations.select(
        F.col("conv_id").alias("question_id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"),
        F.col("text").alias("content"), rank.alias("rank"),
    )
    return retrieval.context_block(hits)


_LINKS = f"links AS ({fx.plain(fx.DOCUMENT_TOPICS_SQL)})"


@query(
    "resynced_chunks",
    f"""WITH {_LINKS}, a AS (SELECT document_id, string_agg(topic_id, ',' ORDER BY topic_id) AS topics FROM links GROUP BY 1)
    SELECT doc_id AS document_id, COALESCE(topics, '') AS topic_ids, COALESCE(topics, '') <> CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS changed
    FROM documents LEFT JOIN a ON document_id = doc_id""",
)
def resynced_chunks(t):
    stale = t.documents.selectExpr(
        "doc_id AS document_id", "if(doc_id % 2 = 0, array(lang), CAST(array() AS ARRAY<STRING>)) AS topic_ids"
    )
    fresh = retrieval.resync_chunk_topics(stale, fx.run(t, fx.DOCUMENT_TOPICS_SQL))
    return fresh.withColumn("topic_ids", F.array_join("topic_ids", ","))


@query(
    "chunks_in_topics",
    f"""WITH {CHUNKS} SELECT document_id, chunk_index FROM chunks WHERE lang IN ('en', 'de')""",
)
def chunks_in_topics(t):
    return retrieval.in_topics(chunks(t), ["en", "de"]).select("document_id", "chunk_index")


def _recall(t: Tables):
    """question_id, recall: for every document whose id is divisible by 20, the share of its
    k nearest documents that the approximate search finds; equal scores count alike."""
    index, k = document_index(t), retrieval.TOP_K
    asked = as_table(
        index.vectors().filter("document_id % 20 = 0").selectExpr("document_id AS question_id", "embedding", "CAST(NULL AS ARRAY<STRING>) AS topic_ids"),
        "questions",
    )
    score = F.round("vector_score", retrieval.SCORE_DIGITS)
    exact = index.scored(index.candidates(asked, k).select("question_id", *retrieval.KEY), asked).withColumn("score", score)
    nth = W.partitionBy("question_id").orderBy(F.desc("score"))
    best = exact.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= k)
    least = best.groupBy("question_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    near = retrieval.ann_search(index, asked, k).select("question_id", F.col("score").alias("found"))
    return least.join(near, "question_id", "left").groupBy("question_id").agg(
        (F.count_if(F.col("found") >= F.col("least")) / F.max("n")).alias("recall")
    )


@query("ann_recall")
def ann_recall(t):
    return _recall(t)


@query(
    "ann_quality",
    "SELECT count(*) AS questions, true AS recall_reached, true AS tenth_read FROM documents WHERE doc_id % 20 = 0 AND regexp_matches(text, '[\\p{L}\\p{N}]')",
)
def ann_quality(t):
    """Whether the mean recall reaches 0.9, with the vectors of at most a tenth of all pairs read."""
    passages = document_index(t).parts().agg(F.sum("n")).scalar()
    return _recall(t).agg(
        F.count(F.lit(1)).alias("questions"),
        (F.avg("recall") >= 0.9).alias("recall_reached"),
        F.first(F.lit(10 * RERANK * retrieval.TOP_K) <= passages).alias("tenth_read"),
    )


@query(
    "search_effort",
    f"""WITH {CHUNKS}, {_QUESTIONS} SELECT (SELECT count(*) FROM chunks) AS passages, (SELECT count(*) FROM questions) AS questions, true AS tenth_scored""",
)
def search_effort(t):
    """Whether the exact search scores at most a tenth of all pairs of texts with vectors of their words."""
    index = embedded_index(t)
    asked = t.conversations.filter("role = 'user'").selectExpr("conv_id * 1000 + turn AS question_id", "text AS content", "CAST(NULL AS ARRAY<STRING>) AS topic_ids")
    ready = as_table(retrieval.with_terms(vectors.embed(asked, "content")), "questions")
    pairs = index.scored_pairs(ready).agg(F.count(F.lit(1)).alias("pairs"))
    counts = index.text.passages().agg(F.count(F.lit(1)).alias("passages")).join(ready.agg(F.count(F.lit(1)).alias("questions"))).join(pairs)
    return counts.selectExpr("passages", "questions", "10 * pairs <= passages * questions AS tenth_scored")
