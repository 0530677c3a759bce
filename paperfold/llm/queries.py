"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperfold.llm import (
    chat, divergence, exact_dedup, licenses, mixing, near_dedup, packing, pii, quality, sql, token_counts, token_files, turns, warc,
)
from paperfold.session import as_table, prepare, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, DataFrame], DataFrame], table: str):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle

    return register


def _documents(name: str, oracle: str | None = None):
    return lambda fn: query(name, oracle)(fn, "documents")


def mixing_sql(max_epochs: int = mixing.MAX_EPOCHS, percent: int = 100) -> str:
    """The SQL twin of the mix over `documents`."""
    number = "coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0)"
    levels = {
        "domain": f"list_extract({list(mixing.DOMAINS)}, 1 + ({number} % {len(mixing.DOMAINS)})::INT)",
        "lang": "lang",
        "source": "source",
    }
    return sql.mixing(levels, {"domain": mixing.DOMAINS, "lang": mixing.LANGUAGES}, mixing.SEED, max_epochs, percent)


@_documents("op1_mixing", mixing_sql())
def _mixing(spark, docs):
    return mixing.mixed_documents(docs)


@_documents("op2_token_counts")
def _token_counts(spark, docs):
    return token_counts.token_counts(docs)


@_documents("op3_token_files")
def _token_files(spark, docs):
    folder = shared_folder(spark, "token-files")
    token_files.write_ids(docs, folder)
    return token_files.read_checks(spark, folder)


@_documents("op4_packing")
def _packing(spark, docs):
    return packing.packed_documents(docs)


@_documents("op5_near_dedup", sql.NEAR)
def _near(spark, docs):
    return near_dedup.near_duplicates(docs, shingle=2).select("doc_id", "n_shingles", "component_id", "kept")


_VERDICT = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words removed_words base_failed depleted kept".split()


@_documents("op6_quality_rules", sql.QUALITY)
def _quality(spark, docs):
    return quality.quality_rules(docs).select(*_VERDICT)


# The name under which the host's limit came first; the same rows.
QUERIES["op6_quality_by_host"], ORACLES["op6_quality_by_host"] = QUERIES["op6_quality_rules"], sql.QUALITY


@_documents("op7_personal_data")
def _personal(spark, docs):
    return pii.personal_data(docs)


@_documents("op8_licenses")
def _licenses(spark, docs):
    return licenses.license_scan(docs)


@_documents("op9_exact_dedup", sql.EXACT)
def _exact(spark, docs):
    return exact_dedup.exact_dedup(docs)


_CHATS = sql.chats(chat.CONTROL, chat.ESCAPES, len(chat.TURN + chat.SAYS + chat.END))


def _chats(spark, conversations):
    extra = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digests(as_table(chat.format_chats(rows), "chats"))


query("op10_chat_formatting", _CHATS)(_chats, "conversations")


def _archives(spark, pages):
    folder = shared_folder(spark, "archives")
    warc.write_archives(pages, folder)
    return warc.read_archives(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


query("op11_warc", sql.WARC)(_archives, "pages")


@_documents("op12_source_divergence", sql.DIVERGENCE)
def _divergence(spark, docs):
    return divergence.source_divergence(docs)


query("op13_conversation_repair", sql.CONVERSATIONS)(lambda spark, rows: turns.repair_damaged(rows), "conversations")
