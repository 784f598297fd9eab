"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import (
    chosen_path, disclosure, divergence, filter_audit, html_tree, kdtree_shards, license_sentences, line_chunks,
    mixing, piece_bpe, quality_ledger, suffix_decontam, token_files,
)
from assayer.llm.common import read
from assayer.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op1_token_files(spark, sf_dir):
    """All documents as token files, read back from them."""
    folder = scratch_path(spark, "tokens")
    token_files.write(read(spark, sf_dir, "documents"), folder)
    return token_files.read(spark, folder)


@query
def op2_suffix_decontam(spark, sf_dir):
    """Words of each document that stand in a window of a benchmark item."""
    found = suffix_decontam.hit_words(suffix_decontam.find(
        read(spark, sf_dir, "documents").select("doc_id", "text"),
        read(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op3_piece_bpe(spark, sf_dir):
    """Each document encoded and decoded again: number and digests of both."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.round_trip(docs).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op4_chosen_path(spark, sf_dir):
    """Class and number of similar documents of each document."""
    joined = chosen_path.join(read(spark, sf_dir, "documents"))
    return joined.select(F.col("_id").alias("doc_id"), "class_id", "n_links", "n_copies")


@query
def op5_html_tree(spark, sf_dir):
    """Main text of each page."""
    return html_tree.extract(read(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", "n_chars")


@query
def op6_disclosure(spark, sf_dir):
    """Personal data of each document: spans of the fixed kinds and disclosing terms."""
    found = disclosure.find(read(spark, sf_dir, "documents"))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == disclosure.KINDS.index(kind))) \
            .cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("_id").alias("doc_id"), *[number(k) for k in disclosure.KINDS[:4]],
        F.sha2(disclosure.written(F.col("base")), 256).alias("base_sha256"),
        disclosure.written(F.col("spans")).alias("spans"))


@query
def op7_line_chunks(spark, sf_dir):
    """Lines of each document that go, and a digest of the text that stays."""
    done = line_chunks.clean(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.array_sort("removed"), ",").alias("removed"),
        F.length("kept_text").cast("long").alias("n_chars_kept"),
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


@query
def op8_license_sentences(spark, sf_dir):
    """Known licence sentences, rules and licences of each document."""
    found = license_sentences.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join("sentences", ",").alias("sentences"),
        F.array_join("rules", ",").alias("rules"),
        F.array_join("licenses", ",").alias("licenses"))


@query
def op9_kdtree_shards(spark, sf_dir):
    """All documents in 16 shards of near equal bytes."""
    placed = kdtree_shards.assign(read(spark, sf_dir, "documents"), 16)
    return placed.select(
        F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_quality_ledger(spark, sf_dir):
    """Measurements, failure bits and the verdict of the current policy."""
    entries = quality_ledger.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality_ledger.apply_policy(entries, "prose-1", "_passed")
    base = quality_ledger.mask("base-1")
    failed = F.col("fail_bits").bitwiseAND(F.lit(base)) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("_passed")).alias("kept"),
        "n_lines", "n_upper", "fail_bits")


@query
def op11_mixing(spark, sf_dir):
    """Words that the mixture of all sources takes from each document."""
    return mixing.Mixture(read(spark, sf_dir, "documents")).taken()


@query
def op12_filter_audit(spark, sf_dir):
    """Five filters in all their orders, by language."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = filter_audit.audit(docs, labels,
                               filter_audit.conditions(F.coalesce("text", F.lit(""))))
    return found.drop("filter")


@query
def op13_divergence(spark, sf_dir):
    """Distances of the sources of each language, and the terms that set each apart."""
    return divergence.divergence(read(spark, sf_dir, "documents"))
