"""Queries of the operators for language-model data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import gazetteer, languages, lookalikes, packing, pages, subjects, tokens, truncation
from driftwell.session import cut_lineage
from driftwell.sources.tables import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ids of every document."""
    return tokens.token_ids(table(spark, d, "documents", "doc_id", "text"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, piece, piece_tokens, container, position of every piece of every document with tokens."""
    return packing.pack(tokens.token_counts(table(spark, d, "documents", "doc_id", "text")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p8_containers(spark, d))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """The rules of packing over all containers and documents: documents, over_full, apart, lost, split, loose."""
    counts = cut_lineage(tokens.token_counts(table(spark, d, "documents", "doc_id", "text")))  # counted once
    return packing.check(packing.pack(counts), counts)


def p7_words(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, has_ids, whole of every document: whether it has ids, and whether they spell its text again."""
    text = table(spark, d, "documents", "doc_id", "text")
    return tokens.spelled(text).select("doc_id", "has_ids", "whole")


def _p2_rows(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.fields(table(spark, d, "items", "id", "title", "summary"), "id", ["title", "summary"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """field, item_id_a, item_id_b of items that look the same but are stored differently."""
    return lookalikes.seen_equal(_p2_rows(spark, d)).select("field", F.col("key_a").alias("item_id_a"), F.col("key_b").alias("item_id_b"))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """field, item_id, canonical: every text in its consistent form."""
    return lookalikes.canonical(_p2_rows(spark, d)).select("field", F.col("key").alias("item_id"), "canonical")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """field, canonical, forms, keys, links of every class of texts that look the same but are stored differently."""
    return lookalikes.classes(_p2_rows(spark, d))


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    """id, seg, lang, confidence, case of every segment of every title."""
    return languages.segments(table(spark, d, "items", "id", "title", "lang"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """item_id, seg, lang of items whose title mixes languages or whose label is missing or wrong."""
    return p4_segments(spark, d).filter("case").select(F.col("id").alias("item_id"), "seg", "lang").distinct()


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """item_id, city, country, place_id, country_code, matched of every event with a typed city."""
    return gazetteer.match_events(table(spark, d, "item_events", "item_id", "city", "country", "tz"), table(spark, d, "places"), table(spark, d, "countries"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """item_id, place_id, country_code of every event with a typed city."""
    return p3_matches(spark, d).select("item_id", "place_id", "country_code").distinct()


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """field, city, country, events: typed cities and typed countries that mean no entry, and how many events have them."""
    each = F.explode(F.filter(F.array(F.when(~F.col("matched"), "city"), F.when(~F.col("country_matched"), "country")), lambda x: x.isNotNull())).alias("field")
    return p3_matches(spark, d).select(each, "city", "country").groupBy("field", "city", "country").agg(F.count("*").alias("events"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """raw_path, block_md5 of every different block of every page's article."""
    # a page is one row, so equal blocks are made one without a shuffle where raw_path is unique; distinct() keeps it true elsewhere
    return pages.article_blocks(table(spark, d, "raw_pages", "raw_path", "source_id", "body")).select("raw_path", "block_md5").distinct()


def p5_rendered(spark: SparkSession, d: str) -> DataFrame:
    """raw_path, rendered, article: every page as text, whole and without its surroundings."""
    return pages.rendered(table(spark, d, "raw_pages", "raw_path", "source_id", "body"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, subject, share for each subject that a document is about."""
    return subjects.document_subjects(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "subject_examples", "subject", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, subject for each subject that a document is about."""
    return p9_shares(spark, d).select("doc_id", "subject")


def _p1_rows(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rows_of(table(spark, d, "items", "id", "source_id", "summary"), "id", "source_id", "summary")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """item_id of every item whose summary was cut."""
    return truncation.truncated(_p1_rows(spark, d)).filter("cut").select(F.col("key").alias("item_id")).distinct()


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    """source, texts, cut, by_limit, share: how often each source cuts its summaries."""
    return truncation.source_report(truncation.truncated(_p1_rows(spark, d)))


def p1_limits(spark: SparkSession, d: str) -> DataFrame:
    """source, measure, length, texts, ... of every hidden storage limit."""
    return truncation.limits(cut_lineage(truncation.judged(_p1_rows(spark, d))))


QUERIES = {"p1_found": p1_found, "p1_sources": p1_sources, "p1_limits": p1_limits, "p9_found": p9_found, "p9_shares": p9_shares, "p5_found": p5_found, "p5_rendered": p5_rendered, "p3_found": p3_found, "p3_matches": p3_matches, "p3_unmatched": p3_unmatched, "p4_found": p4_found, "p4_segments": p4_segments, "p2_found": p2_found, "p2_canonical": p2_canonical, "p2_classes": p2_classes, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_check": p8_check, "p7_words": p7_words}
ORACLES = {
    # no rule is broken, and every document with text has its tokens in a container
    "p8_check": "SELECT count(*) FILTER (WHERE text <> '') AS documents, CAST(0 AS BIGINT) AS over_full, CAST(0 AS BIGINT) AS apart, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS split, false AS loose FROM documents",
    # exact round trip: ids spell the text, empty and null texts have none
    "p7_words": "SELECT doc_id, coalesce(text, '') <> '' AS has_ids, true AS whole FROM documents",
}
