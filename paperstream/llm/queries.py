"""The pN_ queries of this package; each applies an operator to its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperstream.llm import address, cutoff, encode, mix, quantiles, scan_repair, split, topn
from paperstream.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_values(table(spark, d, "documents"), table(spark, d, "candidates"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_shares(table(spark, d, "documents"), table(spark, d, "candidates"))


def p1_lengths(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.limits(table(spark, d, "documents"), table(spark, d, "candidates"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "field_candidates"), 3).select("doc_id", "field", "gen_seq")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return address.same_location(table(spark, d, "receipt_cases"), table(spark, d, "field_candidates"))


def p3_locations(spark: SparkSession, d: str) -> DataFrame:
    return address.locations(table(spark, d, "receipt_cases"), table(spark, d, "field_candidates"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.latency_percentiles(table(spark, d, "lane_events"), table(spark, d, "candidates"))


def _read(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.read_all(table(spark, d, "scan_pages"), table(spark, d, "candidates"), table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.noisy_lines(_read(spark, d))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repaired(_read(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode(p6_ids(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split(table(spark, d, "documents"), table(spark, d, "piece_limits"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    return mix.kept(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    return split.kept(table(spark, d, "documents"), table(spark, d, "piece_limits"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_shares, p1_lengths, p2_found, p3_found, p3_locations, p4_percentiles, p5_found, p5_paragraphs, p6_ids, p6_decoded, p7_mix, p7_shares, p7_kept, p8_pieces, p8_kept)}
