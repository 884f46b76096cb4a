"""Registered queries of the corpus operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    best_fit, collocations, exact_dedup, hard_negatives, language_centroids, line_quality, mixture_packing, oracles,
    page_wrappers, piece_tokens, secret_formats, simhash_trees, suffix_levels, surrogates,
)
from .common import table


#: The registered queries' key, so that their rows can be repeated; it is public, own data need another.
PUBLIC_KEY = "spikeframe"


def op1_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_formats.digests(secret_formats.scan(table(spark, sf_dir, "documents")))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality_report(table(spark, sf_dir, "documents"))


def op3_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_wrappers.extract(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.digests(suffix_levels.repeated_spans(table(spark, sf_dir, "documents")))


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack(table(spark, sf_dir, "documents"))


def op7_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trees.near_duplicates(table(spark, sf_dir, "documents"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.report(table(spark, sf_dir, "documents"), PUBLIC_KEY)


def op9_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.token_digests(table(spark, sf_dir, "documents"))


def op10_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_centroids.held_out_predictions(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_secret_formats, op2_line_quality, op3_page_wrappers, op4_exact_dedup, op5_suffix_levels, op6_mixture_packing,
    op7_simhash_trees, op8_surrogates, op9_piece_tokens, op10_language_centroids, op11_best_fit_packing,
    op12_hard_negatives, op13_collocations)}
ORACLES = {"op2_line_quality": oracles.LINE_QUALITY, "op4_exact_dedup": oracles.EXACT_DEDUP,
           "op12_hard_negatives": oracles.HARD_NEGATIVES, "op13_collocations": oracles.COLLOCATIONS}
