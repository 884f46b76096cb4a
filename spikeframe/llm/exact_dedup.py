"""Exact de-duplication: 128-bit content hash, then the bytes themselves.

Texts are equal when identical after lower-casing A-Z; null counts as empty. One grouped pass
keyed by (hash, normalised text) compares bytes inside every hash group, so a hash collision
splits into separate groups. Partial aggregation leaves one row per group and map task, however
many copies a group has; each distinct text crosses the network once per map task that holds it.

Defined results: a null id ranks below every other id. Rows that repeat both id and text are one
document (one result row; `group_size` counts every row). Extra columns are allowed. An empty
table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def content_hash(text: Column) -> Column:
    """128 bits of the UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def text_groups(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per distinct normalised text: hash, text, keep_id, group_size."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    return (texts.groupBy(hashed(F.col("norm")).alias("hash"), "norm")
            .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))


def exact_dedup(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One decision per document: doc_id, keep_id, group_size, kept, text_sha256.

    Documents find their group by hash plus SHA-256, so no text crosses this join; a hot group is
    one row on the group side and small rows on the other, which adaptive execution splits.
    """
    groups = text_groups(docs, hashed).select(
        "hash", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    rows = (docs.select("doc_id", normalised(F.col("text")).alias("norm"))
            .select("doc_id", hashed(F.col("norm")).alias("hash"),
                    F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
            .distinct())
    return rows.join(groups, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_distinct(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The documents that stay, with all their columns: one shuffle, no join back."""
    norm = normalised(F.col("text"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    best = docs.groupBy(hashed(norm).alias("__hash"), norm.alias("__norm")).agg(
        F.max_by(row, F.struct("doc_id", "text")).alias("__row"))
    return best.select("__row.*")
