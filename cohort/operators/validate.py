"""Upload checks: one reject reason per row, the first failing rule wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohort.functions.names import IMAGE_EXTENSIONS, suffix

MAX_FILE_SIZE_MB = 10


def reject_reason(filename: Column, content_type: Column, size: Column, decodable: Column,
                  extensions: Sequence[str] = IMAGE_EXTENSIONS,
                  max_mb: int = MAX_FILE_SIZE_MB, type_prefix: str = "image/") -> Column:
    """Why an upload is refused, NULL if it is accepted."""
    extension = F.lower(suffix(F.coalesce(filename, F.lit(""))))
    typed = F.coalesce(content_type, F.lit("")) != ""
    return (F.when(~extension.isin(*extensions), "unsupported file type")
            .when(typed & ~content_type.startswith(type_prefix), "invalid content type")
            .when(size > max_mb * 1024 * 1024, "file too large")
            .when(~F.coalesce(decodable, F.lit(False)), "could not open image"))


def accepted(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason).isNull()).drop(reason)


def dead_letters(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason).isNotNull())


def reject_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("n"))
