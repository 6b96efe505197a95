"""Duplicates on arrival: a stream of fingerprints against the table of known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohort.operators.bands import Bands
from cohort.operators.pairs import BUCKET_ROWS, THRESHOLD
from cohort.session import written


def _keyed(prints: DataFrame, keep: list[str], bands: Bands, refined: bool) -> DataFrame:
    rows = bands.banded(prints, keep)
    if refined:
        return bands.refined(rows)
    return rows.withColumns({"sub": F.lit(-1), "sub_value": F.lit(0).cast("bigint")})


def known_bands(groups: DataFrame, bits: int = 256, threshold: int = THRESHOLD,
                bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, bool]:
    """Band table of known fingerprints (one row per distinct one, see ``print_groups``).

    When some bucket is large, all keys get a second band, which keeps buckets small and the
    search exact.
    """
    bands, keep = Bands(bits, threshold), ["first", "n"]
    plain = written(_keyed(groups, keep, bands, False), "known-bands")
    largest = (plain.groupBy("band", "value").agg(F.count("*").alias("rows"))
               .where(F.col("rows") > bucket_rows))
    if largest.isEmpty() or not bands.can_refine:
        return plain, False
    return written(_keyed(groups, keep, bands, True), "known-bands"), True


def arriving_duplicates(stream: DataFrame, key: str, known: DataFrame, refined: bool,
                        bits: int = 256, threshold: int = THRESHOLD) -> DataFrame:
    """(key, print, known print, first known member, members, distance) for each near match.

    A stateless stream-static join; a match comes out once, at its first equal band.
    """
    bands = Bands(bits, threshold)
    arrivals = _keyed(stream.where(F.col("print").isNotNull()), [key], bands, refined)
    a, b = arrivals.alias("a"), known.alias("b")
    condition = F.lit(True)
    for column in ("band", "value", "sub", "sub_value"):
        condition = condition & (F.col(f"a.{column}") == F.col(f"b.{column}"))
    condition = condition & (bands.distance() <= threshold) & bands.at_first_band(refined)
    return a.join(b, condition).select(
        F.col(f"a.{key}").alias(key), bands.print_hex("a").alias("print"),
        bands.print_hex("b").alias("known_print"), F.col("b.first").alias("known_first"),
        F.col("b.n").alias("known_members"), bands.distance().alias("distance"))

