"""Fingerprints as columns: median-threshold bits, hex text, 64-bit words, Hamming distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from cohort.functions.vectors import bind

WORD_BITS = 64
WORD_CHARS = 16


def median_print(values: Column, size: int) -> Column:
    """Hex fingerprint of a numeric array of ``size`` elements (a multiple of 64).

    A bit is set where the element is above the median; the first element is the highest bit.
    For an even size the median lies half-way between the two middle elements, so twice the
    element is compared with their sum.  NULL in, NULL out.
    """
    if size % WORD_BITS:
        raise ValueError("a fingerprint has a multiple of 64 bits")
    def flags(middle):
        bits = F.transform(values, lambda x: F.when(x * 2 > middle, "1").otherwise("0"))
        return F.array_join(bits, "")

    ordered = F.sort_array(values)
    text = bind(F.try_element_at(ordered, F.lit(size // 2))
                + F.try_element_at(ordered, F.lit(size // 2 + 1)), flags)
    words = [
        F.lpad(F.lower(F.conv(F.substring(text, start + 1, WORD_BITS), 2, 16)), WORD_CHARS, "0")
        for start in range(0, size, WORD_BITS)
    ]
    return F.when(F.size(values) == size, F.concat(*words))


def hex_words(print_hex: Column, chars: int) -> Column:
    """The 64-bit words of a hex fingerprint."""
    return F.array(*[
        F.conv(F.substring(print_hex, start + 1, WORD_CHARS), 16, -10).cast("bigint")
        for start in range(0, chars, WORD_CHARS)
    ])


def words_distance(left: Column, right: Column, words: int) -> Column:
    """Hamming distance of two word arrays of known length; stays inside generated code."""
    parts = [F.bit_count(left[i].bitwiseXOR(right[i])) for i in range(words)]
    return reduce(lambda a, b: a + b, parts).cast("int")


def hamming(left: Column, right: Column, bits: int = 256) -> Column:
    """Hamming distance of two hex fingerprints; infinite when either is missing."""
    chars = bits // 4
    distance = words_distance(hex_words(left, chars), hex_words(right, chars), chars // WORD_CHARS)
    return F.coalesce(distance.cast("double"), F.lit(float("inf")))


def risk_tier(distance: Column) -> Column:
    """Risk named after the distance of a pair."""
    return (F.when(distance == 0, "EXACT DUPLICATE")
            .when(distance <= 3, "HIGH RISK")
            .otherwise("MODERATE RISK"))


def spans(chars: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` adjoining (offset, length) pieces of a string of ``chars`` characters."""
    if parts > chars:
        raise ValueError(f"{chars} characters cannot be cut into {parts} pieces")
    short, longer = divmod(chars, parts)
    lengths = [short] * (parts - longer) + [short + 1] * longer
    return [(sum(lengths[:i]), length) for i, length in enumerate(lengths)]
