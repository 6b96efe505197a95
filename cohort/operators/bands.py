"""Band keys of fingerprints and the condition that keeps each near pair exactly once.

A fingerprint travels as 64-bit words with the sign bit turned over, so that comparing words as
numbers orders fingerprints like their hex text; XOR does not see the turned bit.  The part of
the join condition that every candidate runs through is a few integer operations; which band
comes first is looked up in a table of masks, and only for pairs that are near.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohort.functions.bits import WORD_CHARS, spans

_SIGN = -(1 << 63)
_EXACT_CHARS = 15


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


class Bands:
    """The cuts of ``bits``-bit fingerprints for a Hamming distance of up to ``threshold``.

    With threshold + 1 pieces, two fingerprints that near agree in at least one.  ``pieces``
    cuts all characters, ``sub_pieces[b]`` the characters outside piece ``b``.
    """

    def __init__(self, bits: int, threshold: int) -> None:
        self.bits, self.threshold = bits, threshold
        self.chars, self.words = bits // 4, bits // 64
        everything = list(range(self.chars))
        self.pieces = self._cut(everything)
        self.can_refine = self.chars - max(map(len, self.pieces)) > threshold
        self.sub_pieces = [self._cut([c for c in everything if c not in piece])
                           for piece in self.pieces] if self.can_refine else []

    def _cut(self, positions: list[int]) -> list[list[int]]:
        return [positions[start:start + length]
                for start, length in spans(len(positions), self.threshold + 1)]

    def word_columns(self, print_hex: Column) -> dict[str, Column]:
        return {f"w{i}": F.conv(F.substring(print_hex, i * WORD_CHARS + 1, WORD_CHARS), 16, -10)
                .cast("bigint").bitwiseXOR(F.lit(_SIGN)) for i in range(self.words)}

    def print_hex(self, side: str) -> Column:
        return F.concat(*[F.lpad(F.lower(F.hex(F.col(f"{side}.w{i}").bitwiseXOR(F.lit(_SIGN)))),
                                 WORD_CHARS, "0") for i in range(self.words)])

    def _value(self, piece: list[int]) -> Column:
        """The bits of a piece as one number; a piece too long for that is hashed."""
        if len(piece) > _EXACT_CHARS:
            masked = [F.col(f"w{i}").bitwiseAND(F.lit(m))
                      for i, m in enumerate(self._mask(piece)) if m]
            return F.xxhash64(*masked)
        value = F.lit(0).cast("bigint")
        for word in range(self.words):
            inside = [c % WORD_CHARS for c in piece if c // WORD_CHARS == word]
            runs = []
            for c in inside:
                if runs and runs[-1][-1] == c - 1:
                    runs[-1].append(c)
                else:
                    runs.append([c])
            for run in runs:
                size = 4 * len(run)
                bits = F.shiftrightunsigned(f"w{word}", 4 * (WORD_CHARS - 1 - run[-1])).bitwiseAND(
                    F.lit((1 << size) - 1).cast("bigint"))
                value = F.shiftleft(value, size).bitwiseOR(bits)
        return value

    def _mask(self, piece: list[int]) -> list[int]:
        masks = [0] * self.words
        for c in piece:
            masks[c // WORD_CHARS] |= 0xF << 4 * (WORD_CHARS - 1 - c % WORD_CHARS)
        return [_signed(m) for m in masks]

    def banded(self, prints: DataFrame, keep: list[str]) -> DataFrame:
        """One row per fingerprint and band: kept columns, words, ``band`` and ``value``."""
        names = [f"w{i}" for i in range(self.words)]
        values = F.posexplode(F.array(*[self._value(p) for p in self.pieces]))
        return (prints.select(*keep, *[c.alias(n) for n, c in
                                       self.word_columns(F.col("print")).items()])
                .select(*keep, *names, values.alias("band", "value")))

    def refined(self, rows: DataFrame) -> DataFrame:
        """Add a second band outside the first: ``sub`` and ``sub_value``."""
        values = None
        for band, pieces in enumerate(self.sub_pieces):
            option = F.array(*[self._value(p) for p in pieces])
            same = F.col("band") == band
            values = F.when(same, option) if values is None else values.when(same, option)
        return rows.select("*", F.posexplode(values).alias("sub", "sub_value"))

    def _masks(self, pieces: list[list[int]]) -> Column:
        return F.array(*[F.array(*[F.lit(m).cast("bigint") for m in self._mask(p)])
                         for p in pieces])

    def _differences(self) -> list[Column]:
        return [F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}")) for i in range(self.words)]

    def distance(self) -> Column:
        return reduce(lambda x, y: x + y,
                      [F.bit_count(x) for x in self._differences()]).cast("int")

    def in_order(self) -> Column:
        """Fingerprint of ``a`` before that of ``b`` in hex order."""
        result = F.lit(False)
        for i in reversed(range(self.words)):
            left, right = F.col(f"a.w{i}"), F.col(f"b.w{i}")
            result = (left < right) | ((left == right) & result)
        return result

    def _first_equal(self, masks: Column) -> Column:
        differences = F.array(*self._differences())

        def equal(mask):
            return F.forall(F.zip_with(differences, mask, lambda x, m: x.bitwiseAND(m)),
                            lambda rest: rest == 0)

        return F.array_position(F.transform(masks, equal), True) - 1

    def at_first_band(self, refined: bool) -> Column:
        """The pair is looked at in its first equal band, and there in its first second band."""
        first = F.col("a.band") == self._first_equal(self._masks(self.pieces))
        if not refined:
            return first
        tables = F.array(*[self._masks(pieces) for pieces in self.sub_pieces])
        return first & ((F.col("a.sub") == -1)
                        | (F.col("a.sub") == self._first_equal(tables[F.col("a.band")])))
