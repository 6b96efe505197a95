"""Array arithmetic: softmax, arg-max, cosine, normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

ZERO = 0.0


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(ZERO), lambda acc, x: acc + x)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once per row, not once per element."""
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column) -> Column:
    def shares(top):
        return bind(F.transform(logits, lambda x: F.exp(x - top)),
                    lambda raised: bind(total(raised),
                                        lambda t: F.transform(raised, lambda x: x / t)))
    return bind(F.array_max(logits), shares)


def arg_max(values: Column) -> Column:
    """Zero-based position of the largest element; the first one wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(ZERO), lambda acc, x: acc + x * x))


def unit(values: Column) -> Column:
    """The vector scaled to length one; a zero vector gives NULL."""
    return bind(norm(values), lambda length: F.when(
        length > 0, F.transform(values, lambda x: x / length)))


def array_of(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def normalise(pixels: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """``(x - mean) / std`` over interleaved channels."""
    channels, m, s = len(mean), array_of(mean), array_of(std)
    return F.transform(pixels, lambda x, i: (x - m[i % channels]) / s[i % channels])


def denormalise(pixels: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """``x * std + mean`` over interleaved channels, clipped to [0, 1]."""
    channels, m, s = len(mean), array_of(mean), array_of(std)
    return F.transform(pixels, lambda x, i: F.least(
        F.lit(1.0), F.greatest(F.lit(0.0), x * s[i % channels] + m[i % channels])))


def ranked(names: Column, scores: Column) -> Column:
    """Name and score pairs, best first, ties by name."""
    pairs = F.arrays_zip(names.alias("name"), scores.alias("score"))
    structs = F.transform(pairs, lambda p: F.struct((-p["score"]).alias("key"),
                                                    p["name"].alias("name"),
                                                    p["score"].alias("score")))
    return F.transform(F.array_sort(structs), lambda p: F.struct(p["name"], p["score"]))
