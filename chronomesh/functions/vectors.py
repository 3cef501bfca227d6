"""Expressions over array columns: geometry, softmax, divergences, quantisation, rotation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 1e-12, dot(a, b) / size).otherwise(F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def relative_error(a: Column, b: Column) -> Column:
    """|a - b| / |a|; 0 if a is as good as zero."""
    return F.when(norm(a) < 1e-12, F.lit(0.0)).otherwise(euclid(a, b) / norm(a))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(a: Column) -> Column:
    return let(a, lambda x: let(F.array_max(x), lambda top: let(
        F.transform(x, lambda v: F.exp(v - top)), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s))
    )))


def diagonal_fisher(p: Column) -> Column:
    return F.transform(p, lambda v: v * (1 - v))


def natural_gradient(g: Column, p: Column, epsilon: float = 1e-4) -> Column:
    return F.zip_with(g, diagonal_fisher(p), lambda x, f: x / (f + epsilon))


def fisher_rao(p: Column, q: Column) -> Column:
    return 2 * F.acos(F.least(total(F.zip_with(p, q, lambda x, y: F.sqrt(x * y))), F.lit(1.0)))


def kl_divergence(p: Column, q: Column, epsilon: float = 1e-10) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.ln(x / F.greatest(y, F.lit(epsilon)))).otherwise(F.lit(0.0))))


def cross_entropy_gradient(logits: Column, target: int) -> Column:
    return F.transform(softmax(logits), lambda v, k: v - F.when(k == target, 1.0).otherwise(0.0))


def descend(logits: Column, target: int, rate: float = 0.1, steps: int = 8, natural: bool = False, epsilon: float = 1e-4) -> Column:
    """Logits after gradient steps towards a class, one expression."""
    def step(at: Column, _: Column) -> Column:
        g = cross_entropy_gradient(at, target)
        return let(natural_gradient(g, softmax(at), epsilon) if natural else g, lambda d: F.zip_with(at, d, lambda x, y: x - rate * y))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), logits, step)


def compare_steps(logits: Column, g: Column, rate: float, epsilon: float = 1e-4) -> Column:
    """(euclid_vanilla, euclid_natural, fisher_rao_vanilla, fisher_rao_natural) of one step either way."""
    p = softmax(logits)
    ways = {"vanilla": g, "natural": natural_gradient(g, p, epsilon)}
    moved = {k: F.zip_with(logits, d, lambda x, y: x - rate * y) for k, d in ways.items()}
    return F.struct(
        *[euclid(logits, moved[k]).alias(f"euclid_{k}") for k in ways], *[fisher_rao(p, softmax(moved[k])).alias(f"fisher_rao_{k}") for k in ways]
    )


def quantized(a: Column, levels: int) -> Column:
    """Round trip through ``levels`` even steps between least and most; halves round up."""
    low = F.array_min(a)
    scale = (F.array_max(a) - low) / (levels - 1)
    scale = F.when(scale < 1e-9, F.lit(1.0)).otherwise(scale)
    return F.transform(a, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(levels - 1.0), F.floor((v - low) / scale + 0.5).cast("double"))) * scale + low)


def block_quantized(a: Column, block: int = 16, levels: int = 16) -> Column:
    """Round trip of each ``block`` values on their own (4 bits by default)."""
    starts = F.sequence(F.lit(0), F.size(a) - 1, F.lit(block))
    return F.flatten(F.transform(starts, lambda s: quantized(F.slice(a, s + 1, block), levels)))


def hadamard(a: Column) -> Column:
    """Rotation by the normalised Hadamard matrix, whose entry (i, j) is the parity of i & j; its own inverse."""
    n = F.size(a)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: total(F.transform(
        a, lambda v, j: v * (1 - 2 * (F.bit_count(i.bitwiseAND(j)) % 2))
    )) / F.sqrt(n))


def ring_histogram(idx: Column, x: Column, y: Column, most: float, rings: int = 10, bins: int = 8) -> tuple[Column, Column]:
    """(ring, bin) of a point: rings up to ``most``, bins of its angle."""
    r = F.sqrt(x * x + y * y)
    turn = F.atan2(y, x) + math.pi
    return F.least(F.floor(r / most * rings), F.lit(rings - 1)), F.least(F.floor(turn / (2 * math.pi) * bins), F.lit(bins - 1))
