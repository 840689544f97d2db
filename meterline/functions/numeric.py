"""Numeric column expressions. Every ratio is ANSI-safe (null on zero)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; null stays null (greatest/least would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def floor_at_zero(value: Column) -> Column:
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def round_cents(value: Column) -> Column:
    """Half to even on the hundredfold value."""
    return F.rint(value * 100.0) / 100.0


def log1p(value: Column) -> Column:
    return F.log1p(value)


def cut(
    value: Column,
    edges: Sequence[float],
    labels: Sequence[str],
    include_lowest: bool = False,
) -> Column:
    """Right-closed binning ``(e0,e1] (e1,e2] ...``; outside gives null."""
    return _bins(value, edges, [F.lit(x) for x in labels], include_lowest)


def cut_index(value: Column, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """Ordinal of :func:`cut`, for sorting category labels."""
    codes = [F.lit(i) for i in range(len(edges) - 1)]
    return _bins(value, edges, codes, include_lowest)


def _bins(value: Column, edges: Sequence[float], out: list[Column], include_lowest: bool) -> Column:
    if len(out) != len(edges) - 1:
        raise ValueError("need one label per interval")
    above = value >= edges[0] if include_lowest else value > edges[0]
    # Spark orders NaN above every number, so an infinite top edge must exclude it.
    inside = above & ~F.isnan(value.cast("double"))
    chain = None
    for upper, label in zip(edges[1:], out):
        hit = inside if math.isinf(upper) else inside & (value <= upper)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def left_closed_bucket(value: Column, buckets: Sequence[tuple[float, float, str]]) -> Column:
    """Label of the ``[low, high)`` bucket that holds the value."""
    chain = None
    for low, high, label in buckets:
        hit = value >= low if math.isinf(high) else (value >= low) & (value < high)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain


def _widened(low: Column, high: Column) -> tuple[Column, Column]:
    flat = low == high
    return F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)


def bin_edge(low: Column, high: Column, bins: int, index: Column) -> Column:
    lo, hi = _widened(low, high)
    return F.when(index == bins, hi).otherwise(index * ((hi - lo) / F.lit(bins)) + lo)


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin over [low, high]; the last bin is closed.

    The arithmetic guess is corrected against the edges, so a value that sits
    on an edge lands right of it whatever the rounding. A zero-width range is
    widened by one half on both sides.
    """
    lo, hi = _widened(low, high)
    guess = F.least(F.floor((value - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1))
    fixed = (
        F.when(value < bin_edge(low, high, bins, guess), guess - 1)
        .when((value >= bin_edge(low, high, bins, guess + 1)) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    return F.when(value.between(lo, hi), fixed.cast("int"))


def bin_label(low: Column, high: Column) -> Column:
    # format_number rounds the exact binary value half to even; %.1f does not.
    one = F.lit("0.0")
    return F.concat(
        F.call_function("format_number", low, one),
        F.lit("-"),
        F.call_function("format_number", high, one),
    )


def quality_status(pct: Column) -> Column:
    return F.when(pct < 1, "ok").when(pct < 5, "warn").otherwise("bad")
