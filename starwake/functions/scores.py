"""Scores and ratios. Rounding is half-even, as in the systems these numbers are compared with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starwake.functions.text import list_or_empty, strip, text_or_empty


def rounded(value: Column, digits: int) -> Column:
    return F.bround(value.cast("double"), digits)


def percent_gain(current: Column, stars: Column) -> Column:
    """Growth in the window relative to the stars before it."""
    return rounded(current / F.greatest(stars - current, F.lit(1)) * 100, 2)


def window_ratio(current: Column, previous: Column) -> Column:
    return rounded(current / F.greatest(previous, F.lit(1)), 4)


def momentum(window_stars: Column, stars: Column) -> Column:
    return rounded(window_stars / F.greatest(stars, F.lit(1)), 4)


def share(part: Column, total: Column) -> Column:
    return rounded(part / F.when(total == 0, F.lit(1)).otherwise(total), 4)


def closeness(left: Column, right: Column) -> Column:
    """Smaller over larger."""
    return rounded(F.least(left, right) / F.greatest(left, right, F.lit(1)), 4)


def popularity(stars: Column, window_stars: Column) -> Column:
    scale = F.least(F.log1p(stars) / 12.0, F.lit(1.0))
    recent = F.least(F.log1p(window_stars) / 8.0, F.lit(1.0))
    return rounded(scale * 0.6 + recent * 0.4, 4)


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(
        left, right, lambda a, b: a.cast("double") * b.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda total, item: total + item)


def cosine(left: Column, right: Column) -> Column:
    """0 for vectors that cannot be compared."""
    norms = F.sqrt(_dot(left, left)) * F.sqrt(_dot(right, right))
    usable = (F.size(left) == F.size(right)) & (F.size(left) > 0)
    return F.when(usable & (norms > 0), _dot(left, right) / norms).otherwise(F.lit(0.0))


def semantic(left: Column, right: Column) -> Column:
    """Cosine moved to [0, 1]; NULL when one side has no vector."""
    moved = (cosine(left, right) + 1.0) / 2.0
    clipped = F.greatest(F.lit(0.0), F.least(moved, F.lit(1.0)))
    return F.when(left.isNotNull() & right.isNotNull(), rounded(clipped, 4))


def long_words(text: Column) -> Column:
    words = F.split(strip(F.lower(text_or_empty(text))), r"\s+")
    return F.array_distinct(F.filter(words, lambda word: F.length(word) >= 4))


def description_overlap(left: Column, right: Column) -> Column:
    """Jaccard similarity of the words of four or more letters."""
    a, b = long_words(left), long_words(right)
    union = F.size(F.array_union(a, b))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, rounded(F.size(F.array_intersect(a, b)) / union, 4)).otherwise(F.lit(0.0))


def lowered(topics: Column) -> Column:
    return F.transform(list_or_empty(topics), lambda topic: F.lower(topic))


def shared_topics(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_intersect(lowered(left), lowered(right)))


def half_up(value: Column) -> Column:
    """Whole number, halves upwards, as the charts draw it."""
    return F.floor(value + 0.5).cast("bigint")
