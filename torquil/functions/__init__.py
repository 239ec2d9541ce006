"""Column functions the operators share; all run as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Latin letters with accents and what they fold to.
ACCENTED, FOLDED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"


def seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds between two times, with or without a zone."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def changed(value: Column, previous: Column) -> Column:
    """Null always differs, from null too."""
    return F.coalesce(value != previous, F.lit(True))


def exceeded(gap: Column, limit: float | None) -> Column:
    """Strictly beyond the limit; a missing gap is not, and no limit never is."""
    return F.lit(False) if limit is None else F.coalesce(gap > limit, F.lit(False))


def joined_on(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """left and right's other columns where the keys are the same, null as null."""
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, how=how)
    names = {k: f"__{i}_{k}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    return left.join(renamed, all_of([F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`")) for k, n in names.items()]), how).drop(*names.values())


def cleaned(c: str) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(c), F.col(c))


def folded(text: Column) -> Column:
    return F.translate(text, ACCENTED, FOLDED)


def words(text: Column, least: int = 4) -> Column:
    """Distinct lower-case words of letters and digits with `least` characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(folded(text)), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) >= least))


def first_match(text: Column, patterns: list[tuple[str, str]], other: str | None = None) -> Column:
    """Name of the first of the (pattern, name) that matches."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for p, name in patterns], F.lit(other))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def shortened(text: Column, limit: int) -> Column:
    """White space collapsed; cut at a word's end with an ellipsis if longer than limit."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit), r"\s+\S*$", ""), F.lit("…")))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
