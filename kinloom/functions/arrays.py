"""Arrays read as sets and multisets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def among(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def only(tokens: Column, words) -> Column:
    """The tokens that are in a word list, sorted: equal as multisets if equal as arrays."""
    return F.array_sort(F.filter(tokens, lambda t: t.isin(*words)))


def without(tokens: Column, words) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*words))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def times(tokens: Column, token: Column) -> Column:
    return F.size(F.filter(tokens, lambda x: x == token))


def inside(a: Column, b: Column) -> Column:
    """Is multiset a strictly contained in b?"""
    return ~same_multiset(a, b) & F.forall(F.array_distinct(a), lambda t: times(a, t) <= times(b, t))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the distinct elements of either that both have; two empty arrays are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def mapped(tokens: Column, table: dict[str, str]) -> Column:
    """Tokens replaced by a table, others kept."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(pairs, t), t))
