"""Graph patterns over triples (s, p, o) as joins.

A pattern is a list of (s, p, o) whose terms are names or variables (?x); each variable becomes a column. Parts are joined
in the order of how many triples their predicate, or their named ends, leave: the smallest first, then always the smallest
that shares a variable with what is joined. A pattern whose parts share none would be a cross join and is refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _variables(part: tuple) -> list[str]:
    return list(dict.fromkeys(t[1:] for t in part if t.startswith("?")))


def _part(triples: DataFrame, part: tuple) -> DataFrame:
    """The bindings of one part."""
    d = triples.select("s", "p", "o")
    names: dict[str, str] = {}
    for c, t in zip("spo", part, strict=True):
        if not t.startswith("?"):
            d = d.where(F.col(c) == t)
        elif t[1:] in names:
            d = d.where(F.col(c) == F.col(names[t[1:]]))
        else:
            names[t[1:]] = c
    return d.select(*(F.col(c).alias(v) for v, c in names.items())).distinct()


def counts(triples: DataFrame, parts: list[tuple]) -> list[int]:
    """How many triples each part's names leave; one pass over the triples for all parts."""
    hit = lambda part: reduce(Column.__and__, (F.col(c) == t for c, t in zip("spo", part, strict=True) if not t.startswith("?")), F.lit(True))
    return list(triples.agg(*(F.count_if(hit(p)).alias(f"n{i}") for i, p in enumerate(parts))).first())


def order(parts: list[tuple], sizes: list[int]) -> list[tuple]:
    """The parts as they are joined."""
    left, out, bound = sorted(zip(sizes, range(len(parts)), strict=True)), [], set()
    while left:
        k = next((k for k, (_, i) in enumerate(left) if not out or bound & set(_variables(parts[i]))), None)
        if k is None:
            raise ValueError("a pattern's parts must share variables")
        part = parts[left.pop(k)[1]]
        out.append(part)
        bound |= set(_variables(part))
    return out


def basic(triples: DataFrame, parts: list[tuple]) -> DataFrame:
    """A row for each way to bind the variables of all parts."""
    every = order(parts, counts(triples, parts) if len(parts) > 1 else [0])
    d = _part(triples, every[0])
    for part in every[1:]:
        d = d.join(_part(triples, part), [v for v in _variables(part) if v in d.columns])
    return d


def solve(triples: DataFrame, where: list[tuple], optional: list[list[tuple]] = (), union: list[list[tuple]] = (), absent: list[list[tuple]] = (), having: str | None = None, select: list[str] | None = None) -> DataFrame:
    """Distinct bindings (select, or all variables) of a pattern.

    union adds the bindings of any of several patterns, joined on what they share with the first; optional ones add columns
    where they hold; absent ones drop rows for which they hold; having is a SQL condition over the variables. Each of
    these patterns must share a variable with the first, always bound.
    """
    d = basic(triples, where)
    first = list(d.columns)

    def shared(x: DataFrame) -> list[str]:
        if not (on := [c for c in x.columns if c in first]):
            raise ValueError("a pattern must share a variable with the first one")
        return on

    if union:
        ways = [basic(triples, u) for u in union]
        on = [c for c in shared(ways[0]) if all(c in w.columns for w in ways)]
        if not on:
            raise ValueError("the patterns of a union must share a variable")
        d = d.join(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (w.drop(*(c for c in w.columns if c in first and c not in on)) for w in ways)), on)
    for o in optional:
        x = basic(triples, o)
        if new := [c for c in x.columns if c in d.columns and c not in first]:
            raise ValueError(f"{', '.join(new)} would be bound twice")
        d = d.join(x, shared(x), "left")
    for a in absent:
        x = basic(triples, a)
        d = d.join(x, shared(x), "left_anti")
    if having is not None:
        d = d.where(having)
    return d.select(*(select or d.columns)).distinct()
