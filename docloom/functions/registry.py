"""Functions for SQL texts, and registries of what users may add: parsers of structure, graders of sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from docloom.operators import traces
from docloom.sources import structure

#: Temporary SQL functions: their signature and their body, which the optimizer sees through.
SQL = {
    "line_for(lines MAP<STRING, INT>, k STRING) RETURNS INT": "element_at(lines, k)",
    "explicit_null() RETURNS STRING": "'null'",
    "slug(t STRING) RETURNS STRING": "regexp_replace(regexp_replace(lower(t), '[^\\\\p{L}\\\\p{N}]+', '-'), '^-+|-+$', '')",
    "pin(t STRING, first INT, last INT) RETURNS STRING": "sha2(array_join(slice(split(replace(t, '\\r\\n', '\\n'), '\\n'), first, last - first + 1), '\\n'), 256)",
}


def register(spark: SparkSession) -> None:
    """Makes the SQL functions known to a session."""
    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def add_parser(extension: str, parse: Callable[[str], list[tuple]]) -> None:
    """A parser of a text to nodes (kind, level, text, target, line, last, attrs) for files of an extension; one that exists is refused."""
    if extension in structure.PARSERS:
        raise ValueError(f"{extension} has a parser")
    structure.PARSERS[extension] = parse


def add_grader(kind: str, make: Callable[[dict], tuple[Column, Column]]) -> None:
    """A kind of grader: from its options, (outcome, detail) as aggregates over a session's events; one that exists is refused."""
    if kind in traces.GRADERS:
        raise ValueError(f"{kind} exists")
    traces.GRADERS[kind] = make
