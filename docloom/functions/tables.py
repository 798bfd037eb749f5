"""Table functions for SQL: parts of texts, and sections of lines. register() gives them to a session.

    select * from split_body(table(docs), 12000)         docs: text and any other columns, which are repeated
    select * from line_sections(table(lines))            lines: path, n, line of Markdown; partitioned by path and ordered by itself
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, Row, StringType, StructField, StructType

HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def _fields(table: AnalyzeArgument, *wanted: str) -> list[StructField]:
    if not table.isTable:
        raise ValueError("a table argument is needed")
    fields = table.dataType.fields
    if missing := [w for w in wanted if w not in {f.name for f in fields}]:
        raise ValueError(f"the table has no {', '.join(missing)}")
    return fields


class SplitBody:
    """Each row once for each part of its text: the other columns, part and text. Null texts have no rows."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        kept = [f for f in _fields(docs, "text") if f.name != "text"]
        return AnalyzeResult(StructType([*kept, StructField("part", IntegerType()), StructField("text", StringType())]))

    def eval(self, docs: Row, most: int = 12_000):
        from docloom.sources.structure import cut_lines

        if docs["text"] is not None:
            own = [v for k, v in docs.asDict().items() if k != "text"]
            for i, x in enumerate(cut_lines(docs["text"], most)):
                yield (*own, i, x)


class LineSections:
    """(path, section, level, title, first, last) of each heading, from lines in order; only the open section is held. Headings inside fences are none."""

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        path = next(f for f in _fields(lines, "path", "n", "line") if f.name == "path")
        schema = StructType([path, *(StructField(c, IntegerType()) for c in ("section", "level")), StructField("title", StringType()), *(StructField(c, IntegerType()) for c in ("first", "last"))])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("path")], orderBy=[OrderingColumn("n")])

    def __init__(self):
        self.open, self.count, self.last, self.fence = None, 0, 0, None

    def eval(self, lines: Row):
        line, n = lines["line"] or "", int(lines["n"])
        f = FENCE.match(line)
        if self.fence is not None:
            if f and f[1][0] == self.fence[0] and len(f[1]) >= len(self.fence) and not line.strip().strip(self.fence[0]):
                self.fence = None
        elif f:
            self.fence = f[1]
        elif h := HEADING.match(line):
            if self.open is not None:
                yield (*self.open, n - 1)
            self.count += 1
            self.open = (lines["path"], self.count, len(h[1]), (h[2] or "").strip(), n)
        self.last = n

    def terminate(self):
        if self.open is not None:
            yield (*self.open, self.last)


NAMES = {"split_body": SplitBody, "line_sections": LineSections}


def register(spark: SparkSession) -> None:
    for name, cls in NAMES.items():
        spark.udtf.register(name, udtf(cls))
