"""Findings, triples and tables as files of other tools. Text is rendered by columns; only summaries go through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"error": "error", "warning": "warning", "notice": "note"}


def github(findings: DataFrame) -> DataFrame:
    """(value) workflow annotations of findings (path, line, key, message, keyword)."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    at = F.concat(F.lit("file="), esc(F.col("path")), F.when(F.col("line").isNotNull(), F.concat(F.lit(",line="), "line")).otherwise(""))
    return findings.orderBy("path", "line", "keyword", "message").select(F.concat(F.lit("::error "), at, F.lit(",title="), esc(F.col("keyword")), F.lit("::"), esc(F.coalesce("message", F.lit("")))).alias("value"))


def sarif(findings: DataFrame, tool: str = "docloom") -> DataFrame:
    """(value) one SARIF result a row; sarif_log() wraps them."""
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.orderBy("path", "line", "keyword", "message").select(F.to_json(F.struct(F.col("keyword").alias("ruleId"), F.lit("error").alias("level"), F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def write_sarif(findings: DataFrame, path: str, tool: str = "docloom") -> None:
    """One SARIF log of all findings: a report for people and tools, written by one task, row after row."""
    head = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"' + tool + '"}},"results":['
    spark = findings.sparkSession
    body = sarif(findings).withColumn("n", F.monotonically_increasing_id())
    first = body.agg(F.min("n").alias("first"))
    rows = body.crossJoin(F.broadcast(first)).select((F.col("n") + 1).alias("n"), F.concat(F.when(F.col("n") > F.col("first"), ",").otherwise(""), "value").alias("value"))
    ends = spark.createDataFrame([(0, head), (2**62, "]}]}")], "n long, value string")
    rows.unionByName(ends).orderBy("n").coalesce(1).select("value").write.text(path)


def junit(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(value) one <testcase> for each file (path), with a <failure> for each of its findings."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    said = F.concat(F.lit('<failure type="'), esc(F.col("keyword")), F.lit('" message="'), esc(F.coalesce("message", F.lit(""))), F.lit('"/>'))
    per = findings.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(said)), "").alias("fails"))
    return files.select("path").distinct().join(per, "path", "left").orderBy("path").select(F.concat(F.lit('<testcase name="'), esc(F.col("path")), F.when(F.col("fails").isNull(), F.lit('"/>')).otherwise(F.concat(F.lit('">'), "fails", F.lit("</testcase>")))).alias("value"))


def report(rows: DataFrame, kind: str, path: str) -> None:
    """Query rows as csv or json files; "pretty" is for show()."""
    {"csv": lambda: rows.write.option("header", True).csv(path), "json": lambda: rows.write.json(path)}[kind]()


def export(tables: dict[str, DataFrame], path: str) -> None:
    """Each table or view as a Parquet folder below a path."""
    for name, d in tables.items():
        d.write.parquet(f"{path}/{name}")


def search_index(entries: DataFrame, path: str) -> None:
    """Search entries (id, type, title, .., language) as JSON lines, a folder for each language; without one: und."""
    entries.withColumn("language", F.coalesce(F.when(F.col("language") != "", F.col("language")), F.lit("und"))).write.partitionBy("language").json(path)


def llms_txt(pages: DataFrame, title: str, summary: str = "") -> DataFrame:
    """(value) lines of an llms.txt: a title, then pages (section, title, url, description) as lists by section."""
    line: Column = F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")"), F.when(F.col("description") != "", F.concat(F.lit(": "), "description")).otherwise(""))
    items = pages.select("section", F.lit(1).alias("o"), F.col("title").alias("t"), line.alias("value"))
    heads = pages.select("section").distinct().select("section", F.lit(0).alias("o"), F.lit("").alias("t"), F.concat(F.lit("## "), "section").alias("value"))
    top = pages.sparkSession.createDataFrame([("", -1, "", f"# {title}" + (f"\n\n> {summary}" if summary else ""))], "section string, o int, t string, value string")
    return top.unionByName(heads).unionByName(items).orderBy("section", "o", "t", "value").select("value")
