"""Validation of documents by JSON Schemas: which schemas apply, and what their keywords find.

docs have _path and _data (JSON text). A schema is a dict, compiled to an expression over the parsed data (schema.Compiler),
so that one scan tests all documents. Findings are (path, schema, pointer, keyword, message).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import matches_any
from docloom.operators.schema import PENDING, Compiler, error, nothing
from docloom.plans.lineage import cut

def resolve_schemas(docs: DataFrame, cli: list[str], overrides: list[dict], config: list[str], defaults: list[str], trust: bool = True) -> DataFrame:
    """(_path, schema, source): the command's schemas; else the document's own $schema, unless not trusted; else the first matching override that has schemas; else the configuration's; else the defaults.

    An override is {"paths": globs, "schemas": names}, and adds to the configuration's schemas with "defaults": True.
    """
    own = F.get_json_object("_data", "$['$schema']")
    said = lambda names, source: F.struct(F.array(*map(F.lit, names)).cast("array<string>").alias("schemas"), F.lit(source).alias("source"))
    rest = said(config, "config") if config else said(defaults, "default")
    for i, o in reversed(list(enumerate(overrides))):
        if o.get("schemas"):
            names = list(dict.fromkeys([*(config if o.get("defaults") else []), *o["schemas"]]))
            rest = F.when(matches_any(F.col("_path"), o["paths"]), said(names, f"override {i}")).otherwise(rest)
    if trust:
        rest = F.when(own.isNotNull(), F.struct(F.array(own).alias("schemas"), F.lit("document").alias("source"))).otherwise(rest)
    pick = said(cli, "command") if cli else rest
    return docs.select("_path", pick.alias("x")).select("_path", F.explode("x.schemas").alias("schema"), "x.source")


def validate(docs: DataFrame, schemas: dict[str, dict], assigned: DataFrame | None = None) -> DataFrame:
    """(path, schema, pointer, keyword, message) of each keyword that a document breaks; without ``assigned`` (_path, schema) all schemas apply to all.

    Data that isn't JSON breaks the keyword "parse". An unknown schema name in ``assigned`` breaks "schema". Keywords and
    formats that aren't supported are refused. A schema that refers to itself takes a round for each level of the data.
    """
    c = Compiler(schemas)
    d = docs.select(F.col("_path").alias("path"), F.try_parse_json("_data").alias("v"))
    if assigned is not None:
        d = d.join(assigned.select(F.col("_path").alias("path"), "schema"), "path")
    else:
        d = d.withColumn("schema", F.explode(F.array(*map(F.lit, schemas))))
    own = lambda keyword, message: F.array(error(F.lit(""), keyword, message))
    pick = own("schema", F.concat(F.lit("unknown schema "), "schema"))
    for name in schemas:
        pick = F.when(F.col("schema") == name, F.when(F.col("v").isNull(), own("parse", "must be JSON")).otherwise(c.errors(name, F.col("v")))).otherwise(pick)
    found = d.select("path", "schema", F.explode(pick).alias("x")).select("path", "schema", "x.*")
    if not c.pending:
        return found.drop("value")
    out = []
    while True:
        found = cut(found)
        out.append(found.where(F.col("keyword") != PENDING).drop("value"))
        wait = found.where(F.col("keyword") == PENDING)
        if wait.isEmpty():
            return reduce(DataFrame.union, out)
        pick = nothing()
        for key in list(c.pending):
            pick = F.when(F.col("message") == key, c.errors(key, F.col("value"), F.col("pointer"))).otherwise(pick)
        found = wait.select("path", "schema", F.explode(pick).alias("x")).select("path", "schema", "x.*")


def run_checks(docs: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Findings of named SQL checks over one view ``docs``; a row whose path isn't loaded is a finding of its own."""
    from docloom.operators.corpus import findings
    from docloom.operators.sqlguard import run

    docs.createOrReplaceTempView("docs")
    loaded = docs.select(F.col("_path").alias("path")).distinct()
    out = []
    for name, text in checks.items():
        rows = findings(run(docs.sparkSession, text, {}), name)
        lost = rows.join(loaded, "path", "left_anti").select("path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("key"), F.lit("names a document that isn't loaded").alias("message"), F.lit(name).alias("keyword"))
        out.append(rows.join(loaded, "path", "left_semi").select(*lost.columns).unionByName(lost))
    return reduce(DataFrame.unionByName, out)


def staleness(values: DataFrame) -> DataFrame:
    """(.., state) of asserted and derived, arrays of text: unknown, unset, current or stale; order doesn't count."""
    same = F.array_sort("asserted") == F.array_sort("derived")
    return values.withColumn("state", F.when(F.col("derived").isNull(), "unknown").when(F.col("asserted").isNull(), "unset").when(same, "current").otherwise("stale"))


def derive_fields(evidence: DataFrame, order: dict[str, list[str]]) -> DataFrame:
    """(path, field, value, source) from evidence (path, field, source, value): the first source in the field's order that has a value."""
    rank = F.lit(None).cast("int")
    for field, sources in order.items():
        for i, s in enumerate(sources):
            rank = F.when((F.col("field") == field) & (F.col("source") == s), F.lit(i)).otherwise(rank)
    e = evidence.where("value is not null").withColumn("rank", rank).where("rank is not null")
    return e.groupBy("path", "field").agg(F.min_by(F.struct("value", "source"), F.struct("rank", "value")).alias("x")).select("path", "field", "x.value", "x.source")


def fill(proposals: DataFrame, schema: dict, least: float = 0.7) -> DataFrame:
    """(path, key, value, confidence): of proposals (path, key, value JSON, confidence) the surest of each key that is declared, sure enough and valid by its own schema."""
    best = proposals.where(F.col("confidence") >= least).groupBy("path", "key").agg(F.max_by("value", F.struct("confidence", "value")).alias("value"), F.max("confidence").alias("confidence"))
    c, ok = Compiler({"": schema}), F.lit(False)
    for k, below in schema.get("properties", {}).items():
        v = F.try_parse_json("value")
        ok = F.when(F.col("key") == k, v.isNotNull() & c.valid(below, v, "")).otherwise(ok)
    return best.where(ok)


def misplaced(docs: DataFrame, owners: dict[str, str]) -> DataFrame:
    """(path, key, home): keys that a page carries though a sidecar owns them."""
    keys = docs.select(F.col("_path").alias("path"), F.explode(F.json_object_keys("_data")).alias("key"))
    home = F.element_at(F.create_map(*(F.lit(x) for kv in owners.items() for x in kv)), F.col("key"))
    return keys.withColumn("home", home).where("home is not null")
