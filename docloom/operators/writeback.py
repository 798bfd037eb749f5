"""Effects of statements on documents: what a changed table asks to be written, and what is refused.

before and after are (_path, _data) with a column ``row`` that both share (the path at load time; null for a new row).
Effects are judged by comparing the two tables, not by the statement. Nothing is written here: plan() gives the change
set, refusals() what stands against it, and both must be looked at before apply() gives the new table, all or nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.corpus import members_of as members

SYSTEM = ("_path", "_format", "_present")


def cells(docs: DataFrame) -> DataFrame:
    """(row, key, value): the JSON text of each top-level member; an explicit null is 'null'."""
    return docs.select("row", F.explode(members("_data")).alias("key", "v")).select("row", "key", F.to_json("v").alias("value"))


def plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """(row, path, change, key, old, new): created, cleared, renamed, set, null and removed; created and cleared have no key."""
    rows = before.select("row", F.col("_path").alias("old")).join(after.where("row is not null").select("row", F.col("_path").alias("new")), "row", "full")
    none = F.lit(None).cast("string")
    whole = rows.where("new is null").select("row", F.col("old").alias("path"), F.lit("cleared").alias("change"), none.alias("key"), none.alias("old"), none.alias("new"))
    whole = whole.union(after.where("row is null").select("row", "_path", F.lit("created"), none, none, F.col("_data")))
    moved = rows.where("old <> new").select("row", F.col("old").alias("path"), F.lit("renamed").alias("change"), F.lit("_path").alias("key"), "old", "new")
    a, b = cells(before.join(rows.where("new is not null").select("row"), "row", "left_semi")), cells(after.where("row is not null"))
    both = a.withColumnRenamed("value", "old").join(b.withColumnRenamed("value", "new"), ["row", "key"], "full").where("not (old <=> new)")
    change = F.when(F.col("new").isNull(), "removed").when(F.col("new") == "null", "null").otherwise("set")
    at = before.select("row", F.col("_path").alias("path"))
    return whole.union(moved).union(both.withColumn("change", change).join(at, "row").select("row", "path", "change", "key", "old", "new"))


def refusals(changes: DataFrame, before: DataFrame) -> DataFrame:
    """(path, reason) of changes that can't be written: none of a plan is when there is one."""
    ext = lambda c: F.regexp_extract(c, r"(\.[A-Za-z]+)$", 1)
    say = lambda d, reason, path="path": d.select(F.col(path).alias("path"), F.lit(reason).alias("reason"))
    moved = changes.where("change = 'renamed'")
    there = before.select(F.col("_path").alias("new"))
    created = changes.where("change = 'created'")
    other = changes.where("change not in ('renamed', 'created')").select("row").distinct()
    parts = [
        say(changes.where(F.col("key").isin(*SYSTEM) & (F.col("change") != "renamed")), "a system column can't be set"),
        say(moved.where(ext(F.col("old")) != ext(F.col("new"))), "a rename keeps the extension"),
        say(moved.join(there, "new", "left_semi"), "the new path exists"),
        say(moved.groupBy("new").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 1"), "two documents would have one path"),
        say(moved.join(other, "row", "left_semi"), "a rename is the only change of its document"),
        say(created.join(there.withColumnRenamed("new", "path"), "path", "left_semi"), "the new path exists"),
        say(created.where(F.try_parse_json("new").isNull()), "the data isn't JSON"),
        say(changes.where("path = '<stdin>'"), "standard input can't be written"),
    ]
    return reduce(DataFrame.union, parts).distinct()


def set_keys(docs: DataFrame, values: dict, where: Column | None = None) -> DataFrame:
    """docs with keys set in _data, where a condition holds: each to a column of JSON text, or None to remove it."""
    kept = F.map_filter(members("_data"), lambda k, _: ~k.isin(list(values)))
    new = [x for k, v in values.items() if v is not None for x in (F.lit(k), F.parse_json(v))]
    said = F.to_json(F.map_concat(kept, F.create_map(*new)) if new else kept)
    return docs.withColumn("_data", said if where is None else F.when(where, said).otherwise(F.col("_data")))


def apply(changes: DataFrame, before: DataFrame) -> DataFrame:
    """The table (_path, _data) after a plan that nothing refuses. A cleared document keeps its row, with empty data."""
    if not refusals(changes, before).isEmpty():
        raise ValueError("a plan with refusals isn't applied")
    keyed = changes.where("change in ('set', 'null', 'removed')").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("key", "new"))).alias("edits"))  # at most a document's keys
    moved = changes.where("change = 'renamed'").select("row", F.col("new").alias("to"))
    cleared = changes.where("change = 'cleared'").select("row", F.lit(True).alias("gone"))
    d = before.join(keyed, "row", "left").join(moved, "row", "left").join(cleared, "row", "left")
    none = F.create_map().cast("map<string,string>")
    edits = F.coalesce("edits", none)
    kept = F.map_filter(members("_data"), lambda k, _: ~F.map_contains_key(edits, k))
    new = F.transform_values(F.map_filter(edits, lambda _, v: v.isNotNull()), lambda _, v: F.parse_json(v))
    data = F.when(F.col("gone"), "{}").when(F.col("edits").isNull(), F.col("_data")).otherwise(F.to_json(F.map_concat(kept, new)))
    created = changes.where("change = 'created'").select(F.col("path").alias("_path"), F.col("new").alias("_data"))
    return d.select(F.coalesce("to", "_path").alias("_path"), data.alias("_data")).unionByName(created)


def route(changes: DataFrame, owners: dict[str, str]) -> DataFrame:
    """changes with ``home``: the sidecar that owns the key, else the page."""
    known = F.create_map(*(F.lit(x) for kv in owners.items() for x in kv)) if owners else F.create_map().cast("map<string,string>")
    return changes.withColumn("home", F.coalesce(F.element_at(known, F.col("key")), F.col("path")))


def alter(schema: dict, add: dict | None = None, drop: str | None = None, rename: tuple[str, str] | None = None) -> dict:
    """A JSON Schema after ADD, DROP or RENAME of a property; a property that exists already, or doesn't, is refused."""
    props, required = dict(schema.get("properties", {})), list(schema.get("required", []))
    for k, v in (add or {}).items():
        if k in props:
            raise ValueError(f"{k} exists")
        props[k] = v
    if drop is not None:
        if drop not in props:
            raise ValueError(f"no property {drop}")
        del props[drop]
        required = [k for k in required if k != drop]
    if rename is not None:
        old, new = rename
        if old not in props or new in props:
            raise ValueError(f"{old} can't become {new}")
        props = {new if k == old else k: v for k, v in props.items()}
        required = [new if k == old else k for k in required]
    return {**schema, "properties": props, **({"required": required} if required else {})}
