"""One row for each document: projection, collections, findings, baselines, inference and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import fingerprint, matches_any, quote_ident

SYSTEM = ("_path", "_format", "_present", "_data")
MAX_KEYS = 5_000


def members_of(data: Column | str) -> Column:
    """A JSON object's top-level members as a map to variants; null where it isn't an object."""
    return F.try_variant_get(F.try_parse_json(data), "$", "map<string,variant>")


def json_type(data: Column, key: str) -> Column:
    """Type of a top-level member; null where it is absent, 'VOID' for an explicit null."""
    return F.schema_of_variant(F.element_at(members_of(data), key))


def docs_long(records: DataFrame) -> DataFrame:
    """(_path, key, type, value) of each top-level member but system ones: text as is, 1 and 0 for booleans, numbers that aren't finite as null, arrays and objects as JSON text."""
    d = records.select("_path", F.explode(members_of("_data")).alias("key", "v")).where((F.col("key") != "") & ~F.col("key").isin(*SYSTEM))
    kind = F.schema_of_variant("v")
    text = F.try_variant_get("v", "$", "string")
    value = F.when(kind == "VOID", None).when(kind == "BOOLEAN", F.when(text == "true", "1").otherwise("0")).when(kind == "STRING", text).otherwise(F.to_json("v"))
    plain = F.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "DOUBLE").when(kind.startswith("ARRAY"), "ARRAY").when(kind.startswith("OBJECT"), "OBJECT").otherwise(kind)
    return d.select("_path", "key", plain.alias("type"), value.alias("value"))


def build_docs(records: DataFrame, keys: dict[str, str] | list[str] | None = None) -> DataFrame:
    """(_path, _format, _present, _data) with a column for each top-level key of _data, sorted.

    A key whose values are all whole numbers is a long, all numbers a double, all booleans 1 or 0; others are text (see
    docs_long). Keys and their types are found in one pass, or given. Beyond MAX_KEYS keys a table has too many columns:
    docs_long holds the same cells as rows.
    """
    if keys is None:
        found = docs_long(records).select("key", "type").distinct().limit(7 * MAX_KEYS + 1).collect()  # seven types at most
        types: dict[str, set] = {}
        for x in found:
            types.setdefault(x["key"], set()).update({x["type"]} - {"VOID"})
        if len(types) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} keys; use docs_long")
        keys = {k: "long" if t == {"BIGINT"} else "double" if t and t <= {"BIGINT", "DOUBLE"} else "int" if t == {"BOOLEAN"} else "string" for k, t in types.items()}
    elif not isinstance(keys, dict):
        keys = dict.fromkeys(keys, "string")
    m = members_of("_data")

    def cell(k: str, kind: str) -> Column:
        v = F.element_at(m, k)
        t, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
        value = F.when(v.isNull() | (t == "VOID"), None).when(t == "BOOLEAN", F.when(text == "true", "1").otherwise("0")).when(t == "STRING", text).otherwise(F.to_json(v))
        return value.cast(kind).alias(k)

    return records.select(*SYSTEM, *(cell(k, keys[k]) for k in sorted(keys)))


def members(docs: DataFrame, collections: dict[str, tuple[list[str], list[str]]], path: str = "_path") -> DataFrame:
    """(collection, path) of each collection's include and exclude globs; a document may be in several."""
    tests = [F.when(matches_any(F.col(path), inc) & ~matches_any(F.col(path), exc), F.lit(name)) for name, (inc, exc) in collections.items()]
    return docs.select(F.explode(F.array_compact(F.array(*tests))).alias("collection"), F.col(path).alias("path"))


def findings(rows: DataFrame, check: str) -> DataFrame:
    """Rows of a check as (path, line, key, message, keyword); without a message the other columns make it."""
    if "path" not in rows.columns:
        raise ValueError("a check needs a column path")
    extra = [c for c in rows.columns if c not in ("path", "line", "key", "message")]
    made = F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), F.col(quote_ident(c)).cast("string")) for c in extra)) if extra else F.lit("")
    col = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    return rows.select(F.col("path").cast("string").alias("path"), col("line", "int").alias("line"), col("key", "string").alias("key"), F.coalesce(col("message", "string"), made).alias("message"), F.lit(check).alias("keyword"))


def with_fingerprint(found: DataFrame, schema: str = "check") -> DataFrame:
    return found.withColumn("fp", fingerprint(F.lit(schema), F.col("key"), F.col("keyword"), F.col("message")))


def build_baseline(found: DataFrame) -> DataFrame:
    """(path, fp) once each."""
    return with_fingerprint(found).select("path", "fp").distinct()


def apply_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that the baseline doesn't hold."""
    return with_fingerprint(found).join(baseline, ["path", "fp"], "left_anti")


def baseline_counts(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """(recorded, suppressed, stale) in one row."""
    now = with_fingerprint(found).groupBy("path", "fp").agg(F.count(F.lit(1)).alias("n"))
    both = now.join(baseline.withColumn("old", F.lit(1)), ["path", "fp"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.agg(zero(F.sum("old")).alias("recorded"), zero(F.sum(F.when(F.col("old") == 1, F.col("n")))).alias("suppressed"), zero(F.sum(F.when((F.col("old") == 1) & F.col("n").isNull(), 1))).alias("stale"))


def diff_baselines(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, fp, change)."""
    keys = ["path", "fp"]
    return new.join(old, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new, keys, "left_anti").withColumn("change", F.lit("removed")))


def infer_schema(values: DataFrame, files: DataFrame, most: int = 20, share: float = 0.05) -> DataFrame:
    """Of (path, key, type, value) and the table of files: coverage, dominant type, distinct values, and whether they make an enum."""
    by_type = values.groupBy("key", "type").agg(F.count(F.lit(1)).alias("n"))
    top = by_type.groupBy("key").agg(F.max_by("type", F.struct("n", "type")).alias("type"), F.count(F.lit(1)).alias("types"))
    per_key = values.groupBy("key").agg(F.countDistinct("path").alias("files"), F.countDistinct("value").alias("distinct"))
    total = files.agg(F.count(F.lit(1)).alias("total"))
    enum = (F.col("distinct") <= most) & (F.col("distinct") <= share * F.col("total"))
    return per_key.join(top, "key").crossJoin(F.broadcast(total)).select("key", "files", F.round(F.col("files") / F.col("total"), 4).alias("coverage"), "type", "types", "distinct", enum.alias("enum"))  # one row


def dominant_type(values: DataFrame) -> DataFrame:
    """(key, type): the type with strictly the most values, null on a tie."""
    n = values.groupBy("key", "type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("key").orderBy(F.desc("n"))
    r = n.withColumn("r", F.rank().over(w)).where("r = 1")
    return r.groupBy("key").agg(F.when(F.count(F.lit(1)) == 1, F.first("type")).alias("type"))


def diff_snapshots(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): created, cleared or changed rows of two tables with equal columns."""
    cols = [c for c in before.columns if c != key]
    pack = lambda d, n: d.select(F.col(key), F.struct(*cols).alias(n))
    both = pack(before, "a").join(pack(after, "b"), key, "full")
    change = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "cleared").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def last_match(paths: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(path, owner): the last rule whose glob matches."""
    expr = F.lit(None).cast("string")
    for glob, owner in rules:
        expr = F.when(matches_any(F.col("path"), [glob]), F.lit(owner)).otherwise(expr)
    return paths.select("path", expr.alias("owner"))


def merge_sidecar(pages: DataFrame, sidecar: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """Owned fields come from the sidecar; a page that carries one itself is a conflict, and neither value wins."""
    s = sidecar.select(key, *(F.col(c).alias(f"side {c}") for c in owned))
    j = pages.join(s, key, "left")
    pick = [F.when(F.col(c).isNull(), F.col(f"side {c}")).alias(c) if c in owned else F.col(c) for c in pages.columns]
    bad = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in owned)))
    return j.select(*pick, F.array_join(bad, ",").alias("conflicts"))


def suggest(unknown: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """(name, suggestion): the nearest known name within ``most`` edits, ties by name.

    A name is cut into most + 1 parts; within so many edits one part stays whole and moves by at most ``most`` places. So
    names meet by an equi-join on a part, its number and the other's length, and only those are compared. Names shorter
    than most + 1 meet by their lengths.
    """
    n = most + 1
    size = F.char_length(F.col("name"))
    pieces = lambda c, of: F.array(*(F.struct(F.lit(i).alias("i"), F.substr(c, F.floor(of * i / n).cast("int") + 1, (F.floor(of * (i + 1) / n) - F.floor(of * i / n)).cast("int")).alias("part")) for i in range(n)))
    k = known.select("name").distinct().select(F.col("name").alias("k"), size.alias("ksize"), F.explode(pieces(F.col("name"), size)).alias("x")).select("k", "ksize", "x.i", "x.part")
    u = unknown.select("name").distinct().withColumn("size", size).withColumn("ksize", F.explode(F.sequence(F.greatest(F.col("size") - most, F.lit(0)), F.col("size") + most)))
    place = lambda i: F.floor(F.col("ksize") * i / n).cast("int")
    each = F.array(*(F.struct(F.lit(i).alias("i"), (place(i) + F.lit(shift)).alias("at"), (place(i + 1) - place(i)).alias("len")) for i in range(n) for shift in range(-most, most + 1)))
    u = u.select("name", "ksize", F.explode(each).alias("x")).where("x.at >= 0").select("name", "ksize", F.col("x.i").alias("i"), F.substr("name", F.col("x.at") + 1, F.col("x.len")).alias("part")).distinct()
    d = u.join(k, ["ksize", "i", "part"]).select("name", "k").distinct().withColumn("d", F.levenshtein("name", "k")).where(F.col("d") <= most)
    return d.groupBy("name").agg(F.min_by("k", F.struct("d", "k")).alias("suggestion"))
