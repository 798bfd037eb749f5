"""Rules over audiences, personas and journeys, each a DataFrame of findings (rule, file, line, id, value).

records: idx, file, line, type, id, parents (array), lifecycle. references: page, line, type, value (names on pages).
steps: record (idx), position, page (path or null), written, verified, changed (days or null). Ids fold by lower(); the
first record of a type with an id is the one that references resolve to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARENT = {"persona": "audience", "journey": "persona"}
LIVE = "coalesce(lifecycle, '') not in ('draft', 'archived')"


def _found(d: DataFrame, rule: str, value: str = "value") -> DataFrame:
    of = lambda c, kind: F.col(c).cast(kind) if c in d.columns else F.lit(None).cast(kind)
    return d.select(F.lit(rule).alias("rule"), of("file", "string").alias("file"), of("line", "int").alias("line"), of("id", "string").alias("id"), of(value, "string").alias("value"))


def _first(records: DataFrame) -> DataFrame:
    """(kind, key, target) of the record that a name of a type resolves to."""
    return records.groupBy(F.col("type").alias("kind"), F.lower("id").alias("key")).agg(F.min("idx").alias("target"))


def _kinds(records: DataFrame) -> DataFrame:
    return records.select(F.col("type").alias("there")).distinct()


def parents(records: DataFrame) -> DataFrame:
    """(idx, file, line, id, type, wanted, value, target) of each parent value; target is null where it names none."""
    wanted = F.element_at(F.create_map(*(F.lit(x) for kv in PARENT.items() for x in kv)), F.col("type"))
    p = records.where("type <> 'audience'").select("idx", "file", "line", "id", "type", wanted.alias("wanted"), F.explode("parents").alias("value"))
    return p.join(_first(records), (F.col("wanted") == F.col("kind")) & (F.lower("value") == F.col("key")), "left").drop("kind", "key")


def undefined_reference(records: DataFrame, references: DataFrame) -> DataFrame:
    """Names on pages, and parents, that no record of the type has; types without any record aren't judged."""
    r = references.select(F.col("page").alias("file"), "line", F.lit(None).cast("string").alias("id"), F.col("type").alias("wanted"), "value")
    r = r.join(_first(records), (F.col("wanted") == F.col("kind")) & (F.lower("value") == F.col("key")), "left_anti")
    p = parents(records).where("target is null").select("file", "line", "id", "wanted", "value")
    d = r.unionByName(p)
    return _found(d.join(_kinds(records), F.col("wanted") == F.col("there"), "left_semi"), "undefined-reference")


def duplicate_id(records: DataFrame) -> DataFrame:
    n = records.groupBy(F.lower("id").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _found(records.join(n, F.lower("id") == F.col("k"), "left_semi"), "duplicate-id", "id")


def missing_parent(records: DataFrame, references: DataFrame) -> DataFrame:
    """Pages that name a journey or persona and none of its parents: once for each set of parents, at the first such name."""
    named = references.select("page", F.col("type").alias("kind"), F.lower("value").alias("key"), "line", "value").join(_first(records), ["kind", "key"]).where("kind <> 'audience'")
    up = parents(records).where("target is not null").select(F.col("idx").alias("child"), "wanted", F.col("target").alias("parent")).distinct()
    ids = records.select(F.col("idx").alias("pidx"), F.lower("id").alias("pid"))
    sets = up.join(ids, F.col("parent") == F.col("pidx")).groupBy("child", "wanted").agg(F.array_sort(F.collect_set("pid")).alias("pids"))  # a record's parents
    have = references.groupBy(F.col("page").alias("hpage"), F.col("type").alias("htype")).agg(F.collect_set(F.lower("value")).alias("names"))  # a page's names
    j = named.join(sets, F.col("target") == F.col("child")).join(have, (F.col("page") == F.col("hpage")) & (F.col("wanted") == F.col("htype")), "left")
    j = j.where(~F.coalesce(F.arrays_overlap("names", "pids"), F.lit(False)))
    d = j.groupBy("page", "wanted", "pids").agg(F.min(F.struct("line", "value")).alias("x"))
    return _found(d.select(F.col("page").alias("file"), "x.line", F.array_join("pids", ",").alias("value")), "missing-parent")


def orphan_record(records: DataFrame) -> DataFrame:
    wanted = F.element_at(F.create_map(*(F.lit(x) for kv in PARENT.items() for x in kv)), F.col("type"))
    d = records.where("type <> 'audience' and coalesce(size(parents), 0) <= 0").withColumn("wanted", wanted)
    return _found(d.join(_kinds(records), F.col("wanted") == F.col("there"), "left_semi"), "orphan-record", "wanted")


def _resolved(records: DataFrame) -> DataFrame:
    return records.join(_first(records).select(F.col("target").alias("idx")), "idx", "left_semi")


def _naming(records: DataFrame, references: DataFrame) -> DataFrame:
    """(idx, page): the pages that name a record."""
    r = references.select("page", F.col("type").alias("kind"), F.lower("value").alias("key"))
    return r.join(_first(records), ["kind", "key"]).select(F.col("target").alias("idx"), "page").distinct()


def unserved_journey(records: DataFrame, references: DataFrame) -> DataFrame:
    d = _resolved(records).where(f"type = 'journey' and {LIVE}")
    return _found(d.join(_naming(records, references), "idx", "left_anti"), "unserved-journey", "id")


def unused_record(records: DataFrame, references: DataFrame) -> DataFrame:
    used = _naming(records, references).select("idx").union(parents(records).where("target is not null").select("target"))
    return _found(_resolved(records).where("type <> 'journey'").join(used.distinct(), "idx", "left_anti"), "unused-record", "id")


def step_findings(records: DataFrame, steps: DataFrame, references: DataFrame) -> DataFrame:
    """Of live journeys: a step whose page doesn't exist (broken), isn't written, or changed since it was verified (stale), and a page of a step that doesn't name the journey."""
    live = records.where(f"type = 'journey' and {LIVE}").select("idx", "file", "line", "id")
    s = steps.join(live, F.col("record") == F.col("idx"))
    state = F.when(F.col("page").isNull(), "broken-step").when(~F.col("written"), "unwritten-step").when(F.col("changed") > F.col("verified"), "stale-step")
    found = s.withColumn("state", state).where("state is not null").select(F.col("state").alias("rule"), "file", F.col("line").cast("int").alias("line"), "id", F.col("position").cast("string").alias("value"))
    silent = s.where("page is not null and written").join(_naming(records, references), ["idx", "page"], "left_anti")
    return found.unionByName(_found(silent.drop("file").withColumn("file", F.col("page")), "missing-journey", "id"))


def check(records: DataFrame, references: DataFrame, steps: DataFrame) -> DataFrame:
    """All findings in order of file, line, rule and value."""
    parts = [undefined_reference(records, references), duplicate_id(records), missing_parent(records, references), orphan_record(records), unserved_journey(records, references), unused_record(records, references), step_findings(records, steps, references)]
    return reduce(DataFrame.unionByName, parts).orderBy("file", F.coalesce("line", F.lit(0)), "rule", "value")


def impact(findings: DataFrame, naming: DataFrame, records: DataFrame) -> DataFrame:
    """(id, type, live, errors, warnings) of the records that pages with findings (file, severity) serve, live ones first."""
    j = findings.join(naming, findings.file == naming.page).join(records.select("idx", "id", "type", F.expr(LIVE).alias("live")), "idx")
    return j.groupBy("id", "type", "live").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).orderBy(F.desc("live"), F.desc("errors"), "id")
