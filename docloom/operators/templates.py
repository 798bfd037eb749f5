"""Pages against templates: which template, how sections align, and the rules of each kind of node.

nodes and sections come from docloom.sources.structure. A template is {"sections": [rule, ..]}; a rule has "name" (the
heading it wants, or None for any), "pattern" (of the heading), "required", "repeat", "sections" (rules for the sections
inside), and "content": rules for nodes of a kind with "min", "max" and tests. Findings are (path, section, rule, message).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.batches import pieces, table

MATCH, COERCE, MISS = 0, 1, 2


def resolve(docs: DataFrame, index: dict[str, str], config: list[tuple[str, str]]) -> DataFrame:
    """(path, template, source): the page's own $template, else its type in the index, else the first glob of the configuration."""
    from docloom.functions.text import matches_any

    own = F.get_json_object("_data", "$['$template']")
    known = F.create_map(*(F.lit(x) for k, v in index.items() for x in (k.lower(), v))) if index else F.create_map().cast("map<string,string>")
    typed = F.element_at(known, F.lower(F.get_json_object("_data", "$.type")))
    rest = F.lit(None).cast("string")
    for glob, name in reversed(config):
        rest = F.when(matches_any(F.col("_path"), [glob]), F.lit(name)).otherwise(rest)
    source = F.when(own.isNotNull(), "page").when(typed.isNotNull(), "type").when(rest.isNotNull(), "config")
    return docs.select(F.col("_path").alias("path"), F.coalesce(own, typed, rest).alias("template"), source.alias("source")).where("template is not null")


def align_titles(titles: list[str], rules: list[dict]) -> list[tuple[int | None, int | None]]:
    """(rule, title) pairs of least cost: a match 0, a rule on a heading it rejects 1, a required rule without a heading or a heading without a rule 2. A repeating rule takes several; ties go to a match, then to the earlier rule."""
    n, m = len(rules), len(titles)
    fits = [[_fits(r, t) for t in titles] for r in rules]
    best: dict[tuple[int, int], tuple] = {(n, m): (0, 0, None)}
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            if (i, j) == (n, m):
                continue
            options = []
            if j < m:
                options.append((MISS + best[i, j + 1][0], 3, ("extra", i, j + 1)))
            if i < n:
                options.append(((MISS if rules[i].get("required", True) else 0) + best[i + 1, j][0], 2, ("miss", i + 1, j)))
                if j < m:
                    cost, rank = (MATCH, 0) if fits[i][j] else (COERCE, 1)
                    options.append((cost + best[i + 1, j + 1][0], rank, ("take", i + 1, j + 1)))
            best[i, j] = min(options)
            if i < n and j < m and rules[i].get("repeat") and fits[i][j]:  # stays for the next heading, which must match too
                more = 0 if j + 1 < m and fits[i][j + 1] else None
                if more is not None and best[i, j + 1][2][0] in ("take", "again"):
                    best[i, j] = min(best[i, j], (MATCH + best[i, j + 1][0], 0, ("again", i, j + 1)))
    out, i, j = [], 0, 0
    while (i, j) != (n, m):
        what, a, b = best[i, j][2]
        out.append((i if what != "extra" else None, j if what != "miss" else None))
        i, j = a, b
    return out


def _fits(rule: dict, title: str) -> bool:
    name, pattern = rule.get("name"), rule.get("pattern")
    return name is None and not pattern or name is not None and name.lower() == title.lower() or bool(pattern and re.search(pattern, title))


def align_tree(rules: list[dict], tops: list[int], titles: dict[int, str], below: dict[int, list[int]], prefix: str = "") -> list[tuple[str | None, int | None, str]]:
    """(rule, section, status) of sections and, below each that a rule takes, of its own sections by the rule's own rules; a rule is named by the places of its holders and its own, as 0/2."""
    out = []
    for i, j in align_titles([titles[x] for x in tops], rules):
        r, at = None if i is None else rules[i], None if j is None else tops[j]
        if at is None and not r.get("required", True):
            continue
        status = "unexpected" if r is None else "missing" if at is None else "match" if _fits(r, titles[at]) else "coerced"
        name = None if i is None else f"{prefix}{i}"
        out.append((name, at, status))
        if r is not None and at is not None and "sections" in r:
            out += align_tree(r["sections"], below.get(at, []), titles, below, f"{name}/")
    return out


def align(sections: DataFrame, assigned: DataFrame, templates: dict[str, dict], level: int = 2) -> DataFrame:
    """(path, template, rule, section, title, status) of each page's sections from a level on, by rules and the rules inside them: match, coerced, missing or unexpected.

    Sections below a missing or unexpected one aren't looked at. A page's headings are one row, as they are few, and a task
    aligns the rows as they come.
    """
    s = sections.where(F.col("level") >= level).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("section", "title", "level", "parent"))).alias("heads"))
    d = assigned.select("path", "template").distinct().join(s, "path", "left")
    d = d.select("path", "template", *(F.coalesce(F.col(f"heads.{c}"), F.array().cast(f"array<{t}>")).alias(c) for c, t in (("section", "int"), ("title", "string"), ("level", "int"), ("parent", "int"))))
    names, text = ("path", "template", "rule", "section", "title", "status"), pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "path"):
            out = []
            for path, template, at, said, levels, parents in zip(*(c.to_pylist() for c in b.columns), strict=True):
                titles = {x: t or "" for x, t in zip(at, said, strict=True)}
                below: dict[int, list[int]] = {}
                tops = []
                for x, deep, parent in zip(at, levels, parents, strict=True):
                    if deep == level:
                        tops.append(x)
                    elif parent is not None:
                        below.setdefault(parent, []).append(x)
                out += [(path, template, r, x, titles.get(x), status) for r, x, status in align_tree(templates.get(template, {}).get("sections", []), tops, titles, below)]
            yield table(out, names, (text, text, text, pa.int32(), text, text))

    return d.mapInArrow(run, "path string, template string, rule string, section int, title string, status string")


def rules_of(templates: dict[str, dict]) -> list[tuple[str, str, dict]]:
    """(template, rule, the rule itself) of all rules, those inside others too."""
    out: list[tuple[str, str, dict]] = []

    def add(name: str, rules: list[dict], prefix: str) -> None:
        for i, r in enumerate(rules):
            out.append((name, f"{prefix}{i}", r))
            add(name, r.get("sections", []), f"{prefix}{i}/")

    for name, t in templates.items():
        add(name, t.get("sections", []), "")
    return out


def in_sections(nodes: DataFrame) -> DataFrame:
    """nodes with ``section``: the headings of the page so far; 0 before the first."""
    w = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("section", F.count_if(F.col("kind") == "heading").over(w).cast("int"))


def _tests(rule: dict) -> dict[str, Column]:
    """What a node of a rule's kind must satisfy, by the name of the test."""
    a, out = F.col("attrs"), {}
    if "pattern" in rule:
        out["pattern"] = F.col("text").rlike(rule["pattern"])
    if "language" in rule:
        out["language"] = F.coalesce(a["language"].isin(rule["language"]), F.lit(False))
    if "ordered" in rule:
        out["ordered"] = a["ordered"] == str(rule["ordered"]).lower()
    if "min_items" in rule:
        out["min_items"] = a["items"].cast("int") >= rule["min_items"]
    if "max_items" in rule:
        out["max_items"] = a["items"].cast("int") <= rule["max_items"]
    if "header" in rule:
        out["header"] = a["header"] == "|".join(rule["header"])
    if "variant" in rule:
        out["variant"] = a["variant"] == rule["variant"]
    if "url" in rule:
        out["url"] = F.col("target").rlike(rule["url"])
    if "alt" in rule:
        out["alt"] = F.coalesce(F.col("text").rlike(rule["alt"]), F.lit(False))
    if "tag" in rule:
        out["tag"] = F.col("text") == rule["tag"]
    for k, v in rule.get("attributes", {}).items():
        out[f"attribute {k}"] = F.coalesce(a[k] == v, F.lit(False))
    return out


def check_content(nodes: DataFrame, aligned: DataFrame, templates: dict[str, dict]) -> DataFrame:
    """(path, section, rule, message): counts (at least 1 where neither min nor max is given) and tests of the nodes in each aligned section.

    Kinds: paragraph, code, list, table, admonition, image, blockquote, deflist, element. A code rule's "language" with
    "narrow" counts only blocks of that language. Nodes are joined once with the sections of all
    templates; every rule is a conditional aggregate of its section.
    """
    rules = [(name, i, c, f"{c['kind']} {k}") for name, i, r in rules_of(templates) for k, c in enumerate(r.get("content", []))]
    own = aligned.where("section is not null").select("path", "section", "template", F.col("rule").cast("string").alias("rule"))
    rows = []
    for name, i, c, label in rules:
        mine = (F.col("template") == name) & (F.col("rule") == i)
        here, tests = F.coalesce(F.col("kind") == c["kind"], F.lit(False)), _tests(c)
        if c.get("narrow") or c["kind"] in ("image", "element", "admonition"):  # the tests say which nodes count
            here, tests = reduce(Column.__and__, tests.values(), here), {}
        here = mine & here
        say = lambda broken, *words: rows.append(F.when(broken, F.struct(F.lit(label).alias("rule"), F.concat(*words).alias("message"))))  # noqa: B023, E731
        n, least = F.count_if(here), c.get("min", 0 if "max" in c else 1)
        say(mine & (n < least), F.lit(f"at least {least}, found "), n)
        if "max" in c:
            say(mine & (n > c["max"]), F.lit(f"at most {c['max']}, found "), n)
        for test, ok in tests.items():
            bad = F.count_if(here & ~F.coalesce(ok, F.lit(False)))
            say(mine & (bad > 0), F.lit(f"{test}: "), bad, F.lit(" fail"))
    if not rows:
        return own.select("path", "section", F.lit("").alias("rule"), F.lit("").alias("message")).where("false")
    g = own.join(in_sections(nodes), ["path", "section"], "left").groupBy("path", "section", "template", "rule").agg(F.array_compact(F.array(*rows)).alias("x"))
    return g.select("path", "section", F.explode("x").alias("x")).select("path", "section", "x.*")


def check_sequence(nodes: DataFrame, kinds: list[str], contains: bool = False) -> DataFrame:
    """(path, section) of sections whose runs of kinds aren't the sequence; with ``contains``, that don't hold it in order. Neighbours of one kind are one run; items, links and images inside blocks don't count."""
    d = in_sections(nodes).where(~F.col("kind").isin("heading", "item", "link", "image"))
    w = Window.partitionBy("path", "section").orderBy("seq")
    runs = d.withColumn("before", F.lag("kind").over(w)).where("before is null or before <> kind")
    g = runs.groupBy("path", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"]).alias("ks"))  # the runs of one section
    said, want = F.array_join("ks", ","), ",".join(kinds)
    if not contains:
        return g.where(said != want).select("path", "section")
    return g.where(~F.concat(F.lit(","), said, F.lit(",")).rlike("," + ",(.*,)?".join(map(re.escape, kinds)) + ",")).select("path", "section")


def infer(sections: DataFrame, level: int = 2, required: float = 0.9, kept: float = 0.25) -> DataFrame:
    """(slug, title, share, required, repeat, place) of the sections of a level that a share of pages have: rules of a template, in order of their usual place."""
    s = sections.where(F.col("level") == level).withColumn("base", F.regexp_replace("slug", r"-\d+$", ""))
    pages = sections.agg(F.countDistinct("path").alias("pages"))
    w = Window.partitionBy("path").orderBy("section")
    per = s.withColumn("nth", F.row_number().over(w)).groupBy("path", "base").agg(F.min("title").alias("title"), F.min("nth").alias("nth"), F.count(F.lit(1)).alias("n"))
    g = per.groupBy(F.col("base").alias("slug")).agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("files"), F.max("n").alias("n"), F.avg("nth").alias("place"))
    share = F.col("files") / F.col("pages")
    return g.crossJoin(F.broadcast(pages)).where(share >= kept).select("slug", "title", F.round(share, 4).alias("share"), (share >= required).alias("required"), (F.col("n") > 1).alias("repeat"), F.round("place", 4).alias("place"))
