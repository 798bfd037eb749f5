"""Glossary rules over one table of terms, each a DataFrame of findings (rule, file, line, id, value, other).

terms: idx long (set order), file, line, id, language, label, alt, hidden (arrays), designations (array of (term, status)),
definition, abstract, see, broader, narrower, related (arrays), matches (array of (kind, iri)). Names fold by lower().
references: file, line, label, language (names on pages). blocks: file, line, label, language, field, value (edges that
pages state). keywords: file, line, label.

Names resolve by joins on tables that hold one row for each folded name, language and kind, so that a name that very
many entries claim multiplies nothing. ``other`` is the idx of the entry a finding names, as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.lineage import cut

RETIRED = ("deprecated", "superseded")
RELATIONS = ("see", "broader", "narrower", "related")
MOST_HOPS = 64


def _finding(d: DataFrame, rule: str, value: Column | str = "value", other: Column | str | None = None) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    of = lambda c, kind: F.col(c).cast(kind) if c in d.columns else F.lit(None).cast(kind)
    return d.select(F.lit(rule).alias("rule"), of("file", "string").alias("file"), of("line", "int").alias("line"), of("id", "string").alias("id"), col(value).cast("string").alias("value"), (F.lit(None) if other is None else col(other)).cast("string").alias("other"))


def _lang(c: Column) -> Column:
    return F.coalesce(F.lower(c), F.lit(""))


def names(terms: DataFrame) -> DataFrame:
    """(idx, lang, kind, value, key) of each label, id and alt-label."""
    t = terms.select("idx", _lang(F.col("language")).alias("lang"), F.explode(F.concat(F.array(F.struct(F.lit("label").alias("kind"), F.col("label").alias("value")), F.struct(F.lit("id").alias("kind"), F.col("id").alias("value"))), F.coalesce(F.transform("alt", lambda a: F.struct(F.lit("alt").alias("kind"), a.alias("value"))), F.array()))).alias("x"))
    return t.select("idx", "lang", "x.*").where("value is not null").withColumn("key", F.lower("value"))


def _firsts(named: DataFrame, *by: str) -> DataFrame:
    """The first entry of each kind that claims a name."""
    kinds = [F.min(F.when(F.col("kind") == k, F.col("idx"))).alias(k) for k in ("label", "id", "alt")]
    return named.groupBy("key", *by).agg(*kinds)


def resolve_references(refs: DataFrame, terms: DataFrame) -> DataFrame:
    """refs (.., language, value) with target: a label of the language, then an id of it, then any label, then any id."""
    n = names(terms).where("kind <> 'alt'")
    own = _firsts(n, "lang").select(F.col("key").alias("k1"), F.col("lang").alias("l1"), F.col("label").alias("label1"), F.col("id").alias("id1"))
    every = _firsts(n).select(F.col("key").alias("k2"), F.col("label").alias("label2"), F.col("id").alias("id2"))
    j = refs.join(own, (F.lower("value") == F.col("k1")) & (_lang(F.col("language")) == F.col("l1")), "left").join(every, F.lower("value") == F.col("k2"), "left")
    return j.select(*refs.columns, F.coalesce("label1", "id1", "label2", "id2").alias("target"))


def resolve_names(refs: DataFrame, terms: DataFrame) -> DataFrame:
    """refs (.., language, label) with target and by_alt: the exact language, then the primary one, then any; in each label, id, alt-label.

    A term or a reference without a language takes part in the last pass only.
    """
    n = names(terms)
    tagged = n.where("lang <> ''")
    passes = [
        (_firsts(tagged, "lang"), _lang(F.col("language"))),
        (_firsts(tagged.withColumn("lang", F.substring_index("lang", "-", 1)), "lang"), F.substring_index(_lang(F.col("language")), "-", 1)),
        (_firsts(n), None),
    ]
    j, found = refs, []
    for i, (t, tag) in enumerate(passes):
        t = t.select(*(F.col(c).alias(f"{c} {i}") for c in t.columns))
        on = F.lower(F.col("label")) == F.col(f"key {i}")
        j = j.join(t, on if tag is None else on & (tag == F.col(f"lang {i}")), "left")
        found += [F.struct(F.col(f"{k} {i}").alias("target"), F.lit(k == "alt").alias("by_alt")) for k in ("label", "id", "alt")]
    hit = F.coalesce(*(F.when(x["target"].isNotNull(), x) for x in found))
    return j.select(*refs.columns, hit["target"].alias("target"), F.coalesce(hit["by_alt"], F.lit(False)).alias("by_alt"))


def undefined_term(terms: DataFrame, references: DataFrame) -> DataFrame:
    return _finding(resolve_names(references, terms).where("target is null"), "undefined-term", "label")


def alt_label_reference(terms: DataFrame, references: DataFrame) -> DataFrame:
    return _finding(resolve_names(references, terms).where("by_alt"), "alt-label-reference", "label", "target")


def duplicate_id(terms: DataFrame) -> DataFrame:
    """On each entry that shares its id in one language; other is how many others do."""
    key = [_lang(F.col("language")).alias("l"), F.lower("id").alias("k")]
    n = terms.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _finding(terms.join(n, (_lang(F.col("language")) == F.col("l")) & (F.lower("id") == F.col("k"))), "duplicate-id", "id", F.col("n") - 1)


def _colliders(values: DataFrame, terms: DataFrame, kind: str, before: bool) -> DataFrame:
    """values (.., idx, lang, value) with the first other entry whose names of a kind collide: equal within a language, differently spelt across."""
    held = names(terms).where(F.col("kind") == kind)
    if kind == "alt":  # an entry's first alt-label of those that fold alike
        held = terms.select("idx", _lang(F.col("language")).alias("lang"), F.posexplode("alt").alias("p", "value")).groupBy("idx", "lang", F.lower("value").alias("key")).agg(F.min_by("value", "p").alias("value"))
    w = Window.partitionBy("key", "lang", "value").orderBy("idx")
    held = held.withColumn("nth", F.row_number().over(w)).where("nth <= 2").select(F.col("idx").alias("oidx"), F.col("lang").alias("olang"), F.col("value").alias("ovalue"), F.col("key").alias("okey"))
    on = (F.lower("value") == F.col("okey")) & (F.col("idx") != F.col("oidx")) & ((F.col("lang") == F.col("olang")) | (F.col("value") != F.col("ovalue")))
    if before:
        on = on & (F.col("oidx") < F.col("idx"))
    return values.join(held, on).groupBy(*values.columns).agg(F.min("oidx").alias("other"))


_AT = ("idx", "file", "line", "id")


def _each(terms: DataFrame, field: str) -> DataFrame:
    return terms.select(*_AT, _lang(F.col("language")).alias("lang"), F.explode(field).alias("value"))


def label_collision(terms: DataFrame) -> DataFrame:
    own = terms.select(*_AT, _lang(F.col("language")).alias("lang"), F.col("label").alias("value"))
    return _finding(_colliders(own, terms, "label", True), "label-collision", "value", "other")


def alt_label_collision(terms: DataFrame) -> DataFrame:
    return _finding(_colliders(_each(terms, "alt"), terms, "label", False), "alt-label-collision", "value", "other")


def ambiguous_alt_label(terms: DataFrame) -> DataFrame:
    return _finding(_colliders(_each(terms, "alt"), terms, "alt", True), "ambiguous-alt-label", "value", "other")


def label_overlap(terms: DataFrame) -> DataFrame:
    """Alt-labels that repeat their entry's label; hidden labels that are its label or alt-label, or another entry's."""
    alts = terms.select(*_AT, "label", F.explode("alt").alias("value")).where(F.lower("value") == F.lower("label"))
    hidden = terms.select(*_AT, _lang(F.col("language")).alias("lang"), "label", "alt", F.explode("hidden").alias("value"))
    own = (F.lower("value") == F.lower("label")) | F.coalesce(F.array_contains(F.transform("alt", F.lower), F.lower("value")), F.lit(False))
    rest = hidden.where(~own).select(*_AT, "lang", "value")
    labels = _colliders(rest, terms, "label", False)
    both = labels.unionByName(_colliders(rest, terms, "alt", False).join(labels.select("idx", "value").distinct(), ["idx", "value"], "left_anti"))
    return reduce(DataFrame.unionByName, [_finding(alts, "label-overlap"), _finding(hidden.where(own), "label-overlap"), _finding(both, "label-overlap", "value", "other")])


def deprecated_label(terms: DataFrame) -> DataFrame:
    """Entries whose own label's designation is retired; redirects aside."""
    first = F.get(F.filter("designations", lambda d: F.lower(d["term"]) == F.lower("label")), F.lit(0))["status"]
    return _finding(terms.where(F.col("see").isNull() & F.lower(first).isin(*RETIRED)), "deprecated-label", "label")


def relations(terms: DataFrame) -> DataFrame:
    """(idx, file, line, id, language, field, value) of each value that names another entry."""
    lists = F.array(*(F.struct(F.lit(f).alias("field"), (F.array_compact(F.array("see")) if f == "see" else F.coalesce(F.col(f), F.array())).alias("values")) for f in RELATIONS))
    d = terms.select(*_AT, "language", F.explode(lists).alias("x")).select(*_AT, "language", "x.field", F.explode("x.values").alias("value"))
    return d


def dangling_reference(terms: DataFrame) -> DataFrame:
    return _finding(resolve_references(relations(terms), terms).where("target is null"), "dangling-reference", "value", "field")


def see_not_empty(terms: DataFrame) -> DataFrame:
    return _finding(terms.where("see is not null and definition is not null"), "see-not-empty", "see")


def missing_definition(terms: DataFrame) -> DataFrame:
    return _finding(terms.where("see is null and definition is null"), "missing-definition", F.lit("definition"))


def conflicting_matches(terms: DataFrame) -> DataFrame:
    """Once for each mapped IRI that an entry holds under two kinds; other is the second kind in order."""
    m = terms.select(*_AT, F.posexplode("matches").alias("p", "m")).groupBy(*_AT, F.col("m.iri").alias("value"), F.col("m.kind").alias("kind")).agg(F.min("p").alias("p"))
    n = m.groupBy(*_AT, "value").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("p", "kind"))).alias("ks")).where("n > 1")  # at most one for each kind
    return _finding(n, "conflicting-matches", "value", F.col("ks")[1]["kind"])


def abstract_too_long(terms: DataFrame, most: int = 60) -> DataFrame:
    """Lengths are UTF-16 units: characters beyond U+FFFF count twice."""
    size = F.octet_length(F.encode("abstract", "UTF-16BE")) / 2
    return _finding(terms.where(size > most), "abstract-too-long", size.cast("long"))


def unused_term(terms: DataFrame, references: DataFrame) -> DataFrame:
    used = resolve_names(references, terms).where("target is not null").select(F.col("target").alias("idx")).distinct()
    ids = terms.join(used, "idx", "left_semi").select(F.lower("id").alias("used")).distinct()
    return _finding(terms.join(ids, F.lower("id") == F.col("used"), "left_anti"), "unused-term", "label")


def edges(terms: DataFrame) -> DataFrame:
    """(field, a, b): resolved broader, narrower and related links, each pair once."""
    r = resolve_references(relations(terms).where("field <> 'see'"), terms)
    return r.where("target is not null").select("field", F.col("idx").alias("a"), F.col("target").alias("b")).distinct()


def _at_entry(d: DataFrame, terms: DataFrame, on: str) -> DataFrame:
    return d.join(terms.select(F.col("idx").alias("entry"), "file", "line", "id"), F.col(on) == F.col("entry"))


def asymmetric_related(terms: DataFrame) -> DataFrame:
    """On the entry that omits the other half; other is the entry that has it."""
    r = edges(terms).where("field = 'related'").select("a", "b")
    missing = r.join(r.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    return _finding(_at_entry(missing, terms, "b"), "asymmetric-related", F.lit("related"), "a")


def asymmetric_hierarchy(terms: DataFrame) -> DataFrame:
    e = edges(terms)
    up, down = (e.where(F.col("field") == f).select("a", "b") for f in ("broader", "narrower"))
    flip = lambda d: d.select(F.col("b").alias("a"), F.col("a").alias("b"))
    found = []
    for have, other, field in ((up, down, "narrower"), (down, up, "broader")):
        found.append(_finding(_at_entry(have.join(flip(other), ["a", "b"], "left_anti"), terms, "b"), "asymmetric-hierarchy", F.lit(field), "a"))
    return found[0].unionByName(found[1])


def hierarchy(terms: DataFrame) -> DataFrame:
    """(child, parent) of broader and narrower links."""
    return _hierarchy(edges(terms))


def _hierarchy(e: DataFrame) -> DataFrame:
    return e.where("field = 'broader'").select(F.col("a").alias("child"), F.col("b").alias("parent")).union(e.where("field = 'narrower'").select("b", "a")).distinct()


def _related(e: DataFrame) -> DataFrame:
    return e.where("field = 'related' and a <> b").select("a", "b")


def elementary_cycles(up: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(path) of each elementary cycle of (child, parent), once, from its lowest node.

    Paths grow by one join a round, over later nodes only; nodes without a way in or out were peeled off before. A cycle
    of more than ``most`` nodes ends the job instead of being left out.
    """
    e = cut(up.select(F.col("child").alias("a"), F.col("parent").alias("b")).distinct())
    n = e.count()
    while n:
        e = cut(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        if (m := e.count()) == n:
            break
        n = m
    found = e.where("a = b").select(F.array("a").alias("path"))
    paths, hops = cut(e.where("b > a").select(F.array("a", "b").alias("path"))), 2
    while not paths.isEmpty():
        if hops > most:
            raise ValueError(f"a path through cycles has more than {most} nodes")
        step = paths.join(e, F.element_at("path", -1) == F.col("a"))
        found = found.union(step.where(F.col("b") == F.col("path")[0]).select("path"))
        paths = cut(step.where((F.col("b") > F.col("path")[0]) & ~F.array_contains("path", F.col("b"))).select(F.array_append("path", F.col("b")).alias("path")))
        hops += 1
    return found


def broader_cycle(terms: DataFrame) -> DataFrame:
    c = elementary_cycles(hierarchy(terms)).select(F.col("path")[0].alias("start"), F.array_join(F.array_append("path", F.col("path")[0]).cast("array<string>"), " > ").alias("value"))
    return _finding(_at_entry(c, terms, "start"), "broader-cycle")


def _leaps(e: DataFrame, most: int = 16, farthest: int = 8) -> tuple[DataFrame, int]:
    """(node, next, hops) of all that lies up to so many hops above each node, and that number, from edges (node, next).

    Hops double while the table stays below ``most`` times the edges, so that a walk takes few rounds.
    """
    h = cut(e.withColumn("hops", F.lit(1)))
    n = size = h.count()
    reach = 1
    while reach < farthest:
        out = h.groupBy(F.col("node").alias("next")).agg(F.count(F.lit(1)).alias("n"))
        if size + (h.join(out, "next").agg(F.sum("n")).first()[0] or 0) > most * n:
            break
        then = h.select(F.col("node").alias("next"), F.col("next").alias("far"), F.col("hops").alias("more"))
        step = h.join(then, "next").select("node", F.col("far").alias("next"), F.col("hops") + F.col("more"))
        h = cut(h.union(step).groupBy("node", "next").agg(F.min("hops").alias("hops")))
        reach, m = reach * 2, h.count()
        if m == size:
            break
        size = m
    return h, reach


def above(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """pairs (a, b) of which b is above a, at any depth: the starts' ancestors are followed round by round, several hops in one; what was seen isn't followed again.

    Starts without a parent and targets without a child are left out beforehand. The rounds that were written are read
    together; none is written again.
    """
    e = cut(up.select(F.col("child").alias("node"), F.col("parent").alias("next")).distinct())
    pairs = pairs.select("a", "b").distinct().join(e.select(F.col("node").alias("a")), "a", "left_semi").join(e.select(F.col("next").alias("b")), "b", "left_semi")
    pairs = cut(pairs.select("a", "b"))
    h, reach = _leaps(e)
    front, seen = pairs.select("a", F.col("a").alias("node")).distinct(), None
    while True:
        step = front.join(h, "node").groupBy("a", F.col("next").alias("node")).agg(F.min("hops").alias("hops"))
        new = cut(step if seen is None else step.join(seen, ["a", "node"], "left_anti"))
        seen = new.select("a", "node") if seen is None else seen.union(new.select("a", "node"))
        front = new.where(F.col("hops") == reach).select("a", "node")  # a shortest way on leads over these
        if front.isEmpty():
            return pairs.join(seen.select("a", F.col("node").alias("b")), ["a", "b"], "left_semi")


def _tied(r: DataFrame, up: DataFrame) -> DataFrame:
    """Pairs (a, b) that the hierarchy relates, with the direction; both directions are looked for in one walk."""
    flip = lambda d: d.select(F.col("b").alias("a"), F.col("a").alias("b"))
    found = cut(above(r.union(flip(r)), up))
    higher = r.join(found, ["a", "b"], "left_semi").withColumn("how", F.lit("broader"))
    lower = r.join(flip(found), ["a", "b"], "left_semi").join(found, ["a", "b"], "left_anti").withColumn("how", F.lit("narrower"))
    return higher.unionByName(lower)


def related_in_hierarchy(terms: DataFrame) -> DataFrame:
    e = cut(edges(terms))
    return _finding(_at_entry(_tied(_related(e), _hierarchy(e)), terms, "a"), "related-in-hierarchy", "how", "b")


def related_siblings(terms: DataFrame) -> DataFrame:
    """Once for each related pair that shares a direct parent, on the first entry that lists the other; value is the lowest parent.

    Only pairs that share a parent are looked for in the hierarchy.
    """
    e = cut(edges(terms))
    up = _hierarchy(e)
    p = cut(_related(e).join(up.select(F.col("child").alias("a"), "parent"), "a").join(up.select(F.col("child").alias("b"), "parent"), ["b", "parent"]))
    p = p.join(_tied(p.select("a", "b").distinct(), up), ["a", "b"], "left_anti")
    once = p.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"), F.min("parent").alias("value"))
    return _finding(_at_entry(once.withColumn("o", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))), terms, "a"), "related-siblings", "value", "o")


def hierarchy_outside_termbase(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges that pages give to a term and that the term's own field doesn't list; values compare as concepts, by id."""
    b = blocks.withColumn("edge", F.monotonically_increasing_id())
    b = cut(resolve_names(b, terms).where("target is not null").drop("by_alt").withColumnRenamed("target", "subject"))
    concept = lambda target, value: F.coalesce(F.concat(F.lit("id "), target), F.concat(F.lit("name "), F.lower(value)))
    ids = terms.select(F.col("idx").alias("of"), F.lower("id").alias("folded"))
    told = resolve_names(b.select("edge", "language", "subject", "field", F.col("value").alias("label")), terms).join(ids, F.col("target") == F.col("of"), "left").select("edge", concept(F.col("folded"), F.col("label")).alias("concept"))
    own = resolve_references(relations(terms), terms).join(ids, F.col("target") == F.col("of"), "left").select(F.col("idx").alias("subject"), "field", concept(F.col("folded"), F.col("value")).alias("concept")).distinct()
    d = b.join(told, "edge").join(own, ["subject", "field", "concept"], "left_anti")
    return _finding(d, "hierarchy-outside-termbase", F.concat_ws(" ", "field", "value"), "subject")


def orphan_term(terms: DataFrame) -> DataFrame:
    """Terms, redirects aside, that no link places; none in a set without any hierarchy. A concept is placed in every language."""
    e = edges(terms)
    ends = e.select(F.explode(F.array("a", "b")).alias("idx")).distinct()
    placed = terms.join(ends, "idx", "left_semi").select(F.lower("id").alias("placed")).distinct()
    any_link = e.where("field <> 'related'").limit(1).select(F.lit(1).alias("one"))
    d = terms.where("see is null").join(placed, F.lower("id") == F.col("placed"), "left_anti")
    return _finding(d.join(F.broadcast(any_link), F.lit(True), "left_semi"), "orphan-term", "label")


def keyword_candidate(terms: DataFrame, keywords: DataFrame, least: int = 2) -> DataFrame:
    """Keywords on so many pages that name no entry, at their first page; other is the number of pages."""
    per_page = keywords.groupBy(F.lower("label").alias("key"), "file").agg(F.min(F.struct(F.coalesce("line", F.lit(0)).alias("l"), "line", "label")).alias("x"))
    k = per_page.groupBy("key").agg(F.count(F.lit(1)).alias("pages"), F.min(F.struct("file", "x")).alias("first")).where(F.col("pages") >= least)
    k = k.join(names(terms).select("key").distinct(), "key", "left_anti")
    return _finding(k.select(F.col("first.file").alias("file"), F.col("first.x.line").alias("line"), F.col("first.x.label").alias("value"), "pages"), "keyword-candidate", "value", "pages")


#: Rules by what they read beside the terms.
RULES = {
    "terms": (duplicate_id, label_collision, alt_label_collision, label_overlap, ambiguous_alt_label, deprecated_label, dangling_reference, see_not_empty, missing_definition, conflicting_matches, abstract_too_long, asymmetric_related, asymmetric_hierarchy, broader_cycle, related_in_hierarchy, related_siblings, orphan_term),
    "references": (undefined_term, alt_label_reference, unused_term),
    "blocks": (hierarchy_outside_termbase,),
    "keywords": (keyword_candidate,),
}


def check(terms: DataFrame, references: DataFrame, blocks: DataFrame, keywords: DataFrame, off: tuple[str, ...] = ()) -> DataFrame:
    """All findings in order of file, line, rule and value, but those of the rules in ``off``."""
    given = {"references": references, "blocks": blocks, "keywords": keywords}
    found = [f(terms) if kind == "terms" else f(terms, given[kind]) for kind, fs in RULES.items() for f in fs if f.__name__.replace("_", "-") not in off]
    return reduce(DataFrame.unionByName, found).orderBy("file", F.coalesce("line", F.lit(0)), "rule", "value", "other")
