"""Triples (s, p, o, kind, lang) from pages and terms; kind is iri or literal. Names are compact (prefix:local).

One select for each rule, their union without repetitions. No blank nodes: each subject's IRI comes from its path or id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.structure import slug

#: Prefixes of public vocabularies, and our own.
PREFIXES = {
    "dcterms": "http://purl.org/dc/terms/",
    "docs": "urn:docloom:",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "prov": "http://www.w3.org/ns/prov#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "schema": "https://schema.org/",
    "sh": "http://www.w3.org/ns/shacl#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}


def expand(name: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """prefix:local as an IRI; others stay."""
    known = F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))
    base = F.element_at(known, F.substring_index(name, ":", 1))
    return F.when(name.contains(":") & base.isNotNull(), F.concat(base, F.substr(name, F.instr(name, ":") + 1))).otherwise(name)


def compact(iri: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """An IRI by its longest known base; others stay."""
    out = iri
    for p, base in sorted(prefixes.items(), key=lambda kv: len(kv[1])):
        out = F.when(iri.startswith(base), F.concat(F.lit(f"{p}:"), F.substr(iri, F.lit(len(base) + 1)))).otherwise(out)
    return out


def page_iri(base: str, path: Column) -> Column:
    """An IRI for a page: its path without the extension, white space and characters that IRIs refuse as %XX."""
    stem = F.regexp_replace(path, r"\.(mdx?|html?|adoc|rst)$", "")
    return F.concat(F.lit(base), F.replace(F.replace(F.url_encode(stem), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))


def section_iri(page: Column, name: Column) -> Column:
    return F.concat(page, F.lit("#"), name)


def _triples(d: DataFrame, s: Column | str, p: str, o: Column | str, kind: str = "iri", lang: Column | None = None) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return d.select(col(s).alias("s"), F.lit(p).alias("p"), col(o).cast("string").alias("o"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if lang is None else lang).alias("lang")).where("s is not null and o is not null")


def _each(d: DataFrame, *rules: tuple) -> DataFrame:
    """The triples of several rules (s, p, o, kind, lang) for each row, by one pass over the table; those without an object are left out."""
    none = F.lit(None).cast("string")
    made = [F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(more[0] if more else "iri").alias("kind"), (more[1] if len(more) > 1 else none).alias("lang")) for s, p, o, *more in rules]
    return d.select(F.explode(F.array(*made)).alias("t")).select("t.*").where("s is not null and o is not null")


def derive(pages: DataFrame, sections: DataFrame | None = None, links: DataFrame | None = None, concepts: DataFrame | None = None, base: str = "https://example.org/") -> DataFrame:
    """Triples of pages (path, title, lang), sections (path, section, level, title, slug, parent), links (path, target, kind, page, broken) and concepts (path, id)."""
    page, lang = page_iri(base, F.col("path")), F.col("lang")
    literal = "literal"
    rules = [
        _each(pages, (page, "rdf:type", F.lit("docs:Document")), (page, "docs:path", F.col("path"), literal), (page, "dcterms:title", F.when(F.col("title") != "", F.col("title")), literal, lang), (page, "dcterms:language", F.when(F.col("lang") != "", F.col("lang")), literal)),
    ]
    if sections is not None:
        own = section_iri(page, F.col("slug"))
        up = sections.select(F.col("path").alias("upath"), F.col("section").alias("usection"), F.col("slug").alias("uslug"))
        nested = sections.join(up, (F.col("path") == F.col("upath")) & (F.col("parent") == F.col("usection")), "left")
        holder = F.coalesce(section_iri(page, F.col("uslug")), page)
        rules.append(_each(nested, (own, "rdf:type", F.lit("docs:Section")), (own, "dcterms:title", F.col("title"), literal), (own, "docs:level", F.col("level"), literal), (own, "docs:order", F.col("section"), literal), (holder, "dcterms:hasPart", own)))
    if links is not None:
        to = F.when(F.col("page").isNotNull() & (F.col("page") != F.col("path")), page_iri(base, F.col("page")))
        rules.append(_each(links, (page, "dcterms:references", to), (page, "rdfs:seeAlso", F.when(F.col("kind") == "external", F.col("target"))), (page, "docs:brokenLink", F.when(F.col("broken"), F.col("target")), literal)))
    if concepts is not None:
        rules.append(_triples(concepts, page, "dcterms:subject", concept_iri(F.col("id"), base)))
    return reduce(DataFrame.unionByName, rules).distinct()


def concept_iri(name: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}concept/"), slug(name))


def from_terms(terms: DataFrame, edges: DataFrame, base: str = "https://example.org/") -> DataFrame:
    """Concepts of a term set (see glossary): labels by language, the hierarchy both ways, top concepts, mappings."""
    own, lang = concept_iri(F.col("id"), base), F.col("language")
    scheme = F.lit(f"{base}concepts")
    real = terms.where("see is null")
    at = lambda side: terms.select(F.col("idx").alias(side), concept_iri(F.col("id"), base).alias(f"{side}iri"))
    e = edges.join(at("a"), "a").join(at("b"), "b")
    pairs = lambda field, s, p, o: _triples(e.where(F.col("field") == field), s, p, o)
    placed = edges.where("field = 'broader'").select(F.col("a").alias("idx")).union(edges.where("field = 'narrower'").select("b")).distinct()
    top = real.join(placed, "idx", "left_anti")
    match = real.select(own.alias("s"), F.explode("matches").alias("m"))
    rules = [
        _triples(real, own, "rdf:type", F.lit("skos:Concept")),
        _triples(real, own, "skos:inScheme", scheme),
        _triples(real, own, "skos:notation", "id", "literal"),
        _triples(real, own, "skos:prefLabel", "label", "literal", lang),
        _triples(real, own, "skos:definition", "definition", "literal", lang),
        *(_triples(real.select(own.alias("s"), "language", F.explode(f).alias("o")), "s", p, "o", "literal", lang) for f, p in (("alt", "skos:altLabel"), ("hidden", "skos:hiddenLabel"))),
        pairs("broader", "airi", "skos:broader", "biri"), pairs("broader", "biri", "skos:narrower", "airi"),
        pairs("narrower", "airi", "skos:narrower", "biri"), pairs("narrower", "biri", "skos:broader", "airi"),
        pairs("related", "airi", "skos:related", "biri"), pairs("related", "biri", "skos:related", "airi"),
        _triples(top, own, "skos:topConceptOf", scheme), _triples(top, scheme, "skos:hasTopConcept", own),
        *(_triples(match.where(F.col("m.kind") == k), "s", f"skos:{k}Match", "m.iri") for k in ("exact", "close", "broad", "narrow", "related")),
    ]
    # a redirect is no concept: its label is an alternative one of its target
    goes = terms.where("see is not null").select("label", "language", F.lower("see").alias("k")).join(real.select(F.lower("id").alias("k"), own.alias("s")), "k")
    return reduce(DataFrame.unionByName, [*rules, _triples(goes, "s", "skos:altLabel", "label", "literal", lang)]).distinct()


def neighbours(triples: DataFrame, node: str, direction: str = "both", predicates: list[str] | None = None) -> DataFrame:
    """(p, target, dir) of a node's edges to other nodes."""
    e = triples.where("kind = 'iri'") if predicates is None else triples.where((F.col("kind") == "iri") & F.col("p").isin(predicates))
    out = e.where(F.col("s") == node).select("p", F.col("o").alias("target"), F.lit("out").alias("dir"))
    back = e.where(F.col("o") == node).select("p", F.col("s").alias("target"), F.lit("in").alias("dir"))
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def stats(triples: DataFrame, node_type: str = "docs:Document") -> DataFrame:
    """(measure, n): triples, subjects, nodes of a type, broken links, nodes without an edge to or from another one."""
    of = triples.where((F.col("p") == "rdf:type") & (F.col("o") == node_type)).select(F.col("s").alias("node")).distinct()
    e = triples.where("kind = 'iri' and s <> o and p <> 'rdf:type'")
    tied = e.select(F.col("s").alias("node")).union(e.select(F.col("o").alias("node"))).distinct()
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")
    parts = [count(triples, "triples"), count(triples.select("s").distinct(), "subjects"), count(of, "nodes"), count(triples.where("p = 'docs:brokenLink'"), "broken links"), count(of.join(tied, "node", "left_anti"), "orphans")]
    return reduce(DataFrame.unionByName, parts)


def shapes(triples: DataFrame, constraints: list[dict]) -> DataFrame:
    """Violations (shape, focus, path, constraint, value) of constraints by target class.

    A constraint is {"shape", "target", "path"} with some of min_count, max_count, kind, one_of, pattern, class and
    disjoint (a path). Values that break one constraint in several ways give a row for each.
    """
    typed = triples.where("p = 'rdf:type'").select(F.col("s").alias("focus"), F.col("o").alias("type")).distinct()
    found = []
    for c in constraints:
        focus = typed.where(F.col("type") == c["target"]).select("focus").distinct()
        v = triples.where(F.col("p") == c["path"]).select(F.col("s").alias("focus"), F.col("o").alias("value"), "kind").join(focus, "focus", "left_semi")
        say = lambda d, name, value=F.lit(None): found.append(d.select(F.lit(c["shape"]).alias("shape"), "focus", F.lit(c["path"]).alias("path"), F.lit(name).alias("constraint"), value.cast("string").alias("value")))  # noqa: B023, B008, E731
        if "min_count" in c or "max_count" in c:
            n = focus.join(v.groupBy("focus").agg(F.countDistinct("value").alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            if "min_count" in c:
                say(n.where(F.col("n") < c["min_count"]), "minCount", F.col("n"))
            if "max_count" in c:
                say(n.where(F.col("n") > c["max_count"]), "maxCount", F.col("n"))
        if "kind" in c:
            say(v.where(F.col("kind") != c["kind"]), "nodeKind", F.col("value"))
        if "one_of" in c:
            say(v.where(~F.col("value").isin(c["one_of"])), "in", F.col("value"))
        if "pattern" in c:
            say(v.where(~F.col("value").rlike(c["pattern"])), "pattern", F.col("value"))
        if "class" in c:
            members = typed.where(F.col("type") == c["class"]).select(F.col("focus").alias("value"))
            say(v.join(members, "value", "left_anti"), "class", F.col("value"))
        if "disjoint" in c:
            other = triples.where(F.col("p") == c["disjoint"]).select(F.col("s").alias("focus"), F.col("o").alias("value"))
            say(v.join(other, ["focus", "value"], "left_semi"), "disjoint", F.col("value"))
    return reduce(DataFrame.unionByName, found).distinct()


def turtle(triples: DataFrame) -> DataFrame:
    """(value) lines of Turtle, one statement a line, in order, after the prefixes; write with .write.text()."""
    literal = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(""))
    iri = lambda c: F.when(F.substring_index(c, ":", 1).isin(list(PREFIXES)) & c.rlike(r"^[a-z]+:[A-Za-z][\w-]*$"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    said = triples.select("s", "p", F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), F.when(F.col("kind") == "iri", iri(F.col("o"))).otherwise(literal), F.lit(".")).alias("value"))
    head = triples.sparkSession.createDataFrame([("", p, f"@prefix {p}: <{u}> .") for p, u in sorted(PREFIXES.items())], "s string, p string, value string")
    return head.unionByName(said).orderBy("s", "p", "value").select("value")


def json_ld(triples: DataFrame) -> DataFrame:
    """(value): one JSON-LD node a subject, as JSON lines in order."""
    o = F.when(F.col("kind") == "iri", F.struct(F.col("o").alias("@id"), F.lit(None).cast("string").alias("@value"), F.lit(None).cast("string").alias("@language"))).otherwise(F.struct(F.lit(None).cast("string").alias("@id"), F.col("o").alias("@value"), F.col("lang").alias("@language")))
    per = triples.groupBy("s", "p").agg(F.array_sort(F.collect_list(o)).alias("os")).groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "os")))).alias("ps"))
    return per.orderBy("s").select(F.concat(F.lit('{"@id":'), F.to_json(F.array("s")).substr(F.lit(2), F.length(F.to_json(F.array("s"))) - 2), F.lit(","), F.substr(F.to_json("ps"), F.lit(2))).alias("value"))
