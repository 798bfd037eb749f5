"""What search and retrieval stand on: index entries, section texts, entry points, golden questions, places of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def section_texts(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(path, section, first, last, text) of pages (path, text): section 0 is what stands before the first heading; each other one goes up to the next heading. Lines meet their section by a running maximum, not by a range join."""
    lines = pages.where("text is not null").select("path", F.posexplode(F.split("text", "\r?\n")).alias("p", "t")).select("path", (F.col("p") + 1).alias("n"), "t")
    at = sections.select("path", F.col("line").alias("n"), "section")
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.join(at, ["path", "n"], "left").withColumn("own", F.coalesce(F.max("section").over(w), F.lit(0)))
    g = d.groupBy("path", F.col("own").alias("section")).agg(F.min("n").alias("first"), F.max("n").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n").alias("text"))  # a section's lines
    return g


def index_entries(pages: DataFrame, sections: DataFrame, texts: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """(id, type, title, labels, description, text, language): pages with their preamble or, without sections, their whole text; sections with their own; concepts (id, label, alt, definition, language) by their names."""
    none = F.array().cast("array<string>")
    pre = texts.where("section = 0").select(F.col("path").alias("tp"), F.col("text").alias("t0"))
    p = pages.join(pre, F.col("path") == F.col("tp"), "left").select(F.col("path").alias("id"), F.lit("page").alias("type"), "title", none.alias("labels"), F.col("description"), F.coalesce("t0", F.lit("")).alias("text"), "language")
    lang = pages.select(F.col("path").alias("lp"), "language")
    s = sections.join(texts.select("path", "section", "text"), ["path", "section"]).join(lang, F.col("path") == F.col("lp"))
    out = p.unionByName(s.select(F.concat("path", F.lit("#"), "slug").alias("id"), F.lit("section").alias("type"), "title", none.alias("labels"), F.lit(None).cast("string").alias("description"), "text", "language"))
    if concepts is not None:
        out = out.unionByName(concepts.select("id", F.lit("concept").alias("type"), F.col("label").alias("title"), F.coalesce("alt", none).alias("labels"), F.col("definition").alias("description"), F.lit(None).cast("string").alias("text"), "language"))
    return out.withColumn("language", F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("und")))


def resolve_variant(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, node) of names (name) among nodes (node, label, notation): the node itself, then its notation, then its label, without regard to case; ties by node."""
    n = nodes.select("node", F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lower(c).alias("key")) for i, c in enumerate(("node", "notation", "label"))))).alias("x")).select("node", "x.*").where("key is not null")
    best = n.groupBy("key").agg(F.min(F.struct("rank", "node")).alias("b"))
    return names.join(best, F.lower("name") == F.col("key")).select("name", F.col("b.node").alias("node"))


def blame(triples: DataFrame, focus: DataFrame, most: int = 5) -> DataFrame:
    """(focus, doc): the documents from which a node (focus) hangs: a bounded walk against the edges, which stops at documents."""
    from docloom.plans.lineage import cut

    docs = triples.where("p = 'rdf:type' and o = 'docs:Document'").select(F.col("s").alias("node")).distinct()
    back = triples.where("kind = 'iri' and p <> 'rdf:type'").select(F.col("o").alias("node"), F.col("s").alias("up")).distinct()
    front = seen = cut(focus.select("focus", F.col("focus").alias("node")).distinct())
    for _ in range(most):
        open_ = front.join(docs, "node", "left_anti")
        front = cut(open_.join(back, "node").select("focus", F.col("up").alias("node")).distinct().join(seen, ["focus", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen.join(docs, "node", "left_semi").select("focus", F.col("node").alias("doc"))


def entry_points(lexical: DataFrame, vector: DataFrame | None, mismatch: str | None, mode: str = "hybrid") -> tuple[DataFrame, str | None]:
    """The ranking of a mode and a note: without vectors, or with ones that don't fit, hybrid falls back to lexical; asked for vectors alone, it is refused."""
    from docloom.operators.search import fuse

    if mode == "lexical":
        return lexical, None
    if vector is None or mismatch:
        if mode == "vector":
            raise ValueError(f"no usable vectors: {mismatch or 'none'}")
        return lexical, f"lexical only: {mismatch or 'no vectors'}"
    return (vector, None) if mode == "vector" else (fuse([lexical, vector]), None)


def golden(questions: DataFrame, hits: DataFrame, top: int = 10) -> DataFrame:
    """(question, page, rank, found) of questions (question, page, first, last; lines or null) and hits (question, page, first, last, rank): an answer is found by any hit on its page in the top ranks, with lines by one that overlaps them."""
    q = questions.select("question", "page", F.col("first").alias("qf"), F.col("last").alias("ql"))
    h = hits.where(F.col("rank") <= top)
    on = F.col("qf").isNull() | ((F.col("first") <= F.col("ql")) & (F.col("last") >= F.col("qf")))
    best = q.join(h, ["question", "page"]).where(on).groupBy("question", "page").agg(F.min("rank").alias("rank"))
    return q.join(best, ["question", "page"], "left").select("question", "page", "rank", F.col("rank").isNotNull().alias("found"))


def gate(judged: DataFrame, least: float = 1.0) -> DataFrame:
    """(questions, found_rate, first_rate, passes) in one row; no question passes."""
    n = F.count(F.lit(1))
    rate = F.when(n == 0, 1.0).otherwise(F.count_if("found") / n)
    return judged.agg(n.alias("questions"), F.round(rate, 4).alias("found_rate"), F.round(F.when(n == 0, 1.0).otherwise(F.count_if(F.col("rank") == 1) / n), 4).alias("first_rate"), (rate >= least).alias("passes"))


def locate(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, page, line) of texts (id, text) among source lines (page, n, line): the one line of one page that holds the whole text, white space aside. Texts meet lines by their rarest word, so no text is compared with all lines."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    plain = lambda c: F.btrim(F.regexp_replace(F.lower(c), r"\s+", " "))
    l = pages.select("page", "n", plain(F.col("line")).alias("l"), F.explode(words(F.col("line"))).alias("w"))  # noqa: E741
    df = l.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    t = texts.select("id", plain(F.col("text")).alias("t"), F.explode(words(F.col("text"))).alias("w")).join(df, "w")
    t = t.groupBy("id", "t").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    hit = t.join(l, "w").where(F.contains("l", F.col("t"))).groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("page").alias("page"), F.min("n").alias("line"))
    return hit.where("k = 1").select("id", "page", "line")


def family_status(findings: DataFrame, projects: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(project, status, errors) of findings (path, severity) and projects (project, prefix): the worst severity below a prefix, ok without findings; with ``changed`` (path) only findings on those count."""
    f = findings if changed is None else findings.join(changed.select("path").distinct(), "path", "left_semi")
    p = projects.select("project", "prefix", F.length("prefix").alias("k"))
    sizes = p.select("k").distinct()
    # an equi-join for each length that a prefix has
    j = f.crossJoin(F.broadcast(sizes)).where(F.length("path") >= F.col("k")).withColumn("prefix", F.substr("path", F.lit(1), F.col("k"))).join(p, ["prefix", "k"])
    g = j.groupBy("project").agg(F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)).alias("worst"), F.count_if(F.col("severity") == "error").alias("errors"))
    return projects.select("project").distinct().join(g, "project", "left").select("project", F.when(F.col("worst") == 2, "error").when(F.col("worst") == 1, "warning").otherwise("ok").alias("status"), F.coalesce("errors", F.lit(0)).alias("errors"))


def access_violations(pages: DataFrame) -> DataFrame:
    """(page_id, rule, severity, n) of simple rules on HTML (page_id, html): images without alt, pages without language or title, links without text, headings that skip a level."""
    n = lambda pattern: F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)))
    heads = F.transform(F.regexp_extract_all("html", F.lit(r"(?i)<h([1-6])[ >]"), F.lit(1)), lambda x: x.cast("int"))
    skips = F.size(F.filter(F.zip_with(heads, F.slice(heads, F.lit(2), F.greatest(F.size(heads) - 1, F.lit(0))), lambda a, b: b - a), lambda x: x > 1))
    rules = [("image-alt", "critical", n(r"(?i)<img(?![^>]*\salt=)[^>]*>")), ("html-has-lang", "serious", F.when(F.col("html").rlike(r"(?i)<html[^>]*\slang="), 0).otherwise(1)), ("document-title", "serious", F.when(F.col("html").rlike(r"(?i)<title>\s*\S"), 0).otherwise(1)), ("link-name", "serious", n(r"(?is)<a\b[^>]*>\s*</a>")), ("heading-order", "moderate", skips)]
    d = pages.select("page_id", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), c.cast("long").alias("n")) for r, s, c in rules))).alias("x"))
    return d.select("page_id", "x.*").where("n > 0")
