"""Queries over structure, links, triples, validation, write-back, pins, sessions and templates, each with its DuckDB form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import tables
from docloom.operators import context, glossary, links, ordered, patterns, pins, provenance, shacl, sqlguard, strategy, templates, traces, triples, validation, writeback
from docloom.plans.glossary import TERMS, terms_of
from docloom.plans.lineage import cut
from docloom.plans.toolkit import query, table
from docloom.sources import formats, structure

# ---- structure and links ----------------------------------------------------------------------------------------


def _nodes(spark, d):
    return structure.nodes(table(spark, d, "pages").withColumn("kind", F.lit("html")), "page_id", "html", "kind")


@query("""SELECT CAST(page_id AS VARCHAR) AS path, 1 AS section, 1 AS level, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""")
def html_sections(spark, d):
    return structure.sections(_nodes(spark, d)).select("path", "section", "level", "title")


@query("""SELECT CAST(page_id AS VARCHAR) AS path, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<ul>')) AS lists, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, '<a href')) AS links FROM (SELECT page_id, regexp_replace(html, '<script>.*?</script>', '', 'g') AS html FROM pages)""")
def html_node_counts(spark, d):
    n = lambda k: F.count_if(F.col("kind") == k)
    return _nodes(spark, d).groupBy("path").agg(n("paragraph").alias("paragraphs"), n("list").alias("lists"), n("item").alias("items"), n("link").alias("links"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents")
def split_body(spark, d):
    """The parts of each text, joined again."""
    doc = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    p = structure.split_body(doc, 700)
    return p.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("text"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, max(length(t)) AS longest, sum(length(t)) + max(n) - 1 AS chars FROM l GROUP BY doc_id""")
def split_body_sizes(spark, d):
    """With the smallest bound each line is a part."""
    doc = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    n = F.char_length("text")
    return structure.split_body(doc, 0).groupBy("path").agg(F.max(n).alias("longest"), (F.sum(n) + F.count(F.lit(1)) - 1).alias("chars"))


@query("""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, len(string_split(text, chr(10))) AS n FROM documents), s AS (SELECT path, n, unnest(range(1, n // 3 + 1)) AS section FROM l)
SELECT path, CAST(section AS INTEGER) AS section, CAST(1 + section % 4 AS INTEGER) AS level, 'Section ' || section AS title, CAST(3 * section AS INTEGER) AS first, CAST(CASE WHEN section = n // 3 THEN n ELSE 3 * section + 2 END AS INTEGER) AS last FROM s""")
def line_sections(spark, d):
    """Sections by the table function, over lines of which every third is a heading."""
    tables.register(spark)
    n = F.col("p") + 1
    each = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    head = F.concat(F.repeat(F.lit("#"), (1 + (n / 3).cast("int") % 4).cast("int")), F.lit(" Section "), (n / 3).cast("int").cast("string"))
    each.select("path", n.alias("n"), F.when(n % 3 == 0, head).otherwise(F.concat(F.lit("- "), "line")).alias("line")).createOrReplaceTempView("docloom_lines")
    try:
        return sqlguard.run(spark, "select * from line_sections(table(docloom_lines))")
    finally:
        spark.catalog.dropTempView("docloom_lines")


#: Pages that some links mean: by name, by other case, by slug and by folder.
PATHS = """SELECT DISTINCT CASE length(w) % 4 WHEN 0 THEN concat(lower(w), '.md') WHEN 1 THEN concat(w, '/index.md') WHEN 2 THEN concat(w, '-.mdx') ELSE concat(w, '.html') END AS path FROM (SELECT regexp_replace(url, '^.*/', '') AS w FROM pages UNION ALL SELECT {} AS w FROM pages) x WHERE length(w) % 5 <> 0"""
_WORD = "substr(regexp_extract(html, 'href=\"(/[^\"]*)\"', 1), 2)"
PATHS = PATHS.format(_WORD)
_LINKS = """WITH paths AS (""" + PATHS + """), l AS (SELECT 'docs/a.md' AS path, target FROM (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN h ELSE '../' || substr(h, 2) || '?q#x' END AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages))),
t AS (SELECT *, CASE WHEN starts_with(target, '/') THEN 'rooted' ELSE 'relative' END AS kind, regexp_replace(regexp_replace(target, '[?#].*$', ''), '^([.][.])?/', '') AS wanted FROM l),
c AS (SELECT target, wanted || unnest(['', '.md', '.mdx', '.html', '/index.md', '/index.mdx', '/index.html']) AS c, unnest(range(7)) AS n FROM t WHERE wanted <> ''),
k AS (SELECT path AS page, 0 AS tier, path AS k FROM paths UNION ALL SELECT min(path), 1, lower(path) FROM paths GROUP BY lower(path) HAVING count(*) = 1 UNION ALL SELECT min(path), 2, regexp_replace(lower(path), '[-_]', '', 'g') FROM paths GROUP BY regexp_replace(lower(path), '[-_]', '', 'g') HAVING count(*) = 1),
h AS (SELECT c.target, arg_min(k.page, c.n * 3 + k.tier) AS page FROM c JOIN k ON k.k = CASE k.tier WHEN 0 THEN c.c WHEN 1 THEN lower(c.c) ELSE regexp_replace(lower(c.c), '[-_]', '', 'g') END GROUP BY c.target)"""


def _classified(spark, d):
    p = table(spark, d, "pages")
    p.createOrReplaceTempView("pages")
    href = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"))
    own = href.select(F.lit("docs/a.md").alias("path"), F.when(F.col("page_id") % 2 == 0, F.col("h")).otherwise(F.concat(F.lit("../"), F.substr("h", F.lit(2)), F.lit("?q#x"))).alias("target")).distinct()
    return links.classify(own, spark.sql(PATHS))


@query(_LINKS + " SELECT t.path, t.target, t.kind, h.page, h.page IS NULL AS broken FROM t LEFT JOIN h ON h.target = t.target")
def resolve_route(spark, d):
    return _classified(spark, d)


@query(_LINKS + " SELECT t.target FROM t LEFT JOIN h ON h.target = t.target WHERE h.page IS NULL")
def broken_links(spark, d):
    return _classified(spark, d).where("broken").select("target")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'http://a/' || o_custkey % 397 || '?p=' || o_custkey % 3 AS a, 'http://a/' || o_orderkey % 389 || '?p=' || o_orderkey % 3 AS b FROM orders), s AS (SELECT 'http://a/5?p=2' AS url, 0 AS depth UNION SELECT e.b, s.depth + 1 FROM s JOIN e ON e.a = s.url WHERE s.depth < 2 AND NOT regexp_matches(e.b, '/1[0-9][?]'))
SELECT url, min(depth) AS depth FROM s GROUP BY url""")
def crawl_frontier(spark, d):
    at = lambda key, n, tail: F.concat(F.lit("http://A:80/"), (F.col(key) % n).cast("string"), F.lit("/?p="), (F.col(key) % 3).cast("string"), F.lit(tail))
    e = table(spark, d, "orders").select(at("o_custkey", 397, "").alias("url"), at("o_orderkey", 389, "#top").alias("href"))
    return links.frontier(spark.createDataFrame([("http://a/5/?p=2",)], "url string"), e, "http://a", ["1[0-9]?p=*"], 2)


# ---- triples ----------------------------------------------------------------------------------------------------

_TEXT = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<{0}>(.*?)</{0}>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))"
_SLUG = "regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _page_triples(spark, d):
    each = table(spark, d, "pages")
    kept = "kind in ('heading', 'link') or kind = 'element' and text = 'title'"
    n = cut(_nodes(spark, d).where(kept).select("path", "seq", "kind", "level", "text", "target", "line", F.col("attrs")["content"].alias("content")))  # parsed once
    title = n.where("kind = 'element' and content is not null").groupBy("path").agg(F.min_by("content", F.struct("seq", "content")).alias("title"))
    lang = F.nullif(F.regexp_extract("html", '<html[^>]* lang="([^"]*)"', 1), F.lit(""))
    p = each.select(F.col("page_id").cast("string").alias("path"), lang.alias("lang")).join(title, "path", "left")
    s = structure.sections(n.where("text <> ''"))  # a heading without text is no section
    l = n.where("kind = 'link'").select("path", "target")  # noqa: E741
    known = cut(each.select(F.concat(F.regexp_extract("html", 'href="/([^"]*)"', 1), F.lit(".md")).alias("path")).distinct())
    return triples.derive(p, s, links.classify(l, known))


@query(f"""WITH p AS (SELECT CAST(page_id AS VARCHAR) AS id, 'https://example.org/' || page_id AS s, html, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) AS lang FROM pages), h AS (SELECT s, {_TEXT.format("h1")} AS t FROM p),
n AS (SELECT DISTINCT regexp_extract(html, 'href="/([^"]*)"', 1) AS w FROM pages), l AS (SELECT s, unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '', 'g'), '<a href="([^"]*)"', 1)) AS t FROM p),
k AS (SELECT w || '.md' AS page, 0 AS tier, w || '.md' AS k FROM n UNION ALL SELECT min(w) || '.md', 1, lower(w) || '.md' FROM n GROUP BY lower(w) HAVING count(*) = 1 UNION ALL SELECT min(w) || '.md', 2, regexp_replace(lower(w), '[-_]', '', 'g') || '.md' FROM n GROUP BY regexp_replace(lower(w), '[-_]', '', 'g') HAVING count(*) = 1),
t AS (SELECT t, regexp_replace(regexp_replace(t, '[?#].*$', ''), '^/', '') AS w FROM (SELECT DISTINCT t FROM l) WHERE NOT regexp_matches(t, '^([A-Za-z][A-Za-z0-9+.-]*:|//|#|$)')),
c AS (SELECT t, regexp_replace(w, '/$', '') || unnest(CASE WHEN w = '' THEN ['index.md', 'index.mdx', 'index.html', '.md', '.mdx', '.html'] WHEN ends_with(w, '/') THEN ['/index.md', '/index.mdx', '/index.html', '.md', '.mdx', '.html'] ELSE ['', '.md', '.mdx', '.html', '/index.md', '/index.mdx', '/index.html'] END) AS c, unnest(CASE WHEN w = '' OR ends_with(w, '/') THEN range(6) ELSE range(7) END) AS n FROM t),
f AS (SELECT t, n, 0 AS tier, c AS k FROM c UNION ALL SELECT t, n, 1, lower(c) FROM c UNION ALL SELECT t, n, 2, regexp_replace(lower(c), '[-_]', '', 'g') FROM c),
r AS (SELECT f.t, arg_min(k.page, f.n * 3 + f.tier) AS page FROM f JOIN k ON k.k = f.k AND k.tier = f.tier GROUP BY f.t)
SELECT 'rdf:type' AS p, count(*) AS n FROM (SELECT s FROM p UNION ALL SELECT s FROM h WHERE t <> '') UNION ALL SELECT 'docs:path', count(*) FROM p UNION ALL SELECT 'dcterms:language', count(*) FROM p WHERE lang <> ''
UNION ALL SELECT 'dcterms:title', count(*) FROM (SELECT t FROM h UNION ALL SELECT {_TEXT.format("title")} FROM p) x(t) WHERE t <> '' HAVING count(*) > 0
UNION ALL SELECT x, count(*) FROM h, (VALUES ('docs:level'), ('docs:order'), ('dcterms:hasPart')) v(x) WHERE t <> '' GROUP BY x
UNION ALL SELECT 'docs:brokenLink', count(*) FROM (SELECT DISTINCT s, t FROM l WHERE starts_with(t, '/') AND t <> '/' AND NOT EXISTS (SELECT 1 FROM n WHERE lower(regexp_replace(n.w, '[-_]', '', 'g')) = lower(regexp_replace(substr(t, 2), '[-_]', '', 'g'))))
UNION ALL SELECT 'dcterms:references', count(*) FROM (SELECT DISTINCT l.s, r.page FROM l JOIN r ON r.t = l.t) HAVING count(*) > 0
UNION ALL SELECT 'rdfs:seeAlso', count(*) FROM (SELECT DISTINCT s, t FROM l WHERE regexp_matches(t, '^(https?:)?//')) HAVING count(*) > 0""")
def triples_from_pages(spark, d):
    """Triples by predicate."""
    return _page_triples(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


_G = "WITH t AS (SELECT 'docs:n' || n_nationkey AS s, 'docs:in' AS p, 'docs:r' || n_regionkey AS o, 'iri' AS kind FROM nation UNION ALL SELECT 'docs:n' || n_nationkey, 'rdf:type', 'docs:Nation', 'iri' FROM nation UNION ALL SELECT 'docs:c' || c_custkey, 'docs:of', 'docs:n' || c_nationkey, 'iri' FROM customer UNION ALL SELECT 'docs:n' || n_nationkey, 'dcterms:title', n_name, 'literal' FROM nation)"


def _graph(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    name = lambda x, k: F.concat(F.lit(f"docs:{x}"), F.col(k).cast("string"))
    row = lambda df, s, p, o, kind="iri": df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("lang"))
    own = name("n", "n_nationkey")
    return row(n, own, "docs:in", name("r", "n_regionkey")).union(row(n, own, "rdf:type", F.lit("docs:Nation"))).union(row(c, name("c", "c_custkey"), "docs:of", name("n", "c_nationkey"))).union(row(n, own, "dcterms:title", F.col("n_name"), "literal"))


@query(_G + " SELECT p, o AS target, 'out' AS dir FROM t WHERE s = 'docs:n3' AND kind = 'iri' UNION ALL SELECT p, s, 'in' FROM t WHERE o = 'docs:n3' AND kind = 'iri'")
def neighbours(spark, d):
    return triples.neighbours(_graph(spark, d), "docs:n3")


@query(_G + """, e AS (SELECT * FROM t WHERE kind = 'iri' AND s <> o AND p <> 'rdf:type'), x AS (SELECT s AS node FROM e UNION SELECT o FROM e) SELECT 'triples' AS measure, count(*) AS n FROM t UNION ALL SELECT 'subjects', count(DISTINCT s) FROM t UNION ALL SELECT 'nodes', count(DISTINCT s) FROM t WHERE p = 'rdf:type' UNION ALL SELECT 'broken links', 0 UNION ALL SELECT 'orphans', count(*) FROM (SELECT s FROM t WHERE p = 'rdf:type' EXCEPT SELECT node FROM x)""")
def graph_stats(spark, d):
    return triples.stats(_graph(spark, d), "docs:Nation")


@query(_G + """, f AS (SELECT DISTINCT s AS focus FROM t WHERE p = 'rdf:type' AND o = 'docs:Nation'), v AS (SELECT s AS focus, p, o, kind FROM t WHERE s IN (SELECT focus FROM f))
SELECT 'S1' AS shape, focus, 'docs:in' AS path, 'in' AS "constraint", o AS value FROM v WHERE p = 'docs:in' AND o NOT IN ('docs:r0', 'docs:r1', 'docs:r2') UNION ALL SELECT 'S1', focus, 'docs:in', 'class', o FROM v WHERE p = 'docs:in'
UNION ALL SELECT 'S2', focus, 'dcterms:title', 'pattern', o FROM v WHERE p = 'dcterms:title' AND NOT regexp_matches(o, '^[A-M]') UNION ALL SELECT 'S3', focus, 'docs:of', 'minCount', '0' FROM f""")
def shape_checks(spark, d):
    return triples.shapes(_graph(spark, d), [{"shape": "S1", "target": "docs:Nation", "path": "docs:in", "one_of": ["docs:r0", "docs:r1", "docs:r2"], "class": "docs:Region", "max_count": 1, "kind": "iri"}, {"shape": "S2", "target": "docs:Nation", "path": "dcterms:title", "pattern": "^[A-M]"}, {"shape": "S3", "target": "docs:Nation", "path": "docs:of", "min_count": 1}])


#: Suppliers in nations in regions, with names and balances.
_SN = """WITH t AS (SELECT 'n' || n_nationkey AS s, 'in' AS p, 'r' || n_regionkey AS o, 'iri' AS kind FROM nation UNION ALL SELECT 's' || s_suppkey, 'in', 'n' || s_nationkey, 'iri' FROM supplier UNION ALL SELECT 's' || s_suppkey, 'name', s_name, 'literal' FROM supplier UNION ALL SELECT 's' || s_suppkey, 'balance', CAST(s_acctbal AS VARCHAR), 'literal' FROM supplier
UNION ALL SELECT 's' || s_suppkey, 'rdf:type', 'Supplier', 'iri' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'rdf:type', 'Nation', 'iri' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'rdf:type', 'Region', 'iri' FROM region UNION ALL SELECT 'n' || n_nationkey, 'name', n_name, 'literal' FROM nation UNION ALL SELECT 's' || s_suppkey, 'knows', 's' || (s_suppkey // 2), 'iri' FROM supplier WHERE s_suppkey > 1)"""


def _suppliers(spark, d):
    n, u, r = (table(spark, d, t) for t in ("nation", "supplier", "region"))
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    row = lambda x, s, p, o, kind: x.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("lang"))
    nk, sk, rk = key("n", "n_nationkey"), key("s", "s_suppkey"), key("r", "r_regionkey")
    boss = F.concat(F.lit("s"), F.floor(F.col("s_suppkey") / 2).cast("string"))
    each = [row(n, nk, "in", key("r", "n_regionkey"), "iri"), row(u, sk, "in", key("n", "s_nationkey"), "iri"), row(u, sk, "name", F.col("s_name"), "literal"), row(u, sk, "balance", F.col("s_acctbal"), "literal"), row(n, nk, "name", F.col("n_name"), "literal"), row(u.where("s_suppkey > 1"), sk, "knows", boss, "iri")]
    each += [row(x, k, "rdf:type", F.lit(c), "iri") for x, k, c in ((u, sk, "Supplier"), (n, nk, "Nation"), (r, rk, "Region"))]
    return reduce(DataFrame.union, each)


@query(_SN + """, s AS (SELECT a.s, b.o AS region, a.o AS nation FROM t a JOIN t b ON b.s = a.o AND b.p = 'in' WHERE a.p = 'in' AND a.s LIKE 's%'), up AS (SELECT s_suppkey AS k, CAST(len(bin(s_suppkey)) - 1 AS BIGINT) AS above FROM supplier)
SELECT 'far' AS shape, s AS focus, '{"sequence": ["in", "in"]}' AS path, 'in' AS "constraint", region AS value FROM s WHERE region NOT IN ('r0', 'r1') UNION ALL SELECT 'near', s, '{"one_or_more": "in"}', 'class', nation FROM s UNION ALL SELECT 'many', o, '{"inverse": "in"}', 'min_count', CAST(count(DISTINCT t.s) AS VARCHAR) FROM t WHERE p = 'in' AND o LIKE 'r%' GROUP BY o HAVING count(DISTINCT t.s) < 6
UNION ALL SELECT 'either', s.s, NULL, 'or', s.s FROM s JOIN t ON t.s = s.s AND t.p = 'balance' WHERE TRY_CAST(t.o AS DOUBLE) < 5000 AND region <> 'r2' UNION ALL SELECT 'never', s, NULL, 'not', s FROM t WHERE p = 'name' AND s LIKE 's%' AND regexp_matches(o, '[05]$') UNION ALL SELECT 'chain', 's' || k, '{"zero_or_more": "knows"}', 'max_count', CAST(above + 1 AS VARCHAR) FROM up WHERE above + 1 > 5
UNION ALL SELECT 'through', s.nation, 'name', 'pattern', t.o FROM (SELECT DISTINCT nation FROM s) s JOIN t ON t.s = s.nation AND t.p = 'name' WHERE NOT regexp_matches(t.o, '[1-9]') UNION ALL SELECT 'one', s.s, NULL, 'xone', s.s FROM s JOIN t ON t.s = s.s AND t.p = 'balance' WHERE (TRY_CAST(t.o AS DOUBLE) >= 0) = (region = 'r1')""")
def shape_paths(spark, d):
    of = {"target": {"class": "Supplier"}}
    shapes = [
        {"name": "far", **of, "path": {"sequence": ["in", "in"]}, "in": ["r0", "r1"]}, {"name": "near", **of, "path": {"one_or_more": "in"}, "class": "Region"}, {"name": "many", "target": {"class": "Region"}, "path": {"inverse": "in"}, "min_count": 6},
        {"name": "either", **of, "or": [{"path": "balance", "min": 5000}, {"path": {"sequence": ["in", "in"]}, "has_value": "r2"}]}, {"name": "never", **of, "not": {"path": "name", "pattern": "[05]$"}}, {"name": "chain", **of, "path": {"zero_or_more": "knows"}, "max_count": 5},
        {"name": "through", **of, "path": "in", "property": [{"path": "name", "pattern": "[1-9]"}]}, {"name": "one", **of, "xone": [{"path": "balance", "min": 0}, {"node": "second"}]}, {"name": "second", "path": {"sequence": ["in", "in"]}, "has_value": "r1"},
    ]
    return shacl.check(_suppliers(spark, d), shapes).select("shape", "focus", "path", "constraint", "value")


@query(_SN + """ SELECT a.s AS supplier, b.o AS region, n.o AS name FROM t a JOIN t b ON b.s = a.o AND b.p = 'in' JOIN t n ON n.s = a.o AND n.p = 'name' JOIN t y ON y.s = a.s AND y.p = 'rdf:type' AND y.o = 'Supplier' WHERE a.p = 'in'""")
def pattern_chain(spark, d):
    return patterns.solve(_suppliers(spark, d), [("?supplier", "rdf:type", "Supplier"), ("?nation", "in", "?region"), ("?supplier", "in", "?nation"), ("?nation", "name", "?name")], select=["supplier", "region", "name"])


@query(_SN + """ SELECT y.s AS x, k.o AS boss, n.o AS of FROM t y LEFT JOIN t k ON k.s = y.s AND k.p = 'knows' LEFT JOIN (SELECT s, o FROM t WHERE p = 'in' AND o IN (SELECT s FROM t WHERE p = 'in' AND o = 'r1')) n ON n.s = y.s WHERE y.p = 'rdf:type' AND y.o = 'Supplier'""")
def pattern_optional(spark, d):
    return patterns.solve(_suppliers(spark, d), [("?x", "rdf:type", "Supplier")], optional=[[("?x", "knows", "?boss")], [("?x", "in", "?of"), ("?of", "in", "r1")]])


@query(_SN + """ SELECT x.s AS x, n.o AS name, m.v AS place FROM t x JOIN t n ON n.s = x.s AND n.p = 'name' JOIN (SELECT s, o AS v FROM t WHERE p = 'in' AND o = 'r2' UNION SELECT a.s, b.o FROM t a JOIN t b ON b.s = a.o AND b.p = 'in' WHERE a.p = 'in' AND b.o <> 'r2') m ON m.s = x.s WHERE x.p = 'rdf:type'""")
def pattern_union(spark, d):
    g = _suppliers(spark, d)
    return patterns.solve(g, [("?x", "rdf:type", "?kind"), ("?x", "name", "?name")], union=[[("?x", "in", "?place"), ("?place", "rdf:type", "Region")], [("?x", "in", "?n"), ("?n", "in", "?place")]], having="place <> 'r2' and kind = 'Supplier' or place = 'r2' and kind = 'Nation'", select=["x", "name", "place"])


@query(_SN + """ SELECT a.s AS x, TRY_CAST(b.o AS DOUBLE) AS balance FROM t a JOIN t b ON b.s = a.s AND b.p = 'balance' WHERE a.p = 'rdf:type' AND a.o = 'Supplier' AND TRY_CAST(b.o AS DOUBLE) > 1000 AND a.s NOT IN (SELECT o FROM t WHERE p = 'knows')""")
def pattern_filter(spark, d):
    found = patterns.solve(_suppliers(spark, d), [("?x", "rdf:type", "Supplier"), ("?x", "balance", "?b")], absent=[[("?y", "knows", "?x")]], having="cast(b as double) > 1000")
    return found.select("x", F.col("b").cast("double").alias("balance"))


@query(_SN + """ SELECT DISTINCT a.s AS x, b.s AS y FROM t a JOIN t k ON k.s = a.s AND k.p = 'knows' JOIN t b ON b.s = k.o AND b.p = 'in' AND b.o = a.o WHERE a.p = 'in'""")
def pattern_cycle(spark, d):
    """Two that know each other's place: the parts close a ring."""
    return patterns.solve(_suppliers(spark, d), [("?x", "in", "?n"), ("?x", "knows", "?y"), ("?y", "in", "?n")], select=["x", "y"])


@query(_G + " SELECT s, p, o, 'https://example.org/' AS base, CASE WHEN starts_with(p, 'rdf:') THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#' || substr(p, 5) WHEN starts_with(p, 'docs:') THEN 'urn:docloom:' || substr(p, 6) ELSE 'http://purl.org/dc/terms/' || substr(p, 9) END AS iri, p AS again FROM t")
def expand_compact(spark, d):
    iri = triples.expand(F.col("p"))
    return _graph(spark, d).select("s", "p", "o", F.lit("https://example.org/").alias("base"), iri.alias("iri"), triples.compact(iri).alias("again"))


@query(f"WITH t AS ({TERMS}), r AS (SELECT * FROM t WHERE see IS NULL) SELECT 'skos:prefLabel' AS p, count(*) AS n FROM (SELECT DISTINCT {_SLUG.format('id')}, label, language FROM r) UNION ALL SELECT 'rdf:type', count(DISTINCT {_SLUG.format('id')}) FROM r UNION ALL SELECT 'skos:exactMatch', count(*) FROM (SELECT DISTINCT {_SLUG.format('id')}, exact FROM r) UNION ALL SELECT 'skos:hiddenLabel', count(*) FROM (SELECT DISTINCT {_SLUG.format('id')}, unnest(hidden), language FROM r)")
def triples_from_terms(spark, d):
    t = terms_of(spark, d)
    g = triples.from_terms(t, glossary.edges(t))
    return g.where("p in ('skos:prefLabel', 'rdf:type', 'skos:exactMatch', 'skos:hiddenLabel')").groupBy("p").agg(F.count(F.lit(1)).alias("n"))


# ---- validation and write-back ----------------------------------------------------------------------------------

SCHEMA = {
    "type": "object", "required": ["lang", "note"], "additionalProperties": False,
    "properties": {"lang": {"enum": ["en", "fr"]}, "source": {"type": "string", "pattern": "^src[0-4]", "maxLength": 5}, "n": {"type": "integer", "minimum": 200, "maximum": 4000, "multipleOf": 2}, "tags": {"type": "array", "items": {"type": "string"}, "minItems": 2, "uniqueItems": True}, "day": {"format": "date"}},
    "anyOf": [{"properties": {"n": {"minimum": 1000}}}, {"properties": {"lang": {"const": "de"}}}],
}


def _pages_of(spark, d):
    doc = table(spark, d, "documents")
    i = F.col("doc_id")
    tags = F.when(i % 3 == 0, F.array("lang", "lang")).when(i % 3 == 1, F.array("lang")).otherwise(F.array("lang", "source"))
    data = F.to_json(F.struct("lang", "source", F.col("n_chars").alias("n"), tags.alias("tags"), F.when(i % 4 == 0, "2024-01-15").when(i % 4 == 1, "Jan 15").alias("day"), F.when(i % 7 == 0, "x").alias("extra"), F.when(i % 2 == 0, "y").alias("note")))
    return doc.select(F.concat(F.lit("docs/"), i.cast("string"), F.lit(".md")).alias("_path"), F.when(i % 50 == 49, "{").otherwise(data).alias("_data"))


_V = """WITH d AS (SELECT *, 'docs/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 50 <> 49), f AS (
SELECT path, '' AS pointer, 'required' AS keyword FROM d WHERE doc_id % 2 <> 0 UNION ALL SELECT path, '', 'additionalProperties' FROM d WHERE doc_id % 7 = 0 OR doc_id % 2 = 0 UNION ALL SELECT path, '/lang', 'enum' FROM d WHERE lang NOT IN ('en', 'fr')
UNION ALL SELECT path, '/source', 'pattern' FROM d WHERE NOT regexp_matches(source, '^src[0-4]') UNION ALL SELECT path, '/source', 'maxLength' FROM d WHERE length(source) > 5 UNION ALL SELECT path, '/n', 'minimum' FROM d WHERE n_chars < 200 UNION ALL SELECT path, '/n', 'maximum' FROM d WHERE n_chars > 4000
UNION ALL SELECT path, '/n', 'multipleOf' FROM d WHERE n_chars % 2 = 1 UNION ALL SELECT path, '/tags', 'minItems' FROM d WHERE doc_id % 3 = 1 UNION ALL SELECT path, '/tags', 'uniqueItems' FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT path, '/day', 'format' FROM d WHERE doc_id % 4 = 1
UNION ALL SELECT path, '', 'anyOf' FROM d WHERE n_chars < 1000 AND lang <> 'de' UNION ALL SELECT 'docs/' || doc_id || '.md', '', 'parse' FROM documents WHERE doc_id % 50 = 49)"""


@query(_V + " SELECT * FROM f")
def validate_schema(spark, d):
    return validation.validate(_pages_of(spark, d), {"page": SCHEMA}).select("path", "pointer", "keyword")


@query("""SELECT 'docs/' || doc_id || '.md' AS _path, CASE WHEN doc_id % 5 = 0 THEN 'own' WHEN doc_id % 10 = 3 THEN unnest(['base', 'three']) WHEN doc_id % 10 = 4 THEN 'four' ELSE 'base' END AS schema, CASE WHEN doc_id % 5 = 0 THEN 'document' WHEN doc_id % 10 = 3 THEN 'override 0' WHEN doc_id % 10 = 4 THEN 'override 1' ELSE 'config' END AS source FROM documents WHERE doc_id % 10 = 3
UNION ALL SELECT 'docs/' || doc_id || '.md', CASE WHEN doc_id % 5 = 0 THEN 'own' WHEN doc_id % 10 = 4 THEN 'four' ELSE 'base' END, CASE WHEN doc_id % 5 = 0 THEN 'document' WHEN doc_id % 10 = 4 THEN 'override 1' ELSE 'config' END FROM documents WHERE doc_id % 10 <> 3""")
def resolve_schemas(spark, d):
    doc = table(spark, d, "documents")
    data = F.to_json(F.struct(F.when(F.col("doc_id") % 5 == 0, "own").alias("$schema")))
    docs = doc.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("_path"), data.alias("_data"))
    over = [{"paths": ["docs/*3.md"], "schemas": ["three"], "defaults": True}, {"paths": ["docs/*[34].md"], "schemas": ["four"]}]
    return validation.resolve_schemas(docs, [], over, ["base"], ["default"])


@query("""SELECT doc_id, field, CASE WHEN field = 'owner' THEN lang ELSE CASE WHEN doc_id % 3 <> 0 THEN source ELSE lang END END AS value FROM documents, (VALUES ('owner'), ('note')) v(field)""")
def derive_fields(spark, d):
    doc = table(spark, d, "documents")
    e = doc.select(F.col("doc_id").alias("path"), F.explode(F.array(F.struct(F.lit("owner").alias("field"), F.lit("git").alias("source"), F.col("lang").alias("value")), F.struct(F.lit("note").alias("field"), F.lit("git").alias("source"), F.col("lang").alias("value")), F.struct(F.lit("note").alias("field"), F.lit("review").alias("source"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("value")))).alias("x")).select("path", "x.*")
    out = validation.derive_fields(e, {"owner": ["codeowners", "git"], "note": ["review", "git"]})
    return out.select(F.col("path").alias("doc_id"), "field", "value")


def _before(spark, d):
    p = table(spark, d, "part")
    own = F.concat(F.lit("p/"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return p.select(own.alias("_path"), F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("it's"))).alias("_data"), own.alias("row"), F.col("p_partkey").alias("k"))


def _changes(spark, d):
    b = _before(spark, d)
    k = F.col("k")
    a = writeback.set_keys(b, {"size": F.lit("99"), "it's": None, "new": F.when(k % 2 == 0, F.lit("null")).otherwise(F.lit('["a"]'))}, k % 5 == 0)
    a = a.where("k % 7 <> 0").withColumn("_path", F.when((k % 11 == 0) & (k % 5 != 0), F.concat(F.lit("q/"), k.cast("string"), F.lit(".md"))).otherwise(F.col("_path")))
    new = b.where("k % 40 = 3").select(F.concat(F.lit("n/"), k.cast("string"), F.lit(".md")).alias("_path"), F.lit('{"a":1}').alias("_data"), F.lit(None).cast("string").alias("row"))
    return b.drop("k"), writeback.plan(b.drop("k"), a.drop("k").unionByName(new))


_W = """WITH b AS (SELECT *, p_partkey AS k, 'p/' || p_partkey || '.md' AS row FROM part), c AS (SELECT row, row AS path, 'cleared' AS change, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS old, CAST(NULL AS VARCHAR) AS new FROM b WHERE k % 7 = 0
UNION ALL SELECT row, row, 'renamed', '_path', row, 'q/' || k || '.md' FROM b WHERE k % 7 <> 0 AND k % 11 = 0 AND k % 5 <> 0 UNION ALL SELECT NULL, 'n/' || k || '.md', 'created', NULL, NULL, '{"a":1}' FROM b WHERE k % 40 = 3
UNION ALL SELECT row, row, 'set', 'size', CAST(p_size AS VARCHAR), '99' FROM b WHERE k % 5 = 0 AND k % 7 <> 0 AND p_size <> 99 UNION ALL SELECT row, row, 'removed', 'it''s', '"' || p_brand || '"', NULL FROM b WHERE k % 5 = 0 AND k % 7 <> 0
UNION ALL SELECT row, row, CASE WHEN k % 2 = 0 THEN 'null' ELSE 'set' END, 'new', NULL, CASE WHEN k % 2 = 0 THEN 'null' ELSE '["a"]' END FROM b WHERE k % 5 = 0 AND k % 7 <> 0)"""


@query(_W + ' SELECT "row", path, change, key, old, new FROM c')
def writeback_plan(spark, d):
    return _changes(spark, d)[1]


@query("""SELECT 'p/3.md' AS path, 'a rename is the only change of its document' AS reason UNION ALL SELECT 'p/3.md', 'a rename keeps the extension' UNION ALL SELECT 'p/3.md', 'the new path exists'""")
def writeback_refusals(spark, d):
    b, c = _changes(spark, d)
    bad = spark.createDataFrame([("p/3.md", "p/3.md", "renamed", "_path", "p/3.md", "p/4.txt"), ("p/3.md", "p/3.md", "set", "size", "1", "2")], c.schema)
    there = spark.createDataFrame([("p/4.txt", "{}", "p/4.txt")], "_path string, _data string, row string")
    return writeback.refusals(c.union(bad), b.unionByName(there))


@query(_W + """ SELECT CASE WHEN k % 7 <> 0 AND k % 11 = 0 AND k % 5 <> 0 THEN 'q/' || k || '.md' ELSE row END AS _path, CASE WHEN k % 7 = 0 THEN 0 WHEN k % 5 = 0 THEN 3 ELSE 3 END AS keys FROM b UNION ALL SELECT path, 1 FROM c WHERE change = 'created'""")
def writeback_apply(spark, d):
    b, c = _changes(spark, d)
    return writeback.apply(c, b).select("_path", F.size(F.json_object_keys("_data")).alias("keys"))


#: Orders as documents with items: members by pattern, conditions, references and what is left over.
NESTED = {
    "$defs": {"item": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "q": {"type": "number"}, "flag": {"enum": ["A", "N", "R"]}}, "patternProperties": {"^x_[1-4]$": {"type": "number", "maximum": 40}}, "additionalProperties": {"type": "string"}}},
    "type": "object",
    "properties": {"status": {"type": "string"}, "closed": {}, "by": {}, "items": {"type": "array", "items": {"$ref": "#/$defs/item", "maxProperties": 4}, "contains": {"properties": {"flag": {"const": "R"}}, "required": ["flag"]}, "maxContains": 3}},
    "if": {"properties": {"status": {"const": "F"}}}, "then": {"required": ["closed"]}, "else": {"properties": {"items": {"maxItems": 6}}},
    "dependentRequired": {"closed": ["by"]}, "unevaluatedProperties": False,
}
_NESTED = """WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS k FROM lineitem), o AS (SELECT o_orderkey AS key, CAST(o_orderkey AS VARCHAR) AS path, o_orderstatus AS status, o_orderkey % 3 = 0 AS closed, o_orderkey % 6 = 0 AS named, o_orderkey % 50 = 0 AS extra, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM orders JOIN i ON l_orderkey = o_orderkey GROUP BY ALL),
t AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, '/items/' || k AS spot, l_linenumber AS l, l_quantity AS q, l_partkey % 20 = 0 AS z FROM i JOIN orders ON o_orderkey = l_orderkey)"""


@query(_NESTED + """ SELECT path, spot || '/x_' || l AS pointer, CASE WHEN l <= 4 THEN 'maximum' ELSE 'type' END AS keyword FROM t WHERE l > 4 OR q > 40 UNION ALL SELECT path, spot || '/z', 'type' FROM t WHERE z UNION ALL SELECT path, spot, 'maxProperties' FROM t WHERE z UNION ALL SELECT path, '/items', 'contains' FROM o WHERE r NOT BETWEEN 1 AND 3
UNION ALL SELECT path, '', 'required' FROM o WHERE status = 'F' AND NOT closed UNION ALL SELECT path, '/items', 'maxItems' FROM o WHERE status <> 'F' AND n > 6 UNION ALL SELECT path, '', 'dependentRequired' FROM o WHERE closed AND NOT named UNION ALL SELECT path, '', 'unevaluatedProperties' FROM o WHERE extra""")
def validate_nested(spark, d):
    c = F.col
    q = c("l_quantity").cast("string")
    item = F.concat(F.lit('{"n":'), c("l_linenumber").cast("string"), F.lit(',"q":'), q, F.lit(',"flag":"'), "l_returnflag", F.lit('","x_'), c("l_linenumber").cast("string"), F.lit('":'), q, F.when(c("l_partkey") % 20 == 0, ',"z":1').otherwise(""), F.lit("}"))
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", item.alias("item")))).alias("x"))
    o = table(spark, d, "orders").join(li, c("o_orderkey") == c("l_orderkey"))
    key = c("o_orderkey")
    data = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","items":['), F.array_join(F.transform("x", lambda e: e["item"]), ","), F.lit("]"), F.when(key % 3 == 0, ',"closed":true').otherwise(""), F.when(key % 6 == 0, ',"by":"x"').otherwise(""), F.when(key % 50 == 0, ',"extra":null').otherwise(""), F.lit("}"))
    return validation.validate(o.select(key.cast("string").alias("_path"), data.alias("_data")), {"order": NESTED}).select("path", "pointer", "keyword")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE '/priority' END AS pointer, CASE WHEN o_orderkey % 8 = 0 THEN 'required' ELSE 'enum' END AS keyword FROM orders WHERE o_orderkey % 8 = 0 OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')")
def required_fields(spark, d):
    key = F.col("o_orderkey")
    data = F.to_json(F.struct(F.when(key % 8 != 0, F.col("o_orderpriority")).alias("priority")))
    schema = {"required": ["priority"], "properties": {"priority": {"enum": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]}}}
    return validation.validate(table(spark, d, "orders").select(key.cast("string").alias("_path"), data.alias("_data")), {"order": schema}).select("path", "pointer", "keyword")


@query("SELECT o_orderkey, CASE WHEN d IS NULL THEN 'unknown' WHEN a IS NULL THEN 'unset' WHEN a = d THEN 'current' ELSE 'stale' END AS state FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN ['F', 'O'] ELSE [o_orderstatus] END END AS a, m.d FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_linestatus)) AS d FROM lineitem GROUP BY l_orderkey) m ON m.l_orderkey = o_orderkey)")
def staleness(spark, d):
    derived = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linestatus").alias("derived"))
    asserted = F.when(F.col("o_orderkey") % 5 != 0, F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("O"), F.lit("F"))).otherwise(F.array("o_orderstatus")))
    v = table(spark, d, "orders").join(derived, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", asserted.alias("asserted"), "derived")
    return validation.staleness(v).select("o_orderkey", "state")


@query("WITH b AS (SELECT user_id, max(value) AS confidence FROM events WHERE value >= 0.7 GROUP BY user_id), x AS (SELECT e.user_id, b.confidence, max('\"' || event_type || '\"') AS value FROM events e JOIN b ON b.user_id = e.user_id AND b.confidence = e.value GROUP BY 1, 2) SELECT user_id AS path, 'type' AS key, value, confidence FROM x WHERE value IN ('\"view\"', '\"click\"', '\"error\"')")
def fill_gate(spark, d):
    e = table(spark, d, "events")
    p = e.select(F.col("user_id").alias("path"), F.lit("type").alias("key"), F.concat(F.lit('"'), "event_type", F.lit('"')).alias("value"), F.col("value").alias("confidence"))
    more = e.select(F.col("user_id").alias("path"), F.lit("undeclared").alias("key"), F.lit("1").alias("value"), F.lit(1.0).alias("confidence"))
    return validation.fill(p.union(more), {"properties": {"type": {"enum": ["view", "click", "error"]}}})


# ---- histories --------------------------------------------------------------------------------------------------

_EDITS = """WITH RECURSIVE e AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS c, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 1 WHEN 'error' THEN 0 ELSE 2 END AS n, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 2 ELSE 1 END AS o FROM events),
r AS (SELECT DISTINCT u, CAST(0 AS BIGINT) AS c, CAST([] AS BIGINT[]) AS ls FROM e UNION ALL SELECT r.u, e.c, list_concat(list_concat(r.ls[1:least(e.k, len(r.ls))], CAST([e.c FOR x IN range(e.n)] AS BIGINT[])), r.ls[least(e.k, len(r.ls)) + least(e.o, len(r.ls) - least(e.k, len(r.ls))) + 1:]) FROM r JOIN e ON e.u = r.u AND e.c = r.c + 1)"""


def _edits(spark, d):
    """Each user is a file and each event a commit that puts n lines in place of o lines after line k; every tenth commit renames the file."""
    from pyspark.sql import Window

    t, w = F.col("event_type"), Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", F.row_number().over(w).cast("long").alias("commit"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(t == "view", 3).when(t == "click", 1).when(t == "error", 0).otherwise(2).cast("long").alias("n"), F.when(t == "view", 0).when(t == "click", 2).otherwise(1).cast("long").alias("o"))
    # the length before each commit follows from all before it
    e = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("commit", "k", "n", "o"))).alias("x"))
    first = F.struct(F.lit(0).cast("long").alias("size"), F.expr("cast(array() as array<struct<commit: long, at: long, n: long, o: long>>)").alias("out"))
    grown = F.aggregate("x", first, lambda a, y: F.struct((a["size"] + y["n"] - F.least(y["o"], a["size"] - F.least(y["k"], a["size"]))).alias("size"), F.array_append(a["out"], F.struct(y["commit"].alias("commit"), F.least(y["k"], a["size"]).alias("at"), y["n"].alias("n"), F.least(y["o"], a["size"] - F.least(y["k"], a["size"])).alias("o"))).alias("out")))
    e = e.select("user_id", F.explode(grown["out"]).alias("x")).select("user_id", "x.*")
    name = lambda c: F.concat("user_id", F.lit("."), F.floor(c / 10).cast("string"))
    here = name(F.col("commit"))
    edits = e.where("n > 0 or o > 0").select(here.alias("path"), "commit", (F.col("at") + (F.col("o") > 0).cast("long")).alias("old_first"), F.col("o").alias("old_count"), (F.col("at") + (F.col("n") > 0).cast("long")).alias("new_first"), F.col("n").alias("new_count"))
    return edits, e.where("commit % 10 = 0").select("commit", name(F.col("commit") - 1).alias("was"), here.alias("path"))


@query(_EDITS + ", z AS (SELECT u, max(c) AS c FROM r GROUP BY u), f AS (SELECT r.u, r.c, r.ls FROM r JOIN z ON z.u = r.u AND z.c = r.c) SELECT u || '.' || CAST(c // 10 AS BIGINT) AS path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS commit FROM f")
def line_origins(spark, d):
    return provenance.blame(*_edits(spark, d)).select("path", "line", "commit")


@query("SELECT e.event_id, o.o_orderkey, o.o_orderdate FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 7 ELSE user_id END AS k FROM events) e ASOF LEFT JOIN (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE o_custkey % 150 END AS k, date_trunc('day', o_orderdate) + (o_orderkey % 1440) * INTERVAL 1 MINUTE AS o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.k = o.k AND e.ts >= o.o_orderdate")
def asof_orders(spark, d):
    """Half of either side has one key."""
    hot = lambda i, c: F.when(F.col(i) % 2 == 0, 7).otherwise(c).cast("long").alias("k")
    e = table(spark, d, "events").select(hot("event_id", F.col("user_id")), "event_id", "ts")
    when = F.date_trunc("day", "o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    o = table(spark, d, "orders").select(hot("o_orderkey", F.col("o_custkey") % 150), when.alias("ts"), "o_orderkey")
    return ordered.asof_join(e, o, ["k"], "ts").select("event_id", "o_orderkey", F.col("right_ts").alias("o_orderdate"))


# ---- pins and sessions ------------------------------------------------------------------------------------------

_C = """WITH t AS (SELECT doc_id AS k, CAST(doc_id AS VARCHAR) AS path, string_split(replace(text || CASE WHEN doc_id % 7 = 0 THEN chr(10) || chr(10) WHEN doc_id % 7 = 1 THEN chr(13) WHEN doc_id % 7 = 2 THEN chr(13) || chr(10) ELSE '' END, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
s AS (SELECT k, path, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM t), c AS (SELECT *, CASE WHEN k % 4 = 0 THEN 1 ELSE 2 END AS f FROM s WHERE len(ls) >= 3),
p AS (SELECT path, ls, k, f, array_to_string(ls[f:f], chr(10)) AS t FROM c), n AS (SELECT path, k, f, t, CASE WHEN k % 3 = 1 THEN list_concat(['new'], CASE WHEN k % 6 = 1 THEN list_transform(range(3000), lambda x: 'far') ELSE [] END, ls) WHEN k % 3 = 2 THEN list_concat(['changed', 'too'], ls[f + 1:]) ELSE ls END AS now FROM p),
m AS (SELECT *, len(list_filter(now, lambda x: x = t)) AS places, list_position(now, t) AS spot, now[f] = t AS same FROM n)"""


def _citations(spark, d):
    """Each document's first or second line is cited; some texts end in line feeds or carriage returns, some lines moved, some by 3,000."""
    odd = F.col("doc_id") % 7
    text = F.concat("text", F.when(odd == 0, "\n\n").when(odd == 1, "\r").when(odd == 2, "\r\n").otherwise(""))
    doc = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "doc_id", text.alias("text"))
    first = F.when(F.col("doc_id") % 4 == 0, 1).otherwise(2)
    ls = pins.lines_of(F.col("text"))
    own = F.when(F.col("doc_id") % 2 == 0, F.element_at(ls, first))
    c = doc.where(F.size(ls) >= 3).select(F.col("doc_id").alias("id"), "path", first.alias("first"), first.alias("last"), pins.pin(ls, first, first).alias("pin"), own.alias("original"))
    k = F.col("doc_id") % 3
    far = F.when(F.col("doc_id") % 6 == 1, F.repeat(F.lit("far\n"), F.lit(3000))).otherwise("")
    now = F.when(k == 1, F.concat(F.lit("new\n"), far, "text")).when(k == 2, F.concat(F.lit("changed\ntoo\n"), F.array_join(F.slice(ls, first + 1, F.greatest(F.size(ls) - first, F.lit(0))), "\n"))).otherwise(F.col("text"))
    return c, doc.select("path", now.alias("text"))


@query(_C + " SELECT path, CASE WHEN same THEN 'current' WHEN places = 1 THEN 'moved' WHEN places > 1 THEN 'moved-ambiguous' ELSE 'changed' END AS status FROM m")
def pin_status(spark, d):
    c, now = _citations(spark, d)
    return pins.classify(c, now).select("path", "status")


@query(_C + " SELECT path, CASE WHEN NOT same AND places = 1 THEN spot ELSE f END AS first FROM m")
def pin_reanchor(spark, d):
    c, now = _citations(spark, d)
    return pins.reanchor(c, pins.classify(c, now)).select("path", "first")


@query("""WITH e AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS c, value > 20 AS stale FROM events), n AS (SELECT max(c) AS e FROM e), x AS (SELECT *, c - row_number() OVER (PARTITION BY id, stale ORDER BY c) AS g, max(c) OVER (PARTITION BY id) AS m FROM e)
SELECT id, min(c) AS opened, CASE WHEN max(c) = max(m) THEN CASE WHEN max(c) < (SELECT e FROM n) THEN max(c) + 1 END ELSE max(c) + 1 END AS closed, CASE WHEN max(c) < max(m) THEN 'restored' WHEN max(c) < (SELECT e FROM n) THEN 'removed' END AS reason FROM x WHERE stale GROUP BY id, g""")
def pin_windows(spark, d):
    return pins.stale_windows(_states(spark, d))


def _states(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("id"), n.cast("long").alias("commit"), F.when(F.col("value") > 20, "changed").otherwise("current").alias("status"))


@query("WITH s AS (SELECT quality AS label, d.n_chars % 50 AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id) SELECT round((SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) FROM s a, s b WHERE a.label = 1 AND b.label = 0), 6) AS auc, round(avg((score / CAST(50 AS DOUBLE) - label) ** 2), 6) AS brier FROM s")
def rank_auc(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") % 50 / 50).alias("score"))
    return pins.auc(s).select(F.round("auc", 6).alias("auc"), F.round("brier", 6).alias("brier"))


_E = "WITH e AS (SELECT user_id AS session, event_id AS i, CASE event_type WHEN 'view' THEN 'prompt' WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'tool' ELSE 'text' END AS kind, CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS tool, props, value FROM events)"


def _events(spark, d):
    t = F.col("event_type")
    kind = F.when(t == "view", "prompt").when(t.isin("click", "purchase"), "tool").otherwise("text")
    tool = F.when(t.isin("click", "purchase"), t)
    path = F.concat(F.lit('{"file_path":"src/'), F.get_json_object("props", "$.k"), F.lit('.md"}'))
    no = F.lit(False)
    return table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("index"), kind.alias("kind"), tool.alias("tool"), F.when(tool.isNotNull(), path).alias("input"), F.col("props").alias("text"), F.col("ts"), F.col("value").cast("long").alias("tokens"), no.alias("sidechain"), no.alias("meta"), no.alias("compact"), F.lit("human").alias("origin"))


@query(_E + """, g AS (SELECT session, count(*) FILTER (WHERE tool = 'click') AS u, count(*) FILTER (WHERE kind = 'tool' AND regexp_matches(props, '"k": ?1[0-9]?[}]')) AS f, min(i) FILTER (WHERE tool = 'click') AS a, max(i) FILTER (WHERE tool = 'purchase') AS b, sum(CAST(trunc(value) AS BIGINT)) AS c, coalesce(bool_or(kind = 'text' AND regexp_matches(props, '77')), false) AS r, arg_max(props, i) FILTER (WHERE kind = 'text') AS j FROM e GROUP BY session)
SELECT session, unnest(['uses', 'files', 'order', 'cost', 'says', 'json']) AS grader, unnest([CASE WHEN u BETWEEN 2 AND 20 THEN 'pass' ELSE 'fail' END, CASE WHEN f >= 1 THEN 'pass' ELSE 'fail' END, CASE WHEN a IS NULL AND b IS NULL OR a <= b THEN 'pass' ELSE 'fail' END, CASE WHEN c <= 1500 THEN 'pass' ELSE 'fail' END, CASE WHEN NOT r THEN 'pass' ELSE 'fail' END, CASE WHEN json_extract(j, '$.k') IS NOT NULL THEN 'pass' ELSE 'fail' END]) AS outcome FROM g""")
def trace_graders(spark, d):
    graders = {"uses": {"kind": "tool-usage", "tool": "click", "min": 2, "max": 20}, "files": {"kind": "file-access", "glob": "src/1{,[0-9]}.md"}, "order": {"kind": "tool-order", "first": "click", "then": "purchase"}, "cost": {"kind": "cost", "max": 1500}, "says": {"kind": "regex", "pattern": "77", "match": False}, "json": {"kind": "json-output", "keys": ["k"]}}
    return traces.grade(_events(spark, d), graders).select("session", "grader", "outcome")


@query(_E + " SELECT session, coalesce(bool_or(tool = 'purchase'), false) AND count(*) FILTER (WHERE kind = 'prompt') > 8 AND coalesce(bool_or(kind = 'prompt' AND regexp_matches(props, '[0-4]')), false) AS triggered FROM e GROUP BY session")
def trace_triggers(spark, d):
    return traces.triggered(_events(spark, d), {"tool_used": "purchase", "turn_count_above": 8, "prompt_matches": "[0-4]"})


@query(_E + ", m AS (SELECT session, max(i) FILTER (WHERE kind = 'prompt') AS a, max(i) FILTER (WHERE kind IN ('text', 'tool')) AS w FROM e GROUP BY 1) SELECT e.session, e.i AS \"index\" FROM e JOIN m ON m.session = e.session WHERE m.w > m.a AND e.i >= m.a")
def trace_last_turn(spark, d):
    return traces.last_turn(_events(spark, d)).select("session", "index")


@query(_E + ", s AS (SELECT session, i AS a, coalesce((SELECT min(i) FROM e x WHERE x.session = e.session AND x.i > e.i AND x.kind = 'prompt' AND regexp_matches(props, '[79]')), (SELECT max(i) + 1 FROM e x WHERE x.session = e.session)) AS b FROM e WHERE kind = 'prompt' AND regexp_matches(props, '9')) SELECT DISTINCT e.session, e.i AS \"index\" FROM e JOIN s ON s.session = e.session AND e.i >= s.a AND e.i < s.b")
def trace_window(spark, d):
    e = _events(spark, d)
    e = e.withColumn("text", F.when(F.col("text").rlike("9"), "/deploy now").when(F.col("text").rlike("7"), "/stop").otherwise(F.col("text")))
    return traces.within(e, traces.spans(e, command="deploy")).select("session", "index")


@query("""WITH v AS (SELECT user_id AS c, event_id, event_type IN ('view', 'click') AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT c, count(*) AS runs, round(avg(CASE WHEN p THEN 1.0 ELSE 0.0 END), 6) AS share, CASE WHEN count(*) < 5 THEN 'insufficient' WHEN avg(CASE WHEN p THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'pass' WHEN avg(CASE WHEN p THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'review' ELSE 'fail' END AS zone FROM v WHERE n <= 5 GROUP BY c""")
def judge_rescore(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("c"), "event_id", F.col("event_type").isin("view", "click").alias("pass"))
    return traces.rescore(v, "c", "event_id", 5)


@query("""WITH o AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'skill' ELSE 'agent' END AS kind, p_name AS name, p_partkey AS k FROM part), l AS (SELECT DISTINCT 'skill:' || p_name AS key FROM part WHERE p_size < 25 AND p_partkey % 2 = 0), n AS (SELECT DISTINCT p_name AS key FROM part WHERE p_size > 40),
m AS (SELECT name, count(DISTINCT kind) AS kinds FROM o GROUP BY name) SELECT k, CASE WHEN kind || ':' || o.name IN (SELECT key FROM l) THEN 'pass' WHEN o.name IN (SELECT key FROM n) AND kinds = 1 THEN 'fail' END AS expected, CASE WHEN kind || ':' || o.name IN (SELECT key FROM l) THEN 'typed' WHEN o.name NOT IN (SELECT key FROM n) THEN 'none' WHEN kinds > 1 THEN 'ambiguous' ELSE 'name' END AS how FROM o JOIN m ON m.name = o.name""")
def trace_label_join(spark, d):
    p = table(spark, d, "part")
    o = p.select(F.when(F.col("p_partkey") % 2 == 0, "skill").otherwise("agent").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").alias("k"))
    typed = p.where("p_size < 25 and p_partkey % 2 = 0").select(F.concat(F.lit("skill:"), "p_name").alias("key"), F.lit("pass").alias("expected")).distinct()
    plain = p.where("p_size > 40").select(F.col("p_name").alias("key"), F.lit("fail").alias("expected")).distinct()
    return traces.join_labels(o, typed.union(plain)).select("k", "expected", "how")


@query("""WITH r AS (SELECT o_orderpriority AS artifact, o_orderstatus AS eval, o_custkey % 50 AS file, CASE o_orderkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'pass' ELSE 'skipped' END AS outcome, CAST(1 + o_orderkey % 3 AS DOUBLE) AS w FROM orders), b AS (SELECT 'artifact' AS level, artifact AS name, file, outcome, w FROM r UNION ALL SELECT 'eval', eval, file, outcome, w FROM r)
SELECT level, name, count(*) FILTER (WHERE outcome <> 'skipped') AS graded, count(*) FILTER (WHERE outcome = 'pass') AS passed, round(sum(w) FILTER (WHERE outcome = 'pass') / sum(w) FILTER (WHERE outcome <> 'skipped'), 6) AS rate, count(DISTINCT file) AS files FROM b GROUP BY 1, 2""")
def eval_aggregate(spark, d):
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select(F.col("o_orderpriority").alias("artifact"), F.col("o_orderstatus").alias("eval"), (F.col("o_custkey") % 50).alias("file"), F.when(k % 4 == 3, "skipped").when(k % 4 == 1, "fail").otherwise("pass").alias("outcome"), (1 + k % 3).cast("double").alias("weight"))
    return traces.aggregate(r)


@query("SELECT user_id AS session, props->>'$.k' AS name, event_id AS opened, (SELECT min(x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.props->>'$.k' = e.props->>'$.k' AND x.event_id > e.event_id AND x.event_type = 'click') AS closed FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id, props->>'$.k' ORDER BY event_id) AS b FROM events WHERE event_type IN ('view', 'click')) e WHERE event_type = 'view' AND (b IS NULL OR b = 'click')")
def availability_replay(spark, d):
    t = F.col("event_type")
    c = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("index"), F.get_json_object("props", "$.k").alias("name"), F.when(t == "view", "offered").when(t == "click", "withdrawn").alias("change"))
    return traces.availability(c)


@query("SELECT user_id AS session, CASE WHEN n BETWEEN 2 AND 20 THEN 'pass' ELSE 'fail' END AS outcome, CAST(n AS VARCHAR) AS detail FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n FROM events GROUP BY user_id)")
def tool_usage(spark, d):
    return traces.grade(_events(spark, d), {"uses": {"kind": "tool-usage", "tool": "click", "min": 2, "max": 20}}).drop("grader")


@query(_E + ", g AS (SELECT session, count(*) FILTER (WHERE tool = 'click' AND regexp_matches(props, '\"k\": ?[1-4]')) AS a, count(*) FILTER (WHERE tool = 'purchase') AS b, min(i) FILTER (WHERE tool = 'click' AND regexp_matches(props, '\"k\": ?[1-4]')) AS x, max(i) FILTER (WHERE tool = 'purchase') AS y, count(*) FILTER (WHERE kind = 'prompt') AS p, bool_or(kind = 'text' AND regexp_matches(props, '77')) AS w FROM e GROUP BY session) SELECT session, unnest(['never', 'order', 'armed', 'turns']) AS grader, unnest([CASE WHEN b = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN x IS NULL AND y IS NULL OR x <= y THEN 'pass' ELSE 'fail' END, CASE WHEN b = 0 THEN 'skipped' WHEN a >= 3 THEN 'pass' ELSE 'fail' END, CASE WHEN p BETWEEN 5 AND 15 THEN 'pass' ELSE 'fail' END]) AS outcome FROM g")
def grader_options(spark, d):
    """Inputs that match, tools that mustn't be used, conditions that arm a grader, and counts of turns."""
    k = '"file_path":"src/[1-4]'
    graders = {"never": {"kind": "tool-usage", "tool": "purchase", "expect": "not-used"}, "order": {"kind": "tool-order", "first": "click", "firstInputMatch": k, "then": "purchase"}, "armed": {"kind": "tool-usage", "tool": "click", "inputMatch": k, "min": 3, "when": {"tool_used": "purchase"}}, "turns": {"kind": "turn-count", "min": 5, "max": 15}}
    return traces.grade(_events(spark, d), graders).select("session", "grader", "outcome")


def _talks(spark, d):
    no = F.lit(False)
    kind = F.when(F.col("role") == "user", "prompt").otherwise("text")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("index"), kind.alias("kind"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("input"), "text", no.alias("sidechain"), no.alias("meta"), no.alias("compact"), F.lit("human").alias("origin"))


@query("SELECT conv_id AS session, count(*) FILTER (WHERE role = 'user') > 2 AND coalesce(bool_or(role = 'user' AND regexp_matches(text, '(?i)the')), false) AS triggered FROM conversations GROUP BY conv_id")
def trigger_conditions(spark, d):
    return traces.triggered(_talks(spark, d), {"turn_count_above": 2, "prompt_matches": "(?i)the"})


@query("SELECT user_id, count(*) AS runs, round(count(*) FILTER (WHERE event_type = 'view') / CAST(count(*) AS DOUBLE), 6) AS share, CASE WHEN count(*) FILTER (WHERE event_type = 'view') / CAST(count(*) AS DOUBLE) >= 0.25 THEN 'pass' WHEN count(*) FILTER (WHERE event_type = 'view') / CAST(count(*) AS DOUBLE) >= 0.15 THEN 'review' ELSE 'fail' END AS zone FROM events GROUP BY user_id")
def consensus_zone(spark, d):
    return traces.consensus(table(spark, d, "events").select("user_id", (F.col("event_type") == "view").alias("pass")), "user_id", 0.25, 0.15)


_TWO = """WITH l AS (SELECT doc_id AS k, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents)),
c AS (SELECT k, ls[len(ls) - 1] || chr(10) || ls[len(ls)] AS t, len(ls) - 1 AS f, CASE WHEN k % 2 = 0 THEN list_concat(ls, ['end'], ls) ELSE list_concat(['start'], ls) END AS now FROM l WHERE len(ls) >= 2),
w AS (SELECT k, f, t, unnest(range(1, len(now))) AS n, now FROM c), m AS (SELECT k, f, n FROM w WHERE now[n] || chr(10) || now[n + 1] = t)"""


def _last_two(spark, d):
    """Each document's two last lines are cited; its text is now there twice, or after another line."""
    doc = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("path"), "text", pins.lines_of(F.col("text")).alias("ls"))
    n = F.size("ls")
    c = doc.where(n >= 2).select("id", "path", (n - 1).alias("first"), n.alias("last"), pins.pin(F.col("ls"), n - 1, n).alias("pin"), F.array_join(F.slice("ls", n - 1, F.lit(2)), "\n").alias("original"))
    own = F.array_join("ls", "\n")
    return c, doc.select("path", F.when(F.col("id") % 2 == 0, F.concat(own, F.lit("\nend\n"), own, F.lit("\n"))).otherwise(F.concat(F.lit("start\n"), own, F.lit("\n"))).alias("text"))


@query(_TWO + " SELECT k AS id, n AS at FROM m")
def moved_window(spark, d):
    return pins.find_moved(*_last_two(spark, d)).select("id", "at")


@query(_TWO + " SELECT c.k AS id, CASE WHEN now[c.f] || chr(10) || now[c.f + 1] = t THEN 'current' WHEN p = 1 THEN 'moved' WHEN p > 1 THEN 'moved-ambiguous' ELSE 'changed' END AS status, CASE WHEN now[c.f] || chr(10) || now[c.f + 1] <> t AND p = 1 THEN q END AS \"at\" FROM c LEFT JOIN (SELECT k, count(*) AS p, min(n) AS q FROM m GROUP BY k) m ON m.k = c.k")
def classify_sources(spark, d):
    c, now = _last_two(spark, d)
    return pins.classify(c.drop("original"), now).select("id", "status", "at")


@query("WITH w AS (SELECT c_nationkey AS id, CAST(c_custkey % 900 AS INT) AS a, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 900 + c_custkey % 40 AS INT) END AS b FROM customer), r AS (SELECT DISTINCT CAST(s_suppkey * 9 AS INT) AS c FROM supplier) SELECT id, count(*) AS windows, count(*) FILTER (WHERE b IS NULL) AS open, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS commits, CAST(sum((SELECT count(*) FROM r WHERE r.c >= w.a AND r.c < coalesce(w.b, 2147483647))) AS BIGINT) AS crossed FROM w GROUP BY id")
def history_metrics(spark, d):
    c = F.col("c_custkey")
    w = table(spark, d, "customer").select(F.col("c_nationkey").alias("id"), (c % 900).cast("int").alias("opened"), F.when(c % 7 != 0, (c % 900 + c % 40).cast("int")).alias("closed"))
    return pins.history_metrics(w, table(spark, d, "supplier").select((F.col("s_suppkey") * 9).alias("commit")))


# ---- templates --------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT CAST(page_id AS VARCHAR) AS path, len(regexp_extract_all(html, '<ul>')) AS lists, CAST(len(regexp_extract_all(regexp_replace(html, '^.*?</h1>', ''), '<p>')) AS BIGINT) AS p FROM (SELECT page_id, regexp_replace(html, '<script>.*?</script>', '', 'g') AS html FROM pages))
SELECT path, 'paragraph 0' AS rule, 'at most 9, found ' || p AS message FROM n WHERE p > 9 UNION ALL SELECT path, 'code 1', 'at least 1, found 0' FROM n""")
def template_counts(spark, d):
    n = cut(_nodes(spark, d))
    t = {"page": {"sections": [{"pattern": ".", "content": [{"kind": "paragraph", "max": 9}, {"kind": "code"}]}]}}
    own = structure.sections(n).where("section = 1").select("path", F.lit("page").alias("template"), F.lit(0).alias("rule"), "section")
    return templates.check_content(n, own, t).select("path", "rule", "message")


@query("""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS path, c_custkey AS k, c_mktsegment AS s FROM customer) SELECT path, '0/0' AS rule, 'coerced' AS status FROM c WHERE s <> 'BUILDING' UNION ALL SELECT path, '1/0', 'missing' FROM c WHERE k % 3 = 0 UNION ALL SELECT path, '1/0/0', 'missing' FROM (SELECT path, k, unnest(range(1, k % 3 + 1)) AS i FROM c) WHERE (k + i) % 4 <> 0
UNION ALL SELECT path, '1/0/0', 'coerced' FROM (SELECT path, k, unnest(range(1, k % 3 + 1)) AS i FROM c) WHERE (k + i) % 4 = 0 AND k % 5 = 0 UNION ALL SELECT path, NULL, 'unexpected' FROM c WHERE k % 7 = 0""")
def template_tree(spark, d):
    """Sections three levels deep: segments, items that repeat, and a note in each."""
    c = F.col("c_custkey")
    note = F.when(c % 5 == 0, "#### Remark\n").otherwise("#### Note\n")
    items = F.transform(F.when(c % 3 > 0, F.sequence(F.lit(1).cast("long"), c % 3)).otherwise(F.expr("cast(array() as array<bigint>)")), lambda i: F.concat(F.lit("### Item "), i.cast("string"), F.lit("\n"), F.when((c + i) % 4 == 0, note).otherwise("")))
    text = F.concat(F.lit("# T\n## Intro\n### "), "c_mktsegment", F.lit("\n## Items\n"), F.array_join(items, ""), F.when(c % 7 == 0, "## Odd\n### Below\n").otherwise(""))
    p = table(spark, d, "customer").select(c.cast("string").alias("path"), text.alias("text"), F.lit("md").alias("kind"))
    t = {"t": {"sections": [{"name": "Intro", "sections": [{"name": "BUILDING"}]}, {"name": "Items", "sections": [{"pattern": "^Item", "repeat": True, "sections": [{"name": "Note"}]}]}]}}
    a = templates.align(structure.sections(structure.nodes(p, "path", "text", "kind")), p.select("path", F.lit("t").alias("template")), t)
    return a.where("status <> 'match'").select("path", "rule", "status")


@query("SELECT event_id, 'a~1b' AS key, json_extract_string(props, '$.k') AS inner, CASE WHEN event_id % 3 = 0 THEN '\"' || event_type || '\"' END AS item FROM events")
def json_pointer(spark, d):
    """Pointers into a document built from each event: keys with both escapes, and an item of an array that every third one has."""
    k = F.get_json_object("props", "$.k")
    data = F.concat(F.lit('{"a/b":{"m~n":'), k, F.lit('},"l":[0'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"'), "event_type", F.lit('"'))).otherwise(""), F.lit("]}"))
    return table(spark, d, "events").select("event_id", formats.escape_pointer(F.lit("a/b")).alias("key"), formats.descend(data, "/a~1b/m~0n").alias("inner"), formats.descend(data, "/l/1").alias("item"))


# ---- strategy, context, access ----------------------------------------------------------------------------------

RECORDS = """SELECT CAST(r_regionkey AS BIGINT) AS idx, 'audiences' AS file, CAST(r_regionkey AS INT) AS line, 'audience' AS type, concat('R', CAST(r_regionkey AS STRING)) AS id, split(NULL, ',') AS parents, CAST(NULL AS STRING) AS lifecycle FROM region
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), 'personas', CAST(n_nationkey AS INT), 'persona', concat('N', CAST(n_nationkey AS STRING)), split(CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 7 = 0 THEN 'r9' ELSE concat('r', CAST(n_regionkey AS STRING)) END, ','), NULL FROM nation
UNION ALL SELECT CAST(1000 + c_custkey AS BIGINT), 'journeys', CAST(c_custkey AS INT), 'journey', concat('C', CAST(c_custkey % 1000 AS STRING)), split(concat('N', CAST(c_nationkey AS STRING)), ','), CASE WHEN c_custkey % 9 = 0 THEN 'draft' END FROM customer"""
NAMED = """SELECT concat('p', CAST(o_orderkey % 500 AS STRING)) AS page, CAST(o_orderkey % 90 AS INT) AS line, CASE o_orderkey % 3 WHEN 0 THEN 'journey' WHEN 1 THEN 'persona' ELSE 'audience' END AS type, CASE o_orderkey % 3 WHEN 0 THEN concat('c', CAST(o_custkey % 1100 AS STRING)) WHEN 1 THEN concat('n', CAST(o_custkey % 30 AS STRING)) ELSE concat('R', CAST(o_custkey % 5 AS STRING)) END AS value FROM orders WHERE o_orderkey % 2 = 0"""
_STRATEGY = f"""WITH rec AS ({RECORDS}), f AS (SELECT type, lower(id) AS k, min(idx) AS t FROM rec GROUP BY 1, 2), ref AS ({NAMED}), par AS (SELECT idx, file, line, id, CASE type WHEN 'persona' THEN 'audience' ELSE 'persona' END AS wanted, unnest(parents) AS value FROM rec WHERE type <> 'audience'),
pr AS (SELECT p.*, f.t AS target FROM par p LEFT JOIN f ON f.type = p.wanted AND f.k = lower(p.value)), nm AS (SELECT DISTINCT f.t AS idx, r.page FROM ref r JOIN f ON f.type = r.type AND f.k = lower(r.value)),
sets AS (SELECT p.idx AS child, p.wanted, list_sort(list(DISTINCT lower(o.id))) AS pids FROM pr p JOIN rec o ON o.idx = p.target GROUP BY 1, 2),
mp AS (SELECT r.page, s.wanted, s.pids, min(r.line) AS line FROM ref r JOIN f ON f.type = r.type AND f.k = lower(r.value) JOIN sets s ON s.child = f.t WHERE r.type <> 'audience' AND NOT EXISTS (SELECT 1 FROM ref x WHERE x.page = r.page AND x.type = s.wanted AND list_contains(s.pids, lower(x.value))) GROUP BY 1, 2, 3)
SELECT 'undefined-reference' AS rule, page AS file, line, CAST(NULL AS VARCHAR) AS id, value FROM ref r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.type = r.type AND f.k = lower(r.value)) UNION ALL SELECT 'undefined-reference', file, line, id, value FROM pr WHERE target IS NULL
UNION ALL SELECT 'duplicate-id', file, line, id, id FROM rec WHERE lower(id) IN (SELECT lower(id) FROM rec GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'missing-parent', page, line, NULL, array_to_string(pids, ',') FROM mp
UNION ALL SELECT 'orphan-record', file, line, id, 'audience' FROM rec WHERE type = 'persona' AND parents IS NULL UNION ALL SELECT 'unserved-journey', file, line, id, id FROM rec JOIN f ON f.t = rec.idx WHERE rec.type = 'journey' AND lifecycle IS NULL AND idx NOT IN (SELECT idx FROM nm)
UNION ALL SELECT 'unused-record', file, line, id, id FROM rec JOIN f ON f.t = rec.idx WHERE rec.type <> 'journey' AND idx NOT IN (SELECT idx FROM nm) AND idx NOT IN (SELECT target FROM pr WHERE target IS NOT NULL)"""


@query(_STRATEGY)
def strategy_check(spark, d):
    for t in ("region", "nation", "customer", "orders"):
        table(spark, d, t).createOrReplaceTempView(t)
    steps = spark.createDataFrame([], "record long, position int, page string, written boolean, verified int, changed int")
    return strategy.check(spark.sql(RECORDS), spark.sql(NAMED), steps)


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(html, '<title>', '<b>') WHEN 1 THEN replace(html, ' lang="', ' l="') WHEN 2 THEN replace(html, '<li><a href="/', '<li><a href="/"></a><img src="') ELSE html END AS html FROM pages)
SELECT page_id, 'link-name' AS rule, CAST(len(regexp_extract_all(html, '<a [^>]*></a>')) AS BIGINT) AS n FROM p WHERE len(regexp_extract_all(html, '<a [^>]*></a>')) > 0 UNION ALL SELECT page_id, 'html-has-lang', 1 FROM p WHERE NOT regexp_matches(html, '<html[^>]* lang=') UNION ALL SELECT page_id, 'document-title', 1 FROM p WHERE NOT regexp_matches(html, '<title>\\s*\\S')
UNION ALL SELECT page_id, 'image-alt', len(regexp_extract_all(html, '<img ')) FROM p WHERE contains(html, '<img ')""")
def access_rules(spark, d):
    i = F.col("page_id") % 4
    swap = lambda a, b: F.replace("html", F.lit(a), F.lit(b))
    html = F.when(i == 0, swap("<title>", "<b>")).when(i == 1, swap(' lang="', ' l="')).when(i == 2, swap('<li><a href="/', '<li><a href="/"></a><img src="')).otherwise(F.col("html"))
    return context.access_violations(table(spark, d, "pages").withColumn("html", html)).where("rule <> 'heading-order'").select("page_id", "rule", "n")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), s AS (SELECT *, coalesce(max(CASE WHEN n % 3 = 0 THEN n // 3 END) OVER (PARTITION BY doc_id ORDER BY n), 0) AS section FROM l)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(section AS INTEGER) AS section, CAST(min(n) AS INTEGER) AS first, CAST(max(n) AS INTEGER) AS last, string_agg(t, chr(10) ORDER BY n) AS text FROM s GROUP BY doc_id, section""")
def section_slices(spark, d):
    """Texts cut at every third line, as if a heading stood there."""
    doc = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    n = F.size(F.split("text", "\n"))
    heads = doc.where(n >= 3).select("path", F.explode(F.sequence(F.lit(1), F.floor(n / 3).cast("int"))).alias("section")).withColumn("line", 3 * F.col("section"))
    return context.section_texts(doc, heads)


@query("""WITH q AS (SELECT l_suppkey AS question, l_partkey AS page, min(l_linenumber) AS a, CASE WHEN min(l_suppkey) % 2 = 0 THEN min(l_linenumber) + 1 END AS b FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2), h AS (SELECT l_suppkey AS question, l_partkey AS page, l_linenumber AS f, l_linenumber + 1 AS l, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)
SELECT q.question, q.page, min(h.rank) AS rank FROM q LEFT JOIN h ON h.question = q.question AND h.page = q.page AND h.rank <= 200 AND (q.b IS NULL OR (h.f <= q.b AND h.l >= q.a)) GROUP BY 1, 2""")
def golden_questions(spark, d):
    from pyspark.sql import Window

    li = table(spark, d, "lineitem")
    q = li.where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("question"), F.col("l_partkey").alias("page")).agg(F.min("l_linenumber").alias("a"))
    even = F.col("question") % 2 == 0
    q = q.select("question", "page", F.when(even, F.col("a")).alias("first"), F.when(even, F.col("a") + 1).alias("last"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    h = li.select(F.col("l_suppkey").alias("question"), F.col("l_partkey").alias("page"), F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + 1).alias("last"), F.row_number().over(w).alias("rank"))
    return context.golden(q, h, 200).select("question", "page", "rank")
