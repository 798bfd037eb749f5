"""Queries over the operators that aren't plain SQL, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import corpus, evals, graph, search, sqlguard
from docloom.sources import html
from docloom.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- corpus -----------------------------------------------------------------------------------------------------


def _records(spark, d):
    doc = table(spark, d, "documents")
    data = F.to_json(F.struct("lang", "source", F.col("n_chars").alias("n")))
    return doc.select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("_path"), F.lit("markdown").alias("_format"), F.lit(True).alias("_present"), data.alias("_data"))


@query("""SELECT 'docs/' || source || '/' || doc_id || '.md' AS _path, 'markdown' AS _format, true AS _present, lang, n_chars AS n, source FROM documents""")
def docs_projection(spark, d):
    return corpus.build_docs(_records(spark, d)).drop("_data")


COLLECTIONS = {"first": (["docs/src[0-4]/**"], ["**/*7.md"]), "even": (["docs/src{0,2,4,6,8}/*.md"], [])}
_MEMBERS = """WITH p AS (SELECT 'docs/' || source || '/' || doc_id || '.md' AS path FROM documents), m AS (
  SELECT 'first' AS collection, path FROM p WHERE regexp_matches(path, '^docs/src[0-4]/') AND NOT path LIKE '%7.md'
  UNION ALL SELECT 'even', path FROM p WHERE regexp_matches(path, '^docs/src[02468]/[^/]*[.]md$'))"""


@query(_MEMBERS + " SELECT collection, count(*) AS n FROM m GROUP BY collection")
def collection_view(spark, d):
    return corpus.members(_records(spark, d), COLLECTIONS).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query(_MEMBERS + " SELECT path FROM m GROUP BY path HAVING count(*) > 1")
def collection_overlap(spark, d):
    return corpus.members(_records(spark, d), COLLECTIONS).groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 500")
def named_param(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return sqlguard.run(spark, "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = $segment AND c_acctbal > :least -- ':none'\n;", {"segment": "BUILDING", "least": 500})


def _found(spark, d):
    doc = table(spark, d, "documents")
    n = doc.groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = doc.select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("h")).join(n, "h").select("path", F.lit("text").alias("key"), F.concat(F.lit("n="), F.col("n").cast("string")).alias("message"))
    return corpus.findings(rows, "unique")


def _known(found):
    return corpus.build_baseline(found.where(F.col("path").cast("long") % 3 == 0))


_FOUND = """WITH found AS (SELECT CAST(d.doc_id AS VARCHAR) AS path, 'text' AS key, 'n=' || g.n AS message, 'unique' AS keyword FROM documents d
  JOIN (SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) g ON md5(d.text) = g.h),
printed AS (SELECT *, substr(sha256('check' || chr(0) || key || chr(0) || keyword || chr(0) || message), 1, 16) AS fp FROM found),
base AS (SELECT DISTINCT path, fp FROM printed WHERE CAST(path AS BIGINT) % 3 = 0)"""


@query(_FOUND + " SELECT path, fp FROM printed")
def fingerprint(spark, d):
    return corpus.with_fingerprint(_found(spark, d)).select("path", "fp")


@query(_FOUND + " SELECT path, fp FROM base")
def baseline_build(spark, d):
    return _known(_found(spark, d))


@query(_FOUND + " SELECT path, CAST(NULL AS INTEGER) AS line, key, message, keyword, fp FROM printed p WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.path = p.path AND b.fp = p.fp)")
def baseline_apply(spark, d):
    found = _found(spark, d)
    return corpus.apply_baseline(found, _known(found))


@query(_FOUND + " SELECT (SELECT count(*) FROM base) AS recorded, (SELECT count(*) FROM printed JOIN base USING (path, fp)) AS suppressed, CAST(0 AS BIGINT) AS stale")
def baseline_counts(spark, d):
    found = _found(spark, d)
    return corpus.baseline_counts(found, _known(found))


@query(_FOUND + """, old AS (SELECT DISTINCT path, fp FROM printed WHERE CAST(path AS BIGINT) % 2 = 0)
SELECT path, fp, 'added' AS change FROM (SELECT * FROM base EXCEPT SELECT * FROM old) UNION ALL SELECT path, fp, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM base)""")
def baseline_diff(spark, d):
    found = _found(spark, d)
    return corpus.diff_baselines(corpus.build_baseline(found.where(F.col("path").cast("long") % 2 == 0)), _known(found))


def _values(spark, d):
    doc = table(spark, d, "documents")
    pairs = F.array(F.struct(F.lit("lang").alias("key"), F.lit("string").alias("type"), F.col("lang").alias("value")), F.struct(F.lit("n").alias("key"), F.when(F.col("doc_id") % 3 == 0, "string").otherwise("integer").alias("type"), F.col("n_chars").cast("string").alias("value")), F.struct(F.lit("source").alias("key"), F.lit("string").alias("type"), F.when(F.col("doc_id") % 10 > 0, F.col("source")).alias("value")))
    return doc.select(F.col("doc_id").alias("path"), F.explode(pairs).alias("x")).select("path", "x.*").where("value is not null")


_VALUES = """WITH v AS (SELECT doc_id AS path, 'lang' AS key, 'string' AS type, lang AS value FROM documents
  UNION ALL SELECT doc_id, 'n', CASE WHEN doc_id % 3 = 0 THEN 'string' ELSE 'integer' END, CAST(n_chars AS VARCHAR) FROM documents
  UNION ALL SELECT doc_id, 'source', 'string', source FROM documents WHERE doc_id % 10 > 0), t AS (SELECT key, type, count(*) AS n FROM v GROUP BY 1, 2)"""


@query(_VALUES + """ SELECT key, count(DISTINCT path) AS files, round(count(DISTINCT path) / CAST((SELECT count(*) FROM documents) AS DOUBLE), 4) AS coverage,
  (SELECT arg_max(type, n) FROM t WHERE t.key = v.key) AS type, (SELECT count(*) FROM t WHERE t.key = v.key) AS types, count(DISTINCT value) AS "distinct",
  count(DISTINCT value) <= 20 AND count(DISTINCT value) <= 0.05 * (SELECT count(*) FROM documents) AS enum FROM v GROUP BY key""")
def infer_schema(spark, d):
    return corpus.infer_schema(_values(spark, d), table(spark, d, "documents"))


@query(_VALUES + " SELECT key, CASE WHEN count(*) = 1 THEN min(type) END AS type FROM (SELECT *, rank() OVER (PARTITION BY key ORDER BY n DESC) AS r FROM t) WHERE r = 1 GROUP BY key")
def dominant_type(spark, d):
    return corpus.dominant_type(_values(spark, d))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'cleared' ELSE 'changed' END AS change FROM part WHERE p_partkey % 11 = 0 OR (p_size > 40 AND p_brand <> 'Brand#99')
UNION ALL SELECT -p_partkey - 1, 'created' FROM part WHERE p_partkey % 50 = 0""")
def diff_snapshots(spark, d):
    p = table(spark, d, "part")
    after = p.where("p_partkey % 11 <> 0").withColumn("p_brand", F.when(F.col("p_size") > 40, "Brand#99").otherwise(F.col("p_brand")))
    after = after.unionByName(p.where("p_partkey % 50 = 0").withColumn("p_partkey", -F.col("p_partkey") - 1))
    return corpus.diff_snapshots(p, after, "p_partkey")


@query("""SELECT path, CASE WHEN regexp_matches(path, '5[.]md$') THEN 'five' WHEN regexp_matches(path, '^docs/src1[^/]*/') THEN 'ones' ELSE 'all' END AS owner
FROM (SELECT 'docs/' || source || '/' || doc_id || '.md' AS path FROM documents)""")
def codeowners_last_match(spark, d):
    return corpus.last_match(_records(spark, d).select(F.col("_path").alias("path")), [("**", "all"), ("docs/src1*/**", "ones"), ("**/*5.md", "five")])


@query("""SELECT d.doc_id, CASE WHEN d.n_chars > 3000 THEN NULL ELSE CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'poor' END END AS note,
  CASE WHEN d.n_chars > 3000 THEN 'note' ELSE '' END AS conflicts FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def sidecar_merge(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 3000, "own").alias("note"))
    side = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("note"))
    return corpus.merge_sidecar(pages, side, "doc_id", ["note"])


@query("""WITH k AS (SELECT n_name AS k FROM nation), u AS (SELECT DISTINCT substr(n_name, 1, length(n_name) - 1) || 'x' AS name FROM nation), c AS (
  SELECT name, k, levenshtein(name, k) AS d FROM u, k WHERE levenshtein(name, k) <= 3)
SELECT name, k AS suggestion FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d, k) AS r FROM c) WHERE r = 1""")
def did_you_mean(spark, d):
    n = table(spark, d, "nation")
    return corpus.suggest(n.select(F.expr("concat(substring(n_name, 1, length(n_name) - 1), 'x')").alias("name")).distinct(), n.select(F.col("n_name").alias("name")))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN lang ELSE source END AS value, CASE WHEN doc_id % 4 IN (0, 1) THEN 'asserted' ELSE 'derived' END AS origin FROM documents""")
def resolved_view(spark, d):
    """An explicit null is asserted; an absent key falls back to the derived value."""
    doc = table(spark, d, "documents")
    data = F.when(F.col("doc_id") % 4 == 0, F.lit('{"k": null}')).when(F.col("doc_id") % 4 == 1, F.to_json(F.struct(F.col("lang").alias("k")))).otherwise(F.lit("{}"))
    doc = doc.select("doc_id", "source", data.alias("_data"))
    present = F.array_contains(F.json_object_keys("_data"), "k")
    return doc.select("doc_id", F.when(present, F.get_json_object("_data", "$.k")).otherwise(F.col("source")).alias("value"), F.when(present, "asserted").otherwise("derived").alias("origin"))


@query("SELECT doc_id, lang AS lang_value, CAST(n_chars AS VARCHAR) AS n_value FROM documents")
def get_fields(spark, d):
    return corpus.build_docs(_records(spark, d).withColumn("_format", F.regexp_extract("_path", r"(\d+)\.md$", 1)), ["lang", "n"]).select(F.col("_format").cast("long").alias("doc_id"), F.col("lang").alias("lang_value"), F.col("n").alias("n_value"))


# ---- graph ------------------------------------------------------------------------------------------------------


def triples(spark, d):
    """Customers and suppliers in nations, nations in regions, orders of customers."""
    node = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
    t = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    out = t(table(spark, d, "customer"), node("customer", "c_custkey"), "in", node("nation", "c_nationkey"))
    out = out.unionAll(t(table(spark, d, "supplier"), node("supplier", "s_suppkey"), "in", node("nation", "s_nationkey")))
    out = out.unionAll(t(table(spark, d, "nation"), node("nation", "n_nationkey"), "in", node("region", "n_regionkey")))
    return out.unionAll(t(table(spark, d, "orders"), node("order", "o_orderkey"), "of", node("customer", "o_custkey")))


_TRIPLES = """WITH RECURSIVE t AS (SELECT 'customer/' || c_custkey AS s, 'in' AS p, 'nation/' || c_nationkey AS o FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 'in', 'nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey, 'in', 'region/' || n_regionkey FROM nation UNION ALL SELECT 'order/' || o_orderkey, 'of', 'customer/' || o_custkey FROM orders)"""


@query(_TRIPLES + " SELECT s, p, o FROM t WHERE p = 'in' AND o = 'nation/3'")
def triple_match(spark, d):
    return graph.match(triples(spark, d), p="in", o="nation/3")


@query(_TRIPLES + " SELECT a.s AS \"order\", c.o AS region FROM t a JOIN t b ON b.s = a.o AND b.p = 'in' JOIN t c ON c.s = b.o AND c.p = 'in' WHERE a.p = 'of'")
def bgp_join(spark, d):
    t = triples(spark, d)
    a, b, c = (t.alias(x) for x in "abc")
    j = a.where("p = 'of'").join(b.where("p = 'in'"), F.col("b.s") == F.col("a.o")).join(c.where("p = 'in'"), F.col("c.s") == F.col("b.o"))
    return j.select(F.col("a.s").alias("order"), F.col("c.o").alias("region"))


_WALK = _TRIPLES + ", e AS ({edges}), w AS (SELECT '{seed}' AS node, 0 AS depth UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < {depth} {cond}) SELECT node, min(depth) AS depth FROM w {where} GROUP BY node"


@query(_WALK.format(edges="SELECT s AS a, o AS b FROM t UNION SELECT o, s FROM t", seed="region/1", depth=2, cond="", where=""))
def bfs_depth(spark, d):
    return graph.traverse(triples(spark, d), spark.createDataFrame([("region/1",)], "node string"), 2, None, "both")


@query(_WALK.format(edges="SELECT o AS a, s AS b FROM t WHERE p = 'in'", seed="region/1", depth=2, cond="AND e.b NOT LIKE '%2'", where=""))
def bfs_scoped(spark, d):
    t = triples(spark, d)
    hidden = t.select(F.col("s").alias("node")).where("node like '%2'").distinct()
    return graph.traverse(t, spark.createDataFrame([("region/1",)], "node string"), 2, ["in"], "in", hidden)


@query(_WALK.format(edges="SELECT o AS a, s AS b FROM t", seed="nation/5", depth=3, cond="", where="WHERE depth > 0"))
def impact(spark, d):
    return graph.impact(triples(spark, d), spark.createDataFrame([("nation/5",)], "node string"))


@query(_TRIPLES + " SELECT s FROM t WHERE o = 'customer/1'")
def backlinks(spark, d):
    return graph.match(triples(spark, d), o="customer/1").select("s")


@query(_TRIPLES + ", n AS (SELECT 'customer/' || c_custkey AS node FROM customer), x AS (SELECT s AS node FROM t UNION ALL SELECT o FROM t WHERE s <> o) SELECT n.node, count(x.node) AS degree FROM n LEFT JOIN x ON x.node = n.node GROUP BY n.node")
def degree_orphans(spark, d):
    return graph.degrees(triples(spark, d), table(spark, d, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("node")))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.b) SELECT a AS node FROM w WHERE a = b""")
def broader_cycles(spark, d):
    return graph.cycles(table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b")))


@query("""WITH l AS (SELECT lower(n_name) AS label, CASE n_nationkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'de-AT' END AS lang, CASE n_nationkey % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'id' ELSE 'alt' END AS kind, n_nationkey AS id FROM nation
  UNION ALL SELECT lower(n_name), CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'de-CH' END, 'alt', n_nationkey + 100 FROM nation), r AS (SELECT n_name AS ref, unnest(['de', 'de-AT', 'fr', NULL]) AS lang FROM nation)
SELECT ref, lang, id FROM (SELECT r.ref, r.lang, l.id, row_number() OVER (PARTITION BY r.ref, r.lang ORDER BY CASE WHEN lower(l.lang) = lower(r.lang) THEN 0 WHEN split_part(lower(l.lang), '-', 1) = split_part(lower(r.lang), '-', 1) THEN 1 ELSE 2 END, CASE kind WHEN 'label' THEN 0 WHEN 'id' THEN 1 ELSE 2 END, l.id) AS n FROM r JOIN l ON lower(r.ref) = l.label) WHERE n = 1""")
def concept_resolution(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    labels = n.select(F.lower("n_name").alias("label"), F.when(k % 4 == 0, "en").when(k % 4 == 1, "de").when(k % 4 == 2, "de-AT").alias("lang"), F.when(k % 3 == 0, "label").when(k % 3 == 1, "id").otherwise("alt").alias("kind"), k.alias("id"))
    labels = labels.unionAll(n.select(F.lower("n_name"), F.when(k % 2 == 0, "en").otherwise("de-CH"), F.lit("alt"), k + 100))
    refs = n.select(F.col("n_name").alias("ref"), F.explode(F.array(F.lit("de"), F.lit("de-AT"), F.lit("fr"), F.lit(None))).alias("lang"))
    return graph.resolve_concepts(refs, labels)


@query("""WITH s AS (SELECT page_id, trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages)
SELECT page_id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || (n - 1) END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n FROM s)""")
def slug_dedupe(spark, d):
    s = table(spark, d, "pages").select("page_id", T.slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))
    return T.numbered_slugs(s, "page_id")


# ---- search -----------------------------------------------------------------------------------------------------

_LEX = """WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT id, len(w) AS size, len(list_filter(w, lambda x: x = 'thing')) AS a, len(list_filter(w, lambda x: x = 'worthless')) AS b FROM w),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(size) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f),
lex AS (SELECT id, round((CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * (0.5::DOUBLE + a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * size / m))) ELSE 0 END)
  + (CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * (0.5::DOUBLE + b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * size / m))) ELSE 0 END), 9) AS score FROM f, s WHERE a > 0 OR b > 0)"""
_RANK = "SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM {} ORDER BY score DESC, id LIMIT {}"


@query("SELECT * EXCLUDE (score), round(score, 6) AS score FROM (" + _LEX + " " + _RANK.format("lex", 10) + ")")
def lexical_search(spark, d):
    return search.lexical(table(spark, d, "documents"), ["thing", "worthless"]).withColumn("score", F.round("score", 6))


def _query_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 7").first()["embedding"]


_VEC = "vec AS (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 9) AS score FROM embeddings)"


@query("SELECT * EXCLUDE (score), round(score, 6) AS score FROM (WITH " + _VEC + " " + _RANK.format("vec WHERE score >= 0", 10) + ")")
def vector_search(spark, d):
    return search.vector(table(spark, d, "embeddings"), _query_vector(spark, d)).withColumn("score", F.round("score", 6))


@query(_LEX + ", " + _VEC + ", legs AS (SELECT * FROM (" + _RANK.format("lex", 50) + ") UNION ALL SELECT * FROM (" + _RANK.format("vec WHERE score >= 0", 50) + ")), rrf AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM legs GROUP BY id) SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM rrf ORDER BY score DESC, id LIMIT 10")
def rrf_fusion(spark, d):
    return search.fuse([search.lexical(table(spark, d, "documents"), ["thing", "worthless"], limit=50), search.vector(table(spark, d, "embeddings"), _query_vector(spark, d), limit=50)])


@query("""WITH hits AS (SELECT l_suppkey AS question, l_partkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem), a AS (SELECT l_suppkey AS question, max(l_partkey) AS id FROM lineitem GROUP BY 1),
b AS (SELECT a.question, min(h.rank) AS best FROM a LEFT JOIN hits h ON h.question = a.question AND h.id = a.id GROUP BY 1) SELECT count(*) FILTER (WHERE best <= 100) AS found, count(*) FILTER (WHERE best = 1) AS first, count(*) AS questions FROM b""")
def recall_at_k(spark, d):
    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    hits = li.select(F.col("l_suppkey").alias("question"), F.col("l_partkey").alias("id"), F.row_number().over(w).alias("rank"))
    return search.recall_at(hits, li.groupBy(F.col("l_suppkey").alias("question")).agg(F.max("l_partkey").alias("id")), 100)


@query("""WITH q AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark), a AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')[4:] FROM benchmark WHERE item_id % 3 = 0),
p AS (SELECT id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM q WHERE len(w) > 1), e AS (SELECT id, len(g) AS of, unnest(g) AS g FROM p), h AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM a WHERE len(w) > 1)
SELECT e.id, count(*) AS copied, e.of FROM e JOIN h ON h.id = e.id AND h.g = e.g GROUP BY e.id, e.of HAVING count(*) >= 0.5 * e.of""")
def copied_pairs(spark, d):
    """Questions that their own answers repeat: each benchmark item against some documents, and against its own tail."""
    b, doc = table(spark, d, "benchmark"), table(spark, d, "documents")
    n = b.agg(F.count(F.lit(1)).alias("n"))
    own = doc.crossJoin(F.broadcast(n)).select((F.col("doc_id") % F.col("n")).alias("id"), "text")  # one row
    tail = F.array_join(F.slice(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != ""), F.lit(4), F.lit(10**6)), " ")
    return search.copied(b.select(F.col("item_id").alias("id"), "text"), own.union(b.where("item_id % 3 = 0").select("item_id", tail)))


# ---- pages ------------------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '([^/])/$', '\\1') AS key, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host FROM pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_key(F.col("url")).alias("key"), T.url_host(F.col("url")).alias("host"))


@query("SELECT regexp_replace(regexp_replace(url, '#.*$', ''), '([^/])/$', '\\1') AS key, min(page_id) AS first, count(*) AS n FROM pages GROUP BY 1")
def url_dedupe(spark, d):
    return table(spark, d, "pages").groupBy(T.url_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def html_metadata(spark, d):
    return html.metadata(table(spark, d, "pages")).select("page_id", "title", "lang")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark, d):
    return html.links(table(spark, d, "pages"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(href, '^(https?:)?//') THEN 'external' WHEN regexp_matches(href, '^[a-z]+:') THEN 'other' WHEN starts_with(href, '#') THEN 'anchor' WHEN starts_with(href, '/') THEN 'rooted' ELSE 'relative' END AS kind
FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)) GROUP BY kind""")
def classify_links(spark, d):
    return html.links(table(spark, d, "pages")).groupBy(html.link_kind(F.col("href")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---- sessions and evals -----------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS turn_no FROM conversations")
def turn_slice(spark, d):
    return evals.turns(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "role", "turn_no")


@query("SELECT c.conv_id, c.turn FROM conversations c JOIN (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS at, max(turn) AS e FROM conversations GROUP BY 1) m ON m.conv_id = c.conv_id WHERE c.turn >= m.at AND m.e > m.at")
def last_turn(spark, d):
    return evals.last_turn(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn")


@query("SELECT user_id, coalesce(min(event_id) FILTER (WHERE event_type = 'view') < max(event_id) FILTER (WHERE event_type = 'purchase'), count(*) FILTER (WHERE event_type IN ('view', 'purchase')) = 0) AS pass FROM events GROUP BY user_id")
def tool_order(spark, d):
    return evals.tool_order(table(spark, d, "events"), "user_id", "event_id", "event_type", "view", "purchase")


_ISLANDS = """WITH l AS (SELECT user_id, event_id, value > 50 AS stale, lag(value > 50) OVER w AS b, lag(event_id) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR stale IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM l), a AS (SELECT user_id, g, stale, min(event_id) AS opened, count(*) AS n FROM i GROUP BY 1, 2, 3),
c AS (SELECT *, lead(opened) OVER (PARTITION BY user_id ORDER BY g) AS closed FROM a)"""


def _islands(spark, d):
    return evals.intervals(table(spark, d, "events").withColumn("stale", F.col("value") > 50), ["user_id"], "event_id", "stale")


@query(_ISLANDS + " SELECT user_id, opened, closed, n FROM c WHERE stale")
def stale_windows(spark, d):
    return _islands(spark, d).where("stale").select("user_id", "opened", "closed", "n")


@query(_ISLANDS + " SELECT user_id, stale, opened, closed FROM c")
def availability_intervals(spark, d):
    return _islands(spark, d).select("user_id", "stale", "opened", "closed")


@query("SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) GROUP BY user_id, event_type, g) GROUP BY user_id")
def content_runs(spark, d):
    runs = evals.intervals(table(spark, d, "events"), ["user_id"], "event_id", "event_type")
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"))


def _cases(spark, d):
    doc = table(spark, d, "documents").select("doc_id", (F.size(F.split("text", r"[#$%&*]{3}")) < 3).alias("actual"))
    return table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("expected")).join(doc, "doc_id")


_CASES = "WITH c AS (SELECT l.doc_id, l.quality = 1 AS expected, len(regexp_split_to_array(d.text, '[#$%&*]{3}')) < 3 AS actual FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@query(_CASES + """ SELECT count(*) AS judged, round(count(*) FILTER (WHERE expected = actual) / CAST(count(*) AS DOUBLE), 6) AS agreement, count(*) FILTER (WHERE expected AND NOT actual) AS false_fail, count(*) FILTER (WHERE NOT expected AND actual) AS false_pass,
bool_or(expected) AND bool_or(NOT expected) AS balanced, count(*) FILTER (WHERE expected = actual) / CAST(count(*) AS DOUBLE) >= 0.7 AS certified FROM c""")
def calibration(spark, d):
    return evals.calibration(_cases(spark, d))


_OUT = _CASES + ", o AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'review' WHEN expected THEN 'pass' ELSE 'fail' END AS e, CASE doc_id % 13 WHEN 0 THEN 'error' WHEN 1 THEN 'skipped' WHEN 2 THEN 'review' ELSE CASE WHEN actual THEN 'pass' ELSE 'fail' END END AS a FROM c), k AS (SELECT doc_id, CASE WHEN a IN ('error', 'skipped') THEN a WHEN a = 'review' AND e = 'review' THEN 'agree' WHEN a = 'review' THEN 'review' WHEN e = 'review' THEN 'missed-review' WHEN a = e THEN 'agree' WHEN a = 'pass' THEN 'false-pass' ELSE 'false-fail' END AS kind FROM o)"


def _outcomes(spark, d):
    word = lambda c: F.when(F.col(c), "pass").otherwise("fail")
    i = F.col("doc_id")
    c = _cases(spark, d).select("doc_id", F.when(i % 11 == 0, "review").otherwise(word("expected")).alias("e"), F.when(i % 13 == 0, "error").when(i % 13 == 1, "skipped").when(i % 13 == 2, "review").otherwise(word("actual")).alias("a"))
    return c.select("doc_id", evals.classify(F.col("e"), F.col("a")).alias("kind"), "a")


@query(_OUT + " SELECT doc_id, kind FROM k")
def classify_outcomes(spark, d):
    return _outcomes(spark, d).select("doc_id", "kind")


@query(_OUT + " SELECT kind, count(*) AS n FROM k GROUP BY kind")
def score_counts(spark, d):
    return _outcomes(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus IN ('O', 'F')) AS graded, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, round(coalesce(sum(w) FILTER (WHERE o_orderstatus = 'F'), 0) / sum(w) FILTER (WHERE o_orderstatus IN ('O', 'F')), 6) AS rate FROM (SELECT *, CAST(1 + o_orderkey % 3 AS DOUBLE) AS w FROM orders) GROUP BY 1")
def suite_pass_rate(spark, d):
    o = F.col("o_orderstatus")
    r = table(spark, d, "orders").select("o_orderpriority", F.when(o == "F", "pass").when(o == "O", "fail").otherwise("skipped").alias("outcome"), (1 + F.col("o_orderkey") % 3).cast("double").alias("weight"))
    return evals.pass_rate(r, "o_orderpriority")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def ledger_top_n(spark, d):
    return evals.newest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query("SELECT user_id, count(*) AS runs, round(avg(value), 6) AS mean, count(*) < 3 AS insufficient FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 3 GROUP BY user_id")
def rescore(spark, d):
    first = evals.newest(table(spark, d, "events"), ["user_id"], [F.col("event_id")], 3)
    return first.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("value"), 6).alias("mean"), (F.count(F.lit(1)) < 3).alias("insufficient"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT a.user_id, round(a.value - b.value, 9) AS change FROM r a LEFT JOIN r b ON b.user_id = a.user_id AND b.n = 2 WHERE a.n = 1")
def compare_to_last(spark, d):
    two = evals.newest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 2)
    now, before = (F.max(F.when(F.col("nth") == i, F.col("value"))) for i in (1, 2))
    return two.groupBy("user_id").agg(F.round(now - before, 9).alias("change"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def newer_than(spark, d):
    return table(spark, d, "events").where("ts >= TIMESTAMP'2024-01-31 00:00:00' - INTERVAL 7 DAYS").select("event_id")


@query("SELECT doc_id, regexp_matches(text, '[0-9a-f]{16}') AS pass FROM documents")
def regex_grader(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike("[0-9a-f]{16}").alias("pass"))


@query("SELECT user_id, round(sum(exp(-date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') / CAST(30 AS DOUBLE))), 6) AS rate FROM events GROUP BY user_id")
def decayed_rate(spark, d):
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.exp(-age / 30)), 6).alias("rate"))


@query("SELECT event_type, count(*) AS n, list_sort(list(DISTINCT user_id % 10)) AS groups FROM events GROUP BY event_type")
def batch_aggregate(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.col("user_id") % 10)).alias("groups"))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) > 1 AS ambiguous, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def label_join(spark, d):
    """Labels are counted before the join, which then meets one row for each key, unsorted."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).groupBy("l_orderkey").agg(F.count("l_returnflag").alias("flags"), F.sum("n").alias("n"))
    o = table(spark, d, "orders").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("m"))
    j = n.join(o.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", (F.col("flags") > 1).alias("ambiguous"), (F.col("n") * F.col("m")).alias("n"))


@query("WITH w AS (SELECT user_id, event_id AS s, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS e FROM events WHERE event_type = 'signup') SELECT w.user_id, w.s, count(e.event_id) AS n FROM w LEFT JOIN events e ON e.user_id = w.user_id AND e.event_id >= w.s AND (w.e IS NULL OR e.event_id < w.e) GROUP BY 1, 2")
def branch_window(spark, d):
    """Events in half-open spans from one signup to the next, by a running maximum instead of a range join."""
    e = table(spark, d, "events")
    at = F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("s", at).where("s is not null").groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text LIKE '%' || chr(10) || '%' AS lines, sha256(array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10))) AS pin FROM documents")
def pin_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.contains("text", F.lit("\n")).alias("lines"), T.pin_hash(F.col("text"), F.lit(1), F.lit(2)).alias("pin"))


@query("SELECT doc_id, regexp_replace(text, '(^|[^0-9A-Za-z_])(AKIA|ASIA|AROA|AIDA)[0-9A-Z]{16}([^0-9A-Za-z_]|$)', '\\1[redacted:aws-access-key-id]\\3', 'g') = text AS clean FROM documents")
def redact_aws(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.regexp_replace("text", F.lit(T.REDACTIONS[2][0]), F.lit(T.REDACTIONS[2][1])) == F.col("text")).alias("clean"))


def _redacted(column: str) -> str:
    """DuckDB: the patterns one after the other; groups are written \\1."""
    for pattern, by in T.REDACTIONS:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by.replace('$', chr(92))}', 'g')"
    return column


@query(f"SELECT 'd' || doc_id AS id, md5({_redacted('text')}) AS redacted_md5 FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, md5({_redacted('text')}) FROM conversations")
def redact(spark, d):
    texts = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    texts = texts.union(table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")), "text"))
    return texts.select("id", F.md5(T.redact(F.col("text"))).alias("redacted_md5"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_extra(spark, d):
    return windows.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"]).select(F.col("window.start").alias("hour"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS opened, count(*) AS n FROM s GROUP BY user_id, k""")
def session_extra(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"]).select("user_id", F.col("session.start").alias("opened"), "n")
