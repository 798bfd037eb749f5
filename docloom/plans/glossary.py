"""The glossary rules over a term set made from the part table, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import glossary
from docloom.plans.toolkit import query, table

#: The term set in SQL that runs on both engines.
TERMS = """SELECT CAST(k AS BIGINT) AS idx, concat('terms/', lower(p_type), '.yaml') AS file, CAST(p_size AS INT) AS line,
  CASE WHEN k % 17 = 0 THEN concat('t', CAST(k + 4 AS STRING)) ELSE concat('T', CAST(k AS STRING)) END AS id,
  CASE k % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'en-GB' WHEN 2 THEN 'de' END AS language,
  CASE WHEN k % 7 = 0 THEN upper(name) ELSE name END AS label, split(CASE WHEN k % 5 = 0 THEN concat(lower(p_type), ' ', p_name, ',', name) ELSE concat(p_type, ' ', p_name) END, ',') AS alt,
  split(CASE WHEN k % 6 = 0 THEN concat(p_type, ' ', upper(p_name)) WHEN k % 6 = 1 THEN p_name ELSE concat('h', CAST(k AS STRING)) END, ',') AS hidden,
  CASE WHEN k % 13 = 0 THEN 'Superseded' WHEN k % 13 = 1 THEN 'preferred' END AS status,
  CASE WHEN k % 4 <> 1 THEN concat('A ', p_name) END AS definition, CASE WHEN k % 3 = 0 THEN repeat(p_name, p_size % 12) END AS abstract,
  CASE WHEN k % 19 = 0 THEN concat('T', CAST(k + 1 AS STRING)) END AS see,
  split(CASE WHEN k % 10 = 0 THEN concat('T', CAST(k + 3 AS STRING)) WHEN k % 10 = 3 THEN concat('t', CAST(k - 3 AS STRING)) WHEN k % 10 < 8 THEN concat('T', CAST(CAST(floor(k / 2) AS BIGINT) AS STRING)) END, ',') AS broader,
  split(CASE WHEN k % 4 = 0 THEN concat('T', CAST(2 * k AS STRING)) END, ',') AS narrower,
  split(CASE WHEN k % 8 = 0 THEN concat('T', CAST(k + 1 AS STRING), ',T', CAST(CAST(floor(k / 2) AS BIGINT) AS STRING)) WHEN k % 8 = 1 THEN concat('T', CAST(k - 1 AS STRING)) WHEN k % 8 = 2 THEN concat('T', CAST(k + 1 AS STRING)) END, ',') AS related,
  concat('x:', p_type) AS exact, concat('x:', CASE WHEN k % 9 = 0 THEN p_type ELSE p_brand END) AS close
FROM (SELECT *, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN concat(p_name, ' ', p_type) ELSE concat('part ', CAST(p_partkey AS STRING)) END AS name FROM part)"""
REFERENCES = """SELECT concat('page', CAST(s_suppkey AS STRING)) AS file, 1 AS line, CASE s_suppkey % 5 WHEN 0 THEN concat('T', CAST(7 * s_suppkey AS STRING)) WHEN 1 THEN 'red widget' WHEN 2 THEN concat('part ', CAST(3 * s_suppkey + 2 AS STRING)) WHEN 3 THEN concat(p_type, ' ', p_name) ELSE concat('none ', CAST(s_suppkey AS STRING)) END AS label,
  CASE s_suppkey % 3 WHEN 0 THEN 'en-US' WHEN 1 THEN 'de' END AS language FROM supplier JOIN part ON p_partkey = s_suppkey"""
BLOCKS = """SELECT concat('page', CAST(s_suppkey AS STRING)) AS file, 2 AS line, concat('T', CAST(s_suppkey AS STRING)) AS label, 'en' AS language, CASE WHEN s_suppkey % 2 = 0 THEN 'broader' ELSE 'related' END AS field,
  CASE WHEN s_suppkey % 3 = 0 THEN 'elsewhere' ELSE concat('T', CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS STRING)) END AS value FROM supplier JOIN part ON p_partkey = s_suppkey"""
#: The start of each DuckDB form: terms, their names, and links resolved by subqueries.
_T = f"""WITH RECURSIVE terms AS MATERIALIZED ({TERMS}), l AS (SELECT *, coalesce(lower(language), '') AS lang, lower(label) AS flabel, lower(id) AS fid FROM terms),
alts AS (SELECT idx, file, line, id, lang, flabel, unnest(alt) AS value, generate_subscripts(alt, 1) AS p FROM l), hid AS (SELECT idx, file, line, id, lang, flabel, alt, unnest(hidden) AS value FROM l),
fa AS (SELECT idx, lang, lower(value) AS k, arg_min(value, p) AS value FROM alts GROUP BY idx, lang, lower(value)),
rel AS (SELECT idx, file, line, id, lang, 'see' AS field, see AS value FROM l WHERE see IS NOT NULL UNION ALL SELECT idx, file, line, id, lang, 'broader', unnest(broader) FROM l UNION ALL SELECT idx, file, line, id, lang, 'narrower', unnest(narrower) FROM l UNION ALL SELECT idx, file, line, id, lang, 'related', unnest(related) FROM l),
held AS (SELECT lang, 0 AS tier, flabel AS k, idx FROM l UNION ALL SELECT lang, 1, fid, idx FROM l),
res AS (SELECT r.idx, r.file, r.line, r.id, r.lang, r.field, r.value, arg_min(h.idx, (CASE WHEN h.lang = r.lang THEN 0 ELSE 2 END + h.tier) * 10000000 + h.idx) AS target FROM rel r LEFT JOIN held h ON h.k = lower(r.value) GROUP BY ALL),
e AS (SELECT DISTINCT field, idx AS a, target AS b FROM res WHERE field <> 'see' AND target IS NOT NULL),
up AS (SELECT a AS child, b AS parent FROM e WHERE field = 'broader' UNION SELECT b, a FROM e WHERE field = 'narrower')"""
_N = _T + """, named AS (SELECT idx, lang, 0 AS tier, flabel AS k FROM l UNION ALL SELECT idx, lang, 1, fid FROM l UNION ALL SELECT idx, lang, 2, lower(value) FROM alts)"""


def _resolved(source: str, name: str) -> str:
    """DuckDB: rows of a table with the target of their label and whether it was an alt-label."""
    return f""", {name} AS (SELECT r.*, t.idx AS target, t.tier = 2 AS by_alt FROM (SELECT *, row_number() OVER () AS n FROM ({source})) r LEFT JOIN LATERAL (
  SELECT idx, tier FROM named WHERE k = lower(r.label) ORDER BY CASE WHEN r.language IS NOT NULL AND lang = lower(r.language) THEN 0 WHEN r.language IS NOT NULL AND lang <> '' AND split_part(lang, '-', 1) = split_part(lower(r.language), '-', 1) THEN 1 ELSE 2 END, tier, idx LIMIT 1) t ON true)"""


def _out(rule: str, source: str, value: str = "value", other: str = "NULL", at: str = "file, line, id") -> str:
    return f" SELECT '{rule}' AS rule, {at}, CAST({value} AS VARCHAR) AS value, CAST({other} AS VARCHAR) AS other FROM {source}"


_PAGE = "file, line, CAST(NULL AS VARCHAR) AS id"
_LABEL_COLLIDER = "(SELECT min(o.idx) FROM l o WHERE o.flabel = lower(v.value) AND o.idx <> v.idx {} AND (o.lang = v.lang OR o.label <> v.value))"
_ALT_COLLIDER = "(SELECT min(o.idx) FROM fa o WHERE o.k = lower(v.value) AND o.idx <> v.idx {} AND (o.lang = v.lang OR o.value <> v.value))"


def terms_of(spark, d):
    for t in ("part", "supplier", "documents"):
        table(spark, d, t).createOrReplaceTempView(t)
    t = spark.sql(TERMS)
    return t.withColumn("designations", F.array(F.struct(F.lit("x").alias("term"), F.lit("deprecated").alias("status")), F.struct(F.upper("label").alias("term"), F.col("status").alias("status")))).withColumn("matches", F.array(F.struct(F.lit("exact").alias("kind"), F.col("exact").alias("iri")), F.struct(F.lit("close").alias("kind"), F.col("close").alias("iri"))))


def _own(name: str, oracle: str) -> None:
    rule = getattr(glossary, name)

    def run(spark, d):
        return rule(terms_of(spark, d))

    run.__name__ = f"term_{name}"
    query(oracle)(run)


_own("duplicate_id", _T + _out("duplicate-id", "(SELECT *, count(*) OVER (PARTITION BY lang, fid) AS n FROM l) WHERE n > 1", "id", "n - 1"))
_own("label_collision", _T + _out("label-collision", f"(SELECT v.*, {_LABEL_COLLIDER.format('AND o.idx < v.idx')} AS o FROM (SELECT *, label AS value FROM l) v) WHERE o IS NOT NULL", "label", "o"))
_own("alt_label_collision", _T + _out("alt-label-collision", f"(SELECT v.*, {_LABEL_COLLIDER.format('')} AS o FROM (SELECT DISTINCT idx, file, line, id, lang, value FROM alts) v) WHERE o IS NOT NULL", "value", "o"))
_own("ambiguous_alt_label", _T + _out("ambiguous-alt-label", f"(SELECT v.*, {_ALT_COLLIDER.format('AND o.idx < v.idx')} AS o FROM (SELECT DISTINCT idx, file, line, id, lang, value FROM alts) v) WHERE o IS NOT NULL", "value", "o"))
_own("label_overlap", _T + _out("label-overlap", "alts WHERE lower(value) = flabel") + " UNION ALL" + _out("label-overlap", "hid WHERE lower(value) = flabel OR list_contains(list_transform(alt, lambda a: lower(a)), lower(value))") + " UNION ALL" + _out("label-overlap", f"(SELECT v.*, coalesce({_LABEL_COLLIDER.format('')}, {_ALT_COLLIDER.format('')}) AS o FROM hid v WHERE NOT (lower(value) = flabel OR list_contains(list_transform(alt, lambda a: lower(a)), lower(value)))) WHERE o IS NOT NULL", "value", "o"))
_own("deprecated_label", _T + _out("deprecated-label", "l WHERE see IS NULL AND lower(status) IN ('deprecated', 'superseded')", "label"))
_own("dangling_reference", _T + _out("dangling-reference", "res WHERE target IS NULL", "value", "field"))
_own("see_not_empty", _T + _out("see-not-empty", "l WHERE see IS NOT NULL AND definition IS NOT NULL", "see"))
_own("missing_definition", _T + _out("missing-definition", "l WHERE see IS NULL AND definition IS NULL", "'definition'"))
_own("conflicting_matches", _T + _out("conflicting-matches", "l WHERE exact = close", "exact", "'close'"))
_own("abstract_too_long", _T + _out("abstract-too-long", "l WHERE length(abstract) > 60", "length(abstract)"))
_own("asymmetric_related", _T + _out("asymmetric-related", "e x JOIN l ON l.idx = x.b WHERE x.field = 'related' AND NOT EXISTS (SELECT 1 FROM e y WHERE y.field = 'related' AND y.a = x.b AND y.b = x.a)", "'related'", "x.a"))
_own("asymmetric_hierarchy", _T + " SELECT * FROM (" + " UNION ALL".join(_out("asymmetric-hierarchy", f"e x JOIN l ON l.idx = x.b WHERE x.field = '{a}' AND NOT EXISTS (SELECT 1 FROM e y WHERE y.field = '{b}' AND y.a = x.b AND y.b = x.a)", f"'{b}'", "x.a") for a, b in (("broader", "narrower"), ("narrower", "broader"))) + ")")
_own("broader_cycle", _T + ", walk AS (SELECT [child] AS path, parent AS spot FROM up UNION ALL SELECT list_append(path, spot), u.parent FROM walk w JOIN up u ON u.child = w.spot WHERE w.spot > w.path[1] AND NOT list_contains(w.path, w.spot))" + _out("broader-cycle", "walk w JOIN l ON l.idx = w.path[1] WHERE w.spot = w.path[1]", "array_to_string(list_append(path, path[1]), ' > ')"))
_ABOVE = ", rl AS (SELECT DISTINCT a, b FROM e WHERE field = 'related' AND a <> b), reach AS (SELECT child AS a, parent AS b FROM up UNION SELECT r.a, u.parent FROM reach r JOIN up u ON u.child = r.b)"
_own("related_in_hierarchy", _T + _ABOVE + _out("related-in-hierarchy", "rl JOIN l ON l.idx = rl.a LEFT JOIN reach x ON x.a = rl.a AND x.b = rl.b LEFT JOIN reach y ON y.a = rl.b AND y.b = rl.a WHERE x.a IS NOT NULL OR y.a IS NOT NULL", "CASE WHEN x.a IS NOT NULL THEN 'broader' ELSE 'narrower' END", "rl.b"))
_own("related_siblings", _T + _ABOVE + ", s AS (SELECT least(rl.a, rl.b) AS lo, greatest(rl.a, rl.b) AS hi, min(rl.a) AS a, min(p.parent) AS parent FROM rl JOIN up p ON p.child = rl.a JOIN up q ON q.child = rl.b AND q.parent = p.parent WHERE NOT EXISTS (SELECT 1 FROM reach x WHERE (x.a = rl.a AND x.b = rl.b) OR (x.a = rl.b AND x.b = rl.a)) GROUP BY 1, 2)" + _out("related-siblings", "s JOIN l ON l.idx = s.a", "parent", "CASE WHEN s.a = lo THEN hi ELSE lo END"))
_own("orphan_term", _T + _out("orphan-term", "l WHERE see IS NULL AND EXISTS (SELECT 1 FROM up) AND fid NOT IN (SELECT o.fid FROM l o WHERE o.idx IN (SELECT a FROM e UNION SELECT b FROM e))", "label"))


@query(_N + _resolved(REFERENCES, "r") + _out("undefined-term", "r WHERE target IS NULL", "label", at=_PAGE))
def term_undefined_term(spark, d):
    t = terms_of(spark, d)
    return glossary.undefined_term(t, spark.sql(REFERENCES))


@query(_N + _resolved(REFERENCES, "r") + _out("alt-label-reference", "r WHERE by_alt", "label", "target", at=_PAGE))
def term_alt_label_reference(spark, d):
    t = terms_of(spark, d)
    return glossary.alt_label_reference(t, spark.sql(REFERENCES))


@query(_N + _resolved(REFERENCES, "r") + _out("unused-term", "l WHERE fid NOT IN (SELECT o.fid FROM l o JOIN r ON r.target = o.idx)", "label"))
def term_unused_term(spark, d):
    t = terms_of(spark, d)
    return glossary.unused_term(t, spark.sql(REFERENCES))


@query(_N + _resolved(BLOCKS, "s") + _resolved("SELECT s.n AS edge, s.language, s.target AS subject, s.field, s.value AS label FROM s WHERE s.target IS NOT NULL", "v") + """,
told AS (SELECT v.edge, v.subject, v.field, coalesce('id ' || o.fid, 'name ' || lower(v.label)) AS concept FROM v LEFT JOIN l o ON o.idx = v.target),
own AS (SELECT res.idx, res.field, coalesce('id ' || o.fid, 'name ' || lower(res.value)) AS concept FROM res LEFT JOIN l o ON o.idx = res.target)""" + _out("hierarchy-outside-termbase", "s JOIN told ON told.edge = s.n WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.idx = told.subject AND own.field = told.field AND own.concept = told.concept)", "s.field || ' ' || s.value", "s.target", at="s.file, s.line, CAST(NULL AS VARCHAR) AS id"))
def term_hierarchy_outside_termbase(spark, d):
    t = terms_of(spark, d)
    return glossary.hierarchy_outside_termbase(t, spark.sql(BLOCKS))


@query("""WITH w AS (SELECT lower(word) AS k, doc_id, min(word) AS label FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents) WHERE length(word) > 9 GROUP BY 1, 2),
n AS (SELECT k, count(*) AS pages, min(lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS file, arg_min(label, doc_id) AS value FROM w GROUP BY 1 HAVING count(*) >= 3)""" + _out("keyword-candidate", "n WHERE k NOT IN (SELECT lower(p_name) FROM part)", "value", "pages", at="file, CAST(NULL AS INT) AS line, CAST(NULL AS VARCHAR) AS id"))
def term_keyword_candidate(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("label"), F.col("p_name").alias("id"), F.lit(None).cast("string").alias("language"), F.array().cast("array<string>").alias("alt"))
    words = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("file"), F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("label"))
    return glossary.keyword_candidate(t, words.where(F.char_length("label") > 9).withColumn("line", F.lit(None).cast("int")), 3)
