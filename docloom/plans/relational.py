"""The relational surface of corpus SQL: each query in Spark SQL; the DuckDB text is the same unless given."""

from __future__ import annotations

#: name -> (Spark SQL, DuckDB SQL or None where the same text runs on both)
QUERIES: dict[str, tuple[str, str | None]] = {
    "proj_expr": ("SELECT o_orderkey, upper(o_orderstatus) AS status, round(o_totalprice * 2, 2) AS doubled, o_orderkey % 7 AS bucket FROM orders", None),
    "filter_predicates": (
        "SELECT c_custkey, c_name FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 100) OR c_name ILIKE '%9' OR c_nationkey IS NULL OR (c_name RLIKE '^Customer#0+1' AND c_acctbal NOT BETWEEN 0 AND 50)",
        "SELECT c_custkey, c_name FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 100) OR c_name ILIKE '%9' OR c_nationkey IS NULL OR (regexp_matches(c_name, '^Customer#0+1') AND c_acctbal NOT BETWEEN 0 AND 50)",
    ),
    "join_inner": ("SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 50000", None),
    "dangling_reference": ("SELECT c.c_custkey, c.c_name FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000 WHERE o.o_orderkey IS NULL", None),
    "self_join": ("SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "cross_const": ("WITH route AS (SELECT '/docs' AS root, 2 AS depth) SELECT n_name, concat(root, '/', lower(n_name)) AS path, depth FROM nation CROSS JOIN route", None),
    "semi_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)", None),
    "semi_exists": ("SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 50)", None),
    "anti_not_in": ("SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_quantity > 40)"),
    # NOT IN written out: no row where the list holds a null, an equi anti join else
    "anti_not_in_null_trap": (
        "WITH l AS (SELECT CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS k, c_nationkey % 2 AS half FROM customer WHERE c_nationkey < 9), nulls AS (SELECT half, count_if(k IS NULL) AS n FROM l GROUP BY half) SELECT h.half, n_nationkey FROM nation JOIN nulls h ON h.n = 0 WHERE n_nationkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.half = h.half AND l.k = n_nationkey)",
        "WITH l AS (SELECT CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS k, c_nationkey % 2 AS half FROM customer WHERE c_nationkey < 9) SELECT h.half, n_nationkey FROM nation, (SELECT DISTINCT half FROM l) h WHERE n_nationkey NOT IN (SELECT k FROM l WHERE l.half = h.half)",
    ),
    # an equi-join for each length that a root has, instead of a comparison of all
    "theta_prefix_join": (
        "WITH roots AS (SELECT DISTINCT substring(url, 1, 14 + 2 * CAST(page_id % 3 AS INT)) AS root FROM pages), sizes AS (SELECT DISTINCT length(root) AS n FROM roots), cuts AS (SELECT substring(url, 1, n) AS root FROM pages CROSS JOIN sizes WHERE length(url) >= n) SELECT r.root, count(*) AS n FROM cuts p JOIN roots r ON p.root = r.root GROUP BY r.root",
        "WITH roots AS (SELECT DISTINCT substring(url, 1, 14 + 2 * CAST(page_id % 3 AS INT)) AS root FROM pages) SELECT r.root, count(*) AS n FROM pages p JOIN roots r ON starts_with(p.url, r.root) GROUP BY r.root",
    ),
    "join_full_outer": ("SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k", None),
    "join_right_using": ("SELECT k, a.n AS customers, b.name FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) a RIGHT JOIN (SELECT n_nationkey AS k, n_name AS name FROM nation) b USING (k)", None),
    "json_each_census": (
        "SELECT k AS key, v AS value, count(*) AS n FROM events LATERAL VIEW explode(from_json(props, 'map<string,string>')) t AS k, v GROUP BY k, v",
        "SELECT k AS key, props->>k AS value, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1, 2",
    ),
    "duplicate_keys": ("SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY md5(text) HAVING count(*) > 1", None),
    "agg_basic": ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_distinct_filter": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY o_orderstatus", None),
    "group_concat": (
        "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "json_group_array": (
        "SELECT n_regionkey, to_json(array_sort(collect_list(n_name))) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, CAST(to_json(list_sort(list(n_name))) AS VARCHAR) AS names FROM nation GROUP BY n_regionkey",
    ),
    "ratio_agg": ("SELECT l_returnflag, round(CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS ratio FROM lineitem GROUP BY l_returnflag", None),
    "union_all": ("SELECT c_nationkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20", None),
    "except": ("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09", None),
    "cte_chain": ("WITH big AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT k, total FROM big ORDER BY total DESC, k LIMIT 25), ranked AS (SELECT k, total, rank() OVER (ORDER BY total DESC, k) AS r FROM top) SELECT k, round(total, 2) AS total, r FROM ranked", None),
    "values_join": ("SELECT v.name, count(*) AS n FROM (VALUES ('O', 'open'), ('F', 'filled'), ('P', 'partial')) AS v(code, name) JOIN orders ON o_orderstatus = v.code GROUP BY v.name", None),
    "recursive_cte": ("WITH RECURSIVE reach(node, depth) AS (SELECT 0, 0 UNION ALL SELECT n.n_nationkey, r.depth + 1 FROM reach r JOIN nation n ON n.n_nationkey IN (2 * r.node + 1, 2 * r.node + 2) WHERE r.depth < 6) SELECT node, depth FROM reach", None),
    "scalar_subquery": ("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS above FROM customer", None),
    "order_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", None),
    "case_coalesce": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand FROM part", None),
    "window_rank": ("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)", None),
    "window_frame": ("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders", None),
    "window_lag": ("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type, 2, 'end') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events", None),
    "cube_extra": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    # spans meet in buckets of 16 that they touch; the first bucket that both touch gives the pair, once
    "range_overlap_join": (
        "WITH spans AS (SELECT doc_id, doc_id * 3 AS s, doc_id * 3 + 1 + n_chars % 7 AS e FROM documents), marks AS (SELECT item_id, item_id * 11 AS s, item_id * 11 + 4 AS e FROM benchmark), sb AS (SELECT *, explode(sequence(s div 16, e div 16)) AS b FROM spans), mb AS (SELECT *, explode(sequence(s div 16, e div 16)) AS b FROM marks) SELECT d.doc_id, m.item_id FROM sb d JOIN mb m ON d.b = m.b AND d.s <= m.e AND d.e >= m.s WHERE d.b = greatest(d.s div 16, m.s div 16)",
        "WITH spans AS (SELECT doc_id, doc_id * 3 AS s, doc_id * 3 + 1 + n_chars % 7 AS e FROM documents), marks AS (SELECT item_id, item_id * 11 AS s, item_id * 11 + 4 AS e FROM benchmark) SELECT d.doc_id, m.item_id FROM spans d JOIN marks m ON d.s <= m.e AND d.e >= m.s",
    ),
    "scalar_strings": (
        "SELECT doc_id, length(text) AS n, lower(substr(text, 1, 10)) AS head, instr(text, ' ') AS blank, replace(source, 'src', 's') AS s, rtrim('0', concat(source, '00')) AS r, concat(lang, '/', source) AS path FROM documents",
        "SELECT doc_id, length(text) AS n, lower(substr(text, 1, 10)) AS head, instr(text, ' ') AS blank, replace(source, 'src', 's') AS s, rtrim(source || '00', '0') AS r, lang || '/' || source AS path FROM documents",
    ),
    "scalar_json": (
        "SELECT event_id, get_json_object(props, '$.k') AS k, try_parse_json(props) IS NOT NULL AS valid, size(json_object_keys(props)) AS keys FROM events",
        "SELECT event_id, props->>'$.k' AS k, json_valid(props) AS valid, CAST(len(json_keys(props)) AS INTEGER) AS keys FROM events",
    ),
    "scalar_dates": (
        "SELECT event_id, to_date(ts) AS day, date_add(to_date(ts), -90) AS back, datediff(DATE'2024-02-01', to_date(ts)) AS age, year(ts) * 100 + month(ts) AS ym FROM events",
        "SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) - 90 AS back, CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS INTEGER) AS age, CAST(year(ts) * 100 + month(ts) AS INTEGER) AS ym FROM events",
    ),
    "scalar_math": ("SELECT o_orderkey, round(o_totalprice, 1) AS r, CAST(floor(o_totalprice / 1000) AS BIGINT) AS k, least(o_orderkey, o_custkey) AS lo, greatest(o_orderkey, o_custkey) AS hi, abs(o_custkey - o_orderkey) AS d FROM orders", None),
    # checks, inference, precedence
    "corpus_check_unique": ("SELECT CAST(d.doc_id AS STRING) AS path, 'text' AS key, concat('n=', CAST(g.n AS STRING)) AS message FROM documents d JOIN (SELECT md5(text) AS k, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1) g ON md5(d.text) = g.k", None),
    "resolve_precedence": ("SELECT doc_id, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'asserted' WHEN b IS NOT NULL THEN 'derived' ELSE 'default' END AS origin FROM (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'label' END AS a, CASE WHEN d.n_chars > 2000 THEN d.lang END AS b, d.source AS c FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)", None),
    "record_refs": ("SELECT c.c_custkey, n.n_nationkey FROM (SELECT c_custkey, upper(concat('N', CAST(c_nationkey AS STRING))) AS ref FROM customer) c JOIN (SELECT n_nationkey, lower(concat('n', CAST(n_nationkey AS STRING))) AS id FROM nation) n ON lower(c.ref) = n.id", None),
    # graph aggregates
    "coverage": ("SELECT d.lang, round(CAST(100 AS DOUBLE) * count(l.doc_id) / count(*), 1) AS labelled, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY d.lang", None),
    "untranslated": ("SELECT s.source, g.lang FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT DISTINCT lang FROM documents) g LEFT JOIN (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 3000) d ON d.source = s.source AND d.lang = g.lang WHERE d.source IS NULL", None),
    "anti_concepts": ("SELECT p_partkey FROM part p LEFT ANTI JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) l ON l.l_partkey = p.p_partkey", "SELECT p_partkey FROM part p ANTI JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) l ON l.l_partkey = p.p_partkey"),
    "lang_partition": ("SELECT coalesce(nullif(lang, ''), 'und') AS language, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1", None),
    "related_conflicts": ("WITH e AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation), up AS (SELECT a, b FROM e UNION SELECT e.a, f.b FROM e JOIN e f ON e.b = f.a), rel AS (SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey = 4 * b.n_nationkey) SELECT DISTINCT x, y FROM rel JOIN up ON up.a = rel.x AND up.b = rel.y", None),
    "label_collision": ("SELECT a.c_custkey AS first, b.c_custkey AS second FROM customer a JOIN customer b ON substr(a.c_name, 10, 8) = substr(b.c_name, 10, 8) AND a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey", None),
    "keyword_candidate": ("SELECT lower(word) AS keyword, count(DISTINCT doc_id) AS files FROM (SELECT doc_id, explode(split(text, ' ')) AS word FROM documents) WHERE length(word) > 6 GROUP BY lower(word) HAVING count(DISTINCT doc_id) >= 2", "SELECT lower(word) AS keyword, count(DISTINCT doc_id) AS files FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE length(word) > 6 GROUP BY lower(word) HAVING count(DISTINCT doc_id) >= 2"),
    "asymmetric_related": ("WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT count(*) AS n FROM e LEFT JOIN e r ON r.a = e.b AND r.b = e.a WHERE r.a IS NULL", None),
    "impact_rollup": ("SELECT c_mktsegment, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS warnings, count(*) AS findings FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment", None),
    "traffic_report": (
        "WITH views AS (SELECT user_id % 50 AS page, count(*) AS views, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS exits FROM events GROUP BY 1), found AS (SELECT page_id, url FROM pages) SELECT f.url, coalesce(v.views, 0) AS views, coalesce(v.exits, 0) AS exits, round(CAST(v.exits AS DOUBLE) / v.views, 4) AS rate FROM found f LEFT JOIN views v ON v.page = f.page_id UNION ALL SELECT NULL, v.views, v.exits, round(CAST(v.exits AS DOUBLE) / v.views, 4) FROM views v WHERE v.page NOT IN (SELECT page_id FROM found)",
        None,
    ),
    "block_counts": (
        "SELECT page_id, CAST(size(regexp_extract_all(html, '<p[ >]', 0)) AS BIGINT) AS paragraphs, CAST(size(regexp_extract_all(html, '<a ', 0)) AS BIGINT) AS links FROM pages",
        "SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links FROM pages",
    ),
    "scalar_json_more": (
        "SELECT event_id, schema_of_variant(variant_get(parse_json(props), '$.k')) = 'BIGINT' AS whole, to_json(array(event_type, get_json_object(props, '$.k'))) AS pair, json_array_length('[1,2,3]') AS n, to_json(map_concat(from_json(props, 'map<string,int>'), map('u', user_id))) AS patched FROM events",
        "SELECT event_id, json_type(props, '$.k') = 'UBIGINT' AS whole, CAST(json_array(event_type, props->>'$.k') AS VARCHAR) AS pair, CAST(json_array_length('[1,2,3]') AS INTEGER) AS n, CAST(json_merge_patch(props, json_object('u', user_id)) AS VARCHAR) AS patched FROM events",
    ),
    # columns beside the grouping that SQLite would take from the row of the extreme
    "bare_columns": (
        "SELECT user_id, max(value) AS top, max_by(event_id, struct(value, -event_id)) AS event_id, max_by(event_type, struct(value, -event_id)) AS event_type FROM events GROUP BY user_id",
        "SELECT user_id, max(value) AS top, first(event_id ORDER BY value DESC, event_id) AS event_id, first(event_type ORDER BY value DESC, event_id) AS event_type FROM events GROUP BY user_id",
    ),
}
