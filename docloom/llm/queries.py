"""The queries over the operators of this folder and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common, cover_dedup, fst_codec, jaccard_join, line_dedup, order_minhash, pfair_mix, prefix_trie, quality, secrets, sharding, spelling, spm_codec, token_store

SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: Target weights of the sources; others have the weight 2.
WEIGHTS = {"src0": 6, "src1": 3, "src2": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), 90, 100, 3)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))  # a row without an id is learned from by none
    model = quality.train(docs, labels.where(~held_out))
    d = quality.score(docs, model)
    return d.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.dedup_embeddings(table(spark, sf_dir, "embeddings"), 0.93)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_codec.encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, 2)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.read_index(spark, path)


def op11_fst_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fst_codec.encode_documents(table(spark, sf_dir, "documents"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return d.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("digest")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(spelling.corpus_words(table(spark, sf_dir, "documents"), drop_every=31))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (op1_line_dedup, op2_sharding, op3_jaccard_join, op4_secret_scan, op5_quality, op6_order_minhash, op7_embedding_dedup, op8_sentencepiece, op9_mix_sources, op10_token_store, op11_fst_bpe, op12_prefix_trie, op13_spelling_variants, pipeline)
    return {f.__name__: f for f in fs}


_OP1 = """
WITH lines AS (
  SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, l, pos, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), found AS (
  SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.doc_id, keyed.l, keyed.pos, found.stays IS NOT NULL AND found.stays <> keyed.doc_id AS gone
  FROM keyed LEFT JOIN found ON keyed.k = found.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, c.c = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id
"""


#: crc32 of a text in DuckDB: the table of all bytes, and a step for each byte of the text.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(strlen({0})), lambda i: CAST('0x' || substr(hex({0}), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1])), 4294967295)"

_OP12 = f"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), cs AS (
  SELECT c, n, {_CRC.format("CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT c, count(*) AS n FROM own GROUP BY c), {_CRC_TABLE}
), rebuilt AS (
  SELECT cs.c, o.pos AS d, o.role, o.text FROM cs JOIN own o ON o.c = cs.c - cs.c % 5 AND o.pos <= cs.h
  UNION ALL
  SELECT cs.c, o.pos - cs.h + least(cs.h, coalesce(l.n, 0)), o.role, o.text
  FROM cs JOIN own o ON o.c = cs.c AND o.pos > cs.h LEFT JOIN cs l ON l.c = cs.c - cs.c % 5
), members AS (
  SELECT c, 0 AS d, '' AS text, '' AS k FROM cs
  UNION ALL
  SELECT c, d, text, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) FROM rebuilt
), nodes AS (
  SELECT k, CAST(max(d) AS BIGINT) AS depth, min(c) AS conv_id, count(*) AS n_convs, max(strlen(text)) AS bytes FROM members GROUP BY k
), children AS (
  SELECT left(k, length(k) - 32) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), own_sums AS (
  SELECT n.k, n.depth, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * n.bytes AS saved FROM nodes n LEFT JOIN children c ON c.k = n.k
), sums AS (
  SELECT left(k, 32 * above) AS k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS above FROM own_sums) GROUP BY 1
), ends AS (
  SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h FROM (SELECT c, arg_max(k, d) AS k FROM members GROUP BY c) GROUP BY k
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.k = n.k LEFT JOIN children c ON c.k = n.k LEFT JOIN ends e ON e.k = n.k
  LEFT JOIN nodes p ON n.depth > 0 AND p.k = left(n.k, length(n.k) - 32)
"""

_OP13 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents)
), told AS (
  SELECT w, m, {_CRC.format("told")} AS h
  FROM (SELECT w, count(*) AS m, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS told FROM runs WHERE length(w) >= 7 GROUP BY doc_id, w), {_CRC_TABLE}
), words AS (
  SELECT w, CAST(sum(m) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, m FROM told)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(m) >= 2
), cut AS (
  SELECT w, n, unnest(range(length(w))) AS i FROM words
), holes AS (
  SELECT w, n, i, left(w, i) AS a, substr(w, i + 2) AS b FROM cut
), near AS (
  SELECT x.w, y.w AS o, y.n AS o_n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.w <> y.w
  UNION
  SELECT h.w, words.w, words.n FROM holes h JOIN words ON words.w = h.a || h.b
  UNION
  SELECT words.w, h.w, h.n FROM holes h JOIN words ON words.w = h.a || h.b
), best AS (
  SELECT w, count(*) AS n_near, max(o_n) AS most FROM near GROUP BY w
), formed AS (
  SELECT words.w, words.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 10 * words.n THEN b.most END AS form_n,
    CASE WHEN b.most >= 10 * words.n THEN (SELECT min(o) FROM near WHERE near.w = words.w AND near.o_n = b.most) END AS form
  FROM words LEFT JOIN best b ON b.w = words.w
), follow AS (
  SELECT w, w AS here, 0 AS step FROM formed
  UNION ALL
  SELECT follow.w, formed.form, step + 1 FROM follow JOIN formed ON formed.w = follow.here WHERE formed.form IS NOT NULL
)
SELECT f.w AS word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT w, arg_max(here, step) AS root FROM follow GROUP BY w) r ON r.w = f.w
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _OP1, "op7_embedding_dedup": _OP7, "op12_prefix_trie": _OP12, "op13_spelling_variants": _OP13}
