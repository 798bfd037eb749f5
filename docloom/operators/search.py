"""Lexical, vector and fused search, and how well they find."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B, DELTA, RRF_K = 1.2, 0.7, 0.5, 60


def postings(entries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, size) of lower-cased words."""
    words = F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    e = entries.select(F.col(id_col).alias("id"), words.alias("w"))
    e = e.select("id", F.size("w").alias("size"), F.explode("w").alias("term"))
    return e.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))


def _is(term: str):
    return lambda x: x == term


def lexical(entries: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text", limit: int = 10) -> DataFrame:
    """(id, score, rank): BM25+ over the query's terms, ties by id. The texts are read once: sizes and counts of the query's terms are written."""
    from docloom.plans.lineage import cut

    words = F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    e = entries.select(F.col(id_col).alias("id"), words.alias("w")).withColumn("size", F.size("w"))
    terms = [t.lower() for t in query]
    e = e.select("id", "size", *(F.size(F.filter("w", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)))
    e = cut(e)
    stats = e.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    j = e.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score += F.when(tf > 0, idf * (DELTA + tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("avg"))))).otherwise(0.0)
    return ranked(j.select("id", F.round(score, 9).alias("score")), limit)


def fielded(entries: DataFrame, query: list[str], fields: dict[str, float], id_col: str = "id", limit: int = 10, prefix: bool = True, fuzzy: float = 0.2) -> DataFrame:
    """(id, score, rank): BM25+ over several fields with boosts; a query term also matches words that start with it (weight 0.375) or lie within fuzzy x its length edits (0.45), each less by its distance.

    The texts are read once: postings of words that match some term are written, and statistics come from those and from
    one row of field sizes for each entry.
    """
    from docloom.plans.lineage import cut

    terms = sorted({t.lower() for t in query})
    far = F.col("edits")
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(float(b)).alias("boost"), words(F.col(f)).alias("w")) for f, b in fields.items()))
    match = lambda x, t: (x == t) | (x.startswith(t) if prefix else F.lit(False)) | ((F.abs(F.char_length(x) - len(t)) <= round(fuzzy * len(t))) & (F.levenshtein(x, F.lit(t)) <= round(fuzzy * len(t))))
    any_term = lambda x: reduce(Column.__or__, (match(x, t) for t in terms))
    d = entries.select(F.col(id_col).alias("id"), F.explode(parts).alias("p")).select("id", "p.field", "p.boost", F.size("p.w").alias("size"), F.filter("p.w", any_term).alias("hits"))
    d = cut(d)
    stats = d.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg"))
    e = d.where(F.size("hits") > 0).select("id", "field", "boost", "size", F.explode("hits").alias("word")).groupBy("id", "field", "boost", "size", "word").agg(F.count(F.lit(1)).alias("tf"))
    e = e.withColumn("term", F.explode(F.array(*map(F.lit, terms)))).withColumn("edits", F.when(F.col("word") == F.col("term"), 0).otherwise(F.levenshtein("word", "term")))
    bound = F.round(F.char_length("term") * fuzzy)
    starts = F.startswith("word", F.col("term")) if prefix else F.lit(False)
    weight = F.when(F.col("word") == F.col("term"), 1.0).when(starts, 0.375 * F.char_length("word") / (F.char_length("word") + 0.3 * (F.char_length("word") - F.char_length("term")))).when(far <= bound, 0.45 * F.char_length("word") / (F.char_length("word") + far))
    e = cut(e.withColumn("weight", weight).where("weight is not null"))
    df = e.groupBy("field", "word").agg(F.countDistinct("id").alias("df"))
    j = e.join(df, ["field", "word"]).join(F.broadcast(stats), "field")  # one row a field
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = F.col("boost") * F.col("weight") * idf * (DELTA + F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avg"))))
    return ranked(j.groupBy("id").agg(F.round(F.sum(score), 9).alias("score")), limit)


def assemble(found: DataFrame, budget: int) -> DataFrame:
    """found (query, rank, id, text) with used and reason: taken in rank order while they fit a budget of UTF-16 units; a text that is too big is skipped, and later ones may still fit.

    Greedy and in order, so one fold for each query over its ranked list, on the JVM.
    """
    size = (F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("long")
    g = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", size.alias("size")))).alias("xs"))  # a ranked list has a limit
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<id:string,rank:int,taken:boolean>>").alias("out"))
    step = lambda acc, x: F.struct(F.when(acc["sum"] + x["size"] <= budget, acc["sum"] + x["size"]).otherwise(acc["sum"]).alias("sum"), F.array_append(acc["out"], F.struct(x["id"].cast("string").alias("id"), x["rank"].cast("int").alias("rank"), (acc["sum"] + x["size"] <= budget).alias("taken"))).alias("out"))
    return g.select("query", F.explode(F.aggregate("xs", start, step)["out"]).alias("x")).select("query", "x.rank", "x.id", F.col("x.taken").alias("used"), F.when(~F.col("x.taken"), "budget").alias("reason"))


def passages(chunks: DataFrame, where: dict[str, str], withheld: DataFrame) -> DataFrame:
    """Chunks (id, path, _data, ..) whose metadata has all values of ``where``, with the reason for which some are withheld (path, reason)."""
    d = chunks
    for k, v in where.items():
        d = d.where(F.get_json_object("_data", f"$['{k}']") == v)
    return d.join(withheld, "path", "left")


def copied(questions: DataFrame, answers: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, copied, of): the adjacent word pairs of a question (id, text) that its own answers (id, text) have, where that is a share of ``least`` or more; of at least two words.

    Words are runs of letters and digits. Questions meet their own answers only.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    q = questions.select("id", pairs(words(F.col("text"))).alias("q")).where(F.size("q") > 0)
    a = answers.select(F.col("id").alias("aid"), pairs(words(F.col("text"))).alias("a"))
    hit = q.join(a, F.col("id") == F.col("aid")).select("id", F.size("q").alias("of"), F.explode(F.array_intersect("q", "a")).alias("g")).distinct()
    return hit.groupBy("id", "of").agg(F.count(F.lit(1)).alias("copied")).where(F.col("copied") >= least * F.col("of")).select("id", "copied", "of")


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    top = scores.orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # over at most limit rows


def vector(vectors: DataFrame, query: list[float], id_col: str = "vec_id", vector_col: str = "embedding", limit: int = 10, least: float = 0.0) -> DataFrame:
    """(id, score, rank): exact cosine, ties by id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector_col)
    score = dot(v, q) / F.sqrt(dot(v, v.cast("array<double>")) * dot(q, q))
    s = vectors.select(F.col(id_col).alias("id"), F.round(score, 9).alias("score")).where(F.col("score") >= least)
    return ranked(s, limit)


def fuse(legs: list[DataFrame], k: int = RRF_K, limit: int = 10) -> DataFrame:
    """(id, score, rank): sums of 1 / (k + rank) over the legs (id, rank)."""
    every = legs[0].select("id", "rank")
    for x in legs[1:]:
        every = every.unionAll(x.select("id", "rank"))
    return ranked(every.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score")), limit)


def recall_at(hits: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """(found, first, questions) of hits (question, id, rank) and answers (question, id)."""
    best = answers.join(hits, ["question", "id"], "left").groupBy("question").agg(F.min("rank").alias("best"))
    return best.agg(F.count_if(F.col("best") <= k).alias("found"), F.count_if(F.col("best") == 1).alias("first"), F.count(F.lit(1)).alias("questions"))
