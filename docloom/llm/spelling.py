"""Groups of spelling variants: words one edit apart, found by an even-partition pigeonhole join.

One edit leaves one half of a word whole. Each word is cut into two segments whose lengths follow from its own length;
words are indexed under both, and probe with the substrings that would be the same segments of words of equal length or of
words shorter by one, shifted by one in the second half. Equal keys give candidates, each is verified by edit distance, and
pairs found by both halves count once. Where a segment is common (more than BUCKET words on either side) its rows are cut
again: the rest of the word, which must hold the edit, is divided into two segments of its own, until the rest is one
letter. So no group is ever paired whole, and every pair is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import LOWER, UPPER, column, materialize, pointed, sized_join

#: Letters of words: ASCII, and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]"
#: Words of the smaller side up to which a bucket is joined as it is.
BUCKET = 24


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, drop_every: int | None = None) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, A-Z lower-cased, of ``shortest`` code points and ``least`` occurrences.

    With drop_every, a run whose crc32 (of ``id:run``) it divides loses one letter, at crc % length: misspellings at known
    places. Null texts hold no words, a null id counts as empty, repeated rows count each. Other columns aren't read.
    Occurrences are added up before the shuffle, so a frequent word is a row for each task.
    """
    runs = F.regexp_extract_all(column(text_col), F.lit(f"{RUN}{{{shortest},}}+"), F.lit(0))
    d = docs.select(F.coalesce(column(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    d = d.select("id", word.alias("word"))
    if drop_every:
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        at = (h % F.char_length("word")).cast("int")
        less = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.char_length("word")))
        d = d.select(F.when(h % drop_every == 0, less).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= shortest)
    return d.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _segments(word: Column, lo: Column, hi: Column, g: Column, key: list[Column]) -> Column:
    """The two ways on from a row whose letters before lo and from hi on are matched; g is the indexed word's rest."""
    h = F.floor(g / 2).cast("int")
    left = F.struct(F.xxhash64(*key, F.lit(0), word.substr(lo + 1, h)).alias("key"), (lo + h).alias("lo"), hi.alias("hi"), (g - h).alias("g"))
    right = F.struct(F.xxhash64(*key, F.lit(1), word.substr(hi - g + h + 1, g - h)).alias("key"), lo.alias("lo"), (hi - g + h).alias("hi"), h.alias("g"))
    return F.array(left, right)


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b, a_n, b_n), a < b: all pairs of distinct words of ``words`` (word, n) that one edit separates, once each.

    kind 0 rows meet words of their own length, kind 1 is the shorter and kind 2 the longer one of a pair. Keys are 64-bit
    hashes of a path of segments; what they confuse, the distance tells apart.
    """
    size = F.char_length("word")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (size - int(k == 2)).alias("g")) for k in (0, 1, 2)))).alias("x")
    d = words.select("word", "n", size.alias("size"), kinds).select("word", "n", "x.kind", "x.g", F.lit(0).alias("lo"), F.col("size").alias("hi")).where("g > 0")
    first, found = [F.when(F.col("kind") == 0, 0).otherwise(1), F.col("g")], None
    while True:
        d = d.select("word", "n", "kind", F.explode(_segments(F.col("word"), F.col("lo"), F.col("hi"), F.col("g"), first)).alias("x")).select("word", "n", "kind", "x.*")
        first = [F.col("key")]
        count = lambda *k: F.count(F.when(F.col("kind").isin(*k), 1))
        hot = materialize(d.where("g > 1").groupBy("key").agg(count(0, 1).alias("i"), count(0, 2).alias("p")).where(F.least("i", "p") > bucket).select("key"))
        more = not hot.isEmpty()
        cold = sized_join(d, hot, "key", "left_anti") if more else d
        a = cold.where("kind < 2").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("kind").alias("a_kind"))
        b = cold.where("kind <> 1").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("kind").alias("b_kind"))
        near = a.join(b, "key").where("(a_kind = 1 and b_kind = 2) or (a_kind = 0 and b_kind = 0 and a < b)").where(F.levenshtein("a", "b", 1) == 1)
        swap = F.col("a") > F.col("b")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
        near = materialize(near.select(pick("a", "b"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), pick("a_n", "b_n"), F.when(swap, F.col("a_n")).otherwise(F.col("b_n")).alias("b_n")))
        found = near if found is None else found.union(near)
        if not more:
            return found.dropDuplicates(["a", "b"])
        d = materialize(sized_join(d, hot, "key", "left_semi"))


def group_spellings(words: DataFrame, ratio: int = 10, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n), which must be distinct.

    form: the near word of largest n (ties: the smallest in code-point order) where that n is ratio times the word's own,
    else null; root: the last of the forms that follow each other, the word itself if none. As n grows along forms, they
    end after few steps; pointers double until none moves. Null words are left out; an empty table gives no rows.
    """
    words = materialize(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")))
    p = near_pairs(words, bucket)
    both = p.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("o"), F.col("b_n").alias("o_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("o"), F.col("a_n").alias("o_n")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("o_n")).alias("m"), F.col("o").alias("o"))).alias("best"))
    has = F.coalesce(-F.col("best.m") >= ratio * F.col("n"), F.lit(False))
    d = materialize(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.o")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")))
    root = pointed(d.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("parent")))
    out = sized_join(d, root, d.word == root.node, "left")
    return out.select("word", "form", F.coalesce("parent", "word").alias("root"), "n", "n_near", "form_n")
