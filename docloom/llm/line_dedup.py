"""Line dedup, with DataFrame functions only.

Hashes of line keys are range-partitioned and sorted by document and position; a window streams over each key's
first occurrences and marks the lines to drop. Drops return to their document as a sparse bitmap (64 lines a word;
words in which every line stays are left out), never as text. Keys that hold so many lines that they would fill a
partition are pre-aggregated instead: a sketch of bounded size names them, and both ways give the same drops.

Rows of one doc_id are one document; rows of the same doc_id and text are the same lines. Null and empty texts have
one empty line. Null doc_ids are one document, below all others. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import LOWER, UPPER, WHITE, column, discard, hot_keys, materialize, small_enough


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased; lower() is the quick way where all is ASCII."""
    s = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, row, pos, h1, h2) of each line whose key is long enough; row tells texts of one document apart."""
    text = column(text_col)
    d = docs.where(text.isNotNull()).select(column(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("row"), F.split(text, "\n").alias("ls"))
    d = d.select("doc", "row", F.posexplode("ls").alias("pos", "l")).where(F.char_length("l") >= min_chars)
    d = d.select("doc", "row", "pos", line_key(F.col("l")).alias("k")).where(F.char_length("k") >= min_chars)
    return d.select("doc", "row", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2"))


def dropped_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(doc, row, pos) of lines that go: of keys in at least min_docs documents, all but the largest document's."""
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(lines, "h1", 1 / (2 * parts), 2 * parts)
    order = F.col("doc").desc_nulls_last()
    cold = lines.where(~F.col("h1").isin(hot)) if hot else lines
    key = Window.partitionBy("h1", "h2")
    cold = cold.repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", order, "row", "pos")
    cold = cold.withColumn("nth", F.dense_rank().over(key.orderBy(order)))
    cold = cold.withColumn("docs", F.max("nth").over(key)).where((F.col("docs") >= min_docs) & (F.col("nth") > 1)).select("doc", "row", "pos")
    if not hot:
        return cold
    warm = lines.where(F.col("h1").isin(hot))
    per_doc = warm.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    stays = per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("stays")).where(F.col("docs") >= min_docs)
    # at most as many rows as the sketch names keys, but for 64-bit collisions
    warm = warm.join(F.broadcast(stays), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("stays"))).select("doc", "row", "pos")
    return cold.union(warm)


def bitmaps(drops: DataFrame) -> DataFrame:
    """(doc, row, words): for each 64 lines with a drop, in order, the word's index and the bits of the lines that go."""
    w = drops.select("doc", "row", F.shiftright("pos", 6).alias("i"), F.expr("shiftleft(1L, pos % 64)").alias("b"))
    w = w.groupBy("doc", "row", "i").agg(F.bit_or("b").alias("b"))
    return w.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("words"))


def kept_text(text: Column, words: Column) -> Column:
    """The lines whose bits are not set, joined by \\n."""
    last = F.element_at(words, -1)["i"]
    index = F.map_from_entries(words)
    dense = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.element_at(index, i), F.lit(0).cast("long")))
    one = F.array(F.struct(F.split(text, "\n").alias("ls"), dense.alias("d")))  # bound once, not once for each line
    kept = F.transform(one, _keep)
    return F.array_join(F.get(kept, F.lit(0)), "\n")


def _keep(s: Column) -> Column:
    word = lambda p: F.coalesce(F.get(s["d"], F.shiftright(p, 6)), F.lit(0).cast("long"))
    return F.filter(s["ls"], lambda _, p: F.call_function("getbit", word(p), p % 64) == 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, kept_text, n_lines, n_dropped, words, whole): n_lines counts all lines, words is the bitmap (null: every line stays), whole holds the row."""
    lines = materialize(keyed_lines(docs, id_col, text_col, min_chars))
    maps = materialize(bitmaps(dropped_lines(lines, min_docs)).select("doc", F.col("row").alias("of"), "words"))
    discard(lines)
    d = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"), F.xxhash64(column(text_col)).alias("row"), F.struct(*(column(c) for c in docs.columns)).alias("whole"))
    # within the bound no text is shuffled; beyond it the bitmaps, not the texts, are what is hashed in memory
    d = d.join(F.broadcast(maps) if small_enough(maps) else maps.hint("shuffle_hash"), d.doc_id.cast("long").eqNullSafe(maps.doc) & (d["row"] == maps.of), "left")
    n = F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1
    gone = F.aggregate("words", F.lit(0), lambda a, x: a + F.bit_count(x["b"]))
    kept = F.when(F.col("words").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("words")))
    return d.select("doc_id", kept.alias("kept_text"), n.cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"), "words", "whole")
