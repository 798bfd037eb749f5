"""From documents to token ids: quality, line dedup, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import jaccard_join, line_dedup, pfair_mix, quality, spm_codec
from docloom.llm.common import column, discard, fresh, materialize
from docloom.llm.queries import WEIGHTS, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more stay. The model learns from the labels, on a bounded sample.

    Null and empty texts are scored like others; equal texts stay or go together; without any label all stay, at 0.5.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = fresh("docloom score", docs.columns)
    d = quality.score(docs, model, keep=docs.columns, score_col=name)
    return d.where(d[name] >= 0.3).select(*(column(c) for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that repeat in five documents or more; n_chars follows.

    A row that loses nothing stays as it is, null texts too; rows that repeat a doc_id are one document.
    """
    d, less = line_dedup.dedup_lines(docs), F.col("n_dropped") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return d.select(*(F.when(less, new[c]).otherwise(F.col("whole")[c]).alias(c) if c in new else F.col("whole")[c].alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one of smallest id stays.

    Texts without words, and rows without an id, are linked with nothing and stay; all rows of an id stay or go together.
    """
    return jaccard_join.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, written in the order of the mixture; a null source is one of its own, repeated rows have a place each."""
    return pfair_mix.mix_documents(docs, WEIGHTS, 2)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids, position): the place in the mixture, by the files that the stage before wrote. A null text is empty."""
    d = pfair_mix.written_places(docs, "docloom place")
    return spm_codec.encode_documents(d, place_col="docloom place").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "position")


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_stage), ("mixing sources", mix_stage), ("SentencePiece encoding", encode_stage)]
#: Trees, mixing and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        was, docs = docs, materialize(stage(spark, docs, sf_dir))
        if i:  # the first one read the input
            discard(was)
    return STAGES[-1][1](spark, docs, sf_dir)
