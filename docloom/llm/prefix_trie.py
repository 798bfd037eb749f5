"""The trie of conversation prefixes, rolled up by pointer jumping.

A node is a sequence of first turns, named by a 128-bit digest that is the exclusive or of its turns' digests, each taken
with its place. So the digests along a conversation are a running combination that parts of it can compute apart (a
conversation may be longer than a partition), and a node's parent edge follows from its own last turn. Nodes are grouped by
digest, counts and savings add up over the subtrees in rounds: in round k each node hands what it gathered within 2^k - 1
steps to its ancestor 2^k steps up, and then points twice as far, so that a depth of d takes log2(d) rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import column, discard, materialize, sized_join

#: Decimal ids that are joined to one text before those of a node meet.
PART = 1_000
EMPTY = hashlib.sha256(b"").hexdigest()


def _digests(*of: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *of) for seed in (11, 12)]


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each row among the consecutive rows of its conversation, and the task's number."""
    from pyspark import TaskContext

    part, last, before = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(0).to_numpy()
        first = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
        size = np.diff(np.append(first, len(c)))
        at = np.arange(1, len(c) + 1) - np.repeat(first, size)
        if c[0] == last:
            at[: size[0]] += before
        last, before = c[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int32)), pa.array(at.astype(np.int64)), *b.columns], names=["part", "at", *b.schema.names])


def _carried(d: DataFrame, value: list[Column], names: list[str]) -> DataFrame:
    """(part, conv, *names): aggregates of a conversation's rows in the parts before, for conversations in several parts.

    Parts hold ranges, so that at most two conversations of a part go on in another one: a few rows for each partition.
    """
    ends = d.groupBy("part").agg(F.min("conv").alias("lo"), F.max("conv").alias("hi"))
    ends = ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("conv")).groupBy("conv").count().where("count > 1").select("conv")
    each = d.join(F.broadcast(ends), "conv").groupBy("part", "conv").agg(*(v.alias(n) for v, n in zip(value, names, strict=True)))
    w = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    how = {"n": F.sum}
    return each.select("part", "conv", *(how.get(n, F.bit_xor)(n).over(w).alias(n) for n in names)).where(F.col(names[0]).isNotNull())


def number_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(part, conv, pos, a, b, size): turns by their place from 1 on, with a digest of role and text and the text's bytes.

    Turns are ordered by turn, null first; those of one turn by role and text, and repeated rows are turns each. Texts
    stay where they are but for those of tied turns. Rows without a conversation are left out.
    """
    text, role = F.coalesce(column(text_col).cast("string"), F.lit("")), F.coalesce(column(role_col).cast("string"), F.lit(""))
    a, b = _digests(F.col("role"), F.col("text"))
    base = turns.select(column(conv_col).cast("long").alias("conv"), column(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null")
    tied = materialize(base.groupBy("conv", "turn").count().where("count > 1").select(F.col("conv").alias("tied conv"), F.col("turn").alias("tied turn")))
    if tied.isEmpty():
        d = base.withColumn("tie", F.lit(None).cast("string"))
    else:
        on = (F.col("conv") == F.col("tied conv")) & F.col("turn").eqNullSafe(F.col("tied turn"))
        d = sized_join(base, tied, on, "left").withColumn("tie", F.when(F.col("tied conv").isNotNull(), F.col("text")))
    d = d.select("conv", "turn", "role", "tie", a.alias("a"), b.alias("b"), F.octet_length("text").cast("long").alias("size"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie"), F.col("a"), F.col("b")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "a", "b", "size")
    d = materialize(d.mapInArrow(_along, "part int, at long, conv long, a long, b long, size long"))
    before = _carried(d, [F.count(F.lit(1))], ["n"])
    return d.join(F.broadcast(before), ["part", "conv"], "left").select("part", "conv", (F.col("at") + F.coalesce("n", F.lit(0))).alias("pos"), "a", "b", "size")


def rebuilt(t: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Prefixes and conversations of rebuilt ones, from number_turns().

    Conversation c begins with the first h turns of c - c % family, h = crc32(decimal c) % most, and goes on with its own
    turns after its first h. Gives (conv, depth, ka, kb, pa, pb, size, ends), the digests of each prefix and of the one
    before it and whether the conversation ends there, and (conv, length). At most most - 1 rows of a conversation are copied, each to its family.
    """
    convs = materialize(t.groupBy("conv").agg(F.max("pos").alias("n")).select("conv", "n", (F.col("conv") - F.col("conv") % family).alias("lead"), (F.crc32(F.col("conv").cast("string")) % most).alias("h")))
    x = _digests(F.col("pos"), F.col("a"), F.col("b"))
    w = Window.partitionBy("conv").orderBy("pos")
    head = t.where(F.col("pos") < most).select("conv", "pos", "size", x[0].alias("xa"), x[1].alias("xb"))
    head = head.select("conv", "pos", "size", F.bit_xor("xa").over(w).alias("ka"), F.bit_xor("xb").over(w).alias("kb"), "xa", "xb")
    heads = head.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "size", "ka", "kb", "xa", "xb"))).alias("head")).withColumnRenamed("conv", "lead of")
    c = convs.join(heads, F.col("lead") == F.col("lead of"), "left")
    c = c.select("conv", "n", "h", F.slice(F.coalesce("head", F.expr("cast(array() as array<struct<pos: long, size: long, ka: long, kb: long, xa: long, xb: long>>)")), F.lit(1), F.col("h").cast("int")).alias("head"))
    c = materialize(c.select("conv", "n", "h", "head", F.size("head").cast("long").alias("m"), F.get("head", F.size("head") - 1).alias("z")))
    length = c.select("conv", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    begins = c.select("conv", (F.col("n") <= F.col("h")).alias("short"), "m", F.explode("head").alias("x"))
    begins = begins.select("conv", F.col("x.pos").alias("depth"), "x.ka", "x.kb", F.col("x.ka").bitwiseXOR(F.col("x.xa")).alias("pa"), F.col("x.kb").bitwiseXOR(F.col("x.xb")).alias("pb"), "x.size", (F.col("short") & (F.col("x.pos") == F.col("m"))).alias("ends"))

    base = c.where("n > h").select("conv", "n", "h", "m", F.coalesce("z.ka", F.lit(0)).alias("za"), F.coalesce("z.kb", F.lit(0)).alias("zb"))
    own = sized_join(t, base, "conv").where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("m"))
    x = _digests(F.col("depth"), F.col("a"), F.col("b"))
    own = materialize(own.select("part", "conv", "depth", "size", (F.col("pos") == F.col("n")).alias("ends"), x[0].alias("xa"), x[1].alias("xb"), "za", "zb"))
    carry = _carried(own, [F.bit_xor("xa"), F.bit_xor("xb")], ["ca", "cb"])
    w = Window.partitionBy("part", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = own.join(F.broadcast(carry), ["part", "conv"], "left")
    key = lambda s: F.bit_xor(f"x{s}").over(w).bitwiseXOR(F.col(f"z{s}")).bitwiseXOR(F.coalesce(f"c{s}", F.lit(0))).alias(f"k{s}")
    own = own.select("conv", "depth", "size", "ends", "xa", "xb", key("a"), key("b"))
    own = own.select("conv", "depth", "ka", "kb", F.col("ka").bitwiseXOR(F.col("xa")).alias("pa"), F.col("kb").bitwiseXOR(F.col("xb")).alias("pb"), "size", "ends")
    return begins.unionByName(own), length


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive ids of one node, in texts of PART ids at most."""
    for b in batches:
        ka, kb, conv = (b.column(i).to_numpy() for i in range(3))
        if not len(conv):
            continue
        cut = np.flatnonzero((ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])) + 1
        edge = np.unique(np.concatenate([[0, len(conv)], cut, *(np.arange(i, j, PART) for i, j in zip([0, *cut], [*cut, len(conv)], strict=True))]))
        said = conv.astype(str)
        yield pa.RecordBatch.from_arrays([pa.array(ka[edge[:-1]]), pa.array(kb[edge[:-1]]), pa.array(conv[edge[:-1]]), pa.array([",".join(said[i:j]) for i, j in zip(edge, edge[1:])])], names=["ka", "kb", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each node, comma-joined, one after the other."""
    at, h = None, None
    for b in batches:
        out = []
        for ka, kb, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if at == (ka, kb):
                h.update(b"," + said.encode())
            else:
                if at is not None:
                    out.append((*at, h.hexdigest()))
                at, h = (ka, kb), hashlib.sha256(said.encode())
        yield pa.RecordBatch.from_pylist([{"ka": x, "kb": y, "ends_sha256": z} for x, y, z in out], _HASHED)
    if at is not None:
        yield pa.RecordBatch.from_pylist([{"ka": at[0], "kb": at[1], "ends_sha256": h.hexdigest()}], _HASHED)


_HASHED = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("ends_sha256", pa.string())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256) from (ka, kb, conv): SHA-256 of each node's ascending decimal ids, comma-joined.

    Ids are range-partitioned, so that a node of very many spreads over tasks, and joined to texts there; only these meet,
    in order, in one running hash for each node that has several.
    """
    o = ["ka", "kb", "conv"]
    parts = materialize(ends.repartitionByRange(*o).sortWithinPartitions(*o).mapInArrow(_joined_ids, "ka long, kb long, first long, ids string"))
    several = materialize(parts.groupBy("ka", "kb").count().where("count > 1").select("ka", "kb"))
    alone = sized_join(parts, several, ["ka", "kb"], "left_anti").select("ka", "kb", F.sha2("ids", 256).alias("ends_sha256"))
    rest = sized_join(parts, several, ["ka", "kb"], "left_semi").repartition("ka", "kb").sortWithinPartitions("ka", "kb", "first")
    return alone.union(rest.mapInArrow(_hashed, "ka long, kb long, ends_sha256 string"))


def roll_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(ka, kb, above, *values): sums of the values (longs) over each node's subtree, and ``label`` of its parent as above.

    nodes has (ka, kb, pa, pb, label, *values), pa and pb null for roots. After round k a node holds the sums over its
    descendants within 2^k - 1 steps and points 2^k steps up.
    """
    d, labelled = nodes.select("ka", "kb", "pa", "pb", "label", *values, F.lit(None).cast("long").alias("above")), True
    while True:
        given = d.where("pa is not null").groupBy("pa", "pb").agg(*(F.sum(v).alias(f"{v} more") for v in values)).select(F.col("pa").alias("ga"), F.col("pb").alias("gb"), *(f"{v} more" for v in values))
        hop = d.select(F.col("ka").alias("ha"), F.col("kb").alias("hb"), F.col("pa").alias("na"), F.col("pb").alias("nb"), F.col("label").alias("up"))
        out = d.join(given, (F.col("ka") == F.col("ga")) & (F.col("kb") == F.col("gb")), "left")
        out = out.select("ka", "kb", "pa", "pb", "label", "above", *((F.col(v) + F.coalesce(f"{v} more", F.lit(0))).alias(v) for v in values))
        out = out.join(hop, (F.col("pa") == F.col("ha")) & (F.col("pb") == F.col("hb")), "left")
        was, d = d, materialize(out.select("ka", "kb", F.col("na").alias("pa"), F.col("nb").alias("pb"), "label", *values, F.col("up" if labelled else "above").alias("above")))
        if not labelled:
            discard(was)
        labelled = False
        if d.where("pa is not null").isEmpty():
            return d.select("ka", "kb", "above", *values)


def prefix_trie(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node, and digest.

    turns: (conv_id, turn, role, text), other columns aren't read; null roles and texts are empty. conv_id is the smallest
    member, parent_conv_id null at the root, saved_tokens the bytes of a node's last text for each member but one, summed
    over its subtree; the digest of no ids is that of the empty text. No conversations: no rows, not even the root.
    """
    t = number_turns(turns)
    rows, length = rebuilt(t, family, most)
    rows = materialize(rows)
    n = rows.groupBy("ka", "kb").agg(F.min("conv").alias("label"), F.count(F.lit(1)).alias("n_convs"), F.max("depth").alias("depth"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("size").alias("size"))
    length = materialize(length)
    top = length.groupBy().agg(F.min("conv").alias("label"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = top.select(zero.alias("ka"), zero.alias("kb"), "label", "n_convs", zero.alias("depth"), none.alias("pa"), none.alias("pb"), zero.alias("size"))
    nodes = materialize(n.unionByName(top))
    below = nodes.where("pa is not null").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children")).select(F.col("pa").alias("ba"), F.col("pb").alias("bb"), "n_children")
    nodes = nodes.join(below, (F.col("ka") == F.col("ba")) & (F.col("kb") == F.col("bb")), "left").drop("ba", "bb")
    nodes = materialize(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    saved = (F.col("n_convs") - 1) * F.col("size")
    sums = roll_up(nodes.select("ka", "kb", "pa", "pb", "label", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), saved.alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = rows.where("ends").select("ka", "kb", "conv").union(length.where("length = 0").select(zero, zero, "conv"))
    d = nodes.join(sums, ["ka", "kb"]).join(end_digests(ends), ["ka", "kb"], "left")
    return d.select(F.col("label").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), F.concat(F.lower(F.lpad(F.hex("ka"), 16, "0")), F.lower(F.lpad(F.hex("kb"), 16, "0"))).alias("digest"))
