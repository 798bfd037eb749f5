"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in an order shuffled by a hash, form blocks of ``block_rows``. The k-th block (from 0) of a source
whose share is w is released at floor(k / w) and due at ceil((k + 1) / w); in each slot the released block that is due
first goes, the tighter follower breaking ties. While the same sources have blocks, each prefix of t slots holds of each
source less than one block more or less than w * t. When a source runs out, which ends a phase, the others' shares are scaled up and
their windows start anew. All rows come exactly once.

With whole-number weights a phase's schedule repeats: a period has as many slots as the weights' sum (over their greatest
common divisor), in which each source has as many blocks as its weight. A task makes one period of each phase, or less where
the phase is shorter; a row finds its slot by its source and block. The earliest deadline first is a sequence, so that this
is one task's work for each phase, of a few microseconds a slot and of fixed memory, whatever the weights; the driver goes
through the last, broken period of each phase for the counts that the next one starts with. Ranks within a source come from a
range partitioning by source and hash, so that a hot source spreads over partitions.

Sources without a weight of their own have the weight ``other`` each. They are scheduled as one of their summed weight, inside
which they take turns, block by block in an order by hash, which keeps each within one block of its share, too, while all of
them have rows; one that runs out leaves its turns to the others of them. So what the driver plans is as long as the list of
weights, however many sources there are.

A null source is a source of its own. Rows that repeat an id and a source have a place each; weights must be whole numbers
above 0. Other columns are not read by mix_sources; mix_documents reads all of them, to tell rows of equal id and source
apart.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import islice
from math import gcd
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, VariantType

from docloom.llm.common import column, fresh, materialize, sized_join

#: Slots that a task hands on at once.
LOT = 50_000


def windows(share: int, total: int, k: int) -> tuple[int, int]:
    """Release and deadline of block k of a source that has share of total slots."""
    return k * total // share, -(-(k + 1) * total // share)


def earliest(shares: Mapping[int, int], slots: int) -> Iterator[tuple[int, int]]:
    """(source, block) of each slot: earliest deadline first among the released blocks."""
    total = sum(shares.values())
    waiting = [(0, i, 0) for i in shares]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (windows(shares[i], total, k)[1], windows(shares[i], total, k + 1)[1], i, k))
        *_, i, k = heapq.heappop(ready)  # shares that sum to 1 leave no slot empty
        yield i, k
        heapq.heappush(waiting, (windows(shares[i], total, k + 1)[0], i, k + 1))


class Phase(NamedTuple):
    """Slots in which the same sources take part: the first one, how many, and of each source its slots in a period, its blocks before the phase and after it."""

    slot: int
    slots: int
    shares: dict[int, int]
    before: dict[int, int]
    after: dict[int, int]


def phases(blocks: list[int], weights: list[int]) -> list[Phase]:
    """At most one for each source: it ends when the first source is due to have had all its blocks."""
    left, done, slot, out = {i: n for i, n in enumerate(blocks) if n}, [0] * len(blocks), 0, []
    while left:
        g = gcd(*(weights[i] for i in left))
        shares = {i: weights[i] // g for i in left}
        total = sum(shares.values())
        slots = min(-(-n * total // shares[i]) for i, n in left.items())
        had = {i: slots // total * n for i, n in shares.items()}
        for i, _ in earliest(shares, slots % total):
            had[i] += 1
        for i, n in left.items():
            if had[i] > n:  # the last slot's block isn't there any more
                had[i], slots = n, slots - 1
        out.append(Phase(slot, slots, shares, {i: done[i] for i in left}, {i: done[i] + had[i] for i in left}))
        slot += slots
        for i, n in had.items():
            done[i] += n
            left[i] -= n
        left = {i: n for i, n in left.items() if n}
    return out


def places(spark: SparkSession, plan: list[Phase]) -> DataFrame:
    """(phase, skey, nth, place) of the slots of one period of each phase, a task for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.column(0).to_pylist():
                slots, at = earliest(plan[f].shares, min(plan[f].slots, sum(plan[f].shares.values()))), 0
                while rows := list(islice(slots, LOT)):
                    cols = [pa.array(np.full(len(rows), f, np.int32)), pa.array([i for i, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.int64()), pa.array(np.arange(at, at + len(rows)))]
                    yield pa.RecordBatch.from_arrays(cols, names=["phase", "skey", "nth", "place"])
                    at += len(rows)

    return spark.range(0, len(plan), 1, max(1, len(plan))).mapInArrow(run, "phase int, skey int, nth long, place long")


def _numbered(d: DataFrame, *order) -> DataFrame:
    """d, range-partitioned and sorted, with ids ``at`` that count within partitions."""
    d = d.repartitionByRange(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return materialize(d.withColumn("at", F.monotonically_increasing_id()))


def _in_turns(d: DataFrame, seed: int, block_rows: int) -> DataFrame:
    """(doc_id, source, key, rank) ranked anew over all sources: their first blocks, their second blocks and so on."""
    d = d.withColumn("turn", F.floor(F.col("rank") / block_rows)).withColumn("place", F.xxhash64(F.lit(seed), "source"))
    d = _numbered(d, "turn", "place", F.col("source").asc_nulls_first(), "rank")
    part, shifts, before = F.shiftright("at", 33), [], 0
    for x in sorted(d.groupBy(part.alias("p")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect(), key=lambda x: x["p"]):  # one for each partition
        shifts.append((x["p"], before - x["first"]))
        before += x["n"]
    o = F.broadcast(d.sparkSession.createDataFrame(shifts, "p long, shift long"))
    return d.join(o, part == o.p).select(*carried(d), "key", (F.col("at") + F.col("shift")).alias("rank"))


def carried(d: DataFrame) -> list[str]:
    """The columns that name a row."""
    return [c for c in d.columns if c in ("doc_id", "source", "row")]


def mix_sources(docs: DataFrame, weights: Mapping[str | None, int], other: int = 1, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 32, seed: int = 9, row: Column | None = None) -> DataFrame:
    """(doc_id, source, slot, position) of each row: the block's place and the row's place in the mixture, from 0; with row also that column."""
    spark = docs.sparkSession
    if min([other, *weights.values()]) <= 0:
        raise ValueError("weights must be above 0")
    d = docs.select(column(id_col).cast("long").alias("doc_id"), column(source_col).cast("string").alias("source"), *([row.alias("row")] if row is not None else []))
    d = d.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    own = carried(d)
    d = _numbered(d, F.col("source").asc_nulls_first(), "h", *(c for c in own if c != "source"))
    part = F.shiftright("at", 33)
    runs = materialize(d.groupBy(part.alias("p"), "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))  # one for each partition, and one more for each source
    sources = materialize(runs.groupBy("source").agg(F.sum("n").alias("n")))
    own_weight = F.col("source").isin([s for s in weights if s is not None]) | (F.col("source").isNull() & F.lit(None in weights))
    count = {x["source"]: x["n"] for x in sources.where(own_weight).collect()}  # at most one for each weight
    names = sorted(count, key=lambda s: (s is not None, s or ""))
    others, rest = sources.where(~F.coalesce(own_weight, F.lit(False))).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts, share = [count[s] for s in names], [weights[s] for s in names]
    if others:
        counts.append(rest)
        share.append(other * others)
    # a source's rows in partitions before this one
    shift = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")
    o = materialize(runs.select("p", F.col("source").alias("osource"), shift.alias("shift")))
    keys = F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(names)], "ksource string, key int"))
    o = materialize(o.join(keys, o.osource.eqNullSafe(keys.ksource), "left").select("p", "osource", "shift", F.coalesce("key", F.lit(len(names))).alias("key")))
    d = sized_join(d, o, (part == o.p) & d.source.eqNullSafe(o.osource)).select(*own, "key", (F.col("at") + F.col("shift")).alias("rank"))
    if others > 1:
        d = materialize(d)
        d = d.where(F.col("key") < len(names)).union(_in_turns(d.where(F.col("key") == len(names)), seed, block_rows))
    plan = phases([-(-n // block_rows) for n in counts], share)
    at = materialize(places(spark, plan))
    # for each scheduled source at most as many rows as there are sources
    runs = [(f, i, p.before[i], p.after[i], p.slot, sum(p.shares.values()), n) for f, p in enumerate(plan) for i, n in p.shares.items()]
    r = spark.createDataFrame(runs, "rphase int, rkey int, lo long, hi long, first long, slots long, own long")

    def slotted(d: DataFrame) -> DataFrame:
        """d (key, block, ..) with slot."""
        d = d.join(F.broadcast(r), (F.col("key") == F.col("rkey")) & (F.col("block") >= F.col("lo")) & (F.col("block") < F.col("hi"))).withColumn("done", F.col("block") - F.col("lo"))
        d = sized_join(d, at, (F.col("rphase") == F.col("phase")) & (F.col("key") == F.col("skey")) & (F.col("done") % F.col("own") == F.col("nth")))
        return d.withColumn("slot", F.col("first") + F.floor(F.col("done") / F.col("own")) * F.col("slots") + F.col("place"))

    # of each scheduled source the last block may be short: rows are missing after it
    ends = spark.createDataFrame([(i, (n - 1) // block_rows, -n % block_rows) for i, n in enumerate(counts) if n % block_rows], "key int, block long, missing long")
    short = slotted(ends).select("slot", "missing").collect()  # at most one for each weight
    d = slotted(d.withColumn("block", F.floor(F.col("rank") / block_rows)))
    gone = F.lit(0).cast("long")
    if short:
        each = F.array(*(F.struct(F.lit(x["slot"]).cast("long").alias("slot"), F.lit(x["missing"]).cast("long").alias("n")) for x in short))
        gone = F.aggregate(F.filter(each, lambda x: x["slot"] < F.col("slot")), gone, lambda s, x: s + x["n"])
    return d.select(*own, "slot", (F.col("slot") * block_rows + F.col("rank") % block_rows - gone).alias("position"))


def _comparable(t: DataType) -> bool:
    inner = [f.dataType for f in t.fields] if hasattr(t, "fields") else [t.elementType] if hasattr(t, "elementType") else []
    return not isinstance(t, (MapType, VariantType)) and all(map(_comparable, inner))


def mix_documents(docs: DataFrame, weights: Mapping[str | None, int], other: int = 1, id_col: str = "doc_id", source_col: str = "source", **more) -> DataFrame:
    """All rows and columns of docs, range-partitioned and sorted by their place in the mixture."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.xxhash64(*(column(f.name) if _comparable(f.dataType) else F.to_json(F.struct(column(f.name))) for f in docs.schema.fields))
    m = mix_sources(docs, weights, other, id_col, source_col, row=row, **more)
    taken = list(docs.columns)
    names = [fresh(n, taken) for n in ("mixed id", "mixed source", "mixed row")]
    place = fresh("mixed position", taken)
    m = materialize(m.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "source", "row"), names, strict=True)), F.col("position").alias(place)))
    is_row = lambda of: column(id_col).cast("long").eqNullSafe(of[0]) & column(source_col).cast("string").eqNullSafe(of[1]) & (row == of[2])
    several = materialize(m.groupBy(*map(column, names)).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*(column(n).alias(f"several {n}") for n in names)))
    of, on = [column(f"several {n}") for n in names], [column(n) for n in names]
    same = reduce(Column.__and__, (a.eqNullSafe(b) for a, b in zip(on, of, strict=True)))
    if several.isEmpty():
        placed = sized_join(docs, m, is_row(on))
    else:  # equal rows: one of them takes all their places
        whole = F.struct(*(column(c) for c in docs.columns))
        one = sized_join(docs, several, is_row(of), "left_semi").groupBy(column(id_col).cast("long").alias("one id"), column(source_col).cast("string").alias("one source"), row.alias("one row")).agg(F.first(whole).alias("whole"))
        again = sized_join(m, several, same, "left_semi")
        again = again.join(one, on[0].eqNullSafe(one["one id"]) & on[1].eqNullSafe(one["one source"]) & (on[2] == one["one row"])).select("whole.*", column(place))
        once = sized_join(sized_join(docs, several, is_row(of), "left_anti"), sized_join(m, several, same, "left_anti"), is_row(on))
        placed = once.select(*(column(c) for c in docs.columns), column(place)).union(again)
    return placed.repartitionByRange(parts, column(place)).sortWithinPartitions(column(place)).select(*(column(c) for c in docs.columns))


def written_places(docs: DataFrame, place_col: str) -> DataFrame:
    """docs, as read from the Parquet files of mix_documents, with each row's place in the mixture, from 0.

    A reader packs files into partitions by size, so that the order of what it returns isn't that of the mixture: the
    place is the row's in its file, after all rows of the files written by earlier partitions.
    """
    files = docs.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).collect()  # one for each file
    before, at = [], 0
    for x in sorted(files, key=lambda x: (int(x["name"].split("-")[1]), len(x["name"]), x["name"])):
        before.append((x["name"], at))
        at += x["n"]
    file, was, own, nth = (fresh(n, docs.columns) for n in ("mixed file", "mixed before", "in file", "in row"))
    b = F.broadcast(docs.sparkSession.createDataFrame(before, f"`{file}` string, `{was}` long"))
    d = docs.select("*", F.col("_metadata.file_name").alias(own), F.col("_metadata.row_index").alias(nth))
    return d.join(b, column(own) == column(file)).select(*(column(c) for c in docs.columns), (column(was) + column(nth)).alias(place_col))
