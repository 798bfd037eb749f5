"""Shared plumbing: scratch tables, streams of whole groups, hot keys, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a table of ids and small fields may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of its fields up to which such a table may be broadcast.
BROADCAST_BYTES = 32 * 2**20
#: Spark's own setting for the removal of a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This session's folder below ``spark.checkpoint.dir``; a folder of our own where that is unset in a local session, an error on a cluster."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = base or f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        _scratch[app] = f"{base.rstrip('/')}/docloom-{uuid.uuid4().hex}"
        atexit.register(_remove, weakref.ref(spark), _scratch[app])
    return _scratch[app]


def _remove(ref, path: str) -> None:
    spark = ref()
    if spark is None or spark._jsc is None or spark._jsc.sc().isStopped():
        return
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to a shared Parquet table and reads it: cuts the lineage and survives lost executors.

    The write's shuffle files go with its end, not with the driver's next garbage collection: nobody reads them again,
    and a chain of written tables would otherwise keep those of all its steps on the executors' disks.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    was = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() wrote, once all that is read from it has been written."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.startswith(scratch_dir(df.sparkSession)) or scratch_dir(df.sparkSession).split(":", 1)[-1].lstrip("/") in path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows and BROADCAST_BYTES; meant for written tables, which are read for it once more.

    Fields of fixed width count 8 bytes; texts, binaries and arrays are added up.
    """
    wide = [f for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct", "variant")]
    fixed = 8 * (len(df.columns) - len(wide))
    if not wide:
        return df.count() <= min(rows, BROADCAST_BYTES // max(1, fixed))
    size = {"string": F.octet_length, "binary": F.octet_length}
    own = sum((F.coalesce(size.get(f.dataType.typeName(), lambda c: F.octet_length(F.to_json(F.struct(c))))(column(f.name)), F.lit(0)) for f in wide), F.lit(fixed))
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(own), F.lit(0))).first()
    return n <= rows and b <= BROADCAST_BYTES


def sized_join(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins; broadcasts ``small`` only where its counted rows and bytes are within the bounds, else shuffles."""
    return big.join(F.broadcast(small) if small_enough(small, rows) else small, on, how)


def columns_of(batch) -> dict:
    return {n: batch.column(i) for i, n in enumerate(batch.schema.names)}


def texts(column) -> list[bytes]:
    """UTF-8 texts of an Arrow column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables that hold whole groups of consecutive equal keys, of about so many rows."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1])) if np.all(k[1:] >= k[:-1]) else int(np.flatnonzero(k != k[-1])[-1] + 1 if (k != k[-1]).any() else 0)
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            n = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def starts_of(k: np.ndarray) -> np.ndarray:
    """Where groups of consecutive equal values begin, with the end."""
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]) if len(k) else np.zeros(1, int)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links (a, b) reach."""
    r = np.arange(n)
    while len(a):
        lo = np.minimum(r[a], r[b])
        was = r.copy()
        np.minimum.at(r, a, lo)
        np.minimum.at(r, b, lo)
        np.minimum.at(r, was[a], lo)
        np.minimum.at(r, was[b], lo)
        r = r[r]
        if (r == was).all():
            break
    return r


def hot_keys(df: DataFrame, key: str, share: float, items: int) -> list:
    """Keys that may hold more than ``share`` of df's rows: at most ``items`` from a mergeable sketch over all rows.

    Only the plan depends on them: both ways of handling a key give the same rows.
    """
    row = df.agg(F.expr(f"approx_top_k({key}, {items}, {min(1_000_000, 16 * items)})").alias("k"), F.count(key).alias("n")).first()
    return [x["item"] for x in row["k"] or [] if x["count"] > share * row["n"]]


def pointed(low: DataFrame) -> DataFrame:
    """low (node, parent) with each node's root in place of its parent: pointers double until none moves."""
    while True:
        up = low.select(F.col("node").alias("n"), F.col("parent").alias("p"))
        far = sized_join(low, up.where("n <> p"), F.col("parent") == F.col("n"), "left")
        low = materialize(far.select("node", F.coalesce("p", "parent").alias("parent"), F.col("p").isNotNull().alias("moved")))
        if low.where("moved").isEmpty():
            return low.drop("moved")
        low = low.drop("moved")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), longs; a component is its smallest node.

    Each round points every node at its smallest neighbour, follows pointers to their roots by doubling, and replaces the
    ends of the edges by roots; edges within a root go. Minima are aggregated before the shuffle; ends meet their roots in
    joins that broadcast up to a counted bound, and that adaptive execution splits beyond.
    """
    told = lambda d: materialize(d.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e = told(edges.where("a is not null and b is not null"))
    steps = []
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = materialize(both.groupBy("node").agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("parent")))
        steps.append(pointed(low))
        to = lambda c: steps[-1].where("node <> parent").select(F.col("node").alias(f"{c} node"), F.col("parent").alias(f"{c} root"))
        e = sized_join(sized_join(e, to("a"), F.col("a") == F.col("a node"), "left"), to("b"), F.col("b") == F.col("b node"), "left")
        e = told(e.select(F.coalesce("a root", "a").alias("a"), F.coalesce("b root", "b").alias("b")))
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = steps[0]
    for s in steps[1:]:  # a root of one round is a node of the next
        s = s.where("node <> parent").select(F.col("node").alias("n"), F.col("parent").alias("p"))
        out = sized_join(out, s, F.col("parent") == F.col("n"), "left").select("node", F.coalesce("p", "parent").alias("parent"))
    return materialize(out.select("node", F.col("parent").alias("component")))


def fresh(name: str, taken: list[str]) -> str:
    """The name, with quotes added until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "'"
    return name


def column(name: str) -> Column:
    """A column by its whole name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of words, computed once; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes, width: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text in UTF-8, A-Z lower-cased; of all words where there are fewer."""
    w = word_hashes(text.lower().split(), cache)
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


class Recent(dict):
    """A cache in two generations: what was used since the last turn of generations outlives the next. Holds up to 2 * most."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
