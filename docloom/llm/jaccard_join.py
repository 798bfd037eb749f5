"""N-gram Jaccard join: exact components of documents whose word-shingle sets reach a similarity.

The Jaccard distance is a metric, but distances of unrelated texts to any document are all close to 1, so that regions
around documents alone would put nearly every text on every boundary. Two kinds of pivots are used:

1. Reference sets. A hash deals the shingle universe into m slices; a document's part of a slice names its region there.
   Sets that differ in at most D shingles disagree in at most D slices, so with m > D each linked pair shares a region.
   m grows with the set size in steps; a document enters the regions of each step that a partner may use (the window
   of sizes by the triangle inequality with the empty set). Slices that are empty don't count: m has slack for them,
   and documents with more empty slices than the slack also meet each other in regions of empty slices.
   Of its slices a document enters the D + 1 rarest only, in one order of all slices: of the slices in which a linked
   pair agrees, the first in that order has at most D others before it in either set. So parts that very many documents
   share name no region of those that have enough of their own.
   Within a region the distances to further reference sets (counts of shingles by hash, one for about 16 shingles and
   64 at least) bound the difference of two sets from below; pairs beyond the bound are dropped, and what hangs together
   goes on as one region, a cell. A region of more than SIG_LEAF sets goes on whole.
2. Documents. A cell of more than LEAF sets chooses up to PIVOTS of them. Each member computes its distances to them:
   within the threshold it is linked, and all known to hang together carry one tag; only sets of equal tags are settled
   against each other. Members form Voronoi regions around their nearest pivots; those without the cell's most frequent
   tag are replicated to each region j with d(x, pivot j) <= d(x, nearest) + 2 r, which by the triangle inequality meets
   all partners of other tags. Regions join recursively, until they hold one tag. Where the windows save little, the
   members are dealt into blocks, and each pair of blocks that isn't settled is one group of a shuffle. Rounds carry ids;
   sets are joined where they are compared, by products of 0/1 matrices over the shingles that a group shares.

Equal sets are one class throughout. No list of pairs is made: tasks return spanning links. A row's set comes from its
whole text; null or blank texts have the empty set and link with nothing. Rows that share a doc_id are one document
with the links of all of them; a row with a null doc_id links with nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_ROWS, column, connected_components, discard, fresh, materialize, mix, roots, shingles, sized_join, starts_of, texts, whole_groups, WordHash

LEAF, SIG_LEAF, BUCKETS = 256, 128, 64
PIVOTS, LEAST_PIVOTS = 512, 64
#: Members and shingles of a block. A task holds the sets of two.
BLOCK, MOST_BLOCK, ELEMENTS = 256, 1024, 1_000_000
#: Parts of the names of regions that are counted apart.
SLICES = 4
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Plan:
    """Slice counts for a threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.steps = [2]
        while self.steps[-1] < 10**7:
            self.steps.append(max(self.steps[-1] + 1, self.steps[-1] * 5 // 4))
        self.least: dict[int, int] = {}

    def differ(self, a: int, b: int) -> int:
        """Most shingles in which linked sets of these sizes differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def most(self, a: int) -> int:
        """The same for a set of size a and any larger partner."""
        return self.differ(a, a * self.den // self.num)

    def step(self, a: int) -> int:
        """Index of the slice count of pairs whose smaller set has size a; -1 if only equal sets link."""
        d = self.most(a)
        return -1 if d == 0 else int(np.searchsorted(self.steps, max(d + 2, -(-(d + 1) * 6 // 5))))

    def window(self, n: int) -> list[int]:
        """Slice counts that a set of size n uses."""
        lo, hi = self.step(-(-n * self.num // self.den)), self.step(n)
        return [self.steps[k] for k in range(max(0, lo), hi + 1)]

    def slack(self, m: int) -> int:
        """Empty slices that a linked pair may have at m, and still agree in one that isn't."""
        if m not in self.least:
            k, lo, hi = self.steps.index(m), 1, 2
            while self.step(hi) <= k:
                hi *= 2
            while lo < hi:  # the first size beyond this step
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if self.step(mid) <= k else (lo, mid)
            self.least[m] = m - self.most(lo - 1) - 1
        return self.least[m]


@cache
def plan(num: int, den: int) -> Plan:
    return Plan(num, den)


def signatures(s: np.ndarray, p: Plan) -> list[tuple[int, np.ndarray]]:
    """Names of the regions of a set of sorted distinct hashes, by step; with each, how many of the commonest may go."""
    own = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + _GOLD))])
    out = []
    for m in p.window(len(s)):
        edge = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(s, edge), [len(s)]])
        size = np.diff(at).astype(np.uint64)
        part = own[at[1:]] - own[at[:-1]]
        sig = mix(mix(part + size * _GOLD) + np.arange(m, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(m))
        full, needed = size > 0, m - p.slack(m)  # D + 1
        for x in (sig[full], sig[~full] if m - full.sum() > p.slack(m) else sig[:0]):
            if len(x):
                out.append((max(0, len(x) - needed), x))
    return out


def buckets(s: np.ndarray) -> bytes:
    """Counts of the set's shingles in parts of the universe, up to 255: each changes by at most what the sets differ.

    Neighbours added up are the counts in half as many parts, so that sets of unlike sizes compare.
    """
    bits = 6
    while len(s) > 16 << bits:
        bits += 1
    c = np.bincount((mix(s) >> np.uint64(64 - bits)).astype(int), minlength=1 << bits)
    return np.minimum(c, 255).astype(np.uint8).tobytes()


def sketch(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc, n, h1, h2, steps, vec) of each row of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_, p = WordHash(), plan(num, den)
        ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            rows = [shingles(t, width, cache_) for t in texts(b.column(1))]
            sigs = [signatures(s, p) for s in rows]
            h1 = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in rows], np.uint64).view(np.int64)
            h2 = np.array([np.add.reduce(mix(s + _GOLD)) if len(s) else 0 for s in rows], np.uint64).view(np.int64)
            each = [x for row in sigs for x in row]
            flat = np.concatenate([x for _, x in each]).view(np.int64) if each else np.zeros(0, np.int64)
            step = pa.StructArray.from_arrays([pa.array([k for k, _ in each], pa.int32()), pa.ListArray.from_arrays(ends([len(x) for _, x in each]), pa.array(flat))], ["spare", "sigs"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in rows], pa.int32()), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(ends([len(x) for x in sigs]), step), pa.array([buckets(s) for s in rows], pa.binary())], names=["doc", "n", "h1", "h2", "steps", "vec"])

    return docs.mapInArrow(run, "doc long, n int, h1 long, h2 long, steps array<struct<spare: int, sigs: array<long>>>, vec binary")


def _pairs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within groups, by group size."""
    size = np.diff(starts)
    i, j = [], []
    for g in np.unique(size[size > 1]):
        a, b = np.triu_indices(g, 1)
        at = starts[:-1][size == g][:, None]
        i.append((at + a).ravel())
        j.append((at + b).ravel())
    return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, int), np.zeros(0, int))


def _arrow(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns.values()], names=list(columns))


def _apart(vec: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lower bounds of the differences of pairs of sets, by their counts in parts."""
    size = np.array([len(v) for v in vec])
    level, out = np.minimum(size[i], size[j]), np.zeros(len(i), np.int64)
    for n in np.unique(level):
        these = np.flatnonzero(level == n)
        used = np.unique(np.concatenate([i[these], j[these]]))
        counts = np.stack([np.frombuffer(vec[k], np.uint8).reshape(n, -1).sum(1, dtype=np.int16) for k in used])
        for k in range(0, len(these), chunk := max(1, 8_000_000 // int(n))):
            x = these[k : k + chunk]
            out[x] = np.abs(counts[np.searchsorted(used, i[x])] - counts[np.searchsorted(used, j[x])]).sum(1, dtype=np.int64)
    return out


def _region_links(num: int, den: int):
    """Of (region, rep, n, vec) sorted by region: (a, b) that hang together in a region by the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "region", 4_000):
            region, rep, n = (t.column(k).to_numpy() for k in ("region", "rep", "n"))
            i, j = _pairs(starts_of(region))
            lo, hi = np.minimum(n[i], n[j]).astype(np.int64), np.maximum(n[i], n[j]).astype(np.int64)
            ok = (lo * den >= hi * num) & (rep[i] != rep[j])
            i, j, lo, hi = i[ok], j[ok], lo[ok], hi[ok]
            ok = _apart(t.column("vec").to_pylist(), i, j) <= (den - num) * (lo + hi) // (den + num)
            root = roots(len(rep), i[ok], j[ok])
            a = np.flatnonzero(root != np.arange(len(rep)))
            links = np.unique(np.stack([rep[a], rep[root[a]]], 1), axis=0)
            yield _arrow(a=links[:, 0].copy(), b=links[:, 1].copy())

    return run


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each set of b.

    Shingles in few sets are joined by their places, the others make columns of 0/1 matrices, a chunk at a time.
    """
    na, nb = len(a), len(b)
    out = np.zeros((na, nb), np.float32)
    sets = [*a, *b]
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(na + nb), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]  # of one shingle, those of a first
    if not len(flat):
        return out
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    name = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    ca = np.bincount(name, owner < na, len(first)).astype(int)
    cb = np.diff(np.append(first, len(flat))) - ca
    rare = (ca > 0) & (cb > 0) & (ca * cb <= max(16, na * nb // 128))
    at = np.flatnonzero(rare[name] & (owner < na))
    times = cb[name[at]]
    step = 4_000_000
    ends = np.cumsum(times)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, step):  # pairs of places, some millions at a time
        s, e = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, lo + step, "right")
        x, k = at[s:e], times[s:e]
        if len(x):
            within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            right = np.repeat(first[name[x]] + ca[name[x]], k) + within
            out += np.bincount(np.repeat(owner[x], k) * nb + owner[right] - na, minlength=na * nb).reshape(na, nb)
    dense = np.flatnonzero((ca > 0) & (cb > 0) & ~rare)
    column = np.full(len(first), -1)
    column[dense] = np.arange(len(dense))
    c = column[name]
    for lo in range(0, len(dense), 4096):
        here = (c >= lo) & (c < lo + 4096)
        m = np.zeros((na + nb, min(4096, len(dense) - lo)), np.float32)
        m[owner[here], c[here] - lo] = 1
        out += m[:na] @ m[na:].T
    return out


def _near(a: list[np.ndarray], b: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a's sets are linked with which of b's, and their distances."""
    both = overlaps(a, b).astype(np.int64)
    union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b]) - both
    return den * both >= num * union, 1 - both / np.maximum(union, 1)


def linked_in(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of some sets."""
    root = roots(len(sets), *np.nonzero(np.triu(_near(sets, sets, num, den)[0], 1)))
    a = np.flatnonzero(root != np.arange(len(sets)))
    return a, root[a]


def _leaf_links(num: int, den: int):
    """Of (cell, rep, set) sorted by cell: links (a, b) that span each cell's components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cell", 500):
            rep, sets, starts = t.column("rep").to_numpy(), _sets(t.column("set")), starts_of(t.column("cell").to_numpy())
            a, b = [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s > 1:
                    i, j = linked_in(sets[s:e], num, den)
                    a.append(rep[s + i])
                    b.append(rep[s + j])
            none = [np.zeros(0, np.int64)]
            yield _arrow(a=np.concatenate(a or none), b=np.concatenate(b or none))

    return run


def _block_links(num: int, den: int):
    """Of (group, right, rep, set) sorted by group: links (a, b) that span what hangs together between a group's two blocks; within the block where it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "group", 1):
            group, right, rep = (t.column(k).to_numpy() for k in ("group", "right", "rep"))
            starts = starts_of(group)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                sets, m = _sets(t.column("set").slice(s, e - s)), s + int((right[s:e] == 0).sum())
                if m == e:
                    i, j = linked_in(sets, num, den)
                elif m == s:
                    continue
                else:
                    x, y = np.nonzero(_near(sets[: m - s], sets[m - s :], num, den)[0])
                    root = roots(e - s, x, y + m - s)
                    i = np.flatnonzero(root != np.arange(e - s))
                    j = root[i]
                yield _arrow(a=rep[s + i], b=rep[s + j])

    return run


_ROUND = "cell long, rep long, tag long, n long, pivot boolean, links array<long>, home long, near array<long>"


def _pivot_round(num: int, den: int):
    """Of (group, cell, kind, rep, tag, n, set) sorted by group and kind (0: the pivots): each member's links to pivots, its region and its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "group", 1):
            group, cell, kind, rep, tag, n = (t.column(k).to_numpy() for k in ("group", "cell", "kind", "rep", "tag", "n"))
            starts = starts_of(group)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                p = s + int((kind[s:e] == 0).sum())
                if p == s or p == e:
                    continue
                sets, pivots, seen = _sets(t.column("set").slice(s, e - s)), rep[s:p], set()
                linked, d = _near(sets[p - s :], sets[: p - s], num, den)
                home = d.argmin(1)
                window = d <= d.min(1)[:, None] + 2 * (1 - num / den) + 1e-9
                links, near = [], []
                for i in range(e - p):
                    mine = np.sort(pivots[linked[i]]).tolist()
                    links.append([x for x in mine if x == mine[0] or (mine[0], x) not in seen])
                    seen.update((mine[0], x) for x in mine)
                    near.append(pivots[window[i]])
                ids = pa.list_(pa.int64())
                yield _arrow(cell=cell[p:e], rep=rep[p:e], tag=tag[p:e], n=n[p:e], pivot=np.isin(rep[p:e], pivots), links=pa.array(links, ids), home=pivots[home], near=pa.array(near, ids))

    return run


def _tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (cell, low, others) sorted by cell: the tag of each pivot and each former tag (tcell, node, new), the smallest of its component."""
    for t in whole_groups(batches, "cell"):
        cell, low, others = (t.column(c).to_pylist() for c in ("cell", "low", "others"))
        out_cell, out_node, out_new = [], [], []
        starts = starts_of(t.column("cell").to_numpy())
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            nodes = sorted({*low[s:e], *(y for x in others[s:e] for y in x)})
            index = {x: i for i, x in enumerate(nodes)}
            a = np.array([index[low[i]] for i in range(s, e) for _ in others[i]])
            b = np.array([index[y] for x in others[s:e] for y in x])
            out_cell += [cell[s]] * len(nodes)
            out_node += nodes
            out_new += [nodes[r] for r in roots(len(nodes), a, b)]
        yield _arrow(tcell=np.array(out_cell, np.int64), node=np.array(out_node, np.int64), new=np.array(out_new, np.int64))


def _tasks(df: DataFrame) -> int:
    """Partitions of a shuffle whose work isn't in proportion to its bytes: a stated number isn't coalesced."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _leaf(cells: DataFrame, num: int, den: int) -> DataFrame:
    """Links within the small cells of (cell, rep, set)."""
    return cells.select("cell", "rep", "set").repartition(_tasks(cells), "cell").sortWithinPartitions("cell", "rep").mapInArrow(_leaf_links(num, den), "a long, b long")


def _with_sets(ids: DataFrame, sets: DataFrame) -> DataFrame:
    return sized_join(sets.select(F.col("rep").alias("of"), "set"), ids, F.col("of") == F.col("rep")).drop("of")


def _blocks(ids: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links within cells of ids (cell, rep, top, members, others, elements): each pair of blocks but those of one tag."""
    few = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_BLOCK), F.col("members") / 16))  # members of a block
    per = F.greatest(F.lit(1), F.least(few, F.col("members") * ELEMENTS / F.col("elements")))
    mine, rest = F.ceil(F.col("others") / per).cast("int"), F.ceil((F.col("members") - F.col("others")) / per).cast("int")
    h = F.xxhash64(F.lit("block"), "rep")
    d = ids.withColumn("mine", mine).withColumn("rest", rest)
    d = d.withColumn("i", F.when(F.col("top"), F.col("mine") + F.pmod(h, F.col("rest"))).otherwise(F.pmod(h, F.col("mine"))).cast("int"))
    last = F.when(F.col("top"), F.col("mine")).otherwise(F.col("mine") + F.col("rest")) - 1
    d = d.select("cell", "rep", "i", F.explode(F.sequence(F.lit(0), last)).alias("j"))
    d = d.select(F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")).alias("group"), (F.col("i") > F.col("j")).cast("int").alias("right"), "rep")
    d = _with_sets(materialize(d), sets).repartition(_tasks(sets), "group").sortWithinPartitions("group", "right", "rep")
    return d.select("group", "right", "rep", "set").mapInArrow(_block_links(num, den), "a long, b long")


def _big_cells(ids: DataFrame, sets: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Links within cells, a written table (cell, rep, tag, n) of ids, round by round.

    A tag is the id of a set of the same component: at first a set's own, later that of a pivot, which has left the cell.
    """
    found, small = [], (F.col("members") <= LEAF) & (F.col("elements") <= 2 * ELEMENTS)
    while True:
        per = ids.groupBy("cell", "tag").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("e"))
        per = per.groupBy(F.col("cell").alias("c")).agg(F.sum("k").alias("members"), F.sum("e").alias("elements"), F.max("k").alias("most"), F.max_by("tag", F.struct("k", "tag")).alias("toptag"))
        per = materialize(per.where("most < members").withColumn("others", F.col("members") - F.col("most")))
        if per.isEmpty():
            return found
        ids = materialize(sized_join(ids, per, F.col("cell") == F.col("c")).withColumn("top", F.col("tag") == F.col("toptag")).drop("c", "most", "toptag"))
        if not per.where(small).isEmpty():
            found.append(materialize(_leaf(_with_sets(ids.where(small), sets), num, den)))
        big = ids.where(~small)
        if per.where(~small).isEmpty():
            return found
        h = F.xxhash64(F.lit("pivot"), "rep")
        many = F.greatest(F.lit(LEAST_PIVOTS), F.least(F.lit(PIVOTS), F.sqrt("members"))).cast("int")
        chosen = big.where("not top").groupBy("cell", F.pmod(h, many).alias("k")).agg(F.min_by("rep", h).alias("rep"))
        chosen = materialize(chosen.select(F.col("cell").alias("pcell"), F.col("rep").alias("prep")))
        pivots = sized_join(big, chosen, (F.col("cell") == F.col("pcell")) & (F.col("rep") == F.col("prep")), "left_semi")
        blocks = F.greatest(F.ceil(F.col("members") / (2 * BLOCK)), F.ceil(F.col("elements") / ELEMENTS)).cast("int")
        pivots = pivots.select("cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(0).alias("kind"), "rep", "tag", F.col("n").cast("long").alias("n"))
        members = big.select("cell", F.pmod(F.xxhash64("rep", F.lit(1)), blocks).cast("int").alias("block"), F.lit(1).alias("kind"), "rep", "tag", F.col("n").cast("long").alias("n"))
        rows = materialize(pivots.unionByName(members).withColumn("group", F.xxhash64("cell", "block")))
        rows = _with_sets(rows, sets).repartition(_tasks(sets), "group").sortWithinPartitions("group", "kind", "rep")
        done = materialize(rows.select("group", "cell", "kind", "rep", "tag", "n", "set").mapInArrow(_pivot_round(num, den), _ROUND))
        linked = done.where(F.size("links") > 0).select("cell", "rep", "tag", F.array_min("links").alias("low"), "links")
        ends = F.when(F.col("tag") == F.col("rep"), F.col("links")).otherwise(F.array_append("links", F.col("tag")))  # pivots and former tags only
        pairs = linked.select("cell", "low", F.explode(ends).alias("b")).distinct()
        pairs = materialize(pairs.groupBy("cell", "low").agg(F.collect_list("b").alias("others")))  # at most as many as pivots so far
        found.append(materialize(linked.select(F.col("rep").alias("a"), F.col("low").alias("b")).union(pairs.select(F.col("low").alias("a"), F.explode("others").alias("b"))).where("a <> b")))
        tags = materialize(pairs.repartition(_tasks(ids), "cell").sortWithinPartitions("cell").mapInArrow(_tags, "tcell long, node long, new long"))
        known = F.coalesce(F.array_min("links"), "tag")
        state = sized_join(done.where("not pivot"), tags, (F.col("cell") == F.col("tcell")) & (known == F.col("node")), "left")
        state = materialize(state.select("cell", "rep", "n", F.coalesce("new", "tag").alias("tag"), "home", "near"))
        # a cell is split where comparing its regions is clearly less work than comparing its members
        tops = state.groupBy("cell", "tag").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("e"))
        tops = tops.groupBy(F.col("cell").alias("gcell")).agg(F.sum("k").alias("members"), F.sum("e").alias("elements"), F.max(F.struct("k", "tag")).alias("best")).where("best.k < members")
        tops = materialize(tops.select("gcell", "members", "elements", F.col("best.tag").alias("gtop"), (F.col("members") - F.col("best.k")).alias("others")))
        state = sized_join(state, tops, F.col("cell") == F.col("gcell")).drop("gcell").withColumn("top", F.col("tag") == F.col("gtop"))
        goes = F.when(F.col("top"), F.array("home")).otherwise(F.array_union(F.array("home"), "near"))
        split = state.select("cell", "rep", "tag", "n", "top", F.explode(goes).alias("to"))
        work = split.groupBy("cell", "to").agg(F.count(F.lit(1)).cast("double").alias("k"), F.count_if(~F.col("top")).alias("o"))
        work = materialize(work.groupBy(F.col("cell").alias("wcell")).agg(F.sum(F.col("k") * F.col("o")).alias("work")))
        # regions of at most half the work; each round halves it, or ends in blocks
        gain = materialize(sized_join(work, tops, F.col("wcell") == F.col("gcell")).select("wcell", (2 * F.col("work") <= F.col("members") * F.col("others")).alias("split")))
        if not gain.where("not split").isEmpty():
            whole = sized_join(state, gain.where("not split"), F.col("cell") == F.col("wcell"), "left_semi")
            found.append(materialize(_blocks(whole.select("cell", "rep", "top", "members", "others", "elements"), sets, num, den)))
        if gain.where("split").isEmpty():
            return found
        ids = sized_join(split, gain.where("split"), F.col("cell") == F.col("wcell"), "left_semi").select(F.xxhash64("cell", "to").alias("cell"), "rep", "tag", "n")
        ids = materialize(ids)


def _shared(each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written (s, k), the regions of each (.., rep, sig) that hold several sets and their rows, and each's rows in them.

    Nearly all names occur once, so that a task's table of counts holds as many as it reads: one part of the names follows
    the other, and reads its rows anew.
    """
    names, rows = [], []
    for i in range(SLICES):
        own = each.where(F.pmod("sig", F.lit(SLICES)) == i)
        n = own.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
        names.append(materialize(n.select(F.col("sig").alias("s"), "k")))
        # most regions hold one set only: they go before anything else is joined; one long a row is broadcast
        rows.append(materialize(sized_join(own, names[-1].select("s"), F.col("sig") == F.col("s"), "left_semi", BROADCAST_ROWS)))
    return reduce(DataFrame.union, names), reduce(DataFrame.union, rows)


def jaccard_components(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: documents hang together by links of similarity num/den or more."""
    if not 0 < num <= den:
        raise ValueError("the similarity must be above 0 and at most 1")
    d = docs.select(column(id_col).cast("long").alias("doc"), column(text_col).alias("text"))
    full = materialize(sketch(d, width, num, den))
    s = materialize(full.select("doc", "n", "h1", "h2"))
    usable = s.where("n > 0 and doc is not null")
    # one representative for each set; hot sets are reduced before the shuffle
    classes = materialize(usable.groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep")))
    mine = F.struct("h1", "h2", "n")
    mine_only = sized_join(full.where("n > 0 and doc is not null"), classes.select(F.col("rep"), F.struct("h1", "h2", "n").alias("c")), (F.col("doc") == F.col("rep")) & (mine == F.col("c")))
    reps = materialize(mine_only.select("rep", "n", "vec").distinct())
    each = mine_only.select("rep", F.posexplode("steps").alias("step", "x")).select("rep", "step", "x.spare", F.explode("x.sigs").alias("sig"))
    shared, each = _shared(each)
    discard(full)  # nothing that follows reads it
    # of each step's regions the commonest go, as many as its spare; those that were of one set came first in the order
    rank = F.row_number().over(Window.partitionBy("rep", "step").orderBy(F.desc("k"), F.desc("sig")))
    each = sized_join(each, shared, F.col("sig") == F.col("s")).withColumn("nth", rank).where("nth > spare").select("sig", "rep", "k")
    each = materialize(each)
    members = lambda d: d.groupBy("sig").agg(F.array_sort(F.collect_set("rep")).alias("reps")).where(F.size("reps") > 1).select("reps")  # noqa: E731  # at most SIG_LEAF
    few, many = members(each.where(F.col("k") <= SIG_LEAF)), None
    hot = each.where(F.col("k") > SIG_LEAF)
    if not hot.isEmpty():
        left = materialize(hot.groupBy(F.col("sig").alias("s")).agg(F.count(F.lit(1)).alias("left"), F.min("rep").alias("low")))
        hot = sized_join(hot, left, F.col("sig") == F.col("s"))
        few = few.union(members(hot.where(F.col("left") <= SIG_LEAF)))
        many = hot.where(F.col("left") > SIG_LEAF).select(F.col("rep").alias("a"), F.col("low").alias("b"))
    few = few.distinct()  # regions of the same sets are one: near copies share hundreds
    few = few.select(F.xxhash64("reps").alias("region"), F.explode("reps").alias("r"))
    few = sized_join(few, reps, F.col("r") == F.col("rep")).select("region", "rep", "n", "vec")
    few = few.repartition(_tasks(d), "region").sortWithinPartitions("region", "rep").mapInArrow(_region_links(num, den), "a long, b long")
    regions = connected_components(few if many is None else few.union(many))
    regions = sized_join(regions, reps.select("rep", "n"), F.col("node") == F.col("rep")).groupBy(F.col("component").alias("cell"), "rep").agg(F.max("n").alias("n"))
    regions = materialize(regions)
    sizes = materialize(regions.groupBy(F.col("cell").alias("c")).agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("elements")))
    small = (F.col("members") <= LEAF) & (F.col("elements") <= 2 * ELEMENTS)
    regions = materialize(sized_join(regions, sizes, F.col("cell") == F.col("c")).select("cell", "rep", "n", small.alias("small")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_ = WordHash()
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingles(t, width, cache_).tobytes() for t in texts(b.column(2))], pa.binary())], names=["cell", "rep", "set"])

    def cells(of: str) -> DataFrame:
        rows = sized_join(d.where("doc is not null"), regions.where(of), F.col("doc") == F.col("rep")).select("cell", "rep", "text")
        return rows.mapInArrow(whole, "cell long, rep long, set binary").where(F.octet_length("set") > 0)

    links = [materialize(_leaf(cells("small"), num, den))]
    if not sizes.where(~small).isEmpty():
        ids = regions.where("not small").select("cell", "rep", F.col("rep").alias("tag"), "n")
        links += _big_cells(ids, materialize(cells("not small").select("rep", "set").distinct()), num, den)
    every = links[0]
    for x in links[1:]:
        every = every.union(x)
    # documents of several rows tie their classes together
    ties = materialize(usable.groupBy("doc").agg(F.min(mine).alias("first"), F.max(mine).alias("last")).where("first <> last").select("doc"))
    if not ties.isEmpty():
        own = classes.select(F.col("rep").alias("b"), mine.alias("c"))
        several = usable.join(ties.select(F.col("doc").alias("t")), F.col("doc") == F.col("t"), "left_semi")
        every = every.union(several.join(own, mine == F.col("c")).select(F.col("doc").alias("a"), "b"))
    comps = connected_components(every)
    classes = sized_join(classes, comps, F.col("rep") == F.col("node"), "left").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("n").alias("gn"), F.coalesce("component", "rep").alias("component"))
    out = sized_join(s.select("doc", "n", "h1", "h2"), materialize(classes), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("n") == F.col("gn")) & F.col("doc").isNotNull(), "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def keep_one(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those linked, directly or not, to a document of smaller id; rows without an id stay."""
    gone = materialize(jaccard_components(docs, num, den, width, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias(fresh("near copy", docs.columns))).distinct())
    return sized_join(docs, gone, column(id_col).cast("long") == column(gone.columns[0]), "left_anti")
