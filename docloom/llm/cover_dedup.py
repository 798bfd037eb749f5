"""Embedding near-dedup by dual traversal of cover trees.

Equal vectors of a label are first reduced to one with a count. The top level of a label's tree is a net of pivots, one for
about half a block of vectors: each vector goes to the region of its nearest pivot, whose covering radius is the largest
distance within. A vector also visits another region only if it could have a partner there: if its distance to that
pivot is at most its own to its nearest pivot and twice the threshold distance, and at most the region's radius and the
threshold distance. Each region (its residents, and visitors from regions of lower number) is joined by blocks: a cover
tree over each block (nested nets whose radii halve) and a traversal of node pairs, which drops pairs whose centres lie
further apart than both covering radii and the threshold distance. Pairs that remain are decided by their cosine in
double precision. A task returns sums and a spanning set of links, not pairs. The threshold join is exact; where vectors
aren't clustered, no metric bound prunes, and its work grows with the square of a label's distinct vectors, shared
evenly between tasks.

Vectors that are null, zero or hold null or non-finite components, or whose label or id is null, link with nothing, as do
vectors of unlike length. Equal vectors under different ids link; rows that repeat an id count as vectors of their own.
"""

from __future__ import annotations

from math import fsum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import column, connected_components, materialize, roots, sized_join

LEAF = 128
AT_ONCE = 2048
MOST_PIVOTS = 4096


class CoverTree:
    """Nodes by index: centre, covering radius, and children or points."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        if len(x):
            todo = [(self._node(0, np.arange(len(x))), 2.0)]
            while todo:
                node, r = todo.pop()
                points = self.points[node]
                if len(points) <= LEAF or self.radius[node] < 1e-6:
                    continue
                r = min(r, self.radius[node])
                net = self._net(points, self.centre[node], r / 2)
                if 2 * len(net) > len(points):  # so far apart that smaller nodes would hold hardly more than a point each
                    continue
                for centre, own, radius in net:
                    child = self._node(centre, own, radius)
                    self.children[node].append(child)
                    todo.append((child, r / 2))

    def _node(self, centre: int, points: np.ndarray, radius: float | None = None) -> int:
        self.centre.append(centre)
        self.points.append(points)
        self.children.append([])
        self.radius.append(float(distance(self.x[points], self.x[centre][None]).max()) if radius is None else radius)
        return len(self.centre) - 1

    def _net(self, points: np.ndarray, first: int, r: float) -> list[tuple[int, np.ndarray, float]]:
        """Centres further than r from each other, the node's own first, each with the points nearest to it and its covering radius."""
        x = self.x[points]
        every = distance(x, x) if len(points) <= AT_ONCE else None  # all distances by one product where they fit
        row = lambda k: distance(x, x[k][None])[:, 0] if every is None else every[k]
        near, owner, centres = row(int(np.flatnonzero(points == first)[0])).copy(), np.zeros(len(points), int), [first]
        while True:
            far = int(near.argmax())
            if near[far] <= r or 2 * len(centres) > len(points):
                break
            centres.append(int(points[far]))
            d = row(far)
            closer = d < near
            near[closer], owner[closer] = d[closer], len(centres) - 1
        order = np.argsort(owner, kind="stable")
        at = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        return [(c, points[order[at[k] : at[k + 1]]], float(near[order[at[k] : at[k + 1]]].max())) for k, c in enumerate(centres)]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def near_pairs(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all rows of x and y whose cosine is at least ``least``; rows are raw vectors in double precision."""
    if not len(x) or not len(y):
        return np.zeros(0, int), np.zeros(0, int)
    a, b = (v / np.sqrt((v * v).sum(1))[:, None] for v in (x, y))
    s, t = CoverTree(a), CoverTree(b)
    reach = np.sqrt(max(0.0, 2.0 - 2.0 * least)) + 1e-7
    sc, tc, sr, tr = np.array(s.centre), np.array(t.centre), np.array(s.radius), np.array(t.radius)
    out_i, out_j, todo = [], [], [(0, 0)]
    while todo:
        p, q = todo.pop()
        if not s.children[p] and not t.children[q]:
            own, others = s.points[p], t.points[q]
            i, j = np.nonzero(a[own] @ b[others].T >= least - 1e-9)
            out_i.append(own[i])
            out_j.append(others[j])
            continue
        left, right = np.array(s.children[p] or [p]), np.array(t.children[q] or [q])
        d = distance(a[sc[left]], b[tc[right]])
        i, j = np.nonzero(d <= sr[left][:, None] + tr[right][None, :] + reach)
        todo += zip(left[i].tolist(), right[j].tolist(), strict=True)
    i, j = np.concatenate(out_i or [np.zeros(0, int)]), np.concatenate(out_j or [np.zeros(0, int)])
    cos = (a[i] * b[j]).sum(1)
    ok = cos >= least
    for k in np.flatnonzero(np.abs(cos - least) < 1e-12):  # rounding could decide: sum exactly
        u, v = x[i[k]], y[j[k]]
        ok[k] = fsum(u * v) / (fsum(u * u) ** 0.5 * fsum(v * v) ** 0.5) >= least
    return i[ok], j[ok]


def _placed(big: DataFrame, block: int, reach: float, tasks: int) -> DataFrame:
    """(label, dim, rep, copies, v, home, d, near) of vectors (label, dim, n, rep, copies, v): the nearest pivot, the distance to it, and the pivots of higher number whose regions may hold partners.

    Pivots are chosen by hash, MOST_PIVOTS of a label at most, and go with each chunk of at least twice as many vectors.
    """
    h = F.xxhash64(F.lit("pivot"), "rep", "v")
    many = F.least(F.lit(MOST_PIVOTS), F.greatest(F.lit(2), F.ceil(2 * F.col("n") / block))).cast("int")
    pivots = big.groupBy("label", "dim", "n", F.pmod(h, many).alias("k")).agg(F.min_by(F.struct("rep", "v"), h).alias("p"))
    chunks = F.ceil(F.col("n") / F.greatest(F.lit(1024), 2 * many)).cast("int")
    kind = lambda k: F.lit(k).alias("kind")
    p = materialize(pivots.select("label", "dim", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), kind(0), F.col("k").cast("long").alias("rep"), F.lit(0).cast("long").alias("copies"), "p.v"))
    m = big.select("label", "dim", F.pmod(F.xxhash64(F.lit("chunk"), "rep", "v"), chunks).cast("int").alias("chunk"), kind(1), "rep", "copies", "v")

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["kind", "rep"], kind="stable")
        n = int((g["kind"] == 0).sum())
        x = np.array(g["v"].tolist(), float)
        x /= np.sqrt((x * x).sum(1))[:, None]
        out = g.iloc[n:]
        d = distance(x[n:], x[:n])
        at = d.argmin(1)
        d0 = d[np.arange(len(d)), at]
        number = g["rep"].to_numpy()[:n]
        window = (d <= d0[:, None] + 2 * reach) & (number[None, :] > number[at][:, None])
        near = [[{"j": int(number[k]), "d": float(row[k])} for k in np.flatnonzero(w)] for row, w in zip(d, window, strict=True)]
        return pd.DataFrame({"label": out["label"], "dim": out["dim"], "rep": out["rep"], "copies": out["copies"], "v": out["v"], "home": number[at].astype(np.int32), "d": d0, "near": near})

    rows = p.unionByName(m).repartition(tasks, "label", "dim", "chunk")
    return rows.groupBy("label", "dim", "chunk").applyInPandas(run, "label string, dim int, rep long, copies long, v array<double>, home int, d double, near array<struct<j: int, d: double>>".replace("array<double>", big.schema["v"].dataType.simpleString()))


def dedup_embeddings(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each vector.

    Equal vectors are told by a label and two 64-bit hashes, so that whole vectors travel only to where they are compared,
    and as they came, floats as floats.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = "array<float>" if kind == "array<float>" else "array<double>"
    v = vectors.select(column(id_col).cast("long").alias("vec_id"), column(label_col).cast("string").alias("label"), column(vector_col).cast(kind).alias("v"))
    wide = F.col("v").cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & (norm > 0), F.lit(False))
    plain = F.transform("v", lambda x: x + F.lit(0).cast("float" if kind == "array<float>" else "double"))  # zeros have one sign
    v = v.select("vec_id", "label", F.when(good, plain).alias("v"))
    v = v.select("vec_id", "label", "v", *(F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(s), "label", "v")).alias(h) for s, h in ((1, "h1"), (2, "h2"))))
    used = v.where("v is not null")
    classes = materialize(used.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")))
    sizes = classes.groupBy(F.col("label").alias("l"), F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    c = sized_join(classes, materialize(sizes), (F.col("label") == F.col("l")) & (F.size("v") == F.col("dim")))
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * least))) + 1e-7
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = c.select("label", "dim", "n", "rep", "copies", "v")
    big = c.where(F.col("n") > 2 * block)
    homes = c.where(F.col("n") <= 2 * block).select("label", "dim", "rep", "copies", "v", F.lit(0).alias("home"))
    visits = None
    if not big.isEmpty():
        placed = materialize(_placed(big, block, reach, tasks))
        radius = placed.groupBy("label", "dim", "home").agg(F.max("d").alias("radius")).groupBy(F.col("label").alias("rl"), F.col("dim").alias("rd"))
        radius = materialize(radius.agg(F.map_from_entries(F.collect_list(F.struct("home", "radius"))).alias("radii")))  # at most MOST_PIVOTS of a label
        near = sized_join(placed.where(F.size("near") > 0), radius, (F.col("label") == F.col("rl")) & (F.col("dim") == F.col("rd")))
        near = near.withColumn("near", F.filter("near", lambda x: x["d"] <= F.element_at("radii", x["j"]) + reach)).where(F.size("near") > 0)
        visits = near.select("label", "dim", "rep", "copies", "v", F.explode(F.transform("near", lambda x: x["j"])).alias("home"))
        homes = homes.unionByName(placed.select("label", "dim", "rep", "copies", "v", "home"))
    every = homes.withColumn("guest", F.lit(0)) if visits is None else homes.withColumn("guest", F.lit(0)).unionByName(visits.withColumn("guest", F.lit(1)))
    every = materialize(every)
    size = materialize(every.groupBy(F.col("label").alias("sl"), F.col("dim").alias("sd"), F.col("home").alias("sh")).agg(F.count_if(F.col("guest") == 0).alias("own"), F.count_if(F.col("guest") == 1).alias("guests")))
    own, guests = F.ceil(F.col("own") / block).cast("int"), F.ceil(F.col("guests") / block).cast("int")
    j = sized_join(every, size, (F.col("label") == F.col("sl")) & (F.col("dim") == F.col("sd")) & (F.col("home") == F.col("sh"))).withColumn("i", F.pmod(F.xxhash64("rep", "v"), F.when(F.col("guest") == 1, guests).otherwise(own)).cast("int"))
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda kind, lo, hi, right: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), right.alias("right"))
    within = F.transform(upto(own), lambda k: pair(0, F.least("i", k), F.greatest("i", k), F.col("i") > k))
    beside = F.transform(upto(guests), lambda k: pair(1, F.col("i"), k, F.lit(False)))
    calls = F.transform(upto(own), lambda k: pair(1, k, F.col("i"), F.lit(True)))
    j = j.select("label", "dim", "home", "rep", "copies", "v", F.explode(F.when(F.col("guest") == 1, calls).otherwise(F.concat(within, beside))).alias("t"))
    j = j.select(F.xxhash64("label", "dim", "home", "t.kind", "t.lo", "t.hi").alias("group"), (F.col("t.kind") == 0).alias("inner"), (F.col("t.lo") == F.col("t.hi")).alias("one"), "t.right", "rep", "copies", "v")

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["right", "rep"], kind="stable")
        x, copies, rep = np.array(g["v"].tolist(), float), g["copies"].to_numpy(), g["rep"].to_numpy()
        same = bool(g["inner"].iloc[0]) and bool(g["one"].iloc[0])
        n = len(g) if same else int((~g["right"].to_numpy(bool)).sum())
        i, j = near_pairs(x[:n], x if same else x[n:], least)
        if same:
            i, j = i[i != j], j[i != j]
        else:
            j = j + n
        links = np.bincount(i, copies[j], len(g))
        if not same:
            links += np.bincount(j, copies[i], len(g))
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[some], "links": links[some].astype(np.int64), "other": rep[roots(len(g), i, j)[some]]})

    found = materialize(j.repartition(tasks, "group").groupBy("group").applyInPandas(run, "rep long, links long, other long"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = sized_join(sized_join(classes.select("h1", "h2", "rep", "copies"), links.withColumnRenamed("rep", "lrep"), F.col("rep") == F.col("lrep"), "left"), comps, F.col("rep") == F.col("node"), "left")
    per_class = materialize(per_class.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("comp")))
    out = sized_join(v.select("vec_id", "h1", "h2"), per_class, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(False)).alias("kept"))
