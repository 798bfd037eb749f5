"""Triples (s, p, o) and edges (a, b): matching, traversal, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.lineage import cut


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    for c, v in (("s", s), ("p", p), ("o", o)):
        if v is not None:
            triples = triples.where(F.col(c) == v)
    return triples


def traverse(triples: DataFrame, seeds: DataFrame, depth: int = 1, predicates: list[str] | None = None, direction: str = "out", hidden: DataFrame | None = None, limit: int | None = None, with_types: bool = False) -> DataFrame:
    """(node, depth): nodes within ``depth`` steps of the seeds (node), the seeds themselves at 0.

    Each round joins the frontier with the edges and drops what was seen; hidden nodes (node) are not reached, but a
    seed expands even if hidden. Types aren't followed unless asked for or named. The lineage is cut after each round. A
    limit takes the first by depth and node.
    """
    e = (triples if with_types else triples.where("p <> 'rdf:type'")) if predicates is None else triples.where(F.col("p").isin(predicates))
    out, back = e.select(F.col("s").alias("a"), F.col("o").alias("b")), e.select(F.col("o").alias("a"), F.col("s").alias("b"))
    e = {"out": out, "in": back, "both": out.union(back)}[direction].distinct()
    seen = frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        step = e.join(frontier, e.a == frontier.node).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        if hidden is not None:
            step = step.join(hidden.select("node"), "node", "left_anti")
        frontier = cut(step.withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)  # of written rounds; none is written again
    return seen if limit is None else seen.orderBy("depth", "node").limit(limit)


def impact(triples: DataFrame, seeds: DataFrame, depth: int = 3, predicates: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """What refers to the seeds, directly or not; the seeds go, and count for no limit."""
    found = traverse(triples, seeds, depth, predicates, "in").where("depth > 0")
    return found if limit is None else found.orderBy("depth", "node").limit(limit)


def in_scope(nodes: DataFrame, claims: DataFrame, scope: dict[str, str]) -> DataFrame:
    """nodes (node, ..) that a scope {field: value} allows, by claims (node, field, value, positive): a negative claim of the value excludes; where positive claims of a field exist, one must match; a field without claims passes."""
    c = claims.where(F.col("field").isin(list(scope)))
    wanted = F.element_at(F.create_map(*(F.lit(x) for kv in scope.items() for x in kv)), F.col("field"))
    per = c.withColumn("hit", F.col("value") == wanted).groupBy("node", "field").agg(F.bool_or(~F.col("positive") & F.col("hit")).alias("no"), F.bool_or("positive").alias("some"), F.bool_or(F.col("positive") & F.col("hit")).alias("yes"))
    out = per.where("no or (some and not yes)").select("node").distinct()
    return nodes.join(out, "node", "left_anti")


def degrees(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree): outgoing edges, and incoming ones from elsewhere; a node without either is an orphan."""
    ends = triples.select(F.col("s").alias("node")).unionAll(triples.where("s <> o").select(F.col("o").alias("node")))
    n = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(n, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def cycles(edges: DataFrame) -> DataFrame:
    """(node) on a cycle of edges (a, b): forward colouring finds strong components without any closure.

    Nodes without a way in or out are peeled off. Then each node takes the largest id that reaches it; within a colour,
    what reaches back from its root is the root's component. Components leave, and the rest goes on, until none is left.
    """
    e = cut(edges.select("a", "b").distinct())
    found = e.where("a = b").select(F.col("a").alias("node"))
    e = _peeled(cut(e.where("a <> b")))
    while not e.isEmpty():
        colour = cut(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            far = e.join(colour, F.col("a") == F.col("node")).groupBy(F.col("b").alias("n")).agg(F.max("c").alias("m"))
            new = cut(colour.join(far, F.col("node") == F.col("n"), "left").select("node", F.greatest("c", "m").alias("c"), (F.col("m") > F.col("c")).alias("moved")))
            colour = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        ca, cb = colour.select(F.col("node").alias("a"), F.col("c").alias("ca")), colour.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        inner = cut(e.join(ca, "a").join(cb, "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")))
        front = member = cut(colour.where("node = c").select("node", "c"))
        while not front.isEmpty():  # backwards from the roots, within a colour
            front = cut(inner.join(front, (F.col("b") == F.col("node")) & (inner.c == front.c)).select(F.col("a").alias("node"), inner.c).distinct().join(member, ["node", "c"], "left_anti"))
            member = cut(member.union(front))
        size = member.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
        found = found.union(member.join(size, "c", "left_semi").select("node"))
        gone = member.select("node")
        e = _peeled(cut(e.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")))
    return found.distinct()


def _peeled(e: DataFrame) -> DataFrame:
    """Edges without nodes that have no way in or no way out."""
    n = e.count()
    while n:
        e = cut(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        if (m := e.count()) == n:
            break
        n = m
    return e


def resolve_concepts(refs: DataFrame, labels: DataFrame) -> DataFrame:
    """(ref, lang, id) for refs (ref, lang) and labels (label, lang, kind, id): the exact language first, then the primary one, then any; within each label, id, alt; then the lowest id. What lacks a language takes part in the last pass only.

    Labels are reduced to one candidate for each name and language before the join, so that a hot name multiplies nothing.
    """
    tier = F.when(F.col("kind") == "label", 0).when(F.col("kind") == "id", 1).otherwise(2)
    named = labels.select(F.lower("label").alias("key"), F.lower("lang").alias("tag"), F.struct(tier.alias("tier"), "id").alias("best"))
    primary = lambda c: F.substring_index(c, "-", 1)
    tagged = named.where("tag <> ''")
    exact = tagged.groupBy(F.col("key").alias("k0"), F.col("tag").alias("t0")).agg(F.min("best").alias("b0"))
    near = tagged.groupBy(F.col("key").alias("k1"), primary("tag").alias("t1")).agg(F.min("best").alias("b1"))
    every = named.groupBy(F.col("key").alias("k2")).agg(F.min("best").alias("b2"))
    r = refs.select("ref", "lang", F.lower("ref").alias("key"), F.lower("lang").alias("own"))
    j = r.join(exact, (F.col("key") == F.col("k0")) & (F.col("own") == F.col("t0")), "left").join(near, (F.col("key") == F.col("k1")) & (primary("own") == F.col("t1")), "left").join(every, F.col("key") == F.col("k2"), "left")
    return j.select("ref", "lang", F.coalesce("b0", "b1", "b2")["id"].alias("id")).where("id is not null")


def hops(triples: DataFrame, reached: DataFrame, direction: str = "out") -> DataFrame:
    """(a, p, b, depth): the edges by which a traversal's nodes (node, depth) were first reached."""
    a, b = ("s", "o") if direction == "out" else ("o", "s")
    r = reached.select(F.col("node").alias(a), F.col("depth").alias("da"))
    to = reached.select(F.col("node").alias(b), F.col("depth").alias("db"))
    return triples.join(r, a).join(to, b).where("db = da + 1").select(F.col(a).alias("a"), "p", F.col(b).alias("b"), F.col("db").alias("depth")).distinct()
