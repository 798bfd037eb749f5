"""Shapes over triples (s, p, o, kind, lang): property paths, constraints, and logic over what other shapes find.

A path is a predicate, or {"inverse": path}, {"sequence": [..]}, {"alternative": [..]}, {"zero_or_more": path},
{"one_or_more": path} or {"zero_or_one": path}. It becomes a small automaton; nodes and its states are walked together, a
join a step, until no pair is new. Nothing recurses over nodes.

A shape is a dict. "name", "message" and "severity" describe it; "target" ({"class"}, {"subjects_of"}, {"objects_of"} or
{"nodes": [..]}) says where it starts. With a "path" it tests the values of the path, else the focus node itself, by

    min_count max_count unique_lang has_value equals disjoint less_than        over all values of a focus (the last three name paths)
    in kind class pattern min_length max_length languages min max              over each value
    node and or xone not property closed                                       by other shapes, or their names

Findings are (shape, severity, focus, path, constraint, value, message). Values are texts; literals and IRIs of one spelling
are different nodes.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.plans.lineage import cut

_KNOWN = frozenset("name message severity target path min_count max_count unique_lang has_value equals disjoint less_than in kind class pattern min_length max_length languages min max node and or xone not property closed".split())


def node(kind: Column, value: Column, lang: Column) -> Column:
    """A node's key: its kind, language and text."""
    return F.concat(F.when(kind == "iri", "i").otherwise("l"), F.coalesce(lang, F.lit("")), F.lit("\0"), value)


def said(key: Column) -> Column:
    return F.substr(key, F.instr(key, "\0") + 1)


def iri(value: str) -> str:
    return f"i\0{value}"


def automaton(path: object) -> tuple[set[int], list[tuple[int, str, bool, int]], set[int]]:
    """Start states, steps (state, predicate, backwards, next state) and final states of a path."""
    empty: dict[int, set[int]] = {}
    steps: list[tuple[int, str, bool, int]] = []
    count = iter(range(10**6))

    def build(p: object, back: bool) -> tuple[int, int]:
        a, b = next(count), next(count)
        free = lambda x, y: empty.setdefault(x, set()).add(y)
        if isinstance(p, str):
            steps.append((a, p, back, b))
            return a, b
        ((kind, arg),) = p.items()
        if kind == "inverse":
            return build(arg, not back)
        if kind == "sequence":
            parts = [build(x, back) for x in (reversed(arg) if back else arg)]
            for (_, x), (y, _) in zip(parts, parts[1:], strict=False):
                free(x, y)
            return parts[0][0], parts[-1][1]
        if kind == "alternative":
            for x, y in (build(x, back) for x in arg):
                free(a, x)
                free(y, b)
            return a, b
        if kind not in ("zero_or_more", "one_or_more", "zero_or_one"):
            raise ValueError(f"unknown path {kind}")
        x, y = build(arg, back)
        free(a, x)
        free(y, b)
        if kind != "zero_or_one":
            free(y, x)
        if kind != "one_or_more":
            free(a, b)
        return a, b

    first, last = build(path, False)

    def closure(q: int) -> set[int]:
        out, todo = {q}, [q]
        while todo:
            new = empty.get(todo.pop(), set()) - out
            out |= new
            todo += new
        return out

    return closure(first), [(q, p, back, r) for q, p, back, to in steps for r in closure(to)], {last}


def name_of(path: object) -> str | None:
    return path if path is None or isinstance(path, str) else json.dumps(path, sort_keys=True)


class Graph:
    """Triples as edges between nodes, both ways."""

    def __init__(self, triples: DataFrame):
        self.spark = triples.sparkSession
        lang = F.col("lang") if "lang" in triples.columns else F.lit(None).cast("string")
        out = triples.select(node(F.lit("iri"), F.col("s"), F.lit(None).cast("string")).alias("a"), "p", node(F.col("kind"), F.col("o"), lang).alias("b")).distinct()
        self.out = cut(out)

    def of(self, predicates: list[str], back: bool) -> DataFrame:
        d = self.out.where(F.col("p").isin(predicates))
        return d.select(F.col("b").alias("a"), "p", F.lit(True).alias("back"), F.col("a").alias("b")) if back else d.select("a", "p", F.lit(False).alias("back"), "b")

    def values(self, focus: DataFrame, path: object) -> DataFrame:
        """(focus, value) of a path from each focus (focus)."""
        start, steps, final = automaton(path)
        if len(steps) == 1 and not start & final:
            e = self.of([steps[0][1]], steps[0][2])
            return focus.join(e, focus["focus"] == e["a"]).select("focus", F.col("b").alias("value"))
        ways = {back: sorted({p for _, p, b, _ in steps if b == back}) for back in (False, True)}
        e = reduce(DataFrame.union, (self.of(ps, back) for back, ps in ways.items() if ps))
        t = F.broadcast(self.spark.createDataFrame(steps, "q int, tp string, tback boolean, r int"))  # as long as the path is written
        states = F.array(*(F.lit(q) for q in sorted(start)))
        seen = front = cut(focus.select("focus", F.col("focus").alias("value"), F.explode(states).alias("q")))
        parts = [front]
        while True:
            step = front.join(t, "q").join(e, (F.col("value") == F.col("a")) & (F.col("tp") == F.col("p")) & (F.col("tback") == F.col("back")))
            step = step.select("focus", F.col("b").alias("value"), F.col("r").alias("q")).distinct()
            front = cut(step.join(seen, ["focus", "value", "q"], "left_anti"))
            if front.isEmpty():
                break
            parts.append(front)
            seen = reduce(DataFrame.union, parts)  # each round's file is read, none written again
        return seen.where(F.col("q").isin(list(final))).select("focus", "value").distinct()

    def targets(self, target: dict) -> DataFrame:
        ((kind, arg),) = target.items()
        if kind == "class":
            return self.out.where((F.col("p") == "rdf:type") & (F.col("b") == iri(arg))).select(F.col("a").alias("focus")).distinct()
        if kind == "subjects_of":
            return self.out.where(F.col("p") == arg).select(F.col("a").alias("focus")).distinct()
        if kind == "objects_of":
            return self.out.where(F.col("p") == arg).select(F.col("b").alias("focus")).distinct()
        if kind == "nodes":
            return self.spark.createDataFrame([(iri(x),) for x in arg], "focus string")
        raise ValueError(f"unknown target {kind}")


class Shapes:
    """Shapes by name, which others may refer to."""

    def __init__(self, shapes: list[dict]):
        self.shapes = shapes
        self.named = {s["name"]: s for s in shapes if "name" in s}

    def resolve(self, s: dict | str, above: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
        if isinstance(s, dict):
            return s, above
        if s not in self.named:
            raise ValueError(f"unknown shape {s}")
        if s in above:
            raise ValueError(f"shape {s} refers to itself")
        return self.named[s], (*above, s)

    def broken(self, g: Graph, s: dict | str, nodes: DataFrame, above: tuple[str, ...]) -> DataFrame:
        """(value): those of nodes (focus) that don't conform to a shape."""
        s, above = self.resolve(s, above)
        return self.found(g, s, nodes, above).select(F.col("root").alias("value")).distinct()

    def found(self, g: Graph, s: dict, nodes: DataFrame, above: tuple[str, ...] = ()) -> DataFrame:
        """(root, shape, severity, focus, path, constraint, value, message) of nodes (focus), root being the node that a nested finding counts against."""
        if unknown := sorted(set(s) - _KNOWN):
            raise ValueError(f"unknown in a shape: {', '.join(unknown)}")
        path, out = s.get("path"), []
        v = nodes.select("focus", F.col("focus").alias("value")) if path is None else g.values(nodes, path)

        def say(d: DataFrame, name: str, value: Column | None = None) -> None:
            told = F.lit(None).cast("string") if value is None else value.cast("string")
            message = F.lit(s["message"]) if "message" in s else F.lit(f"{name} {json.dumps(s[name], sort_keys=True)}")
            out.append(d.select(F.col("focus").alias("root"), F.lit(s.get("name")).cast("string").alias("shape"), F.lit(s.get("severity", "violation")).alias("severity"), "focus", F.lit(name_of(path)).cast("string").alias("path"), F.lit(name).alias("constraint"), told.alias("value"), message.alias("message")))

        text, own = said(F.col("value")), said(F.col("value"))
        if "min_count" in s or "max_count" in s:
            n = nodes.join(v.groupBy("focus").agg(F.countDistinct("value").alias("n")), "focus", "left").select("focus", F.coalesce("n", F.lit(0)).alias("n"))
            if "min_count" in s:
                say(n.where(F.col("n") < s["min_count"]), "min_count", F.col("n"))
            if "max_count" in s:
                say(n.where(F.col("n") > s["max_count"]), "max_count", F.col("n"))
        if s.get("unique_lang"):
            lang = F.substr(F.split_part("value", F.lit("\0"), F.lit(1)), F.lit(2))
            say(v.select("focus", "value", lang.alias("lang")).where("lang <> ''").groupBy("focus", "lang").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "unique_lang", F.col("lang"))
        if "has_value" in s:
            has = v.where(own == s["has_value"]).select("focus").distinct()
            say(nodes.join(has, "focus", "left_anti"), "has_value", F.lit(s["has_value"]))
        for name in ("equals", "disjoint"):
            if name in s:
                other = g.values(nodes, s[name])
                if name == "disjoint":
                    say(v.join(other, ["focus", "value"], "left_semi"), name, own)
                else:
                    say(v.join(other, ["focus", "value"], "left_anti").union(other.join(v, ["focus", "value"], "left_anti")), name, own)
        if "less_than" in s:
            least = g.values(nodes, s["less_than"]).groupBy("focus").agg(F.min(said(F.col("value")).try_cast("double")).alias("least"))
            say(v.join(least, "focus").where(~F.coalesce(text.try_cast("double") < F.col("least"), F.lit(False))), "less_than", own)
        tests = {
            "in": lambda x: text.isin(x), "kind": lambda x: F.left("value", F.lit(1)) == ("i" if x == "iri" else "l"), "pattern": lambda x: text.rlike(x), "min_length": lambda x: F.char_length(text) >= x, "max_length": lambda x: F.char_length(text) <= x,
            "languages": lambda x: F.substr(F.split_part("value", F.lit("\0"), F.lit(1)), F.lit(2)).isin(x), "min": lambda x: text.try_cast("double") >= x, "max": lambda x: text.try_cast("double") <= x,
        }
        for name, holds in tests.items():
            if name in s:
                say(v.where(~F.coalesce(holds(s[name]), F.lit(False))), name, own)
        if "class" in s:
            members = g.targets({"class": s["class"]}).select(F.col("focus").alias("value"))
            say(v.join(members, "value", "left_anti").select("focus", "value"), "class", own)
        if "closed" in s:  # the predicates that a node may have
            more = v.join(g.out.where(~F.col("p").isin(s["closed"])), F.col("value") == F.col("a"))
            say(more.select("focus", "p").distinct(), "closed", F.col("p"))

        each = v.select(F.col("value").alias("focus")).distinct() if {"node", "and", "or", "xone", "not", "property"} & set(s) else None
        for name in ("node", "and", "not"):
            if name in s:
                parts = [self.broken(g, x, each, above) for x in (s[name] if name == "and" else [s[name]])]
                bad = reduce(DataFrame.union, parts).distinct()
                say(v.join(bad, "value", "left_anti" if name == "not" else "left_semi").select("focus", "value"), name, own)
        for name in ("or", "xone"):
            if name in s:
                n = reduce(DataFrame.union, (self.broken(g, x, each, above) for x in s[name])).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
                holds = F.lit(len(s[name])) - F.coalesce("n", F.lit(0))
                say(v.join(n, "value", "left").where(holds != 1 if name == "xone" else holds < 1).select("focus", "value"), name, own)
        for x in s.get("property", []):
            x, inner = self.resolve(x, above)
            deep = self.found(g, {"name": s.get("name"), **x}, each, inner)
            out.append(v.join(deep, v["value"] == deep["root"]).select(v["focus"].alias("root"), *(deep[c] for c in deep.columns[1:])))
        if not out:
            raise ValueError("a shape without constraints")
        return reduce(DataFrame.union, out)


def check(triples: DataFrame, shapes: list[dict]) -> DataFrame:
    """(shape, severity, focus, path, constraint, value, message) of all shapes that have a target."""
    g, every = Graph(triples), Shapes(shapes)
    out = [every.found(g, s, g.targets(s["target"])) for s in shapes if "target" in s]
    return reduce(DataFrame.union, out).drop("root").withColumn("focus", said(F.col("focus"))).distinct()


def report(found: DataFrame) -> DataFrame:
    """(shape, severity, focus, path, message): one finding for each shape, focus and path, its distinct messages joined."""
    d = found.groupBy("shape", "severity", "focus", "path").agg(F.array_join(F.array_sort(F.collect_set("message")), "; ").alias("message"))
    return d.select("shape", "severity", "focus", "path", "message")
