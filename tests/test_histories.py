"""As-of joins, line origins, shapes with paths and graph patterns, each against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import ordered, patterns, pins, provenance, shacl


def rows(d, *cols):
    return sorted(map(str, (tuple(r) for r in d.select(*cols).collect())))


def test_asof_join_equals_a_plain_search(spark):
    rng = random.Random(2)
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])  # noqa: E731  # one key holds half of the rows
    left = [(i, key(), rng.choice([None, *range(50)])) for i in range(400)]
    right = [(key(), rng.choice([None, *range(0, 50, 3)]), rng.randint(0, 9)) for _ in range(120)]
    l, r = spark.createDataFrame(left, "i int, k int, t int").repartition(3), spark.createDataFrame(right, "k int, t int, v int")

    def plain(strict, within):
        out = []
        for i, k, t in left:
            ok = [x for x in right if None not in (k, t, x[0], x[1]) and x[0] == k and (x[1] < t or not strict and x[1] == t)]
            best = max(ok, key=lambda x: (x[1], x[2]), default=None)
            if best is not None and within is not None and best[1] < t - within:
                best = None
            out.append(str((i, *((best[1], best[2]) if best else (None, None)))))
        return sorted(out)

    for strict in (False, True):
        for within in (None, 4):
            got = ordered.asof_join(l, r, ["k"], "t", strict=strict, within=within)
            assert rows(got, "i", "right_t", "v") == plain(strict, within)
    inner = ordered.asof_join(l, r, ["k"], "t", how="inner")
    assert rows(inner, "i", "right_t", "v") == [x for x in plain(False, None) if "None" not in x]
    assert ordered.asof_join(l.limit(0), r, ["k"], "t").count() == 0 and ordered.asof_join(l, r.limit(0), ["k"], "t").where("v is not null").count() == 0


def history(seed, commits):
    """Random edits and renames of a few files, with the origin of each line kept beside it."""
    rng = random.Random(seed)
    files, edits, renames, n = {}, [], [], 0
    for c in range(1, commits + 1):
        used = set()
        for _ in range(rng.randint(1, 3)):
            act = rng.random()
            free = [f for f in files if f not in used]
            if act < 0.15 and free:  # a rename, at times onto a name that was used before, at times with edits
                was = rng.choice(free)
                new = rng.choice([f"f{i}" for i in range(8) if f"f{i}" not in files and f"f{i}" not in used] or [f"g{c}-{len(renames)}"])
                files[new] = files.pop(was)
                renames.append((c, was, new))
                used |= {was, new}
                path = new
                if rng.random() < 0.5:
                    continue
            elif act < 0.35 or not free:
                n += 1
                path = rng.choice([f"f{i}" for i in range(8) if f"f{i}" not in files and f"f{i}" not in used] or [f"h{n}"])
                files[path] = []
            else:
                path = rng.choice(free)
            used.add(path)
            old, new, at, shift = files[path], [], 0, 0
            hunks = []
            while at <= len(old) and len(hunks) < 3:
                at += rng.randint(0, 4)
                if at > len(old):
                    break
                gone, come = min(rng.randint(0, 3), len(old) - at), rng.randint(0, 3)
                if gone or come:
                    hunks.append((at, gone, come))
                at += gone + 1
            at = 0
            for start, gone, come in hunks:
                new += old[at:start]
                edits.append((path, c, start + (gone > 0), gone, start + shift + (come > 0), come))
                new += [(c, start + shift + 1 + k) for k in range(come)]
                shift += come - gone
                at = start + gone
            files[path] = new + old[at:]
    return files, edits, renames


def test_line_origins_equal_a_plain_replay(spark):
    for seed in (1, 2):
        files, edits, renames = history(seed, 60)
        e = spark.createDataFrame(edits, "path string, commit long, old_first long, old_count long, new_first long, new_count long")
        r = spark.createDataFrame(renames, "commit long, was string, path string")
        assert renames
        want = sorted(str((p, i + 1, c, o)) for p, ls in files.items() for i, (c, o) in enumerate(ls))
        assert rows(provenance.blame(e, r), "path", "line", "commit", "origin") == want
    assert provenance.replay([(3, 1, 1)], [(2, 1, 2, 2)], 5) == [(1, 1, 1), (2, 5, 2), (1, 1, 3)]
    for bad in ([(4, 1, 1, 0)], [(2, 2, 2, 0), (2, 1, 2, 0)]):
        with pytest.raises(ValueError, match="hunk"):
            provenance.replay([(3, 1, 1)], bad, 5)


def test_stale_windows_follow_renames(spark):
    versions = spark.createDataFrame([("a", 1, "x\ny"), ("b", 3, "x\ny"), ("b", 4, "z\ny"), ("c", 6, "x\nq"), ("a", 7, "other"), ("c", 9, None)], "path string, commit long, text string")
    renames = spark.createDataFrame([(3, "a", "b"), (6, "b", "c")], "commit long, was string, path string")
    h = spark.range(1).select(F.sha2(F.lit("x"), 256)).first()[0]
    cited = spark.createDataFrame([("p", "a", 1, 1, 1, h)], "id string, path string, commit long, first int, last int, pin string")
    s = provenance.states(cited, versions, renames)
    assert rows(s, "commit", "path", "status") == sorted(map(str, [(1, "a", "current"), (3, "b", "current"), (4, "b", "changed"), (6, "c", "current"), (9, "c", "missing")]))
    assert rows(pins.stale_windows(s), "opened", "closed", "reason") == sorted(map(str, [(4, 6, "restored"), (9, None, None)]))


def test_shape_paths_equal_reachability(spark):
    rng = random.Random(6)
    es = {(rng.randrange(14), rng.choice("pq"), rng.randrange(14)) for _ in range(34)}
    g = shacl.Graph(spark.createDataFrame([(f"n{a}", p, f"n{b}", "iri", None) for a, p, b in es], "s string, p string, o string, kind string, lang string"))

    def plain(path, a):
        if isinstance(path, str):
            return {y for x, p, y in es if x == a and p == path}
        ((kind, arg),) = path.items()
        if kind == "inverse":
            return {x for x in range(14) if a in plain(arg, x)}
        if kind == "alternative":
            return set().union(*(plain(x, a) for x in arg))
        if kind == "sequence":
            out = {a}
            for x in arg:
                out = set().union(*(plain(x, y) for y in out))
            return out
        out, todo = set(), [a]
        while todo:
            new = plain(arg, todo.pop()) - out
            out |= new
            todo += [] if kind == "zero_or_one" else new
        return out | ({a} if kind != "one_or_more" else set())

    focus = spark.createDataFrame([(shacl.iri(f"n{i}"),) for i in range(14)], "focus string")
    for path in ("p", {"inverse": "q"}, {"sequence": ["p", {"inverse": "q"}]}, {"one_or_more": {"alternative": ["p", "q"]}}, {"inverse": {"sequence": ["p", {"zero_or_more": "q"}, "p"]}}, {"sequence": [{"zero_or_one": "p"}, {"zero_or_more": {"sequence": ["p", "q"]}}]}):
        got = {(r.focus, r.value) for r in g.values(focus, path).collect()}
        assert got == {(shacl.iri(f"n{a}"), shacl.iri(f"n{b}")) for a in range(14) for b in plain(path, a)}, path


def test_shapes_with_logic(spark):
    t = [("a", "rdf:type", "C", "iri", None), ("b", "rdf:type", "C", "iri", None), ("a", "label", "one", "literal", "en"), ("a", "label", "uno", "literal", "en"), ("a", "label", "eins", "literal", "de"), ("b", "label", "C", "literal", None), ("a", "to", "b", "iri", None), ("b", "to", "C", "iri", None), ("b", "low", "7", "literal", None), ("b", "high", "5", "literal", None)]
    d = spark.createDataFrame(t, "s string, p string, o string, kind string, lang string")
    of = {"target": {"class": "C"}}

    def found(*shapes):
        return {(r.shape, r.focus, r.constraint, r.value) for r in shacl.check(d, list(shapes)).collect()}

    assert found({"name": "u", **of, "path": "label", "unique_lang": True, "languages": ["en", "de"]}) == {("u", "a", "unique_lang", "en"), ("u", "b", "languages", "C")}
    assert found({"name": "k", **of, "path": "to", "kind": "literal"}) == {("k", "a", "kind", "b"), ("k", "b", "kind", "C")}
    assert found({"name": "e", **of, "path": "label", "equals": "to"}) >= {("e", "b", "equals", "C")}  # a text isn't the node of that name
    assert found({"name": "l", **of, "path": "low", "less_than": "high"}) == {("l", "b", "less_than", "7")}
    assert found({"name": "n", "target": {"nodes": ["a"]}, "property": [{"path": "to", "node": "inner"}]}, {"name": "inner", "path": "label", "max_count": 0}) == {("n", "a", "node", "b")}
    assert found({"name": "c", **of, "closed": ["rdf:type", "label", "to"]}) == {("c", "b", "closed", "low"), ("c", "b", "closed", "high")}
    assert found({"name": "o", "target": {"objects_of": "to"}, "and": [{"path": "label", "min_count": 1}, {"not": {"path": "low", "min_count": 1}}]}) == {("o", "b", "and", "b"), ("o", "C", "and", "C")}
    r = shacl.report(shacl.check(d, [{"name": "m", **of, "path": "label", "min_length": 9, "pattern": "^x", "severity": "warning"}])).collect()
    assert sorted((x.focus, x.severity, x.message) for x in r) == [("a", "warning", 'min_length 9; pattern "^x"'), ("b", "warning", 'min_length 9; pattern "^x"')]
    for bad in ([{"name": "x", **of, "node": "x"}], [{"name": "x", **of, "node": "y"}], [{"name": "x", **of, "odd": 1}], [{"name": "x", **of, "path": {"up": "p"}, "min_count": 1}]):
        with pytest.raises(ValueError, match="itself|unknown"):
            shacl.check(d, bad)


def test_patterns(spark):
    t = spark.createDataFrame([(f"s{i}", "knows", f"s{i * 7 % 20}") for i in range(20)] + [(f"s{i}", "age", str(i)) for i in range(0, 20, 2)] + [("s3", "boss", "s3")], "s string, p string, o string")
    assert rows(patterns.basic(t, [("?x", "?p", "?x")]), "x", "p") == sorted(map(str, [("s0", "knows"), ("s10", "knows"), ("s3", "boss")]))
    parts = [("?x", "knows", "?y"), ("?y", "age", "?a"), ("?z", "boss", "?x")]
    assert patterns.order(parts, patterns.counts(t, parts)) == [parts[2], parts[0], parts[1]]
    assert rows(patterns.solve(t, parts[:1], optional=[[parts[1]]], having="x = 's2' or x = 's3'"), "x", "y", "a") == sorted(map(str, [("s2", "s14", "14"), ("s3", "s1", None)]))
    with pytest.raises(ValueError, match="share"):
        patterns.basic(t, [("?x", "knows", "?y"), ("?a", "age", "?b")])
    with pytest.raises(ValueError, match="share"):
        patterns.solve(t, [("?x", "knows", "?y")], optional=[[("?a", "age", "?b")]])
