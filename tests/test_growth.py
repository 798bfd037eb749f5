"""Steps that must not grow faster than their input: rounds, rows and what a row costs."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import jaccard_join, spm_codec
from docloom.operators import glossary, links, pins, provenance, templates
from docloom.plans import lineage, toolkit
from docloom.sources import batches, structure


def rows(d, *cols):
    return sorted(tuple(r) for r in d.select(*cols).collect())


def test_ancestors_take_few_rounds(spark, monkeypatch):
    written, real = [], glossary.cut
    monkeypatch.setattr(glossary, "cut", lambda d: written.append(1) or real(d))
    up = spark.range(70).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent")).union(spark.createDataFrame([(70, 60), (5, 200), (200, 5)], "child long, parent long"))
    pairs = spark.createDataFrame([(0, 70), (70, 0), (3, 200), (200, 69), (65, 62), (62, 65), (70, 60), (10, 200), (8, 8), (61, 61)], "a long, b long")
    assert rows(glossary.above(pairs, up), "a", "b") == [(0, 70), (3, 200), (61, 61), (62, 65), (65, 62), (70, 60), (200, 69)]
    assert len(written) < 24  # not a round or two for each of 70 levels


def test_related_terms_by_hierarchy(spark):
    cols = "idx long, file string, line int, id string, language string, label string, alt array<string>, see string, broader array<string>, narrower array<string>, related array<string>"
    t = [(0, [], ["b"]), (1, ["a"], ["c", "d"]), (2, ["b"], ["a", "d"]), (3, ["a", "b"], ["c"])]  # a over b and d, b over c and d
    terms = spark.createDataFrame([(i, "f", 1, "abcd"[i], "en", "abcd"[i].upper() + "x", [], None, up, [], rel) for i, up, rel in t], cols)
    assert rows(glossary.related_in_hierarchy(terms), "id", "value", "other") == [("a", "narrower", "1"), ("b", "narrower", "2"), ("b", "narrower", "3"), ("c", "broader", "0")]
    assert rows(glossary.related_siblings(terms), "id", "value", "other") == [("c", "1", "3")]


def test_releases_in_windows_by_running_number(spark):
    w = spark.createDataFrame([("a", 5, 5), ("a", 3, 10), ("b", 0, None), ("b", 9, None), ("c", 11, 200), ("d", 4, 6)], "id string, opened int, closed int")
    r = spark.createDataFrame([(x,) for x in (3, 9, 9, 10, 50, None)], "commit long")
    d = pins.history_metrics(w, r)
    assert rows(d, "id", "windows", "open", "commits", "crossed") == [("a", 2, 0, 7, 2), ("b", 2, 2, 0, 7), ("c", 1, 0, 189, 1), ("d", 1, 0, 2, 0)]
    assert "filter(" not in d._jdf.queryExecution().optimizedPlan().toString().replace("Filter", "")  # no list of all releases for each window


def test_references_without_semicolon_are_text(spark):
    page = '<h1 id="x">A &amp;&amp &lt; &#x27;q&#39; &copy &nbsp;&amp;lt; \n b &amp</h1><p><a href="/x?a=1&copy=2&amp;b=3">t</a></p>'
    d = structure.nodes(spark.createDataFrame([("p.html", page)], "path string, text string"))
    assert [(r.kind, r.text, r.target) for r in d.orderBy("seq").collect()] == [("heading", "A &&amp < 'q' &copy  &lt; b &amp", None), ("paragraph", "t", None), ("link", "t", "/x?a=1&copy=2&b=3")]


def test_python_holds_a_few_texts_at_once():
    b = pa.RecordBatch.from_pydict({"text": ["x" * 40, None, "y" * 70, "", "z" * 500, "w"] + [None] * 1500})
    got = [p.column("text").to_pylist() for p in batches.pieces(iter([b, b.slice(0, 0)]), "text", 100)]
    assert [len(x) for x in got][:4] == [2, 2, 1, 1000] and sum(got, []) == b.column("text").to_pylist()


def test_pages_align_without_a_group_each(spark):
    s = spark.createDataFrame([("a", 1, 2, "In", None), ("a", 2, 3, None, 1), ("a", 3, 2, "Odd", None), ("b", 1, 1, "T", None)], "path string, section int, level int, title string, parent int")
    t = {"t": {"sections": [{"name": "In", "sections": [{"name": "X"}]}]}}
    d = templates.align(s, spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t"), ("d", "none")], "path string, template string"), t)
    got = {tuple(r) for r in d.select("path", "rule", "section", "title", "status").collect()}
    assert got == {("a", "0", 1, "In", "match"), ("a", "0/0", 2, "", "coerced"), ("a", None, 3, "Odd", "unexpected"), ("b", "0", None, None, "missing"), ("c", "0", None, None, "missing")}
    assert "FlatMapGroupsInPandas" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_only_cited_hashes_leave_a_source(spark):
    text = "\n".join(f"l{i}" for i in range(400)) + "\nl7\n"
    h = lambda *x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    cols = "id int, path string, first int, last int, pin string"
    c = spark.createDataFrame([(1, "a", 1, 1, h("l5")), (2, "a", 1, 1, h("l7")), (3, "a", 2, 3, h("l1", "l2")), (4, "a", 1, 1, h("no")), (5, "z", 1, 1, h("l5")), (6, "a", 0, 0, None), (7, None, 1, 1, h("l5")), (8, "n", 1, 1, h("l5")), (9, "a", 900, 901, None)], cols)
    s = spark.createDataFrame([("a", text), ("n", None)], "path string, text string")
    assert rows(pins.classify(c, s), "id", "status", "at") == [(1, "moved", 6), (2, "moved-ambiguous", None), (3, "current", None), (4, "changed", None), (5, "missing", None), (6, "current", None), (7, "missing", None), (8, "changed", None), (9, "current", None)]
    plan = pins.classify(c, s)._jdf.queryExecution().executedPlan().toString()
    assert "array_contains(pins" in plan


def test_labels_are_counted_before_their_join(spark, tmp_path):
    li = [(1, "A"), (1, "B"), (2, "A"), (2, "A"), (2, None), (3, None), (4, "A")]
    spark.createDataFrame(li, "l_orderkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (2,), (3,), (9,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    d = toolkit.label_join(spark, str(tmp_path))
    assert rows(d, "l_orderkey", "ambiguous", "n") == [(1, True, 2), (2, False, 6), (3, False, 1)]
    assert "SortMergeJoin" not in d._jdf.queryExecution().executedPlan().toString() and d._jdf.queryExecution().optimizedPlan().toString().startswith("Project")


def test_repeated_links_are_parsed_once(spark, monkeypatch):
    seen, real = [], lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda d: seen.append(d._jdf.queryExecution().optimizedPlan().toString()) or real(d))
    e = spark.createDataFrame([("http://a/", "http://a/p#x")] * 5 + [("http://a/p/", "http://a/q")], "url string, href string")
    got = links.frontier(spark.createDataFrame([("http://a/",)], "url string"), e, "http://a")
    assert rows(got, "url", "depth") == [("http://a/", 0), ("http://a/p", 1), ("http://a/q", 2)]
    assert seen[0].startswith("Aggregate") and "regexp" not in seen[0] and "regexp" in seen[1]


def test_a_commit_touches_only_pieces_near_its_hunks():
    class Counted(list):
        n = 0

        def __getitem__(self, i):
            Counted.n += isinstance(i, int)
            return super().__getitem__(i)

    old = [(2, c, 5) for c in range(3000)]
    got = provenance.replay(Counted(old), [(2, 1, 2, 3)], 9000)
    assert got == [(1, 0, 5), (3, 9000, 2), *old[1:]] and Counted.n < 10


def test_region_names_are_counted_in_parts(spark, monkeypatch):
    plans, real = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or real(d))
    each = spark.createDataFrame([(r, x) for x in range(-9, 9) for r in range(abs(x) % 3 + 1)] + [(5, 100), (5, 100)], "rep long, sig long")
    shared, kept = jaccard_join._shared(each)
    want = [(x, abs(x) % 3 + 1) for x in range(-9, 9) if x % 3]
    assert rows(shared, "s", "k") == want
    assert rows(kept, "sig", "rep") == [(x, r) for x, k in want for r in range(k)]
    assert len(plans) == 2 * jaccard_join.SLICES and all("pmod" in p for p in plans)


def test_a_worker_keeps_no_encoded_units():
    c = spm_codec.codec()
    was = c.encode("one two one")
    assert c.marked or c.plain
    c.forget()
    assert not (c.marked or c.plain or c.marked.old or c.plain.old or c.pairs) and c.encode("one two one") == was
