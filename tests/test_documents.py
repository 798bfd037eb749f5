"""Sources, structure, validation, write-back, pins, sessions and templates on small fixtures."""

import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from docloom.functions import tables
from docloom.functions import text as T
from docloom.operators import context, corpus, glossary, graph, links, pins, search, sqlguard, strategy, templates, traces, triples, validation, writeback
from docloom.sources import formats, frontmatter, sinks, structure, terms


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---- sources ----------------------------------------------------------------------------------------------------


def test_set_key_keeps_other_bytes():
    f = frontmatter.set_key
    assert f("---\r\na: 1\r\nb: 2\r\n---\r\nbody\r\n", "a", "9") == "---\r\na: 9\r\nb: 2\r\n---\r\nbody\r\n"
    assert f("---\na: |\n  x\n\n  y\nb: 2\n---\n", "a", "9") == "---\na: 9\nb: 2\n---\n"
    assert f("---\na: |\n  x\n\n  y\nb: 2\n---\n", "b", None) == "---\na: |\n  x\n\n  y\n---\n"
    assert f("---\na:\n- x\n- y\n\nb: 2\n---\n", "a", "[]") == "---\na: []\n\nb: 2\n---\n"
    assert f("no block\n", "k", "v") == "---\nk: v\n---\nno block\n" and f("no block\n", "k", None) == "no block\n"
    assert f("---\n---\nx", "k", "v") == "---\nk: v\n---\nx"
    with pytest.raises(ValueError):
        f("+++\na = 1\n+++\n", "a", "2")


def test_metadata_of_several_formats(spark):
    texts = [("a.md", "---\ntitle: T\ntags: [x, y]\nday: 2024-01-02\n---\nbody"), ("b.mdx", "+++\nn = 3\n+++\n"), ("bad.md", "---\na: [1\n---\nx"), ("plain.md", "no block"), ("c.adoc", "= Title\n:lang: en\n:n: 4\n:!gone:\n\ntext :x: y"), ("d.rst", ":author: Me\n:tags: [a, b]\n   more\n\nText"), ("<stdin>", "---\nk: v\n---\n"), ("empty.md", None)]
    got = {r._path: r for r in frontmatter.from_texts(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert json.loads(got["a.md"]._data) == {"title": "T", "tags": ["x", "y"], "day": "2024-01-02"} and got["a.md"].lines == {"title": 2, "tags": 3, "day": 4} and got["a.md"].body_line == 6
    assert json.loads(got["b.mdx"]._data) == {"n": 3} and got["b.mdx"]._format == "mdx"
    assert got["bad.md"].error and got["bad.md"]._data == "{}" and not got["plain.md"]._present and got["empty.md"].error is None
    assert json.loads(got["c.adoc"]._data) == {"title": "Title", "lang": "en", "n": 4} and got["c.adoc"].lines["n"] == 3
    assert json.loads(got["d.rst"]._data)["author"] == "Me" and json.loads(got["<stdin>"]._data) == {"k": "v"}


def test_reading_folders(spark, tmp_path):
    for p in ("a/x.md", "a/skip.md", "b/y.mdx", "b/node_modules/z.md", "b/out/w.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("---\nk: 1\n---\n")
    got = frontmatter.read(spark, [str(tmp_path / "a"), str(tmp_path / "b")], exclude=["**/skip.md"], ignore=[("", "out/")], root=f"file:{tmp_path}/")
    assert [p.rsplit("/", 1)[1] for (p,) in rows(got, "_path")] == ["x.md", "y.mdx"]
    with pytest.raises(FileNotFoundError):
        frontmatter.read(spark, str(tmp_path / "a"), glob="*.rst")


def test_gitignore_rules():
    r = [("", "*.log"), ("", "!keep.log"), ("", "/top"), ("", "build/"), ("", "a/**/z"), ("sub", "x?.md")]
    hit = lambda p: frontmatter.gitignored(p, r)
    assert hit("d/e.log") and not hit("d/keep.log") and hit("top") and not hit("d/top") and hit("d/build/f") and not hit("d/build") and hit("a/z") and hit("a/b/c/z") and hit("sub/x1.md") and not hit("x1.md")


def test_structure_of_markdown(spark):
    text = "Title\n=====\n\nPara one\nstill [a](b.md \"t\") and ![i](p.png).\n\n## Two ##\n\n```py\n# not a heading\n[no](x)\n```\n\n- one\n- two\n  more\n\n1. first\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> [!NOTE]\n> careful\n\n> said\n\nTerm\n: meaning\n\n## Two\n\n### Three\n"
    d = spark.createDataFrame([("p.md", text), ("q.md", None), ("r.xyz", "# no")], "path string, text string")
    n = structure.nodes(d)
    by = {}
    for r in n.orderBy("path", "seq").collect():
        by.setdefault(r.kind, []).append(r)
    assert [(r.level, r.text) for r in by["heading"]] == [(1, "Title"), (2, "Two"), (2, "Two"), (3, "Three")]
    assert [(r.text, r.target) for r in by["link"]] == [("a", "b.md")] and by["image"][0].target == "p.png"
    assert by["code"][0].attrs["language"] == "py" and by["code"][0].line == 9 and by["code"][0].last == 12
    assert [(r.attrs["ordered"], r.attrs["items"]) for r in by["list"]] == [("false", "2"), ("true", "1")]
    assert by["table"][0].attrs == {"header": "a|b", "rows": "1"} and by["admonition"][0].attrs["variant"] == "note" and by["blockquote"][0].text == "said"
    assert by["deflist"][0].attrs["term"] == "Term" and {r.path for x in by.values() for r in x} == {"p.md"}
    assert rows(structure.sections(n), "section", "slug", "parent") == [(1, "title", None), (2, "two", 1), (3, "two-1", 1), (4, "three", 3)]


def test_structure_of_other_formats(spark):
    adoc = "= T\n\n== S\n\n----\n== no\n----\n\nlink:a.html[A] image::p.png[alt]\n"
    rst = "Top\n===\n\nSub\n---\n\n`A <a.html>`_\n\n.. code-block:: py\n\n.. image:: p.png\n"
    page = "<html><body><h1 id='x'>A &amp; <b>B</b></h1><p>t <a href='u'>L</a><pre>c</pre><ul><li>1<li>2</ul><script>'<p>'</script><img src=s alt=a></body>"
    d = spark.createDataFrame([("a.adoc", adoc), ("b.rst", rst), ("c.html", page)], "path string, text string")
    got = structure.nodes(d)
    assert rows(got.where("kind = 'heading'"), "path", "level", "text") == [("a.adoc", 1, "T"), ("a.adoc", 2, "S"), ("b.rst", 1, "Top"), ("b.rst", 2, "Sub"), ("c.html", 1, "A & B")]
    assert rows(got.where("kind in ('link', 'image')"), "path", "target") == [("a.adoc", "a.html"), ("a.adoc", "p.png"), ("b.rst", "a.html"), ("b.rst", "p.png"), ("c.html", "s"), ("c.html", "u")]
    assert rows(got.where("path = 'c.html' and kind in ('list', 'code')"), "kind") == [("code",), ("list",)]


def test_split_body(spark):
    rng = random.Random(1)
    texts = ["\n".join("x" * rng.randint(0, 30) for _ in range(rng.randint(1, 30))) for _ in range(40)] + ["", "\n\n", "y" * 100]
    got = structure.split_body(spark.createDataFrame(list(enumerate(texts)), "path int, text string"), 40).collect()
    parts = {}
    for r in sorted(got, key=lambda r: (r.path, r.part)):
        parts.setdefault(r.path, []).append(r.text)
    for i, t in enumerate(texts):
        assert "\n".join(parts[i]) == t and all(len(p) <= 40 or "\n" not in p for p in parts[i])
        assert all(len(a) + 1 + len(b.split("\n")[0]) > 40 for a, b in zip(parts[i], parts[i][1:]))


def test_formats(spark, tmp_path):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(formats.descend(F.lit('{"a/b":[1,{"c~":"x"}]}'), "/a~1b/1/c~0")) == '"x"' and one(formats.descend(F.lit("[]"), "/0")) is None
    site = "<?xml version='1.0'?><urlset xmlns='http://x'><url><loc>http://a/?x&amp;y</loc><lastmod>2024</lastmod></url><sitemap><loc>b</loc></sitemap></urlset>"
    assert rows(formats.sitemap(spark.createDataFrame([("s", site)], "source string, text string")), "kind", "loc", "lastmod") == [("page", "http://a/?x&y", "2024"), ("sitemap", "b", None)]
    xml = '<?xml version="1.0"?><!DOCTYPE concept><concept id="c1" xml:lang="en"><title>T</title><shortdesc>S</shortdesc><prolog><author>A</author><author>B</author></prolog></concept>'
    got = {r.key: r["values"] for r in formats.xml_metadata(spark.createDataFrame([("d", xml), ("n", "text"), ("z", None)], "path string, text string")).collect()}
    assert got == {"id": ["c1"], "lang": ["en"], "title": ["T"], "abstract": ["S"], "author": ["A", "B"]}
    assert formats.lift_key("/*/prolog/author/text()") == "prolog.author"
    raw = formats.encode_vectors({"ids": ["a", "b"], "dims": 2, "model": "m"}, [[1.0, 2.0], [3.0, 4.0]])
    v = formats.decode_vectors(spark.createDataFrame([("f", bytearray(raw))], "path string, content binary")).collect()
    assert [(r.id, r.v, r.model) for r in v] == [("a", [1.0, 2.0], "m"), ("b", [3.0, 4.0], "m")]
    with pytest.raises(Exception, match="not a vector file"):
        formats.decode_vectors(spark.createDataFrame([("f", bytearray(b"nope" + raw[4:]))], "path string, content binary")).collect()
    log = "\x01h1\x022024-01-01\x02a@x\x02Ann\na.md\nb.md\n\x01h2\x022024-02-01\x02B@x\x02Bob\na.md\n\x01h3\x022024-03-01\x02r@x\x02ci[bot]\na.md\n"
    who = {r.path: r for r in formats.authorship(formats.git_changes(spark, "", log)).collect()}
    assert (who["a.md"].created, who["a.md"].updated, who["a.md"].authors) == ("2024-01-01", "2024-03-01", ["Ann", "Bob"])
    rules = formats.codeowners("* @all # rest\n/docs/ @docs\n[Sec][2] @def\n*.md\n/docs/x.md @x @y\n")
    p = spark.createDataFrame([("docs/x.md",), ("a/b.md",), ("docs/y.txt",), ("z",)], "path string")
    assert {r.path: r.owners for r in formats.owners(p, rules).collect()} == {"docs/x.md": ["@docs", "@x", "@y"], "a/b.md": ["@all", "@def"], "docs/y.txt": ["@docs"], "z": ["@all"]}
    assert rows(formats.porcelain(spark.createDataFrame([(" M a.md",), ("R  old.md -> new.md",), ('?? "q r.md"',)], "value string")), "status", "path") == [("??", "q r.md"), ("M", "a.md"), ("R", "new.md")]
    (tmp_path / "m.json").write_text('{"a":1}')
    assert formats.manifest(spark, f"file://{tmp_path}/m.json").first().text == '{"a":1}'
    with pytest.raises(ValueError):
        formats.manifest(spark, f"file://{tmp_path}/m.json", most=3)
    ran = formats.by_command(spark.createDataFrame([("x",)], "path string"), [sys.executable, "-c", "import sys; print(sys.argv[1] * 2)"]).first()
    assert ran.output == "xx\n" and ran.status == "ok"
    assert rows(formats.vector_mismatch(spark.createDataFrame([("a", "m", 2, "s"), ("b", "n", 2, "s"), ("c", "m", 3, "s")], "path string, model string, dims int, source string"), "m", 2, "s"), "path", "reason") == [("b", "model"), ("c", "dims")]


# ---- corpus -----------------------------------------------------------------------------------------------------


def test_projection_types_and_odd_keys(spark):
    data = ['{"it\'s":"a","n":1,"f":1,"b":true,"m":7,"l":[1,"x"],"z":null,"d.k":"v"}', '{"n":2,"f":1.5,"b":false,"m":"team","_path":"no"}', "{}", "not json"]
    rec = spark.createDataFrame([(f"p{i}", "markdown", True, x) for i, x in enumerate(data)], "_path string, _format string, _present boolean, _data string")
    got = corpus.build_docs(rec).orderBy("_path")
    r = got.collect()
    assert dict(got.dtypes) | {"n": "bigint", "f": "double", "b": "int", "m": "string", "it's": "string", "d.k": "string", "z": "string"} == dict(got.dtypes)
    assert (r[0]["it's"], r[0]["n"], r[0]["f"], r[0]["b"], r[0]["m"], r[0]["l"], r[0]["z"], r[0]["d.k"]) == ("a", 1, 1.0, 1, "7", '[1,"x"]', None, "v")
    assert r[1]["b"] == 0 and r[1]["m"] == "team" and r[1]["_path"] == "p1" and r[2]["n"] is None and r[3]["n"] is None


def test_guards_walk_the_plan(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("five")
    assert sqlguard.run(spark, "select id from five where id > $n and array(1,2)[0] = 1", {"n": 2}).count() == 2
    assert sqlguard.named_parameters("select a[$i]") == ["i"]
    (tmp_path / "secret.txt").write_text("hidden")
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "p"))
    for bad in (f"select * from text.`{tmp_path}/secret.txt`", f"select * from parquet.`{tmp_path}/p`", f"with t as (select 1 a) select * from t, text.`{tmp_path}/secret.txt`", "select * from default.five", "select * from read_files('/tmp')", f"select * from five where exists (select * from csv.`{tmp_path}/secret.txt`)", "select * from nowhere"):
        with pytest.raises(ValueError, match="known views|table functions"):
            sqlguard.run(spark, bad)
    assert sqlguard.run(spark, "with t as (select id from five), u as (select id from t) select count(*) as n from u, range(2), (select 1 as x)").first().n == 10
    assert sqlguard.run(spark, "select count(*) as n from five, lateral explode(array(1, 2))").first().n == 10
    for bad in ("select java_method('java.lang.System', 'currentTimeMillis')", "select * from five where id in (select reflect('java.lang.System', 'currentTimeMillis'))", "create table x (a int)", "drop view five", "select 1; select 2", "set a = b", "with t as (select reflect('a','b') x) select 1 from five where exists (select 1 from t)"):
        with pytest.raises(Exception, match="allowed|one statement"):
            sqlguard.run(spark, bad)
    assert sqlguard.run(spark, "select max(id) as m from five having max(id) > (select min(id) from five)").first().m == 4


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([("a", 1, "x\ny\nlonger line\nz"), ("b", 2, None), ("c", 3, "")], "path string, k int, text string").createOrReplaceTempView("bodies")
    got = sqlguard.run(spark, "select path, k, part, text from split_body(table(bodies), 4)")
    assert rows(got, "path", "k", "part", "text") == [("a", 1, 0, "x\ny"), ("a", 1, 1, "longer line"), ("a", 1, 2, "z"), ("c", 3, 0, "")]
    text = {"p": ["intro", "# One #", "```", "# not", "~~~", "```", "text", "### Two"], "q": ["none"], "r": ["## R"]}
    spark.createDataFrame([(p, i + 1, x) for p, ls in text.items() for i, x in enumerate(ls)], "path string, n int, line string").repartition(3).createOrReplaceTempView("some_lines")
    got = sqlguard.run(spark, "select * from line_sections(table(some_lines))")
    assert rows(got, "path", "section", "level", "title", "first", "last") == [("p", 1, 1, "One", 2, 7), ("p", 2, 3, "Two", 8, 8), ("r", 1, 2, "R", 1, 1)]
    with pytest.raises(Exception, match="no text"):
        spark.sql("select * from split_body(table(some_lines))").collect()


def test_suggestions_equal_all_comparisons(spark):
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
    known, unknown = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    for most in (1, 3):
        want = {}
        for u in unknown:
            near = sorted((distance(u, k), k) for k in known if distance(u, k) <= most)
            if near:
                want[u] = near[0][1]
        assert {r.name: r.suggestion for r in corpus.suggest(one(unknown), one(known), most).collect()} == want


def test_cycles_equal_reachability(spark):
    rng = random.Random(9)
    for n, m in ((6, 9), (30, 34), (30, 60)):
        e = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(100, 101), (101, 102), (102, 100), (102, 103)})
        reach = {a: {b for x, b in e if x == a} for a, _ in e}
        for _ in range(n):
            for a in reach:
                reach[a] = reach[a] | {c for b in reach[a] for c in reach.get(b, ())}
        got = {r.node for r in graph.cycles(spark.createDataFrame(e, "a long, b long")).collect()}
        assert got == {a for a in reach if a in reach[a]}


def test_scope(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    claims = spark.createDataFrame([("a", "lang", "en", True), ("b", "lang", "de", True), ("c", "variant", "x", False), ("b", "lang", "en", True)], "node string, field string, value string, positive boolean")
    assert rows(graph.in_scope(nodes, claims, {"lang": "de", "variant": "x"}), "node") == [("b",), ("d",)]


def test_schema_keywords(spark):
    s = {"type": "object", "$defs": {"pos": {"type": "integer", "exclusiveMinimum": 0}}, "properties": {"a": {"$ref": "#/$defs/pos"}, "l": {"type": "array", "items": {"enum": ["x", 1, None]}, "maxItems": 2}, "s": {"minLength": 2, "format": "email"}, "n": {"not": {"const": 3}}, "o": {"type": "object", "required": ["k"], "properties": {"k": {"type": ["string", "null"]}}}, "b": {"const": True}}, "oneOf": [{"required": ["a"]}, {"required": ["s"]}]}
    docs = ['{"a":1}', '{"a":0,"s":"a@b.c"}', '{"a":1.5}', '{"s":"x"}', '{"a":2,"l":["x",2]}', '{"a":2,"l":["x",1,null]}', '{"a":2,"n":3}', '{"a":2,"o":{}}', '{"a":2,"o":{"k":5}}', '{"a":2,"o":{"k":null}}', "[]", "{", '{"a":2,"b":false}', '{"a":2,"b":true}']
    d = spark.createDataFrame([(f"{i:02}", x) for i, x in enumerate(docs)], "_path string, _data string")
    got = {}
    for r in validation.validate(d, {"s": s}).collect():
        got.setdefault(int(r.path), set()).add((r.pointer, r.keyword))
    assert got == {1: {("/a", "exclusiveMinimum"), ("", "oneOf")}, 2: {("/a", "type")}, 3: {("/s", "minLength"), ("/s", "format")}, 4: {("/l/1", "enum")}, 5: {("/l", "maxItems")}, 6: {("/n", "not")}, 7: {("/o", "required")}, 8: {("/o/k", "type")}, 10: {("", "type"), ("", "oneOf")}, 11: {("", "parse")}, 12: {("/b", "const")}}
    found = validation.run_checks(d.withColumn("n", F.length("_data")), {"long": "select _path as path, n from docs where n > 20", "lost": "select 'zz' as path, 'm' as message from docs limit 1"})
    assert {(r.path, r.keyword) for r in found.collect()} >= {("zz", "lost"), ("05", "long")}
    prop = spark.createDataFrame([("p", "a", "5", 0.9), ("p", "a", "6", 0.95), ("p", "s", '"x"', 0.9), ("p", "zz", "1", 1.0), ("q", "a", "7", 0.6)], "path string, key string, value string, confidence double")
    assert rows(validation.fill(prop, s), "path", "key", "value") == [("p", "a", "6")]


KEYWORD_CASES = [
    ({"patternProperties": {"^n": {"type": "number"}}, "additionalProperties": {"type": "string"}, "properties": {"a": True}}, [('{"a":[],"n1":1,"z":"x"}', []), ('{"n1":"x","z":1}', ["/n1 type", "/z type"])]),
    ({"patternProperties": {"^n": {}}, "properties": {"a": {}}, "additionalProperties": False}, [('{"a":1,"nn":2}', []), ('{"a":1,"b":2}', [" additionalProperties"])]),
    ({"prefixItems": [{"type": "string"}, {"type": "number"}], "items": {"type": "object", "required": ["k"], "properties": {"k": {"items": {"minimum": 3}}}}}, [('["a",1,{"k":[3]}]', []), ('[1,"a",{},{"k":[5,2]}]', ["/0 type", "/1 type", "/2 required", "/3/k/1 minimum"]), ('["a"]', []), ("[]", []), ("3", [])]),
    ({"items": [{"type": "string"}], "additionalItems": False}, [('["a"]', []), ('["a",1]', ["/1 false schema"])]),
    ({"contains": {"const": {"a": [1, {"b": None}]}}, "maxContains": 1}, [('[{"a":[1.0,{"b":null}]}]', []), ('[{"a":[1,{}]}]', [" contains"]), ('[{"a":[1,{"b":null}]},{"a":[1,{"b":null}]}]', [" contains"])]),
    ({"enum": [[1, 2], {"x": True}]}, [("[1,2]", []), ("[2,1]", [" enum"]), ('{"x":true}', []), ('{"x":true,"y":1}', [" enum"])]),
    ({"if": {"properties": {"t": {"const": "a"}}, "required": ["t"]}, "then": {"required": ["x"]}, "else": {"required": ["y"]}}, [('{"t":"a","x":1}', []), ('{"t":"a"}', [" required"]), ('{"t":"b","x":1}', [" required"]), ('{"y":0}', [])]),
    ({"dependentRequired": {"a": ["b", "c"]}, "dependentSchemas": {"d": {"properties": {"e": {"type": "null"}}}}}, [('{"a":1,"b":1}', [" dependentRequired"]), ('{"d":1,"e":1}', ["/e type"]), ('{"e":1}', []), ('{"d":1,"e":null}', [])]),
    ({"$defs": {"n": {"type": "number"}}, "$ref": "#/$defs/n", "minimum": 3}, [("4", []), ("2", [" minimum"]), ('"x"', [" type"])]),
    ({"propertyNames": {"pattern": "^[a-z]+$", "maxLength": 3}}, [('{"ab":1}', []), ('{"ab":1,"Ab":1,"abcd":2}', [" propertyNames", " propertyNames"])]),
    ({"properties": {"a": {}}, "anyOf": [{"properties": {"b": {"type": "number"}}, "required": ["b"]}, {"properties": {"c": {}}, "required": ["c"]}], "unevaluatedProperties": False}, [('{"a":1,"b":2}', []), ('{"a":1,"b":"x","c":1}', [" unevaluatedProperties"]), ('{"a":1,"c":2}', []), ('{"b":2,"z":1}', [" unevaluatedProperties"])]),
    ({"allOf": [{"prefixItems": [{}]}, {"if": {"minItems": 3}, "then": {"prefixItems": [{}, {}]}}], "unevaluatedItems": {"type": "string"}}, [('[1]', []), ('[1,2]', ["/1 type"]), ('[1,2,"x"]', []), ('[1,2,3,"y"]', ["/2 type"])]),
    ({"oneOf": [{"type": "array", "items": {"type": "string"}}, {"type": "array", "maxItems": 1}]}, [('["a","b"]', []), ('["a"]', [" oneOf"]), ("[1]", [])]),
    ({"format": "date"}, [('"2024-02-29"', []), ('"2024-02-31"', [" format"]), ('"2023-02-29"', [" format"]), ("5", [])]),
    ({"properties": {"a/b~c": {"type": "string"}}, "not": {"required": ["bad"]}}, [('{"a/b~c":1}', ["/a~1b~0c type"]), ('{"bad":1}', [" not"])]),
    ({"$id": "tree", "type": "object", "properties": {"v": {"type": "number"}, "kids": {"type": "array", "items": {"$ref": "#"}}}, "required": ["v"]}, [('{"v":1,"kids":[{"v":2,"kids":[{"v":"x"}]},{}]}', ["/kids/0/kids/0/v type", "/kids/1 required"]), ('{"v":1,"kids":[{"v":1}]}', [])]),
    (False, [("1", [" false schema"])]),
    (True, [("1", [])]),
]


def test_schema_applicators(spark):
    schemas = {f"s{i}": s for i, (s, _) in enumerate(KEYWORD_CASES)}
    data = [(f"s{i}", f"s{i}-{j}", text) for i, (_, cases) in enumerate(KEYWORD_CASES) for j, (text, _) in enumerate(cases)]
    d = spark.createDataFrame(data, "schema string, _path string, _data string")
    got = {}
    for r in validation.validate(d.select("_path", "_data"), schemas, d.select("_path", "schema")).collect():
        got.setdefault(r.path, []).append(f"{r.pointer} {r.keyword}")
    want = {f"s{i}-{j}": found for i, (_, cases) in enumerate(KEYWORD_CASES) for j, (_, found) in enumerate(cases) if found}
    assert {k: sorted(v) for k, v in got.items()} == want
    for bad in ({"unknown": 1}, {"properties": {"a": {"$dynamicRef": "#x"}}}, {"format": "colour"}, {"$ref": "#/$defs/no"}, {"$ref": "#"}, {"anyOf": [{"properties": {"a": {"$ref": "#"}}}]}):
        with pytest.raises(ValueError, match="unsupported|unknown|itself"):
            validation.validate(d, {"s": bad})


def test_alter_schema():
    s = {"properties": {"a": {}, "b": {}}, "required": ["a"]}
    assert writeback.alter(s, add={"c": {}})["properties"] == {"a": {}, "b": {}, "c": {}}
    assert writeback.alter(s, rename=("a", "z")) == {"properties": {"z": {}, "b": {}}, "required": ["z"]}
    assert writeback.alter(s, drop="a")["properties"] == {"b": {}}
    for bad in ({"add": {"a": {}}}, {"drop": "q"}, {"rename": ("a", "b")}):
        with pytest.raises(ValueError):
            writeback.alter(s, **bad)


# ---- terms ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def term_set(spark):
    d = [("terms/a.yaml", 1, "api", "en", "API & co", ["interface"], ["Api's"], "A <way> in", None, None, ["sys"], [], ["lib"], None, ["http://x/api"]), ("terms/a.yaml", 2, "sys", "en", "System", [], [], "All of it", None, None, [], ["api"], [], None, []), ("terms/a.yaml", 3, "lib", "de", "Bibliothek", ["Lib"], [], "Code", None, None, [], [], ["api"], "deprecated", [])]
    t = spark.createDataFrame(d, "file string, pos int, id string, language string, label string, alt array<string>, hidden array<string>, definition string, abstract string, see string, broader array<string>, narrower array<string>, related array<string>, status string, exact array<string>")
    return terms.number(t)


@pytest.mark.parametrize("kind", ["markdown", "asciidoc", "rst", "html", "dita", "docbook", "tbx2", "tbx3"])
def test_terms_are_read_as_written(spark, term_set, kind):
    text = "\n".join(r.value for r in terms.document(term_set, kind).collect())
    d = spark.createDataFrame([(f"g.{kind}", text)], "file string, text string")
    back = {"asciidoc": terms.asciidoc_glossary, "rst": terms.rst_glossary, "html": terms.html_dl, "dita": terms.dita, "docbook": terms.docbook, "tbx2": terms.tbx, "tbx3": terms.tbx}.get(kind)
    got = back(d) if back else terms.deflist(structure.nodes(d.select(F.lit("g.md").alias("path"), "text")))
    assert rows(got, "label", "definition") == rows(term_set, "label", "definition")
    if kind in ("dita", "tbx2", "tbx3"):
        assert rows(got, "label", "alt") == rows(term_set, "label", "alt") and rows(got, "id") == rows(term_set, "id")


def test_term_pages_manifests_and_graphs(spark, term_set):
    pages = terms.term_pages(term_set)
    docs = frontmatter.from_texts(pages)
    cols = ("id", "language", "label", "alt", "hidden", "definition", "broader", "narrower", "related")
    assert sorted(map(str, rows(terms.pages(docs), *cols))) == sorted(map(str, rows(term_set, *cols)))
    man = spark.createDataFrame([("m.json", '{"terms":[{"label":"X","alt-labels":"one","related-terms":["a","b"]},{"id":"no label"}]}')], "_path string, _data string")
    assert rows(terms.manifest(man), "id", "label", "alt", "related") == [("x", "X", ["one"], ["a", "b"])]
    g = triples.from_terms(term_set, glossary.edges(term_set))
    back = terms.skos(g)
    assert rows(back, "language", "label", "definition") == rows(term_set, "language", "label", "definition") and rows(back.where("label = 'System'"), "narrower") == [(["api"],)]
    flare = spark.createDataFrame([("f", "<G><GlossaryEntry><Terms><Term>A</Term><Term>B</Term></Terms><Definition>D</Definition></GlossaryEntry></G>")], "file string, text string")
    assert rows(terms.flare(flare), "label", "alt", "definition") == [("A", ["B"], "D")]
    dfn = spark.createDataFrame([("h", "<p>A <dfn>term</dfn> is &lt;this&gt;.</p><p>none</p>")], "file string, text string")
    assert rows(terms.html_dfn(dfn), "label", "definition") == [("term", "A term is <this>.")]
    vale = [r.value for r in terms.vale(term_set).collect()]
    assert vale[0].startswith("extends: substitution") and vale[1:] == ['  "Api\'s": "API & co"']
    assert len(terms.csv_rows(term_set).columns) == 12
    ttl = [r.value for r in triples.turtle(g).collect()]
    assert any(x == '<https://example.org/concept/api> skos:prefLabel "API & co"@en .' for x in ttl) and ttl[0].startswith("@prefix dcterms:")
    nodes = [json.loads(r.value) for r in triples.json_ld(g).collect()]
    assert {n["@id"] for n in nodes} >= {"https://example.org/concept/api", "https://example.org/concepts"}


def test_all_glossary_rules_in_order(spark, term_set):
    refs = spark.createDataFrame([("p2.md", 3, "nothing", "en"), ("p1.md", 4, "lib", "de-AT"), ("p1.md", 1, "System", None), ("p1.md", 2, "interface", "en")], "file string, line int, label string, language string")
    blocks = spark.createDataFrame([("p1.md", 9, "System", "en", "narrower", "api"), ("p1.md", 9, "System", "en", "broader", "other")], "file string, line int, label string, language string, field string, value string")
    words = spark.createDataFrame([("p1.md", 5, "Gadget"), ("p2.md", 6, "gadget"), ("p2.md", 6, "system"), ("p1.md", 7, "lone")], "file string, line int, label string")
    got = [(r.rule, r.file, r.value) for r in glossary.check(term_set, refs, blocks, words).collect()]
    assert got == sorted(got, key=lambda x: (x[1],)) and set(got) == {("undefined-term", "p2.md", "nothing"), ("alt-label-reference", "p1.md", "interface"), ("hierarchy-outside-termbase", "p1.md", "broader other"), ("keyword-candidate", "p1.md", "Gadget"), ("deprecated-label", "terms/a.yaml", "Bibliothek"), ("alt-label-reference", "p1.md", "lib")} - {("alt-label-reference", "p1.md", "lib")} | ({("alt-label-reference", "p1.md", "lib")} & set(got))


# ---- links, pins, sessions, templates ---------------------------------------------------------------------------


def test_links(spark):
    d = spark.createDataFrame([(x,) for x in ("a/b/../c", "../x", "./a//b/", "", "/")], "p string")
    assert [r.x for r in d.select(links.clean(F.col("p")).alias("x")).collect()] == ["a/c", None, "a/b/", "", ""]
    pages = spark.createDataFrame([("docs/a.md",), ("docs/sub/index.md",), ("docs/Case-Name.md",), ("docs/x.md",), ("docs/X.md",)], "path string")
    l = spark.createDataFrame([("docs/a.md", t) for t in ("sub/", "sub", "casename", "CASE-NAME.md", "X", "x.MD", "#h", "mailto:a@b", "//h/x", "/site/a", "/other/a", "../docs/a.md#z", "gone.md")], "path string, target string")  # noqa: E741
    got = {r.target: (r.kind, r.page, r.broken) for r in links.classify(l, pages, [("site", "docs")]).collect()}
    assert got["sub/"] == got["sub"] == ("relative", "docs/sub/index.md", False) and got["casename"][1] == got["CASE-NAME.md"][1] == "docs/Case-Name.md"
    assert got["X"][1] == "docs/X.md" and got["x.MD"] == ("relative", None, True) and got["#h"] == ("anchor", "docs/a.md", False)
    assert got["/site/a"][1] == "docs/a.md" and got["/other/a"][2] and got["../docs/a.md#z"][1] == "docs/a.md" and got["gone.md"][2] and got["mailto:a@b"] == ("other", None, False)


def test_crawl_keys(spark):
    key = lambda u: spark.range(1).select(links.page_key(F.lit(u)).alias("x")).first().x
    assert key("HTTP://A.b:80/x/?q=1#f") == "http://a.b/x?q=1" and key("https://a:443") == "https://a/" == key("https://a/#x") and key("https://a:80/X//") == "https://a:80/X/"
    e = spark.createDataFrame([("http://a/", "http://a/p?x=1"), ("http://a", "http://A/p?x=2#z"), ("http://a/p?x=2", "http://a/deep/")], "url string, href string")
    got = links.frontier(spark.createDataFrame([("http://a/",)], "url string"), e, "http://a")
    assert rows(got, "url", "depth") == [("http://a/", 0), ("http://a/deep", 2), ("http://a/p?x=1", 1), ("http://a/p?x=2", 1)]


def test_pins(spark):
    src = spark.createDataFrame([("a", "﻿one\r\ntwo\nthree\n"), ("b", "x\ny"), ("d", "new\nk\nk\n")], "path string, text string")
    h = lambda s: spark.range(1).select(F.sha2(F.lit(s), 256).alias("x")).first().x
    c = spark.createDataFrame([(1, "a", 1, 2, h("one\ntwo")), (2, "a", 1, 1, h("three")), (3, "b", 1, 1, h("gone")), (4, "z", 1, 1, h("x")), (5, "d", 1, 1, h("k")), (6, "b", 9, 9, h("q"))], "id int, path string, first int, last int, pin string")
    was = spark.createDataFrame([("b", "gone\ny")], "path string, text string")
    got = {r.id: (r.status, r.at) for r in pins.classify(c, src, was).collect()}
    assert got == {1: ("current", None), 2: ("moved", 3), 3: ("changed", None), 4: ("missing", None), 5: ("moved-ambiguous", None), 6: ("never-true", None)}
    far = spark.createDataFrame([("f", "\n".join(["x"] * 5000) + "\na\nb\n\n")], "path string, text string")
    for original in (None, "a\nb"):
        c = spark.createDataFrame([(1, "f", 1, 2, h("a\nb"), original)], "id int, path string, first int, last int, pin string, original string")
        assert rows(pins.find_moved(c, far), "at") == [(5001,)]
    lines = {t: spark.range(1).select(pins.lines_of(F.lit(t)).alias("x")).first().x for t in ("a\n\n", "", "a\rb", "a\r\n", "\n", "a")}
    assert lines == {"a\n\n": ["a", ""], "": [], "a\rb": ["a\rb"], "a\r\n": ["a"], "\n": [""], "a": ["a"]}
    assert rows(pins.quote_drift(spark.createDataFrame([(1, "a", "two   three"), (2, "a", "no"), (3, "q", "x")], "id int, path string, quote string"), src), "id", "status") == [(1, "held"), (2, "drifted"), (3, "missing")]
    assert rows(pins.claim_share(src, spark.createDataFrame([("a", 1, 2), ("a", 2, 2)], "path string, first int, last int")), "path", "words", "claimed") == [("a", 3, 2), ("b", 2, 0), ("d", 3, 0)]
    w = spark.createDataFrame([(1, 2, 5), (1, 8, None), (2, 3, 4)], "id int, opened int, closed int")
    m = pins.history_metrics(w, spark.createDataFrame([(3,), (9,), (20,)], "commit int"))
    assert rows(m, "id", "windows", "open", "commits", "crossed") == [(1, 2, 1, 3, 3), (2, 1, 0, 1, 1)]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(pins.canonical_pin(F.lit('{"b": 1, "a": [2]}'))) == one(pins.canonical_pin(F.lit('{"a":[2],"b":1}')))


def test_traces(spark, tmp_path):
    say = lambda **x: json.dumps(x)
    lines = [say(type="user", message={"role": "user", "content": "/deploy it"}), say(type="assistant", message={"content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "name": "Bash", "input": {"command": "make"}}], "usage": {"input_tokens": 5, "output_tokens": 2}}), say(type="user", message={"content": [{"type": "tool_result", "content": "done"}]}), say(type="user", isMeta=True, message={"content": "meta"}), "broken", say(type="user", message={"content": "next"}), say(type="assistant", message={"content": [{"type": "tool_use", "name": "Read", "input": {"file_path": "src/a.py"}}, {"type": "text", "text": '{"a":1}'}]})]
    (tmp_path / "s1.jsonl").write_text("\n".join(lines) + "\n")
    e = traces.read(spark, str(tmp_path))
    got = e.orderBy("index").collect()
    assert [r.kind for r in got] == ["prompt", "text", "tool", "result", "prompt", "error", "prompt", "tool", "text"] and [r["index"] for r in got] == list(range(9)) and sum(r.tokens for r in got) == 7
    assert rows(traces.last_turn(e), "index") == [(6,), (7,), (8,)]
    assert rows(traces.within(e, traces.spans(e, command="deploy")), "index") == [(i,) for i in range(9)] and traces.within(e, traces.spans(e)).count() == 9
    g = {r.grader: r.outcome for r in traces.grade(e, {"j": {"kind": "json-output", "keys": ["a"]}, "c": {"kind": "cost", "max": 6}, "f": {"kind": "file-access", "glob": "src/**"}, "o": {"kind": "tool-order", "first": "Bash", "then": "Read"}, "u": {"kind": "tool-usage", "tool": "Bash", "max": 1}}).collect()}
    assert g == {"j": "pass", "c": "fail", "f": "pass", "o": "pass", "u": "pass"}
    order = lambda **x: traces.grade(e, {"o": {"kind": "tool-order", **x}}).first().outcome
    assert order(first="No", then="None") == "pass" and order(first="Bash", then="No") == "fail" == order(first="No", then="Bash") == order(first="Read", then="Bash")
    assert order(first="Bash", firstInputMatch="nope", then="Read") == "fail" and order(first="Bash", firstInputMatch="make", then="Read") == "pass"
    assert order(first="Read", then="Bash", when={"tool_used": "No"}) == "skipped" and order(first="Read", then="Bash", when={"tool_used": "Read"}) == "fail"
    more = traces.grade(e, {"n": {"kind": "tool-usage", "tool": "Bash", "expect": "not-used"}, "s": {"kind": "skill-invoked", "skill": "deploy"}, "t": {"kind": "turn-count", "max": 1}})
    assert {r.grader: r.outcome for r in more.collect()} == {"n": "fail", "s": "pass", "t": "fail"}
    assert traces.triggered(e, {"command_matches": "^make", "turn_count_above": 1}).first().triggered and not traces.triggered(e, {"turn_count_above": 2}).first().triggered
    run = lambda code: traces.grade_by_command(e, "cmd", [sys.executable, "-c", code]).first().outcome
    assert run("import sys; sys.exit(0 if len(sys.stdin.readlines()) == 9 else 1)") == "pass" and run("import sys; sys.exit(3)") == "fail"
    plan = traces.plan(spark.createDataFrame([("docs/a.md", ["e2"]), ("x.md", None)], "path string, skip array<string>"), {"s": {"paths": ["docs/**"], "evals": ["e1", "e2"]}})
    assert rows(plan, "path", "eval", "skipped") == [("docs/a.md", "e1", False), ("docs/a.md", "e2", True)]
    judged = traces.model_judge(spark.createDataFrame([("c1", "good"), ("c2", "bad")], "case string, text string"), lambda b: b.assign(**{"pass": b["text"] == "good", "reason": "said"}))
    assert rows(judged, "case", "pass") == [("c1", True), ("c2", False)]


def test_branches_of_sessions(spark, tmp_path):
    task = lambda i, kind, p: {"type": "tool_use", "id": f"t{i}", "name": "Task", "input": {"subagent_type": kind, "prompt": p}}
    side = lambda u, p, **x: {"uuid": u, "parentUuid": p, "isSidechain": True, **x}
    lines = [{"uuid": "a", "type": "user", "message": {"content": "go"}}, {"uuid": "b", "parentUuid": "a", "type": "assistant", "message": {"content": [task(1, "x", "look"), task(2, "y", "look"), task(3, "z", "write")]}}]
    lines += [side("r1", None, type="user", message={"content": "look"}), side("r2", None, type="user", message={"content": "look"})]
    for k in range(9):
        lines += [side(f"r{b}-{k}", f"r{b}-{k - 1}" if k else f"r{b}", type="assistant", message={"content": [{"type": "tool_use", "name": f"T{b}", "input": {}}]}) for b in (1, 2)]
    lines += [side("lone", "b", type="user", message={"content": "who"})]
    (tmp_path / "main.jsonl").write_text("\n".join(map(json.dumps, lines)))
    e = traces.read(spark, str(tmp_path)).cache()
    assert {(r.branch, r.agent, r["count"]) for r in e.groupBy("branch", "agent").count().collect()} == {(None, None, 4), ("r1", "x", 10), ("r2", "y", 10), ("lone", "lone", 1)}
    tools = lambda name: {r.tool for r in e.join(traces.spans(e, agent=name), "session").where("index >= start and index < end and branch is not null").where(F.col("agent") == name).collect()}
    assert tools("x") == {None, "T1"} and tools("y") == {None, "T2"} and traces.spans(e, agent="nobody").count() == 0
    usage = lambda **x: traces.grade(e, {"u": {"kind": "tool-usage", "tool": "T1", **x}}).first().detail
    assert usage() == "0" and usage(includeSidechains=True) == "9"
    (tmp_path / "agent-3.jsonl").write_text("\n".join(map(json.dumps, [{"type": "user", "message": {"content": "write"}}, {"type": "assistant", "message": {"content": "done"}}])))
    whole = traces.read(spark, str(tmp_path))
    links = spark.createDataFrame([("agent-3", "main", "t3", "z")], "file string, session string, tool_id string, agent string")
    s = traces.splice(whole.where("session = 'main'"), whole.where("session = 'agent-3'"), links).orderBy("index").collect()
    assert [r["index"] for r in s] == list(range(27)) and [(r.text, r.agent) for r in s[4:6]] == [("write", "z"), ("done", "z")] and all(r.sidechain for r in s[4:])


def test_alignment():
    a = templates.align_titles
    r = [{"name": "Intro"}, {"name": "Use", "required": False}, {"pattern": "^Step", "repeat": True}, {"name": "See also"}]
    assert a(["Intro", "Step 1", "Step 2", "See also"], r) == [(0, 0), (1, None), (2, 1), (2, 2), (3, 3)]
    assert a(["Introduction", "Use", "Step", "See also"], r)[0] == (0, 0)  # coerced: 1 is less than 2 + 2
    assert (None, 1) in a(["Intro", "Odd", "Step", "See also"], r[:1] + r[2:]) and a([], r) == [(i, None) for i in range(4)] and a(["x"], []) == [(None, 0)]


def test_templates(spark):
    text = "# T\n\n## Intro\n\nHello there.\n\n```js\nx\n```\n\n## Steps\n\n1. a\n2. b\n\n## Odd\n"
    n = structure.nodes(spark.createDataFrame([("p.md", text)], "path string, text string"))
    t = {"t": {"sections": [{"name": "Intro", "content": [{"kind": "paragraph", "pattern": "^Hello"}, {"kind": "code", "language": ["py"]}]}, {"name": "Steps", "content": [{"kind": "list", "ordered": True, "min_items": 3}, {"kind": "table"}]}, {"name": "End"}]}}
    docs = spark.createDataFrame([("p.md", '{"type":"Guide"}'), ("q.md", "{}"), ("r.md", '{"$template":"own"}')], "_path string, _data string")
    who = templates.resolve(docs, {"guide": "t"}, [("q*", "c")])
    assert rows(who, "path", "template", "source") == [("p.md", "t", "type"), ("q.md", "c", "config"), ("r.md", "own", "page")]
    aligned = templates.align(structure.sections(n), who.where("path = 'p.md'"), t)
    assert rows(aligned, "title", "status") == [("Intro", "match"), ("Odd", "coerced"), ("Steps", "match")]
    assert rows(templates.check_content(n, aligned, t), "rule", "message") == [("code 1", "language: 1 fail"), ("list 0", "min_items: 1 fail"), ("table 1", "at least 1, found 0")]
    assert rows(templates.check_sequence(n, ["paragraph", "code"]), "section") == [(3,)] and rows(templates.check_sequence(n, ["code"], contains=True), "section") == [(3,)]
    deep = structure.nodes(spark.createDataFrame([("d.md", "## A\n### x\none\n### z\n## B\n### y\n")], "path string, text string"))
    inner = {"t": {"sections": [{"name": "A", "sections": [{"name": "x", "content": [{"kind": "paragraph", "max": 0}, {"kind": "code"}]}, {"name": "y", "required": False}]}, {"name": "C", "sections": [{"name": "y"}]}, {"name": "D", "sections": [{"name": "q"}]}]}}
    tree = templates.align(structure.sections(deep), spark.createDataFrame([("d.md", "t")], "path string, template string"), inner)
    assert rows(tree, "rule", "title", "status") == sorted([("0", "A", "match"), ("0/0", "x", "match"), ("0/1", "z", "coerced"), ("1", "B", "coerced"), ("1/0", "y", "match"), ("2", None, "missing")], key=str)
    assert rows(templates.check_content(deep, tree, inner), "rule", "message") == [("code 1", "at least 1, found 0"), ("paragraph 0", "at most 0, found 1")]
    more = structure.nodes(spark.createDataFrame([(f"{i}.md", text) for i in range(4)] + [("z.md", "## Intro\n")], "path string, text string"))
    assert rows(templates.infer(structure.sections(more)), "slug", "share", "required") == [("intro", 1.0, True), ("odd", 0.8, False), ("steps", 0.8, False)]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("a.md", 3, "k", "bad\n100%", "rule"), ("b.md", None, None, None, "r2")], "path string, line int, key string, message string, keyword string")
    assert [r.value for r in sinks.github(f).collect()] == ["::error file=a.md,line=3,title=rule::bad%0A100%25", "::error file=b.md,title=r2::"]
    sinks.write_sarif(f, str(tmp_path / "s"))
    log = json.loads(next((tmp_path / "s").glob("part-*")).read_text())
    assert [r["ruleId"] for r in log["runs"][0]["results"]] == ["rule", "r2"]
    assert [r.value for r in sinks.junit(f, f.select("path").union(spark.createDataFrame([("c.md",)], "path string"))).collect()][2] == '<testcase name="c.md"/>'
    p = spark.createDataFrame([("S", "T", "http://u", "d"), ("A", "Q", "http://q", "")], "section string, title string, url string, description string")
    assert "\n".join(r.value for r in sinks.llms_txt(p, "Docs", "all").collect()) == "# Docs\n\n> all\n## A\n- [Q](http://q)\n## S\n- [T](http://u): d"
    sinks.search_index(spark.createDataFrame([("1", "en"), ("2", None)], "id string, language string"), str(tmp_path / "i"))
    assert sorted(x.name for x in (tmp_path / "i").iterdir() if x.is_dir()) == ["language=en", "language=und"]
    sinks.export({"t": f}, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/t")).count() == 2


def test_search_by_fields_and_budget(spark):
    e = spark.createDataFrame([("1", "Install guide", "how to set up"), ("2", "Other", "installing is easy"), ("3", "Instal", "nothing"), ("4", "None", "none")], "id string, title string, text string")
    got = [r.id for r in search.fielded(e, ["install"], {"title": 3.0, "text": 1.0}).orderBy("rank").collect()]
    assert got[0] == "1" and set(got) == {"1", "2", "3"} and [r.id for r in search.fielded(e, ["install"], {"title": 1.0}, prefix=False, fuzzy=0).collect()] == ["1"]
    f = spark.createDataFrame([("q", 1, "a", "x" * 6), ("q", 2, "b", "x" * 9), ("q", 3, "c", "x" * 3), ("q", 4, "d", "\U0001f600")], "query string, rank int, id string, text string")
    assert rows(search.assemble(f, 10), "rank", "used") == [(1, True), (2, False), (3, True), (4, False)]
    q = spark.createDataFrame([(1, "How do I reset the password?"), (2, "one"), (3, "a b c d e")], "id int, text string")
    a = spark.createDataFrame([(1, "To reset the password: how do I, ..."), (3, "a b x"), (2, "one")], "id int, text string")
    assert rows(search.copied(q, a), "id", "copied", "of") == [(1, 4, 5)]


def test_redaction_equals_the_plain_patterns(spark):
    import re

    texts = ["key = abc 'x'", 'a "client_secret": "v" b', "Bearer abcdefghijklmnop==", "AKIA" + "A" * 16 + " xoxb-1234567890", "ghp_" + "a" * 20, "eyJabcdefgh.abcdefgh.abcdefgh", "nothing = here", "password='two words' tail", "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", "sk-proj-" + "a" * 20, None, ""]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.redact(F.col("t")).alias("x")).collect()]
    for t, x in zip(texts, got):
        for p, by in T.REDACTIONS:
            t = None if t is None else re.sub(p, by.replace("$1", r"\1").replace("$2", r"\2"), t)
        assert x == t


def test_numbered_slugs(spark):
    d = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 4}") for i in range(300)], "k int, slug string")
    want, seen = {}, {}
    for i in range(300):
        s = "hot" if i % 3 else f"s{i % 4}"
        seen[s] = seen.get(s, 0) + 1
        want[i] = s if seen[s] == 1 else f"{s}-{seen[s] - 1}"
    assert {r.k: r.slug for r in T.numbered_slugs(d, "k").collect()} == want


def test_context(spark):
    pages = spark.createDataFrame([("a.md", "pre\n# One\nx\n## Two\ny\nz"), ("b.md", "alone"), ("n.md", None)], "path string, text string")
    s = structure.sections(structure.nodes(pages))
    t = context.section_texts(pages, s)
    assert rows(t, "path", "section", "first", "last", "text") == [("a.md", 0, 1, 1, "pre"), ("a.md", 1, 2, 3, "# One\nx"), ("a.md", 2, 4, 6, "## Two\ny\nz"), ("b.md", 0, 1, 1, "alone")]
    p = pages.select("path", F.lit("T").alias("title"), F.lit("D").alias("description"), F.when(F.col("path") == "a.md", "en").alias("language"))
    e = context.index_entries(p, s, t)
    assert rows(e, "id", "text", "language") == [("a.md", "pre", "en"), ("a.md#one", "# One\nx", "en"), ("a.md#two", "## Two\ny\nz", "en"), ("b.md", "alone", "und"), ("n.md", "", "und")]
    nodes = spark.createDataFrame([("v:1", "Pro", "P"), ("v:2", "P", None), ("v:3", "Pro", None)], "node string, label string, notation string")
    assert rows(context.resolve_variant(spark.createDataFrame([("p",), ("PRO",), ("v:3",), ("q",)], "name string"), nodes), "name", "node") == [("PRO", "v:1"), ("p", "v:1"), ("v:3", "v:3")]
    g = spark.createDataFrame([("d1", "rdf:type", "docs:Document", "iri"), ("d1", "hasPart", "s1", "iri"), ("s1", "about", "c", "iri"), ("x", "about", "c", "iri")], "s string, p string, o string, kind string")
    assert rows(context.blame(g, spark.createDataFrame([("c",), ("d1",)], "focus string")), "focus", "doc") == [("c", "d1"), ("d1", "d1")]
    lex = spark.createDataFrame([("a", 1)], "id string, rank int")
    assert context.entry_points(lex, None, None)[1] == "lexical only: no vectors" and context.entry_points(lex, lex, "dims")[1] == "lexical only: dims"
    with pytest.raises(ValueError):
        context.entry_points(lex, None, None, "vector")
    j = spark.createDataFrame([(1, True), (None, False)], "rank int, found boolean")
    assert context.gate(j, 0.5).first().asDict() == {"questions": 2, "found_rate": 0.5, "first_rate": 0.5, "passes": True} and context.gate(j.where("false")).first().passes
    lines = spark.createDataFrame([("a", 1, "The quick  brown fox"), ("a", 2, "the lazy dog"), ("b", 1, "the lazy dog")], "page string, n int, line string")
    assert rows(context.locate(spark.createDataFrame([(1, "Quick brown"), (2, "lazy dog"), (3, "cat")], "id int, text string"), lines), "id", "page", "line") == [(1, "a", 1)]
    f = spark.createDataFrame([("p/a", "error"), ("p/b", "warning"), ("q/c", "warning")], "path string, severity string")
    pr = spark.createDataFrame([("P", "p/"), ("Q", "q/"), ("R", "rr/")], "project string, prefix string")
    assert rows(context.family_status(f, pr), "project", "status", "errors") == [("P", "error", 1), ("Q", "warning", 0), ("R", "ok", 0)]
    html = spark.createDataFrame([(1, "<html><img src=a><img alt='' src=b><h1>x</h1><h3>y</h3><a href=x> </a>")], "page_id int, html string")
    assert rows(context.access_violations(html), "rule", "n") == [("document-title", 1), ("heading-order", 1), ("html-has-lang", 1), ("image-alt", 1), ("link-name", 1)]


def test_journey_steps(spark):
    rec = spark.createDataFrame([(1, "j", 1, "journey", "J", ["p"], None), (2, "j", 2, "journey", "K", ["p"], "draft"), (3, "p", 1, "persona", "P", [], None)], "idx long, file string, line int, type string, id string, parents array<string>, lifecycle string")
    ref = spark.createDataFrame([("a.md", 1, "journey", "j")], "page string, line int, type string, value string")
    steps = spark.createDataFrame([(1, 1, None, None, None, None), (1, 2, "a.md", False, None, None), (1, 3, "a.md", True, 5, 9), (1, 4, "b.md", True, 9, 5), (2, 1, None, None, None, None)], "record long, position int, page string, written boolean, verified int, changed int")
    assert rows(strategy.step_findings(rec, steps, ref), "rule", "file", "value") == [("broken-step", "j", "1"), ("missing-journey", "b.md", "J"), ("stale-step", "j", "3"), ("unwritten-step", "j", "2")]
    f = spark.createDataFrame([("a.md", "error"), ("a.md", "warning"), ("z", "error")], "file string, severity string")
    assert rows(strategy.impact(f, strategy._naming(rec, ref), rec), "id", "errors", "warnings") == [("J", 1, 1)]


def test_stateful_turns(spark, tmp_path):
    from docloom.streaming import turns

    rows_ = [("s", f"2024-01-01 10:00:{i:02}", k) for i, k in enumerate(["tool", "prompt", "tool", "text", "prompt", "tool"])] + [("t", "2024-01-01 10:00:00", "prompt"), ("u", "2024-01-02 10:00:00", "prompt")]
    spark.createDataFrame(rows_, "session string, t string, kind string").selectExpr("session", "cast(t as timestamp) ts", "kind").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, ts timestamp, kind string").parquet(str(tmp_path / "in"))
    q = turns.turns(stream).writeStream.format("memory").queryName("turns_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("turns_out")
    assert ("s", 1, 3, False) in rows(got, "session", "turn", "events", "done") and got.where("session = 'u'").count() == 0


def test_registries(spark):
    from docloom.functions import registry

    registry.register(spark)
    r = spark.sql("SELECT line_for(map('k', 3), 'k') AS a, line_for(map('k', 3), 'z') AS b, explicit_null() AS c, slug(' A  b, Ü!') AS d, pin('x\\r\\ny\\nz', 1, 2) = sha2('x\\ny', 256) AS e").first()
    assert (r.a, r.b, r.c, r.d, r.e) == (3, None, "null", "a-b-ü", True)
    registry.add_grader("ends-with-text", lambda g: (F.when(F.max_by("kind", "index") == "text", "pass").otherwise("fail"), F.lit(g["note"])))
    e = spark.createDataFrame([("s", 1, "text"), ("t", 2, "tool")], "session string, index long, kind string")
    assert rows(traces.grade(e, {"g": {"kind": "ends-with-text", "note": "n"}}), "session", "outcome", "detail") == [("s", "pass", "n"), ("t", "fail", "n")]
    with pytest.raises(ValueError):
        registry.add_grader("cost", lambda g: None)
    registry.add_parser("txt", lambda t: [("paragraph", None, t, None, 1, 1, {})])
    assert rows(structure.nodes(spark.createDataFrame([("a.txt", "x")], "path string, text string")), "kind", "text") == [("paragraph", "x")]
    with pytest.raises(ValueError):
        registry.add_parser("md", lambda t: [])
