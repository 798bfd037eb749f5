"""Triples of pages: none of the rules is left out."""

from docloom.plans import pages


def test_triples_from_pages_are_whole(spark, tmp_path):
    html = [
        (1, '<html lang="en"><head><title> A &amp;\nB</title></head><h1>One</h1><svg><title>no</title></svg><a href="/x">a</a><a href="/X?q#f">b</a><a href="/Y-z">c</a><a href="/gone">d</a><a href="https://e.org/">e</a></html>'),
        (2, '<html><head><title></title></head><h1>!!!</h1><h2></h2><a href="/y_z">a</a><a href="/odd/">b</a></html>'),
        (3, '<html lang="de"><title>C</title><h1>Three</h1><a href="/odd">a</a>'),
        (4, None),
    ]
    spark.createDataFrame(html, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {}
    for r in pages._page_triples(spark, str(tmp_path)).collect():
        got.setdefault(r.p, set()).add((r.s.removeprefix("https://example.org/"), r.o.removeprefix("https://example.org/")) + ((r.lang,) if r.lang else ()))
    assert got["dcterms:references"] == {("1", "x"), ("1", "y_z"), ("2", "y_z"), ("2", "odd"), ("3", "odd")}
    assert got["docs:brokenLink"] == {("1", "/gone")} and got["rdfs:seeAlso"] == {("1", "https://e.org/")}
    assert {("1", "A & B", "en"), ("1#one", "One"), ("2#", "!!!")} < got["dcterms:title"]
    assert not {"2", "4"} & {s for s, *_ in got["dcterms:title"]}  # an empty title is none
    assert got["dcterms:hasPart"] == {("1", "1#one"), ("2", "2#"), ("3", "3#three")} and got["docs:level"] == {("1#one", "1"), ("2#", "1"), ("3#three", "1")}
    assert {r.p: r.n for r in pages.triples_from_pages(spark, str(tmp_path)).collect()} == {p: len(x) for p, x in got.items()}
