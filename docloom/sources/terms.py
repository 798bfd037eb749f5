"""Glossaries of many formats as one table of terms, and that table written as any of them.

Readers take (file, text) and return rows (file, pos, id, language, label, alt, hidden, definition, abstract, see, broader,
narrower, related, status, exact); number() makes the table that docloom.operators.glossary checks. Markup is taken apart
by patterns and XPath on the JVM. Entries without a label are left out; without an id, the label's slug is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.structure import slug

LISTS = ("alt", "hidden", "broader", "narrower", "related", "exact")
TEXTS = ("id", "language", "label", "definition", "abstract", "see", "status")
#: Keys of a term's record in pages and manifests, by our column.
KEYS = {"label": "label", "id": "id", "language": "language", "definition": "definition", "abstract": "abstract", "see": "see", "alt": "alt-labels", "hidden": "hidden-labels", "broader": "broader", "narrower": "narrower", "related": "related-terms", "exact": "exact-match"}


def _rows(d: DataFrame, **have: Column) -> DataFrame:
    """The common columns; those that a format lacks are null or empty."""
    clean = lambda c: F.nullif(F.btrim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    texts = {c: clean(have[c].cast("string")) if c in have else F.lit(None).cast("string") for c in TEXTS}
    lists = {c: F.filter(F.transform(have[c], clean), lambda x: x.isNotNull()) if c in have else F.array().cast("array<string>") for c in LISTS}
    out = d.select("file", F.col("pos").cast("int").alias("pos"), *(v.alias(c) for c, v in {**texts, **lists}.items())).where("label is not null")
    return out.withColumn("id", F.coalesce("id", slug(F.col("label"))))


def number(rows: DataFrame) -> DataFrame:
    """Terms in set order (file, then place), as the glossary rules read them."""
    d = rows.withColumn("idx", F.xxhash64("file", "pos", "language", "label")).withColumn("line", F.col("pos"))
    d = d.repartitionByRange(F.col("file"), F.col("pos")).sortWithinPartitions("file", "pos", "language", "label").withColumn("idx", F.monotonically_increasing_id())
    one = F.when(F.col("status").isNotNull(), F.array(F.struct(F.col("label").alias("term"), F.col("status").alias("status")))).otherwise(F.array().cast("array<struct<term:string,status:string>>"))
    return d.withColumn("designations", one).withColumn("matches", F.transform("exact", lambda x: F.struct(F.lit("exact").alias("kind"), x.alias("iri"))))


def _record(d: DataFrame, data: Column) -> DataFrame:
    """Rows of JSON records; a list may be given as one text."""
    m = F.from_json(data, "map<string,string>")
    many = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    have = {c: (many(F.element_at(m, k)) if c in LISTS else F.element_at(m, k)) for c, k in KEYS.items()}
    return _rows(d, **have)


def pages(docs: DataFrame) -> DataFrame:
    """Term pages, of (_path, _data): the record is the front matter; the file's name is the id where there is none."""
    stem = F.regexp_extract("_path", r"([^/]+?)(\.[a-z]+)?$", 1)
    d = docs.select(F.col("_path").alias("file"), F.lit(1).alias("pos"), "_data", stem.alias("stem"))
    own = F.from_json("_data", "map<string,string>")
    own = F.map_filter(own, lambda _, v: v.isNotNull())
    usual = F.map_filter(F.create_map(F.lit("id"), F.col("stem"), F.lit("label"), F.element_at(own, "title")), lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k))
    with_id = F.to_json(F.map_concat(usual, own))
    return _record(d.withColumn("_data", with_id), F.col("_data"))


def manifest(docs: DataFrame) -> DataFrame:
    """Manifests, of (_path, _data): a list "terms" of records."""
    each = F.from_json(F.element_at(F.from_json("_data", "map<string,string>"), "terms"), "array<map<string,string>>")
    d = docs.select(F.col("_path").alias("file"), F.posexplode(each).alias("pos", "m"))
    return _record(d.select("file", (F.col("pos") + 1).alias("pos"), F.to_json("m").alias("_data")), F.col("_data"))


def deflist(nodes: DataFrame) -> DataFrame:
    """Definition lists of Markdown, from the structure's nodes."""
    d = nodes.where("kind = 'deflist'").select(F.col("path").alias("file"), F.col("line").alias("pos"), F.col("attrs")["term"].alias("term"), "text")
    return _rows(d, label=F.col("term"), definition=F.col("text"))


def _matched(texts: DataFrame, pattern: str, **groups: int) -> DataFrame:
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    d = texts.select("file", F.posexplode(whole).alias("pos", "m"))
    return _rows(d, **{c: F.regexp_extract("m", pattern, g) for c, g in groups.items()})


def rst_glossary(texts: DataFrame) -> DataFrame:
    """Entries below a glossary directive: terms three columns in, definitions further in."""
    block = F.regexp_extract("text", r"(?s)\.\. glossary::[^\n]*\n(.*?)(?:\n\S|$)", 1)
    return _matched(texts.select("file", F.concat(block, F.lit("\n")).alias("text")), r"(?m)^ {3}([^\s:][^\n]*)\n((?: {4,}[^\n]*\n)+)", label=1, definition=2)


def asciidoc_glossary(texts: DataFrame) -> DataFrame:
    return _matched(texts, r"(?m)^([^\s:=/][^\n:]*)::[ \t]*\n?[ \t]*([^\n]+)", label=1, definition=2)


def _plain(c: Column) -> Column:
    text = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def html_dl(texts: DataFrame) -> DataFrame:
    pattern = r"(?is)<dt\b[^>]*?(?:id=\"([^\"]*)\")?[^>]*>(.*?)</dt>\s*<dd\b[^>]*>(.*?)</dd>"
    d = texts.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "m"))
    return _rows(d, id=F.regexp_extract("m", pattern, 1), label=_plain(F.regexp_extract("m", pattern, 2)), definition=_plain(F.regexp_extract("m", pattern, 3)))


def html_dfn(texts: DataFrame) -> DataFrame:
    """Terms that running text defines: the sentence's paragraph is the definition."""
    pattern = r"(?is)<p\b[^>]*>((?:(?!</p>).)*<dfn\b[^>]*>(.*?)</dfn>(?:(?!</p>).)*)</p>"
    d = texts.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "m"))
    return _rows(d, label=_plain(F.regexp_extract("m", pattern, 2)), definition=_plain(F.regexp_extract("m", pattern, 1)))


def _blocks(texts: DataFrame, tag: str) -> DataFrame:
    """Elements of one or another name, without name spaces, in order."""
    bare = F.regexp_replace(F.regexp_replace("text", r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", ""), r"(</?|\s)\w+:(?=[\w-]+[\s=/>])", "$1")
    found = F.regexp_extract_all(bare, F.lit(rf"(?s)<({tag})\b[^>]*>.*?</\1>"), F.lit(0))
    return texts.select("file", F.posexplode(found).alias("pos", "x"))


def _texts(path: str) -> Column:
    return F.xpath("x", F.lit(path))


def dita(texts: DataFrame) -> DataFrame:
    """DITA glossentry topics, alone or in a glossgroup."""
    return _rows(_blocks(texts, "glossentry"), id=F.xpath_string("x", F.lit("/*/@id")), label=F.xpath_string("x", F.lit("/*/glossterm")), definition=F.xpath_string("x", F.lit("/*/glossdef")), alt=_texts("//glossAlt/*[self::glossSynonym or self::glossAcronym or self::glossAbbreviation]/text()"), language=F.xpath_string("x", F.lit("/*/@lang")))


def docbook(texts: DataFrame) -> DataFrame:
    return _rows(_blocks(texts, "glossentry"), id=F.xpath_string("x", F.lit("/*/@id")), label=F.xpath_string("x", F.lit("/*/glossterm")), definition=F.xpath_string("x", F.lit("/*/glossdef")), see=F.xpath_string("x", F.lit("/*/glosssee/@otherterm")), related=_texts("/*/glossdef/glossseealso/@otherterm"), alt=_texts("/*/acronym/text()|/*/abbrev/text()"))


def tbx(texts: DataFrame) -> DataFrame:
    """TBX 2 (termEntry, langSet, tig) and 3 (conceptEntry, langSec, termSec): a row for each language; the first term is the label."""
    e = _blocks(texts, "termEntry|conceptEntry")
    langs = F.regexp_extract_all("x", F.lit(r"(?s)<(langSet|langSec)\b[^>]*>.*?</\1>"), F.lit(0))
    d = e.select("file", "pos", F.xpath_string("x", F.lit("/*/@id")).alias("eid"), F.xpath_string("x", F.lit("/*/descrip[@type='definition']|/*/descripGrp/descrip[@type='definition']")).alias("whole"), F.explode(langs).alias("x"))
    terms = _texts("//term/text()")
    own = F.nullif(F.xpath_string("x", F.lit("//descrip[@type='definition']")), F.lit(""))
    status = F.regexp_replace(F.xpath_string("x", F.lit("(//termNote[@type='administrativeStatus'])[1]")), r"Term(-admn-sts)?$", "")
    return _rows(d, id=F.col("eid"), language=F.xpath_string("x", F.lit("/*/@lang")), label=F.get(terms, F.lit(0)), alt=F.slice(terms, F.lit(2), F.greatest(F.size(terms) - 1, F.lit(0))), definition=F.coalesce(own, F.col("whole")), status=status)


def flare(texts: DataFrame) -> DataFrame:
    terms = _texts("/*/Terms/Term/text()")
    return _rows(_blocks(texts, "GlossaryEntry"), label=F.get(terms, F.lit(0)), alt=F.slice(terms, F.lit(2), F.greatest(F.size(terms) - 1, F.lit(0))), definition=F.xpath_string("x", F.lit("/*/Definition")))


def skos(triples: DataFrame, file: str = "skos") -> DataFrame:
    """Concepts of a graph (s, p, o, kind, lang), a row for each language of their labels."""
    t = triples.where(F.col("p").startswith("skos:"))
    pick = lambda p: F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o"))))
    said = t.where("p in ('skos:prefLabel', 'skos:altLabel', 'skos:hiddenLabel', 'skos:definition')").groupBy("s", "lang").agg(F.min(F.when(F.col("p") == "skos:prefLabel", F.col("o"))).alias("label"), pick("skos:altLabel").alias("alt"), pick("skos:hiddenLabel").alias("hidden"), F.min(F.when(F.col("p") == "skos:definition", F.col("o"))).alias("definition"))
    tied = t.groupBy("s").agg(F.min(F.when(F.col("p") == "skos:notation", F.col("o"))).alias("id"), pick("skos:broader").alias("b"), pick("skos:narrower").alias("n"), pick("skos:related").alias("r"), pick("skos:exactMatch").alias("exact"))
    local = lambda c: F.transform(c, lambda x: F.regexp_extract(x, r"([^/#]+)$", 1))
    d = said.join(tied, "s").select(F.lit(file).alias("file"), F.lit(0).alias("pos"), "*")
    return _rows(d, id=F.coalesce("id", F.regexp_extract("s", r"([^/#]+)$", 1)), language=F.col("lang"), label=F.col("label"), alt=F.col("alt"), hidden=F.col("hidden"), definition=F.col("definition"), broader=local("b"), narrower=local("n"), related=local("r"), exact=F.col("exact"))


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def entries(terms: DataFrame, kind: str) -> DataFrame:
    """(idx, value): each term as an entry of a format: markdown, mdx, asciidoc, rst, html, dita, docbook, tbx2, tbx3."""
    label, text, own = F.col("label"), F.coalesce("definition", F.lit("")), F.col("id")
    x = _xml(text)
    alts = lambda before, after: F.array_join(F.transform("alt", lambda a: F.concat(F.lit(before), _xml(a), F.lit(after))), "")
    lang = F.coalesce("language", F.lit("und"))
    forms = {
        "markdown": F.concat(label, F.lit("\n: "), text, F.lit("\n")),
        "asciidoc": F.concat(label, F.lit(":: "), text),
        "rst": F.concat(F.lit("   "), label, F.lit("\n      "), text, F.lit("\n")),
        "html": F.concat(F.lit('<dt id="'), _xml(own), F.lit('">'), _xml(label), F.lit("</dt>\n<dd>"), x, F.lit("</dd>")),
        "dita": F.concat(F.lit('<glossentry id="'), _xml(own), F.lit('"><glossterm>'), _xml(label), F.lit("</glossterm><glossdef>"), x, F.lit("</glossdef>"), F.when(F.size("alt") > 0, F.concat(F.lit("<glossBody>"), alts("<glossAlt><glossSynonym>", "</glossSynonym></glossAlt>"), F.lit("</glossBody>"))).otherwise(""), F.lit("</glossentry>")),
        "docbook": F.concat(F.lit('<glossentry xml:id="'), _xml(own), F.lit('"><glossterm>'), _xml(label), F.lit("</glossterm>"), F.when(F.col("see").isNotNull(), F.concat(F.lit('<glosssee otherterm="'), _xml(F.col("see")), F.lit('"/>'))).otherwise(F.concat(F.lit("<glossdef><para>"), x, F.lit("</para></glossdef>"))), F.lit("</glossentry>")),
        "tbx2": F.concat(F.lit('<termEntry id="'), _xml(own), F.lit('"><langSet xml:lang="'), lang, F.lit('"><descrip type="definition">'), x, F.lit("</descrip><tig><term>"), _xml(label), F.lit("</term></tig>"), alts("<tig><term>", "</term></tig>"), F.lit("</langSet></termEntry>")),
        "tbx3": F.concat(F.lit('<conceptEntry id="'), _xml(own), F.lit('"><langSec xml:lang="'), lang, F.lit('"><descripGrp><descrip type="definition">'), x, F.lit("</descrip></descripGrp><termSec><term>"), _xml(label), F.lit("</term></termSec>"), alts("<termSec><term>", "</term></termSec>"), F.lit("</langSec></conceptEntry>")),
    }
    return terms.select("idx", forms["markdown" if kind == "mdx" else kind].alias("value"))


#: What stands before and after the entries of a document.
FRAMES = {
    "asciidoc": ("[glossary]", ""),
    "dita": ('<glossgroup id="glossary"><title>Glossary</title>', "</glossgroup>"),
    "docbook": ('<glossary xmlns="http://docbook.org/ns/docbook" version="5.0">', "</glossary>"),
    "html": ("<dl>", "</dl>"),
    "markdown": ("# Glossary\n", ""),
    "mdx": ("# Glossary\n", ""),
    "rst": (".. glossary::\n", ""),
    "tbx2": ('<martif type="TBX"><text><body>', "</body></text></martif>"),
    "tbx3": ('<tbx type="TBX-Basic" style="dca" xmlns="urn:iso:std:iso:30042:ed-2"><text><body>', "</body></text></tbx>"),
}


def document(terms: DataFrame, kind: str) -> DataFrame:
    """(value) lines of a whole glossary in set order; write with .coalesce(1).write.text() where one file is wanted."""
    head, tail = FRAMES[kind]
    ends = terms.sparkSession.createDataFrame([(-1, head), *([(2**62, tail)] if tail else [])], "idx long, value string")
    return entries(terms, kind).unionByName(ends).orderBy("idx").select("value")


def term_pages(terms: DataFrame) -> DataFrame:
    """(path, text) of a Markdown page for each term, its record as front matter; values are JSON, which YAML reads."""
    pairs = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{KEYS[c]}: "), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))) for c in ("label", "id", "language", "definition", "abstract", "see")]
    pairs += [F.when(F.size(c) > 0, F.concat(F.lit(f"{KEYS[c]}: "), F.to_json(c))) for c in LISTS]
    text = F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*pairs)), "\n"), F.lit("\n---\n"))
    return terms.select(F.concat(F.lit("terms/"), slug(F.col("id")), F.when(F.col("language").isNotNull(), F.concat(F.lit("."), F.lower("language"))).otherwise(""), F.lit(".md")).alias("path"), text.alias("text"))


def csv_rows(terms: DataFrame) -> DataFrame:
    """One flat row a term, lists joined by |; write with .write.csv()."""
    return terms.select("id", "language", "label", *(F.array_join(c, "|").alias(KEYS[c]) for c in LISTS), "definition", "abstract", "see")


def vale(terms: DataFrame) -> DataFrame:
    """(value) lines of a Vale substitution rule: what not to write, and the label instead; and of a vocabulary of labels."""
    wrong = terms.where("see is null").select("label", F.explode(F.concat("hidden", F.when(F.col("status").isin("deprecated", "superseded"), F.array("label")).otherwise(F.array().cast("array<string>")))).alias("bad")).where("lower(bad) <> lower(label)")
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    lines = wrong.groupBy("bad").agg(F.min("label").alias("label")).select(F.lit(1).alias("o"), F.concat(F.lit("  "), quoted(F.col("bad")), F.lit(": "), quoted(F.col("label"))).alias("value"))
    head = terms.sparkSession.createDataFrame([(0, "extends: substitution\nmessage: Use '%s' instead of '%s'.\nlevel: warning\nignorecase: true\nswap:")], "o int, value string")
    return head.unionByName(lines).orderBy("o", "value").select("value")


def read_all(texts: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Terms of files of all kinds: texts (file, text) by extension, docs (_path, _data) of pages and manifests, nodes of Markdown."""
    ext = lambda *x: texts.where(F.lower(F.regexp_extract("file", r"\.(\w+)$", 1)).isin(*x))
    xml = ext("xml", "dita", "tbx", "flglo")
    parts = [pages(docs), manifest(docs), deflist(nodes), rst_glossary(ext("rst")), asciidoc_glossary(ext("adoc")), html_dl(ext("html")), html_dfn(ext("html")), dita(xml.where(F.contains("text", F.lit("glossAlt")) | ~F.contains("text", F.lit("<para")))), docbook(xml.where(F.contains("text", F.lit("<para")))), tbx(xml), flare(xml)]
    return number(reduce(DataFrame.unionByName, parts))
