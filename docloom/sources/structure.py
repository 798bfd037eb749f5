"""Structure of pages as rows: headings, paragraphs, code, lists, tables, links and so on, for several formats.

nodes() returns one row for each node: path, seq (order on the page), kind, level, text, target, line, last (line), and
attrs. Kinds: heading, paragraph, code, list, item, table, blockquote, admonition, deflist, link, image, element. A page is
parsed whole in one task; a page that can't be parsed has one node of kind "error". Null texts have no nodes. The element
of an HTML page's first title has its text as the attribute "content".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.batches import pieces, table

SCHEMA = "path string, seq int, kind string, level int, text string, target string, line int, last int, attrs map<string,string>"
INLINE = re.compile(r"(!?)\[([^\]]*)\]\(\s*<?([^)\s>]*)>?(?:\s+[\"'][^\"']*[\"'])?\s*\)")
BLOCKS = [
    ("heading", re.compile(r"(#{1,6})\s+(.*?)\s*#*$")),
    ("item", re.compile(r"\s*(?:[-*+]|(\d+)[.)])\s+(.*)")),
    ("table", re.compile(r"\s*\|(.*)\|\s*$")),
    ("blockquote", re.compile(r"\s*>\s?(.*)")),
    ("admonition", re.compile(r":::\s*([a-z]+)\s*(.*)|!!!\s*([a-z]+)\s*(.*)", re.IGNORECASE)),
    ("deflist", re.compile(r":\s+(.*)")),
]
ADOC = {"heading": re.compile(r"(={1,6})\s+(.*)"), "link": re.compile(r"(?:link:|xref:)([^\[\s]+)\[([^\]]*)\]"), "image": re.compile(r"image::?([^\[\s]+)\[([^\]]*)\]")}
REFERENCE = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")
RST = {"link": re.compile(r"`([^`<]*?)\s*<([^>]+)>`_"), "image": re.compile(r"\.\.\s+(?:image|figure)::\s*(\S+)")}


def _node(kind, line, last=None, level=None, text=None, target=None, **attrs):
    return (kind, level, text, target, line, last or line, {k: str(v) for k, v in attrs.items() if v is not None})


def markdown(text: str) -> list[tuple]:
    """Nodes of a Markdown body; fenced code hides what it holds, runs of items, quotes and table rows are one node each."""
    lines, out, para, at = text.replace("\r\n", "\n").split("\n"), [], [], 0

    def flush(end: int) -> None:
        if para:
            out.append(_node("paragraph", end - len(para), end - 1, text=" ".join(para)))
            para.clear()

    while at < len(lines):
        line, n = lines[at], at + 1
        fence = re.match(r"\s*(`{3,}|~{3,})\s*([^\s`{]*)", line)
        if fence:
            flush(n)
            end = next((i for i in range(at + 1, len(lines)) if lines[i].strip().startswith(fence[1]) and not lines[i].strip().strip(fence[1][0])), len(lines))
            out.append(_node("code", n, end + 1, text="\n".join(lines[at + 1 : end]), language=fence[2] or None))
            at = end + 1
            continue
        if para and re.fullmatch(r"\s*(=+|-+)\s*", line) and len(para) == 1:
            head = para.pop()
            out.append(_node("heading", n - 1, n, 1 if "=" in line else 2, head))
            at += 1
            continue
        kind, m = next(((k, m) for k, p in BLOCKS if (m := p.match(line))), (None, None))
        if kind == "deflist" and not para:
            kind = None
        if kind is None:
            if line.strip():
                para.append(line.strip())
                out += [_node("image" if x[1] else "link", n, text=x[2], target=x[3]) for x in INLINE.finditer(line)]
            else:
                flush(n)
            at += 1
            continue
        term = para[-1] if kind == "deflist" else None
        flush(n)
        end, pattern = at + 1, dict(BLOCKS)[kind]
        if kind in ("item", "table", "blockquote", "deflist"):
            while end < len(lines) and (pattern.match(lines[end]) or kind == "item" and lines[end].startswith("  ")):
                end += 1
        held = lines[at:end]
        if kind == "heading":
            out.append(_node("heading", n, n, len(m[1]), m[2]))
        elif kind == "item":
            own = [x for x in held if pattern.match(x)]
            out.append(_node("list", n, end, text="\n".join(held), ordered=str(bool(m[1])).lower(), items=len(own)))
            out += [_node("item", at + 1 + i, level=len(x) - len(x.lstrip()), text=pattern.match(x)[2]) for i, x in enumerate(held) if pattern.match(x)]
        elif kind == "table":
            out.append(_node("table", n, end, text="\n".join(held), header="|".join(c.strip() for c in m[1].split("|")), rows=max(0, len(held) - 2)))
        elif kind == "blockquote":
            note = re.match(r"\[!(\w+)\]", m[1])
            out.append(_node("admonition" if note else "blockquote", n, end, text="\n".join(pattern.match(x)[1] for x in held), variant=note[1].lower() if note else None))
        elif kind == "admonition":
            out.append(_node("admonition", n, text=m[2] or m[4], variant=(m[1] or m[3]).lower()))
        else:
            out.append(_node("deflist", n, end, text="\n".join(pattern.match(x)[1] for x in held), term=term))
        out += [_node("image" if x[1] else "link", at + 1 + i, text=x[2], target=x[3]) for i, y in enumerate(held) for x in INLINE.finditer(y)]
        at = end
    flush(len(lines) + 1)
    return sorted(out, key=lambda x: x[4])


def asciidoc(text: str) -> list[tuple]:
    """Headings, delimited code, links, images and paragraphs of an AsciiDoc page."""
    out, code = [], None
    for n, line in enumerate(text.splitlines(), 1):
        if re.fullmatch(r"-{4,}|\.{4,}", line.strip()):
            code = n if code is None else out.append(_node("code", code, n))
        elif code is None and (m := ADOC["heading"].match(line)):
            out.append(_node("heading", n, level=len(m[1]), text=m[2]))
        elif code is None:
            out += [_node(k, n, text=m[2], target=m[1]) for k in ("link", "image") for m in ADOC[k].finditer(line)]
    return out


def rst(text: str) -> list[tuple]:
    """Headings by their underlines, in order of first use, links, images and literal blocks of a reST page."""
    lines, out, marks = text.splitlines(), [], []
    for n, line in enumerate(lines, 1):
        below = lines[n] if n < len(lines) else ""
        if line.strip() and re.fullmatch(r"([=\-~^\"'#*+`])\1{2,}", below.strip()) and len(below.rstrip()) >= len(line.rstrip()):
            marks += [] if below[0] in marks else [below[0]]
            out.append(_node("heading", n, n + 1, marks.index(below[0]) + 1, line.strip()))
        if (m := re.match(r"\.\.\s+code(?:-block)?::\s*(\S*)", line)) or line.rstrip().endswith("::") and not line.startswith(".."):
            out.append(_node("code", n, language=m[1] if m else None))
        out += [_node("link", n, text=x[1], target=x[2]) for x in RST["link"].finditer(line)] + [_node("image", n, target=x[1]) for x in RST["image"].finditer(line)]
    return out


def _plain(text: list[str]) -> str:
    """Pieces of HTML text as one, runs of white space as one space."""
    return re.sub(r"[ \t\n\f\r]+", " ", "".join(text)).strip(" ")


class _Html(HTMLParser):
    HELD = {**{f"h{i}": "heading" for i in range(1, 7)}, "p": "paragraph", "pre": "code", "ul": "list", "ol": "list", "li": "item", "table": "table", "blockquote": "blockquote", "dl": "deflist", "a": "link"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.skip = [], [], 0
        self.title, self.said = None, None  # the node of the first title, and its text while it is open

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "img":
            self.out.append(_node("image", self.getpos()[0], text=a.get("alt"), target=a.get("src")))
        elif tag == "a" and "href" not in a:
            return
        elif tag in self.HELD:
            self.open.append((tag, self.getpos()[0], a, [], len(self.out)))
            self.out.append(None)
        else:
            if tag == "title" and self.title is None:
                self.title, self.said = len(self.out), []
            self.out.append(_node("element", self.getpos()[0], text=tag, **{k: v for k, v in a.items() if k in ("id", "class", "lang", "name")}))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "title" and self.said is not None:
            self.out[self.title][-1]["content"] = _plain(self.said)
            self.said = None
        if any(x[0] == tag for x in self.open):
            while True:
                t, line, a, text, at = self.open.pop()
                self.out[at] = _node(self.HELD[t], line, self.getpos()[0], int(t[1]) if self.HELD[t] == "heading" else None, _plain(text), a.get("href"), id=a.get("id"), ordered=str(t == "ol").lower() if t in ("ul", "ol") else None)
                if self.open:
                    self.open[-1][3].append("".join(text))
                if t == tag:
                    break

    def handle_data(self, data):
        if self.said is not None:
            self.said.append(data)
        if self.open and not self.skip:
            self.open[-1][3].append(data)


def html(text: str) -> list[tuple]:
    """Nodes of an HTML page; an element left open ends with the page. Character references end in a semicolon, others are text."""
    p = _Html()
    p.feed(REFERENCE.sub("&amp;", text))
    p.close()
    for tag in [*(x[0] for x in reversed(p.open)), "title"]:
        p.handle_endtag(tag)
    return [x for x in p.out if x]


PARSERS = {"md": markdown, "mdx": markdown, "markdown": markdown, "html": html, "htm": html, "adoc": asciidoc, "asciidoc": asciidoc, "rst": rst}


def nodes(pages: DataFrame, path: str = "path", text: str = "text", kind: str | None = None) -> DataFrame:
    """The nodes of pages; the format is that of column ``kind``, or the path's extension. Unknown formats have none."""
    fmt = F.lower(F.col(kind)) if kind else F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))

    text_type, attrs = pa.string(), pa.map_(pa.string(), pa.string())
    types = (text_type, pa.int32(), text_type, pa.int32(), text_type, text_type, pa.int32(), pa.int32(), attrs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            out = []
            for p, t, f in zip(*(b.column(c).to_pylist() for c in ("path", "text", "fmt")), strict=True):
                try:
                    found = PARSERS[f](t) if f in PARSERS and t is not None else []
                except (ValueError, AssertionError, IndexError) as x:  # the standard parser raises these on broken markup
                    found = [_node("error", 1, text=str(x))]
                out += [(p, i, *x[:-1], list(x[-1].items())) for i, x in enumerate(found)]
            yield table(out, ("path", "seq", "kind", "level", "text", "target", "line", "last", "attrs"), types)

    return pages.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"), fmt.alias("fmt")).mapInArrow(run, SCHEMA)


def slug(text: Column) -> Column:
    """Lower case, runs of what isn't a letter or a digit as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def sections(found: DataFrame) -> DataFrame:
    """(path, section, level, title, slug, line, last, parent) of each heading: a section ends before the next heading; parent is the last heading above it of a lower level. Repeated slugs of a page get a number."""
    h = found.where("kind = 'heading'").select("path", "seq", F.col("level"), F.col("text").alias("title"), slug(F.col("text")).alias("base"), "line")
    w = Window.partitionBy("path").orderBy("seq")
    above = [F.last(F.when(F.col("level") == i, F.col("section")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for i in range(1, 6)]
    h = h.withColumn("section", F.row_number().over(w)).withColumn("last", F.lead("line").over(w) - 1)
    h = h.withColumn("nth", F.row_number().over(Window.partitionBy("path", "base").orderBy("seq")))
    parent = F.greatest(*(F.when(F.col("level") > i, above[i - 1]) for i in range(1, 6)))
    return h.select("path", "section", "level", "title", F.concat("base", F.when(F.col("nth") > 1, F.concat(F.lit("-"), F.col("nth") - 1)).otherwise("")).alias("slug"), "line", "last", parent.alias("parent"))


def cut_lines(text: str, most: int) -> list[str]:
    """A text cut at line ends into parts of at most so many characters; a longer line is a part of its own."""
    out, now, size = [], [], -1
    for line in text.split("\n"):
        if now and size + 1 + len(line) > most:
            out.append("\n".join(now))
            now, size = [], -1
        now.append(line)
        size += 1 + len(line)
    out.append("\n".join(now))
    return out


def split_body(docs: DataFrame, most: int = 12_000, path: str = "path", text: str = "text") -> DataFrame:
    """(path, part, text): cut_lines() of each text, in time that grows with its length. Parts joined by line feeds give the text again; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            parts = [cut_lines(t, most) for t in b.column("text").to_pylist()]
            which = pa.array([i for i, xs in enumerate(parts) for _ in xs], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("path").take(which), pa.array([i for xs in parts for i in range(len(xs))], pa.int32()), pa.array([x for xs in parts for x in xs], pa.string())], names=["path", "part", "text"])

    kind = docs.select(F.col(path)).schema[0].dataType.simpleString()
    return docs.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, f"path {kind}, part int, text string")
