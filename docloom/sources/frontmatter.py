"""Metadata of text files: one (_path, _format, _present, _data, body_line, lines, error) row for each file.

Markdown has front matter (YAML, TOML, JSON), AsciiDoc attributes, reST a docinfo or field list. ``lines`` gives the line
of each top-level key. A block that can't be parsed leaves {} and its message in ``error``; it ends no job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FENCE = {"---": "yaml", "+++": "toml", ";;;": "json"}
IGNORED = "/(node_modules|[.]git)/"


def split_front_matter(text: str) -> tuple[str | None, str, int]:
    """Kind and source of the block, and the first line of the body, from 1."""
    lines = text.removeprefix("﻿").replace("\r\n", "\n").split("\n")
    kind = FENCE.get(lines[0].rstrip())
    if kind:
        for i, x in enumerate(lines[1:], 1):
            if x.rstrip() == lines[0].rstrip():
                return kind, "\n".join(lines[1:i]), i + 2
    return None, "", 1


def parse(kind: str, source: str) -> dict:
    """The block's mapping; dates become ISO text."""
    if kind == "json":
        data = json.loads(source)
    elif kind == "toml":
        import tomllib

        data = tomllib.loads(source)
    else:
        import yaml

        data = yaml.safe_load(source)
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ValueError("front matter must be a mapping")
    return json.loads(json.dumps(data, default=str, ensure_ascii=False))


def key_lines(kind: str, source: str, first: int = 2) -> dict[str, int]:
    """The line of each top-level key of a block that starts below line ``first - 1``."""
    pattern = {"yaml": r"""^["']?([^\s#"':][^"':]*)["']?\s*:""", "toml": r"""^\[*["']?([\w.-]+)["']?\]*\s*(?:=|$)""", "json": r"""^\s{0,4}"([^"]+)"\s*:"""}[kind]
    out: dict[str, int] = {}
    for i, x in enumerate(source.split("\n")):
        if m := re.match(pattern, x):
            out.setdefault(m[1], first + i)
    return out


def asciidoc_attributes(text: str) -> tuple[dict, dict[str, int], int]:
    """Document title and attributes of an AsciiDoc header, their lines, and the first line of the body."""
    data, at, n = {}, {}, 0
    lines = text.removeprefix("\ufeff").replace("\r\n", "\n").split("\n")
    for n, x in enumerate(lines, 1):
        if m := re.match(r"=\s+(.*)", x):
            data["title"], at["title"] = m[1].strip(), n
        elif m := re.match(r":(!?)([\w-]+)(!?):\s*(.*)", x):
            if m[1] or m[3]:
                data.pop(m[2], None)
            else:
                data[m[2]], at[m[2]] = scalar(m[4].strip()), n
        elif not x.startswith("//") and (not x.strip() and data or x.strip() and n > 3):
            break
    return data, at, n


def rst_fields(text: str) -> tuple[dict, dict[str, int], int]:
    """The field list at the start of a reST page (after a title), as a mapping; continuation lines are joined."""
    data, at, last, n = {}, {}, None, 0
    lines = text.removeprefix("\ufeff").replace("\r\n", "\n").split("\n")
    for n, x in enumerate(lines, 1):
        if m := re.match(r":([^:]+):\s*(.*)", x):
            last = m[1].strip()
            data[last], at[last] = m[2].strip(), n
        elif last and re.match(r"\s+\S", x):
            data[last] = f"{data[last]} {x.strip()}".strip()
        elif data and x.strip():
            break
        elif n > 6 and not data:
            break
    return {k: scalar(v) for k, v in data.items()}, at, n


def scalar(text: str):
    """A value of untyped markup: as a YAML scalar or flow collection, else the text."""
    import yaml

    try:
        v = yaml.safe_load(text) if text else ""
    except yaml.YAMLError:
        return text
    if isinstance(v, dict) and not text.startswith("{") or isinstance(v, list) and not text.startswith("["):
        return text
    return json.loads(json.dumps(v, default=str))


FORMATS = {"md": "markdown", "mdx": "mdx", "adoc": "asciidoc", "asciidoc": "asciidoc", "rst": "rst"}


def extract(path: str, text: str) -> tuple[str, str, bool, str, int, dict[str, int], str | None]:
    form = FORMATS.get(path.rsplit(".", 1)[-1].lower(), "markdown")
    if form in ("asciidoc", "rst"):
        data, at, line = (asciidoc_attributes if form == "asciidoc" else rst_fields)(text)
        return path, form, bool(data), json.dumps(data, ensure_ascii=False), line, at, None
    kind, source, line = split_front_matter(text)
    try:
        data, error = parse(kind, source) if kind else {}, None
    except Exception as x:  # noqa: BLE001  # each of the three parsers has errors of its own; one bad file must not end the job
        data, error = {}, f"{type(x).__name__}: {x}"[:500]
    return path, form, kind is not None, json.dumps(data, ensure_ascii=False), line, key_lines(kind, source) if kind else {}, error


SCHEMA = "_path string, _format string, _present boolean, _data string, body_line int, lines map<string,int>, error string"


def from_texts(files: DataFrame) -> DataFrame:
    """Metadata of (path, text) rows, for instance of standard input under the path <stdin>."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            yield pd.DataFrame([extract(p, t or "") for p, t in zip(b["path"], b["text"], strict=True)], columns=names)

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def gitignored(path: str, rules: list[tuple[str, str]]) -> bool:
    """Whether the last matching rule (folder, pattern) ignores a path; ! takes back, / anchors, a trailing / means folders."""
    ignored = False
    for folder, rule in rules:
        if folder and not path.startswith(folder + "/"):
            continue
        rest, keep = path[len(folder) + 1 if folder else 0 :], rule.startswith("!")
        body = rule.lstrip("!").rstrip("/")
        anchored = "/" in body
        pattern = re.compile(_glob(body.lstrip("/")))
        parts = rest.split("/")
        whole = range(1, len(parts) + (0 if rule.endswith("/") else 1))
        names = ["/".join(parts[:i]) for i in whole] if anchored else parts[: len(whole)]
        if any(pattern.fullmatch(x) for x in names):
            ignored = not keep
    return ignored


def _glob(text: str) -> str:
    """A pattern of gitignore as a regular expression: ** over folders, * and ? within one."""
    out = ""
    for x in re.split(r"(/\*\*/|\*\*/|/\*\*|\*|\?|\[[^\]]*\])", text):
        out += {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(x) or (x if x.startswith("[") else re.escape(x))
    return out


def read(spark: SparkSession, path: str | list[str], glob: str = "*.{md,mdx}", exclude: list[str] = (), ignore: list[tuple[str, str]] = (), root: str = "") -> DataFrame:
    """All files below folders, or files, or what globs name, in order of path; ignored folders don't count, nor excluded globs and .gitignore rules (folder, pattern), taken below ``root``. No file at all is an error, unlike no row of a query."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    own = F.regexp_replace(F.col("path"), "^" + re.escape(root), "") if root else F.col("path")
    files = files.where(~F.col("path").rlike(IGNORED)).select("path", own.alias("own"), F.col("content").cast("string").alias("text"))
    for g in exclude:
        files = files.where(~F.col("own").rlike("^" + _glob(g) + "$"))
    if ignore:
        rules = list(ignore)

        @F.pandas_udf("boolean")
        def hidden(p: pd.Series) -> pd.Series:
            return p.map(lambda x: gitignored(x.lstrip("/"), rules))

        files = files.where(~hidden("own"))
    if files.select("path").limit(1).isEmpty():
        raise FileNotFoundError(f"no documents in {path}")
    return from_texts(files)


def line_for(lines: Column, key: str) -> Column:
    """The line of a key; null where there is none."""
    return F.element_at(lines, key)


def set_key(text: str, key: str, value: str | None) -> str:
    """The file with one top-level YAML key set, or removed where value is None; all other bytes stay, line ends too.

    A key's lines are its own and those below it that are indented more or blank, up to the next line at its level.
    """
    nl = "\r\n" if "\r\n" in text else "\n"
    new = [] if value is None else [f"{key}: {value}{nl}"]
    kind, _, body = split_front_matter(text)
    if kind is None:
        return text if value is None else "".join([f"---{nl}", *new, f"---{nl}", text])
    if kind != "yaml":
        raise ValueError("only YAML blocks are written")
    lines = text.splitlines(keepends=True) if "\r\n" in text else re.findall(r"[^\n]*\n|[^\n]+$", text)
    end = body - 2  # the closing fence
    own = re.compile(rf"[\"']?{re.escape(key)}[\"']?\s*:(\s|$)")
    for i in range(1, end):
        if own.match(lines[i]):
            j = i + 1
            while j < end and (not lines[j].strip() or lines[j][:1] in " \t" or lines[j].startswith("- ")):
                j += 1
            while j > i + 1 and not lines[j - 1].strip() and not lines[i].rstrip().endswith(("|", ">", "|-", ">-", "|+", ">+")):
                j -= 1  # blank lines before the next key stay, unless they end a block of text
            return "".join([*lines[:i], *new, *lines[j:]])
    return "".join([*lines[:end], *new, *lines[end:]])
