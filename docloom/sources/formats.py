"""Other sources as tables: XML metadata, sitemaps, JSON pointers, vector files, Git logs, manifests, commands."""

from __future__ import annotations

import json
import struct
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where DITA and DocBook keep what front matter would say: key -> XPath.
LIFTS = {
    "title": "/*/title/text()|/*/info/title/text()",
    "abstract": "/*/shortdesc/text()|/*/info/abstract/para/text()",
    "author": "/*/prolog/author/text()|/*/info/author/personname/text()",
    "keywords": "/*/prolog/metadata/keywords/keyword/text()|/*/info/keywordset/keyword/text()",
    "id": "/*/@id",
    "lang": "/*/@*[local-name()='lang']",
}


def xml_metadata(docs: DataFrame, lifts: dict[str, str] = LIFTS, path: str = "path", text: str = "text") -> DataFrame:
    """(path, key, values) of each element path that a document answers; documents that aren't XML have none. Name spaces are dropped before."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), r"^\s*<\?xml[^>]*\?>|<!DOCTYPE[^>\[]*(\[[^\]]*\])?\s*>", ""), r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", ""), r"(</?|\s)\w+:(?=[\w-]+[\s=/>])", "$1")
    ok = F.coalesce(F.col(text).rlike(r"^\s*(<\?xml|<!DOCTYPE|<\w)"), F.lit(False))
    d = docs.where(ok).select(F.col(path).alias("path"), plain.alias("x"))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.xpath("x", F.lit(p)).alias("values")) for k, p in lifts.items()))
    return d.select("path", F.explode(pairs).alias("y")).select("path", "y.*").where(F.size("values") > 0)


def lift_key(xpath: str) -> str:
    """The column name of an element path: its names joined by dots, attributes as @name."""
    return ".".join(p for p in xpath.replace("text()", "").strip("/").split("/") if p and p != "*")


def sitemap(texts: DataFrame) -> DataFrame:
    """(source, kind, loc, lastmod) of sitemaps (source, text): pages, and the sitemaps that an index names."""
    x = F.regexp_replace("text", r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')|^\s*<\?xml[^>]*\?>", "")
    block = F.regexp_extract_all(x, F.lit(r"(?s)<(url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(0))
    d = texts.select("source", F.explode(block).alias("b"))
    part = lambda tag: F.nullif(F.btrim(F.regexp_extract("b", rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    loc = F.replace(part("loc"), F.lit("&amp;"), F.lit("&"))
    return d.select("source", F.when(F.startswith("b", F.lit("<sitemap>")), "sitemap").otherwise("page").alias("kind"), loc.alias("loc"), part("lastmod").alias("lastmod")).where("loc is not null")


def unescape_pointer(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def escape_pointer(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def descend(data: Column, pointer: str) -> Column:
    """The JSON text at a JSON pointer; numbers index arrays. Null where nothing is there."""
    v = F.try_parse_json(data)
    for part in pointer.split("/")[1:]:
        k = part.replace("~1", "/").replace("~0", "~")
        by_key = F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), k)
        v = F.coalesce(F.get(F.try_variant_get(v, "$", "array<variant>"), F.lit(int(k))), by_key) if k.isdigit() else by_key
    return F.to_json(v)


MAGIC, VERSION = b"MGRV", 2


def encode_vectors(header: dict, rows: list[list[float]]) -> bytes:
    """A vector file: magic, version and header size as 32-bit integers, the header as JSON, then rows of float32."""
    head = json.dumps(header).encode()
    return MAGIC + struct.pack("<II", VERSION, len(head)) + head + b"".join(struct.pack(f"<{len(r)}f", *r) for r in rows)


def decode_vectors(files: DataFrame) -> DataFrame:
    """(path, id, v, model) of vector files (path, content); another magic, version or size is an error that names the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                c = bytes(c)
                version, size = struct.unpack_from("<II", c, 4) if len(c) >= 12 else (0, 0)
                if c[:4] != MAGIC or version != VERSION:
                    raise ValueError(f"{p}: not a vector file of version {VERSION}")
                head = json.loads(c[12 : 12 + size])
                v = np.frombuffer(c[12 + size :], "<f4").reshape(-1, head["dims"])
                if len(v) != len(head["ids"]):
                    raise ValueError(f"{p}: {len(v)} rows for {len(head['ids'])} ids")
                yield pd.DataFrame({"path": p, "id": head["ids"], "v": list(v), "model": head.get("model")})

    return files.select("path", "content").mapInPandas(run, "path string, id string, v array<float>, model string")


def vector_mismatch(headers: DataFrame, model: str, dims: int, source: str) -> DataFrame:
    """(path, reason) of headers (path, model, dims, source) that don't fit what a search needs."""
    reason = F.when(F.col("model") != model, "model").when(F.col("dims") != dims, "dims").when(F.col("source") != source, "stale source")
    return headers.select("path", reason.alias("reason")).where("reason is not null")


def git_changes(spark: SparkSession, repository: str, log: str | None = None) -> DataFrame:
    """(commit long, hash, day, email, name, path) of a repository's first-parent history, oldest first, from `git log`."""
    if log is None:
        log = subprocess.run(["git", "-C", repository, "log", "--first-parent", "--reverse", "--name-only", "--date=short", "--pretty=format:%x01%H%x02%cd%x02%ae%x02%an"], capture_output=True, text=True, check=True, timeout=600).stdout
    rows = []
    for n, block in enumerate(log.split("\x01")[1:]):
        head, *paths = block.strip("\n").split("\n")
        rows += [(n, *head.split("\x02"), p) for p in paths if p]
    return spark.createDataFrame(rows, "commit long, hash string, day string, email string, name string, path string")


def authorship(changes: DataFrame) -> DataFrame:
    """(path, created, updated, authors) of Git changes: authors once each by address, oldest first, without robots."""
    own = changes.where(~F.col("name").contains("[bot]")).groupBy("path", F.lower("email").alias("e")).agg(F.min("commit").alias("c"), F.min_by("name", "commit").alias("name"))
    who = own.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "name"))), lambda x: x["name"]).alias("authors"))
    return changes.groupBy("path").agg(F.min_by("day", "commit").alias("created"), F.max_by("day", "commit").alias("updated")).join(who, "path", "left")


def porcelain(text: DataFrame) -> DataFrame:
    """(status, path) of lines (value) of `git status --porcelain`: of a rename the new path; quotes dropped."""
    rest = F.regexp_replace(F.substr("value", F.lit(4)), "^.* -> ", "")
    return text.where(F.length("value") > 3).select(F.btrim(F.substr("value", F.lit(1), F.lit(2))).alias("status"), F.regexp_replace(rest, '^"|"$', "").alias("path"))


def codeowners(text: str) -> list[tuple[str, str, str]]:
    """(section, glob, owners) rules of a CODEOWNERS file, in order; a section's default owners stand where a rule has none."""
    section, default, out = "", "", []
    for line in text.splitlines():
        line = line.split(" #")[0].strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith(("[", "^[")):
            name, _, rest = line.lstrip("^").partition("]")
            section, default = name[1:], rest.split("]")[-1].strip()
            continue
        glob, *owners = line.replace("\\ ", "\0").split()
        glob = glob.replace("\0", " ")
        body = glob.strip("/")
        full = body if glob.startswith("/") or "/" in body else f"**/{body}"
        out.append((section, full + "/**" if glob.endswith("/") else full, " ".join(owners) or default))
    return out


def owners(paths: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(path, owners): the last matching rule of each section, all sections together; a pattern also covers what lies below it."""
    from docloom.functions.text import matches_any

    per = []
    for name in dict.fromkeys(s for s, _, _ in rules):
        pick = F.lit(None).cast("string")
        for _, glob, who in (r for r in rules if r[0] == name):
            pick = F.when(matches_any(F.col("path"), [glob, f"{glob}/**"]), F.lit(who)).otherwise(pick)
        per.append(pick)
    return paths.select("path", F.array_distinct(F.filter(F.split(F.array_join(F.array_compact(F.array(*per)), " "), " "), lambda x: x != "")).alias("owners"))


def manifest(spark: SparkSession, url: str, seconds: float = 10.0, most: int = 5 * 2**20) -> DataFrame:
    """One row (url, text) of a manifest fetched by the driver: small, within a time and a size; larger ones are refused."""
    from urllib.request import urlopen

    with urlopen(url, timeout=seconds) as f:  # noqa: S310  # the caller names the URL
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{url}: more than {most} bytes")
    return spark.createDataFrame([(url, data.decode())], "url string, text string")


def by_command(paths: DataFrame, argv: list[str], seconds: int = 60) -> DataFrame:
    """(path, output, status) of a program run once for each path, which it gets as its last argument; status is 'ok', the exit code or the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["path"]:
                try:
                    r = subprocess.run([*argv, p], capture_output=True, text=True, timeout=seconds, check=False)
                    out.append((p, r.stdout, "ok" if r.returncode == 0 else str(r.returncode)))
                except (OSError, subprocess.TimeoutExpired) as x:
                    out.append((p, None, type(x).__name__))
            yield pd.DataFrame(out, columns=["path", "output", "status"])

    return paths.select("path").mapInPandas(run, "path string, output string, status string")
