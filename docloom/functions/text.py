"""Column functions on names, paths, links and texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quote_ident(name: str) -> str:
    """A column name in backticks; any name but the empty one is allowed."""
    if not name:
        raise ValueError("a column needs a name")
    return "`" + name.replace("`", "``") + "`"


def glob_regex(glob: str) -> str:
    """Anchored regex of a path glob: ** crosses folders, * and ? don't, {a,b} and [..] choose."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + ")" * depth + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    if not globs:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-|-$", "")


def fingerprint(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts, joined by NUL; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def pin_text(text: Column) -> Column:
    """Text for pins: no byte order mark, no carriage return before a line feed."""
    return F.replace(F.regexp_replace(text, "^﻿", ""), F.lit("\r\n"), F.lit("\n"))


def pin_hash(text: Column, first: Column, last: Column) -> Column:
    """SHA-256 of lines first to last, from 1."""
    lines = F.split(pin_text(text), "\n")
    return F.sha2(F.array_join(F.slice(lines, first, last - first + 1), "\n"), 256)


def url_key(url: Column) -> Column:
    """A URL without its fragment and without one trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "([^/])/$", "$1")


def url_host(url: Column) -> Column:
    """Host with an explicit port."""
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1))


# The shapes of secrets and what replaces them, in order.
SECRET_NAME = r"(?:(?:[A-Za-z0-9]+[_\-.])*(?:api[_\-.]?key|access[_\-.]?key|secret[_\-.]?key|auth[_\-.]?token|access[_\-.]?token|refresh[_\-.]?token|client[_\-.]?secret|session[_\-.]?token|key|token|secret|password|passwd|passphrase|credentials?|authorization)|AWS_[A-Za-z0-9_]+)"
REDACTIONS = [
    (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[redacted:private-key]"),
    (r"\b[sprk]k-(?:[A-Za-z0-9]+-)*[A-Za-z0-9_-]{16,}", "[redacted:api-key]"),
    (r"\b(?:AKIA|ASIA|AROA|AIDA)[0-9A-Z]{16}\b", "[redacted:aws-access-key-id]"),
    (r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b", "[redacted:github-token]"),
    (r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", "[redacted:slack-token]"),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", "[redacted:google-api-key]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[redacted:jwt]"),
    (r"\b([Bb]earer|Basic|Token)\s+[A-Za-z0-9\-._~+/]{12,}={0,2}", "$1 [redacted:auth-token]"),
    (rf'(?i)("{SECRET_NAME}"\s*:\s*)"[^"]*"', '$1"[redacted:secret-value]"'),
    (rf"(?i)\b({SECRET_NAME})(\s*=\s*)(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s\"'\n]+)", "$1$2[redacted:secret-value]"),
]


#: What a text must hold for a pattern to find anything: a cheap test before it.
HINTS = [("-----BEGIN",), ("sk-", "rk-", "pk-"), ("AKIA", "ASIA", "AROA", "AIDA"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), ("xox",), ("AIza",), ("eyJ",), ("earer", "Basic", "Token")]


def redact(text: Column, extra: list[str] = ()) -> Column:
    """The text without secrets; further patterns come after the fixed ones. A pattern runs only on texts that hold a part of what it needs."""
    noun = "(?i)key|token|secret|passw|passphrase|credential|authorization|aws_"

    def step(i: int, pattern: str, by: str):
        def run(t: Column) -> Column:
            done = F.regexp_replace(t, F.lit(pattern), F.lit(by))
            if i < len(HINTS):
                return F.when(reduce(Column.__or__, (F.contains(t, F.lit(h)) for h in HINTS[i])), done).otherwise(t)
            if i < len(REDACTIONS):
                return F.when(F.contains(t, F.lit('"' if i == len(HINTS) else "=")) & t.rlike(noun), done).otherwise(t)
            return done

        return run

    for i, (pattern, by) in enumerate([*REDACTIONS, *((p, "[redacted]") for p in extra)]):
        text = F.get(F.transform(F.array(text), step(i, pattern, by)), F.lit(0))  # the text is bound once for each step
    return text


def numbered_slugs(rows: DataFrame, key: str) -> DataFrame:
    """(key, slug): repeats of a slug get -1, -2 and so on, in order of the key.

    A slug that very many rows have fills no single task: rows are range-partitioned by slug and key, numbered within
    partitions, and moved on by what earlier partitions hold of their slug (one row for each slug and partition).
    """
    from docloom.plans.lineage import cut

    d = cut(rows.repartitionByRange("slug", key).withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part", "slug").orderBy(key)
    per = d.groupBy("slug", "part").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("slug").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = per.select("slug", "part", before.alias("before"))
    n = d.withColumn("n", F.row_number().over(w)).join(at, ["slug", "part"]).withColumn("n", F.col("n") + F.col("before"))
    return n.select(key, F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), (F.col("n") - 1).cast("string"))).alias("slug"))
