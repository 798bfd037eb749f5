"""Links of pages: kinds, relative paths, routes to pages, what is broken.

A target is external (a scheme or //), an anchor (#...), rooted (/...) or relative. Relative ones resolve against their
page's folder; rooted ones against route mappings (base path, root folder), in order. A path's candidates are tried in
order, each exactly, then without regard to case, then by slug; the last two only where one page alone answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTENSIONS = ("md", "mdx", "html")
INDEX = ("index.md", "index.mdx", "index.html")


def kind(target: Column) -> Column:
    return F.when(target.rlike("^(?i:https?:)?//"), "external").when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "other").when(target.startswith("#"), "anchor").when(target == "", "anchor").when(target.startswith("/"), "rooted").otherwise("relative")


def bare(target: Column) -> Column:
    """A target without its query and fragment."""
    return F.regexp_replace(target, r"[?#].*$", "")


def clean(path: Column) -> Column:
    """A path with . and .. folded away; null where it leaves the root. A trailing slash stays."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))
    up = lambda acc: F.struct(F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0))).alias("p"), (acc["ok"] & (F.size(acc["p"]) > 0)).alias("ok"))
    done = F.aggregate(parts, start, lambda acc, x: F.when(x == "..", up(acc)).otherwise(F.struct(F.array_append(acc["p"], x).alias("p"), acc["ok"].alias("ok"))))
    return F.when(done["ok"], F.concat(F.array_join(done["p"], "/"), F.when(path.endswith("/") & (F.size(done["p"]) > 0), "/").otherwise("")))


def candidates(path: Column) -> Column:
    """The files that a path may mean, in order; of a folder its index files come first."""
    stem = F.regexp_replace(path, "/$", "")
    files = [F.concat(stem, F.lit(f".{e}")) for e in EXTENSIONS]
    index = [F.when(stem == "", F.lit(i)).otherwise(F.concat(stem, F.lit(f"/{i}"))) for i in INDEX]
    folder = path.endswith("/") | (path == "")
    return F.when(folder, F.array(*index, *files)).otherwise(F.array(path, *files, *index))


def _slug(path: Column) -> Column:
    return F.regexp_replace(F.lower(path), "[-_]", "")


def resolve_paths(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """wanted (.., key, path) with ``page``: the first candidate that a page (path) answers.

    Exact paths are unique; folded ones count only where one page has them, so no join multiplies rows.
    """
    p = pages.select(F.col("path").alias("page")).distinct()
    each = wanted.select("key", F.posexplode(candidates(F.col("path"))).alias("nth", "candidate"))
    found = None
    for tier, fold in enumerate((lambda c: c, F.lower, _slug)):
        own = p.groupBy(fold(F.col("page")).alias("folded")).agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("n")).where("n = 1")
        hit = each.join(own, fold(F.col("candidate")) == F.col("folded")).select("key", F.struct("nth", F.lit(tier).alias("tier")).alias("rank"), "page")
        found = hit if found is None else found.union(hit)
    best = found.groupBy("key").agg(F.min_by("page", "rank").alias("page"))
    return wanted.join(best, "key", "left")


def route(path: Column, routes: list[tuple[str, str]]) -> Column:
    """The file path of a rooted URL path: of the first mapping whose base holds it."""
    out = F.lit(None).cast("string")
    for base, root in reversed(routes):
        b = "/" + base.strip("/") + "/" if base.strip("/") else "/"
        rest = F.substr(path, F.lit(len(b) + 1))
        out = F.when((path == F.lit(b.rstrip("/") or "/")) | path.startswith(b), F.concat(F.lit(root.strip("/") + "/" if root.strip("/") else ""), rest)).otherwise(out)
    return out


def classify(links: DataFrame, pages: DataFrame, routes: list[tuple[str, str]] = (("", ""),)) -> DataFrame:
    """links (path, target) with kind, page and broken: a relative or rooted target that no page answers is broken."""
    own = F.regexp_replace("path", "[^/]*$", "")
    k = kind(F.col("target"))
    to = F.when(k == "relative", F.concat(own, bare(F.col("target")))).when(k == "rooted", route(bare(F.col("target")), list(routes)))
    d = links.select("path", "target", k.alias("kind"), clean(to).alias("to")).withColumn("key", F.xxhash64("to"))
    wanted = d.where("to is not null").select("key", F.col("to").alias("path")).distinct()
    hit = resolve_paths(wanted, pages).select(F.col("key").alias("k"), F.col("path").alias("at"), "page")
    j = d.join(hit, (F.col("key") == F.col("k")) & (F.col("to") == F.col("at")), "left")
    page = F.when(F.col("kind") == "anchor", F.col("path")).otherwise(F.col("page"))
    return j.select("path", "target", "kind", page.alias("page"), (F.col("kind").isin("relative", "rooted") & F.col("page").isNull()).alias("broken"))


def page_key(url: Column) -> Column:
    """What spellings of one page share: no fragment, host in lower case without a default port, and a path that loses one
    trailing slash unless it is the root. The query stays; text that isn't an absolute URL only loses its fragment."""
    u = F.regexp_replace(url, "(?s)#.*$", "")
    head = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path, query = F.regexp_extract(rest, "^([^?]*)", 1), F.regexp_extract(rest, "(?s)^[^?]*(.*)$", 1)
    return F.when(head == "", u).otherwise(F.concat(head, F.when(path == "", "/").otherwise(F.regexp_replace(path, "([^/]|/(?=/))/$", "$1")), query))


def frontier(start: DataFrame, links: DataFrame, scope: str, exclude: list[str] = (), depth: int = 10, limit: int | None = None) -> DataFrame:
    """(url, depth) of a crawl over known links (url, href): breadth first, within a prefix, without excluded path globs.

    URLs are compared by page_key(): without fragment and one trailing slash, with their query. Each is visited once, at
    its least depth. A limit takes the first by depth and url, as a crawl in rounds of sorted URLs would.
    """
    from docloom.functions.text import matches_any
    from docloom.plans.lineage import cut

    key = page_key
    inside = lambda c: c.startswith(scope.rstrip("/")) & ~(matches_any(F.regexp_replace(c, "^[a-z]+://[^/]+/?", ""), list(exclude)) if exclude else F.lit(False))
    e = cut(links.select("url", "href").distinct())  # a link that many rows repeat is parsed once
    e = cut(e.select(key(F.col("url")).alias("a"), key(F.col("href")).alias("b")).where(inside(F.col("b"))).distinct())
    seen = front = cut(start.select(key(F.col("url")).alias("url")).where(inside(F.col("url"))).distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        front = cut(e.join(front, e.a == front.url).select(F.col("b").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.union(front)  # of written rounds; none is written again
    return seen if limit is None else seen.orderBy("depth", "url").limit(limit)
