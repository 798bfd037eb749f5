"""Pins: hashes of line ranges that tell whether cited text is still where it was.

sources are (path, text), citations (id, path, first, last, pin): the lines first to last, from 1, had that hash, and may
have a column ``original``, those lines themselves. Before hashing, a text loses a byte order mark, its carriage returns
before line feeds, and the one empty line that a final line feed leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.lineage import cut


def lines_of(text: Column) -> Column:
    """The lines of a normalised text; an empty one has none."""
    ls = F.split(F.replace(F.regexp_replace(text, "^\\ufeff", ""), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(F.element_at(ls, -1) == "", F.slice(ls, F.lit(1), F.size(ls) - 1)).otherwise(ls)


def pin(lines: Column, first: Column, last: Column) -> Column:
    """SHA-256 of some lines joined by line feeds; null where there aren't so many."""
    own = F.slice(lines, first, last - first + 1)
    return F.when((first >= 1) & (last >= first) & (F.size(lines) >= last), F.sha2(F.array_join(own, "\n"), 256))


def canonical_pin(data: Column) -> Column:
    """SHA-256 of a flat JSON object with sorted keys and no white space; nested values keep the order of their keys in VARIANT, which is sorted."""
    return F.sha2(F.to_json(F.try_parse_json(data)), 256)


def source_lines(sources: DataFrame) -> DataFrame:
    """(path, n, line) of each source, from 1."""
    d = sources.where("text is not null").select("path", F.posexplode(lines_of(F.col("text"))).alias("p", "line"))
    return d.select("path", (F.col("p") + 1).alias("n"), "line")


def find_moved(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, path, at): everywhere that lines with a citation's pin stand in its source now, however far they moved.

    Where the citation has its original lines, only places that begin with the first of them are hashed. Of the others,
    windows of each cited length are hashed once for each source, for the lengths that its citations ask for, and only
    hashes that one of them has leave the source's row. Texts meet tables of citations unsorted.
    """
    size = (F.col("last") - F.col("first") + 1).alias("size")
    s = sources.where("text is not null").select("path", "text")
    own = lines_of(F.col("text")).alias("ls")
    hashed = lambda i: F.sha2(F.array_join(F.slice("ls", i, F.col("size")), "\n"), 256)
    starts = F.sequence(F.lit(1), F.size("ls") - F.col("size") + 1)
    blind, out = citations, []
    if "original" in citations.columns:
        seen = citations.where("original is not null").select("id", "path", size, "pin", F.split("original", "\n")[0].alias("head"))
        seen = s.join(seen.where("size >= 1").hint("shuffle_hash"), "path").select("id", "path", "size", "pin", "head", own).where(F.size("ls") >= F.col("size"))
        hits = F.filter(starts, lambda i: (F.element_at("ls", i) == F.col("head")) & (hashed(i) == F.col("pin")))
        out.append(seen.select("id", "path", F.explode(hits).alias("at")))
        blind = citations.where("original is null")
    sizes = blind.select("path", size, "pin").where("size >= 1 and pin is not null").groupBy("path", "size").agg(F.collect_set("pin").alias("pins"))
    w = s.join(sizes.hint("shuffle_hash"), "path").select("path", "size", "pins", own).where(F.size("ls") >= F.col("size"))
    found = F.filter(F.transform(starts, lambda i: F.struct(i.alias("at"), hashed(i).alias("pin"))), lambda x: F.array_contains("pins", x["pin"]))
    w = w.select("path", "size", F.explode(found).alias("x")).select("path", "size", "x.*")
    out.append(blind.select("id", "path", size, "pin").join(w, ["path", "size", "pin"]).select("id", "path", "at"))
    return reduce(DataFrame.union, out)


def classify(citations: DataFrame, sources: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(id, path, status, at), at for moved ones: current; moved; moved-ambiguous (several places); missing (no source); changed; or never-true, where ``before``, the source as cited, hasn't the pin either."""
    key = [F.col(c).alias(f"c{i}") for i, c in enumerate(("id", "path", "first", "last", "pin"))]
    citations = cut(citations)  # they may be told from texts
    s = sources.select(F.col("path").alias("spath"), "text")
    at = citations.select(*key).distinct()
    at = s.join(at.hint("shuffle_hash"), F.col("spath") == F.col("c1")).withColumn("now", pin(lines_of(F.col("text")), F.col("c2"), F.col("c3")))
    at = at.select("c0", "c1", "c2", "c3", "c4", F.col("now").eqNullSafe(F.col("c4")).alias("same"))
    met = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"c{i}")) for i, c in enumerate(("id", "path", "first", "last", "pin"))))
    d = citations.join(at, met, "left").select("id", "path", F.col("same").isNull().alias("lost"), "same")
    moved = find_moved(citations, sources).groupBy("id").agg(F.count(F.lit(1)).alias("places"), F.min("at").alias("at"))
    d = d.join(moved, "id", "left")
    never = F.lit(False)
    if before is not None:
        b = before.select(F.col("path").alias("bpath"), lines_of(F.col("text")).alias("bls"))
        was = citations.join(b, F.col("path") == F.col("bpath")).select(F.col("id").alias("bid"), pin(F.col("bls"), F.col("first"), F.col("last")).eqNullSafe(F.col("pin")).alias("held"))
        d = d.join(was, F.col("id") == F.col("bid"), "left")
        never = ~F.coalesce("held", F.lit(True))
    status = F.when(F.col("lost"), "missing").when(F.col("same"), "current").when(F.col("places") == 1, "moved").when(F.col("places") > 1, "moved-ambiguous").when(never, "never-true").otherwise("changed")
    return d.select("id", "path", status.alias("status"), F.when(status == "moved", F.col("at")).alias("at"))


def reanchor(citations: DataFrame, classified: DataFrame) -> DataFrame:
    """citations with first and last shifted to where moved lines stand now; others as they were."""
    to = classified.where("status = 'moved'").select("id", F.col("at").alias("to"))
    d = citations.join(to, "id", "left")
    shift = F.coalesce(F.col("to") - F.col("first"), F.lit(0))
    return d.select(*(((F.col(c) + shift).cast("int").alias(c)) if c in ("first", "last") else F.col(c) for c in citations.columns))


def quote_drift(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, path, status) of claims (id, path, quote): held where the page's text has the quote, white space aside; else drifted, or missing."""
    plain = lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))
    d = claims.join(sources.select(F.col("path").alias("spath"), plain(F.col("text")).alias("t")), F.col("path") == F.col("spath"), "left")
    return d.select("id", "path", F.when(F.col("t").isNull(), "missing").when(F.contains("t", plain(F.col("quote"))), "held").otherwise("drifted").alias("status"))


def stale_windows(states: DataFrame) -> DataFrame:
    """(id, opened, closed, reason) of runs of commits, by number, in which a citation (id, commit, status) wasn't current.

    closed is null for a window that is open at the end; reason says how it ended: restored, by the source; or removed,
    where the citation has no state at a later commit that others have.
    """
    w = Window.partitionBy("id").orderBy("commit")
    d = states.withColumn("stale", F.col("status") != "current")
    d = d.withColumn("starts", (F.col("stale") & ~F.coalesce(F.lag("stale").over(w), F.lit(False))).cast("int")).withColumn("run", F.sum("starts").over(w)).withColumn("next", F.lead("commit").over(w))
    end = states.agg(F.max("commit").alias("end"))
    runs = d.where("stale").groupBy("id", "run").agg(F.min("commit").alias("opened"), F.max(F.struct("commit", "next")).alias("x"))
    runs = runs.crossJoin(F.broadcast(end))  # one row
    last, after = F.col("x.commit"), F.col("x.next")
    return runs.select("id", "opened", F.coalesce(after, F.when(last < F.col("end"), last + 1)).alias("closed"), F.when(after.isNotNull(), "restored").when(last < F.col("end"), "removed").alias("reason"))


def history_metrics(windows: DataFrame, releases: DataFrame) -> DataFrame:
    """(id, windows, open, commits, crossed): the windows of a citation, those open, commits within closed ones, and releases (commit) that fell into any.

    Releases are counted by their running number, not joined by range: they and the windows' ends, each value once, are
    range-partitioned by commit; each partition adds up its own, after those of the partitions before it.
    """
    at = F.coalesce(F.col("closed"), F.lit(2**31 - 1)).cast("long")
    ends = windows.select("id", F.explode(F.array(F.struct(F.col("opened").cast("long").alias("at"), F.lit(-1).alias("sign")), F.struct(at.alias("at"), F.lit(1).alias("sign")))).alias("x"))
    ends = ends.groupBy("id", "x.at").agg(F.sum("x.sign").alias("weight"))
    r = releases.select(F.col("commit").cast("long").alias("at"), F.lit(1).alias("hit")).where("at is not null")
    line = r.unionByName(ends.select("at", F.lit(0).alias("hit"))).groupBy("at").agg(F.max("hit").alias("hit"))
    line = cut(line.repartitionByRange("at").withColumn("part", F.spark_partition_id()))  # the ranges are fixed from here on
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = line.groupBy("part").agg(F.sum("hit").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # one row for each partition
    within = F.coalesce(F.sum("hit").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = line.withColumn("within", within).join(F.broadcast(parts), "part").select("at", (F.col("offset") + F.col("within")).alias("below"))
    crossed = ends.join(below, "at").groupBy("id").agg(F.sum(F.col("weight") * F.col("below")).cast("long").alias("crossed"))
    d = windows.groupBy("id").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("closed").isNull()).alias("open"), F.coalesce(F.sum(F.col("closed") - F.col("opened")), F.lit(0)).cast("long").alias("commits"))
    return d.join(crossed, "id")


def claim_share(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """(path, words, claimed, share): how many of a page's words stand in lines that a claim (path, first, last) covers."""
    n = source_lines(pages).withColumn("words", F.size(F.filter(F.split("line", r"\s+"), lambda w: w != "")))
    covered = claims.select("path", F.explode(F.sequence("first", "last")).alias("n")).distinct().withColumn("hit", F.lit(1))
    d = n.join(covered, ["path", "n"], "left").groupBy("path").agg(F.sum("words").cast("long").alias("words"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("words"))), F.lit(0)).cast("long").alias("claimed"))
    return d.withColumn("share", F.round(F.try_divide("claimed", "words"), 4))


def forecast(changes: DataFrame, cutoff: int, half: float = 30.0) -> DataFrame:
    """(id, rate): the decayed rate of a citation's changes (id, day) before a day, sum(exp(-age / half))."""
    return changes.where(F.col("day") < cutoff).groupBy("id").agg(F.sum(F.exp((F.col("day") - cutoff) / half)).alias("rate"))


def auc(scored: DataFrame) -> DataFrame:
    """(auc, brier) of (score, label 0 or 1), ranks of equal scores shared.

    Counts for each score are range-partitioned; each partition adds up its own, after the sums of those before it.
    """
    per = scored.groupBy("score").agg(F.sum("label").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    per = cut(per.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    parts = per.groupBy("part").agg(F.sum(F.col("n") - F.col("pos")).alias("neg")).collect()  # one for each partition
    before = {x["part"]: sum(y["neg"] for y in parts if y["part"] < x["part"]) for x in parts}
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("part")) if before else F.lit(0.0)
    w = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    r = per.withColumn("below", offset + F.coalesce(F.sum(F.col("n") - F.col("pos")).over(w), F.lit(0.0)))
    wins = F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2))
    a = r.agg((wins / (F.sum("pos") * F.sum(F.col("n") - F.col("pos")))).alias("auc"))
    return a.crossJoin(scored.agg(F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2))).alias("brier")))  # one row each
