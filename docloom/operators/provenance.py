"""Where lines come from: changes along the first parents of a history, replayed into the origin of each line.

edits are (path, commit, old_first, old_count, new_first, new_count): from line old_first on, old_count lines of the version
before became new_count lines from new_first on, commits numbered in order; with a count of 0 the line before the place is
given, as in unified diffs. renames are (commit, was, path). A path's life begins where it first appears, or again after it
was renamed away; lives that renames connect are one file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.ordered import asof_join
from docloom.plans.lineage import cut

_LINES = "file string, path string, line long, commit long, origin long"


def lives(edits: DataFrame, renames: DataFrame) -> DataFrame:
    """(path, born, file): from which commit on a path belongs to which file, named by its first path and commit.

    Chains of renames are followed by doubling pointers.
    """
    to = renames.select("path", F.col("commit").alias("born"), "was")
    away = renames.select(F.col("was").alias("path"), F.col("commit").alias("commit")).distinct()
    seen = edits.select("path", "commit").unionByName(renames.select("path", "commit")).distinct()
    # a path is born where it's first seen, or first seen again after it was renamed away, or renamed to
    since = asof_join(seen, away.withColumn("gone", F.col("commit")), ["path"], "commit", strict=True).select("path", "commit", "gone")
    born = since.groupBy("path", "gone").agg(F.min("commit").alias("born")).select("path", "born")
    born = cut(born.unionByName(to.select("path", "born")).distinct())
    own = born.select("path", F.col("born").alias("commit"), F.col("born").alias("life"))
    parent = asof_join(to.select(F.col("was").alias("path"), F.col("born").alias("commit"), F.col("path").alias("child")), own, ["path"], "commit", strict=True)
    # a life that was renamed away before is over: what is renamed now came without lines, and begins a file
    over = asof_join(parent.drop("right_commit"), away.withColumn("gone", F.col("commit")), ["path"], "commit", strict=True)
    parent = over.where("life is not null and (gone is null or gone <= life)").select(F.col("child").alias("path"), F.col("commit").alias("born"), F.struct(F.col("path").alias("path"), F.col("life").alias("born")).alias("up"))
    me = F.struct(F.col("path").alias("path"), F.col("born").alias("born"))
    d = cut(born.join(parent, ["path", "born"], "left").select(me.alias("at"), F.coalesce("up", me).alias("up")))
    while True:
        far = d.select(F.col("at").alias("up"), F.col("up").alias("next"))
        d = cut(d.join(far, "up").select("at", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
        if d.where("moved").isEmpty():
            return d.select("at.path", "at.born", F.concat_ws("@", "up.path", "up.born").alias("file"))


def path_at(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows (.., path, commit) with the file that the path belongs to at that commit; rows of no file are left out."""
    return asof_join(rows, of.select("path", F.col("born").alias("commit"), "file"), ["path"], "commit", how="inner").drop("right_commit")


def replay(pieces: list[tuple[int, int, int]], hunks: list[tuple[int, int, int, int]], commit: int) -> list[tuple[int, int, int]]:
    """Pieces (count, commit, origin) of a file after a commit's hunks (old_first, old_count, new_first, new_count), ascending.

    Kept lines keep their piece, in parts where a hunk cuts it; new ones are a piece of the commit.
    """
    out: list[tuple[int, int, int]] = []
    i, used, at = 0, 0, 1  # the piece, how much of it is gone by, and the next old line

    def take(n: int, keep: bool) -> None:
        nonlocal i, used, at
        at += n
        while n > 0 and i < len(pieces):
            count, c, origin = pieces[i]
            m = min(n, count - used)
            if keep:
                if out and out[-1][1] == c and out[-1][2] + out[-1][0] == origin + used:
                    out[-1] = (out[-1][0] + m, c, out[-1][2])
                else:
                    out.append((m, c, origin + used))
            used, n = used + m, n - m
            if used == count:
                i, used = i + 1, 0
        if n > 0:
            raise ValueError("a hunk reaches beyond its file's lines")

    for old_first, old_count, new_first, new_count in hunks:
        start = old_first if old_count else old_first + 1
        if start < at:
            raise ValueError("hunks overlap")
        take(start - at, True)
        take(old_count, False)
        if new_count:
            out.append((new_count, commit, new_first))
    if i < len(pieces):
        take(pieces[i][0] - used, True)
    return out + pieces[i:]  # untouched, in one go


def blame(edits: DataFrame, renames: DataFrame) -> DataFrame:
    """(path, line, commit, origin) of every line of the last version: the commit that brought it, and its number then.

    Rows of a file come together in order of their commits and are replayed as they come, so that a task holds one file's
    pieces, not its history; a line that moves within one commit counts as new, as in a plain diff. Files without lines
    have no rows. Hunks that overlap, or reach beyond their file, end the job.
    """
    e = edits.unionByName(renames.select("path", "commit", *(F.lit(None).cast("long").alias(c) for c in ("old_first", "old_count", "new_first", "new_count"))))
    e = path_at(e.select("path", F.col("commit").cast("long").alias("commit"), *(F.col(c).cast("long") for c in ("old_first", "old_count", "new_first", "new_count"))), lives(edits, renames))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path, commit, pieces, hunks = None, None, None, [], []

        def told() -> pa.RecordBatch:
            rows = [(file, path, i, c, o) for i, (c, o) in enumerate(((c, o + j) for n, c, o in pieces for j in range(n)), 1)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "path", "line", "commit", "origin"])

        for b in batches:
            for f, p, c, *hunk in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if (f, c) != (file, commit) and file is not None:
                    pieces = replay(pieces, hunks, commit)
                    hunks = []
                    if f != file:
                        yield told()
                        pieces = []
                file, path, commit = f, p, c
                if hunk[0] is not None:
                    hunks.append(tuple(hunk))
        if file is not None:
            pieces = replay(pieces, hunks, commit)
            yield told()

    e = e.select("file", "path", "commit", "old_first", "old_count", "new_first", "new_count").repartition("file").sortWithinPartitions("file", "commit", F.col("old_first").asc_nulls_first(), "new_first")
    return e.mapInArrow(run, _LINES).select("path", "line", "commit", "origin")


def states(citations: DataFrame, versions: DataFrame, renames: DataFrame) -> DataFrame:
    """(id, commit, path, status) of citations (id, path, commit, first, last, pin) at each later version (path, commit, text) of their file, under whatever name; a null text is a deleted file."""
    from docloom.operators.pins import lines_of, pin

    of = lives(versions.select("path", "commit"), renames)
    v = path_at(versions, of).select("file", F.col("commit").alias("at"), F.col("path").alias("now"), F.col("text"))
    c = path_at(citations, of)
    d = c.join(v, "file").where(F.col("at") >= F.col("commit"))
    same = pin(lines_of(F.col("text")), F.col("first"), F.col("last")).eqNullSafe(F.col("pin"))
    return d.select("id", F.col("at").alias("commit"), F.col("now").alias("path"), F.when(F.col("text").isNull(), "missing").when(same, "current").otherwise("changed").alias("status"))
