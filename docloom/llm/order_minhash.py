"""Document fingerprints by order MinHash.

The units of a text are pieces of its words: a word is cut before each character whose four preceding bytes hash to one in
CUT_ONE_IN values, which is about as often in words of any length and script, and cuts a long word without spaces where
its own bytes say so. So texts agree in their units wherever they are equal, but for a few bytes beside an edit. Each run of
k units is numbered by its occurrence; each of m hash functions selects the two least numbered runs, keeps them in text
order and hashes the pair. The share of equal positions of two fingerprints falls with their edit distance, also where
runs only change places.

The next document of a row is the next row by descending doc_id (null last), then by descending text hash; after the
last comes the first. Null texts are empty. Texts without units have the empty fingerprint, which is like itself (1)
and unlike others (0). Other columns are not read. One shuffle deals texts by ranges of doc_id; each range also gets
a copy of the next range's first row. An id that fills more than one range, or null, is cut by the hash of its texts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WHITE, column, mix

K, HASHES, CUT_ONE_IN = 3, 48, 8
#: Bytes whose units are made at once.
LOT = 1 << 20
_rng = np.random.default_rng(6)
_MULT = _rng.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_VALUE = _rng.integers(0, 2**64, 256, np.uint64)
_BASE = 0xD1342543DE82EF95
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.isin(np.arange(256), list(WHITE.encode()))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64; kept, and longer by doubling."""
    while len(_pow[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            _pow[i] = np.concatenate([_pow[i], _pow[i] * np.uint64(pow(base, len(_pow[i]), 2**64))])
    return _pow[0][:n], _pow[1][:n]


def _units(b: np.ndarray) -> np.ndarray:
    """Hashes of the units of some bytes: sums of their values times powers by place, over the power of the first."""
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    first = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    if not len(first):
        return np.zeros(0, np.uint64)
    word_end = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    before = np.zeros(len(b), np.uint32)
    for k in range(1, 5):
        before[k:] |= b[:-k].astype(np.uint32) << np.uint32(8 * (k - 1))
    cut = inside[1:-1] & inside[:-2] & ((b & 0xC0) != 0x80) & ((before * np.uint32(0x9E3779B1)) >> np.uint32(16) < 65_536 // CUT_ONE_IN)
    cut[first] = True
    start = np.flatnonzero(cut)
    end = np.minimum(np.append(start[1:], len(b)), word_end[np.searchsorted(first, start, "right") - 1])
    up, down = _powers(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[b] * up, dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * down[start])


def units(text: str) -> np.ndarray:
    """Hashes of the units of a text, LOT bytes of it at a time, cut at white space where there is any."""
    b, at, out = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), 0, []
    while at < len(b):
        end = min(at + LOT, len(b))
        near = np.flatnonzero(_SPACE[b[end : end + 4096]])
        end += int(near[0]) if len(near) else 0
        out.append(_units(b[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprint(text: str) -> np.ndarray:
    """HASHES 32-bit values; none where the text has no units."""
    u = units(text)
    if not len(u):
        return np.zeros(0, np.uint32)
    k = min(K, len(u))
    h = np.full(len(u) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * _GOLD + u[i : len(u) - k + 1 + i])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    nth = np.empty(len(h), np.uint64)
    nth[order] = np.arange(len(h)) - np.repeat(new, np.diff(np.append(new, len(h))))
    c = mix(h + nth * _GOLD)
    if len(c) == 1:
        return (mix(c * _MULT) >> np.uint64(32)).astype(np.uint32)
    first, second = np.empty(HASHES, int), np.empty(HASHES, int)
    step = max(1, 200_000 // len(c))
    for i in range(0, HASHES, step):
        v = c[None, :] * _MULT[i : i + step, None]
        rows = np.arange(len(v))
        first[i : i + step] = a = v.argmin(1)
        v[rows, a] = np.uint64(2**64 - 1)
        second[i : i + step] = v.argmin(1)
    lo, hi = np.minimum(first, second), np.maximum(first, second)
    return (mix(c[lo] * _GOLD + mix(c[hi] + _MULT)) >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def edited(text: str, following: str) -> str:
    """The text whose last third is replaced by as many characters of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _range(o: Column, row: Column, cuts: list[int]) -> Column:
    """The range of a row from the cuts, ascending; range 0 holds the largest ids. A repeated cut is an id that is cut by row."""
    each = sorted(set(cuts))
    if not each:
        return F.lit(0).cast("long")
    step = max(1, int(len(each) ** 0.5))
    # cuts at or below o: first among every step-th one, then among the step that follows it
    k = F.size(F.filter(F.lit(each[::step]), lambda x: x <= o))
    below = F.when(k == 0, 0).otherwise((k - 1) * step + F.size(F.filter(F.slice(F.lit(each), (k - 1) * step + 1, step), lambda x: x <= o)))
    r = (F.lit(len(each)) - below).cast("long")
    times = {v: n for v, n in Counter(cuts).items() if n > 1}
    if not times:
        return r
    most = max(times.values()) + 1
    parts = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in times.items() for x in kv)), o), F.lit(0)) + 1
    # the row's place among all hashes, from 0 to 1, largest first
    sub = F.least(F.floor((0.5 - row / F.lit(2.0**64)) * parts), parts - 1)
    return r * most + F.greatest(sub, F.lit(0)).cast("long")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = ranges or 4 * parts
    d = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    d = d.withColumn("o", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("row", F.xxhash64("text"))
    shares = [i / n for i in range(1, n)]
    cuts = sorted(d.agg(F.percentile_approx("o", shares, 20 * n)).first()[0] or [])  # at most n
    d = d.withColumn("r", _range(F.col("o"), F.col("row"), cuts))
    heads = d.groupBy("r").agg(F.max(F.struct("o", "row")).alias("h")).collect()  # one for each range
    present = sorted(x["r"] for x in heads)
    before = {r: present[i - 1] for i, r in enumerate(present)}
    if heads:
        h = spark.createDataFrame([(x["h"]["o"], x["h"]["row"], before[x["r"]]) for x in heads], "ho long, hrow long, hr long")
        ghosts = d.join(F.broadcast(h), (F.col("o") == F.col("ho")) & (F.col("row") == F.col("hrow"))).select("doc_id", "text", "o", "row", F.col("hr").alias("r"), F.lit(1).alias("ghost"))
        d = d.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    else:
        d = d.withColumn("ghost", F.lit(0))
    d = d.repartition(parts, "r").sortWithinPartitions("r", "ghost", F.desc("o"), F.desc("row")).select("doc_id", "text", "r", "ghost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for doc, text, r, ghost in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now = (doc, text, r, ghost, fingerprint(text))
                if last is not None and last[2] == r and not last[3]:
                    e = edited(last[1], text)
                    f = fingerprint(e)
                    out.append((last[0], len(last[1]), hashlib.sha256(e.encode()).hexdigest(), last[4].astype(">u4").tobytes().hex(), f.astype(">u4").tobytes().hex(), likeness(last[4], f), likeness(last[4], now[4])))
                last = now
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [()] * 7, KINDS, strict=True)], names=NAMES)

    return d.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
