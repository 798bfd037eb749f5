"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counts and ratios of bytes, words and lines of the whole text. Trees are grown level by level on features
binned by quantiles, with logistic loss, on a bounded sample of labelled rows (``max_rows`` with the smallest hashes of
doc_id), and flattened into arrays: a batch of rows walks all trees by numpy indexing.

Empty and null texts have the statistics 0 and get a score like any other. Rows without a label, or whose label is
neither 0 nor 1, are not learned from; without any learnable row each score is 0.5. Equal texts score equal; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docloom.llm.common import column, materialize, texts

MAX_ROWS = 20_000
_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_PUNCT = [i for i in range(33, 127) if not chr(i).isalnum()]


def statistics(data: bytes) -> list[float]:
    """Statistics of a text in UTF-8."""
    if not data:
        return [0.0] * WIDTH
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, words, lines = len(data), data.split(), data.split(b"\n")
    w, uniq = max(1, len(words)), set(words)
    chars = n - int(c[128:192].sum())
    lower = [x.lower().strip(b".,;:!?\"'()") for x in words]
    tally: dict[bytes, int] = {}
    for x in lower:
        tally[x] = tally.get(x, 0) + 1
    counts = np.fromiter(tally.values(), float, len(tally)) if tally else np.ones(1)
    p = counts / counts.sum()
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    per_line = np.fromiter(map(len, lines), float, len(lines))
    letters = int(c[_UPPER].sum() + c[_LOWER].sum() + c[192:].sum())
    k = sorted(tally.values(), reverse=True)[:10]
    return [
        np.log1p(chars), np.log1p(len(words)), np.log1p(len(lines)), letters / chars, c[_UPPER].sum() / chars, c[_DIGIT].sum() / chars, c[_PUNCT].sum() / chars,
        *(c[ord(x)] / w for x in ".,!?|#$%&*-<>{}()[]/\\=_:;\"'@~^+"), c[[9, 32]].sum() / chars, c[10] / w, c[192:].sum() / chars, c[:32].sum() / chars - c[10] / chars,
        sizes.mean(), sizes.std(), sizes.max(), np.median(sizes), len(uniq) / w, len(tally) / w, counts.max() / w, sum(k) / w, float(-(p * np.log(p)).sum()), (counts == 1).sum() / w,
        per_line.mean(), per_line.std(), per_line.max(), len(set(lines)) / len(lines), sum(1 for x in lines if not x.strip()) / len(lines),
        sum(1 for x in words if x[-1:] in b".!?") / w, sum(1 for x in words if x[-1:] in b"#$%&*|") / w, sum(1 for x in words if x[:1].isupper()) / w, sum(1 for x in words if x.isupper()) / w, sum(1 for x in words if x.isalpha()) / w, sum(1 for x in words if len(x) > 18) / w, sum(1 for x in words if len(x) == 1) / w,
        sum(1 for a, b in zip(lower, lower[1:]) if a == b) / w,
    ]


WIDTH = 0
WIDTH = len(statistics(b"a b"))


def features(rows: list[bytes]) -> np.ndarray:
    return np.array([statistics(x) for x in rows], float).reshape(len(rows), WIDTH)


@dataclass
class Trees:
    """Flattened trees, all of one depth: node i's children are 2i+1 and 2i+2; leaves follow the inner nodes."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # goes right where the value is above
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = (inner + 1).bit_length() - 1
        for t in range(trees):
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            total += self.leaf[t, at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, reg: float = 2.0, least: float = 4.0) -> Trees:
    """Grows the trees. reg: added to the hessian; least: hessian that each child needs."""
    n, width = x.shape
    if not n or y.min() == y.max():
        p = 0.5 if not n else float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        return Trees(np.log(p / (1 - p)), np.zeros((1, 1), int), np.zeros((1, 1)), np.zeros((1, 2)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    b = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(width)], 1)  # bin > k: value > cuts[k]
    flat = b + np.arange(width) * bins
    base = np.log(y.mean() / (1 - y.mean()))
    total = np.full(n, base)
    inner = 2**depth - 1
    out = Trees(base, np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, int)
        for d in range(depth):
            first, m = 2**d - 1, 2**d
            key = ((at - first)[:, None] * (width * bins) + flat).ravel()
            G = np.bincount(key, np.repeat(g, width), m * width * bins).reshape(m, width, bins).cumsum(2)
            H = np.bincount(key, np.repeat(h, width), m * width * bins).reshape(m, width, bins).cumsum(2)
            gt, ht = G[:, :, -1:], H[:, :, -1:]
            gain = G**2 / (H + reg) + (gt - G) ** 2 / (ht - H + reg) - gt**2 / (ht + reg)
            gain[(H < least) | (ht - H < least)] = 0
            best = gain.reshape(m, -1).argmax(1)
            for i in range(m):
                j, k = divmod(int(best[i]), bins)
                if gain[i, j, k] > 1e-9 and k < len(cuts[j]):
                    out.feature[t, first + i], out.cut[t, first + i] = j, cuts[j][k]
            f, c = out.feature[t, at], out.cut[t, at]
            at = 2 * at + 1 + (x[np.arange(n), f] > c)
        leaf = at - inner
        out.leaf[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + reg)
        total += out.leaf[t, leaf]
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Learns from at most max_rows labelled rows: those with the smallest hashes of their id."""
    known = labels.select(column(id_col).alias("lid"), column(label_col).cast("int").alias("y")).where("lid is not null and y in (0, 1)")
    picked = materialize(known.orderBy(F.xxhash64("lid"), "lid", "y").limit(max_rows))
    d = docs.select(column(id_col).alias("did"), column(text_col).alias("text")).join(F.broadcast(picked), F.col("did") == F.col("lid")).select("lid", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(texts(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["lid", "y", "x"])

    rows = d.mapInArrow(run, "lid long, y int, x array<double>").toArrow().sort_by([("lid", "ascending"), ("y", "ascending")])
    x = np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, WIDTH)
    order = np.lexsort([*x.T, rows.column("lid").to_numpy()])  # repeated ids: the same order each time
    return fit(x[order], rows.column("y").to_numpy().astype(float)[order])


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """keep's columns (the id alone if None) with the score, whose name must not be among them."""
    keep = [id_col] if keep is None else list(keep)
    own = text_col not in keep
    kept = [column(c).alias(f"c{i}") for i, c in enumerate(keep)]  # Spark's mapInArrow looks columns up by name, without quotes
    d = docs.select(*kept, column(text_col).alias("text to score")) if own else docs.select(*kept)
    at, width = len(keep) if own else keep.index(text_col), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                s = model.score(features(texts(part.column(at))))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(s, pa.float64())], names=[*keep, score_col])

    return d.mapInArrow(run, StructType([*(StructField(c, f.dataType) for c, f in zip(keep, d.schema.fields)), StructField(score_col, DoubleType())]))
