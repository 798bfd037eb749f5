"""Token-id output as a content-addressed store.

Layout below one folder, all Parquet:
  chunks/     digest (BLAKE2b, 16 bytes, of the raw ids), n, payload (zstd of little-endian 16-bit ids); once each
  documents/  part, seq, doc_id, n_tokens, n_chunks, digests (concatenated); ascending doc_id: part, then seq
  manifest/   level, part, node, hash: level 0 hashes a run of documents' recipes, each next one the runs below, one root

A rolling hash over four ids cuts each document's ids into chunks of MIN_CHUNK to MAX_CHUNK, 512 more than the least on
average, so that equal passages give equal chunks wherever they stand. Reading recomputes the manifest from the recipes and
compares the roots, follows each recipe through the chunks, and checks each chunk against its digest and each document's
ids against the count in its recipe: a lost or altered file of any of the three ends the job. read_documents() rebuilds ids.

Null texts are empty; an empty text has its end id alone. Rows with a null doc_id come first; rows of equal doc_id follow
each other by content. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import Recent, column, materialize, sized_join, texts

MIN_CHUNK, MAX_CHUNK, TOP, DIGEST = 128, 4096, np.uint64(2**55), 16
FAN = 1024
MOST_UNITS = 300_000


#: Text in which the tokenizer's pattern and normal form are those of PIECE and lower().
PLAIN = re.compile("[\\t-\\r -~À-ÖØ-öø-ÿŒœ]*")
#: The settings of a tokenizer file for which this holds.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿœ]+")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level models name bytes: printable Latin-1 stays, the others follow from U+0100."""
    out, n = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(n)
            n += 1
    return out


class WordEncoder:
    """Ids of a tokenizer whose pre-tokens hold no white space.

    Texts of ASCII and common Latin letters are cut by PIECE, and the model merges each piece once. Others are cut at
    white space into units for the whole tokenizer; texts that may hold a special token aren't cut. No text is cut for a
    file whose normalizer, pre-tokenizer, model or special tokens aren't those that the cuts rely on.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids above 65535 are not supported")
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.cuts = told["normalizer"] == NORMAL and told["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and not any(told[k] for k in ("truncation", "padding"))
        self.cuts &= told["model"]["type"] == "BPE" and not told["model"].get("dropout") and all(t["content"].startswith("<|") for t in told["added_tokens"])
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.units, self.pieces = Recent(self._whole, MOST_UNITS // 8), Recent(self._piece, MOST_UNITS)

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u2").tobytes()

    def _piece(self, piece: str) -> bytes:
        named = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.model.tokenize(named)]).tobytes()

    def encode(self, text: bytes) -> bytes:
        if not self.cuts or b"<|" in text:
            return self._whole(text)
        said = text.decode("utf-8", "replace")
        if PLAIN.fullmatch(said):
            parts, kept = PIECE.findall(said.lower()), self.pieces
        else:
            parts, kept = text.lower().split(), self.units
        short = len(text) <= 64 * len(parts)  # else too long to be kept
        return b"".join(map(kept.__getitem__ if short else kept.make, parts))


@cache
def encoder(path: str | None) -> WordEncoder:
    """The encoder of a tokenizers file, one for each worker; the path defaults to the public lower-case word BPE."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordEncoder(path)


_ROLL = np.random.default_rng(10).integers(0, 2**64, 65_536, np.uint64)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream: where the top nine bits of a hash of the last four ids are zero."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n] if n else []
    g = _ROLL[ids]
    h = g.copy()
    for i, m in ((1, 3), (2, 5), (3, 7)):
        h[i:] += g[:-i] * np.uint64(m)
    out, at = [], 0
    for m in [*(np.flatnonzero(h < TOP) + 1).tolist(), n]:
        while m - at > MAX_CHUNK:
            at += MAX_CHUNK
            out.append(at)
        if m - at >= MIN_CHUNK or m == n and m > at:
            out.append(m)
            at = m
    return out


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encodes each whole text, appends end_id and writes the store."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, z = encoder(tokenizer), zstandard.ZstdCompressor(1, write_content_size=True)
        for b in batches:
            total, ends, names, size, payload = [], [0], [], [], []
            for t in texts(b.column(1)):
                raw, at = enc.encode(t) + end, 0
                for e in cuts(np.frombuffer(raw, "<u2")):
                    piece = raw[2 * at : 2 * e]
                    names.append(digest(piece))
                    size.append(e - at)
                    payload.append(z.compress(piece))
                    at = e
                total.append(at)
                ends.append(len(names))
            chunk = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(size, pa.int32()), pa.array(payload, pa.binary())], ["digest", "n", "payload"])
            own = pa.array([b"".join(names[i:j]) for i, j in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), own, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunk)], names=["doc_id", "n_tokens", "digests", "chunks"])

    staged = materialize(d.mapInArrow(run, "doc_id long, n_tokens long, digests binary, chunks array<struct<digest: binary, n: int, payload: binary>>"))
    recipes = staged.select("doc_id", "n_tokens", F.floor(F.octet_length("digests") / DIGEST).cast("int").alias("n_chunks"), "digests")
    order = [F.col("doc_id").asc_nulls_first(), F.col("digests")]
    recipes = recipes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    recipes.select(F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit(2**33 - 1)).alias("seq"), "doc_id", "n_tokens", "n_chunks", "digests").write.parquet(f"{path}/documents")
    # equal chunks meet after their copies in one task were reduced to one
    staged.select(F.explode("chunks").alias("c")).select("c.*").dropDuplicates(["digest"]).write.parquet(f"{path}/chunks")
    manifest(documents(spark, path)).write.parquet(f"{path}/manifest")


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, seq long, doc_id long, n_tokens long, n_chunks int, digests binary").parquet(f"{path}/documents")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, n int, payload binary").parquet(f"{path}/chunks")


def manifest(recipes: DataFrame) -> DataFrame:
    """(level, part, node, hash) of all levels; a level has one node for FAN below it, the last one a single node."""
    leaf = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("n_tokens").cast("string"), F.hex("digests")), 256)
    rows = recipes.select("part", F.floor(F.col("seq") / FAN).alias("node"), F.struct("seq", leaf.alias("h")).alias("x"))
    join = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), ","), 256)
    level, out = 0, None
    while True:
        now = materialize(rows.groupBy("part", "node").agg(join.alias("hash")).select(F.lit(level).alias("level"), "part", "node", "hash"))
        out = now if out is None else out.union(now)
        n = now.count()
        if n <= 1:
            return out
        # first within each part, then over parts
        if now.groupBy("part").count().where("count > 1").isEmpty():
            if now.where("part >= 0").isEmpty():
                rows = now.select(F.lit(-1).alias("part"), F.floor(F.col("node") / FAN).alias("node"), F.struct(F.col("node").alias("seq"), F.col("hash").alias("h")).alias("x"))
            else:
                rows = now.select(F.lit(-1).alias("part"), F.floor(F.col("part") / FAN).cast("long").alias("node"), F.struct(F.col("part").cast("long").alias("seq"), F.col("hash").alias("h")).alias("x"))
        else:
            part = F.when(F.col("part") < 0, F.lit(-1)).otherwise(F.col("part"))
            rows = now.select(part.alias("part"), F.floor(F.col("node") / FAN).alias("node"), F.struct(F.col("node").alias("seq"), F.col("hash").alias("h")).alias("x"))
        level += 1


def root(nodes: DataFrame) -> str | None:
    """The one hash of a manifest's last level; None where there is no document."""
    top = nodes.orderBy(F.desc("level")).first()
    return top["hash"] if top else None


def sound_recipes(spark: SparkSession, path: str) -> bool:
    """Whether the recipes are those of the manifest."""
    kept = spark.read.schema("level int, part int, node long, hash string").parquet(f"{path}/manifest")
    return root(kept) == root(manifest(documents(spark, path)))


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the manifest is that of the recipes and each chunk has its digest."""
    return sound_recipes(spark, path) and chunk_sums(spark, path).where("not sound").isEmpty()


def raw_ids(payload: bytes, limit: int = 2 * MAX_CHUNK) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(payload, max_output_size=limit)


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, crc, sound) of the stored chunks: counts and crc32 of the ids as 32-bit integers, from the payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in batches:
            n, crc, sound = [], [], []
            for dg, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = z.decompress(payload, max_output_size=2 * MAX_CHUNK)
                n.append(len(raw) // 2)
                crc.append(zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4").tobytes()))
                sound.append(digest(raw) == dg)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sound, pa.bool_())], names=["digest", "n", "crc", "sound"])

    return chunks(spark, path).mapInArrow(run, "digest binary, n long, crc long, sound boolean")


_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the crc32 polynomial, bits reversed."""
    a, b = np.broadcast_arrays(np.asarray(a, np.uint64), np.asarray(b, np.uint64))
    out, b = np.zeros(a.shape, np.uint64), b.copy()
    for i in range(31, -1, -1):
        out ^= b * ((a >> np.uint64(i)) & np.uint64(1))
        b = (b >> np.uint64(1)) ^ ((b & np.uint64(1)) * np.uint64(_POLY))
    return out


def _shifts(size: np.ndarray) -> np.ndarray:
    """x to the power 8 n for each size n."""
    each, back = np.unique(size, return_inverse=True)
    out, p = np.full(len(each), 1 << 31, np.uint64), np.full(1, 1 << 23, np.uint64)  # 1 and x^8
    while each.any():
        odd = each & 1 > 0
        out[odd] = _times(out[odd], p)
        p, each = _times(p, p), each >> 1
    return out[back]


def joined_crc(crc: np.ndarray, size: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """The crc32 of each document from those of its pieces, which follow each other; size in bytes."""
    out = np.zeros(docs, np.uint64)
    if not len(doc):
        return out
    first = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
    length = np.diff(np.append(first, len(doc)))
    shifts = _shifts(np.asarray(size, np.int64))
    for k in range(int(length.max())):
        at = first[length > k] + k
        out[doc[at]] = _times(out[doc[at]], shifts[at]) ^ crc[at].astype(np.uint64)
    return out


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; damage to any of them ends the job.

    The crc of a document is joined from those of its chunks in the order of its recipe, so that no ids are shuffled; it
    is that of the ids which read_documents() rebuilds.
    """
    if not sound_recipes(spark, path):
        raise ValueError("the recipes differ from the manifest")
    d = documents(spark, path)
    before, total = {}, 0
    for x in d.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one for each file range
        before[x["part"]] = total
        total += x["n"]
    o = F.broadcast(spark.createDataFrame(list(before.items()), "bpart int, before long"))
    d = d.join(o, d.part == o.bpart).withColumn("start", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens"))
    d = d.select("part", "seq", "doc_id", "start", "n_tokens", F.floor(F.octet_length("digests") / DIGEST).cast("int").alias("n_chunks"), "digests")
    each = d.select("part", "seq", "digests", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("k"))
    each = each.select("part", "seq", "k", F.substring("digests", F.col("k") * DIGEST + 1, F.lit(DIGEST)).alias("digest"))
    sums = chunk_sums(spark, path).select("digest", "n", F.when(F.col("sound"), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk differs from its digest")).cast("long")).alias("crc"))
    each = sized_join(each, materialize(sums), "digest").groupBy("part", "seq").agg(F.array_sort(F.collect_list(F.struct("k", "n", "crc"))).alias("x"))
    d = d.drop("digests").join(each, ["part", "seq"], "left").select("doc_id", "start", "n_chunks", "x", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(3)
            sizes = np.array([0 if v is None else len(v) for v in x], int)
            if (sizes != b.column(2).to_numpy()).any():
                raise ValueError("chunks are missing")
            f = x.flatten()
            n, crc = f.field("n").to_numpy(), f.field("crc").to_numpy()
            doc = np.repeat(np.arange(b.num_rows), sizes)
            tokens = np.bincount(doc, n, b.num_rows).astype(np.int64)
            if (tokens != b.column(4).to_numpy()).any():
                raise ValueError("a recipe's count differs from its chunks")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens), pa.array(joined_crc(crc, 4 * n, doc, b.num_rows).astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return d.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) rebuilt from the store: little-endian 16-bit ids with the end id, checked against the digests."""
    d = documents(spark, path)
    each = d.select("part", "seq", "doc_id", "digests", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("k"))
    each = each.select("part", "seq", "doc_id", "k", F.substring("digests", F.col("k") * DIGEST + 1, F.lit(DIGEST)).alias("digest"))
    whole = each.join(chunks(spark, path), "digest").groupBy("part", "seq", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "digest", "payload"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                pieces = [raw_ids(c["payload"]) for c in x]
                if any(digest(p) != c["digest"] for p, c in zip(pieces, x, strict=True)):
                    raise ValueError("a chunk differs from its digest")
                out.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return whole.select("doc_id", "x").mapInArrow(run, "doc_id long, ids binary")
