"""SentencePiece BPE encoding and decoding in linear time, by a table of last tokens.

For each prefix of a text the encoding's last token is unique. It is found among the vocabulary's matches that end
there (an automaton gives them) as the one that is compatible with the last token of the prefix before it: two tokens
are compatible if the merges of their concatenation give these two again. Ids are then recovered backwards. No piece
contains a line feed or a space mark after another character, so texts are cut there, and cuts that were encoded
before are looked up. Characters outside the vocabulary become byte pieces.

Null texts are empty; empty texts have the begin and end ids alone. Rows are independent; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import Recent, column

MARK = "▁"
CUT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
MOST_UNITS, MOST_PAIRS, LONG_UNIT = 200_000, 1_000_000, 64
_codecs: dict[str, Codec] = {}


class Codec:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback, the identity normalizer and a dummy prefix."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                self.bytes_of.append(p.replace(MARK, " ").encode())
                self.id[p], self.score[p] = i, sp.get_score(i)
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces that span words or lines aren't supported")
        probe = "\ufb01 \uff21  x "
        if sp.normalize(probe) != (MARK + probe).replace(" ", MARK):
            raise ValueError("only the identity normalizer with a dummy prefix is supported")
        # a piece that its own merges don't give is never an encoding's token
        self.piece = {i: p for p, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) == 1 or self.merge(p) == [p]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.marked = Recent(lambda u: self.pack(self.encode_unit(MARK + u)), MOST_UNITS)
        self.plain = Recent(lambda u: self.pack(self.encode_unit(u)), MOST_UNITS)
        for text in (probe, "one two\n\n three  \u4f60\U0001f600", "\u2581a \u2581"):
            if self.encode(text) != self.pack([self.bos, *sp.encode(text), self.eos]):
                raise ValueError("the model doesn't encode by merges of best score")

    def merge(self, text: str) -> list[str]:
        """The merges as defined, for short texts: best score first, then leftmost."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = self.score.get(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of two tokens' concatenation give the two."""
        x, y = self.piece[a], self.piece[b]
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        ok = self.pairs[a << 32 | b] = self.merge(x + y) == [x, y]
        return ok

    def encode_unit(self, unit: str) -> list[int]:
        n = len(unit)
        last, width, known = [-1] * (n + 1), [1] * (n + 1), self.pairs.get
        for e, (k, i) in self.automaton.iter(unit):  # of one end, the longest first
            e += 1
            if last[e] < 0:
                at = e - k
                if at:
                    before = last[at]
                    if before >= 0:  # else a character outside the vocabulary, which merges with nothing
                        ok = known(before << 32 | i)
                        if not (self.compatible(before, i) if ok is None else ok):
                            continue
                last[e], width[e] = i, k
        out: list[int] = []
        while n:
            i = last[n]
            if i < 0:
                out += [self.byte_id[x] for x in reversed(unit[n - 1].encode())]
            else:
                out.append(i)
            n -= width[n]
        return out[::-1]

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def forget(self) -> None:
        """Empties the caches: a worker outlives its task, and other stages run beside what it keeps."""
        self.pairs.clear()
        for x in (self.marked, self.plain):
            x.clear()
            x.old = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, with begin and end ids."""
        if not text:
            return self.pack([self.bos, self.eos])
        marked, plain = self.marked.__getitem__, self.plain.__getitem__
        if len(text) > LONG_UNIT * (text.count(" ") + text.count("\n") + 1):  # units too long to be kept
            marked, plain = self.marked.make, self.plain.make
        out, nl = [self.pack([self.bos])], self.plain["\n"]
        for k, line in enumerate(text.replace(MARK, " ").split("\n")):
            if k:
                out.append(nl)
            if "  " in line or line[:1] == " " or line[-1:] == " ":
                line = line.replace(" ", MARK)
                for unit in CUT.findall(line if k else MARK + line):
                    out.append(marked(unit[1:]) if unit[0] == MARK else plain(unit))
            elif line or not k:
                first, *rest = line.split(" ")
                out.append(plain(first) if k else marked(first))
                out += map(marked, rest)
        out.append(self.pack([self.eos]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; the dummy prefix goes."""
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", "replace").removeprefix(" ")


def codec(path: str | None = None) -> Codec:
    """A model's codec, one for each worker process; the path defaults to the public 32k BPE model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = True, place_col: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and with_ids also the packed ids and the decoded text, and a place_col as position."""
    d = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"), *([column(place_col).cast("long").alias("position")] if place_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            decoded = [c.decode(x) for x in ids]
            cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [*names, "ids", "decoded"]
            if place_col:
                cols, names = [*cols, b.column(2)], [*names, "position"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        c.forget()

    return d.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids + ", position long" * bool(place_col))
