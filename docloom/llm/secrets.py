"""Secret scan: three fixed patterns, and a token-efficiency test that finds random strings the patterns miss.

A candidate is a run of at least ``shortest`` characters of base64, hex or identifier alphabets with a letter. Text
that a tokenizer knows packs several characters into a token; random text doesn't. A run of fewer than ``max_ratio``
characters a token, whatever its length, is a span of kind "random", unless it overlaps a span of a pattern or is a known
kind of public string: a digest (32, 40, 56, 64, 96 or 128 hex digits), a UUID, a number, or words joined by separators or case. Each
word must itself have as many characters a token (or one or two letters in one token), and so must all of them together;
digits, up to four, end a word or stand between separators.

Spans are code points, end exclusive, of the whole match. Null and empty texts have none; rows are independent, so that
repeated ones repeat; other columns are not read. Each text is scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from docloom.llm.common import column

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Characters of a candidate at least, and characters a token below which it is random. Shorter runs are more often
#: invented words; the README has the recall and the false positives of both.
SHORTEST, MAX_RATIO = 16, 2.05
DIGEST = re.compile(r"(?i:[0-9a-f]+)")
DIGEST_SIZES = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[_/=+-]+")


@cache
def encoding(path: str | None = None):
    """A tiktoken encoding of a rank file; the path defaults to the public 50k byte-level vocabulary."""
    import public_tokenizers as P
    import tiktoken

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("docloom", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, leftmost non-overlapping for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def identifier(run: str, max_ratio: float, enc) -> bool:
    """Whether it is made of real words that separators or changes of case join."""
    last, letters, tokens = "", 0, 0
    for part in WORDS.findall(run):
        if part.isdigit():
            if len(part) > 4:
                return False
        elif part.isalpha():
            if last.isdigit() and not part.istitle():  # a digit joins nothing
                return False
            n = min(len(enc.encode_ordinary(x)) for x in (part, f" {part.lower()}"))
            if len(part) < max_ratio * n and (n > 1 or len(part) > 2):
                return False
            letters, tokens = letters + len(part), tokens + n
        last = part
    return letters >= max_ratio * tokens


def known(run: str, max_ratio: float, enc) -> bool:
    """Whether it is a digest, a UUID, a number or an identifier made of words."""
    return bool((DIGEST.fullmatch(run) and len(run) in DIGEST_SIZES) or UUID.fullmatch(run) or run.isdigit() or identifier(run, max_ratio, enc))


@cache
def runs(shortest: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_=-]{{{shortest},}}")


def random_spans(text: str, base: list[tuple[int, int, int]], max_ratio: float, enc, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    out = []
    for m in runs(shortest).finditer(text):
        run, s, e = m[0], *m.span()
        if not any(c.isalpha() for c in run) or any(a < e and s < b for a, _, b in base):
            continue
        if len(run) < max_ratio * len(enc.encode_ordinary(run)) and not known(run, max_ratio, enc):
            out.append((s, 3, e))
    return out


def scan(text: str, max_ratio: float = MAX_RATIO, enc=None, shortest: int = SHORTEST) -> tuple[list, list]:
    """The patterns' spans and all spans, as (start, kind index, end)."""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, max_ratio, enc or encoding(), shortest))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO, vocabulary: str | None = None, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans); spans are kind:start:end, comma-joined."""
    d = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        said = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for b in batches:
            found = [scan(t or "", max_ratio, enc, shortest) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(k == i for _, k, _ in x[1]) for x in found], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([said(x[0]) for x in found], pa.string()), pa.array([said(x[1]) for x in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans"])

    return d.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string")


def redact(text: str, max_ratio: float = MAX_RATIO) -> str:
    """The text with each span replaced by its kind in brackets."""
    at, out = 0, []
    for s, k, e in scan(text, max_ratio)[1]:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
