"""BPE encoding by a lexicon of frequent words, kept as a minimal acyclic transducer, and decoding.

Words (pre-tokens) are counted over all texts; those that hold at least a MOST_WORDS-th of all of them, which can't be more
than MOST_WORDS, are compiled: an automaton whose states share suffixes, with numbers on its arcs that add up to the word's
number, and for each number the word's ids. The file lies in the shared folder, Spark brings it to each executor, and the
workers there map it into memory. A batch's distinct words walk the automaton together, one byte a step. Words that it
doesn't hold are merged exactly by the model's ranks, the short ones of a batch together. So the ids are the tokenizer's own whatever the lexicon holds.

Null texts are empty, an empty text has no ids. Rows are independent, repeated ones are encoded each; other columns than
the id and the text are not read. Texts are cut at spaces into slices, so that memory follows a slice, not a text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import column, materialize, scratch_dir
from docloom.llm.token_store import BYTES, NORMAL, PIECE, PLAIN, SPLIT, _byte_letters

#: The lexicon holds words that are at least one in so many, hence at most so many words.
MOST_WORDS = 1_000_000
#: Bytes of a word of the lexicon, at most.
LONGEST = 48
#: Characters that are cut into words at once.
SLICE = 300_000
#: Words that a task counts before it hands its counts on.
MOST_COUNTED = 100_000
#: Unseen words that are merged at once.
TOGETHER = 8192
MAGIC = b"docloom lexicon 1\n"
#: Bits of an id in a pair.
BITS = 21
ONES, NONE = (1 << BITS) - 1, 1 << 62
_ODD = np.uint64(0x9E3779B97F4A7C15)


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The file of a lexicon: words ascending and distinct, with their ids.

    Words are added in order; once a word leaves a prefix, the states below it can't change any more and are replaced by
    equal ones met before, so that the automaton stays minimal throughout.
    """
    known: dict[tuple, int] = {}
    path: list[list] = [[False, []]]

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            to = known.setdefault((final, tuple(arcs)), len(known))
            path[-1][1][-1] = (path[-1][1][-1][0], to)

    last = b""
    for w in words:
        same = 0
        while same < len(last) and same < len(w) and last[same] == w[same]:
            same += 1
        settle(same)
        for byte in w[same:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0], last = True, w
    settle(0)
    start = known.setdefault((path[0][0], tuple(path[0][1])), len(known))
    accepted, final = np.zeros(len(known), np.int64), np.zeros(len(known), bool)
    key, target, add = [], [], []
    for (ends, arcs), s in known.items():  # states follow those that they lead to
        n, final[s] = int(ends), ends
        for byte, to in arcs:
            key.append(s << 8 | byte)
            target.append(to)
            add.append(n)
            n += int(accepted[to])
        accepted[s] = n
    slot, at = hashed(np.array(key, np.int64))
    to, plus = np.zeros(len(slot), np.int32), np.zeros(len(slot), np.int32)
    to[at], plus[at] = target, add
    size = np.array([len(x) for x in ids], np.int64)
    arrays = {"slot": slot, "to": to, "plus": plus, "final": final.astype(np.int8), "begin": np.concatenate([[0], np.cumsum(size)]).astype(np.int64), "ids": np.array([i for x in ids for i in x], np.int32)}
    table, body, at = {}, [], 0
    for name, a in arrays.items():
        raw = a.tobytes()
        table[name] = [at, str(a.dtype), len(a)]
        body += [raw, bytes(-len(raw) % 8)]
        at += len(raw) + -len(raw) % 8
    head = json.dumps({"start": start, "states": len(known), "arcs": len(key), "arrays": table}).encode()
    head = MAGIC + len(head).to_bytes(4, "little") + head
    return head + bytes(-len(head) % 8) + b"".join(body)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table of distinct keys, -1 where it is free, at least half of it, and each key's place in it."""
    bits = max(4, (2 * len(keys)).bit_length())
    slot, place = np.full(1 << bits, -1, np.int64), np.zeros(len(keys), np.int64)
    left, at = np.arange(len(keys)), _slots(keys, bits)
    while len(left):
        free = slot[at] < 0
        slot[at[free]] = keys[left[free]]
        won = slot[at] == keys[left]
        place[left[won]] = at[won]
        left, at = left[~won], (at[~won] + 1) & (len(slot) - 1)
    return slot, place


def find(slot: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in such a table, and whether they are there."""
    at = _slots(keys, len(slot).bit_length() - 1)
    found = slot[at]
    while (miss := np.flatnonzero((found != keys) & (found >= 0))).size:
        at[miss] = (at[miss] + 1) & (len(slot) - 1)
        found[miss] = slot[at[miss]]
    return at, found == keys


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if raw[: len(MAGIC)].tobytes() != MAGIC:
            raise ValueError("not a lexicon")
        at = len(MAGIC) + 4
        n = int.from_bytes(raw[len(MAGIC) : at].tobytes(), "little")
        told = json.loads(raw[at : at + n].tobytes())
        body = raw[at + n + -(at + n) % 8 :]
        self.start, self.states, self.arcs = told["start"], told["states"], told["arcs"]
        view = {k: body[o : o + m * np.dtype(t).itemsize].view(t) for k, (o, t, m) in told["arrays"].items()}
        self.slot, self.to, self.plus, self.final, self.begin, self.ids = (view[k] for k in ("slot", "to", "plus", "final", "begin", "ids"))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in ascending order, -1 for words that the lexicon doesn't hold."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        out, state = np.zeros(len(words), np.int64), np.full(len(words), self.start, np.int64)
        walk = np.flatnonzero(size <= LONGEST)
        out[size > LONGEST] = -1
        step = 0
        while True:
            walk = walk[size[walk] > step]
            if not len(walk):
                break
            at, ok = find(self.slot, state[walk] << 8 | flat[begin[walk] + step])
            out[walk[~ok]] = -1
            walk, at = walk[ok], at[ok]
            out[walk] += self.plus[at]
            state[walk] = self.to[at]
            step += 1
        out[(out >= 0) & (self.final[state] == 0)] = -1
        return out


def ragged(begin: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[begin : begin + size] of each, one after the other."""
    at = np.repeat(begin - (np.cumsum(size) - size), size)
    return flat[at + np.arange(len(at))]


class Words:
    """Cuts texts into the words of a tokenizers file and merges words by its ranks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told["pre_tokenizer"]
        steps = (split or {}).get("pretokenizers", [split])
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE models are supported")
        if not steps[-1] or steps[-1]["type"] != "ByteLevel" or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError("the pre-tokenizer must end in bytes, and special tokens must stand for themselves")
        self.plain = told["normalizer"] == NORMAL and split == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # a pair of ids in one number leads to its rank and, below it, the id of both
        self.rank = {self.vocab[a] << BITS | self.vocab[b]: r << BITS | self.vocab[a + b] for r, (a, b) in enumerate(pairs)}
        self.pair, at = hashed(np.fromiter(self.rank, np.int64, len(self.rank)))
        self.pair_rank = np.zeros(len(self.pair), np.int64)
        self.pair_rank[at] = np.fromiter(self.rank.values(), np.int64, len(self.rank))
        letters = _byte_letters()
        self.inner, self.last = (np.array([self.vocab.get(letters[b] + end, -1) for b in range(256)], np.int64) for end in ("", self.suffix))
        if max(self.vocab.values()) > ONES:
            raise ValueError(f"ids above {ONES} are not supported")
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.letters = _byte_letters()
        self.bytes_of = {c: b for b, c in self.letters.items()}

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, in characters."""
        if self.plain and PLAIN.fullmatch(text):
            return PIECE.findall(text.lower())
        t = self.tokenizer
        said = t.normalizer.normalize_str(text) if t.normalizer else text
        return [bytes(map(self.bytes_of.__getitem__, w)).decode() for w, _ in t.pre_tokenizer.pre_tokenize_str(said)]

    def slices(self, text: str) -> Iterator[str]:
        """A text in slices of about SLICE characters, cut before spaces that follow no white space."""
        at = 0
        while self.plain and len(text) - at > SLICE:
            m = _GAP.search(text, at + SLICE)
            if not m:
                break
            yield text[at : m.start() + 1]
            at = m.start() + 1
        yield text[at:]

    def cuts(self, text: str) -> Iterator[list[str]]:
        """The words of a whole text in lists; special tokens stand among them."""
        for i, x in enumerate(self.cut.split(text) if self.cut and any(n in text for n in self.special) else [text]):
            if i % 2:
                yield [x]
            else:
                for s in self.slices(x):
                    yield self.words(s)

    def merge(self, word: str) -> list[int]:
        """The ids of one word: of all adjacent pairs the one of lowest rank merges, the leftmost first, until none is left."""
        if word in self.special:
            return [self.special[word]]
        said = [self.letters[b] for b in word.encode()]
        said[-1] += self.suffix
        sym = [i for i in map(self.vocab.get, said) if i is not None]
        return self._many(sym)

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of many words the number of ids of each and where they begin in the third, the ids: short ones merge together, each its best pair in a round."""
        said = [w.encode() for w in words]
        size = np.fromiter(map(len, said), np.int64, len(said))
        n, begin, flat, end = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        rest = np.ones(len(words), bool)
        for lo, hi in ((1, 8), (9, 16), (17, 64)):
            own = np.array([i for i in np.flatnonzero((size >= lo) & (size <= hi)).tolist() if words[i] not in self.special], np.int64)
            for k in range(0, len(own), TOGETHER):
                some = own[k : k + TOGETHER]
                count, ids, ok = self._rounds([said[i] for i in some.tolist()], size[some])
                some = some[ok]
                n[some], begin[some], rest[some] = count, end + np.cumsum(count) - count, False
                flat.append(ids)
                end += len(ids)
        for i in np.flatnonzero(rest).tolist():
            ids = np.array(self.merge(words[i]), np.int64)
            n[i], begin[i] = len(ids), end
            flat.append(ids)
            end += len(ids)
        return n, begin, np.concatenate(flat) if flat else np.zeros(0, np.int64)

    def _rounds(self, said: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of ids and the ids of words that have symbols for all bytes, and which words those are."""
        n, wide = len(said), int(size.max())
        flat, begin = np.frombuffer(b"".join(said), np.uint8), np.cumsum(size) - size
        sym = np.full((n, wide + 1), -1, np.int64)
        row, col = np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(begin, size)
        sym[row, col] = np.where(col == np.repeat(size, size) - 1, self.last[flat], self.inner[flat])
        ok = (sym >= 0).sum(1) == size
        sym, size = sym[ok], size[ok]
        n = len(sym)
        rank = np.full((n, wide), NONE, np.int64)
        pair = np.arange(wide)[None, :] < size[:, None] - 1
        rank[pair] = self._ranks(sym[:, :-1][pair], sym[:, 1:][pair])
        right = np.tile(np.arange(1, wide + 2), (n, 1))
        left = np.tile(np.arange(-1, wide), (n, 1))
        here = np.arange(n)
        while len(here):
            i = rank[here].argmin(1)  # of equal ranks the leftmost
            least = rank[here, i]
            go = least != NONE
            here, i, least = here[go], i[go], least[go]
            j = right[here, i]
            after, new, before = right[here, j], least & ONES, left[here, i]
            sym[here, i], sym[here, j], rank[here, j % wide] = new, -1, NONE
            right[here, i] = after
            left[here, np.minimum(after, wide)] = i
            more = after < size[here]
            rank[here, i] = NONE
            rank[here[more], i[more]] = self._ranks(new[more], sym[here[more], after[more]])
            more = before >= 0
            rank[here[more], before[more]] = self._ranks(sym[here[more], before[more]], new[more])
        keep = sym >= 0
        return keep.sum(1), sym[keep], ok

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at, there = find(self.pair, a << BITS | b)
        return np.where(there, self.pair_rank[at], NONE)

    def _many(self, sym: list[int]) -> list[int]:
        """Merges a long word, in a heap of its pairs."""
        left, right = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        right[-1] = -1
        known = self.rank.get
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(len(sym) - 1) if (r := known(sym[i] << BITS | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            new = r & ONES
            sym[i], sym[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if (r := known(new << BITS | sym[right[j]])) is not None:
                    heapq.heappush(heap, (r, i, new, sym[right[j]]))
            if left[i] >= 0 and (r := known(sym[left[i]] << BITS | new)) is not None:
                heapq.heappush(heap, (r, left[i], sym[left[i]], new))
        return [x for x in sym if x >= 0]


_GAP = re.compile(r"(?<=\S) (?=\S)", re.ASCII)


class Codec:
    """Encoder of a tokenizers file with a lexicon, which may be absent."""

    def __init__(self, words: Words, lexicon: Lexicon | None):
        self.of, self.lexicon = words, lexicon

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of a list of words: the number of ids of each, and all ids."""
        each = list(set(words))
        code = dict(zip(each, range(len(each)), strict=True))
        codes = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
        if self.lexicon is None:
            number = np.full(len(each), -1, np.int64)
        else:
            number = self.lexicon.numbers([w.encode() for w in each])
            number[[code[s] for s in self.of.special if s in code]] = -1
        size, begin = np.zeros(len(each), np.int64), np.zeros(len(each), np.int64)
        flat, end = [np.zeros(0, np.int32)], 0
        hit = np.flatnonzero(number >= 0)
        if len(hit):
            first = self.lexicon.begin[number[hit]]
            size[hit] = self.lexicon.begin[number[hit] + 1] - first
            flat.append(ragged(first, size[hit], self.lexicon.ids))
            begin[hit] = np.cumsum(size[hit]) - size[hit]
            end = len(flat[-1])
        miss = np.flatnonzero(number < 0)
        if len(miss):
            size[miss], at, ids = self.of.merge_all([each[i] for i in miss.tolist()])
            begin[miss] = end + at
            flat.append(ids.astype(np.int32))
        return size[codes], ragged(begin[codes], size[codes], np.concatenate(flat))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the number of its ids, and the ids of all; cut and looked up about SLICE characters at a time."""
        total, out, held, of, chars = np.zeros(len(texts), np.int64), [], [], [], 0

        def flush() -> None:
            words = [w for x in held for w in x]
            size, ids = self.ids(words)
            np.add.at(total, np.repeat(of, [len(x) for x in held]).astype(np.int64), size)
            out.append(ids)
            held.clear()
            of.clear()

        for i, t in enumerate(texts):
            for x in self.of.cuts(t or ""):
                held.append(x)
                of.append(i)
                chars += sum(map(len, x))
                if chars >= SLICE:
                    flush()
                    chars = 0
        flush()
        return total, np.concatenate(out)


_made: dict[tuple, object] = {}


def _kept(kind, *key):
    """One of each for a worker process."""
    if (kind, *key) not in _made:
        _made[kind, *key] = kind(*key)
    return _made[kind, *key]


def _file(tokenizer: str | None) -> str:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return tokenizer


def count_words(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(word, n) of all words of all texts. Each task counts before the shuffle, in tables of about MOST_COUNTED words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n = _kept(Words, _file(tokenizer)), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for x in w.cuts(t or ""):
                    n.update(x)
                if len(n) > MOST_COUNTED:
                    yield _counted(n)
                    n.clear()
        yield _counted(n)

    return docs.select(column(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(n: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, most: int = MOST_WORDS) -> list[str]:
    """The words that are at least one in ``most`` of all, so that there are never more than ``most`` of them."""
    n = materialize(count_words(docs, text_col, tokenizer))
    total = n.agg(F.sum("n")).first()[0] or 0
    special = list(_kept(Words, _file(tokenizer)).special)
    rows = n.where((F.col("n") * most >= total) & (F.octet_length("word") <= LONGEST) & ~F.col("word").isin(special)).select("word").collect()
    return [r.word for r in rows]


def ship_lexicon(spark: SparkSession, words: list[str], tokenizer: str | None = None) -> str:
    """Compiles the words, writes the file to the shared folder and has Spark bring it to the executors; its name there."""
    w = _kept(Words, _file(tokenizer))
    words = sorted(words, key=str.encode)
    raw = compile_lexicon([x.encode() for x in words], [w.merge(x) for x in words])
    name = f"lexicon-{hashlib.sha256(raw).hexdigest()}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path)
        out.write(bytearray(raw))
        out.close()
        spark.sparkContext.addFile(path.toString())
    return name


class Decoder:
    """Decoder of a tokenizer."""

    def __init__(self, t):
        self.tokens = pa.array([t.id_to_token(i) or "" for i in range(1 + max(t.get_vocab(with_added_tokens=True).values()))], pa.string())
        self.tokenizer = None if t.decoder is None else t

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids, special tokens too; without a decoder in the file tokens are joined by spaces."""
        if self.tokenizer is None:
            at = pa.array(ids.offsets.to_numpy() - ids.offsets[0].as_py(), pa.int32())
            return pc.binary_join(pa.ListArray.from_arrays(at, self.tokens.take(ids.flatten())), " ")
        return pa.array(self.tokenizer.decode_batch([i or [] for i in ids.to_pylist()], skip_special_tokens=False), pa.string())


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, most: int = MOST_WORDS, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of each whole text, without special tokens of the tokenizer's own, padding or truncation; with ``decoded`` also the text that they decode to."""
    name = ship_lexicon(docs.sparkSession, frequent_words(docs, text_col, tokenizer, most), tokenizer)
    d = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _file(tokenizer)
        c, back = Codec(_kept(Words, path), _kept(Lexicon, SparkFiles.get(name))), Decoder(_kept(Words, path).tokenizer) if decoded else None
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            lot = np.cumsum(size) // (2 * SLICE)
            for i, j in zip(e := np.unique(np.concatenate([[0], np.flatnonzero(lot[1:] != lot[:-1]) + 1, [b.num_rows]])), e[1:]):
                part = b.slice(i, j - i)
                n, ids = c.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids, pa.int32()))
                out = {"doc_id": part.column(0), "n_tokens": pa.array(n), "ids": ids}
                yield pa.RecordBatch.from_pydict(out | ({"decoded": back.decode(ids)} if decoded else {}))
            pa.default_memory_pool().release_unused()

    return d.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>" + ", decoded string" * decoded)


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Adds ``decoded`` to encode_documents()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(_kept(Words, _file(tokenizer)).tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, back.decode(b.column(2))], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")
