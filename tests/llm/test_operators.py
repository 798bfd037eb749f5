"""Each operator against a brute-force version, a library or a round trip, on odd rows too."""

import hashlib
import random
import re
import tempfile
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docloom.llm import common, cover_dedup, fst_codec, jaccard_join, line_dedup, order_minhash, pfair_mix, prefix_trie, quality, secrets, sharding, spelling, spm_codec, token_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, rep string, cell string, slot string"
WORDS = "alpha beta gamma delta the of and Über straße naïve fjord über 123 x1 don't 你好 \U0001f600 tab\tin".split(" ")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "r", "p", "c", "s") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    line = "A line that is longer than forty characters, for sure"
    out = [(i, "\n".join([text(rng.randint(3, 40)) for _ in range(3)] + [line if i % 2 else f"  {line.upper()}\r"] * (i % 3)), f"s{i % 4}") for i in range(40)]
    base = text(200).split(" ")
    for i in range(40, 60):
        w = list(base)
        w[rng.randrange(200)] = "edit"
        out.append((i, " ".join(w), "hot"))
    out += [(60, None, None), (61, "", "s1"), (62, " \n\t ", "s1"), (63, "one", "s1"), (64, "one", "s2"), (65, text(20_000), "hot"), (66, "\n", "s1"), (67, "two  spaces   here ", "s1"), (68, f"{line}\n{line}\n\n{line}", "s1"), (69, "a" * 5000, "s1")]
    out += [out[5], out[5], (None, "no id here", "s1"), (None, line, None)]
    return out


def test_line_dedup(spark, rows):
    white = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(white))
    held = {}
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(-1 if i is None else i)
    stays = {k: max(v) for k, v in held.items() if len(v) >= 5}
    want = []
    for i, t, _ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if stays.get(key(x), -1 if i is None else i) == (-1 if i is None else i)]
        want.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.kept_text, r.n_lines, r.n_dropped)) for r in got.collect())
    assert any(w[3] for w in want)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_without_hot_keys(spark, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a key must then hold half of the lines to be hot
    try:
        many = [(i, f"{i} is a line that is found in one document only, yes", "s") for i in range(100)] + [(200 + i, "this is a line that is found in six documents, more or less", "s") for i in range(6)]
        got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(frame(spark, many)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {k for k, v in got.items() if v} == {200, 201, 202, 203, 204}


def test_sharding(spark, rows):
    shards = [f"s{i}" for i in range(5)]
    table = sharding.lookup_table(shards, 101)
    prefs = []
    for s in shards:
        h = hashlib.sha256(s.encode()).digest()
        o, k = int.from_bytes(h[:8], "big") % 101, int.from_bytes(h[8:16], "big") % 100 + 1
        prefs.append([(o + j * k) % 101 for j in range(101)])
    want, turn = [-1] * 101, 0
    while -1 in want:
        want[next(x for x in prefs[turn % 5] if want[x] < 0)] = turn % 5
        turn += 1
    assert table == want
    counts = np.bincount(sharding.lookup_table(shards, 65537))
    assert counts.max() - counts.min() <= 1
    less = sharding.lookup_table(shards[:-1], 65537)
    moved = sum(a != b for a, b in zip(sharding.lookup_table(shards, 65537), less) if a != 4)
    assert moved < 0.2 * 65537
    got = sharding.assign_shards(frame(spark, rows), "doc_id", shards, 101)
    assert got.count() == len(rows) and all(table[r.slot] == r.shard for r in got.collect())
    assert sharding.assign_shards(frame(spark, []), "doc_id", shards, 101).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


def brute(rows, num, den, width):
    sets = []
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    ids = [r[0] for r in rows]
    comp = {i: i for i in ids}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (ids[a], ids[b]) and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                comp[max(x, y)] = min(x, y)
    return sorted(map(str, ((i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets))))


@pytest.mark.parametrize(("num", "width"), [(90, 3), (80, 5)])
def test_jaccard(spark, rows, num, width, monkeypatch):
    got = jaccard_join.jaccard_components(frame(spark, rows), num, 100, width).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows, num, 100, width)
    assert jaccard_join.jaccard_components(frame(spark, []), num, 100, width).count() == 0


@pytest.mark.parametrize("num", [80, 90])
def test_jaccard_regions_by_pivots(spark, num, monkeypatch):
    """Regions above the leaf size, some without one large component."""
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    monkeypatch.setattr(jaccard_join, "SIG_LEAF", 4)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 4)
    monkeypatch.setattr(jaccard_join, "LEAST_PIVOTS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(num)
    out = []
    for g in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60 + 30 * g)]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randint(0, 3 + g)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            out.append((len(out), " ".join(w), "s"))
    got = jaccard_join.jaccard_components(frame(spark, out), num, 100, 3).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(out, num, 100, 3)


def test_jaccard_families_joined_by_one_pair(spark, monkeypatch):
    """Two large families whose only link is a pair that isn't likely to hold a pivot."""
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    monkeypatch.setattr(jaccard_join, "SIG_LEAF", 4)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 4)
    monkeypatch.setattr(jaccard_join, "LEAST_PIVOTS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(12)
    out = []
    for t in range(3):
        both = [f"c{t}x{i}" for i in range(88)]
        own = [[f"{side}{t}x{i}" for i in range(12)] for side in "ab"]
        for side in (0, 1):
            for k in range(70):
                w = both + own[side]
                for j in rng.sample(range(88), rng.randint(1, 2)):
                    w[j] = f"e{rng.randrange(10**9)}"
                if k == 0:  # one word of the other family, and no edit
                    w = both + own[side][:11] + [own[1 - side][0]]
                out.append((len(out), " ".join(w), "s"))
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard_join.jaccard_components(frame(spark, out), 80, 100, 1).collect())
    assert got == brute(out, 80, 100, 1) and len({x.rsplit(",")[-1] for x in got}) == 3


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(3)
    for num in (50, 80, 90, 95):
        p = jaccard_join.plan(num, 100)
        for _ in range(300):
            n = int(rng.integers(2, 60))
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.choice([0.9, 0.95, 1])], rng.integers(0, 2**63, rng.integers(0, 5)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= num * (len(x) + len(y) - both) and both < max(len(x), len(y)):
                rank = lambda sig: common.mix(sig ^ np.uint64(salt))  # noqa: E731  # any one order of all regions
                for salt in range(4):
                    rarest = [[v[np.argsort(rank(v))][: len(v) - k] for k, v in jaccard_join.signatures(z, p)] for z in (x, y)]
                    assert len(np.intersect1d(*map(np.concatenate, rarest))), (num, len(x), len(y))
                d = jaccard_join._apart([jaccard_join.buckets(x), jaccard_join.buckets(y)], np.array([0]), np.array([1]))[0]
                assert d <= p.differ(len(x), len(y))


def test_counts_of_sets_of_unlike_sizes():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (5, 1000, 1100, 5000, 40_000)]
    sets += [np.unique(np.concatenate([s[: len(s) // 2], s[-1:]])) for s in sets]
    i, j = np.triu_indices(len(sets), 1)
    bounds = jaccard_join._apart([jaccard_join.buckets(s) for s in sets], i, j)
    assert all(b <= len(np.setxor1d(sets[a], sets[c])) for b, a, c in zip(bounds, i, j))
    assert bounds[(i == 3) & (j == 4)][0] > 30_000


@pytest.mark.parametrize(("na", "nb", "universe", "most"), [(5, 7, 50, 20), (60, 80, 400, 100), (150, 90, 3000, 200)])
def test_overlaps(na, nb, universe, most):
    rng = np.random.default_rng(na)
    u = rng.integers(0, 2**64, universe, np.uint64)
    a = [np.unique(rng.choice(u, rng.integers(0, most))) for _ in range(na)]
    b = [np.unique(np.concatenate([rng.choice(u[: universe // 3], rng.integers(0, most)), rng.integers(0, 2**64, 5, np.uint64)])) for _ in range(nb)]
    assert (jaccard_join.overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_jaccard_one_large_group(spark):
    """Near copies of one text, few of them linked directly, with the sizes of production."""
    rng = random.Random(30)
    base, out = [f"w{i}" for i in range(60)], []
    for i in range(3000):
        w = list(base)
        for _ in range(rng.choice((1, 1, 2, 3))):
            w[rng.randrange(60)] = f"e{rng.randrange(10**9)}"
        out.append((i, " ".join(w), "s"))
    sets = [common.shingles(t.encode(), 2, common.WordHash()) for _, t, _ in out]
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    m = np.zeros((len(sets), len(names)), np.float32)
    m[np.repeat(np.arange(len(sets)), list(map(len, sets))), at] = 1
    m = m[:, m.sum(0) > 1]
    size = np.array(list(map(len, sets)))
    both = m @ m.T
    a, b = np.nonzero(np.triu(100 * both >= 90 * (size[:, None] + size - both), 1))
    want = common.roots(len(sets), a, b)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, out), 90, 100, 2).collect()}
    assert [got[i] for i in range(3000)] == want.tolist() and 1 < len(set(want.tolist())) < 3000


def test_secrets(spark):
    rng = random.Random(2)
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    text = f"é password: 'Abcdefghijkl9' PASSWORD=short token=secret=abcdefghijklmnop api_key = \"x\" AKIA{'A1' * 8} AKIAX {'0a' * 16} {key} d41d8cd98f00b204e9800998ecf8427e 123e4567-e89b-12d3-a456-426614174000 some_long_identifier_name_1 {'deadbeef' * 2}"
    base, every = secrets.scan(text)
    said = {(secrets.KINDS[k], text[s:e]) for s, k, e in every}
    assert ("assign", "password: 'Abcdefghijkl9") in said and ("access", "AKIA" + "A1" * 8) in said and ("random", key) in said
    assert ("assign", "token=secret=abcdefghijklmnop") in said and ("hex", "deadbeef" * 2) in said
    assert set(base) <= set(every) and len(every) == len(base) + 1
    assert not secrets.scan("ordinary text with some_long_identifier_name_1 and 123e4567-e89b-12d3-a456-426614174000")[1]
    got = secrets.scan_secrets(frame(spark, [(1, text, "s"), (1, text, "s"), (2, None, "s"), (None, "", "s")])).collect()
    assert [r.n_assign for r in got] == [2, 2, 0, 0] and got[0].spans == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in every)
    assert key not in secrets.redact(text)
    assert secrets.scan_secrets(frame(spark, [])).count() == 0


def test_secrets_of_one_case_or_without_digits():
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for alphabet in (lower + "0123456789", upper + "0123456789", upper + "234567", lower + upper, lower + upper + "0123456789"):
        for n in (20, 24, 32):
            rng = random.Random(n)
            keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(300)]
            assert sum(not secrets.scan(f"a {k} b")[1] for k in keys) <= 3, (alphabet, n)
    for alphabet, least in ((lower + "0123456789", 0.97), (lower + upper, 0.97), (upper, 0.93), (lower, 0.85), (lower + upper + "0123456789+/", 0.97)):
        rng = random.Random(16)
        keys = ["".join(rng.choice(alphabet) for _ in range(rng.randint(16, 19))) for _ in range(400)]
        assert sum(bool(secrets.scan(f"a {k} b")[1]) for k in keys) >= least * 400, alphabet
    for name in ("someLongIdentifierNameHere", "get_user_by_id_or_name_2", "HTTPServerConnectionPool", "src/main/java/com/example/Foo", "base64EncodeToString2Bytes", "2024-01-15/2024-02-15", "-" * 40):
        assert not secrets.scan(f"a {name} b")[1], name


def test_hex_and_access_patterns_agree_with_the_plain_ones():
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice("abf0129AKIAZ =:'token") for _ in range(200))
        want = sorted([(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18])
        assert [x for x in secrets.base_spans(t) if x[1]] == want


def test_quality(spark, rows):
    rng = random.Random(5)
    good = [(i, " ".join(rng.choice(["the", "house", "is", "green", "today."]) for _ in range(rng.randint(5, 80))), "s") for i in range(300)]
    bad = [(300 + i, " ".join(rng.choice(["the", "h##", "is$$", "gr%%", "0101"]) for _ in range(rng.randint(5, 80))), "s") for i in range(300)]
    docs = frame(spark, good + bad + rows[:0])
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(600)] + [(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    model = quality.train(docs, labels.where("doc_id % 5 <> 0 or doc_id is null"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.mean([(got[i] > 0.5) == (i < 300) for i in range(0, 600, 5)]) > 0.97
    odd = quality.score(frame(spark, rows), model).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    none = quality.train(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    x = np.random.default_rng(1).normal(size=(500, 4))
    t = quality.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=5)
    for row, s in zip(x[:50], t.score(x[:50])):
        total = t.base
        for f, c, leaf in zip(t.feature, t.cut, t.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + bool(row[f[at]] > c[at])
            total += leaf[at - len(f)]
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-12


def test_order_minhash(spark, rows):
    got = order_minhash.fingerprint_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(t or "")
    by = {r.doc_id: r for r in got if r.doc_id is not None and len(texts[r.doc_id]) == 1}
    ids = sorted(by, reverse=True)
    cache = common.WordHash()
    for a, b in zip(ids, ids[1:]):
        if a - b != 1 or len(texts[b]) > 1:
            continue
        x, y = texts[a][0], texts[b][0]
        e = x[: len(x) - len(x) // 3] + y[: len(x) // 3]
        assert by[a].n_chars == len(x) and by[a].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        f = lambda t: order_minhash.fingerprint(t).astype(">u4").tobytes().hex()
        assert (by[a].fingerprint, by[a].edited_fingerprint) == (f(x), f(e))
    assert by[63].fingerprint == by[64].fingerprint and by[61].fingerprint == ""
    words = "one two three four five six seven eight nine ten".split()
    a, b = order_minhash.fingerprint(" ".join(words * 3)), order_minhash.fingerprint(" ".join(words * 2 + words[5:] + words[:5]))
    assert 0 < order_minhash.likeness(a, b) < 1  # the order counts
    assert order_minhash.fingerprint_documents(frame(spark, [])).count() == 0
    one = order_minhash.fingerprint_documents(frame(spark, [(1, "a b c d e f", "s")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_order_minhash_against_its_definition():
    cache = common.WordHash()
    rng = random.Random(8)
    for n in (1, 2, 3, 5, 60):
        t = " ".join(rng.choice("abc") for _ in range(n))
        u = order_minhash.units(t)
        k, seen, items = min(order_minhash.K, len(u)), {}, []
        for i in range(len(u) - k + 1):
            run = tuple(u[i : i + k].tolist())
            nth = seen[run] = seen.get(run, -1) + 1
            h = np.array([k], np.uint64)
            for x in run:
                h = common.mix(h * order_minhash._GOLD + np.uint64(x))
            items.append(common.mix(h + np.array([nth], np.uint64) * order_minhash._GOLD)[0])
        got = order_minhash.fingerprint(t)
        if len(items) > 1:
            for j, m in enumerate(order_minhash._MULT):
                v = sorted(range(len(items)), key=lambda i: int(items[i]) * int(m) % 2**64)[:2]
                a, b = (np.array([items[i]]) for i in sorted(v))
                assert got[j] == int(common.mix(a * order_minhash._GOLD + common.mix(b + m))[0]) >> 32


def test_order_minhash_of_long_words_and_hot_ids(spark):
    """Units are chosen word by word, so that a text of long words is like its edited text; hot ids are cut by their texts."""
    rng = random.Random(21)
    word = lambda lo, hi: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(lo, hi)))
    docs = [(i, " ".join(word(24, 39) for _ in range(60)), "s") for i in range(12)] + [(20 + i, word(4000, 4000), "s") for i in range(4)] + [(30 + i, " ".join(word(3, 30) for _ in range(60)), "s") for i in range(6)]
    docs += [(None, f"no id {i} " * 30, "s") for i in range(40)] + [(50, f"one id {i} " * 30, "s") for i in range(40)]
    got = order_minhash.fingerprint_documents(frame(spark, docs), ranges=8).collect()
    assert len(got) == len(docs)
    near = [r.near_edited for r in got if r.doc_id is not None and r.doc_id < 40]
    # two thirds of each text stay, half of all runs of either: a pair of the two least is common with a chance of 0.25, less the runs beside the edit
    assert min(near) > 0.05 and np.mean(near) > 0.2
    long = [" ".join(word(24, 39) for _ in range(60)) for _ in range(300)]
    like = [order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(order_minhash.edited(a, b))) for a, b in zip(long, long[1:])]
    assert 0.22 < np.mean(like) < 0.26
    text = "".join(rng.choice("abcdefghij") for _ in range(30_000))
    whole, moved = order_minhash.units(text), order_minhash.units("zz" + text)  # an edit moves no other cut
    assert len(set(whole) - set(moved)) <= 3 and len(whole) > 2000
    h = {t: spark.createDataFrame([(t,)], "t string").selectExpr("xxhash64(t) AS h").first().h for _, t, _ in docs}
    order = sorted(docs, key=lambda d: (-(2**63) if d[0] is None else d[0], h[d[1]]), reverse=True)
    cache, want = common.WordHash(), []
    for (i, x, _), (_, y, _) in zip(order, order[1:] + order[:1]):
        e = order_minhash.edited(x, y)
        f, g, n = (order_minhash.fingerprint(t) for t in (x, e, y))
        want.append((i, hashlib.sha256(e.encode()).hexdigest(), order_minhash.likeness(f, g), order_minhash.likeness(f, n)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.edited_sha256, r.near_edited, r.near_next)) for r in got)


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    v = []
    for g in range(30):
        c = rng.normal(size=16)
        v += [(c + 0.2 * rng.normal(size=16)).astype(np.float32).tolist() for _ in range(12)]
    labels = [int(i % 3) for i in range(len(v))]
    v += [v[0], v[0], v[3]]
    labels += [labels[0], labels[0], labels[3]]
    rows = [(i, x, c) for i, (x, c) in enumerate(zip(v, labels))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, v[0], None), (n + 5, [1.0], 0), (n + 6, [2.0], 0), (n + 7, [], 0), (None, v[0], 0)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id long, embedding array<float>, label int, rep string, i string, v string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_dedup.dedup_embeddings(df, block=64).collect()}
    good = [r for r in rows if r[0] is not None and r[0] < n or r[0] in (n + 5, n + 6)]
    comp, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for a in good:
        for b in good:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = find(a[0]), find(b[0])
                    comp[max(p, q)] = min(p, q)
    assert got == {i: (links[i], find(i), i is not None and find(i) == i) for i in links}
    assert sum(links.values()) > 100
    assert cover_dedup.dedup_embeddings(df.limit(0)).count() == 0


def test_cover_tree_invariants():
    x = np.random.default_rng(9).normal(size=(400, 6))
    x /= np.sqrt((x * x).sum(1))[:, None]
    t = cover_dedup.CoverTree(x)
    for c, r, kids, points in zip(t.centre, t.radius, t.children, t.points):
        assert cover_dedup.distance(x[points], x[c][None]).max() <= r + 1e-12
        if kids:
            assert sorted(np.concatenate([t.points[k] for k in kids])) == sorted(points) and c in {t.centre[k] for k in kids}


def test_sentencepiece(spark, rows):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    c = spm_codec.codec()
    rng = random.Random(6)
    odd = ["", " ", "\n", "  ", "\n\n a", " a", "a ", "▁", "▁▁ x", "a▁b", "<s> x </s>", "<0x41>", "\x00\x01", "    indented\n\tcode  here", "ﬁ ½ é", "　x"]
    texts = odd + [t or "" for _, t, _ in rows] + ["".join(rng.choice("ab \n▁theé你\U0001f600\t0") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for t in texts:
        want = sp.encode(t, add_bos=True, add_eos=True)
        got = c.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, t
        assert c.decode(got) == sp.decode(want), t
    got = spm_codec.encode_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.decoded)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, sp.decode(sp.encode(r[1] or ""))))):
        assert r.n_tokens == len(sp.encode(t or "")) + 2
    assert spm_codec.encode_documents(frame(spark, [])).count() == 0


ODD_TEXTS = ["", " ", "a", "The  quick\tBrown FOX's don't I'LL", "<|endoftext|>x <|startoftext|><|endoftext|> <|endoftext", "á vs a\u0301, \u0130 \u1e9e \u03a3\u03c2\u03a3 \ufb01", "\u4f60\u597d\u4e16\u754c \U0001f600\U0001f468\u200d\U0001f469", "nb\u00a0sp \x1c \x85 \u2028x", "x" * 5000, "ab" * 3000 + "c", "...!!!###$$$ 12345 1,000.5", "\u00bfqu\u00e9? \u00a1s\u00ed!", "\x00\x01", "\u0e44\u0e17\u0e22 \u05e9\u05dc\u05d5\u05dd"]


def test_lexicon():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))).encode() for _ in range(4000)})
    ids = [[rng.randrange(49_000) for _ in range(rng.randint(1, 4))] for _ in words]
    raw = fst_codec.compile_lexicon(words, ids)
    with tempfile.TemporaryDirectory() as d:
        path = f"{d}/lexicon"
        with open(path, "wb") as f:
            f.write(raw)
        x = fst_codec.Lexicon(path)
        asked = words[::3] + [w + b"!" for w in words[:50]] + [w[:-1] for w in words[:500]] + [b"", b"z" * 100]
        at = {w: i for i, w in enumerate(words)}
        got = x.numbers(asked)
        assert got.tolist() == [at.get(w, -1) for w in asked]
        assert all(x.ids[x.begin[i] : x.begin[i + 1]].tolist() == ids[i] for i in range(len(words)))
        # minimal: as many states as there are different sets of endings
        rest = {}
        for w in words:
            for i in range(len(w) + 1):
                rest.setdefault(w[:i], set()).add(w[i:])
        assert x.states == len({frozenset(v) for v in rest.values()}) and x.states < len(rest) // 2
    with tempfile.TemporaryDirectory() as d:
        with open(f"{d}/none", "wb") as f:
            f.write(fst_codec.compile_lexicon([], []))
        assert fst_codec.Lexicon(f"{d}/none").numbers([b"a", b""]).tolist() == [-1, -1]


def test_fst_codec_equals_the_library(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    rng = random.Random(8)
    letters = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x180), 0x301, 0x3A3, 0x2003, 0x4E00, 0x1F600)]
    more = ODD_TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    words = fst_codec.Words(public_tokenizers.path("word_bpe_49k.json"))
    for most in (1, 10**6):  # whatever the lexicon holds
        d = frame(spark, rows + [(1000 + i, x, "s") for i, x in enumerate(more)] + [(5000, None, "s")])
        got = fst_codec.encode_documents(d, most=most, decoded=True)
        want = sorted((str(i), (ids := t.encode(x or "", add_special_tokens=False).ids), t.decode(ids, skip_special_tokens=False)) for i, x, _ in [*rows, *((1000 + i, x, 0) for i, x in enumerate(more)), (5000, None, 0)])
        assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got.collect()) == want
    again = fst_codec.decode_documents(got.drop("decoded")).join(got.select("doc_id", F.col("decoded").alias("was"), F.col("ids").alias("i")), "doc_id").where("ids = i and decoded <> was")
    assert again.count() == 0 and got.where("n_tokens <> size(ids)").count() == 0
    assert fst_codec.encode_documents(frame(spark, [])).count() == 0
    for w in ["a" * n for n in (1, 2, 63, 64, 65, 66, 200)] + ["".join(rng.choice("abcth") for _ in range(n)) for n in (60, 64, 70, 300)]:
        assert words.merge(w) == t.encode(w, add_special_tokens=False).ids
    many = sorted({x for m in more for x in words.words(m)}) + ["<|endoftext|>", "q"]
    n, begin, flat = words.merge_all(many)
    assert [flat[i : i + k].tolist() for i, k in zip(begin, n)] == [words.merge(w) for w in many]
    assert "".join(words.slices("ab cd  ef " * 300_000)) == "ab cd  ef " * 300_000 and max(map(len, words.slices("ab cd  ef " * 300_000))) < 1_000_100


def plain_trie(turns):
    """Nodes by brute force from (conv, turn, role, text)."""
    c, nodes, ends = {}, {}, {}
    for i, n, role, text in sorted((t for t in turns if t[0] is not None), key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2] or "", (t[3] or "").encode())):
        c.setdefault(i, []).append((role or "", text or ""))
    for i in sorted(c):
        h = zlib.crc32(str(i).encode()) % 9
        whole = tuple(c.get(i - i % 5, [])[:h] + c[i][h:])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append(i)
        ends.setdefault(whole, []).append(i)
    children, leaves, saved = {}, {}, {}
    for k in nodes:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in children)
            saved[k[:d]] = saved.get(k[:d], 0) + (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()
    return sorted(map(str, ((m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), children.get(k, 0), leaves[k], saved[k], sha(k)) for k, m in nodes.items())))


TURNS = "conv_id long, turn long, role string, text string, conv string, pos int"


def test_prefix_trie(spark):
    rng = random.Random(12)
    say = lambda: rng.choice(["yes", "no", "Über", "", "a longer answer", None])
    turns = [(i, n, rng.choice(["user", None, ""]), say()) for i in range(120) if i % 7 for n in range(rng.randint(0, 12))]
    turns += [(300, n, "user", f"t{n}") for n in range(700)]  # one holds a third of the rows
    turns += [(301, n, "user", f"t{n}") for n in range(20)] + [(303, n, "user", f"t{n}") for n in range(250)]
    turns += [(400 + i, n, "user", f"same {n}") for i in range(300) for n in range(2)]  # many equal ones
    turns += [(500, None, "b", "null turns"), (500, None, "a", "come first"), (500, 1, "x", "tie b"), (500, 1, "x", "tie a"), (500, 1, "x", "tie a"), (None, 1, "user", "of none"), (7, 3, None, None), (7, 3, None, None)]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        d = spark.createDataFrame([(*t, "x", 1) for t in turns], TURNS).repartition(3)
        got = prefix_trie.prefix_trie(d).drop("digest").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(str(tuple(r)) for r in got) == plain_trie(turns)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    alone = prefix_trie.prefix_trie(spark.createDataFrame([(3, 0, "user", "hi", "x", 1)], TURNS)).drop("digest").collect()
    assert sorted(str(tuple(r)) for r in alone) == plain_trie([(3, 0, "user", "hi")])


def plain_spellings(n):
    """(word, form, root, n, n_near, form_n) by brute force."""
    near = {w: set() for w in n}
    for w in n:
        for x in (w[:i] + w[i + 1 :] for i in range(len(w))):
            if x in n:
                near[w].add(x)
                near[x].add(w)
    by = {}
    for w in n:
        for i in range(len(w)):
            by.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
    for m in by.values():
        for w in m:
            near[w] |= {x for x in m if x != w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(map(str, ((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)))


def test_spelling_variants(spark):
    rng = random.Random(4)
    n = {}
    for _ in range(500):
        w = rng.choice(["prefix", "", "xy"]) + "".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) + rng.choice(["", "suffix"])
        n[w] = rng.choice([1, 2, 30, 500, 9000])
    n |= {"aaaaaaa": 5, "aaaaaaaa": 60, "aaaaaaaaa": 700, "a": 3, "b": 40, "ab": 2, "x" * 5000: 4, "x" * 4999: 50}
    want = plain_spellings(n)
    d = spark.createDataFrame(list(n.items()), "word string, n long")
    for bucket in (2, 10_000):  # cut again as often as there is anything to cut, and never
        assert sorted(str(tuple(r)) for r in spelling.group_spellings(d, bucket=bucket).collect()) == want
    assert spelling.group_spellings(d.limit(0)).count() == 0
    text = "Elephant elephant, ELEPHANT\nelefant\u00dcber\u00fcberaus don't elephant9 tinyw sevenly Sevenly"
    docs = [(1, text, "s"), (2, text, "s"), (2, text, "s"), (3, None, "s"), (None, "sevenly", "s"), (4, "", "s"), (5, "x" * 100_000 + " " + "y" * 7, "s")]

    def plain(drop):
        out = {}
        up = str.maketrans(common.UPPER, common.LOWER)
        for i, t, _ in docs:
            for w in re.findall("[A-Za-z\u00c0-\u00ff]+", (t or "").translate(up)):
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if drop and h % drop == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                out[w] = out.get(w, 0) + 1
        return {w: k for w, k in out.items() if len(w) >= 7 and k >= 2}

    for drop in (None, 1, 2):
        assert {r.word: r.n for r in spelling.corpus_words(frame(spark, docs), drop_every=drop).collect()} == plain(drop)


def slots_of(blocks, weights):
    """All slots of a mixture, (source, its block), by phases and periods."""
    out = {}
    for p in pfair_mix.phases(blocks, weights):
        assert p.slot == len(out)
        slots = sum(p.shares.values())
        for place, (i, k) in enumerate(pfair_mix.earliest(p.shares, min(p.slots, slots))):
            for at in range(place, p.slots, slots):
                out[p.slot + at] = (i, p.before[i] + k + at // slots * p.shares[i])
    assert sorted(out.values()) == sorted((i, k) for i, n in enumerate(blocks) for k in range(n))
    return [out[t] for t in sorted(out)]


def plain_schedule(blocks, weights):
    """Earliest deadline first over all blocks, without periods; a phase ends where a source's last deadline is."""
    left, done, out = dict(enumerate(blocks)), [0] * len(blocks), []
    while left := {i: n for i, n in left.items() if n}:
        total, k = sum(weights[i] for i in left), dict.fromkeys(left, 0)
        w = {i: Fraction(weights[i], total) for i in left}
        due = lambda i, n: -(-(n + 1) // w[i])  # noqa: E731, B023
        for t in range(min(-(-n // w[i]) for i, n in left.items())):
            i = min((due(i, k[i]), due(i, k[i] + 1), i) for i in left if k[i] // w[i] <= t)[2]
            assert due(i, k[i]) > t  # no deadline is missed
            if left[i]:
                out.append((i, done[i]))
                k[i], done[i], left[i] = k[i] + 1, done[i] + 1, left[i] - 1
    return out


def within_a_block(slots, weights, upto):
    total, seen = sum(weights), [0] * len(weights)
    for t, (i, _) in enumerate(slots[:upto], 1):
        seen[i] += 1
        assert all(abs(n * total - w * t) < total for n, w in zip(seen, weights)), t


def test_pfair(spark, rows):
    w = [5, 3, 1, 1]
    slots = slots_of([50, 30, 40, 10], w)
    assert sorted(slots) == sorted((i, k) for i, n in enumerate([50, 30, 40, 10]) for k in range(n))
    seen = [0] * 4
    for t, (i, _) in enumerate(slots[:98], 1):  # all four last so long
        seen[i] += 1
        assert all(abs(seen[j] - Fraction(w[j] * t, 10)) < 1 for j in range(4))
    assert [k for i, k in slots if i == 2] == list(range(40))
    rng = random.Random(3)
    for _ in range(20):
        w = [rng.randint(1, 50) for _ in range(rng.randint(2, 8))]
        total, seen = sum(w), [0] * len(w)
        for t, (i, _) in enumerate(slots_of([20 * x for x in w], w)[: 5 * total], 1):
            seen[i] += 1
            assert all(abs(seen[j] - Fraction(w[j] * t, total)) < 1 for j in range(len(w)))
        w, n = [2 * rng.randint(1, 9) for _ in range(5)], [rng.randint(0, 60) for _ in range(5)]
        assert slots_of(n, w) == plain_schedule(n, w)
        within_a_block(slots_of([9 * x for x in w], w), w, 9 * sum(w))
    within_a_block(slots_of([4000, 3000], [99_991, 70_001]), [99_991, 70_001], 6799)
    w = [rng.randint(1, 10**6) for _ in range(200)]
    n = [3 * max(1, x // 10**5) for x in w]
    within_a_block(slots_of(n, w), w, min(k * sum(w) // x for k, x in zip(n, w)))
    got = pfair_mix.mix_sources(frame(spark, rows), {"hot": 3}, block_rows=2).collect()
    want = [(i, s) for i, _, s in rows]
    assert sorted(map(str, ((r.doc_id, r.source) for r in got))) == sorted(map(str, want)) and sorted(r.position for r in got) == list(range(len(want)))
    whole = pfair_mix.mix_documents(frame(spark, rows), {"hot": 3}, block_rows=2)
    assert sorted(map(str, whole.collect())) == sorted(map(str, frame(spark, rows).collect()))
    assert pfair_mix.mix_sources(frame(spark, []), {}).count() == 0
    with pytest.raises(ValueError):
        pfair_mix.mix_sources(frame(spark, rows), {"hot": 0})


def test_pfair_positions_are_those_of_the_schedule(spark):
    names = ["a", "b", "c", None]
    count = {"a": 75, "b": 200, "c": 41, None: 33}
    weights = {"a": 4, "b": 2, "c": 1, None: 1}
    docs = [(i, "x", s) for i, s in enumerate(s for s in names for _ in range(count[s]))]
    got = sorted((r.position, r.slot, r.source) for r in pfair_mix.mix_sources(frame(spark, docs), weights, 1, block_rows=8).collect())
    order = [None, "a", "b", "c"]
    want = []
    for slot, (i, b) in enumerate(plain_schedule([-(-count[s] // 8) for s in order], [weights.get(s, 1) for s in order])):
        want += [(slot, order[i])] * min(8, count[order[i]] - 8 * b)
    assert got == [(p, *x) for p, x in enumerate(want)]


def test_odd_column_names(spark):
    """Dots and names that the operators use themselves."""
    d = spark.createDataFrame([(1, "good text here", 1, 2, 3), (2, None, 1, 2, 3)], "`a.id` long, `the.text` string, `docloom slot` int, `docloom key slot` int, `docloom shard` int")
    got = sharding.assign_shards(d, "a.id", ["x", "y"], 101)
    assert got.columns == [*d.columns, "slot", "shard"] and {r["docloom slot"] for r in got.collect()} == {1}
    kept = line_dedup.dedup_lines(d, "a.id", "the.text")
    assert sorted((r.doc_id, r.kept_text, r.whole["docloom slot"]) for r in kept.collect()) == [(1, "good text here", 1), (2, "", 1)]
    none = quality.train(d.withColumnRenamed("a.id", "doc_id").withColumnRenamed("the.text", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(d, none, "a.id", "the.text", keep=d.columns, score_col="s").columns == [*d.columns, "s"]


def test_dots_and_clashing_names_everywhere(spark, tmp_path):
    """Ids, texts and vectors in columns with dots, beside columns of the operators' own names."""
    own = [x.strip("`") for x in "doc doc_id text rep cell o row r label v dim n word id run key conv part pos a b".split(" ")] + ["near copy"]
    extra = ", ".join(f"'{i}' as `{c}`" for i, c in enumerate(own))
    text = "some words that are the same in both of these texts password=abcdefghijkl12345 and so on"
    d = spark.createDataFrame([(1, text), (2, text), (3, None)], "`a.id` long, `the.text` string").selectExpr("*", *extra.split(", "))
    args = ("a.id", "the.text")
    ids = lambda x: sorted(r.doc_id for r in x.select("doc_id").collect())
    assert ids(jaccard_join.jaccard_components(d, 80, 100, 5, *args)) == [1, 2, 3]
    assert sorted(r["a.id"] for r in jaccard_join.keep_one(d, 80, 100, 5, *args).collect()) == [1, 3]
    assert {r.doc_id: r.n_assign for r in secrets.scan_secrets(d, *args).collect()} == {1: 1, 2: 1, 3: 0}
    assert ids(order_minhash.fingerprint_documents(d, *args)) == ids(spm_codec.encode_documents(d, *args)) == ids(fst_codec.encode_documents(d, *args)) == [1, 2, 3]
    token_store.write_store(d, str(tmp_path / "store"), *args)
    assert ids(token_store.read_index(spark, str(tmp_path / "store"))) == [1, 2, 3]
    assert {r.word: r.n for r in spelling.corpus_words(d, *args, shortest=5).collect()} == {"words": 2, "these": 2, "texts": 2, "password": 2, "abcdefghijkl": 2}
    v = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 0.01], "x"), (3, None, "x")], "`a.id` long, `the.v` array<float>, `its.label` string").selectExpr("*", *extra.split(", "))
    assert {r.vec_id: r.component_id for r in cover_dedup.dedup_embeddings(v, 0.93, "a.id", "the.v", "its.label").collect()} == {1: 1, 2: 1, 3: 3}
    t = spark.createDataFrame([(5, 0, "user", "hi")], "`c.id` long, `t.n` long, `the.role` string, `the.text` string").selectExpr("*", *extra.split(", "))
    assert prefix_trie.number_turns(t, "c.id", "t.n", "the.role", "the.text").select("conv", "pos", "size").collect() == [(5, 1, 2)]


def test_pfair_repeated_rows_and_odd_columns(spark):
    """Equal rows, rows that differ beside id and source only, and names with dots and of the operator's own."""
    rows = [(i % 5, f"t{i % 3}", "s0" if i % 2 else None, {"k": i % 2}) for i in range(120)]
    d = spark.createDataFrame(rows, "`a.id` long, position string, `the.source` string, m map<string,int>").selectExpr("*", "1 as `mixed position`", "2 as `mixed id`", "3 as `in file`", "4 as `mixed file`")
    got = pfair_mix.mix_documents(d, {"s0": 2}, 1, "a.id", "the.source", block_rows=4)
    assert got.columns == d.columns and sorted(map(str, got.collect())) == sorted(map(str, d.collect()))
    placed = common.materialize(got)
    out = pfair_mix.written_places(placed, "docloom place").collect()
    assert sorted(r["docloom place"] for r in out) == list(range(120))
    first = [r["the.source"] for r in sorted(out, key=lambda r: r["docloom place"])]
    assert all(abs(first[:t].count("s0") - 2 * t / 3) < 8 for t in range(0, 80, 4))


def test_pfair_with_many_sources(spark, rows):
    host = lambda i: "src0" if i < 400 else None if i < 500 else f"host{i % 60}"
    many = [(i, "x", host(i)) for i in range(1100)] + [(2000 + i, "x", "host7") for i in range(200)]
    got = sorted((r.position, r.source) for r in pfair_mix.mix_sources(frame(spark, many), {"src0": 60}, block_rows=4).collect())
    assert [p for p, _ in got] == list(range(1300)) and sum(s == "host7" for _, s in got) == 210
    for t in range(4, 760, 4):  # sixty hosts and null weigh 61 of 121
        assert abs(sum(s == "src0" for _, s in got[:t]) - t * 60 / 121) < 5
    seen = [s for _, s in got if s != "src0"]
    assert len(set(seen[:244])) == 61 and set(map(seen[:488].count, set(seen))) == {8}
    thousand = [(i, "x", f"h{i % 1000}") for i in range(9000)]
    got = sorted((r.position, r.source) for r in pfair_mix.mix_sources(frame(spark, thousand), {"h1": 2, "h2": 7}, block_rows=3).collect())
    assert [p for p, _ in got] == list(range(9000))
    count, want = {}, {"h1": 2, "h2": 7}
    for t, (_, s) in enumerate(got[:1200], 1):
        count[s] = count.get(s, 0) + 1
        if t % 3 == 0:
            assert all(abs(n - want.get(h, 1) * t / 1007) < 3 for h, n in count.items())
    big = [(i, "x", "ab"[i % 2]) for i in range(2000)]
    got = sorted((r.position, r.source) for r in pfair_mix.mix_sources(frame(spark, big), {"a": 99_991, "b": 70_001}, block_rows=2).collect())
    assert [p for p, _ in got] == list(range(2000)) and all(abs(sum(s == "a" for _, s in got[:t]) - t * 99_991 / 169_992) < 2 for t in range(2, 1600, 2))


def test_token_store(spark, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    more = rows + [(100, "I'll can't <|endoftext|>x á  nb\x1csp İ ẞ", "s"), (101, (rows[0][1] + " ") * 60, "s")]
    at = str(tmp_path / "store")
    token_store.write_store(frame(spark, more), at)
    assert token_store.verify(spark, at)
    got = token_store.read_index(spark, at).orderBy("start").collect()
    want = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, _ in more]
    start = 0
    pool = {}
    for i, ids in want:
        pool.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert len(got) == len(want)
    last = -1
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in pool[r.doc_id]
        pool[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
        assert (r.doc_id if r.doc_id is not None else -1) >= last
        last = r.doc_id if r.doc_id is not None else -1
    back = token_store.read_documents(spark, at).collect()
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u2").tolist()) for r in back) == sorted((str(i), x) for i, x in want)
    chunks = token_store.chunks(spark, at)
    assert chunks.count() == chunks.select("digest").distinct().count()
    none = str(tmp_path / "none")
    token_store.write_store(frame(spark, []), none)
    assert token_store.read_index(spark, none).count() == 0 and token_store.verify(spark, none)


def test_token_store_notices_damage(spark, rows, tmp_path):
    import shutil

    from pyspark.sql import functions as F

    def damaged(part, change):
        at = str(tmp_path / f"{part}-{change.__name__}")
        shutil.copytree(tmp_path / "good", at)
        old = spark.read.parquet(f"{tmp_path}/good/{part}")
        shutil.rmtree(f"{at}/{part}")
        change(old).write.parquet(f"{at}/{part}")
        return at

    def lose(d):
        return d.limit(d.count() - 1)

    def alter(d):
        if "payload" in d.columns:
            other = d.select("payload").orderBy("payload").first()[0]
            return d.withColumn("payload", F.lit(other))
        return d.withColumn("n_tokens", F.col("n_tokens") + F.when(F.col("seq") == 0, 1).otherwise(0)) if "n_tokens" in d.columns else d.withColumn("hash", F.lit("0"))

    token_store.write_store(frame(spark, rows), str(tmp_path / "good"))
    assert token_store.read_index(spark, str(tmp_path / "good")).count() == len(rows)
    for part in ("chunks", "documents", "manifest"):
        for change in (lose, alter):
            at = damaged(part, change)
            if part == "manifest" and change is lose and spark.read.parquet(f"{tmp_path}/good/manifest").count() > 1 and token_store.sound_recipes(spark, at):
                continue  # a lower level was lost, the root was not
            with pytest.raises(Exception):  # noqa: B017  # of this module, or Spark's around it
                token_store.read_index(spark, at).collect()


def test_tokenizers_with_other_settings(tmp_path):
    """No text is cut by rules that the file doesn't state."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    told = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    told["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(told))
    enc, t = token_store.WordEncoder(str(other)), Tokenizer.from_file(str(other))
    assert not enc.cuts and token_store.encoder(None).cuts
    for text in ("Plain Text, it's  here", "caf\u0065\u0301 \u4f60"):
        assert np.frombuffer(enc.encode(text.encode()), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_components(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7)]
    comp = {}
    find = lambda x: x if comp.setdefault(x, x) == x else find(comp[x])
    for a, b in edges:
        x, y = find(a), find(b)
        comp[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in comp if any(x in e and e[0] != e[1] for e in edges)}


def test_pipeline_keeps_the_order_of_the_mixture(spark):
    """Files of very different sizes, which a reader doesn't return in the order they were written."""
    import corpus_pipeline

    rng = random.Random(13)
    sources = ["src0", "src1", "src2", None]
    docs = frame(spark, [(i, "word " * rng.choice([1, 3, 400 if i % 7 == 0 else 2]), sources[i % 4]) for i in range(1200)])
    mixed = common.materialize(corpus_pipeline.mix_stage(spark, docs, ""))
    got = corpus_pipeline.encode_stage(spark, mixed, "").collect()
    want = {r.doc_id: r.position for r in pfair_mix.mix_sources(docs, corpus_pipeline.WEIGHTS, 2).collect()}
    assert len(mixed.inputFiles()) > 1 and {r.doc_id: r.position for r in got} == want
    weight = [corpus_pipeline.WEIGHTS.get(s, 2) for s in sources]
    order = [i for i, _ in sorted(want.items(), key=lambda x: x[1])]
    for t in range(32, 400, 32):  # while no source runs out
        for s in range(4):
            assert abs(sum(i % 4 == s for i in order[:t]) - t * weight[s] / sum(weight)) < 33
    empty = common.materialize(corpus_pipeline.mix_stage(spark, docs.limit(0), ""))
    assert corpus_pipeline.encode_stage(spark, empty, "").count() == 0


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([Row(doc_id=i, quality=1, toxic=0) for i in range(40)]).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        if name != "n-gram Jaccard join":
            assert after.count() == docs.count(), name
        docs = common.materialize(after)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == docs.count() and len({r.doc_id for r in out} & set(range(40, 60))) >= 1


def test_queries_return_what_they_promise(spark, rows, tmp_path):
    """The thin queries on whole tables; joins and embeddings have tests of their own."""
    from docloom.llm import queries

    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([Row(doc_id=i, quality=i % 2, toxic=0) for i in range(40)]).write.parquet(str(tmp_path / "labels.parquet"))
    want = {
        "op1_line_dedup": "doc_id n_lines n_dropped kept_sha256", "op2_sharding": "doc_id slot shard", "op4_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans", "op5_quality": "doc_id held_out score predicted",
        "op6_order_minhash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op8_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256", "op9_mix_sources": "doc_id source slot position", "op10_token_store": "doc_id start n_tokens ids_crc32",
    }
    for name, columns in want.items():
        d = queries.queries()[name](spark, str(tmp_path))
        got = d.collect()
        assert d.columns[: len(columns.split())] == columns.split(), name
        assert len(got) == len(rows), name
        if name == "op5_quality":
            held = {r.doc_id: r.held_out for r in got}
            assert all(v == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, v in held.items())
            assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_quality_stage_drops_what_it_rejects(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    said = lambda ws: " ".join(rng.choice(ws) for _ in range(rng.randint(20, 60)))
    docs = [(i, said(["the", "house", "is", "green", "today."]) if i % 2 else said(["h##", "is$$", "gr%%", "0101"]), "s") for i in range(200)]
    spark.createDataFrame([Row(doc_id=i, quality=i % 2, toxic=0) for i in range(120)]).write.parquet(str(tmp_path / "labels.parquet"))
    d = frame(spark, docs)
    kept = corpus_pipeline.quality_stage(spark, d, str(tmp_path))
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(range(1, 200, 2))
