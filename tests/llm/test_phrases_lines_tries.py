"""Collocations, line dedup and prefix tries against plain Python, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import lines, phrases, trie


def brute_collocations(rows, least, top, subsumed):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, out = defaultdict(Counter), []
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            w = re.findall(r"[^ \t]+", piece)
            for m in range(1, 5):
                counts[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, f in counts.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        cands = {g: v for g, v in f.items() if len(g) > 1 and v >= least}
        kept = []
        for g, a in cands.items():
            inside = any(100 * v >= subsumed * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, v in cands.items() if len(h) > len(g))
            if not inside:
                cuts = [(2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = ["New", "york", "CITY", "hall", "of", "the", "Straße", "naïve", "x y", "\U0001f600", "a-b", "\x00"]
    pick = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 30)))
    return [(r.choice(["en", "de", None]), pick() + r.choice([". ", "\n", "\t", ",", " ; "]) + "new York city hall" + r.choice(["", "!", " of the"])) for _ in range(n)]


@pytest.mark.parametrize(("filter_", "chunk"), [(1 << 26, 1_000_000), (1 << 16, 300)])
def test_collocations(spark, filter_, chunk):
    """Also with a filter that lets all through, and many small counts to merge."""
    rows = [*corpus(1, 260), ("en", None), ("en", ""), ("und", "new york " * 40), ("fr", "..,,;;"), (None, "tie one tie one tie two tie two " * 3), ("en", "same row here " * 3), ("en", "same row here " * 3)]
    docs = spark.createDataFrame([(k, t, x, "n") for k, (x, t) in enumerate(rows)], "n long, text string, lang string, gram string")
    for least, top in ((5, 2000), (3, 7)):
        got = phrases.collocations(docs, least, top, chunk=chunk, size=filter_)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute_collocations(rows, least, top, 80)
    if chunk > 1000:
        assert phrases.collocations(docs.limit(0)).count() == 0


def test_counts_beyond_64_bits(spark):
    """The score's products are exact where they pass 64 bits."""
    row = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_000_001, 9_000_000_000_000_000)], "a long, l long, r long")
    got = row.select(F.expr("cast(a as decimal(30,0)) * 2000000 div (cast(l as decimal(30,0)) + r)")).first()[0]
    assert got == 2000000 * 9_000_000_000_000_000 // 18_000_000_000_000_001


def test_filters():
    r = np.random.default_rng(2)
    prints = phrases._prints("de", r.integers(0, 1 << 63, (500, 3), np.uint64), 12)
    bits = np.zeros(phrases.FILTER // 8, np.uint8)
    at = phrases._places(prints[:250], phrases.FILTER).ravel()
    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    assert phrases._held(bits, prints).tolist() == [True] * 250 + [False] * 250 and len(set(prints.tolist())) == 500 and (prints >> np.uint64(44)).max() == 0


def test_line_index():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 3000):
        hi, lo = (r.integers(0, 1 << 63, n, np.uint64) for _ in range(2))
        count = r.integers(1, 70_000, n)
        parts = lines.LineIndex.parts(hi, lo, count)
        index = lines.LineIndex(*parts)
        other = r.integers(0, 1 << 63, 1000, np.uint64)
        assert (index.probe(hi, lo) == count).all() and not index.probe(other, other).any() and len(index.prints) == n
    same = np.full(40, 7, np.uint64)  # digests that no level can part are listed
    assert lines.LineIndex(*lines.LineIndex.parts(np.arange(40, dtype=np.uint64), same, np.arange(1, 41))).probe(np.arange(40, dtype=np.uint64), same).tolist() == list(range(1, 41))


def brute_lines(texts, least, chars=1):
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(blank).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    docs = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = []
    for t in texts:
        rows = (t or "").split("\n")
        left = [x for x in rows if docs[key(x)] < least]
        out.append((len(rows), len(rows) - len(left), "\n".join(left)))
    return out


@pytest.mark.parametrize(("block", "shard", "probes"), [(128, 200_000, 500_000), (2, 5, 8)])
def test_line_dedup(spark, monkeypatch, block, shard, probes):
    """Also with many blocks, shards and parts of a shard."""
    r = random.Random(4)
    some = ["Cookie Notice", "  cookie notice\t", "ÄRGER", "ärger", "", " ", "\x0b", "a", "x" * 50, "\U0001f600", "\r"]
    texts = [None, "", "\n\n", "same\nsame\nsame", *["Row of one id"] * 6, "\n".join(f"line {k}" for k in range(30_000)) + "\ncookie notice"]
    texts += ["\n".join(r.choice(some) if r.random() < 0.6 else f"own {r.randrange(40)}" for _ in range(r.randrange(1, 9))) for _ in range(80)]
    for name, value in (("BLOCK", block), ("SHARD", shard), ("PROBES", probes)):
        monkeypatch.setattr(lines, name, value)
    rows = [(None if k == 3 else 7 if t == "Row of one id" else k, t, k, [k], "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, hot array<int>, __block string")
    for least, chars in ((5, 1), (2, 3)):
        got = lines.without_frequent_lines(docs, least, chars)
        assert got.columns == ["doc_id", "text", "hot", "__block", "n_lines", "n_dropped"]
        have = sorted((x.hot[0], x.n_lines, x.n_dropped, x.text or "") for x in got.collect())
        assert have == sorted((k, *x) for k, x in enumerate(brute_lines(texts, least, chars)))
    assert got.where("hot[0] = 0").first().text is None
    assert lines.without_frequent_lines(docs.limit(0)).count() == 0


def test_parentheses():
    r = random.Random(3)
    for n in (1, 2, 70, 3000):
        for shape in range(3):
            depth = [0]
            while len(depth) < n:
                depth.append((1, depth[-1] + 1, r.randint(1, depth[-1] + 1))[shape])
            own = trie.Parens(np.array(depth))
            size = [next((j for j in range(i + 1, n) if depth[j] <= depth[i]), n) - i for i in range(n)] if shape != 1 else list(range(n, 0, -1))
            x = np.array([r.randrange(100) for _ in range(n)])
            leaf = [i + 1 == n or depth[i + 1] <= depth[i] for i in range(n)]
            some = range(0, n, max(1, n // 50))
            assert own.size.tolist() == size
            assert [own.leaves()[i] for i in some] == [sum(leaf[i : i + size[i]]) for i in some]
            assert [own.least(x)[i] for i in some] == [x[i : i + size[i]].min() for i in some] and [own.sums(x)[i] for i in some] == [x[i : i + size[i]].sum() for i in some]


def brute_trie(turns, rebuilt):
    own = defaultdict(list)
    for c, turn, role, text in sorted((x for x in turns if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        own[c].append((role or "", text or ""))
    paths = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + x[h:]) if rebuilt else tuple(x)
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if paths[c] == p)))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("turns", "shard", "fan"), [(400_000, 100_000, 64), (25, 6, 2), (60, 1, 3)])
def test_prefix_trie(spark, turns, shard, fan):
    """One shard, and many small ones that share spines and are merged over several rounds."""
    r = random.Random(7)
    rows = [(None, 0, "user", "no conversation"), (5, None, None, None), (5, 1, "user", "hi"), (5, 1, "user", "hi"), (5, 1, "bot", "hi"), (205, 0, "user", "gone"), (900, 0, "user", "\U0001f600 long " * 50)]
    for c in [*range(100, 160), *range(300, 340), *range(9000, 9010)]:
        rows += [(c, k, r.choice(["user", "assistant"]), r.choice(["hello", "yes", "", None, "a" * (1 + c % 3)])) for k in range(r.randrange(1, 9))]
    rows += [(c, k, "user", f"deep {k}") for c in (20_000, 20_001) for k in range(400 + c % 2)]
    df = spark.createDataFrame([(*x, x[0]) for x in rows], "conv_id long, turn int, role string, text string, depth long")
    for rebuilt in (False, True):
        own = trie.sequences(df)
        got = trie.prefix_trie(trie.grafted(own) if rebuilt else own, turns, shard, fan)
        assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows, rebuilt)
    if fan == 64:
        assert trie.prefix_trie(trie.sequences(df.limit(0))).count() == 0
