"""The operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, and columns of clashing names."""

import hashlib
import html as entities
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import chat, common, html, jaccard, mixing, packing, quality, queries, secrets, simhash, substrings, vectors

DOCS = "doc_id long, text string, source string, size int, component_id string, n_chars long"


def components(nodes, pairs):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def words(seed, n):
    r = random.Random(seed)
    return [r.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau".split()) + str(r.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls, empty, blank and long texts, near copies, repeated rows, and columns that operators use as names."""
    base = words(1, 300)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:150] + ["new"] + base[150:])), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (None, "no id at all"), (8, " ".join(words(2, 60000)))]
    rows += [(9, "Same row."), (9, "Same row."), (10, 'x token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" y')]
    rows += [(k, " ".join(words(k, 50 + k % 60))) for k in range(20, 60)]
    made = [(i, t, None if k == 7 else f"s{k % 3}", k, "clash", len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 560)] + [(600, k) for k in range(601, 700)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = dict(common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == components({n for p in pairs for n in p}, pairs)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark, messy, none):
    got = [tuple(r) for r in simhash.near_duplicates(messy).collect()]
    rows = messy.select("doc_id", "text").collect()
    fps = sorted({brute_fingerprint(t) for _, t in rows})
    root = components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, t in rows:
        if i is not None:
            k = root[brute_fingerprint(t)]
            least[k] = min(least.get(k, i), i)
    want = [(i, f"{brute_fingerprint(t):016x}", least.get(root[brute_fingerprint(t)])) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("direct", [2048, 3])
def test_ball_hashing_finds_all_links(spark, direct):
    """Both ways, and large buckets by the whole ball, have the components of all pairs."""
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(r.randrange(5)):
            for _bit in range(r.randrange(1, 6)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    want = {k: v for k, v in components(fps, near).items() if any(k in p for p in near)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for halves in (1, 2):
        got = dict(common.connected_components(simhash.links(df, 4, halves, direct)).collect())
        assert got == want


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 16))
    near = x[rng.integers(0, 400, 200)] + rng.standard_normal((200, 16)) * rng.uniform(0.02, 0.3, (200, 1))
    x = np.concatenate([x, near, x[:30], 3 * x[:5]]).astype(np.float32)
    rows = [(i, [float(c) for c in v], "clash", 1) for i, v in enumerate(x)]
    rows += [(700, None, "c", 1), (701, [0.0] * 16, "c", 1), (702, [float("nan")] + [1.0] * 15, "c", 1), (703, [None] + [1.0] * 15, "c", 1), (704, [float("inf")] * 16, "c", 1), (705, [], "c", 1), (None, [1.0] * 16, "c", 1), (3, [float(c) for c in x[3]], "c", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string, t int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    want = components(range(len(x)), zip(*np.nonzero(s)))
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert set(got) == set(range(len(x))) | set(range(700, 706))
    assert [got[i].n_links for i in range(len(x))] == s.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == [want[i] for i in range(len(x))]
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(700, 706))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert vectors.near_duplicates(df.limit(0)).count() == 0

    found = vectors.nearest(df, F.col("vec_id") % 20 == 0, 20)
    by = {}
    for r in found.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x64 = x.astype(float)
    hits = 0
    for q in range(0, len(x), 20):
        score = x64 @ x64[q]
        want_ids = [i for i in sorted(range(len(x)), key=lambda i: (-round(score[i], 9), i)) if i != q][:20]
        rows_q = sorted(by[q])
        assert [r[0] for r in rows_q] == list(range(1, 21))
        assert all(abs(r[2] - score[r[1]]) < 1e-9 for r in rows_q)
        hits += len(set(want_ids) & {r[1] for r in rows_q})
    assert hits >= 0.99 * 20 * len(range(0, len(x), 20))
    assert 700 not in by and vectors.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = vectors.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0, 20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_copies_of_one_vector(spark):
    """Copies tie; the smallest ids come first, and links count every copy."""
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(60, [2.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert all(got[i] == (59, 0) for i in range(60)) and got[60] == (0, 60)
    top = [r.vec_id for r in vectors.nearest(df, F.col("vec_id") == 20, 20).orderBy("rank").collect()]
    assert top == [i for i in range(21) if i != 20]


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 7)
    rng = np.random.default_rng(2)
    x = rng.standard_normal(8) + rng.standard_normal((60, 8)) * 0.12
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    assert [got[i] for i in range(60)] == want.tolist()


def test_mixing(spark, messy, none):
    got = mixing.mix(messy).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = messy.select("doc_id", "text", "source").collect()
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=str) == sorted(((r.doc_id, r.source, size(r.text)) for r in rows), key=str)
    total = {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + size(r.text)
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, want = set(total), {}
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in total if s not in open_)
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if each * weight[s] > 2 * total[s]}
        if not over:
            break
        open_ -= over
    want = {s: each * weight[s] if s in open_ else 2 * total[s] for s in total}
    assert all(math.isclose(r.target, want[r.source]) and r.source_size == total[r.source] for r in got)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(messy.repartition(7)).collect()))
    assert mixing.mix(none).count() == 0


def test_mixing_comes_near_targets(spark):
    r = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(["w"] * r.randrange(5, 400)), f"s{min(i % 7, 3)}") for i in range(6000)], "doc_id long, text string, source string")
    for fan in (256, 8):
        got = mixing.mix(docs, fan=fan).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
        assert all(abs(x.n / x.t - 1) < 0.01 for x in got)


def test_mixing_of_repeated_rows(spark):
    """A row that repeats 2,000 times, and 1,000 texts of one size without an id: words come near the targets, and the stage writes what the mix took."""
    r = random.Random(9)
    rows = [(1, "w " * 100, "a", 0)] * 2000 + [(k, " ".join(["w"] * r.randrange(5, 400)), "b", k) for k in range(2, 1500)] + [(None, f"x{k} y z", "c", k) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __id int")
    got = mixing.mix(docs)
    by = {x.source: x for x in got.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.sum("copies").alias("copies"), F.count("*").alias("rows")).collect()}
    assert all(abs(x.n / x.t - 1) < 0.01 for x in by.values()) and {s: x["rows"] for s, x in by.items()} == {"a": 2000, "b": 1498, "c": 1000}
    assert got.where("taken > 2 * size").count() == 0
    out = corpus_pipeline.mixed(spark, docs, "")
    assert {x.source: x["count"] for x in out.groupBy("source").count().collect()} == {s: x.copies for s, x in by.items()} and out.columns == docs.columns
    key = lambda df: sorted(map(str, df.collect()))
    assert key(out) == key(corpus_pipeline.mixed(spark, docs.repartition(5), ""))


def test_many_copies_of_one_row(spark):
    rows = spark.createDataFrame([("a", 25_001), ("b", 0), ("c", 3)], "k string, n int")
    assert {r.k: r["count"] for r in mixing.repeated(rows, F.col("n")).groupBy("k").count().collect()} == {"a": 25_001, "c": 3}


def test_pairing_against_plain_python(spark):
    """One group, rounded step by step in plain Python from the same draws."""
    items = [(s, i, i * 31, "s", 1, 0, 0, 1.0, 1.0, p) for i, (s, p) in enumerate([(5, 0.3), (9, 0.9), (2, 0.5), (9, 0.2), (7, 0.75), (1, 0.6)])]
    df = spark.createDataFrame(items, "size long, doc_id long, key long, source string, m long, base int, whole long, source_size double, target double, p double")
    got = mixing._rounded(df, ["source"], 11).first()
    draw = {}
    for a in items:
        for b in items:
            draw[a[1], b[1]] = (a[1], a[2], b[1], b[2])
    drawn = spark.createDataFrame(list(draw.values()), "a long, ka long, b long, kb long").select("a", "b", mixing._uniform(F.col("a"), F.col("ka"), F.col("b"), F.col("kb"), seed=11).alias("u"))
    draw = {(r.a, r.b): r.u for r in drawn.collect()}
    order = sorted(items, key=lambda x: (x[0], x[1]), reverse=True)
    (held, p), take = (order[0][1], order[0][9]), {}
    for x in order[1:]:
        total = p + x[9]
        chance = x[9] / total if total < 1 else (1 - x[9]) / (2 - total)
        lost, kept = (held, x[1]) if draw[held, x[1]] < chance else (x[1], held)
        take[lost], held, p = int(total >= 1), kept, total if total < 1 else total - 1
    assert {r.doc_id: r.take for r in got.done} == take and got.left.doc_id == held and math.isclose(got.left.p, p)


def test_secrets(spark, messy, none):
    rows = [(1000 + k, f'some words token = "{hashlib.sha1(str(k).encode()).hexdigest()}" and more', "src", 0, "c", 1) for k in range(40)]
    rows += [(2000 + k, f"commit {hashlib.sha1(str(k).encode()).hexdigest()} fixed 0826257060216530{k}", "src", 0, "c", 1) for k in range(40)]
    docs = messy.unionByName(spark.createDataFrame(rows, DOCS))
    found = secrets.scan(docs)
    got = found.where("is_secret").select("doc_id").distinct().collect()
    ids = {r.doc_id for r in got}
    assert ids >= {10, *range(1000, 1040)} and not ids & set(range(2000, 2040))
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    for r in found.where("doc_id is not null").collect():
        assert texts[r.doc_id][r.start : r.end] == r.candidate
    clean = secrets.redact(docs, found)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    after = {r.doc_id: r for r in clean.collect()}
    assert after[10].text == 'x token = "[SECRET]" y' and after[10].n_chars == len(after[10].text)
    assert all(after[i].text == texts[i] for i in texts if i not in ids)
    assert secrets.scan(none).count() == 0


def test_secret_spans(spark):
    """Several candidates, at the ends and of surrogate pairs before, against a plain search; a very long text too."""
    run = r"[A-Za-z0-9+/_-]{16,}"
    texts = ["\U0001f600 abcdefgh12345678 x ABCDEFGH12345678ZZ, short1 0123456789012345", None, "", "a \x01\x02 b abcdefgh12345678", " ".join(f"w{k} abcdefgh{k:08d}" for k in range(20000))]
    got = secrets.candidates(spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    want = [(k, *m.span(), m[0]) for k, t in enumerate(texts) for m in re.finditer(run, t or "")]
    assert sorted((r.doc_id, r.start, r.end, r.candidate) for r in got) == want
    for r in got:
        t = texts[r.doc_id].translate({1: " ", 2: " "})
        assert t[: r.start].endswith(r.before) and t[r.end :].startswith(r.after) and len(r.before) >= min(r.start, 2)


def test_secrets_of_all_forms_are_candidates(spark):
    value = {
        "token=24be64439e3e49cf46b2d7c90f3602a3d0b907ff": "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCYzz": "wJalrXUtnFEMIK7MDENGbPxRfiCYzz", 'password = "Xk9vQ2mLp7w"': "Xk9vQ2mLp7w",
        'password = "correcthorsebatterystaple"': "correcthorsebatterystaple", 'token = "' + "a" * 220 + '9xyz1234"': "a" * 220 + "9xyz1234", "-----BEGIN RSA PRIVATE KEY-----\nabc\ndef\n-----END RSA PRIVATE KEY-----": None, "-----BEGIN PRIVATE KEY-----\n" + "aB3/" * 16: None,
        "Authorization: Bearer abc.def-12": "abc.def-12", '{"api_key": "Zq81"}': "Zq81", "https://x.io/?token=k3y5&b=1": "k3y5", "use ghp_Abcdefghijklmnopqrstuvwx": "ghp_Abcdefghijklmnopqrstuvwx",
    }
    got = {(r.doc_id, r.candidate): r for r in secrets.candidates(spark.createDataFrame(list(enumerate(value)), "doc_id long, text string"), None).collect()}
    for k, (text, v) in enumerate(value.items()):
        r = got[k, v or text]
        assert text[r.start : r.end] == (v or text)


def test_candidates_of_keys_without_an_end_and_of_long_runs(spark):
    """A mention of a key's header is none, a key without an end takes its lines alone; runs of a million characters take no time."""
    body = "A1b2" * 16 + "\n" + "Zz9/" * 16 + "=="
    texts = ["see -----BEGIN RSA PRIVATE KEY----- in prose that goes on", f"k -----BEGIN RSA PRIVATE KEY-----\n{body}\nthat was it"]
    texts += [x * (1_000_000 // len(x)) for x in ("-", "_", "token", "-----BEGIN RSA PRIVATE KEY----- ", "A")] + ["-----BEGIN RSA PRIVATE KEY-----" + "a-" * 500_000]
    began = time.time()
    got = secrets.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), None).collect()
    assert [(r.doc_id, r.candidate) for r in got] == [(1, f"-----BEGIN RSA PRIVATE KEY-----\n{body}")] and time.time() - began < 60


def test_scores_do_not_depend_on_the_layout(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a, b = (sorted((r.doc_id, r.start, r.score) for r in secrets.scan(d, documents=60).collect()) for d in (docs, docs.repartition(7).sortWithinPartitions(F.desc("doc_id"))))
    assert a == b and a


def test_forest_against_held_out_findings(spark, small):
    """Precision and recall on findings made in other documents, by other draws; the forest removes what is no secret."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = secrets.train(secrets.labelled_findings(docs.where("doc_id % 2 = 0")))
    held = secrets.scored(secrets.labelled_findings(docs.where("doc_id % 2 = 1"), salt=1), model).groupBy("label", "is_secret").count().collect()
    n = {(r.label, r.is_secret): r["count"] for r in held}
    assert n[1, True] / (n[1, True] + n.get((0, True), 0)) > 0.97 and n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.97 and n[0, False] > 500


def test_redacted_rows_with_one_id(spark):
    """Null ids and shared ids: every text has its own findings."""
    token = lambda k: f'token = "{hashlib.sha1(str(k).encode()).hexdigest()}"'
    rows = [(None, f"a {token(1)} b"), (None, f"longer {token(2)} b {token(3)}"), (7, f"x {token(4)}"), (7, "clean text of the id"), (7, None), (7, f"x {token(4)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.scan(docs, None)
    got = sorted(str(r.text) for r in secrets.redact(docs, found).collect())
    assert got == sorted(["a token = \"[SECRET]\" b", "longer token = \"[SECRET]\" b token = \"[SECRET]\"", "x token = \"[SECRET]\"", "clean text of the id", "None", "x token = \"[SECRET]\""])


def test_packing(spark, messy, none):
    got = packing.pack(messy, 64, shard=16).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        assert sum(r.n_words for r in b) <= 64
        for of in ([r.source for r in b], [r.cluster for r in b]):
            known = [x for x in of if x is not None]
            assert len(known) == len(set(known))
        at = 0
        for r in sorted(b, key=lambda r: r.position):
            assert r.bin_offset == at
            at += r.n_words
    size = lambda t: len((t or "").split())
    assert sum(r.n_words for r in got) == sum(size(r.text) for r in messy.collect())
    assert {(r.doc_id, r["copy"]) for r in got} >= {(9, 0), (9, 1), (4, 0), (None, 0)}
    assert packing.pack(none, 64).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    """Against a plain search over all bins."""
    rng = np.random.default_rng(4)
    n = 300
    size, source, cluster = np.sort(rng.integers(1, 60, n))[::-1], rng.integers(-1, 9, n), rng.integers(-1, 70, n)
    got = packing.pack_shard(size, source, cluster, 100)
    bins = []
    for k in range(n):
        fits = [(100 - b[0], i) for i, b in enumerate(bins) if 100 - b[0] >= size[k] and (source[k] < 0 or source[k] not in b[1]) and (cluster[k] < 0 or cluster[k] not in b[2])]
        tight = min((f[0] for f in fits), default=None)
        b = int(got[0][k])
        if tight is None:
            assert b == len(bins)
            bins.append([0, set(), set()])
        else:
            assert (tight, b) in fits
        assert got[2][k] == bins[b][0]
        bins[b][0] += int(size[k])
        bins[b][1].add(source[k])
        bins[b][2].add(cluster[k])


def test_quality(spark, messy, none):
    good = [(k, " ".join(words(k, 60)).capitalize() + ".", "s", 0, "c", 1) for k in range(3000, 3200)]
    bad = [(k, " ".join(x + "###" for x in words(k, 60)), "s", 0, "c", 1) for k in range(4000, 4200)]
    docs = messy.unionByName(spark.createDataFrame(good + bad, DOCS))
    labels = spark.createDataFrame([(r[0], int(r[0] < 4000), 0) for r in good + bad] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(got[r[0]].predicted == int(r[0] < 4000) for r in good + bad)
    import zlib

    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(messy, labels.limit(0)).collect()} == {0.5}
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), labels.repartition(3)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_trees_go_down_like_one_row_at_a_time():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, len(quality.STATISTICS)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    m = quality.fit(x, y, trees=20)
    for row, score in list(zip(x, m.score(x)))[:50]:
        total = m.base
        for node in m.roots:
            while m.feature[node] >= 0:
                node = m.left[node] + int(row[m.feature[node]] > m.threshold[node])
            total += m.value[node]
        assert math.isclose(score, 1 / (1 + math.exp(-total)))
    assert ((m.score(x) >= 0.5) == y).mean() > 0.9


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><!-- no <p>no</p> -->
<header>Site head</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad big">Buy</div><main><article><header><h1>Head &amp; {k}</h1></header>
<p>First <b>para</b>graph {k} with&nbsp;space<br>and more<p>Second &lt;{k}&gt;<div class="notice">Cookies!</div><p>Subscribe here</p><ul><li>one {k}<li>two {k}</ul>
<form><input>name</form><section id="comments"><p>I disagree {k}</p></section></article></main><aside>Other</aside><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    rows = [(k, f"https://h.example/{k}", PAGE.format(k=k), "x") for k in range(12)]
    rows += [(100, None, None, "x"), (101, "no url", "", "x"), (102, "https://one.example/", "<p>Only <i>one", "x"), (0, "https://h.example/0", PAGE.format(k=0), "x"), (103, "//b.example", "plain a < b &amp; c", "x"), (None, "https://h.example/z", PAGE.format(k=77), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): r.text for r in html.extract(df).collect()}
    assert html.extract(df).count() == len(rows)
    for k in (*range(12), None):
        n = 77 if k is None else k
        assert got[k, f"https://h.example/{'z' if k is None else k}"] == f"Head & {n} First paragraph {n} with space and more Second <{n}> one {n} two {n}"  # "Subscribe here" stands on every page
    assert got[100, None] == "" and got[101, "no url"] == "" and got[102, "https://one.example/"] == "Only one" and got[103, "//b.example"] == "plain a < b & c"
    assert html.extract(df.limit(0)).count() == 0


def test_frames_around_the_article(spark):
    """Names of furniture on a frame around the article don't hide it; an article among comments is a comment."""
    page = '<body class="has-sidebar nav-open"><div class="layout with-menu"><article class="post">Main <span class="ad">buy</span>text<section class="comments"><article>No</article></section></article></div><div class="related"><article>Other</article></div><section id="comments"><article class="comment">Nay</article></section></body>'
    plain = '<body class="no-sidebar"><div class="menu">Menu</div><div>Text</div><div style="display: none">gone</div></body>'
    df = spark.createDataFrame([(1, "https://a.example/", page), (2, "https://b.example/", plain)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == {1: "Main text", 2: "Text"}


def test_html_of_copies_and_long_pages(spark):
    """Pages that are copies of one another keep their text; long pages are read to the end."""
    same = "<article><h1>A</h1><p>b</p></article>"
    long = "<article>" + "".join(f"<p>p{i}</p><div>d{i}</div>" for i in range(3000)) + "</article>"
    df = spark.createDataFrame([(k, "https://c.example/", same) for k in range(20)] + [(99, "https://l.example/", long)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(got[k] == "A b" for k in range(20))
    assert got[99] == " ".join(f"p{i} d{i}" for i in range(3000))


def test_wrapper_alone(spark):
    """Furniture without tell-tale names or elements goes by the wrapper; copies of an article keep it."""
    menus = [f"<div class='x1'><div>Menu {m}</div><div>About {m}</div></div>" for m in range(3)]
    rows = []
    for k in range(40):
        body = f"<div class='x2'><h2>Title {k % 35}</h2><p>Article {k % 35} says {' '.join(words(k % 35, 12))}</p></div>"
        rows.append((k, f"https://w.example/{k}", f"<html><body>{menus[k % 3]}{body}<div class='x3'>Imprint {k % 2}</div></body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df, names=False).collect()}
    assert got == {k: f"Title {k % 35} Article {k % 35} says {' '.join(words(k % 35, 12))}" for k in range(40)}


def test_wrapper_decides_given_pages(spark):
    """Pages of the tables whose text changes by the wrapper, with names and kinds of elements left out of account."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    right = {r.page_id: r.text for r in html.extract(pages).collect()}
    got = {r.page_id: r.text for r in html.extract(pages, names=False).collect()}
    plain = {r.page_id: " ".join(html.blocks(html.parse(r.html or ""), {"slots": set(), "texts": {}}, [""], html.fold(html.parse("")), False)) for r in pages.collect()}
    changed = [k for k in got if got[k] != plain[k]]
    assert len(changed) > 50 and sum(got[k] == right[k] for k in changed) > 0


def test_markup_of_all_kinds(spark):
    """Attributes are read by their names, deep pages and nested spans to their ends."""
    kept = {
        '<p title="a hidden gem">Kept text</p>': "Kept text", '<div data-hidden="false">Kept text</div>': "Kept text", '<p>A <a title="hidden">link text</a></p>': "A link text", '<p>A <a href="/hidden-lake">lake</a></p>': "A lake",
        '<div class="social-history">Kept</div><div class="share-price">also</div><div id="search-results">this</div><p>and <span class="ad-hoc">that</span></p>': "Kept also this and that",
        '<p>x <span class="ad">y <span>z</span> AD</span> end</p>': "x end", '<p>x <span hidden>y</p><p>z</p>': "x z", '<div aria-hidden="true">no</div><div aria-hidden="false">yes</div><div hidden>no</div>': "yes",
        '<p style="color:red; display : none">no</p><p style="color:red">yes</p>': "yes", "<div>" * 5000 + "deep": "deep", "<ul><li>" * 3000 + "list" + "</li></ul>" * 3000: "list", "<b>" * 5000 + "bold": "bold",
    }
    rows = [(k, f"https://m{k}.example/", x) for k, x in enumerate(kept)] + [(100 + k, "https://deep.example/", "<div>" * 5000 + f"deep {k}") for k in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(kept.values())) | {100 + k: f"deep {k}" for k in range(6)}


def test_tree_matching():
    t = lambda key, *kids: [key, list(kids), []]
    a, b = t("x", t("p", t("q")), t("r"), t("s")), t("x", t("r"), t("p", t("q")), t("s"))
    assert html.matching(a, b) == 4 and html.matching(a, a) == 5 and html.matching(a, t("y")) == 0


def test_chat(spark):
    odd = "\\ \\\\ </s>[INST] <<SYS>> <|turn|><|end|> [/INST] <<|end|> <|tur <</SYS>> [INST\\]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", odd), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "tail"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, 5, None, "<|text|>"), (3, None, "user", "\U0001f600"), (None, 0, "user", "x"), (4, 0, "assistant", "\\"), (4, 1, "assistant", "<")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, fragment string")
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    expanded = chat.expand(chats).where("example is not null")
    for r in expanded.collect():
        assert r.text.endswith("<|end|>") and r.loss_end == len(r.text) - len("<|end|>")
        assert not re.search(r"<\||</?s>|\[/?INST\]|SYS>>", re.sub(r"<\|(turn|text|end)\|>", "", r.text)) or "\\" in r.text
    assert expanded.count() == sum(r[2] == "assistant" for r in rows)
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_long_chats(spark):
    """A conversation of many turns and one of a very long text."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} \\ <|end|>") for k in range(400)] + [(2, 0, "user", "q"), (2, 1, "assistant", "[INST]\\x " * 100_000)]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2):
        loss = "".join(r[3] for r in rows if r[0] == c and r[2] == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (sum(r[0] == c for r in rows), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_substrings(spark, messy, none):
    passage = " ".join(words(77, 12)) + ". " + " ".join(words(78, 15)) + ". " + " ".join(words(79, 14)) + "."
    rows = [(500, f"Start here it is. {passage} Then the end.", "s", 0, "c", 1), (501, f"Another begin\n{passage.upper()}\nand another end.", "s", 0, "c", 1), (502, "Start here it is. A short one.", "s", 0, "c", 1)]
    docs = messy.unionByName(spark.createDataFrame(rows, DOCS))
    got = [r for r in substrings.repeated_spans(docs, 20).collect() if r.doc_id and r.doc_id >= 500]
    assert [(r.doc_id, r.kept_in, r.n_words) for r in got] == [(501, 500, 41)]
    text = rows[1][1]
    assert text[got[0].start : got[0].end].lower() == passage
    clean = {r.doc_id: r for r in substrings.without_spans(docs, substrings.repeated_spans(docs, 20)).where("doc_id >= 500").collect()}
    assert clean[501].text == text.replace(passage.upper(), "") and clean[501].removed == [(got[0].start, got[0].end)]
    assert clean[500].text == rows[0][1] and clean[500].removed is None
    assert substrings.repeated_spans(none).count() == 0


def test_columns_named_like_the_operators_own(spark):
    passage = " ".join(words(5, 40)) + "."
    docs = spark.createDataFrame([(1, passage, 1, 2, 3, 4), (2, f"Here. {passage} token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\"", 5, 6, 7, 8)], "doc_id long, text string, removed int, __id int, __key int, __own int")
    clean = substrings.without_spans(docs, substrings.repeated_spans(docs, 20))
    assert sorted(clean.columns) == sorted(docs.columns) and {r.doc_id: bool(r.removed) for r in clean.collect()} == {1: False, 2: True}
    assert jaccard.one_of_each(docs).columns == docs.columns and jaccard.one_of_each(docs).count() == 1
    assert secrets.redact(docs, secrets.scan(docs, None)).columns == docs.columns


def test_repeated_lines_of_any_length_go(spark):
    """Without a minimum every line but the first of its kind goes, a short one too, and only where it stands."""
    rows = [(k, f"Own words of {k} {' '.join(words(k, 9))}\nAll rights reserved\nMore of {k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.start, r.end, r.kept_in) for r in substrings.repeated_spans(docs).collect()}
    assert {k: rows[k][1][a:b] for k, (a, b, _) in got.items()} == dict.fromkeys(range(1, 50), "All rights reserved") and {x[2] for x in got.values()} == {0}


def test_spans_of_rows_with_one_id(spark):
    """A span found in one text of an id cuts nothing from another text of that id, or of none; of equal rows one stays, of others the first in order of id and text."""
    passage, other = " ".join(words(5, 40)) + ".", " ".join(words(6, 90)) + "."
    rows = [(1, passage), (2, f"Here. {passage}"), (2, other), (None, f"There. {passage}"), (None, other[::-1]), (3, other), (3, other), (None, other[::-1]), (4, None), (4, None), (5, "few"), (5, "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in substrings.without_spans(docs, substrings.repeated_spans(docs, 20)).collect())
    rev = other[::-1]
    assert got == sorted([("1", passage), ("2", "Here. "), ("2", other), ("None", "There. "), ("None", rev), ("None", rev[: len(rev) - len(rev.lstrip())]), ("3", ""), ("3", ""), ("4", "None"), ("4", "None"), ("5", "few"), ("5", "few")])
    both = [(9, f"Eins. {passage}"), (9, f"Zwei. {passage}")]
    left = [r.text for r in substrings.without_spans(spark.createDataFrame(both, docs.schema), substrings.repeated_spans(spark.createDataFrame(both, docs.schema), 20)).collect()]
    assert sum(passage in t for t in left) == 1 and sorted(t[:6] for t in left) == ["Eins. ", "Zwei. "]


def test_runs_first_seen_in_several_documents_go(spark):
    parts = [" ".join(words(k, 15)) + "." for k in range(4)]
    docs = spark.createDataFrame([(k, f"Own {k}. {p}") for k, p in enumerate(parts)] + [(9, "Begin here. " + " ".join(parts) + " And end.")], "doc_id long, text string")
    assert [(r.doc_id, r.n_words) for r in substrings.repeated_spans(docs, 20).collect()] == [(9, 60)]


def plain_units(text):
    """Units by a splitter of its own: words of each line, cut behind the ends of sentences, behind words of one hash in eight and after 48 words."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        own = []
        for m in re.finditer(r"\S+", line[0]):
            w = m[0]
            own.append((line.start() + m.start(), line.start() + m.end(), w.lower()))
            tail = re.search(r"[^\w\s]*$", w)[0]
            lone = any(c == "!" and tail[k - 1 : k] != "!" and tail[k + 1 : k + 2] != "!" and w[len(w) - len(tail) + k - 1 : len(w) - len(tail) + k] != "!" for k, c in enumerate(tail))
            if "." in tail or "?" in tail or lone or zlib.crc32(w.lower().encode()) % 8 == 0 or len(own) == 48:
                out.append(own)
                own = []
        if own:
            out.append(own)
    return [(u[0][0], u[-1][1], len(u), " ".join(x[2] for x in u)) for u in out]


def test_substrings_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    first, units = {}, {i: plain_units(t) for i, t in rows}
    for i, _ in rows:
        for a, _, w, x in units[i]:
            first.setdefault((x, w), (i, a))
    for least in (1, 20):
        want = set()
        for i, _ in rows:
            run = []
            for a, b, w, x in [*units[i], (0, 0, 0, "")]:
                if x and first[x, w] < (i, a):
                    run.append((a, b, w, first[x, w][0]))
                else:
                    n = {k: sum(r[2] for r in run if r[3] == k) for k in {r[3] for r in run}}
                    if n and (max(n.values()) >= least or sum(n.values()) >= 2 * least):
                        want.add((i, run[0][0], run[-1][1], sum(r[2] for r in run), min(n, key=lambda k: (-n[k], k))))
                    run = []
        assert {(r.doc_id, r.start, r.end, r.n_words, r.kept_in) for r in substrings.repeated_spans(docs, least).collect()} == want


@pytest.mark.parametrize(("marks", "size", "least"), [(True, 55, 38), (False, 55, 36), (False, 70, 39)])
def test_passages_within_lines_are_found(spark, marks, size, least):
    """Passages of over 50 words in the middle of other lines, with and without marks of sentences."""
    rows = []
    for k in range(40):
        passage = " ".join(w + "." * (marks and n % 11 == 7) for n, w in enumerate(words(900 + k, size)))
        for copy in range(2):
            rows.append((2 * k + copy, " ".join([*words(5000 + 2 * k + copy, 80), passage, *words(7000 + 2 * k + copy, 80)])))
    rows += [(500 + k, " ".join(words(9000 + k, 200))) for k in range(100)]
    got = {(r.doc_id, r.kept_in) for r in substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()}
    assert got <= {(2 * k + 1, 2 * k) for k in range(40)} and len(got) >= least


def test_html_pages_against_the_markup(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r.text for r in queries.op5_html_extraction(spark, small).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
        assert got[r.page_id] == " ".join(entities.unescape(plain).split())


def test_pipeline(spark, small, messy):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.good_documents(spark, docs, small)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert sum((i in ids) == bool(q) for i, q in labels.items()) >= 0.97 * len(labels)
    one = corpus_pipeline.one_of_each(spark, docs, small)
    groups = {r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert {r.doc_id for r in one.collect()} == groups and one.count() == len(groups)
    assert corpus_pipeline.without_secrets(spark, docs, small).where(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0
    taken = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect()}
    mixed = corpus_pipeline.mixed(spark, docs, small)
    counts = {(r.doc_id, r.source): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    assert counts == {k: v for k, v in taken.items() if v}
    for stage in (one, mixed, corpus_pipeline.without_secrets(spark, docs, small), kept):
        assert stage.columns == docs.columns
    out = corpus_pipeline.run(spark, small)
    assert out.groupBy("bin_id").agg(F.sum("n_words").alias("n")).where("n > 2048").count() == 0 and out.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, messy.limit(0), small).count() == 0, name


def test_stages_on_messy_rows(spark, small, messy):
    """What each stage keeps of nulls, empty and long texts and repeated rows."""
    rows = {(r.doc_id, r.text) for r in messy.collect()}
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.good_documents(spark, messy, small).collect()}
    assert kept <= rows
    one = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, messy, small).collect()]
    ids = sorted(i for i, _ in one if i is not None)
    assert set(one) <= rows and len(one) == len(ids) + 1 and ids == sorted({1, 4, 7, 8, 9, 10, *range(20, 60)})  # 2 and 3 are like 1; 4 to 6 have no words
    clean = {(r.doc_id, r.text) for r in corpus_pipeline.without_secrets(spark, messy, small).collect()}
    assert rows - clean == {(10, 'x token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" y')} and (10, 'x token = "[SECRET]" y') in clean
    taken = {}
    for r in mixing.mix(messy).collect():
        taken[r.doc_id, r.source, r.size] = taken.get((r.doc_id, r.source, r.size), 0) + r.copies
    got = {}
    for r in corpus_pipeline.mixed(spark, messy, small).collect():
        key = r.doc_id, r.source, len((r.text or "").split())
        got[key] = got.get(key, 0) + 1
    assert got == {k: v for k, v in taken.items() if v}
    packed = corpus_pipeline.packed(spark, messy, small).collect()
    assert sum(r.n_words for r in packed) == sum(len((t or "").split()) for _, t in [(r.doc_id, r.text) for r in messy.collect()])


def test_one_of_each_by_row(spark):
    """Rows that share an id are told apart by their texts: no text is lost, no copy kept."""
    a, b = " ".join(words(1, 60)), " ".join(words(2, 60))
    docs = spark.createDataFrame([(3, a, "s"), (9, a, "s"), (9, b, "t"), (None, b, "t"), (9, b, "u"), (None, a[::-1], "v")], "doc_id long, text string, source string")
    got = {tuple(r) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    assert got == {(3, a, "s"), (9, b, "t"), (None, a[::-1], "v")}


def test_pipeline_goes_on_where_it_failed(spark, small, tmp_path, monkeypatch):
    folder, calls = str(tmp_path / "run"), []
    ready = spark.read.parquet(f"{small}/documents.parquet").limit(50)

    def stage(name, fails):
        def f(s, docs, d):
            calls.append(name)
            if fails and calls.count(name) == 1:
                raise RuntimeError(name)
            return ready

        return f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage("one", False)), ("two", stage("two", True))])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, small, folder)
    assert corpus_pipeline.run(spark, small, folder).count() == 50 and calls == ["one", "two", "two"]


@pytest.mark.parametrize("part", [256, 3])
def test_pipeline_drops_near_copies(spark, monkeypatch, part):
    """Texts that share 0.8 of their five-word shingles, far beyond 4 bits of a fingerprint, are one group; in the components of all pairs."""
    monkeypatch.setattr(jaccard, "PART", part)
    r = random.Random(11)
    rows = []
    for k in range(12):
        base = words(100 + k, 150)
        for _ in range(8):
            own = list(base)
            for _ in range(r.randrange(5)):
                own[r.randrange(len(own))] = f"other{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), "four words stand here"), (len(rows) + 1, "Four words  stand here"), (len(rows) + 2, ""), (len(rows) + 3, " ")]

    def sets(text):
        own = text.lower().split()
        k = min(5, len(own))
        return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()

    own = {i: sets(t) for i, t in rows}
    near = [(a, b) for a in own for b in own if a < b and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])]
    want = components(list(own), near)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in jaccard.near_duplicates(docs).collect()} == want
    assert {x.doc_id for x in corpus_pipeline.one_of_each(spark, docs, "").collect()} == set(want.values())
    assert len({x.component_id for x in simhash.near_duplicates(docs).collect()}) > len(set(want.values()))


@pytest.mark.parametrize("k", [147911, 507671])
def test_candidates_of_bands_are_settled_exactly(spark, k):
    """Texts of 10 and 8 five-word shingles that share 8, where a band agrees but few of all minima do."""
    text = [f"w{k}x{i}" for i in range(14)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:12])), (3, " ".join(text[:11]))], "doc_id long, text string")  # 3 shares 7 of 8 with 2
    assert {x.doc_id: x.component_id for x in jaccard.near_duplicates(docs.where("doc_id < 3")).collect()} == {1: 1, 2: 1}
    assert [x.doc_id for x in corpus_pipeline.one_of_each(spark, docs, "").collect()] == [1]


def test_fingerprints_of_the_stage(spark, monkeypatch):
    """The stage's fingerprints bit by bit; their balls give candidates, without any band too, which the exact sets settle."""
    base = words(7, 400)
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(base[::-1]), "few words", "", " ".join(words(8, 5000))]
    own = [jaccard.shingles(t.encode()) for t in texts]
    for x in own:
        assert jaccard.fingerprint(x) % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in x) > len(x))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = jaccard.with_bands(docs)
    pairs = {tuple(sorted(p)) for p in jaccard.close(ids.select("node", "fp").distinct()).collect()}
    nodes = {r.doc_id: r.node for r in ids.collect()}
    assert pairs == {tuple(sorted((nodes[0], nodes[1])))} and jaccard.similar(own[0], own[1])
    lone = ids.withColumn("bands", F.transform("bands", lambda x: F.xxhash64(x, "node")))
    monkeypatch.setattr(jaccard, "with_bands", lambda _: lone)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}


def test_bounds_lose_no_similar_sets():
    """Sets at the threshold and just below, from one value to many more than there are bits."""
    r, passed = np.random.default_rng(4), 0
    for both in (1, 4, 8, 40, 400, 4000, 40000):
        for one, two in {(both // 4, 0), (0, both // 4), (both // 8, both // 4 - both // 8), (both // 4 + 1, 0), (both, both)}:
            values = r.integers(0, 1 << 63, both + one + two, np.uint64)
            x, y = np.sort(values[: both + one]), np.sort(np.concatenate((values[:both], values[both + one :])))
            bits = [np.frombuffer(jaccard.parities(s), np.uint64)[None] for s in (x, y)]
            may = bool(jaccard.possible(np.array([len(x)]), bits[0], np.array([len(y)]), bits[1])[0])
            near = 5 * both >= 4 * len(values)
            assert jaccard.similar(x, y) == near and may >= near
            passed += may and not near
    assert passed < 10


def test_balls_of_no_radius(spark):
    fps = spark.createDataFrame([(1,)], "fp long")
    for radius, halves in ((3, 1), (0, 1), (5, 2), (6, 2)):
        with pytest.raises(ValueError, match="no balls"):
            simhash.links(fps, radius, halves)


def test_html_constants_among_many_paragraphs(spark):
    """A text of every page is template beside 20 and 40 paragraphs of its key; one on 85 % of the pages too, one on 70 % isn't."""
    rows = []
    for host, n in (("a.org", 20), ("b.org", 40)):
        for k in range(60):
            own = [f"{host} paragraph {k} of number {i} says {' '.join(words(1000 * k + i, 6))}" for i in range(n)]
            more = ["This notice stands on every page"] + ["Most pages have this"] * (k % 20 < 17) + ["Some pages have this"] * (k % 10 < 7)
            body = own[: k % n] + more + own[k % n :]
            rows.append((len(rows), f"https://{host}/{k}", "<html><body><div>" + "".join(f"<p>{x}</p>" for x in body) + "</div></body></html>", " ".join(x for x in body if x not in more[:-1] or x.startswith("Some")) if k % 10 < 7 else " ".join(own)))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {r[0]: r[3] for r in rows}
