"""Phrase collocation mining by stripes: each prefix keys a counter of the words that follow it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: What ends a piece of a text, what parts words, and what is lower-cased.
ENDS, BLANKS, CAPITALS = b".,;:!?\n\x0b\x0c\r", b" \t", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = bytes.maketrans(ENDS + BLANKS + CAPITALS, b"." * len(ENDS) + b" " * len(BLANKS) + CAPITALS.lower())
#: Words of one lang that a task counts at once, about; how many times as many it holds of all langs; distinct words of a lang whose numbers it keeps.
CHUNK, LANGS, KEPT = 500_000, 4, 100_000
#: Bits of a filter, whatever the corpus, and of a segment of it.
FILTER, SEGMENT = 1 << 26, 1 << 16
#: Parts of a prefix' stripe, by its words, so that no frequent prefix is one task's.
PARTS = 32
#: Buckets of fingerprints and stripes, as powers of two: one for each 1,024 texts, but not fewer or more. A chunk has a row for each, so they are few where the chunks are.
BUCKETS = (8, 16)
#: Salts of the first ranking.
SALTS = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _prints(lang: str, words: np.ndarray, buckets: int) -> np.ndarray:
    """A fingerprint for each row of word hashes: `buckets` bits of its bucket, then 32 bits."""
    x = np.full(len(words), xxhash.xxh64_intdigest(lang), np.uint64)
    for k in range(words.shape[1]):
        x = _mixed((x ^ words[:, k]) * _ODD)
    return (x >> np.uint64(64 - buckets)) << np.uint64(32) | (x & _LOW)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then the next ones: high bytes are mostly zero and compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _plain(b: bytes, kind: type) -> np.ndarray:
    """The numbers of `_planes`."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _places(prints: np.ndarray, size: int) -> np.ndarray:
    """Two places of a filter of `size` bits for each fingerprint."""
    x = _mixed(prints * _ODD)
    return np.stack([x % np.uint64(size), (x >> np.uint64(32)) * np.uint64(3) % np.uint64(size)], axis=1)


def _held(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = _places(prints, 8 * len(bits))
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def filter_of(known: DataFrame, buckets: int, size: int = FILTER) -> np.ndarray:
    """A Bloom filter of `known` (lang, gram, print: a fingerprint, or null and that of the phrase counts), `size` bits whatever their number, put together from segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [b.column(2).drop_null().to_numpy().view(np.uint64)]
            by: dict[tuple[str, int], list[bytes]] = {}
            for lang, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if g is not None:
                    by.setdefault((lang, len(g)), []).append(g)
            own += [_prints(lang, np.frombuffer(b"".join(x), np.uint64).reshape(len(x), -1), buckets) for (lang, _), x in by.items()]
            at = np.unique(_places(np.concatenate(own), size)).astype(np.int64)
            yield pa.record_batch([pa.array((at // SEGMENT).astype(np.int32)), pa.array((at % SEGMENT).astype(np.int32))], names=["segment", "bit"])

    def packed(table: pa.Table) -> pa.Table:
        own = np.zeros(SEGMENT, bool)
        own[table.column("bit").to_numpy()] = True
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    bits = np.zeros(size // 8, np.uint8)
    places = known.select("lang", "gram", "print").mapInArrow(run, "segment int, bit int").distinct()
    for r in places.groupBy("segment").applyInArrow(packed, "segment int, bits binary").collect():
        bits[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


class _Numbers(dict):
    """Numbers of words, from 1 on, with their hashes; 0 is the end of a piece."""

    def __init__(self, seed: int):
        self.seed, self.hashes = seed, [0]
        self[b"."] = 0
        self.told = np.zeros(1, bool)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return n

    def untold(self, here: np.ndarray) -> np.ndarray:
        """Numbers of the words of `here` that weren't asked for before."""
        told = np.zeros(len(here), bool)
        told[: len(self.told)] = self.told
        self.told = told | here
        return np.flatnonzero(here & ~told)


def _numbered(batches: Iterator[pa.RecordBatch], seed: int, chunk: int) -> Iterator[tuple[str, np.ndarray, _Numbers]]:
    """(lang, numbers of words with a 0 after each piece, their table) of all texts, about `chunk` words of a lang at a time; with many langs, the lang of most words when LANGS times as many are held."""
    tables: dict[str, _Numbers] = {}
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def out(lang: str) -> tuple[str, np.ndarray, _Numbers]:
        del sizes[lang]
        table = tables[lang]
        if len(table) > KEPT:
            del tables[lang]
        return lang, np.concatenate(held.pop(lang)).astype(np.int64), table

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            if lang not in tables:
                tables[lang] = _Numbers(seed)
            words = ((text.as_py() or b"").translate(_PLAIN).replace(b".", b" . ") + b" .").split()
            held.setdefault(lang, []).append(np.fromiter(map(tables[lang].__getitem__, words), np.int32, len(words)))
            sizes[lang] = sizes.get(lang, 0) + len(words)
            if sizes[lang] >= chunk:
                yield out(lang)
            elif sum(sizes.values()) >= LANGS * chunk:
                yield out(max(sizes, key=sizes.get))
    for lang in list(sizes):
        yield out(lang)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def _binary(words: np.ndarray) -> pa.Array:
    """Rows of 64-bit numbers as binary values."""
    width = 8 * words.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(words), [None, pa.py_buffer(np.ascontiguousarray(words).tobytes())]).cast(pa.binary())


#: What tasks send: stripes (part: the words of a prefix, 0 for the counts of words) of a bucket: columns of the prefix'
#: words and of the words that follow in `blob`, how often in `counts`; fingerprints of a bucket (PRINTS), as differences,
#: with counts up to 255; words (WORDS) with their text, once for each table of numbers; all words of a lang (ALL).
_SENT = {"lang": pa.string(), "prefix": pa.binary(), "part": pa.int32(), "n": pa.int64(), "blob": pa.binary(), "counts": pa.binary()}
_SENT_DDL = "lang string, prefix binary, part int, n long, blob binary, counts binary"
PRINTS, WORDS, ALL = -1, -2, -3
#: What is known when they are added up: kind (part of what was sent, or 0), a phrase or word with its count, a word with its text, or a fingerprint.
_KNOWN = {"kind": pa.int32(), "lang": pa.string(), "gram": pa.binary(), "n": pa.int64(), "word": pa.binary(), "print": pa.int64()}
_KNOWN_DDL = "kind int, lang string, gram binary, n long, word binary, print long"


def _rows(kinds: dict, n: int, /, **columns) -> pa.RecordBatch:
    given = {k: v if isinstance(v, pa.Array) else pa.array(v, kinds[k]) for k, v in columns.items()}
    return pa.record_batch([given.get(k, pa.nulls(n, kind)) for k, kind in kinds.items()], names=list(kinds))


def _cut(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the buckets, where each begins, and the end) of sorted bucket numbers."""
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[: len(bucket)]
    return bucket[first], np.append(first, len(bucket))


def _stripes(lang: str, code: np.ndarray, count: np.ndarray, base: int, prefixes: np.ndarray, hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Stripes of sorted codes (number of a prefix * base + number of a word), by bucket of prefix and part; prefixes has the hashes of a prefix' words."""
    prefix, word = prefixes[code // base], hashes[code % base]
    own = _mixed(word * _ODD)
    if prefix.shape[1]:  # without a prefix each word goes by itself
        own %= np.uint64(PARTS)
    for k in range(prefix.shape[1]):
        own = _mixed((own ^ prefix[:, k]) * _ODD)
    own >>= np.uint64(64 - buckets)
    order = np.argsort(own, kind="stable")  # within a bucket the stripes stay whole
    columns = np.concatenate([prefix, word[:, None]], axis=1)[order]
    count = count[order].astype(np.uint32)
    numbers, ends = _cut(own[order].astype(np.uint32))
    blob = [np.ascontiguousarray(columns[x:y].T).tobytes() for x, y in zip(ends[:-1], ends[1:])]
    counts = [_planes(count[x:y]) for x, y in zip(ends[:-1], ends[1:])]
    n = len(numbers)
    return _rows(_SENT, n, lang=[lang] * n, prefix=[b.tobytes() for b in numbers], part=np.full(n, prefix.shape[1], np.int32), blob=blob, counts=counts)


def _buckets(prints: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket of fingerprints: five bytes for each of them, of which two are mostly alike."""
    order = np.argsort(prints)
    prints, count = prints[order], np.minimum(count[order], 255).astype(np.uint8)
    numbers, ends = _cut((prints >> np.uint64(32)).astype(np.uint32))
    low = (prints & _LOW).astype(np.uint32)
    blob = [_planes(np.diff(low[x:y], prepend=np.uint32(0))) for x, y in zip(ends[:-1], ends[1:])]
    counts = [count[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])]
    n = len(numbers)
    return _rows(_SENT, n, lang=[""] * n, prefix=[b.tobytes() for b in numbers], part=np.full(n, PRINTS, np.int32), blob=blob, counts=counts)


class _Counter:
    """Counts of one chunk of one lang: pairs, then triples of frequent pairs, then fours of triples."""

    def __init__(self, lang: str, at: np.ndarray, table: _Numbers, buckets: int):
        self.lang, self.at, self.base, self.bits = lang, at, len(table.hashes), buckets
        self.hashes = np.array(table.hashes, np.uint64)

    def longer(self, before: np.ndarray, prefixes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, codes, own, counts, hashes) of phrases of `size` words whose prefix and suffix have numbers, 0 or more, in `before`."""
        at, n = self.at, len(self.at)
        i = np.flatnonzero((before[: n - 1] >= 0) & (before[1:n] >= 0) & (np.arange(1, n) + size - 2 < n))
        code, own, count = np.unique(before[i] * self.base + at[i + size - 1], return_inverse=True, return_counts=True)
        return i, code, own, count, np.concatenate([prefixes[code // self.base], self.hashes[code % self.base][:, None]], axis=1)

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words or -1, their hashes)"""
        return np.where(self.at > 0, self.at, -1), self.hashes[:, None]

    def numbers(self, i: np.ndarray, own: np.ndarray, some: np.ndarray) -> np.ndarray:
        out = np.full(len(self.at), -1, np.int64)
        out[i] = np.where(some[own], own, -1)
        return out

    def stripes(self, code: np.ndarray, count: np.ndarray, prefixes: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
        return _stripes(self.lang, code[some], count[some], self.base, prefixes, self.hashes, self.bits)

    def prints(self, words: np.ndarray) -> np.ndarray:
        return _prints(self.lang, words, self.bits)


def pair_prints(docs: DataFrame, seed: int, buckets: int, chunk: int) -> DataFrame:
    """Fingerprints of all pairs of neighbouring words, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, at, table in _numbered(batches, seed, chunk):
            c = _Counter(lang, at, table, buckets)
            both = (at[:-1] > 0) & (at[1:] > 0)
            code, count = np.unique(at[:-1][both] * c.base + at[1:][both], return_counts=True)
            yield _buckets(c.prints(np.stack([c.hashes[code // c.base], c.hashes[code % c.base]], axis=1)), count)

    return _texts(docs).mapInArrow(run, _SENT_DDL)


def pair_stripes(docs: DataFrame, seed: int, buckets: int, chunk: int, pairs: np.ndarray) -> DataFrame:
    """Stripes of one word, of the pairs that the filter has; and fingerprints of the phrases of three and four words that are made of such pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)  # of a fixed number of bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, at, table in _numbered(batches, seed, chunk):
            c = _Counter(lang, at, table, buckets)
            one, words = c.singles()
            i, code, own, count, two = c.longer(one, words, 2)
            some = _held(shared.value, c.prints(two))
            yield c.stripes(code, count, words, some)
            i, code, own, count, three = c.longer(c.numbers(i, own, some), two, 3)
            four = c.longer(c.numbers(i, own, np.ones(len(code), bool)), three, 4)
            yield _buckets(np.concatenate([c.prints(three), c.prints(four[4])]), np.concatenate([count, four[3]]))

    return _texts(docs).mapInArrow(run, _SENT_DDL)


def longer_stripes(docs: DataFrame, seed: int, buckets: int, chunk: int, known: np.ndarray) -> DataFrame:
    """Stripes of two and three words, of the phrases that the filter has with all their parts; words that it has with their texts, and the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # of a fixed number of bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, at, table in _numbered(batches, seed, chunk):
            c = _Counter(lang, at, table, buckets)
            one, words = c.singles()
            i, code, own, count, two = c.longer(one, words, 2)
            i, code, own, count, three = c.longer(c.numbers(i, own, _held(shared.value, c.prints(two))), two, 3)
            some = _held(shared.value, c.prints(three))
            yield c.stripes(code, count, two, some)
            i, code, own, count, four = c.longer(c.numbers(i, own, some), three, 4)
            yield c.stripes(code, count, three, _held(shared.value, c.prints(four)))

            times = np.bincount(at, minlength=c.base)
            yield _rows(_SENT, 1, lang=[lang], prefix=[b""], part=[ALL], n=[int(times[1:].sum())])
            here = (times > 0) & _held(shared.value, c.prints(words))
            here[0] = False
            yield c.stripes(np.arange(c.base), times, np.empty((1, 0), np.uint64), here)
            own = table.untold(here)
            new = np.zeros(len(table), bool)
            new[own] = True
            texts = list(compress(table, new))  # words stand in order of their numbers
            yield _rows(_SENT, len(own), lang=[lang] * len(own), prefix=_binary(words[own]), part=np.full(len(own), WORDS, np.int32), blob=pa.array(texts, pa.binary()))

    return _texts(docs).mapInArrow(run, _SENT_DDL)


def added(sent: DataFrame, least: int) -> DataFrame:
    """What tasks sent, added up (_KNOWN): phrases, words and fingerprints that occur `least` times or more, words' texts, and the number of all words of a lang.

    Stripes are added element by element, as sorted columns of a bucket; a task holds those of one bucket, and a batch.
    Words with two texts come twice.
    """

    def stripes(rows: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        langs, grams, counts = [], [], []
        first = np.append(np.flatnonzero(new), rows.num_rows).tolist()
        for x, y in zip(first[:-1], first[1:]):
            size = rows.column(2)[x].as_py() + 1
            columns = np.concatenate([np.frombuffer(b, np.uint64).reshape(size, -1) for b in rows.column(4).slice(x, y - x).to_pylist()], axis=1)
            n = np.concatenate([_plain(b, np.uint32) for b in rows.column(5).slice(x, y - x).to_pylist()]).astype(np.int64)
            order = np.lexsort(columns[::-1])
            columns, n = columns[:, order], n[order]
            at = np.flatnonzero(np.concatenate(([True], (columns[:, 1:] != columns[:, :-1]).any(axis=0))))[: len(n)]
            n = np.add.reduceat(n, at) if len(at) else n
            keep = n >= least
            grams.append(_binary(columns[:, at[keep]].T))
            counts.append(n[keep])
            langs.extend([rows.column(0)[x].as_py()] * int(keep.sum()))
        return _rows(_KNOWN, len(langs), kind=np.zeros(len(langs), np.int32), lang=langs, gram=pa.concat_arrays(grams), n=np.concatenate(counts))

    def prints(rows: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in rows.column(5).to_pylist()])
        bucket = np.repeat(np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint32), sizes).astype(np.uint64)
        low = np.concatenate([np.cumsum(_plain(b, np.uint32), dtype=np.uint64) for b in rows.column(4).to_pylist()])
        own = bucket << np.uint64(32) | low
        count = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint8)
        order = np.argsort(own)
        own = own[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))[: len(own)]
        many = own[first][np.add.reduceat(count[order].astype(np.int64), first) >= least] if len(first) else own
        return _rows(_KNOWN, len(many), kind=np.full(len(many), PRINTS, np.int32), print=many.view(np.int64))

    def words(rows: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        texts: dict[tuple[int, bytes | None], int] = {}
        for g, text, n in zip(np.cumsum(new) - 1, rows.column(4).to_pylist(), rows.column(3).to_pylist()):
            texts[g, text] = texts.get((g, text), 0) + (n or 0)
        of = rows.take(pa.array(np.flatnonzero(new)[[g for g, _ in texts]].astype(np.int64)))
        return _rows(_KNOWN, len(texts), kind=of.column(2), lang=of.column(0), gram=of.column(1), n=list(texts.values()), word=[w for _, w in texts])

    def starts(rows: pa.RecordBatch) -> np.ndarray:
        differ = np.zeros(rows.num_rows - 1, bool)
        for c in range(3):
            x = rows.column(c)
            differ |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
        return np.concatenate(([True], differ))

    def out(rows: pa.RecordBatch, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        part, group = rows.column(2).to_numpy(), np.cumsum(new)
        for kind, f in ((part >= 0, stripes), (part == PRINTS, prints), (part <= WORDS, words)):
            at = np.flatnonzero(kind)
            if len(at):
                own = group[at]
                yield f(rows.take(pa.array(at)), np.concatenate(([True], own[1:] != own[:-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.concat_batches([*held, b])
            new = starts(rows)
            whole = int(np.flatnonzero(new)[-1])  # the last group may go on
            if whole:
                yield from out(rows.slice(0, whole), new[:whole])
            held = [rows.slice(whole)]
        if held:
            rows = pa.concat_batches(held)
            yield from out(rows, starts(rows))

    by = ("lang", "prefix", "part")
    return sent.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, _KNOWN_DDL)


def _big(c: str) -> Column:
    return F.col(c).cast("decimal(30,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, subsumed: int = 80, seed: int = 0, chunk: int = CHUNK, size: int = FILTER) -> DataFrame:
    """The first `top` phrases of 2 to 4 words of each lang in `docs` (lang, text): lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased (A-Z), pieces end at .,;:!? and line ends, words at blanks and tabs. A null lang is `und`, a null
    text empty; every row counts, repeated ones too. a is how often a phrase occurs; phrases of less than `least` are no
    candidates. Of the cuts of a phrase in two that with the lowest score floor(2000000 a / (l + r)) counts, of equals the
    earliest; l and r are the counts of its parts, n that of all words of the lang. A phrase is dropped if a longer candidate
    that contains it has `subsumed` per cent of its count. Order: score, a, both falling, then the phrase's bytes.

    Stripes: each prefix has a counter of the words that follow it, and tasks' stripes are added up element by element,
    those of a prefix in PARTS parts by the words in them. A stripe's entries are the counts of a phrase and of its
    extensions to the right; by the words without the first they are its extensions to the left, so counts of parts and the
    largest extension come from the same entries. Longer extensions needn't be looked at: where one has so much of the
    count, so has the one of one word in it. Most phrases are rare, and are told by fingerprints of five bytes before any
    stripe is made of them: first those of all pairs are added up; a second pass makes the stripes of pairs whose fingerprint
    is frequent, and fingerprints of three and four words of such pairs; a third makes the stripes of these, and counts
    the words of frequent pairs, whose texts a task sends once. Frequent fingerprints reach tasks in filters of a fixed size, which never lose one: what
    they let through besides costs a stripe, and nothing in the result. Words go by 64-bit hashes; should two words of a
    lang share one, everything is counted anew with another seed.
    """
    docs = docs.select("lang", "text")
    buckets = min(max(BUCKETS[0], (docs.count() // 1024).bit_length()), BUCKETS[1])
    prints = settled(added(pair_prints(docs, seed, buckets, chunk), least))
    first = settled(added(pair_stripes(docs, seed, buckets, chunk, filter_of(prints, buckets, size)), least))
    two = first.where("kind = 0").select("lang", "gram", "n")
    singles = two.select("lang", F.explode(F.array(F.expr("substring(gram, 1, 8)"), F.expr("substring(gram, 9)"))).alias("gram")).distinct()
    known = first.select("lang", "gram", "print").union(singles.select("lang", "gram", F.lit(None).cast("long")))
    last = settled(added(longer_stripes(docs, seed, buckets, chunk, filter_of(known, buckets, size)), least))
    words = last.where(F.col("kind") == WORDS)
    if not words.groupBy("lang", "gram").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        return collocations(docs, least, top, subsumed, seed + 1, chunk, size)
    totals = last.where(F.col("kind") == ALL).select("lang", F.col("n").alias("total"))
    common = last.where("kind = 0 and length(gram) = 8").select("lang", "gram", "n")
    more = last.where("kind = 0 and length(gram) > 8").select("lang", "gram", F.expr("substring(gram, 1, length(gram) - 8)").alias("prefix"), "n")
    found = two.union(more.select("lang", "gram", "n"))

    longer = more.select("lang", F.col("prefix").alias("gram"), "n").union(more.select("lang", F.expr("substring(gram, 9)").alias("gram"), "n"))
    longer = longer.groupBy("lang", "gram").agg(F.max("n").alias("most"))
    kept = found.join(longer, ["lang", "gram"], "left").where(F.coalesce(100 * _big("most"), F.lit(0)) < subsumed * _big("n"))
    kept = settled(kept.select("lang", "gram", F.col("n").alias("a")))

    parts = common.union(found.select("lang", "gram", "n"))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), (F.length("gram") / 8).cast("int") - 1)))
    cuts = cuts.select("*", F.expr("substring(gram, 1, 8 * k)").alias("left"), F.expr("substring(gram, 8 * k + 1)").alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("gram").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("gram").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("cast(a as decimal(30,0)) * 2000000 div (cast(l as decimal(30,0)) + r)"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("x")
    scored = settled(cuts.groupBy("lang", "gram", "a").agg(best).select("lang", "gram", "a", "x.l", "x.r", "x.score"))

    # phrases that can't be among the first go before words are looked up; ties at the end stay
    place = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).orderBy(F.desc("score"), F.desc("a"))
    scored = scored.withColumn("at", F.rank().over(place)).where(F.col("at") <= top).drop("at")
    scored = scored.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("at") <= top).drop("at")
    each = scored.withColumn("i", F.explode(F.sequence(F.lit(0), (F.length("gram") / 8).cast("int") - 1)))
    each = each.select("*", F.expr("substring(gram, 8 * i + 1, 8)").alias("one"))
    each = each.join(words.select("lang", F.col("gram").alias("one"), F.col("word").cast("string").alias("word")), ["lang", "one"])
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")
    told = each.groupBy("lang", "gram", "a", "l", "r", "score").agg(phrase)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = told.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(totals, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
