"""Substring dedup by hashing lines and their parts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, text_key, unused

_TOKEN = re.compile(r"\n|\S+")
#: A sentence ends with a word that ends with its mark and what else is no letter.
_END = re.compile(r"(?:[.?]|(?<!!)!(?!!))[^\w\s]*$")
#: One word in CUT, by its hash, ends a unit as well, and a unit has LONGEST words at most.
CUT, LONGEST = 8, 48


def _ends() -> Callable[[str], bool]:
    """Whether a word ends a unit; answers are kept for up to half a million words."""
    known: dict[str, bool] = {}

    def ends(word: str) -> bool:
        said = known.get(word)
        if said is None:
            if len(known) > 500_000:
                known.clear()
            said = known[word] = bool(_END.search(word)) or zlib.crc32(word.lower().encode("utf-8", "replace")) % CUT == 0
        return said

    return ends


def units(text: str, ends: Callable[[str], bool] | None = None) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, words, normalised text) of the units of a text in order: case and white space don't matter.

    A unit is a line, cut after each sentence and after the words that their hashes choose. Where a passage stands
    in the middle of a line, all but its first and last unit are therefore cut alike.
    """
    ends = ends or _ends()
    own: list[str] = []
    start = end = 0
    for m in _TOKEN.finditer(text):
        word = m[0]
        if word != "\n":
            if not own:
                start = m.start()
            own.append(word.lower())
            end = m.end()
            if not ends(word) and len(own) < LONGEST:
                continue
        if own:
            yield start, end, len(own), " ".join(own)
            own = []
    if own:
        yield start, end, len(own), " ".join(own)


def with_units(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, text_key and arrays digest, start, end, words, times of its units.

    times is how often a unit occurs in the text at its first occurrence there, 0 at later ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = _ends()
        for batch in batches:
            rows: list = [[], [], [], [], []]
            for text in batch.column(2):
                own = [(xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) - (1 << 63), a, b, w) for a, b, w, x in units(text.as_py() or "", ends)]
                left = Counter(x[0] for x in own)
                own = [(*x, left.pop(x[0], 0)) for x in own]
                for to, x in zip(rows, zip(*own) if own else ((),) * 5):
                    to.append(list(x))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([*batch.columns[:2], *(pa.array(r, pa.list_(k)) for r, k in zip(rows, kinds))], names=["doc_id", "text_key", "digest", "start", "end", "words", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, digest array<long>, start array<int>, end array<int>, words array<int>, times array<int>")


def repeated_spans(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """Spans of `docs` (doc_id, text) to remove: doc_id, text_key, again, start, end (characters of the original text), n_words, kept_in.

    The occurrence of a unit that is first in order of doc_id (null last), text and position stays; every other one is
    repeated. Repeated units that follow on one another form a span, so a repeated line is one. With `min_words` a span
    stays unless so many words of it have their first occurrence in one document, or it has twice as many whatever their
    first documents: texts share short lines by chance or habit. kept_in is the document of the most words (of equals the smallest id).

    Rows of one doc_id, or without one, are told apart by their text. Of rows equal in both one is the first; the others have
    one span (again: true) from their first unit to their last, as all of them is repeated. Null, empty and blank texts have no units.

    A unit goes to the count once for each document, with its number there; the digests that occur twice or more are
    written before all units meet them, so that adaptive execution can split the join where one digest has most of them.
    """
    rows = settled(with_units(docs).withColumn("row", F.monotonically_increasing_id()))
    own = rows.groupBy("doc_id", "text_key").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    n, kinds, ids = own.agg(F.sum("n"), F.count("*"), F.count_distinct("doc_id")).first()
    extra = None
    if n and n > kinds:
        own = settled(own)
        extra = rows.join(own.select("row"), "row", "left_anti").where(F.size("digest") > 0)
        total = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
        extra = extra.select("doc_id", "text_key", F.lit(True).alias("again"), F.array_min("start").alias("start"), F.array_max("end").alias("end"), total.alias("n_words"), F.col("doc_id").alias("kept_in")).where(F.col("n_words") >= min_words)
        rows = rows.join(own.select("row"), "row", "left_semi")
    # ids that are all different are places by themselves, and less to send
    place = F.col("doc_id") if ids == kinds else F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    each = rows.select("row", place.alias("place"), F.posexplode(F.arrays_zip("digest", "start", "end", "words", "times")).alias("pos", "u"))
    first = each.where("u.times > 0").groupBy("u.digest").agg(F.min("place").alias("first"), F.sum("u.times").alias("times"))
    first = settled(first.where("times > 1").select("digest", "first"))
    words = F.when(F.col("u.times") == 0, -F.col("u.words")).otherwise(F.col("u.words"))  # below 0: not the first in its text
    each = each.select("row", "place", "pos", "u.digest", "u.start", "u.end", words.alias("words"))
    again = each.join(first, "digest").where((F.col("words") < 0) | (F.col("place") > F.col("first")))
    again = again.select("row", "pos", "start", "end", F.abs("words").alias("words"), F.col("first").alias("kept_in"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("row").orderBy("pos"))
    parts = again.withColumn("run", island).groupBy("row", "run", "kept_in")
    parts = parts.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n"))
    most = F.min_by("kept_in", F.struct(-F.col("n"), F.col("kept_in"))).alias("kept_in")
    runs = parts.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_words"), F.max("n").alias("most"), most)
    runs = runs.where((F.col("most") >= min_words) | (F.col("n_words") >= 2 * min_words))
    spans = runs.join(rows.select("row", "doc_id", "text_key"), "row")
    spans = spans.select("doc_id", "text_key", F.lit(False).alias("again"), "start", "end", "n_words", F.col("kept_in" if ids == kinds else "kept_in.id").alias("kept_in"))
    return spans if extra is None else spans.union(extra)


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with the spans cut out of `text`, and `removed` (array of start and end in the original text; null if none) in place of a column of that name.

    Spans cut only the text they were found in. Of rows equal in id and text one has the spans that aren't `again`, the others those that are.
    """
    at, key, cut, own, row, low = unused(docs, "id", "key", "removed", "own", "row", "low")
    cuts = spans.groupBy(F.col("doc_id").alias(at), F.col("text_key").alias(key), "again").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("c"))
    cuts = settled(cuts.groupBy(at, key).agg(F.struct(F.max(F.when(~F.col("again"), F.col("c"))).alias("first"), F.max(F.when(F.col("again"), F.col("c"))).alias("later")).alias(cut)))
    docs = docs.drop("removed")
    names = docs.columns
    rows = docs.withColumn(own, text_key(F.col("text")))
    same = (F.col(own) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(at))
    some = cuts.where(F.col(f"{cut}.later").isNotNull())
    chosen = F.col(f"{cut}.first")
    if not some.isEmpty():
        rows = settled(rows.withColumn(row, F.monotonically_increasing_id()))
        least = rows.join(some.select(at, key), same, "left_semi").groupBy(F.col(own).alias(key), F.col("doc_id").alias(at)).agg(F.min(row).alias(low))
        cuts = cuts.join(least.select(F.col(key).alias("k"), F.col(at).alias("i"), low), F.col(key).eqNullSafe(F.col("k")) & F.col(at).eqNullSafe(F.col("i")), "left").drop("k", "i")
        chosen = F.when(F.col(row) > F.col(low), F.col(f"{cut}.later")).otherwise(chosen)
    # ids without a cut, null ones too, match nothing and lie spread by their text
    out = rows.join(cuts, same, "left").withColumn(cut, chosen)
    upto = lambda i: F.coalesce(F.get(cut, i - 1)["end"], F.lit(0))
    pieces = F.transform(cut, lambda x, i: F.substring("text", upto(i) + 1, x["start"] - upto(i)))
    clean = F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), F.element_at(cut, -1)["end"] + 1, F.length("text")))
    return out.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(clean)).select(*names, F.col(cut).alias("removed"))
