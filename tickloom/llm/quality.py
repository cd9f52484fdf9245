"""Quality classifier: histogram gradient-boosted trees over document statistics."""

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Labelled rows that a model is fitted on, at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
BINS = 64
STATISTICS = (
    "log_chars", "log_words", "mean_word", "sd_word", "max_word", "upper", "lower", "digits", "spaces", "marks", "ends", "commas", "symbols", "bars", "exclamations", "non_ascii",
    "words_with_end", "words_upper", "words_title", "words_no_letter", "words_symbol_end", "distinct_words", "top_word", "repeated_words",
    "log_lines", "mean_line", "distinct_lines", "lines_with_end", "entropy", "sentence", "distinct_starts", "log_compressed",
)


def statistics(text: str) -> list[float]:
    """The figures named in STATISTICS, of the whole text; an empty text has defined ones too."""
    n = max(len(text), 1)
    chars = Counter(text)
    words = text.split()
    w = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    upper = lower = digits = spaces = marks = high = 0
    entropy = 0.0
    for c, k in chars.items():
        entropy -= k / n * math.log2(k / n)
        if c.islower():
            lower += k
        elif c.isupper():
            upper += k
        elif c.isdigit():
            digits += k
        elif c.isspace():
            spaces += k
        else:
            marks += k
        high += k * (c > "\x7f")
    ends = chars["."] + chars["?"] + chars["!"]
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(len(lines), 1)
    sentences = max(text.count(". ") + text.count(".\n") + text.endswith("."), 1)
    odd = "%&*#$|!"
    return [
        math.log1p(len(text)), math.log1p(len(words)), float(sizes.mean()), float(sizes.std()), math.log1p(float(sizes.max())),
        upper / n, lower / n, digits / n, spaces / n, marks / n, ends / n, chars[","] / n, sum(chars[c] for c in odd) / n, chars["|"] / n, chars["!"] / n, high / n,
        sum(k for x, k in counts.items() if x[-1] in ".?!") / w, sum(k for x, k in counts.items() if x.isupper() and len(x) > 1) / w, sum(k for x, k in counts.items() if x.istitle()) / w,
        sum(k for x, k in counts.items() if not any(c.isalpha() for c in x)) / w, sum(k for x, k in counts.items() if x[-1] in odd) / w,
        len(counts) / w, max(counts.values(), default=0) / w, sum(k for k in counts.values() if k > 1) / w,
        math.log1p(len(lines)), len(words) / m, len(set(lines)) / m, sum(x.rstrip()[-1] in ".?!:" for x in lines) / m, entropy,
        min(len(words) / sentences, 1000.0), len({x[:2] for x in counts}) / max(len(counts), 1), math.log1p(len(zlib.compress(text.encode("utf-8", "replace"), 1))) - math.log1p(n),
    ]


@dataclass
class Trees:
    """All trees of a model in flat arrays: of node i the feature tested (-1: a leaf), the threshold, the left child (the right one follows it) and the value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics; all rows and trees go down together, a level at a time."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            right = x[row, np.maximum(f, 0)] > self.threshold[node]
            node = np.where(f >= 0, self.left[node] + right, node)
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, least: int = 8, ridge: float = 1.0) -> Trees:
    """Gradient boosting for the logistic loss; splits are searched in histograms of BINS quantile bins a column."""
    n, columns = x.shape
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = math.log(share / (1 - share))
    feature, threshold, left, value, roots = [], [], [], [], []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(columns)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, columns), int)
    margin = np.full(n, base)
    offset = np.arange(columns) * BINS
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        roots.append(len(feature))
        feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
        open_nodes = [(roots[-1], np.arange(n), 0)]
        while open_nodes:
            node, rows, level = open_nodes.pop()
            g, h = gradient[rows], hessian[rows]
            value[node] = rate * g.sum() / (h.sum() + ridge)
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                at = (bins[rows] + offset).ravel()
                sums = [np.bincount(at, np.repeat(v, columns), columns * BINS).reshape(columns, BINS).cumsum(axis=1) for v in (g, h, np.ones(len(rows)))]
                gl, hl, nl = sums
                gr, hr, nr = (s[:, -1:] - s for s in sums)
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
                gain[(nl < least) | (nr < least)] = 0
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                best = (gain[j, b], (int(j), int(b)))
            if best[1] is None or best[0] <= 1e-6:
                margin[rows] += value[node]
                continue
            j, b = best[1]
            feature[node], threshold[node], left[node] = j, float(edges[j][b]), len(feature)
            for _side in range(2):
                feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
            goes = bins[rows, j] > b
            open_nodes += [(left[node], rows[~goes], level + 1), (left[node] + 1, rows[goes], level + 1)]
    return Trees(np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(value), base, depth)


def scorer(model: Trees):
    """A column function: the score of a text, from whole texts in Arrow batches. Null counts as empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t or "") for t in texts], np.float64).reshape(-1, len(STATISTICS))
            yield pd.Series(model.score(x))

    return F.pandas_udf(run, "double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """A model of `labels` (doc_id, quality) from the texts of `docs` (doc_id, text).

    Labels of held-out ids, null labels and null ids aren't used; of several labels of an id the largest counts. Up to
    `rows` labelled documents, those of the smallest hashes, are fitted on the driver; their statistics, not their
    texts, go there. Without labels of both kinds every score is 0.5 or the share of 1s.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    some = settled(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [statistics(t or "") for t in b["text"]]})

    # at most `rows` pairs of an id and a label are broadcast
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("y", "text").mapInPandas(run, "y int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(STATISTICS))
    order = np.lexsort(x.T) if len(x) else np.zeros(0, int)  # the same model whatever the order of rows
    return fit(x[order], got["y"].to_numpy(np.float64)[order])


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    Empty and null texts get the score of a text without words. held_out is false for a null id.
    """
    score = scorer(train(docs, labels, rows))
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
