"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, settled, text_key, unused

#: What is known of a group of equal rows.
ITEM = ["size", "doc_id", "key", "source", "m", "base", "whole", "source_size", "target"]
#: Copies that one row of a plan makes at most.
BLOCK = 10_000


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """`sources` (source, source_size) with `target`, the words that each source gives to the mix.

    Sources by code point, null last, take `weights` in turn. Together they give `share` of all words; a source gives
    `limit` times its size at most and the others share the rest by weight. That is least(cap, level * weight), with the
    level the largest of those that follow when the sources are capped in order of cap / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    s = sources.withColumn("weight", F.element_at(kinds, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    spent, used = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("cap", "weight"))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - spent) / (F.sum("weight").over(every) - used)
    s = s.withColumn("level", level)
    return s.select("source", "source_size", F.least("cap", F.max("level").over(every) * F.col("weight")).alias("target"))


def _uniform(*of: Column, seed: int) -> Column:
    """A number from 0 to under 1 that depends on some values and the seed alone."""
    return F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _rounded(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Within each group of `keys`, pair the rows' probabilities until one is left.

    Of a pair with the sum s < 1 one row gets 0 and the other s; else one gets 1 and the other s - 1. Which is drawn so
    that each keeps its expectation. Gives the keys, `done` (array of rows with `take`) and `left` (the row with p in 0..1).
    """
    item = F.struct(*ITEM, "p", F.lit(0).alias("take"))

    def put(x: Column, p: Column, take: Column) -> Column:
        return x.withField("p", p).withField("take", take)

    def step(state: Column, x: Column) -> Column:
        r = state["left"]
        total = r["p"] + x["p"]
        few = total < 1
        chance = F.when(few, x["p"] / total).otherwise((1 - x["p"]) / (2 - total))
        drawn = _uniform(r["doc_id"], r["key"], x["doc_id"], x["key"], seed=seed)
        pair = F.when(drawn < chance, F.array(r, x)).otherwise(F.array(x, r))
        done = put(pair[0], F.lit(0.0), F.when(few, 0).otherwise(1))
        left = put(pair[1], F.when(few, total).otherwise(total - 1), F.lit(0))
        return F.struct(F.concat(state["done"], F.array(done)).alias("done"), left.alias("left"))

    largest_first = F.sort_array(F.collect_list(item), asc=False)  # so that what is left at last is small
    got = rows.groupBy(*keys).agg(largest_first.alias("items"))
    start = F.struct(F.slice("items", 1, 0).alias("done"), F.element_at("items", 1).alias("left"))
    folded = F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), start, step)
    return got.select(*keys, folded.alias("f")).select(*keys, "f.done", "f.left")


def decisions(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 7, fan: int = 256) -> DataFrame:
    """What the mix takes of each group of equal rows of `docs` (doc_id, text, source): doc_id, key, source, size, m, base, more, source_size, target.

    Rows are equal if they share id, source and text; `key` is a hash of the text. Each of a group's m rows is taken `base`
    times, and `more` of them (0 to m) once more.

    Every document of a source has target / source_size copies due: the whole part is taken, the fraction is rounded
    by pivotal dependent rounding. Of m equal rows the whole part of m fractions is taken at once, and only what is left
    of it goes on as one row. The first groups hold documents of one source and about one size (16 classes an
    octave), about `fan` of them by a hash of id and key, so that the sum of words barely moves; what is left of each goes on
    to a group of `fan` groups, and so on: a reduction tree in which no group outgrows `fan`. The last step joins the
    size classes of a source, the very last remainder is drawn by itself.
    """
    sized = docs.select("doc_id", text_key(F.col("text")).alias("key"), "source", n_words(F.col("text")).alias("size"))
    items = settled(sized.groupBy("doc_id", "key", "source", "size").agg(F.count("*").alias("m")))
    sources = settled(targets(items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, share, limit))
    s = sources.withColumnRenamed("source", "s")
    items = items.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    items = items.withColumn("base", F.floor(due + 1e-9).cast("int"))
    fractions = F.when(F.col("size") > 0, F.greatest(due - F.col("base"), F.lit(0.0)) * F.col("m")).otherwise(F.lit(0.0))
    items = items.withColumn("p", fractions).withColumn("whole", F.floor(F.col("p") + 1e-9)).withColumn("p", F.greatest(F.col("p") - F.col("whole"), F.lit(0.0)))
    items = items.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 16)).cast("int"))
    split = F.col("p") > 1e-9
    whole = items.where(~split).select(*ITEM, F.lit(0).alias("take"))
    rest = items.where(split)
    groups = settled(rest.groupBy("source", "class").agg(F.ceil(F.count("*") / F.lit(fan)).alias("groups")))
    deepest = groups.agg(F.max("groups")).first()[0] or 0
    g = groups.select(F.col("source").alias("gs"), F.col("class").alias("gc"), "groups")
    rest = rest.join(g, F.col("source").eqNullSafe(F.col("gs")) & (F.col("class") == F.col("gc"))).drop("gs", "gc")
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.col("groups")))

    done = []
    keys = ["source", "class", "salt"]
    levels = 1
    while fan**levels < deepest:
        levels += 1
    for level in range(levels + 2):
        step = settled(_rounded(rest, keys, seed + level))
        done.append(step.select(F.explode("done").alias("x")))
        rest = step.select(*keys, *(F.col(f"left.{c}").alias(c) for c in (*ITEM, "p") if c != "source"))
        if level < levels:
            rest = rest.withColumn("salt", F.floor(F.col("salt") / fan))
        else:
            keys = ["source"]
    last = F.when(_uniform(F.col("doc_id"), F.col("key"), seed=seed) < F.col("p"), 1).otherwise(0)
    decided = rest.select(*ITEM, last.alias("take"))
    for d in done:
        decided = decided.union(d.select(*(F.col(f"x.{c}").alias(c) for c in decided.columns)))
    return decided.union(whole).select("doc_id", "key", "source", "size", "m", "base", (F.col("whole") + F.col("take")).alias("more"), "source_size", "target")


def repeated(rows: DataFrame, times: Column) -> DataFrame:
    """Each of `rows` so many times. Large numbers are cut into blocks that are dealt over tasks."""
    t = rows.withColumn("__left", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(times / BLOCK) - 1, F.lit(0))))).withColumn("__times", times)
    own = F.least(F.col("__times") - F.col("__left") * BLOCK, F.lit(BLOCK)).cast("int")
    few, many = (t.where(c).withColumn("__left", own) for c in (F.col("__times") <= BLOCK, F.col("__times") > BLOCK))
    each = F.explode(F.when(F.col("__left") > 0, F.sequence(F.lit(1), F.col("__left"))).otherwise(F.array().cast("array<int>")))
    return few.union(many.hint("rebalance")).withColumn("__left", each).drop("__left", "__times")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 7, fan: int = 256) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken. See decisions().

    Null texts have no words and take none. Null sources are a source, the last in order. Of repeated rows (same id, source
    and text) some may be taken once more than the others. An empty table gives none.
    """
    out = decisions(docs, weights, share, limit, seed, fan)
    lots = F.array(F.struct(F.col("base").alias("copies"), (F.col("m") - F.col("more")).alias("n")), F.struct((F.col("base") + 1).alias("copies"), F.col("more").alias("n")))
    out = out.withColumn("lot", F.explode(lots)).where("lot.n > 0")
    return repeated(out, F.col("lot.n")).select("doc_id", "source", "size", "source_size", "target", "lot.copies", (F.col("lot.copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """`docs` with every row as often as mix() takes it; all columns stay as they are.

    Rows of one id, source and text are one group of decisions(). Where only some of a group's rows go once more, its first
    row, by a hash of all columns, stands for them.
    """
    own, at, of, key, plan_ = unused(docs, "own", "id", "source", "key", "plan")
    rows = docs.withColumn(own, text_key(F.col("text")))
    plan = settled(decisions(docs, **parameters))
    plan = plan.select(F.col("key").alias(key), F.col("doc_id").alias(at), F.col("source").alias(of), F.struct("m", "base", "more").alias(plan_))
    same = (F.col(own) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(at)) & F.col("source").eqNullSafe(F.col(of))
    m, base, more = (F.col(f"{plan_}.{c}") for c in ("m", "base", "more"))
    copies = base + F.when(more == m, 1).otherwise(0)
    out = repeated(rows.join(plan.where(copies > 0), same), copies).select(*docs.columns)
    partly = plan.where((more > 0) & (more < m))
    if not partly.isEmpty():
        one = rows.join(partly, same).groupBy(own, at, of).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"), F.first(more).alias("more"))
        out = out.union(repeated(one, F.col("more")).select("row.*"))
    return out
