"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size within each source. A source's target is met by whole passes over all its documents
and a remaining budget; the budget is filled with the same share of every size and then, for what is left of it, by
bounded-knapsack dynamic programming over the sizes and the documents not yet used. Which documents of a size are taken
is settled by a seeded hash: ranks are counted per hash range first, and only the range in which the count runs out is
ranked row by row, so that a size that a third of all rows have isn't sorted in one task.

Targets: sources in code point order, null last, have weights 3, 1, 2, repeating, and share ``ratio`` of all sizes; a
target stops at ``most`` times its source's size and the excess goes to the others by weight until none is above.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source, the last; rows with
equal doc_id are rows of their own; equal hashes are ordered by doc_id; an empty table gives an empty result; ``mix``
keeps the other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, ship, whole_rows

#: Fixed values.
WEIGHTS = (3, 1, 2)
SEED = 20240607


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """``place`` of each distinct source, from 0, in code point order with null last: ranges are counted, then ranked within."""
    dealt = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_base", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # one row for each range
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("_rank", rank).join(before, "_part").withColumn("place", F.col("_base") + F.col("_rank") - 1).drop("_part", "_n", "_base", "_rank")


def targets(sources: DataFrame, ratio: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with ``target``; only sums reach the driver."""
    weighed = numbered(sources).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))).withColumn("top", F.col("source_size") * float(most))
    weighed = cut(weighed, "weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, F.lit(False)
    while True:
        left = weighed.agg(F.sum(F.when(full, F.col("top")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(F.when(full, 1).otherwise(0))).first()
        capped = left[2] or 0
        if level is not None and capped == before or not left[1]:
            break
        before, level = capped, (ratio * total - (left[0] or 0.0)) / left[1]
        full = F.col("weight") * level >= F.col("top")
    return weighed.select("source", "source_size", F.when(full, F.col("top")).otherwise(F.col("weight") * float(level or 0.0)).alias("target"))


def fill(sizes: np.ndarray, counts: np.ndarray, budget: int, width: int = 1 << 15) -> np.ndarray:
    """How many documents of each size to take so that the words come as near to ``budget``, from below, as can be found.

    sizes: distinct and positive. The same share of each size, then larger sizes while more than ``width`` words are left,
    then dynamic programming over what is left: the set of reachable sums is a bit string, kept before each size. The
    knapsack's own budget is at most four times ``width``, which bounds its memory whatever the budget.
    """
    have = int((sizes * counts).sum())
    if budget >= have:
        return counts.copy()
    take = np.floor(counts * (budget / have)).astype(np.int64)
    left = budget - int((sizes * take).sum())
    large = np.argsort(-sizes)
    for i in large:
        if left > width:
            more = max(0, min(int(counts[i] - take[i]), (left - width) // int(sizes[i])))
            take[i] += more
            left -= more * int(sizes[i])
    for i in large:  # some are given back, so that there is something to choose
        back = min(int(take[i]), 4)
        if left < width // 2 and left + back * int(sizes[i]) <= 4 * width:
            take[i] -= back
            left += back * int(sizes[i])
    cap = min(left, 4 * width)
    mask, reach, steps = (1 << cap + 1) - 1, 1, []
    for i in large[::-1]:
        size, free = int(sizes[i]), int(counts[i] - take[i])
        if size > cap or reach >> cap & 1:
            break
        steps.append((i, size, reach))
        free, part = min(free, cap // size), 1
        while free:  # parts of 1, 2, 4, ... make up every number of documents
            part = min(part, free)
            reach |= reach << part * size & mask
            free -= part
            part *= 2
    at = reach.bit_length() - 1
    for i, size, before in reversed(steps):
        while not before >> at & 1:
            at -= size
            take[i] += 1
    return take


def plan(counted: DataFrame) -> DataFrame:
    """(source, size, passes, extra): whole passes, and how many documents of that size are taken once more.

    counted: (source, size, n, source_size, target). One task solves one source; it reads a row for each distinct size.
    """

    def solve(t: pa.Table) -> pa.Table:
        sizes, n = t.column("size").to_numpy(), t.column("n").to_numpy()
        total, target = t.column("source_size")[0].as_py(), round(t.column("target")[0].as_py())
        passes, budget = divmod(target, total) if total else (0, 0)
        extra = np.zeros(len(sizes), np.int64)
        some = sizes > 0
        if budget:
            extra[some] = fill(sizes[some], n[some], int(budget))
        return pa.table({"source": t.column("source"), "size": t.column("size"), "passes": pa.array(np.full(len(sizes), passes, np.int64)), "extra": pa.array(extra)})

    return counted.groupBy("source").applyInArrow(solve, "source string, size long, passes long, extra long")


def choose(docs: DataFrame, ratio: float = 1.5, most: float = 2.0, seed: int = SEED, rows: int = 4096) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of ``docs`` (doc_id, source, text)."""
    ship(docs.sparkSession)
    sized = cut(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size")), "sizes")
    counted = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    wanted = cut(targets(counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), ratio, most), "targets")
    known = counted.alias("c").join(wanted.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "size", "n", "source_size", "target")
    known = cut(known, "known")
    planned = plan(known).alias("p")
    same = F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p.size") == F.col("k.size"))
    groups = known.alias("k").join(planned, same).select("k.source", "k.size", "source_size", "target", "passes", "extra", F.ceil(F.col("n") / rows).alias("ranges"))
    groups = cut(groups, "groups")

    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    same = F.col("s.source").eqNullSafe(F.col("g.source")) & (F.col("s.size") == F.col("g.size"))
    row = sized.withColumn("place", place).alias("s").join(groups.alias("g"), same)
    row = row.select("doc_id", "s.source", "s.size", "source_size", "target", "passes", "extra", "place", F.floor(F.col("place") * F.col("ranges") / float(1 << 30)).alias("range"))
    # documents before and within each hash range of a size; most sizes have one range
    per = row.groupBy("source", "size", "range").agg(F.count("*").alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.partitionBy("source", "size").orderBy("range")) - F.col("n"))
    same = F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.size") == F.col("b.size")) & (F.col("r.range") == F.col("b.range"))
    row = row.alias("r").join(per.alias("b"), same).select("doc_id", "r.source", "r.size", "source_size", "target", "passes", "extra", "place", "r.range", "before", "n")
    rank = F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("place", "doc_id"))
    sure = row.where("before + n <= extra or before >= extra").withColumn("copies", F.col("passes") + F.expr("if(before + n <= extra, 1, 0)"))
    torn = row.where("before < extra and before + n > extra").withColumn("copies", F.col("passes") + F.when(rank + F.col("before") <= F.col("extra"), 1).otherwise(0))
    every = sure.unionByName(torn)
    return every.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, ratio: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns."""
    chosen = choose(docs, ratio, most, seed).where("size > 0 and copies > 0")
    per = chosen.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"))
    keyed = docs.select(whole_rows(docs).alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    number = keyed.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).where("n > 1")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))
    taken = per.alias("p").join(number.alias("n"), same("p", "n"), "left").select("p.*", F.coalesce("n.n", F.lit(1)).alias("n"))
    out = keyed.alias("k").join(taken.alias("t"), same("k", "t")).select("k.*", "copies", "n")
    # rows that share doc_id, source and size share their copies, the first ones getting what is over
    one = out.where("n = 1")
    rest = [F.col("row")[c] for c in ("text", *[c for c in docs.columns if c not in ("doc_id", "source", "text")])]
    rank = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(*rest))
    several = out.where("n > 1").withColumn("copies", F.floor(F.col("copies") / F.col("n")) + F.when(rank <= F.col("copies") % F.col("n"), 1).otherwise(0)).where("copies > 0")
    return one.unionByName(several).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
