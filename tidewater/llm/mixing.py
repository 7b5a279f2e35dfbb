"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length). Per source, whole passes cover the target as far as they go; for the budget
that is left, a proportional number of documents of each length is taken, and what is then still missing is met by a
bounded-knapsack dynamic program over the lengths that remain and some documents given back to it. Documents are selected by a seeded hash order within (source,
length), so the plan needs counts alone and reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import NO_ID, WORD, numbered, ranked, repeated, written
from tidewater.operators.numbering import numbered as numbered_by

#: Words of taken documents that go back to the dynamic program, so that it can swap them; its bit sets have as many bits, and as many
#: more as the longest document that is open. All budgets end in the program.
ROOM = 1 << 17
WEIGHTS = (5.0, 2.0, 1.0)


def targets(totals: DataFrame, share: float, repeats: float, weights: tuple[float, ...]) -> DataFrame:
    """``totals`` (source, source_size) with target: a share of all words by weight, at most ``repeats`` times the source's size each.

    Weights repeat over the sources by code point, null last. The level at which words are shared rises as full sources leave their
    excess to the others; each round is one sum over the sources, till no further one is full.
    """
    rows = numbered_by(totals, [F.col("source").isNull(), F.col("source")], "__n")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__n") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = written(rows.select("source", "source_size", weight.alias("weight")), "mix-sources")
    full = float(repeats) * F.col("source_size")
    level, before, total = 0.0, -1, None
    while True:
        over = F.lit(level) * F.col("weight") > full
        r = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(over, full)), F.lit(0.0)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("n")).first()
        total = share * r["all"] if total is None else total
        if r["n"] == before or not r["open"]:
            break
        level, before = (total - r["full"]) / r["open"], r["n"]
    return rows.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), full).cast("double").alias("target"))


def _nearest_sum(lengths: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """How many of the spare documents of each length make the largest sum of words up to the budget: bounded knapsack on bit sets.

    Counts go in pieces of 1, 2, 4 ... documents. For each sum the piece that first reached it is kept, which leads back to nothing.
    """
    take = np.zeros(len(lengths), np.int64)
    pieces = []
    for i in np.argsort(lengths, kind="stable"):
        n, step = min(int(spare[i]), budget // int(lengths[i])) if lengths[i] else 0, 1
        while n > 0:
            step = min(step, n)
            pieces.append((step * int(lengths[i]), int(i), step))
            n, step = n - step, 2 * step
    whole, reach = (1 << (budget + 1)) - 1, 1
    first = np.full(budget + 8, -1, np.int32)
    for k, (words, _, _) in enumerate(pieces):
        if new := (reach << words) & whole & ~reach:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
            first[np.flatnonzero(bits)] = k
            reach |= new
            if reach >> budget & 1:
                break
    at = reach.bit_length() - 1
    while at:
        words, i, n = pieces[first[at]]
        take[i] += n
        at -= words
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as they can without passing it.

    From the longest on, each length gets its proportional number, what it misses being carried to the next. What is open at the end, and
    the words of some documents that go back, are met by the dynamic program: first two documents of each length go back, then, if a
    gap is left, as many of the shortest as ROOM holds.
    """
    total = int((lengths * counts).sum())
    budget = max(0, min(int(budget), total))
    if budget in (0, total):
        return counts.astype(np.int64) * (budget == total and total > 0)
    base, carry = np.zeros(len(lengths), np.int64), 0.0
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i]:
            want = counts[i] * (budget / total) * lengths[i] + carry
            base[i] = min(counts[i], int(want // lengths[i]), (budget - int((base * lengths).sum())) // int(lengths[i]))
            carry = want - base[i] * lengths[i]
    best = None
    for most in (2, None):
        take, spare = base.copy(), counts - base
        open_ = budget - int((take * lengths).sum())
        for i in np.argsort(lengths, kind="stable"):
            back = min(int(take[i]), max(0, ROOM - open_) // int(lengths[i])) if lengths[i] else 0
            back = back if most is None else min(back, most)
            take[i], spare[i], open_ = take[i] - back, spare[i] + back, open_ + back * int(lengths[i])
        take = take + _nearest_sum(lengths, spare, open_)
        if best is None or int((take * lengths).sum()) > int((best * lengths).sum()):
            best = take
        if int((best * lengths).sum()) == budget:
            break
    return best


def plan(counts: pd.DataFrame) -> pd.DataFrame:
    """One source's (size, n, target, source_size) to (size, passes, extra): whole passes, and documents with one pass more."""
    counts = counts.sort_values("size", kind="stable").reset_index(drop=True)
    total, target = int(counts["source_size"].iloc[0]), float(counts["target"].iloc[0])
    passes = min(int(target // total), 2) if total else 0
    extra = fit_budget(counts["size"].to_numpy(np.int64), counts["n"].to_numpy(np.int64), round(target - passes * total)) if total else np.zeros(len(counts), np.int64)
    return pd.DataFrame({"source": counts["source"], "size": counts["size"], "passes": passes, "extra": extra})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, repeats: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """(did, th, source, size, source_size, target, taken, copies), one row for each row of ``docs``.

    Weights go to the sources by code point, null last, repeating. Null and empty texts have size 0 and are taken with the whole
    passes only, at no words. Repeated rows count as rows of their own, in any order. An empty table gives an empty result.
    The plan is made per source from counts by length; sources too are counted and numbered by Spark.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    base = docs.select(F.col(id_col).cast("long").alias("did"), F.xxhash64(F.lit(7), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("size", size).drop("text").withColumn("__h", F.xxhash64(F.lit(seed), "did", "th")).withColumn("__part", F.shiftright("__h", 54).cast("int"))
    base = written(base, "mix-sizes")
    counts = base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    goal = written(targets(totals, share, repeats, weights).withColumnRenamed("source", "gs"), "mix-targets")
    planned = counts.join(goal, F.col("source").eqNullSafe(F.col("gs"))).drop("gs").groupBy("source").applyInPandas(plan, "source string, size long, passes int, extra long")
    planned = planned.select(F.col("source").alias("ps"), F.col("size").alias("psize"), "passes", "extra")
    placed = ranked(base, ["source", "size"], ["__h"], "__part", "__rank")
    placed = placed.join(planned, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("psize"))).drop("ps", "psize")
    placed = placed.join(goal, F.col("source").eqNullSafe(F.col("gs")))
    copies = (F.col("passes") + (F.col("__rank") <= F.col("extra")).cast("int")).cast("int")
    return placed.withColumn("copies", copies).select("did", "th", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken; columns as they were.

    Of rows that repeat id and text, as many are taken as the mix takes. Null and empty texts stay only with whole passes.
    """
    dk = F.coalesce("did", F.lit(NO_ID))
    # how many of the rows that repeat are taken how often: a few counts for each id and text, and the numbers that they cover
    took = mix(docs, **how).filter("copies > 0").groupBy("th", dk.alias("dk"), "copies").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("th", "dk").orderBy(F.desc("copies")))
    took = took.select("th", "dk", "copies", upto.alias("last"), (upto - F.col("n")).alias("first"))
    own = numbered(docs, how.get("id_col", "doc_id"), how.get("text_col", "text"))
    both = own.join(took, ["th", "dk"])
    return repeated(both, (F.least("last", F.col("before") + F.col("n")) - F.greatest("first", "before")) * F.col("copies"))
