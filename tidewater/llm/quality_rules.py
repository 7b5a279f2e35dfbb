"""Quality rules whose cut-offs are chosen with a bound on the share of good documents that they reject.

Every rule is a statistic of a text with a grid of possible cut-offs. Labelled texts, each counted once, are split by hash. One part
only orders the cut-offs: a step of a rule has the level of the share of good texts at or beyond it, if it rejects bad ones several
times as often. The other part, the holdout, tests all rules together, per stratum (length class): from the mildest level on, the
number of good texts that any rule would reject gives an exact (Clopper-Pearson) upper bound of the false rejection rate; the first
level whose bound is above ``ALPHA`` ends the sequence. Of the levels before it the mildest that rejects as many bad texts is taken. Such a fixed sequence needs no correction for
its length; the risk ``DELTA`` is divided by the number of strata (Bonferroni). So with probability 1 - DELTA no stratum loses more
than ALPHA of its good documents. Neighbouring strata with too few good labels for any level to pass are pooled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, pieces, temporary, written

_words = re.compile(WORD).findall
SYMBOLS = "#*$%&|<>"
#: Steps of each rule's grid; a statistic is stored as a step, 0 the mildest.
STEPS = 64
#: (name, value of the statistic at step 0, at the last step); values beyond the last step count as it.
RULES = (("repeat_share", 0.0, 0.5), ("dup_line_share", 0.0, 1.0), ("symbol_share", 0.0, 0.5), ("bang_share", 0.0, 1.0), ("upper_share", 0.0, 1.0), ("long_words", 6.0, 20.0), ("short_words", 0.0, 5.0), ("adjacent_share", 0.0, 0.5))
STRATA = (100, 250, 600, 1500)
#: Highest false rejection rate of all rules together in each stratum, and the risk that the bound fails anywhere.
ALPHA, DELTA = 0.02, 0.05
#: Levels of cut-offs, the last at twice ALPHA on the ordering part; how many times as often a step must reject bad texts as good ones.
LEVELS, GAIN = 64, 4


def base_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line and _words(line):
            seen.add(line)
    repeat, n = 0, len(words)
    if n > 3:
        counts = Counter(zip(words, words[1:], words[2:]))
        if len(counts) < n - 2:
            twice = {w for w, c in counts.items() if c > 1}
            end = 0
            for i, w in enumerate(zip(words, words[1:], words[2:])):
                if w in twice:
                    repeat += i + 3 - max(end, i)
                    end = i + 3
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat


def rule_steps(text: str, base: tuple[int, int, int, int, int]) -> list[int]:
    """Each rule's statistic as a step of its grid."""
    n, chars, symbols, dup, repeat = base
    if not n:
        return [STEPS] * len(RULES)
    words = _words(text)
    lines = text.count("\n") + 1
    bang = sum(w.endswith("!!") for w in words)
    upper = sum(map(str.isupper, words))
    adjacent = sum(map(str.__eq__, words, words[1:]))
    mean = chars / n
    values = (repeat / n, dup / lines, symbols / max(1, chars), bang / n, upper / n, mean, 5.0 - mean, adjacent / n)
    return [max(0, min(STEPS, math.ceil((v - low) / (high - low) * STEPS - 1e-9))) for v, (_, low, high) in zip(values, RULES)]


def stratum(n_words: int) -> int:
    return int(np.searchsorted(STRATA, n_words, "right"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did, a hash of the text, the base counts, ``stratum`` and ``steps`` (array<int>) of every row; null texts are empty."""

    def run(batches):
        for batch in pieces(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            base = [base_stats(t or "") for t in texts]
            steps = [rule_steps(t or "", b) for t, b in zip(texts, base)]
            cols = [pa.array([b[i] for b in base], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), *cols, pa.array([stratum(b[0]) for b in base], pa.int32()), pa.array(steps, pa.list_(pa.int32()))], ["did", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stratum", "steps"])

    rows = docs.select(F.col(id_col).cast("long").alias("did"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    return rows.mapInArrow(run, "did long, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, stratum int, steps array<int>")


def failed_base(df: DataFrame) -> DataFrame:
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_below(k: int, n: int, p: float) -> float:
    """The chance of k or fewer of n at rate p. Terms are added from the largest down until they no longer count, so some
    multiples of the standard deviation, not k terms, are summed."""
    top = min(k, int((n + 1) * p))
    log = math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)
    first = math.exp(log)
    if first == 0.0:
        return 0.0
    odds, total, term = p / (1 - p), first, first
    for i in range(top + 1, k + 1):
        term *= (n - i + 1) / i * odds
        total += term
        if term < total * 1e-18:
            break
    term = first
    for i in range(top, 0, -1):
        term *= i / (n - i + 1) / odds
        total += term
        if term < total * 1e-18:
            break
    return min(1.0, total)


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper bound of a rate after k of n, by bisection of the binomial distribution function."""
    if k >= n:
        return 1.0
    below = lambda p: binomial_below(k, n, p)
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid > 0 and below(mid) > level else (low, mid) if mid > 0 else (mid, high)
    return high


def pools(good: dict[int, int], alpha: float = ALPHA, delta: float = DELTA) -> dict[int, int]:
    """stratum -> the first stratum of its pool: neighbours are joined until each pool has good holdout texts enough for a level to pass."""
    strata = sorted(good)
    groups: list[list[int]] = [[s] for s in strata]

    def enough(g: list[int]) -> bool:
        n = sum(good[s] for s in g)
        return n > 0 and binomial_below(0, n, alpha) <= delta / len(groups)

    while len(groups) > 1 and (short := [i for i, g in enumerate(groups) if not enough(g)]):
        i = min(short, key=lambda j: (sum(good[s] for s in groups[j]), j))
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(groups)]
        j = min(near, key=lambda j: (sum(good[s] for s in groups[j]), j))
        groups[min(i, j)] = groups[min(i, j)] + groups[max(i, j)]
        del groups[max(i, j)]
    return {s: g[0] for g in groups for s in g}


def levels(counts: list[tuple[int, int, int, int, int]], alpha: float = ALPHA) -> dict[tuple[int, int], list[int]]:
    """(pool, rule) -> the level of each step from ``counts`` (pool, rule, step, good, bad) of the ordering part; LEVELS + 1 is never.

    A step's level says at which share of good texts at or beyond it it is let in: 0 at none, LEVELS at 2 * alpha.
    """
    sums: dict[tuple[int, int], np.ndarray] = {}
    for p, r, step, g, b in counts:
        sums.setdefault((p, r), np.zeros((2, STEPS + 1), np.int64))[:, step] += (g, b)
    out = {}
    for key, x in sums.items():
        good, bad = (v[::-1].cumsum()[::-1] for v in x)
        share = good / max(1, good[0])
        level = np.ceil(share / (2 * alpha) * LEVELS - 1e-9).astype(int)
        helps = (bad * (good[0] + 1) >= GAIN * (good + 1) * max(1, bad[0])) & (np.arange(STEPS + 1) > 0)  # one good text more, for chance
        out[key] = np.where(helps & (level <= LEVELS), level, LEVELS + 1).tolist()
    return out


def passed(good: np.ndarray, alpha: float, risk: float) -> int:
    """The last level of the sequence that passes, -1 if none does. ``good``: holdout texts by level, the last those that no level rejects."""
    n, best = int(good.sum()), -1
    for level, k in enumerate(np.cumsum(good[:-1]).tolist()):
        if not n or k > alpha * n or binomial_below(k, n, alpha) > risk:  # that is, the upper bound is above alpha
            break
        best = level
    return best


def fit(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[int, int], int]:
    """(stratum, rule) -> step; documents at that step or beyond are rejected. From all labelled texts but those that fail the base.

    ``labels`` has doc_id and quality (1: good, 0: bad; others and nulls are left out). Texts that repeat with one label are one trial.
    The driver gets counts alone: at most 5 x 8 x 65 of the ordering part and 5 x 66 of the holdout. No labels give no cut-offs.
    """
    known = labels.filter("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("did"), "quality").distinct()
    rows = failed_base(stats).filter("not base_failed").join(known, "did").groupBy("th", "quality").agg(F.first(F.struct("stratum", "steps")).alias("x")).select("th", "quality", "x.*")
    rows = written(rows.withColumn("orders", F.pmod(F.xxhash64(F.lit(23), "th"), F.lit(3)) == 0), "labelled-texts")
    sizes = {r["stratum"]: r["n"] for r in rows.groupBy("stratum").agg(F.count_if(~F.col("orders") & (F.col("quality") == 1)).alias("n")).collect()}
    pool = pools(sizes, alpha, delta)
    found = rows.filter("orders").select("stratum", "quality", F.posexplode("steps").alias("rule", "step")).groupBy("stratum", "rule", "step").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).collect()
    table = levels([(pool[r["stratum"]], r["rule"], r["step"], r["good"], r["bad"]) for r in found], alpha)
    flat = [(s, r, step, level) for s, p in pool.items() for r in range(len(RULES)) for step, level in enumerate(table.get((p, r), [])) if level <= LEVELS]
    if not flat:
        return {}
    which = rows.sparkSession.createDataFrame([(s, p) for s, p in pool.items()], "stratum int, pool int")
    at = F.broadcast(rows.sparkSession.createDataFrame(flat, "stratum int, rule int, step int, level int"))  # at most 5 x 8 x 65 rows
    # good texts of the holdout tell how far a level may go, bad ones of the other part from where on it is of no more use
    each = rows.filter("orders = (quality = 0)").select("th", "quality", "stratum", F.posexplode("steps").alias("rule", "step")).join(at, ["stratum", "rule", "step"], "left")
    each = each.groupBy("th", "quality", "stratum").agg(F.coalesce(F.min("level"), F.lit(LEVELS + 1)).alias("level")).join(F.broadcast(which), "stratum")
    tests = {p: np.zeros((2, LEVELS + 2), np.int64) for p in set(pool.values())}
    for r in each.groupBy("pool", "quality", "level").agg(F.count(F.lit(1)).alias("n")).collect():
        tests[r["pool"]][r["quality"], r["level"]] += r["n"]
    best = {}
    for p, (bad, good) in tests.items():
        last = passed(good, alpha, delta / len(tests))
        best[p] = int(np.searchsorted(bad.cumsum(), bad[: last + 1].sum())) if last >= 0 else -1
    out: dict[tuple[int, int], int] = {}
    for s, r, step, level in flat:
        if level <= best[pool[s]]:
            out[s, r] = min(step, out.get((s, r), STEPS))
    return out


def judge(stats: DataFrame, cuts: dict[tuple[int, int], int]) -> DataFrame:
    """``stats`` with base_failed and kept."""
    hit = F.lit(False)
    for (s, r), cut in sorted(cuts.items()):
        hit = hit | ((F.col("stratum") == s) & (F.col("steps")[r] >= cut))
    return failed_base(stats).withColumn("kept", ~F.col("base_failed") & ~hit)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed and kept of every row of ``docs``.

    Null and empty texts have no words and fail the base. Rows with a null id are judged by the same cut-offs but teach nothing.
    Without labels no cut-off can be shown to be safe, so the base rules alone decide. An empty table gives an empty result.
    """
    stats = written(statistics(docs, id_col, text_col), "quality-statistics")
    with temporary():
        cuts = fit(stats, labels)
    return judge(stats, cuts)


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, as they were; rows do not move. Null and empty texts go, repeated rows stay or go together."""
    with temporary():
        cuts = fit(statistics(docs, id_col, text_col), labels)
    place = docs.columns.index(text_col)

    def good(text: str | None) -> bool:
        base = base_stats(text or "")
        if base[0] < 50 or 100 * base[4] > 50 * base[0]:
            return False
        s = stratum(base[0])
        return not any(step >= cuts.get((s, r), STEPS + 1) for r, step in enumerate(rule_steps(text or "", base)))

    def run(batches):
        for batch in pieces(batches, column=text_col):
            yield batch.filter(pa.array([good(t) for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
