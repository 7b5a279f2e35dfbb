"""Folds, concept ranking, feature construction and selection. Rows stay long; a pivot comes last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.normalise import canonical_float
from tidewater.operators.audit import checked, sole
from tidewater.operators.numbering import numbered, place_within, running
from tidewater.sources.shared import frozen


def patient_folds(cohort: DataFrame, k: int, seed: int) -> DataFrame:
    """(patient_id, fold): patients in hash order, cut into k runs whose sizes differ by one at most."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("patient_id").cast("string")), 256)
    p = cohort.select("patient_id").distinct().withColumn("__h", order)
    ranked = numbered(p, [F.col("__h"), F.col("patient_id")], "__r")
    total = p.agg(F.count(F.lit(1)).alias("__n"))
    return ranked.crossJoin(F.broadcast(total)).select("patient_id", (F.floor((F.col("__r") - 1) * k / F.col("__n")) + 1).cast("long").alias("fold"))


def stratified_folds(cohort: DataFrame, k: int, seed: int) -> DataFrame:
    """(patient_id, fold): within patients of as many visits and outcomes, in turn by hash order."""
    p = cohort.groupBy("patient_id").agg(F.count(F.lit(1)).alias("v"), F.sum("outcome").alias("o"))
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("patient_id").cast("string")), 256)
    p = p.select("patient_id", F.least("v", F.lit(5)).alias("v"), F.least("o", F.lit(2)).alias("o"), order.alias("__h"))
    part = F.conv(F.substring("__h", 1, 4), 16, 10).cast("int")  # strata are few, so each is placed in pieces of the hash's range
    return place_within(p, ["v", "o"], part, ["__h", "patient_id"], "__r").select("patient_id", ((F.col("__r") - 1) % k + 1).cast("long").alias("fold"))


def training_counts(df: DataFrame, keys: list[str], count: str = "visits") -> DataFrame:
    """(fold, keys, count): distinct visits outside each fold, from counts per fold and one subtraction; no row is copied."""
    per = frozen(df.select(*keys, "fold", "visit_id").distinct().groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("own")), "counts")
    total = per.groupBy(*keys).agg(F.sum("own").alias("all"))
    folds = per.select("fold").distinct()
    full = total.crossJoin(F.broadcast(folds)).join(per, [*keys, "fold"], "left")
    return full.select("fold", *keys, (F.col("all") - F.coalesce("own", F.lit(0))).alias(count)).filter(F.col(count) > 0)


def top_per(df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long")).filter(F.col(rank) <= n)


def modal_units(df: DataFrame) -> DataFrame:
    """(fold, concept_key, unit): the commonest unit among rows outside each fold; ties go to the lesser."""
    per = frozen(df.groupBy("concept_key", "unit", "fold").agg(F.count(F.lit(1)).alias("own")), "counts")
    total = per.groupBy("concept_key", "unit").agg(F.sum("own").alias("all"))
    full = total.crossJoin(F.broadcast(per.select("fold").distinct())).join(per, ["concept_key", "unit", "fold"], "left")
    left = full.select("fold", "concept_key", "unit", (F.col("all") - F.coalesce("own", F.lit(0))).alias("n")).filter("n > 0")
    return top_per(left, ["fold", "concept_key"], [F.desc("n"), F.col("unit")], 1).drop("rank", "n")


def measurements(events: DataFrame, cohort: DataFrame, concepts: list[str]) -> DataFrame:
    """Wide mean, max, min, sd, count and missing of each concept for every row of the cohort."""
    per = events.filter(F.col("concept_key").isin(concepts)).groupBy("visit_id", "concept_key").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.count("value").alias("count"))
    wide = per.groupBy("visit_id").pivot("concept_key", concepts).agg(*[F.first(s).alias(s) for s in ("mean", "max", "min", "sd", "count")])
    df = cohort.select("visit_id").join(wide, "visit_id", "left")
    for c in concepts:
        for s in ("mean", "max", "min", "sd"):
            df = df.withColumn(f"{c}_{s}", canonical_float(F.col(f"{c}_{s}")))
        df = df.withColumn(f"{c}_count", F.coalesce(f"{c}_count", F.lit(0))).withColumn(f"{c}_missing", (F.col(f"{c}_count") == 0).cast("int"))
    return df


def exposures(events: DataFrame, cohort: DataFrame, concepts: list[str]) -> DataFrame:
    """Wide exposure (0/1) and count of each concept for every row of the cohort."""
    wide = events.filter(F.col("concept_key").isin(concepts)).groupBy("visit_id").pivot("concept_key", concepts).count()
    df = cohort.select("visit_id").join(wide, "visit_id", "left")
    return df.select("visit_id", *[x for c in concepts for x in (F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"{c}_count"), (F.coalesce(F.col(f"`{c}`"), F.lit(0)) > 0).cast("int").alias(f"{c}_exposure"))])


def top_cells(events: DataFrame, cohort: DataFrame, top: DataFrame, aggs: list[Column]) -> DataFrame:
    """(columns of ``top``, visit_id, aggs): every visit of the cohort with each concept of ``top`` (fold, concept_key, rank); nulls where it has no event of it.

    A visit's cells meet it as one map, and ``top`` is broadcast: rows of the result are made where the visit is and never shuffled.
    """
    per = events.join(F.broadcast(top.select("concept_key").distinct()), "concept_key", "left_semi").groupBy("visit_id", "concept_key").agg(*aggs)
    names = [c for c in per.columns if c not in ("visit_id", "concept_key")]
    cells = per.groupBy("visit_id").agg(F.map_from_entries(F.collect_list(F.struct("concept_key", F.struct(*names)))).alias("__cells"))
    rows = cohort.select("visit_id").join(cells, "visit_id", "left").crossJoin(F.broadcast(top))
    return rows.withColumn("__cell", F.try_element_at("__cells", "concept_key")).select(*top.columns, "visit_id", *[F.col(f"__cell.{c}").alias(c) for c in names])


#: Statistics of a concept in construction order, with the value of a visit that has no event of it.
STATISTICS = {"measurements": {"mean": None, "max": None, "min": None, "sd": None, "count": 0.0, "missing": 1.0}, "medications": {"count": 0.0, "exposure": 0.0}, "procedures": {"count": 0.0, "exposure": 0.0}}
#: Aggregates over all concepts of a domain, likewise.
AGGREGATES = {"measurements": {}, "medications": {"any": 0.0, "unique": 0.0, "repeat": 0.0, "first_hours": None}, "procedures": {"any": 0.0, "unique": 0.0, "total": 0.0}}


def domain_cells(events: DataFrame, domain: str) -> DataFrame:
    """(visit_id, fold, concept_key, feature, place, value) of what visits with events of a domain have; the concept of aggregates is empty.

    ``place`` is a statistic's place within its concept; aggregates follow all concepts.
    """
    per = events.groupBy("visit_id", "fold", "concept_key").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.count("value" if domain == "measurements" else F.lit(1)).alias("count"), F.count(F.lit(1)).alias("n"), F.min("hours_from_start").alias("first_hours"))
    per = per.withColumn("missing", (F.col("count") == 0).cast("int")).withColumn("exposure", F.lit(1))
    stats = F.explode(F.array(*[F.struct(F.concat("concept_key", F.lit(f"__{s}")).alias("feature"), F.lit(i).alias("place"), canonical_float(F.col(s).cast("double")).alias("value")) for i, s in enumerate(STATISTICS[domain])]))
    cells = per.select("visit_id", "fold", "concept_key", stats.alias("x")).select("visit_id", "fold", "concept_key", "x.*")
    if AGGREGATES[domain]:
        visit = per.groupBy("visit_id", "fold").agg(F.lit(1).alias("any"), F.count(F.lit(1)).alias("unique"), F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("repeat"), F.min("first_hours").alias("first_hours"))
        whole = F.explode(F.array(*[F.struct(F.lit(f"{domain}__{s}").alias("feature"), F.lit(i).alias("place"), F.col(s).cast("double").alias("value")) for i, s in enumerate(AGGREGATES[domain])]))
        cells = cells.unionByName(visit.select("visit_id", "fold", F.lit("").alias("concept_key"), whole.alias("x")).select("visit_id", "fold", "concept_key", "x.*"))
    return cells


def selected_features(cells: DataFrame, top: DataFrame, keep: int) -> DataFrame:
    """(fold, feature, support, rank): the features of most training support among those of a fold's top concepts (fold, concept_key, rank) and the aggregates.

    Ties go by construction order: concepts by rank, statistics by place, then aggregates.
    """
    said = F.when(F.col("feature").endswith("__missing"), F.col("value") == 0).when(F.col("feature").rlike("__(mean|max|min|sd|first_hours)$"), F.col("value").isNotNull()).otherwise(F.col("value") > 0)
    support = training_counts(cells.filter(said), ["concept_key", "feature", "place"], "support")
    ranked = support.join(top.select("fold", "concept_key", F.col("rank").alias("of")), ["fold", "concept_key"], "left").filter("of is not null or concept_key = ''")
    return top_per(ranked, ["fold"], [F.desc("support"), F.col("of").asc_nulls_last(), F.col("place"), F.col("feature")], keep).select("fold", "feature", "support", "rank")


def visit_aggregates(events: DataFrame, cohort: DataFrame) -> DataFrame:
    """any, unique, total, repeat and first_hours over all concepts, for every row of the cohort."""
    per = events.groupBy("visit_id").agg(F.count_distinct("concept_key").alias("u"), F.count(F.lit(1)).alias("t"), F.min("hours_from_start").alias("first_hours"))
    df = cohort.select("visit_id").join(per, "visit_id", "left")
    zero = F.lit(0)
    return df.select("visit_id", F.col("t").isNotNull().cast("int").alias("any_event"), F.coalesce("u", zero).alias("unique_concepts"), F.coalesce("t", zero).alias("total_events"), F.coalesce(F.col("t") - F.col("u"), zero).alias("repeat_events"), "first_hours")


def support(long: DataFrame) -> DataFrame:
    """(fold, feature, support, total): training rows outside each fold of which the feature says something."""
    said = F.when(F.col("feature").endswith("missing"), F.col("value") == 0).when(F.col("feature").endswith("count") | F.col("feature").endswith("exposure"), F.col("value") > 0).otherwise(F.col("value").isNotNull())
    per = long.groupBy("feature", "fold").agg(F.count_if(said).alias("s"), F.count(F.lit(1)).alias("n"))
    total = per.groupBy("feature").agg(F.sum("s").alias("ss"), F.sum("n").alias("nn"))
    return per.join(total, "feature").select("fold", "feature", (F.col("ss") - F.col("s")).alias("support"), (F.col("nn") - F.col("n")).alias("total"))


def eligibility(long: DataFrame, least: int) -> DataFrame:
    """(feature, reason): no_values, zero_variance, low_support or eligible."""
    per = long.groupBy("feature").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("value") > 0).alias("pos"))
    reason = F.when(F.col("n") == 0, "no_values").when(F.col("lo") == F.col("hi"), "zero_variance").when(F.col("pos") < least, "low_support").otherwise("eligible")
    return per.select("feature", reason.alias("reason"))


def mutual_information(long: DataFrame) -> DataFrame:
    """(feature, mi) of discrete values and the 0/1 outcome, in nats, from one contingency table.

    A value's outcomes meet in one row; a feature's values are never in one task: its totals are sums, sent to its rows as two small tables.
    """
    pairs = long.groupBy("feature", "value").agg(F.count_if(F.col("outcome") == 1).alias("n1"), F.count_if(F.col("outcome") == 0).alias("n0"))
    both = pairs.groupBy("feature").agg(F.sum("n1").alias("b1"), F.sum("n0").alias("b0"))  # as many rows as features
    cell = pairs.join(F.broadcast(both), "feature").select("feature", (F.col("n1") + F.col("n0")).alias("a"), (F.col("b1") + F.col("b0")).alias("t"), F.explode(F.array(F.struct(F.col("n1").alias("n"), F.col("b1").alias("b")), F.struct(F.col("n0").alias("n"), F.col("b0").alias("b")))).alias("x"))
    p = cell.select("feature", "a", "t", "x.*").filter("n > 0")
    return p.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))


def _by_value(long: DataFrame, *more: str) -> tuple[DataFrame, list]:
    """Counts n of (feature, value, more), with one column f<fold> for each fold's own, and the folds. They are written once."""
    cells = frozen(long.groupBy("feature", "value", *more, "fold").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    folds = sorted(r["fold"] for r in cells.select("fold").distinct().collect())  # as many as the configuration has
    own = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("n"))), F.lit(0)).alias(f"f{f}") for f in folds]
    return cells.groupBy("feature", "value", *more).agg(F.sum("n").alias("n"), *own), folds


def training_medians(cells: DataFrame, folds: list) -> DataFrame:
    """(fold, feature, med): the exact median of each feature's values outside each fold, from counts by value; no row is copied."""
    known = cells.filter("value is not null").groupBy("feature", "value").agg(*[F.sum(c).alias(c) for c in ("n", *[f"f{f}" for f in folds])])
    c = running(known, ["feature"], "value", ["n", *[f"f{f}" for f in folds]])
    picks = []
    for f in folds:
        size, upto = F.col("all_n") - F.col(f"all_f{f}"), F.col("to_n") - F.col(f"to_f{f}")
        held = F.col("n") > F.col(f"f{f}")
        at = [F.min(F.when(held & (upto >= rank), F.col("value"))) for rank in (F.floor((size + 1) / 2), F.floor(size / 2) + 1)]
        picks.append(F.struct(F.lit(f).alias("fold"), at[0].alias("low"), at[1].alias("high")).alias(f"p{f}"))
    one = c.groupBy("feature").agg(*picks).select("feature", F.explode(F.array(*[f"p{f}" for f in folds])).alias("x"))
    return one.select("x.fold", "feature", (F.col("x.low") + (F.col("x.high") - F.col("x.low")) * 0.5).alias("med"))


def median_impute(long: DataFrame) -> DataFrame:
    """``long`` with nulls replaced by the exact median of the feature's rows outside the row's fold."""
    med = training_medians(*_by_value(long)).withColumn("fold", F.col("fold").cast(long.schema["fold"].dataType))
    return long.join(F.broadcast(med), ["fold", "feature"], "left").withColumn("value", F.coalesce("value", "med")).drop("med")


def information_ranking(long: DataFrame, keep: int = 21, bins: int = 10) -> DataFrame:
    """(fold, feature, mi, rank): for each fold the ``keep`` features of most mutual information with the outcome outside it, in nats.

    ``long`` is (fold, feature, value, outcome); nulls count as the fold's training median. Features named as flags or counts are
    discrete, others are cut at the training deciles of their fold. Rows are counted by value once; folds are taken off the counts.
    Ties go by name.
    """
    cells, names = _by_value(long, "outcome")
    med = training_medians(cells, names).select(F.col("fold").alias("of"), "feature", "med")
    outside = F.explode(F.array(*[F.struct(F.lit(f).alias("of"), (F.col("n") - F.col(f"f{f}")).alias("n")) for f in names])).alias("x")
    train = cells.select("feature", "value", "outcome", outside).select("x.of", "feature", "value", "outcome", "x.n").filter("n > 0")
    train = train.join(F.broadcast(med), ["of", "feature"], "left").groupBy("of", "feature", F.coalesce("value", "med").alias("value"), "outcome").agg(F.sum("n").alias("n"))
    train = frozen(train, "training-counts")
    discrete = F.col("feature").rlike("(__missing|__count|__exposure|__any|__unique|__repeat|__total)$")
    smooth = train.filter(~discrete)
    each = smooth.filter("value is not null").groupBy("of", "feature", "value").agg(F.sum("n").alias("n"))
    placed = running(each, ["of", "feature"], "value", ["n"]).select("of", "feature", "value", F.floor((F.col("to_n") - F.col("n")) * bins / F.col("all_n")).cast("double").alias("bin"))
    binned = smooth.join(placed, ["of", "feature", "value"]).groupBy("of", "feature", F.col("bin").alias("value"), "outcome").agg(F.sum("n").alias("n"))
    both = train.filter(discrete & F.col("value").isNotNull()).unionByName(binned)
    v = both.groupBy("of", "feature", "value").agg(F.sum("n").alias("a"))
    y = both.groupBy("of", "feature", "outcome").agg(F.sum("n").alias("b"))
    t = both.groupBy("of", "feature").agg(F.sum("n").alias("t"))
    joined = both.join(v, ["of", "feature", "value"]).join(y, ["of", "feature", "outcome"]).join(t, ["of", "feature"])
    mi = joined.groupBy(F.col("of").alias("fold"), "feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    return top_per(mi.withColumn("__s", F.round("mi", 10)), ["fold"], [F.desc("__s"), F.col("feature")], keep).drop("__s")


def training_statistics(rows: DataFrame, numeric: list[str], categorical: list[str], missing: str = "__MISSING__") -> DataFrame:
    """(fold, column, level, statistic, value): what encoding needs of the rows outside each fold of (visit_id, fold, columns).

    Medians, means and population deviations of the numbers that are known, and the share of each level, nulls being one. Sums and
    counts are made once for each fold and a fold's own are taken off.
    """
    numbers = rows.select("fold", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in numeric])).alias("x")).select("fold", "x.*")
    med = training_medians(*_by_value(numbers)).select(F.col("fold").cast("long").alias("fold"), F.col("feature").alias("column"), F.lit("").alias("level"), F.lit("median").alias("statistic"), F.col("med").alias("value"))
    per = numbers.filter("value is not null").groupBy("fold", "feature").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    whole = per.groupBy("feature").agg(*[F.sum(c).alias(f"a{c}") for c in "nsq"])
    left = rows.select("fold").distinct().crossJoin(F.broadcast(whole)).join(per, ["fold", "feature"], "left")
    n, s, q = (F.col(f"a{c}") - F.coalesce(c, F.lit(0)) for c in "nsq")
    both = F.array(F.struct(F.lit("mean").alias("statistic"), (s / n).alias("value")), F.struct(F.lit("deviation").alias("statistic"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("value")))
    moments = left.filter(n > 0).select(F.col("fold").cast("long").alias("fold"), F.col("feature").alias("column"), F.lit("").alias("level"), F.explode(both).alias("x")).select("fold", "column", "level", "x.*")
    levels = rows.select("visit_id", "fold", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(missing)).alias("level")) for c in categorical])).alias("x")).select("visit_id", "fold", "x.*")
    held = training_counts(levels, ["column", "level"], "n")
    total = held.groupBy("fold", "column").agg(F.sum("n").alias("all"))
    shares = held.join(total, ["fold", "column"]).select(F.col("fold").cast("long").alias("fold"), "column", "level", F.lit("share").alias("statistic"), (F.col("n") / F.col("all")).alias("value"))
    return med.unionByName(moments).unionByName(shares)


# ------------------------------------------------------------------ units, ranks and gates


def confirmed_units(events: DataFrame, rules: list[tuple[str, str, float, float]], allowed: dict[str, list[str]] | None = None, default: tuple[str, ...] = ()) -> DataFrame:
    """``events`` with value in the confirmed unit and unit_status: converted, allowed or invalid (value null).

    ``rules``: (concept, unit, factor, offset), an empty concept standing for all. Else the unit must be on the concept's list, or on
    the default list where the concept has none. Units compare trimmed and in lower case.
    """
    spark = events.sparkSession
    unit = F.lower(F.trim("unit"))
    table = spark.createDataFrame([(c, u.strip().lower(), float(f), float(o)) for c, u, f, o in rules], "rc string, ru string, factor double, offset double")
    own, every = table.filter("rc != ''"), table.filter("rc = ''").select(F.col("ru").alias("eu"), F.col("factor").alias("ef"), F.col("offset").alias("eo"))
    rows = events.join(F.broadcast(own), (F.col("concept_key") == F.col("rc")) & (unit == F.col("ru")), "left").join(F.broadcast(every), unit == F.col("eu"), "left")
    listed = spark.createDataFrame([(c, [x.strip().lower() for x in us]) for c, us in (allowed or {}).items()], "lc string, units array<string>")
    rows = rows.join(F.broadcast(listed), F.col("concept_key") == F.col("lc"), "left")
    fine = F.coalesce(F.when(F.col("units").isNotNull(), F.array_contains("units", F.coalesce(unit, F.lit("")))).otherwise(unit.isin(*[x.lower() for x in default]) if default else F.lit(False)), F.lit(False))
    factor, offset = F.coalesce("factor", "ef"), F.coalesce("offset", "eo")
    value = F.when(factor.isNotNull(), F.col("value") * factor + offset).when(fine, F.col("value"))
    status = F.when(factor.isNotNull(), "converted").when(fine, "allowed").otherwise("invalid")
    return rows.withColumn("unit_status", status).withColumn("value", value).drop("rc", "ru", "factor", "offset", "eu", "ef", "eo", "lc", "units")


def unit_exclusions(events: DataFrame, modal: DataFrame) -> DataFrame:
    """(fold, unit, excluded): rows outside each fold whose unit is not their concept's modal one; a null modal unit matches nothing.

    The query fails if a concept has more than one modal unit in a fold.
    """
    one = sole(modal.select("fold", "concept_key", F.col("unit").alias("modal")), ["fold", "concept_key"]).withColumnRenamed("fold", "of")
    per = events.groupBy("concept_key", "unit", "fold").agg(F.count(F.lit(1)).alias("n"))
    other = F.col("modal").isNull() | F.col("unit").isNull() | (F.col("unit") != F.col("modal"))
    rows = one.join(per, "concept_key").filter((F.col("fold") != F.col("of")) & other)
    return rows.groupBy(F.col("of").alias("fold"), "unit").agg(F.sum("n").alias("excluded"))


def require_ranked(top: DataFrame, groups: list[str], n: int) -> DataFrame:
    """``top``; its query fails if a group has fewer than ``n`` ranks."""
    most = top.groupBy(*groups).agg(F.max("rank").alias("__most"))
    return checked(top.join(most, groups), {f"a group has fewer than {n}": F.col("__most") >= n}).drop("__most")


def concept_metadata(rows: DataFrame) -> DataFrame:
    """(concept_key, concept_name, sources, semantics, units): the first name by text, and sorted distinct values joined by bars."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    have = set(rows.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return rows.groupBy("concept_key").agg(F.min(text("concept_name")).alias("concept_name"), joined(text("source_table")).alias("sources"), joined(text("semantics")).alias("semantics"), joined(text("unit")).alias("units"))


def key_collisions(keys: DataFrame, raw: str, normal: str) -> DataFrame:
    """(normal, n): normalised keys that several raw ones share."""
    return keys.groupBy(normal).agg(F.count_distinct(raw).alias("n")).filter("n > 1")


def selection_frequency(selected: DataFrame, key: str = "concept_key", measure: str = "prevalence") -> DataFrame:
    return selected.groupBy(key).agg(F.count_distinct("fold").alias("folds"), F.avg(measure).alias(f"mean_{measure}"))


def fold_checks(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """(check, failures) of rows (visit_id, patient_id, outcome) under folds (patient_id, fold): without a fold, in several, one class alone."""
    per = folds.groupBy("patient_id").agg(F.count_distinct("fold").alias("folds"))
    own = rows.join(per, "patient_id", "left").agg(F.count_if(F.col("folds").isNull()).alias("unassigned"), F.count_distinct(F.when(F.col("folds") > 1, F.col("patient_id"))).alias("split_patients"))
    sums = rows.join(folds, "patient_id").groupBy("fold").agg(F.sum("outcome").alias("pos"), F.count(F.lit(1)).alias("n"))
    whole = sums.agg(F.sum("pos").alias("ap"), F.sum("n").alias("an"))
    one = sums.crossJoin(F.broadcast(whole)).agg(F.count_if((F.col("pos") == 0) | (F.col("pos") == F.col("n")) | (F.col("ap") == F.col("pos")) | (F.col("an") - F.col("ap") == F.col("n") - F.col("pos"))).alias("one_class_folds"))
    return own.crossJoin(one).select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("failures")) for c in ("unassigned", "split_patients", "one_class_folds")])).alias("x")).select("x.*")


def fold_summary(rows: DataFrame, folds: DataFrame) -> DataFrame:
    return rows.join(folds, "patient_id").groupBy("fold").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("patient_id").alias("patients"), F.sum("outcome").alias("outcomes"))


def assemble(base: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Left joins on the surrogate key; names that meet twice are an error."""
    seen = set(base.columns)
    for p in parts:
        if clash := (set(p.columns) - {key}) & seen:
            raise ValueError(f"columns in two parts: {sorted(clash)}")
        seen |= set(p.columns)
        base = base.join(p, key, "left")
    return base


def screen(df: DataFrame, forbidden: tuple[str, ...] = ("patient_id", "visit_id", "outcome", "death", "datetime")) -> DataFrame:
    """An error if a column that could tell the outcome, an identifier or a time would become a predictor."""
    bad = [c for c, t in df.dtypes if t.startswith(("date", "timestamp")) or any(x in c for x in forbidden)]
    if bad:
        raise ValueError(f"not predictors: {bad}")
    return df
