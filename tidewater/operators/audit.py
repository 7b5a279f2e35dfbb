"""Constraints, gates, digests, differences and disclosure scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.numbering import numbered

#: What must not be in published text.
SENSITIVE = {
    "credential": r"(?i)(password|passwd|api[_-]?key|access[_-]?token|secret)\s*[:=]\s*[^\s'\"]{4,}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "database_url": r"(?i)(?:postgres(?:ql)?|mysql|mssql|oracle)://[^/\s]+@",
    "internal_path": r"(?i)(?:/Users/[^/\s]+|/home/[^/\s]+|/mnt/[^/\s]+|/(?:Volumes|private|srv|opt)/[^/\s]+|[A-Z]:\\Users\\[^\\\s]+)",
    "connection": r"(?i)(?:host|server|database|dsn)\s*[:=]\s*(?!<|example|unset)[^\s,;]{3,}",
}


class ConstraintError(ValueError):
    """A table breaks a constraint; the message names it and the count, never a value."""


def violations(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """(constraint, violations): rows for which a condition does not hold (null counts as not), in one pass."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in constraints.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(n).alias("violations")) for n in constraints])).alias("x")).select("x.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def failing(condition: Column, message: str) -> Column:
    """True where the condition holds; where not (null counts as not), the query fails with the message."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def checked(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """``df``; its query fails at the first row for which a condition does not hold. It takes no pass of its own.

    Spark may check rows that a later join or filter drops, so what is said should hold for the whole table.
    """
    for message, condition in constraints.items():
        df = df.filter(failing(condition, message))
    return df


def sole(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by its keys; its query fails where rows share them. A join on the keys needs no shuffle besides. Null keys are let pass."""
    rest = [c for c in df.columns if c not in keys]
    named = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        named = named & F.col(k).isNotNull()
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *([F.first(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__r")] if rest else []))
    one = checked(one, {f"keys are not unique: {', '.join(keys)}": (F.col("__n") == 1) | ~named})
    return one.select(*keys, *(["__r.*"] if rest else []))


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not duplicates(df, keys).isEmpty():
        raise ConstraintError(f"keys are not unique: {keys}")
    return df


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ConstraintError(f"missing columns: {missing}")
    return df


def enforce(df: DataFrame, constraints: dict[str, Column], evidence: str | None = None) -> DataFrame:
    """``df`` if all constraints hold; else the counts are written to ``evidence`` before the error is raised."""
    found = violations(df, constraints).filter("violations > 0")
    bad = found.collect()  # one row for each constraint
    if bad:
        if evidence:
            found.write.mode("overwrite").parquet(evidence)
        raise ConstraintError(", ".join(f"{r['constraint']}: {r['violations']}" for r in bad))
    return df


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", kind: str = "many_to_one") -> DataFrame:
    """A join whose query fails where the right side, or either if ``kind`` is one_to_one, repeats a key; it takes no pass of its own."""
    if kind == "one_to_one":
        left = sole(left, keys)
    return left.join(sole(right, keys), keys, how)


def reconcile(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of both with merge: both, left_only, right_only."""
    x, y = a.select(*keys).distinct().withColumn("__a", F.lit(1)), b.select(*keys).distinct().withColumn("__b", F.lit(1))
    side = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), "both").when(F.col("__a").isNotNull(), "left_only").otherwise("right_only")
    return x.join(y, keys, "full_outer").select(*keys, side.alias("merge"))


def plain_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row_count, digest) over texts name=value joined by bars, for tables of plain keys; ``digest`` tells all values and types apart."""
    cols = columns or sorted(df.columns)
    row = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("<NA>"))) for c in cols])
    return _summed(df, row, [])


def _summed(df: DataFrame, row: Column, groups: list[str]) -> DataFrame:
    number = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("__h"), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest")]
    hashed = df.select(*groups, number.alias("__h"))
    return hashed.groupBy(*groups).agg(*sums) if groups else hashed.agg(*sums)


def partition_digests(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """(groups, row_count, digest) of every partition in one pass, by the plain texts."""
    row = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("<NA>"))) for c in columns])
    return _summed(df, row, groups)


def require_equal_digests(have: DataFrame, want: DataFrame, keys: list[str], evidence: str | None = None) -> DataFrame:
    """The digests of both; the query fails where one is missing or differs. With ``evidence`` the comparison is written there before it is judged."""
    other = want.select(*keys, F.col("row_count").alias("wanted_rows"), F.col("digest").alias("wanted_digest"))
    both = have.join(other, keys, "full_outer")
    good = (F.col("row_count") == F.col("wanted_rows")) & (F.col("digest") == F.col("wanted_digest"))
    if evidence:
        from tidewater.operators.verify import with_evidence

        return with_evidence(both, good, "a partition is not what was frozen", evidence).select(*keys, "row_count", "digest")
    return checked(both, {"a partition is not what was frozen": good}).select(*keys, "row_count", "digest")


def digest(df: DataFrame, columns: list[str] | None = None, schema: bool = True) -> DataFrame:
    """(row_count, digest): the same for any order of rows; repeated rows count. Sums of row hashes, so nothing is gathered.

    A row's text is JSON of its values by column name, in which nulls, empty texts and bars are told apart. ``schema`` also covers the
    columns' types.
    """
    cols = sorted(columns or df.columns)
    row = canonical_json(*cols)
    if schema:
        row = F.concat(F.lit(repr([(f.name, f.dataType.simpleString()) for f in sorted(df.select(*cols).schema, key=lambda f: f.name)])), row)
    return _summed(df, row, [])


def ordered_digest(df: DataFrame, order: list[str], columns: list[str] | None = None, schema: bool = True) -> DataFrame:
    """(row_count, digest) that changes with the rows' order: each row is digested with its place by ``order``, which must be total."""
    placed = numbered(df, [F.col(c) for c in order], "__place")
    return digest(placed, [*(columns or df.columns), "__place"], schema)


def canonical_json(*columns: str) -> Column:
    """A record as compact JSON with keys in order and nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def strict_boolean(c: Column) -> Column:
    """true, false, 1 and 0 in any case and with blanks around; null stays null; the query fails at anything else."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(c.isNull(), F.lit(None).cast("boolean")).when(t.isin("true", "1"), True).when(t.isin("false", "0"), False).otherwise(F.raise_error(F.lit("not a boolean")).cast("boolean"))


def require_allowed(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """``df``; its query fails at a value that is not on the list, null included."""
    return checked(df, {f"{column} has a value that is not allowed": F.col(column).isin(*allowed)})


def not_allowed(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """(column, n): what is not on the list, with its rows."""
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


#: Result tables: the columns each must have and its key.
RESULT_SCHEMAS = {
    "oof_predictions": (("n", "matrix", "model", "fold", "p"), ("n", "matrix", "model")),
    "fold_metrics": (("matrix", "model", "fold", "auroc", "auprc", "brier"), ("matrix", "model", "fold")),
    "pooled_metrics": (("matrix", "model", "auroc", "auprc", "brier"), ("matrix", "model")),
    "feature_importance": (("matrix", "model", "fold", "feature", "importance"), ("matrix", "model", "fold", "feature")),
    "calibration_bins": (("matrix", "model", "bin", "count", "events", "mean_p", "observed"), ("matrix", "model", "bin")),
    "decision_curve": (("matrix", "model", "threshold", "strategy", "net_benefit"), ("matrix", "model", "threshold", "strategy")),
}


def require_result(df: DataFrame, table: str) -> DataFrame:
    """A result table with its columns and unique key; a missing column is an error at once, a repeated key in its query."""
    columns, key = RESULT_SCHEMAS[table]
    return sole(require_columns(df, list(columns)), list(key)).select(*df.columns)


def publishable(df: DataFrame, table: str, allowed: dict[str, list[str]], count_columns: list[str], threshold: int) -> DataFrame:
    """``df`` if its columns are on the table's list, none is like an identifier or a time, and no count is small; else an error.

    Columns are judged at once, counts in the query.
    """
    if bad := identifier_columns(df, allowed.get(table, [])):
        raise ConstraintError(f"{table}: columns that may not be published: {bad}")
    return checked(df, {f"{table}: a count in {c} is below {threshold}": ~F.coalesce((F.col(c) > 0) & (F.col(c) < threshold), F.lit(False)) for c in count_columns})


IDENTIFIERS = ("patient", "visit", "subject", "hadm", "person", "key")


def manifest_values(df: DataFrame, column: str, depth: int = 8) -> DataFrame:
    """(id columns of ``df``, path, value): the leaves of a column of JSON text, objects and lists opened level by level."""
    keys = [c for c in df.columns if c != column]
    rows = df.select(*keys, F.lit("$").alias("path"), F.col(column).alias("value"))
    shape = F.coalesce(F.substring(F.ltrim("value"), 1, 1), F.lit(""))
    inner = "array<struct<path:string,value:string>>"
    for _ in range(depth):
        fields = F.transform(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: F.struct(F.concat("path", F.lit("."), e.key).alias("path"), e.value.alias("value"))).cast(inner)
        items = F.transform(F.from_json("value", "array<string>"), lambda e, i: F.struct(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")).alias("path"), e.alias("value"))).cast(inner)
        leaf = F.array(F.struct("path", "value")).cast(inner)
        rows = rows.select(*keys, F.explode(F.when(shape == "{", fields).when(shape == "[", items).otherwise(leaf)).alias("x")).select(*keys, "x.*")
    return rows


def manifest_findings(df: DataFrame, column: str, threshold: int, counts: str = r"(count|rows|visits|patients|events|n)$") -> DataFrame:
    """(id columns, path, finding): leaves of nested manifests under a name like an identifier, and small counts; values are not shown."""
    leaves = manifest_values(df, column)
    name = F.lower(F.regexp_extract("path", r"([^.\[\]]+)(?:\[\d+\])*$", 1))
    number = F.col("value").try_cast("double")
    finding = F.when(name.rlike("(" + "|".join(IDENTIFIERS) + ")_?(id|key)?$") & name.rlike("(_id|_key|^(" + "|".join(IDENTIFIERS) + "))$"), "identifier").when(name.rlike(counts) & (number > 0) & (number < threshold), "small_cell")
    return leaves.withColumn("finding", finding).filter("finding is not null").drop("value")


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], atol: float = 5e-11) -> DataFrame:
    """(keys, column, kind): cells that differ by more than ``atol``, and rows that one side lacks."""
    cols = [c for c in a.columns if c not in keys]
    x = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("__a"))
    y = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("__b"))
    both = x.join(y, keys, "full_outer")
    numeric = {c for c, t in a.dtypes if t in ("double", "float")}

    def differ(c: str) -> Column:
        p, q = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.when(p.isNull() | q.isNull(), ~p.eqNullSafe(q)).otherwise(F.abs(p - q) > atol if c in numeric else p != q)

    gone = F.when(F.col("__a").isNull(), "only_right").when(F.col("__b").isNull(), "only_left")
    cells = F.array_compact(F.array(*[F.when(differ(c), F.lit(c)) for c in cols]))
    found = both.select(*keys, gone.alias("gone"), F.when(gone.isNull(), cells).otherwise(F.array(F.lit("*"))).alias("cells"))
    return found.select(*keys, F.explode("cells").alias("column"), F.coalesce("gone", F.lit("value")).alias("kind"))


def sensitive_scan(df: DataFrame, columns: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """(column, pattern, rows): how many values match, each pattern having a row; values are not shown."""
    patterns = patterns or SENSITIVE
    hits = [F.count_if(F.col(c).rlike(p)).alias(f"{c}|{n}") for c in columns for n, p in patterns.items()]
    one = df.agg(*hits)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(n).alias("pattern"), F.col(f"{c}|{n}").alias("rows")) for c in columns for n in patterns]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def small_cells(df: DataFrame, count_columns: list[str], threshold: int, keys: list[str]) -> DataFrame:
    """(keys, column, n) of counts above 0 and below the threshold."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("n")) for c in count_columns]
    return df.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*").filter((F.col("n") > 0) & (F.col("n") < threshold))


#: Words for one person or stay, what may follow them in an identifier's name, ends of names of times, and names of row-level values.
ENTITIES = ("patient", "person", "subject", "visit", "admission", "encounter", "member", "case", "record")
ENTITY_ENDS = ("id", "identifier", "number", "key")
TIMES = ("date", "datetime", "timestamp", "timepoint")
ROW_VALUES = ("probability", "prediction", "oof_probability", "shap_value", "feature_value", "raw_value", "fold_assignment")


def unpublishable(name: str) -> bool:
    """Whether a column's name is that of an identifier, a time or a value of one row. Whole parts of names count: visits and monkey are fine."""
    name = name.lower()
    parts = name.split("_")
    if name in ROW_VALUES or name.endswith(TIMES) or parts[-1] == "mrn" or parts[-2:] == ["hadm", "id"]:
        return True
    return parts[-1] in ENTITIES or (len(parts) > 1 and parts[-1] in ENTITY_ENDS and parts[-2] in ENTITIES)


def identifier_columns(df: DataFrame, allowed: list[str]) -> list[str]:
    """Columns that a published table may not have: not on its list, named like an identifier, time or row value, or of a time's type."""
    kinds = dict(df.dtypes)
    return [c for c in df.columns if c not in allowed or unpublishable(c) or kinds[c].startswith(("date", "timestamp"))]


def publication_findings(tables: dict[str, DataFrame], rules: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], threshold: int) -> DataFrame:
    """(table, column, finding, rows) of a set of tables under ``rules``: (exact columns, count columns) by table.

    Findings are unknown_table, missing_column, unknown_column, not_publishable and small_cell (counts above 0 and below the
    threshold). Schemas are judged without reading rows; all counts of all tables are judged in one pass over their union.
    """
    found, counts = [], None
    for table, df in tables.items():
        if table not in rules:
            found.append((table, "*", "unknown_table", None))
            continue
        columns, cells = rules[table]
        found += [(table, c, "missing_column", None) for c in columns if c not in df.columns]
        found += [(table, c, "unknown_column", None) for c in df.columns if c not in columns]
        found += [(table, c, "not_publishable", None) for c in identifier_columns(df, df.columns)]
        have = [c for c in cells if c in df.columns]
        if have:
            small = df.agg(*[F.count_if((F.col(f"`{c}`") > 0) & (F.col(f"`{c}`") < threshold)).alias(f"c{i}") for i, c in enumerate(have)])
            small = small.select(F.explode(F.array(*[F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), F.lit("small_cell").alias("finding"), F.col(f"c{i}").cast("long").alias("rows")) for i, c in enumerate(have)])).alias("x")).select("x.*")
            counts = small if counts is None else counts.unionByName(small)
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame(found, "table string, column string, finding string, rows long")
    return out if counts is None else out.unionByName(counts.filter("rows > 0"))


def require_publishable(tables: dict[str, DataFrame], rules: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], threshold: int) -> None:
    """An error that names the findings, if there are any; values are not shown."""
    if bad := publication_findings(tables, rules, threshold).orderBy("table", "column", "finding").collect():  # as many rows as columns
        raise ConstraintError("; ".join(f"{r['table']}.{r['column']}: {r['finding']}" for r in bad))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
