"""Column expressions that normalise identifiers, categories, codes and numbers. All stay in the JVM but ``nfkc``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ordered category rules on upper-case text; a later rule wins.
HISPANIC = "HISPANIC|LATINO"
UNKNOWN = "UNKNOWN|UNABLE|DECLINED|NOT SPECIFIED|OTHER/UNKNOWN|PORTUGUESE"
CATEGORY_RULES = (
    ("WHITE", "WHITE"),
    ("BLACK", "BLACK|AFRICAN"),
    ("ASIAN", "ASIAN"),
    ("AMERICAN_INDIAN_OR_ALASKA_NATIVE", "AMERICAN INDIAN|ALASKA NATIVE"),
    ("NATIVE_HAWAIIAN_OR_PACIFIC_ISLANDER", "NATIVE HAWAIIAN|PACIFIC ISLAND"),
    ("MULTIPLE", "MULTIPLE"),
    ("OTHER", HISPANIC),
    ("UNKNOWN", UNKNOWN),
)


def category(c: Column, rules=CATEGORY_RULES, default: str = "OTHER", null: str = "UNKNOWN") -> Column:
    """The last rule that matches; null is read as ``null`` before the rules."""
    text = F.trim(F.upper(F.coalesce(c, F.lit(null))))
    out = None
    for name, pattern in reversed(rules):
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def ethnicity(c: Column) -> Column:
    text = F.trim(F.upper(F.coalesce(c, F.lit("UNKNOWN"))))
    return F.when(text.rlike(HISPANIC), "HISPANIC_OR_LATINO").when(text.rlike(UNKNOWN), "UNKNOWN").otherwise("NOT_HISPANIC_OR_LATINO")


def canonical_id(c: Column) -> Column:
    """Trimmed text; a finite whole number is printed as an integer."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    whole = text.rlike(r"^[+-]?[0-9]+(\.0*)?$") & number.isNotNull() & (F.floor(number) == number) & (F.abs(number) < 9e15)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(text)


def code_text(c: Column) -> Column:
    """Trimmed lower case with single blanks; what says "no code" becomes empty."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")
    return F.when(text.isin("", "nan", "none", "0", "0.0"), F.lit("")).otherwise(text)


def code_hierarchy(levels: list[tuple[str, Column]]) -> Column:
    """The first code that is not empty, as prefix:code, or null."""
    return F.coalesce(*[F.when(code_text(c) != "", F.concat(F.lit(f"{p}:"), code_text(c))) for p, c in levels])


def procedure_code(version: Column, c: Column) -> Column:
    code = F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]", "")
    return F.when(code != "", F.concat(F.lit("icd"), version.cast("string"), F.lit(":"), code))


def concept_key(c: Column) -> Column:
    """Trim, lower case, single blanks; ``nfkc`` before it where text is not ASCII."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalised_keys(df: DataFrame, column: str, out: str = "concept_norm") -> DataFrame:
    """``df`` with the full normalisation of a key; Python sees distinct non-ASCII keys alone."""
    keys = df.select(column).filter(F.col(column).rlike(r"[^\x00-\x7F]")).distinct().select(F.col(column).alias("__key"), concept_key(nfkc(column)).alias("__norm"))
    return df.join(keys, F.col(column) == F.col("__key"), "left").withColumn(out, F.coalesce("__norm", concept_key(F.col(column)))).drop("__key", "__norm")


def feature_safe(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(concept_key(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(text == "", "empty").otherwise(text)


def canonical_float(c: Column, places: int = 8) -> Column:
    """Half-even rounding; minus zero becomes zero."""
    r = F.bround(c, places)
    return F.when(r == 0, 0.0).otherwise(r)


def unit_hash(text: Column) -> Column:
    """A number in [0, 1) from the first eight hexadecimal digits of md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def stable_event_keys(df: DataFrame, namespace: str, columns: list[str], out: str = "event_id") -> DataFrame:
    """namespace:sha256:occurrence; equal rows are numbered from 0, so none is lost."""
    from pyspark.sql import Window

    text = F.concat_ws("|", F.lit(namespace), *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in columns])
    digest = F.sha2(text, 256)
    df = df.withColumn("__digest", digest)
    n = F.row_number().over(Window.partitionBy("__digest").orderBy("__digest")) - 1
    return df.withColumn(out, F.concat(F.lit(f"{namespace}:"), F.col("__digest"), F.lit(":"), n.cast("string"))).drop("__digest")
