"""A sample of registered queries against their SQL in DuckDB at the smallest size."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewater.plans import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(df):
    def cell(x):
        if x is None or str(x) in ("<NA>", "NaT", "nan"):
            return None
        if isinstance(x, float):
            return round(x, 5) if math.isfinite(x) else str(x)
        return int(x) if hasattr(x, "__index__") else str(x)

    cols = sorted(df.columns)
    return cols, sorted((tuple(map(cell, r)) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", ["cohort_attrition", "cohort_numbering", "event_linkage", "linkage_audit", "prior_comorbidity", "measurement_features", "concept_topk", "mutual_information", "pooled_metrics", "calibration_bins", "bootstrap_metrics", "table_diff", "stable_event_keys"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    assert _rows(QUERIES[name](spark, D).toPandas()) == _rows(con.execute(ORACLES[name]).df())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
