"""The bootstrap queries make all replicates and all pairs."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.test_queries import TABLES, _rows
from tidewater.operators import draws, evaluation
from tidewater.plans import ORACLES, QUERIES, evaluation_queries

D = "/root/testdata/sf0.001"


def test_replicates_of_the_production_configuration():
    assert evaluation_queries.REPS == 2000 and "range(1, 2001)" in ORACLES["bootstrap_metrics"]
    assert len(set(evaluation_queries.PAIRS)) == 12 and len(evaluation_queries.ALL) == 8


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_all_pairs(spark, monkeypatch):
    """With few replicates on both sides, to be quick."""
    monkeypatch.setattr(evaluation_queries, "REPS", 5)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = QUERIES["prespecified_comparisons"](spark, D).toPandas()
    assert len(got) == 12 * 3 * 3 and set(got["valid"] + got["invalid"]) == {5}
    assert _rows(got) == _rows(con.execute(ORACLES["prespecified_comparisons"].replace("range(1, 2001)", "range(1, 6)")).df())


def test_draws_are_heads_of_md5():
    for prefix, n in ((b"4|12|", 100_003), (b"20260727|2000|", 1200)):
        got = np.concatenate([draws.md5_heads(prefix, draws.digit_words(a, b, len(prefix)), len(str(a))) for a, b in draws._ranges(n)])
        assert len(got) == n and all(got[i] == int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:8], 16) for i in [*range(1100), n - 1])


def _patients(spark, n):
    return spark.createDataFrame([(1000 + i, i) for i in range(n)], "patient_id long, slot long")


def _plain(n, replicates, seed):
    return Counter((r, int(hashlib.md5(f"{seed}|{r}|{i}".encode()).hexdigest()[:8], 16) % n) for r in range(1, replicates + 1) for i in range(n))


def test_weights_equal_loops_without_a_row_for_a_draw(spark):
    got = evaluation.bootstrap_weights(_patients(spark, 1500), 3, 9)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no row for a draw
    assert {(r["rep"], r["patient_id"] - 1000): r["weight"] for r in got.collect()} == dict(_plain(1500, 3, 9))


def test_every_key_is_summed_once_in_a_block(spark):
    """Keys beyond what a task used to hold; a patient with many rows of one key; null groups."""
    n = 300
    rows = [(1000 + i % n, "ab"[i % 2] if i % 7 else None, (i * 37 % 5000) / 5000, i % 3 == 0) for i in range(12000)] + [(1000, "a", 0.25, True)] * 3000
    df = spark.createDataFrame([(a, b, c, int(d)) for a, b, c, d in rows], "patient_id long, g string, p double, outcome int")
    weights = draws.weights(_patients(spark, n), 4, 9, 100)
    got = evaluation._packed_sums(df, weights, ["g"], "p").collect()
    blocks = Counter((r["g"], r["p"]) for r in got)
    assert len(blocks) > 4096 and max(blocks.values()) <= -(-n // weights.size)
    w, want, have = _plain(n, 4, 9), Counter(), Counter()
    for a, b, c, d in rows:
        for r in range(1, 5):
            want[b, c, r, d] += w[r, a - 1000]
    for r in got:
        for name in ("pos", "neg"):
            for i, x in enumerate(np.frombuffer(r[name], "<u2" if len(r[name]) == 8 else "<i8"), 1):
                have[r["g"], r["p"], i, name == "pos"] += int(x)
    assert +have == +want
