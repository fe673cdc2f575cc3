"""Exact medians by selection against sorting."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from brigade.operators import medians
from tests.conftest import rows


@pytest.mark.parametrize("fit", [1, 2, 7, 100_000])
def test_medians_equal_sorting(spark, fit):
    rnd = random.Random(fit)
    groups = {
        "even": [rnd.randrange(1000) for _ in range(200)], "odd": [rnd.random() for _ in range(201)], "same": [5] * 50, "pair": [1, 2], "one": [3],
        "tail": [10.0**rnd.randrange(-8, 9) for _ in range(151)], "halves": [0] * 40 + [1] * 40, "negative": [-rnd.random() * 1e6 for _ in range(60)],
        "close": [1e9 + k * 1e-6 for k in range(90)], None: [7, 8, 9, 10], "none": [None, None], "some": [None, 4, 6],
    }
    data = [(g, None if x is None else float(x), None if x is None else -2.0 * x) for g, xs in groups.items() for x in xs]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "k string, a double, b double")
    got = {r["k"]: (r["median_a"], r["median_b"]) for r in medians.medians(df, ["k"], ["a", "b"], fit=fit).collect()}
    for g, xs in groups.items():
        xs = [float(x) for x in xs if x is not None]
        assert got[g] == ((statistics.median(xs), statistics.median([-2.0 * x for x in xs])) if xs else (None, None)), g
    assert len(got) == len(groups) and medians.medians(df.where("false"), ["k"], ["a"]).count() == 0


def test_few_passes_and_no_range_shuffle(spark, monkeypatch):
    df = spark.range(200_000).select((F.col("id") * 0).alias("k"), F.rand(1).alias("v"))
    calls = []
    narrowed = medians._narrowed
    monkeypatch.setattr(medians, "_narrowed", lambda *a: calls.append(1) or narrowed(*a))
    got = medians.medians(df, ["k"], ["v"], fit=1000)
    assert abs(got.first()["median_v"] - df.approxQuantile("v", [0.5], 0)[0]) < 1e-4
    assert len(calls) <= 2 and "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got.select("k")) == [(0,)]
