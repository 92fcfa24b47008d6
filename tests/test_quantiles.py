"""Distributed selection against sorting."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.operators import metrics, profile, quantiles, splits

SHARES = [0.0, 0.25, 0.5, 0.99, 1.0]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    n = 3000
    return pd.DataFrame({
        "normal": rng.normal(size=n), "wide": np.exp(rng.normal(size=n) * 90), "few": rng.integers(0, 3, n).astype(float), "tiny": np.where(rng.random(n) < 0.5, -1e-310, 5e-324),
        "one": np.full(n, 7.0), "zeros": rng.choice([0.0, -0.0, 1.5e308, -1.5e308], n), "near": 1 + rng.integers(0, 50, n) * 2.0**-52, "negative": -np.exp(rng.normal(size=n) * 20),
    })


def test_quantiles(spark, data, monkeypatch):
    df = spark.createDataFrame(data).repartition(5).withColumn("none", F.lit(None).cast("double"))
    for split in (4096, 7):  # few ranges: many passes
        monkeypatch.setattr(quantiles, "SPLIT", split)
        found = quantiles.quantiles(df, {c: F.col(c) for c in df.columns}, SHARES)
        assert found.pop("none") == [None] * 5
        for c, got in found.items():
            assert got == pytest.approx([np.quantile(data[c], q) for q in SHARES], rel=1e-12), c


def test_missing_and_infinite_values_are_left_out(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-float("inf"),), (3.0,), (1.0,)], "x double")
    assert quantiles.quantiles(df, {"x": F.col("x")}, [0.5, 1.0]) == {"x": [2.0, 3.0]}
    assert quantiles.quantiles(df.limit(0), {"x": F.col("x")}, [0.5]) == {"x": [None]} and quantiles.quantiles(df, {}, [0.5]) == {}
    assert profile.scaler_statistics(df, ["x"]).first().asDict() == {"feature": "x", "median": 2.0, "mean": 2.0, "std": pytest.approx(np.sqrt(2 / 6))}
    row = metrics.latency(df, "x").first()
    assert (row["mean_ms"], row["median_ms"], row["p99_ms"]) == (2000.0, 2000.0, pytest.approx(2980.0))


def test_smallest(spark, data):
    df = spark.createDataFrame(data[["normal", "few"]])
    got = quantiles.smallest(df, {"normal": F.col("normal"), "few": F.col("few")}, {"normal": 17, "few": 2999})
    assert got == {"normal": sorted(data["normal"])[17], "few": 2.0} and quantiles.smallest(df, {"few": F.col("few")}, {"few": 3000}) == {}


def test_samples_take_the_smallest_hashes(spark):
    df = spark.range(2000).select(F.col("id").alias("key"), F.when(F.col("id") % 100 == 0, None).when(F.col("id") % 7 == 0, "rare").otherwise("often").alias("label"))
    got = splits.minority_sample(df, "label", "key", 120).collect()
    assert {v: sum(r["label"] == v for r in got) for v in (None, "rare", "often")} == {None: 20, "rare": 40, "often": 40}
    ranked = df.where("label = 'often'").orderBy(splits.seeded("key", 42), "key").limit(40)
    assert {r["key"] for r in got if r["label"] == "often"} == {r["key"] for r in ranked.collect()}
    assert splits.minority_sample(df.limit(0), "label", "key", 10).count() == 0


def test_samples_take_two_looks_at_the_rows(spark, monkeypatch):
    """One counts by range of the hash, one takes the rows of the first ranges; hashes are compared in compiled code only."""
    monkeypatch.setattr(splits, "DEALT", 1)  # several rows a range, ties of ranges
    df = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") % 1000 == 0, None).when(F.col("id") % 7 == 0, "rare").otherwise("often").alias("label"))
    looks = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            looks.add(batch.num_rows)
            yield batch

    got = {(r["label"], r["key"]) for r in splits.minority_sample(df.mapInArrow(counted, df.schema), "label", "key", 900).collect()}
    want = {(v, r["key"]) for v in (None, "rare", "often") for r in df.where(F.col("label").eqNullSafe(F.lit(v))).orderBy(splits.seeded("key", 42), "key").limit(300).collect()}
    assert got == want and looks.value == 2 * 3000


def test_quantiles_compile(spark, data):
    """No lambda stands between a column and its counts: those are interpreted, with the column's own expression, for every row."""
    df = spark.createDataFrame(data)
    seen = quantiles._values(df, [quantiles.finite(F.col("wide"))])
    for ranges in (quantiles._ranges(seen, quantiles._magnitude(F.col("x"))), quantiles._refined(df, [F.col("wide"), F.col("few")], [(1, 0.0, 2.0), (0, 1.0, 5.0)])):
        assert "lambda" not in ranges._jdf.queryExecution().executedPlan().toString()
