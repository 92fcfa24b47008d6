from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from packetloom.operators import clean, dedup, features, profile, splits, taxonomy
from packetloom.operators.score import Preprocessor

NAN, INF = float("nan"), float("inf")


def test_invalid_numeric(spark):
    df = spark.createDataFrame([(1.0, INF * -1, 1.0, 1), (2.0, 2.0, NAN, 2), (INF, 3.0, 3.0, 3), (4.0, 4.0, 4.0, 4)], "A double, B double, C double, D int")
    assert [r["D"] for r in clean.drop_invalid(df).collect()] == [4]


def test_suspicious_names_are_substrings():
    found = clean.suspicious_columns(["Target", "SourceIP", "Timestamp", "NormalFeature", "Constant", "Idle Mean"])
    assert {"SourceIP", "Timestamp", "Idle Mean"} <= set(found) and "NormalFeature" not in found


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "a int, b double")
    assert {r["feature"]: r["is_constant"] for r in profile.constant_columns(df, ["a", "b"]).collect()} == {"a": False, "b": True}


def test_stratified_split(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 60, "Benign").otherwise("DDoS").alias("label"))
    out = splits.stratified_split(df, "label", "id")
    counts = {(r["split"], r["label"]): r["count"] for r in out.groupBy("split", "label").count().collect()}
    assert counts["train", "DDoS"] == 28 and sum(n for (s, _), n in counts.items() if s == "train") == 70
    assert sum(n for (s, _), n in counts.items() if s == "val") == 15


def test_rare_labels_train(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x")], "id long, label string")
    assert {r["split"] for r in splits.stratified_split(df, "label", "id").collect()} == {"train"}
    assert {r["split"] for r in splits.validation_split(df, "label", "id").collect()} == {"train"}


def test_minority_sample(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 950, "a").when(F.col("id") < 990, "b").otherwise("c").alias("label"))
    counts = {r["label"]: r["count"] for r in splits.minority_sample(df, "label", "id", 100).groupBy("label").count().collect()}
    assert counts == {"a": 33, "b": 33, "c": 10}


def test_load_splits(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("string").alias("label"))
    parts = splits.load_splits(df, None, df, "train_test", "label", "id")
    assert parts["train"].count() == 80 and parts["val"].count() == 20 and parts["test"] is df
    with pytest.raises(ValueError):
        splits.load_splits(df, None, df, "other", "label", "id")


def test_float32_conflicts(spark):
    rows = [(12345.6789012345, "a"), (12345.6789012346, "b"), (-0.0, "a"), (0.0, "b"), (88888.123456789, "a"), (88888.123456788, "a")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key int, x double, label string")
    kept = dedup.purge_and_dedup(clean.as_features(df, ["x"]), ["x"], "label", "key").collect()
    assert [r["key"] for r in kept] == [4]
    assert dedup.conflict_groups(clean.as_features(df, ["x"]), ["x"], "label").count() == 2


def test_overlaps(spark):
    a = spark.createDataFrame([(1.0, "x"), (2.0, "x"), (2.0, "y")], "v double, label string")
    b = spark.createDataFrame([(2.0, "x"), (3.0, "x")], "v double, label string")
    row = dedup.overlap_report(a.withColumn("split", F.lit("a")).unionByName(b.withColumn("split", F.lit("b"))), "split", ("a", "b"), ["v"], "label").first()
    assert (row["shared"], row["same_label_pairs"], row["conflicting_pairs"], row["left_percent"]) == (1, 1, 1, 50.0)
    assert dedup.without(b, a, ["v"]).count() == 1 and dedup.within(a, b, ["v"]).count() == 2


def test_label_mapping(spark):
    df = spark.createDataFrame([(" Benign ",), ("Bot",), ("never heard",), (None,)], "label string")
    plain = taxonomy.map_labels(df, taxonomy.label_map("IDS2018"))
    robust = taxonomy.map_labels(df, taxonomy.label_map("IDS2018"), robust=True)
    assert [r["final_label"] for r in plain.collect()] == [None, "Botnet", None, None]
    assert [r["final_label"] for r in robust.collect()] == ["Benign", "Botnet", None, None]
    ints = taxonomy.map_labels(spark.createDataFrame([(0,), (9,)], "label int"), taxonomy.label_map("5G"), robust=True)
    assert [r["final_label"] for r in ints.collect()] == ["Benign", None]


def test_arp_labels(spark):
    names = ["Normal", "ARP_Storm", "SYN_Flood", "PING_Flood", "ARP_Spoofing"]
    out = taxonomy.map_labels(spark.createDataFrame([(n,) for n in names], "label string"), taxonomy.label_map("ARP"))
    assert [r["final_label"] for r in out.collect()] == ["Benign", "DoS", "DoS", "DoS", "ARP Spoofing"]


def test_column_selection(spark):
    arp = spark.createDataFrame([(1, "m", 0, "x", "Benign")], "frame_number int, arp_src_hw_mac string, tcp_flag_fin int, label_name string, final_label string")
    assert clean.arp_columns(arp).columns == ["frame_number", "tcp_flag_fin", "final_label"]
    fiveg = spark.createDataFrame([(1.0, "a", "b", "c", "d", "e", "f", "g")], "some_metric double, Src_IP string, Dst_IP string, Dst_MAC string, Attack_Type string, attack string, Label string, final_label string")
    assert clean.fiveg_columns(fiveg).columns == ["some_metric", "final_label"]
    mixed = spark.createDataFrame([(1.0, 2, "m", "i", "x", "y")], "flow_duration double, packet_count int, src_mac string, dst_ip string, Label string, final_label string")
    assert clean.feature_columns(mixed) == ["flow_duration", "packet_count"]


def test_engineered(spark):
    columns = ["Total Fwd Packets", "Total Backward Packets", "Fwd Packets Length Total", "Bwd PSH Flags"]
    df = spark.createDataFrame([(10.0, 5.0, 100.0, 0)], ", ".join(f"`{c}` double" for c in columns[:3]) + ", `Bwd PSH Flags` int")
    row = clean.representation(df, "engineered").first()
    assert row["fwd_bwd_pkt_ratio"] == pytest.approx(10 / 6, rel=1e-6) and row["bytes_per_fwd_pkt"] == pytest.approx(100 / 11, rel=1e-6)
    assert "Bwd PSH Flags" not in row.asDict() and "flow_iat_spread" not in row.asDict()
    with pytest.raises(ValueError):
        clean.representation(df, "other")


def test_dns_features(spark):
    df = spark.createDataFrame([("1", "www.google.com"), ("0", "abc"), ("0", None)], "c0 string, c1 string")
    out = features.with_dns_features(df).collect()
    assert "c1" not in out[0].asDict()
    assert [r["num_dots"] for r in out] == [2, 0, 0]
    assert out[0]["entropy"] == pytest.approx(2.8423709931771093) and out[1]["entropy"] == pytest.approx(1.584962500721156) and out[2]["entropy"] == 0.0
    assert out[2]["query_length"] == 0 and out[0]["max_label_length"] == 6 and out[0]["avg_label_length"] == 4.0


def test_scaler_and_preprocessor(spark):
    train = spark.createDataFrame([(10.0,), (20.0,), (NAN,), (30.0,)], "feature_a double").withColumn("x", F.lit(1.0))
    pre = Preprocessor.fit(train, ["feature_a", "x"], ["Benign", "DoS"])
    assert pre.medians["feature_a"] == 20.0 and pre.stds["x"] == 1.0 and pre.means["feature_a"] == pytest.approx(20.0)
    assert pre.stds["feature_a"] == pytest.approx(math.sqrt(50))
    row = pre.transform(spark.createDataFrame([(NAN, 1.0)], "feature_a double, x double")).first()
    assert row["feature_a"] == 0.0
    with pytest.raises(ValueError):
        pre.transform(spark.createDataFrame([(1.0,)], "x double"))
    with pytest.raises(ValueError):
        Preprocessor(["feature_0"], ["a"], {"feature_0": 0}, {"feature_0": 0}, {"feature_0": 1}).validate()
    assert pre.encode(spark.createDataFrame([("DoS",)], "label string"), "label").first()["label_id"] == 1
    with pytest.raises(Exception, match="unknown label"):
        pre.encode(spark.createDataFrame([("zzz",)], "label string"), "label").collect()


def test_class_weights(spark):
    df = spark.range(1011).select(F.when(F.col("id") < 1000, 0).when(F.col("id") < 1010, 4).otherwise(6).alias("y"))
    weights = lambda s: {r["label"]: r["weight"] for r in profile.class_weights(df, "y", s).collect()}
    balanced, damped, capped = weights("balanced"), weights("sqrt_balanced"), weights("capped_balanced")
    assert balanced[6] / balanced[0] > 900 and 20 < damped[6] / damped[0] < 50 and capped[6] <= 25
    assert set(weights("unweighted").values()) == {1.0}
    assert profile.with_sample_weights(df, "y").count() == 1011


def test_dataset_profile(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert profile.dataset_profile(df).first().asDict() == {"n_rows": 3, "n_columns": 2, "missing_cells": 2, "duplicate_rows": 1}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "x double, label string, key long")
    assert dedup.purge_and_dedup(df, ["x"], "label", "key").count() == 0
    assert profile.dataset_profile(df).first()["n_rows"] == 0
    assert clean.clean_funnel(df, "label", ["x"], ["a"]).first()["initial_rows"] == 0
    assert profile.class_weights(df, "label").count() == 0
