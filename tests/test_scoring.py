from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from packetloom.operators import metrics, score, splits, taxonomy, train


def test_taxonomy(spark):
    assert len(taxonomy.CLASSES) == 13 and "MAC Spoofing" not in taxonomy.CLASSES
    assert [r["class_id"] for r in taxonomy.class_dim(spark).orderBy("class_id").collect()] == list(range(13))
    assert taxonomy.specialist_dim(spark).count() == 24 and taxonomy.label_dim(spark).count() == 58


@pytest.mark.parametrize("name", list(taxonomy.SPECIALISTS))
def test_projection(spark, name):
    n = len(taxonomy.SPECIALISTS[name])
    p = [(i + 1) / (n * (n + 1) / 2) for i in range(n)]
    out = spark.createDataFrame([(p, name)], "p array<double>, s string").select(taxonomy.project_posterior(F.col("p"), name).alias("q"), taxonomy.project_by_column(F.col("p"), F.col("s")).alias("r")).first()
    assert out["q"] == out["r"] and len(out["q"]) == 13 and sum(out["q"]) == pytest.approx(1.0)
    assert {taxonomy.CLASSES[i] for i, x in enumerate(out["q"]) if x} == set(taxonomy.SPECIALISTS[name])


@pytest.mark.parametrize(("columns", "expected"), [(("query",), "DNS_Tunneling"), (("query_length", "num_dots", "entropy"), "DNS_Tunneling"), (("frame_number", "arp_opcode"), "ARP_Spoofing"), (("Tot Fwd Pkts",), "IDS2018"), (("Rate", "Srate"), "CICIoT2023"), (("gtp.teid",), "IP_Spoofing")])
def test_routing(spark, columns, expected):
    assert taxonomy.route_schema(columns) == expected
    row = spark.range(1).select(taxonomy.route_row(F.array(*[F.lit(c) for c in columns])).alias("s")).first()
    assert row["s"] == expected


def test_routing_errors():
    with pytest.raises(ValueError):
        taxonomy.route_schema(["a", "b"])
    long = ["Flow Duration", "Total Fwd Packets"]
    with pytest.raises(ValueError):
        taxonomy.route_schema(long)
    assert taxonomy.route_schema(long, both_spellings=True) == "IDS2018"
    with pytest.raises(ValueError):
        taxonomy.reject_mac(["machine"])
    assert taxonomy.specialist("DNS") == "DNS_Tunneling"


def test_metric_identities(spark):
    df = spark.range(700).select((F.col("id") % 7).cast("int").alias("true_id"), F.when(F.col("id") < 140, 0).otherwise(F.col("id") % 7).cast("int").alias("pred_id"))
    cells = metrics.confusion_matrix(df, 7)
    assert cells.count() == 49 and cells.agg(F.sum("n")).first()[0] == 700
    by = {r["class_id"]: r for r in metrics.per_class(df, 7).collect()}
    assert by[0]["precision"] == pytest.approx(100 / 220) and by[1]["recall"] == pytest.approx(0.8) and by[0]["fp"] == 120
    one = metrics.summary(df, 7).first()
    assert one["accuracy"] == pytest.approx(580 / 700) and one["total"] == 700


def test_empty_metrics(spark):
    df = spark.createDataFrame([], "true_id int, pred_id int")
    assert metrics.summary(df, 3).first()["accuracy"] == 0.0
    assert metrics.threat_summary(df).first()["detection_rate"] == 0.0


def test_threshold_tuning(spark):
    rows = [(0, [0.9, 0.1])] * 70 + [(0, [0.48, 0.52])] * 30 + [(1, [0.15, 0.85])] * 20
    df = spark.createDataFrame(rows, "true_id int, p array<double>").cache()
    found = score.tune_thresholds(df, "p", "true_id", 2)
    assert found["optimized"]["macro_f1"] > found["baseline"]["macro_f1"] and found["multipliers"][0] > 1
    grid = {r["multiplier"]: r for r in score.threshold_grid(df, "p", "true_id", 2).collect()}
    assert grid[1.0]["benign_fpr"] == pytest.approx(0.3) and grid[1.25]["benign_fpr"] == 0.0


def test_argmax_takes_first(spark):
    row = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.0, 0.0, 0.0],)], "p array<double>").select(score.argmax(F.col("p")).alias("i"), score.rescaled(F.col("p"), [1, 1, 1]).alias("q")).collect()
    assert row[0]["i"] == 0 and row[1]["q"] == [0.0, 0.0, 0.0]


def test_training(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("key"), (F.col("id") % 2).cast("double").alias("gtp.teid"), F.rand(1).alias("noise"), F.when(F.col("id") % 2 == 0, "Benign").otherwise("IP Spoofing").alias("final_label")).cache()
    found = train.train_specialist("5g", df, df, df, ["gtp.teid", "noise"], taxonomy.SPECIALISTS["IP_Spoofing"], models=("DecisionTree", "RandomForest"), screen=df.limit(100), top_k=1)
    assert found["passed_gates"] and found["test"]["accuracy"] == 1.0 and len(found["validation"]) == 1
    train.save(found, str(tmp_path / "IP_Spoofing"))
    registry = train.Registry(spark, str(tmp_path))
    out = registry.score(df.drop("final_label", "key")).collect()
    assert len(out) == 400 and {r["specialist"] for r in out} == {"IP_Spoofing"} and {r["canonical_id"] for r in out} == {0, 8}
    assert all(sum(r["posterior"]) == pytest.approx(1.0) and len(r["posterior"]) == 13 for r in out)


def test_boosted_model_has_posteriors(spark, tmp_path):
    df = spark.range(120).select((F.col("id") % 3).cast("double").alias("x"), F.rand(2).alias("y"), F.element_at(F.array(F.lit("Benign"), F.lit("ARP Spoofing"), F.lit("DoS")), (F.col("id") % 3 + 1).cast("int")).alias("final_label")).cache()
    pre = score.Preprocessor.fit(df, ["x", "y"], taxonomy.SPECIALISTS["ARP_Spoofing"])
    model = train.fit(df, pre, "final_label", "HistGradientBoosting", smoke=True)
    assert train.evaluate(df, pre, model, "final_label")["accuracy"] == 1.0
    found = {"specialist": "ARP_Spoofing", "best_model": "HistGradientBoosting", "model": model, "preprocessor": pre, "multipliers": None}
    train.save(found, str(tmp_path / "ARP_Spoofing"))
    again = train.load(spark, str(tmp_path / "ARP_Spoofing"))
    assert again["model"] == model and train.evaluate(df, again["preprocessor"], again["model"], "final_label")["accuracy"] == 1.0


def test_stale_results_are_fitted_again(spark):
    df = spark.range(300).select(F.col("id").alias("key"), (F.col("id") % 2).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "Benign").otherwise("IP Spoofing").alias("final_label")).cache()
    old = {"accuracy": 0.5, "macro_f1": 0.5}
    train_on = lambda rows: train.train_specialist("5g", df, df, df, ["x"], taxonomy.SPECIALISTS["IP_Spoofing"], models=("DecisionTree",), done={"DecisionTree": old | {"train_rows": rows}})["validation"]
    assert train_on(10)["DecisionTree"]["accuracy"] == 1.0 and train_on(100)["DecisionTree"]["train_rows"] == 300  # a stub, and less than half
    assert train_on(200)["DecisionTree"]["accuracy"] == 0.5


def test_smoke_splits_and_caps(spark):
    made = splits.load_splits(None, None, None, "train_test", "final_label", "key", smoke=lambda: splits.smoke_splits(spark, ["a", "b.c"], ["Benign", "DoS", "MITM"]))
    assert {n: df.count() for n, df in made.items()} == {"train": 210, "val": 45, "test": 45} and made["train"].columns == ["key", "a", "b.c", "final_label"]
    with pytest.raises(FileNotFoundError):
        splits.load_splits(None, None, None, "train_test", "final_label", "key")
    rows = spark.range(10_001)
    assert score.checked_batch(rows.limit(10_000)).count() == 10_000 and score.first_rows(rows, "id").agg(F.max("id")).first()[0] == 999
    for bad in (rows, rows.limit(0)):
        with pytest.raises(ValueError):
            score.checked_batch(bad)


def test_mixed_batches_keep_their_order(spark):
    records = spark.createDataFrame([(i, {name: 1.0}) for i, name in enumerate(["Rate", "query_length", "zzz", "query_length"])], "id int, features map<string,double>").repartition(3)
    scorer = lambda i: lambda df: df.withColumns({"canonical_id": F.lit(i), "confidence": F.lit(0.5)})
    scored = score.score_mixed(records, {"CICIoT2023": scorer(1), "DNS_Tunneling": scorer(12)}, order="id")
    assert [r["canonical_id"] for r in scored.collect()] == [1, 12, None, 12]
    label = lambda ids: score.batch_label(scored.where(F.col("id").isin(ids)).withColumn("batch", F.lit(1)), "batch").first()["specialist"]
    assert (label([0, 1, 2]), label([1, 3]), label([2])) == (score.MULTI, "DNS_Tunneling", None)
