"""Settings, names, configuration and delivery."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from packetloom import streaming
from packetloom.functions import row_digest
from packetloom.operators import clean, rules, score, splits, taxonomy, train
from packetloom.sources import files


def test_raw_integer_labels_give_way_to_names(spark):
    raw = spark.createDataFrame([(i, i - 1, n) for i, n in enumerate(("Normal", "ARP_Storm", "SYN_Flood", "PING_Flood", "ARP_Spoofing"), 1)], "frame_number int, label int, label_name string")
    label = taxonomy.label_column(raw.columns)
    rows = taxonomy.map_labels(raw, taxonomy.label_map("ARP"), label, robust=True).orderBy("frame_number").collect()
    assert label == "label_name" and [r["final_label"] for r in rows] == ["Benign", "DoS", "DoS", "DoS", "ARP Spoofing"]


def test_no_label_leaks(spark):
    raw = spark.createDataFrame([(0.5, "1", "2", "3", "x", "y", "z", "u", "v", "Benign")], "some_metric double, Src_IP string, Dst_IP string, Dst_MAC string, Attack_Type string, attack string, Attack_Cat string, sub_cat string, Label string, final_label string")
    assert clean.fiveg_columns(raw).columns == ["some_metric", "final_label"]
    arp = spark.createDataFrame([(1, "m", 2, 3, 4, "n", "Benign")], "frame_number int, arp_src_hw_mac string, tcp_seq int, tcp_hdr_len int, frame_len int, label_name string, final_label string")
    assert clean.arp_columns(arp).columns == ["frame_number", "tcp_seq", "tcp_hdr_len", "final_label"]
    assert clean.suspicious_columns(["Target", "SourceIP", "Timestamp", "Dst Port", "NormalFeature"], "Target") == ["SourceIP", "Timestamp", "Dst Port"]


@pytest.mark.parametrize(("alias", "own"), [("ids", "IDS2018"), ("Model_A", "IDS2018"), ("model_b1", "CICIoT2023"), ("arpspoofing", "ARP_Spoofing"), ("5g_nidd", "IP_Spoofing"), ("DNSTunneling", "DNS_Tunneling")])
def test_specialist_names(alias, own):
    assert taxonomy.specialist(alias) == own


@pytest.mark.parametrize(("alias", "own"), [("rf", "RandomForest"), ("candidate_xgb_tuned", "XGBoost_Tuned"), ("dt_tuned", "DecisionTree_Tuned"), ("hgb", "HistGradientBoosting"), ("candidate_ExtraTrees", "ExtraTrees"), ("xgboost_unweighted", "XGBoost_Unweighted"), (" other ", "other")])
def test_model_names(alias, own):
    assert train.model_name(alias) == own


def test_model_settings():
    forest = train.classifier("RandomForest")
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getSubsamplingRate(), forest.getFeatureSubsetStrategy()) == (30, 12, 10, 0.25, "sqrt")
    tuned = train.classifier("rf_tuned")
    assert (tuned.getNumTrees(), tuned.getMaxDepth(), tuned.getSubsamplingRate()) == (40, 18, 0.4)
    extra = train.classifier("ExtraTrees")
    assert (extra.trees, extra.depth, extra.leaf, extra.features) == (60, 20, 3, None)
    boosted = train.classifier("XGBoost_Tuned")
    assert (boosted.rounds, boosted.depth, boosted.step, boosted.share, boosted.features, boosted.patience) == (80, 7, 0.1, 0.8, 0.8, None)
    hist = train.classifier("HistGradientBoosting")
    assert (hist.rounds, hist.leaves, hist.depth, hist.step, hist.leaf, hist.patience, hist.held_out) == (150, 63, None, 0.08, 20, 10, 0.1)
    candidate = train.classifier("HistGradientBoosting_Candidate")
    assert (candidate.rounds, candidate.leaves, candidate.step, candidate.leaf, candidate.patience) == (60, 31, 0.1, 50, 5)


def test_gates():
    good = {"accuracy": 0.96, "macro_f1": 0.75}
    assert train.passes_gates("CICIoT2023", "XGBoost", good) and not train.passes_gates("CICIoT2023", "XGBoost_Tuned", good) and not train.passes_gates("IDS2018", "DecisionTree", good)
    best = {"accuracy": 0.99, "macro_f1": 0.76}
    assert train.passes_gates("CICIoT2023", "xgb_tuned", best) and not train.passes_gates("CICIoT2023", "xgb_tuned", best, {"macro_f1": 0.77}) and train.passes_gates("CICIoT2023", "xgb_tuned", best, {"macro_f1": 0.78})
    assert train.passes_gates("DNS_Tunneling", "DecisionTree", {"accuracy": 0.1, "macro_f1": 0.1})


@pytest.mark.parametrize(("cached", "rows", "stale"), [(10, 11, True), (999, 1000, True), (40, 90, False), (49, 101, True), (5000, 9000, False), (4000, 9000, True), (5, 0, False), (5, None, False)])
def test_stale_checkpoints(cached, rows, stale):
    assert train.is_stale(cached, rows) is stale


def test_expected_classes(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, label string")
    pre = score.Preprocessor.fit(df, ["x"], ["a", "b"])
    pre.validate(["b", "a"])
    for classes, strict in ((["a"], False), (["b", "a"], True)):
        with pytest.raises(ValueError, match="expected"):
            pre.validate(classes, strict)


def test_registry_order(spark, tmp_path):
    for name in ("candidate_DecisionTree_Tuned", "DecisionTree", "RandomForest"):
        os.makedirs(tmp_path / "IDS2018" / name)
    root = f"{tmp_path}/IDS2018"
    assert train.find_model(spark, root, "ids", None) == ("DecisionTree_Tuned", f"{root}/candidate_DecisionTree_Tuned")
    assert train.find_model(spark, root, "ids", "RandomForest") == ("RandomForest", f"{root}/RandomForest")
    assert train.find_model(spark, root, "ids", "XGBoost_Tuned") == ("DecisionTree", f"{root}/DecisionTree")
    with pytest.raises(FileNotFoundError):
        train.find_model(spark, f"{tmp_path}/other", "ids", None)


def test_configuration(spark, tmp_path):
    os.makedirs(tmp_path / "config")
    (tmp_path / "config" / "label_mapping.json").write_text(json.dumps({"arp": {"Normal": "Benign"}}, indent=1))
    assert files.read_config(spark, "config/label_mapping.json", "/data", f'"{tmp_path}"') == {"arp": {"Normal": "Benign"}}
    with pytest.raises(FileNotFoundError):
        files.read_config(spark, "config/other.json", None, str(tmp_path))
    at = lambda p: files.resolve_path(p, "/d/", "/p")
    assert at("config/a.json") == "/p/config/a.json" and at("data/processed/IDS2018") == "/d/processed/IDS2018" and at("data/samples") == "/d/samples"
    assert at("Datasets/CICIOT23") == "/d/raw/CICIoT2023" and at("x/ids2018_combined_7attacks_benign.parquet") == "/d/raw/IDS2018/ids2018_combined_7attacks_benign.parquet"
    assert at("data/raw/ids2018_combined_7attacks_benign.parquet") == "/d/raw/IDS2018/ids2018_combined_7attacks_benign.parquet" and at("data/processed_old/x") == "/d/data/processed_old/x"
    assert at("data/processed/IDS2018/ids2018_combined_7attacks_benign.parquet") == "/d/processed/IDS2018/ids2018_combined_7attacks_benign.parquet" and at("./processed/IDS2018/train.parquet") == "/d/processed/IDS2018/train.parquet"
    assert at("checkpoints/progress.json") == "/d/checkpoints/progress.json" and at("data/processed/additional/ARP_Spoofing") == "/d/processed/additional/ARP_Spoofing" and at("raw/CICIOT23") == "/d/raw/CICIoT2023"
    assert at("raw/additional/x") == "/d/raw/additional/x" and at("reports") == "/d/reports" and at("s3a://b/k") == "s3a://b/k" and files.resolve_path("reports", None, "/p") == "/p/reports"


def test_training_status(spark, tmp_path):
    progress = files.Progress(spark, f"{tmp_path}/progress")
    progress.update(model_training={"ARP": "done", "DNS": 3})
    assert progress.status("ARP", "rf") == "not_started"
    progress.trained("ARP", "rf", "completed")
    assert progress.status("ARP", "rf") == "completed" and progress.read()["model_training"]["ARP"]["status"] == "done" and progress.status("DNS", "rf") == "not_started"
    assert progress.read()["checkpoints"] == {"arp_model_training_status": "completed"}


def test_transmission():
    waits: list[float] = []
    answers = iter([500, OSError(), 200])

    def send(payload):
        assert payload["batch_size"] == 1
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    one = [{"x": 1}]
    assert streaming.transmit(send, "s", one, wait=waits.append) and waits == [0.5, 1.0]
    for status, pauses in ((401, 0), (403, 0), (500, 3)):
        waits.clear()
        assert not streaming.transmit(lambda p: status, "s", one, wait=waits.append) and len(waits) == pauses  # noqa: B023
    assert streaming.transmit(send, "s", [])


def test_ranges_give_the_same_ranks(spark, monkeypatch):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), F.lit(1).alias("_other"))
    rows = {r["id"]: (r["_rn"], r["_n"]) for r in splits.ranked(df, "label", "id", 7).collect()}
    monkeypatch.setattr(splits, "DEALT", 1)
    assert rows == {r["id"]: (r["_rn"], r["_n"]) for r in splits.ranked(df, "label", "id", 7).collect()}
    for wanted in (lambda i: i % 10 == 0, lambda i: i % 10 and i % 3 == 0):
        ranks = sorted(rows[i][0] for i in range(3000) if wanted(i))
        assert ranks == list(range(1, len(ranks) + 1)) and {rows[i][1] for i in range(3000) if wanted(i)} == {len(ranks)}


def test_rules_look_at_places(spark):
    base = "1.0 AS ts, 'a' AS src_ip, 'b' AS dst_ip, 17 AS proto, 0 AS tcp_flags, 40 AS dst_port"
    ntp = spark.sql(f"SELECT *, 123 AS src_port FROM (SELECT {base}), VALUES (0, unhex('1700032a')), (1, unhex('001700032a')) t(i, bytes)").withColumn("payload", F.decode("bytes", "ISO-8859-1"))
    assert [r["i"] for r in rules.match_packets(ntp, (9000011,)).collect()] == [0]
    dns = spark.sql(f"SELECT *, 53 AS src_port FROM (SELECT {base}), VALUES (unhex('0000818000010001')), (unhex('0000000000010001')), (unhex('8180000000010001')) t(bytes)").withColumn("payload", F.decode("bytes", "ISO-8859-1"))
    assert [r["hits"] for r in rules.rate_alerts(dns, sids=(9000071,), scale=(1, 1)).collect()] == [1]
    replies = spark.sql(f"SELECT *, 53 AS src_port, 0 AS dns_rcode FROM (SELECT {base}), VALUES (0), (0), (5) t(dns_opcode)")
    assert [r["hits"] for r in rules.rate_alerts(replies, sids=(9000070,), scale=(1, 1)).collect()] == [2]


def test_connection_columns(spark):
    df = spark.createDataFrame([(0, "1.2.3.4", "17", None), (255, None, "tcp", "99"), (1, "x", None, "7.0")], "n long, Source_IP string, Protocol string, DPort string")
    rows = {r["n"]: tuple(r[c] for c in taxonomy.CONNECTION) for r in taxonomy.connection_columns(df, "n").collect()}
    assert rows == {0: ("1.2.3.4", "192.168.1.100", 40000, 80, 17), 255: ("10.0.2.2", "192.168.1.100", 40255, 99, 6), 1: ("x", "192.168.1.100", 40001, 7, 6)}


def test_digests_tell_values_apart(spark):
    df = spark.createDataFrame([("a,b", "c"), ("a", "b,c"), (None, "c"), ("-", "c"), ("", "c")], "x string, y string")
    assert df.select(row_digest("x", "y").alias("d")).distinct().count() == 5
