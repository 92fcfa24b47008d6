from __future__ import annotations

import pytest
from pyspark.sql import types as T

from packetloom.sources import files


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("label,x\nBenign,1.5\n")
    (tmp_path / "b.csv").write_text("label,x\nBot,2.5\n")
    schema = "label string, x double"
    assert files.read_files(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv", f"{tmp_path}/none.csv"], schema).count() == 2
    with pytest.raises(FileNotFoundError, match="0 valid rows"):
        files.read_files(spark, [f"{tmp_path}/none.csv"], schema)
    (tmp_path / "dns.csv").write_text("1,www.a.com\n0,b\n")
    assert files.read_headerless(spark, f"{tmp_path}/dns.csv", ["label", "query"]).first().asDict() == {"label": "1", "query": "www.a.com"}
    (tmp_path / "bad.csv").write_text("label,x\nBenign,abc\n")
    with pytest.raises(Exception):
        files.read_csv(spark, f"{tmp_path}/bad.csv", schema).collect()
    assert files.preview_csv(spark, f"{tmp_path}/bad.csv").first()["x_number"] is None


def test_json_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    df = files.read_json(spark, f"{tmp_path}/a.json")
    assert df.count() == 2
    assert files.write_table(df, f"{tmp_path}/t") and not files.write_table(df, f"{tmp_path}/t", force=False)
    files.write_report(df, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2
    assert files.export_json(df).first()["value"] == '{"x":1}'


def test_pinned_schema(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    schema = T.StructType([T.StructField("a", T.FloatType()), T.StructField("b", T.IntegerType())])
    assert files.pinned(df, schema).columns == ["a", "b"]
    with pytest.raises(ValueError, match="mismatch"):
        files.pinned(df.drop("a"), schema)


def test_progress(spark, tmp_path):
    progress = files.Progress(spark, f"{tmp_path}/progress")
    assert progress.read() == {}
    progress.update(ids2018="done")
    assert progress.update(dns="done") == {"ids2018": "done", "dns": "done"}
    spark.createDataFrame([("[1]",)], "value string").write.mode("overwrite").text(f"{tmp_path}/progress")
    assert progress.read() == {}
