"""File sources and sinks on Spark's own readers, so that any store that Spark reads will do."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """CSV of a pinned schema; a row that doesn't fit it is an error.  Without a schema all columns are text."""
    reader = spark.read.option("header", header).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(list(path) if not isinstance(path, str) else path)


def read_headerless(spark: SparkSession, path: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """CSV without a header; columns by position, all text."""
    return read_csv(spark, path, ", ".join(f"`{n}` string" for n in names), header=False)


def read_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """The union of a split's files; missing ones are skipped with a warning, and none at all is an error."""
    there = [p for p in paths if exists(spark, p)]
    for p in set(paths) - set(there):
        log.warning("missing file skipped: %s", p)
    if not there:
        raise FileNotFoundError(f"resulted in 0 valid rows: none of {list(paths)} is there")
    return read_csv(spark, there, schema, header)


def read_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return spark.read.option("multiLine", multiline).json(path)


def preview_csv(spark: SparkSession, path: str, rows: int = 50) -> DataFrame:
    """The first rows of a file, values numeric where they can be."""
    df = spark.read.option("header", True).csv(path).limit(rows)
    return df.withColumns({f"{c}_number": F.col(f"`{c}`").try_cast("double") for c in df.columns})


def pinned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in the order and types of schema; other columns than its own are an error."""
    if set(df.columns) != set(schema.names):
        raise ValueError(f"schema mismatch: {sorted(set(df.columns) ^ set(schema.names))}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def write_table(df: DataFrame, path: str, force: bool = True) -> bool:
    """Parquet by an atomic commit; without force an existing table is kept.  Whether it was written."""
    if not force and exists(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_report(df: DataFrame, path: str) -> None:
    """A report's few rows as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def export_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


# --- fixed values: places below the project and below the data ---------------------------------------
PROJECT_PLACES = ("config", "utils", "tests", "notebooks", "README.md", "app.py", "requirements.txt")
#: A file that is known by its name, and a folder by several.
IDS2018_FILE, IDS2018_PLACE = "ids2018_combined_7attacks_benign.parquet", "raw/IDS2018"
CICIOT2023_PLACE, CICIOT2023_NAMES = "raw/CICIoT2023", ("Datasets/CICIOT23", "raw/CICIoT2023", "Datasets/CICIoT2023", "raw/CICIOT23")


def resolve_path(path: str, data_root: str | None = None, project_root: str = ".") -> str:
    """Where a relative path of the configuration lies: project files below project_root, all others below data_root (if
    there is one), data/processed and data/samples without their first part, raw data sets in their own folders whatever names
    lead there.  Paths with a scheme and absolute ones stay."""
    if "://" in path or path.startswith("/"):
        return path
    clean = lambda root: root.strip().strip("\"'").rstrip("/")
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    rel = "/".join(parts)
    if not data_root or parts[:1] and parts[0] in PROJECT_PLACES:
        return f"{clean(project_root) or '.'}/{rel}"
    if parts[:2] in (["data", "processed"], ["data", "samples"]):
        rel = "/".join(parts[1:])
    elif parts[:1] != ["processed"] and parts[-1:] == [IDS2018_FILE]:
        rel = f"{IDS2018_PLACE}/{IDS2018_FILE}"
    elif rel in CICIOT2023_NAMES:
        rel = CICIOT2023_PLACE
    return f"{clean(data_root)}/{rel}"


def read_config(spark: SparkSession, path: str, data_root: str | None = None, project_root: str = ".") -> dict:
    """A JSON object of the configuration, such as the label mapping, from any store that Spark reads."""
    place = resolve_path(path, data_root, project_root)
    if not exists(spark, place):
        raise FileNotFoundError(place)
    found = json.loads(spark.read.text(place, wholetext=True).first()[0])
    if not isinstance(found, dict):
        raise ValueError(f"not an object: {place}")
    return found


class Progress:
    """Finished steps as JSON in a text table; anything unreadable counts as no progress."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> dict:
        if not exists(self.spark, self.path):
            return {}
        try:
            found = json.loads(self.spark.read.text(self.path).first()[0])
        except (ValueError, TypeError):
            return {}
        return found if isinstance(found, dict) else {}

    def trained(self, dataset: str, model: str, status: str) -> dict:
        """Notes a model's status under its data set; what isn't an object there is replaced."""
        now = self.read()
        by_model = lambda x: x if isinstance(x, dict) else {"status": x} if isinstance(x, str) else {}
        all_sets = now.get("model_training") if isinstance(now.get("model_training"), dict) else {}
        all_sets[dataset] = by_model(all_sets.get(dataset)) | {model: status}
        checkpoints = now.get("checkpoints") if isinstance(now.get("checkpoints"), dict) else {}
        return self.update(model_training=all_sets, checkpoints=checkpoints | {f"{dataset.lower()}_model_training_status": status})

    def status(self, dataset: str, model: str) -> str:
        found = self.read().get("model_training")
        found = found.get(dataset) if isinstance(found, dict) else None
        return str(found.get(model, "not_started")) if isinstance(found, dict) else "not_started"

    def update(self, **steps) -> dict:
        now = self.read() | steps
        self.spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(self.path)
        return now
