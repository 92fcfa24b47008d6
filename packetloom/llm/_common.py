"""What the operators of this subpackage share: the folder for written tables, and checks of bounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only on a local master, where it may be unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="checkpoint-"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and the
    files outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id"):
    """crc32 of an id's decimal text; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Words of 64 bits of a membership filter: its size is bounded whatever it knows.
FILTER_WORDS = 1 << 18


def _bit_of(hash_: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hash_, 58).cast("int"))


def known_words(hashes: DataFrame, column: str) -> DataFrame:
    """_word, _bits: a filter that knows all 64-bit hashes of a column (and some others); FILTER_WORDS rows at most."""
    return hashes.groupBy(F.pmod(F.col(column), F.lit(FILTER_WORDS)).cast("long").alias("_word")).agg(F.bit_or(_bit_of(F.col(column))).alias("_bits"))


def maybe_known(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Rows of df whose hash a filter may know.  It spares most others a shuffle; what it lets pass is joined exactly."""
    near = df.withColumn("_at", F.pmod(F.col(column), F.lit(FILTER_WORDS)).cast("long")).join(F.broadcast(words), F.col("_at") == F.col("_word"))
    return near.where(F.col("_bits").bitwiseAND(_bit_of(F.col(column))) != 0).select(*df.columns)
