"""Exact duplicates, label conflicts and overlaps, always by the feature columns themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _cols(names: Sequence[str]) -> list[str]:
    return [f"`{c}`" for c in names]


def conflict_groups(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Feature vectors with more than one label: the features, n_labels, n_rows."""
    groups = df.groupBy(*_cols(features)).agg(F.count_distinct(label).alias("n_labels"), F.count(F.lit(1)).alias("n_rows"))
    return groups.where("n_labels > 1")


def purge_and_dedup(df: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
    """Rows of vectors with one label only, of each vector the row with the smallest key.  One shuffle."""
    group = Window.partitionBy(*_cols(features))
    marked = df.withColumns({"_lo": F.min(label).over(group), "_hi": F.max(label).over(group), "_first": F.row_number().over(group.orderBy(key))})
    return marked.where("_lo = _hi and _first = 1").drop("_lo", "_hi", "_first")


def dedup(df: DataFrame, features: Sequence[str], key: str | None = None) -> DataFrame:
    """One row for each vector; with a key, the row with the smallest."""
    if key is None:
        return df.dropDuplicates(list(features))
    order = Window.partitionBy(*_cols(features)).orderBy(key)
    return df.withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first")


def without(df: DataFrame, known: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose vector is not in known."""
    return df.join(known.select(*_cols(features)).distinct(), list(features), "left_anti")


def within(df: DataFrame, known: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.join(known.select(*_cols(features)).distinct(), list(features), "left_semi")


def shared_vectors(a: DataFrame, b: DataFrame, features: Sequence[str]) -> DataFrame:
    return a.select(*_cols(features)).intersect(b.select(*_cols(features)))


def label_pairs(a: DataFrame, b: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Every pair of labels that a shared vector has on both sides: the features, label_1, label_2."""
    x = a.select(*_cols(features), F.col(label).alias(f"{label}_1")).distinct()
    y = b.select(*_cols(features), F.col(label).alias(f"{label}_2")).distinct()
    return x.join(y, list(features))


def overlap_report(df: DataFrame, split: str, names: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """For each pair of splits (values of a column): shared vectors, their share of either side in percent, and pairs of
    equal and of different labels.  One pass over the table, one shuffle by vectors."""
    by_vector = df.groupBy(*_cols(features)).agg(*[F.collect_set(F.when(F.col(split) == name, F.col(label))).alias(f"_{name}") for name in names])
    size = lambda name: F.size(f"_{name}")
    rows = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shared = F.coalesce((size(a) > 0) & (size(b) > 0), F.lit(False))
            same = F.size(F.array_intersect(f"_{a}", f"_{b}"))
            rows.append(F.struct(F.lit(f"{a}-{b}").alias("pair"), F.count_if(shared).alias("shared"), F.count_if(size(a) > 0).alias("left_vectors"), F.count_if(size(b) > 0).alias("right_vectors"),
                                 F.coalesce(F.sum(same), F.lit(0)).alias("same_label_pairs"), F.coalesce(F.sum(size(a) * size(b) - same), F.lit(0)).alias("conflicting_pairs")))
    out = by_vector.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    percent = lambda n: F.round(F.coalesce(F.try_divide(F.col("shared") * 100.0, F.col(n)), F.lit(0.0)), 4)
    return out.withColumns({"left_percent": percent("left_vectors"), "right_percent": percent("right_vectors")})
