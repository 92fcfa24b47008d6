"""Feature statistics: constants, variance, correlation, scaler values, class weights, data set profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import finite, quantiles

QUASI_CONSTANT, CORRELATED = 0.999, 0.98
WEIGHTS = ("unweighted", "balanced", "sqrt_balanced", "capped_balanced", "effective_samples")


def _name(c: str) -> str:
    return c.replace("`", "")


def unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value of each row and column."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n_distinct, is_constant: exact distinct counts in one pass over an aggregate."""
    counts = unpivot(df, columns).groupBy("feature").agg(F.count_distinct("value").alias("n_distinct"))
    return counts.withColumn("is_constant", F.col("n_distinct") <= 1)


def variance_rank(df: DataFrame, columns: Sequence[str], top: int = 20) -> DataFrame:
    """rank, feature, variance (sample) of the features of largest variance; ties by name."""
    row = df.agg(*[F.var_samp(F.col(f"`{c}`").cast("double")).alias(c) for c in columns])
    ranked = unpivot(row, columns).select("feature", F.coalesce("value", F.lit(0.0)).alias("variance")).orderBy(F.desc("variance"), "feature").limit(top)
    from pyspark.sql.window import Window

    return ranked.select(F.row_number().over(Window.orderBy(F.desc("variance"), "feature")).alias("rank"), "feature", "variance")  # at most top rows


def quasi_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, dominant_share, is_quasi_constant: share of the most frequent value among those that aren't null."""
    counts = unpivot(df, columns).where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("dominant_share"), F.count(F.lit(1)).alias("n_distinct"))
    return shares.select("feature", "dominant_share", ((F.col("dominant_share") >= QUASI_CONSTANT) & (F.col("n_distinct") > 1)).alias("is_quasi_constant"))


def _correlation(a: str, b: str) -> Column:
    """Pearson's, over rows where both are there; null where either does not vary."""
    x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def correlations(df: DataFrame, columns: Sequence[str], least: float = CORRELATED) -> DataFrame:
    """feature_1, feature_2, correlation (absolute, over all rows) of pairs above least.  Constant columns have none."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_1 string, feature_2 string, correlation double")
    varies = {c: (F.max(f"`{c}`") > F.min(f"`{c}`")).alias(f"_v{i}") for i, c in enumerate(columns)}
    at = {c: i for i, c in enumerate(columns)}
    row = df.agg(*varies.values(), *[_correlation(a, b).alias(f"_c{at[a]}_{at[b]}") for a, b in pairs])
    entries = [F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.when(F.col(f"_v{at[a]}") & F.col(f"_v{at[b]}"), F.abs(f"_c{at[a]}_{at[b]}")).alias("correlation")) for a, b in pairs]
    return row.select(F.inline(F.array(*entries))).where(F.col("correlation") > least)


def scaler_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, median, mean, std: mean and population deviation after missing values are the median; a deviation of
    0 is 1, a median of nothing 0.  The medians are found by distributed selection when this is called."""
    xs = [finite(F.col(f"`{c}`")) for c in columns]
    medians = quantiles(df, dict(zip(columns, xs, strict=True)), [0.5])
    moments = df.agg(*[x for i, c in enumerate(xs) for x in (F.count(c).alias(f"_n{i}"), F.avg(c).alias(f"_a{i}"), F.var_pop(c).alias(f"_v{i}"))], F.count(F.lit(1)).alias("_rows"))

    def entry(i: int, c: str) -> Column:
        median, n, mean, var = F.lit(medians[c][0] or 0.0), F.col(f"_n{i}"), F.coalesce(f"_a{i}", F.lit(0.0)), F.coalesce(f"_v{i}", F.lit(0.0))
        share = F.coalesce(F.try_divide(n, F.col("_rows")), F.lit(0.0))
        filled = mean * share + median * (1 - share)
        spread = var * share + share * (mean - filled) * (mean - filled) + (1 - share) * (median - filled) * (median - filled)
        std = F.sqrt(F.greatest(spread, F.lit(0.0)))
        return F.struct(F.lit(c).alias("feature"), median.alias("median"), filled.alias("mean"), F.when(std > 0, std).otherwise(1.0).alias("std"))

    return moments.select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)])))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str, strategy: str = "sqrt_balanced", max_weight: float = 25.0, beta: float = 0.999) -> DataFrame:
    """label, n, weight: a row for each label."""
    if strategy not in WEIGHTS:
        raise ValueError(f"unknown strategy: {strategy}")
    from pyspark.sql.window import Window

    every = Window.partitionBy()  # over the labels only
    n, total, k = F.col("n"), F.sum("n").over(every), F.count(F.lit(1)).over(every)
    inverse = total / (k * n)
    raw = {
        "unweighted": F.lit(1.0), "balanced": inverse, "capped_balanced": F.least(inverse, F.lit(max_weight)), "sqrt_balanced": F.sqrt(inverse),
        "effective_samples": F.lit(1.0 - beta) / F.greatest(1.0 - F.pow(F.lit(beta), n), F.lit(1e-8)),
    }[strategy]
    out = class_counts(df, label).withColumn("weight", raw)
    return out.withColumn("weight", F.col("weight") / F.avg("weight").over(every)) if strategy in ("sqrt_balanced", "effective_samples") else out


def with_sample_weights(df: DataFrame, label: str, strategy: str = "sqrt_balanced") -> DataFrame:
    weights = class_weights(df, label, strategy).select(F.col("label").alias("_label"), F.col("weight").cast("float").alias("sample_weight"))
    return df.join(F.broadcast(weights), df[label].eqNullSafe(weights["_label"]), "left").drop("_label")  # a row for each class


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows."""
    missing = sum((F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    by_row = df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"), F.sum(missing).alias("_missing"))
    return by_row.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_cells"), F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))
