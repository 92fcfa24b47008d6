"""Preprocessing and scoring: scaler, encoder, thresholds, batches of several schemas."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profile
from .quantiles import finite
from .taxonomy import CLASSES, reject_mac, route_row

# --- fixed values: multipliers that are tried ------------------------------------------------------
BENIGN_SCALES = (1.0, 1.1, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0)
MINORITY_SCALES = (1.0, 1.25, 1.5, 2.0, 3.0, 5.0)
CLOSE_F1, LOW_RECALL, ACCURACY_DROP = 0.005, 0.85, 0.02


@dataclass
class Preprocessor:
    """Medians, means and deviations of named features and the order of classes; fitted on training rows only."""

    features: list[str]
    classes: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    stds: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str], classes: Sequence[str]) -> Preprocessor:
        rows = profile.scaler_statistics(train, features).collect()  # a row for each feature
        return cls(list(features), list(classes), *({r["feature"]: r[c] for r in rows} for c in ("median", "mean", "std")))

    def validate(self, expected: Sequence[str] | None = None, strict_order: bool = False) -> None:
        """Raises unless the contract holds: fitted, named features, statistics for each of them that can scale, distinct classes,
        and those that are expected, with strict_order in the same order."""
        if not self.features or not self.classes:
            raise ValueError("the preprocessor is not fitted")
        if all(f.startswith("feature_") for f in self.features):
            raise ValueError("placeholder feature names")
        if len(set(self.classes)) != len(self.classes):
            raise ValueError("classes repeat")
        for name, values in (("median", self.medians), ("mean", self.means), ("deviation", self.stds)):
            if set(values) != set(self.features):
                raise ValueError(f"a {name} is missing")
        if any(not x > 0 for x in self.stds.values()):
            raise ValueError("a deviation can't scale")
        if expected is not None and set(expected) != set(self.classes):
            raise ValueError(f"other classes than expected: {sorted(set(expected) ^ set(self.classes))}")
        if expected is not None and strict_order and list(expected) != self.classes:
            raise ValueError("the classes are in another order than expected")

    def transform(self, df: DataFrame) -> DataFrame:
        """Missing values become the median, then (x - mean) / std as float32; a missing feature is an error."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"missing features: {missing}")
        return df.withColumns({f: standardized(F.col(f"`{f}`"), self.medians[f], self.means[f], self.stds[f]).cast("float") for f in self.features})

    def encode(self, df: DataFrame, label: str, out: str = "label_id") -> DataFrame:
        """Adds the local id of a label; an unknown label fails when its row is computed."""
        at = F.create_map(*[F.lit(x) for i, c in enumerate(self.classes) for x in (c, i)])[F.col(label)]
        return df.withColumn(out, F.when(at.isNotNull(), at).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label), F.lit("null")))).cast("int")))

    def decode(self, local_id: Column) -> Column:
        return F.get(F.array(*[F.lit(c) for c in self.classes]), local_id)


def standardized(c: Column, median: float, mean: float, std: float) -> Column:
    return (F.coalesce(finite(c), F.lit(median)) - mean) / std


# --- posteriors ----------------------------------------------------------------------------------
def aligned(p: Column, model_classes: Sequence[int], n_classes: int) -> Column:
    """A model's columns in class index order, 0 where it has none."""
    at = {c: i for i, c in enumerate(model_classes)}
    return F.array(*[F.coalesce(F.get(p, F.lit(at[i])), F.lit(0.0)) if i in at else F.lit(0.0) for i in range(n_classes)])


def rescaled(p: Column, multipliers: Sequence[float]) -> Column:
    """p times multipliers, with sum 1 again; a sum of 0 counts as 1."""
    scaled = F.zip_with(p, F.array(*[F.lit(float(m)) for m in multipliers]), lambda x, m: x * m)
    total = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x)
    return F.transform(scaled, lambda x: x / F.when(total == 0, 1.0).otherwise(total))


def argmax(p: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def one_hot(class_id: Column, n_classes: int = len(CLASSES)) -> Column:
    """The posterior of a model without probabilities."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: F.when(i == class_id, 1.0).otherwise(0.0))


def decide(df: DataFrame, p: str, multipliers: Sequence[float]) -> DataFrame:
    """Adds posterior, predicted_id and confidence."""
    out = df.withColumn("posterior", rescaled(F.col(p), multipliers))
    return out.withColumns({"predicted_id": argmax(F.col("posterior")), "confidence": F.array_max("posterior")})


# --- thresholds ----------------------------------------------------------------------------------
def threshold_grid(df: DataFrame, p: str, true: str, n_classes: int, benign: int = 0, scales: Sequence[float] = BENIGN_SCALES) -> DataFrame:
    """multiplier, accuracy, macro_f1, benign_fpr of each multiplier of the benign class: one pass over the rows, each
    of which is expanded by the few multipliers and aggregated at once."""
    scaled = lambda m: F.transform(F.col(p), lambda x, i: F.when(i == benign, x * m).otherwise(x))
    tried = df.select(F.col(true).cast("int").alias("true_id"), F.inline(F.array(*[F.struct(F.lit(float(m)).alias("multiplier"), argmax(scaled(F.lit(float(m)))).alias("pred_id")) for m in scales])))
    cells = tried.groupBy("multiplier", "true_id", "pred_id").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(0)
    sides = cells.select("multiplier", F.inline(F.array(F.struct(F.col("true_id").alias("c"), F.col("n").alias("of"), F.lit(0).cast("long").alias("as"), hit.alias("tp")), F.struct(F.col("pred_id").alias("c"), F.lit(0).cast("long").alias("of"), F.col("n").alias("as"), F.lit(0).cast("long").alias("tp")))))
    classes = sides.groupBy("multiplier", "c").agg(F.sum("of").alias("of"), F.sum("as").alias("as"), F.sum("tp").alias("tp"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("of") + F.col("as")), F.lit(0.0))
    is_benign = F.col("c") == benign
    benign_of, benign_tp = F.sum(F.when(is_benign, F.col("of"))), F.sum(F.when(is_benign, F.col("tp")))
    return classes.groupBy("multiplier").agg(
        (F.sum("tp") / F.sum("of")).alias("accuracy"), (F.sum(f1) / n_classes).alias("macro_f1"), F.coalesce(F.try_divide((benign_of - benign_tp).cast("double"), benign_of), F.lit(0.0)).alias("benign_fpr")
    )


def minority_cells(df: DataFrame, p: str, true: str, targets: Sequence[int], multipliers: Sequence[float], scales: Sequence[float] = MINORITY_SCALES) -> DataFrame:
    """target, true_id, other_id, turn, n.  With the other multipliers as they are, a larger one of the target class can only
    turn a row to it: turn is the number of scales (sorted) that leave the row at other_id, the class that wins without the
    target.  So one aggregation, with a row for few cells, has the predictions of every scale of every target."""
    scaled = F.zip_with(F.col(p), F.array(*[F.lit(float(m)) for m in multipliers]), lambda x, m: x * m)

    def cell(c: int) -> Column:
        others = F.transform("_q", lambda x, i: F.when(i != c, x).otherwise(float("-inf")))
        best = F.array_max(others)
        wins = lambda m: (F.get(p, F.lit(c)) * m > best) | ((F.get(p, F.lit(c)) * m == best) & (argmax(others) > c))
        turn = F.size(F.filter(F.array(*[F.lit(float(m)) for m in sorted(scales)]), lambda m: ~wins(m)))
        return F.struct(F.lit(c).alias("target"), F.col(true).cast("int").alias("true_id"), argmax(others).alias("other_id"), turn.alias("turn"))

    cells = df.withColumn("_q", scaled).select(F.inline(F.array(*[cell(c) for c in targets])))
    return cells.groupBy("target", "true_id", "other_id", "turn").agg(F.count(F.lit(1)).alias("n"))


def minority_trials(df: DataFrame, p: str, true: str, n_classes: int, targets: Sequence[int], multipliers: Sequence[float] | None = None, scales: Sequence[float] = MINORITY_SCALES) -> DataFrame:
    """target, multiplier, accuracy, macro_f1, recall (of the target) of each target class times each scale."""
    steps = sorted(scales)
    cells = minority_cells(df, p, true, targets, multipliers or [1.0] * n_classes, scales)
    tried = cells.select("target", F.posexplode(F.array(*[F.lit(float(m)) for m in steps])).alias("step", "multiplier"), "true_id", F.when(F.col("turn") > F.col("step"), F.col("other_id")).otherwise(F.col("target")).alias("pred_id"), "n")
    hit = F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.inline(F.array(F.struct(F.col("true_id").alias("c"), F.col("n").alias("of"), zero.alias("as"), hit.alias("tp")), F.struct(F.col("pred_id").alias("c"), zero.alias("of"), F.col("n").alias("as"), zero.alias("tp"))))
    classes = tried.select("target", "multiplier", sides).groupBy("target", "multiplier", "c").agg(F.sum("of").alias("of"), F.sum("as").alias("as"), F.sum("tp").alias("tp"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("of") + F.col("as")), F.lit(0.0))
    own = F.col("c") == F.col("target")
    recall = F.coalesce(F.try_divide(F.sum(F.when(own, F.col("tp"))).cast("double"), F.sum(F.when(own, F.col("of")))), F.lit(0.0))
    return classes.groupBy("target", "multiplier").agg((F.sum("tp") / F.sum("of")).alias("accuracy"), (F.sum(f1) / n_classes).alias("macro_f1"), recall.alias("recall"))


def tune_thresholds(df: DataFrame, p: str, true: str, n_classes: int, benign: int = 0, tune_minority: bool = True) -> dict:
    """Multipliers that raise macro F1 on validation rows: first the benign class's, then, one class at a time, those of
    classes of low recall.  One aggregation has all trials of a class, so there are as many jobs as classes at most."""
    grid = sorted(threshold_grid(df, p, true, n_classes, benign, sorted({1.0, *BENIGN_SCALES})).collect(), key=lambda r: r["multiplier"])
    plain = next((r for r in grid if r["multiplier"] == 1.0), None)
    base = (plain["accuracy"], plain["macro_f1"]) if plain else (0.0, 0.0)
    (accuracy, f1), best, profiles = base, [1.0] * n_classes, []
    for row in grid:
        profiles.append({"target": benign, **row.asDict()})
        if row["macro_f1"] > f1 or abs(row["macro_f1"] - f1) < CLOSE_F1 and row["accuracy"] > accuracy:
            f1, accuracy, best[benign] = row["macro_f1"], row["accuracy"], row["multiplier"]
    for c in (c for c in range(n_classes) if c != benign and tune_minority and n_classes > 2):
        trials = {r["multiplier"]: r for r in minority_trials(df, p, true, n_classes, [c], best, [*MINORITY_SCALES, best[c]]).collect()}
        if not trials or trials[best[c]]["recall"] >= LOW_RECALL:
            continue
        for scale in MINORITY_SCALES:
            row = trials[scale]
            if row["macro_f1"] > f1 and row["accuracy"] >= max(0.0, accuracy - ACCURACY_DROP):
                f1, accuracy, best[c] = row["macro_f1"], row["accuracy"], scale
                profiles.append({"target": c, "multiplier": scale, "macro_f1": f1, "accuracy": accuracy})
    return {"multipliers": best, "baseline": {"accuracy": base[0], "macro_f1": base[1]}, "optimized": {"accuracy": accuracy, "macro_f1": f1}, "profiles": profiles}


# --- batches -------------------------------------------------------------------------------------
#: Records of a scored batch, rows that an upload is evaluated on, and flows that an answer shows, at most.
MAX_BATCH, MAX_UPLOAD, MAX_FLOWS = 10_000, 1_000, 100


def checked_batch(records: DataFrame) -> DataFrame:
    """records, if there are any and MAX_BATCH at most."""
    n = records.limit(MAX_BATCH + 1).count()
    if not n or n > MAX_BATCH:
        raise ValueError("the batch is empty" if not n else f"the batch has more than {MAX_BATCH} records")
    return records


def first_rows(df: DataFrame, order: str, n: int = MAX_UPLOAD) -> DataFrame:
    """The first n rows of an upload, or of flows to show, by their number."""
    return df.orderBy(order).limit(n)


#: What a batch is called whose records went to several specialists.
MULTI = "Multi-Specialist"


def batch_label(scored: DataFrame, batch: str) -> DataFrame:
    """batch, specialist: the specialist of all scored records of a batch, MULTI if there are several, null if there is none."""
    known = scored.groupBy(batch).agg(F.min("specialist").alias("_a"), F.max("specialist").alias("_b"))
    return known.select(batch, F.when(F.col("_a") == F.col("_b"), F.col("_a")).when(F.col("_a").isNotNull(), MULTI).alias("specialist"))


def score_mixed(records: DataFrame, scorers: Mapping[str, Callable[[DataFrame], DataFrame]], features: str = "features", order: str | None = None) -> DataFrame:
    """Records of several schemas (a map column): each is routed by its feature names and scored by its specialist;
    others come back with status UNROUTED.  scorers return their input with canonical_id and confidence.  With order, a
    column, the records come back in that order."""
    reject_mac(records.columns)
    routed = records.withColumn("specialist", route_row(F.map_keys(features)))
    out = None
    for name, scorer in scorers.items():
        part = scorer(routed.where(F.col("specialist") == name)).select(*records.columns, "specialist", "canonical_id", "confidence", F.lit("OK").alias("status"))
        out = part if out is None else out.unionByName(part)
    rest = routed.where(F.col("specialist").isNull() | ~F.col("specialist").isin(*scorers)).select(*records.columns, "specialist", F.lit(None).cast("int").alias("canonical_id"), F.lit(None).cast("double").alias("confidence"), F.lit("UNROUTED").alias("status"))
    every = rest if out is None else out.unionByName(rest)
    return every.orderBy(order) if order else every
