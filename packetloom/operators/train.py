"""Specialists on Spark ML and boosting: candidates, selection by validation macro F1, gates, one test, metadata."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists
from . import boosting, extra_trees, metrics, profile
from .boosting import Boosted, Settings
from .extra_trees import Forest
from .score import Preprocessor, argmax, rescaled, tune_thresholds
from .taxonomy import SPECIALISTS, specialist

# --- fixed values: settings, other names of models, gates ---------------------------------------------
#: Trees by their own settings.  share: of rows for a tree; subset: of features for a split.
FORESTS = {
    "RandomForest": {"trees": 30, "depth": 12, "leaf": 10, "share": 0.25, "subset": "sqrt"},
    "RandomForest_Baseline": {"trees": 30, "depth": 12, "leaf": 10, "share": 0.25, "subset": "sqrt"},
    "RandomForest_Tuned": {"trees": 40, "depth": 18, "leaf": 5, "share": 0.4, "subset": "sqrt"},
}
RANDOMISED = {"ExtraTrees": extra_trees.Settings(trees=60, depth=20, leaf=3), "ExtraTrees_Candidate": extra_trees.Settings(trees=40, depth=18, leaf=5)}
SINGLE_TREES = {"DecisionTree": {"depth": 15, "leaf": 1}, "DecisionTree_Baseline": {"depth": 15, "leaf": 5}, "DecisionTree_Tuned": {"depth": 18, "leaf": 5}}
_DEEP = {"step": 0.1, "share": 0.8, "features": 0.8}
_LEAFWISE = {"depth": None, "weight": 1e-3, "penalty": 0.0, "curvature": 1.0, "prior": True, "bins": 255}
BOOSTED = {
    "XGBoost": Settings(rounds=50, depth=6, **_DEEP),
    "XGBoost_Baseline": Settings(rounds=50, depth=6, **_DEEP),
    "XGBoost_Tuned": Settings(rounds=80, depth=7, **_DEEP),
    "XGBoost_Unweighted": Settings(rounds=80, depth=7, **_DEEP),
    "HistGradientBoosting": Settings(rounds=150, step=0.08, leaves=63, leaf=20, patience=10, **_LEAFWISE),
    "HistGradientBoosting_Candidate": Settings(rounds=60, step=0.1, leaves=31, leaf=50, patience=5, **_LEAFWISE),
}
#: How rows are weighted unless it is said.
WEIGHTS = {"DecisionTree": "balanced", "DecisionTree_Baseline": "balanced", "RandomForest": "balanced", "RandomForest_Baseline": "balanced", "ExtraTrees": "balanced", "XGBoost": "balanced", "XGBoost_Baseline": "balanced", "XGBoost_Unweighted": "unweighted"}
#: Other names, in small letters; each may have candidate_ in front.
ALIASES = {
    "decision_tree": "DecisionTree", "dt": "DecisionTree", "tree": "DecisionTree", "random_forest": "RandomForest", "rf": "RandomForest", "forest": "RandomForest", "xgb": "XGBoost",
    "hist_gradient_boosting": "HistGradientBoosting", "hgb": "HistGradientBoosting", "extra_trees": "ExtraTrees", "et": "ExtraTrees",
    "decision_tree_tuned": "DecisionTree_Tuned", "dt_tuned": "DecisionTree_Tuned", "decision_tree_baseline": "DecisionTree_Baseline", "rf_tuned": "RandomForest_Tuned", "xgb_tuned": "XGBoost_Tuned",
}
#: Least validation accuracy and macro F1 of a specialist that may be published; for tuned models of CICIoT2023, and the least
#: macro F1 with thresholds there.
GATES = {"IDS2018": (0.95, 0.80), "CICIoT2023": (0.95, 0.69)}
TUNED_GATES, TUNED_CALIBRATED_F1 = {"CICIoT2023": (0.985, 0.75)}, 0.78
#: Models that are looked for where no metadata name one, and after those.
DEFAULT_MODELS = {"IDS2018": ("DecisionTree_Tuned", "DecisionTree"), "CICIoT2023": ("XGBoost_Tuned", "XGBoost"), "DNS_Tunneling": ("RandomForest", "DecisionTree")}
OTHER_MODELS = ("DecisionTree", "RandomForest", "XGBoost")
MODELS = (*SINGLE_TREES, *FORESTS, *RANDOMISED, *BOOSTED)
_BY_NAME = {m.lower(): m for m in MODELS} | ALIASES


def model_name(name: str) -> str:
    """The model of a name or alias, with or without candidate_ in front; an unknown name stays as it is."""
    low = name.strip().lower()
    return _BY_NAME.get(low) or _BY_NAME.get(low.removeprefix("candidate_")) or name.strip()


def classifier(name: str, seed: int = 42, smoke: bool = False):
    """An estimator, or settings of boosting, by a model's name; smoke: the few, shallow trees of a trial run."""
    own = model_name(name)
    common = {"labelCol": "label_id", "featuresCol": "vector", "seed": seed}
    weighted = common | {"weightCol": "sample_weight", "maxBins": 64}
    if own in SINGLE_TREES:
        tree = SINGLE_TREES[own] | ({"depth": 3} if smoke else {})
        return DecisionTreeClassifier(maxDepth=tree["depth"], minInstancesPerNode=tree["leaf"], **weighted)
    if own in FORESTS:
        forest = FORESTS[own] | ({"trees": 3, "depth": 3} if smoke else {})
        return RandomForestClassifier(numTrees=forest["trees"], maxDepth=forest["depth"], minInstancesPerNode=forest["leaf"], featureSubsetStrategy=forest["subset"], subsamplingRate=forest["share"], **weighted)
    if own in RANDOMISED:
        return replace(RANDOMISED[own], seed=seed, **({"trees": 3, "depth": 3} if smoke else {}))
    if own in BOOSTED:
        return replace(BOOSTED[own], seed=seed, **({"rounds": 3, "depth": 3, "leaf": 2, "patience": None} if smoke else {}))
    raise ValueError(f"unknown model: {name}")


def passes_gates(name: str, model: str, plain: Mapping[str, float], calibrated: Mapping[str, float] | None = None) -> bool:
    """Whether a specialist's validation (accuracy, macro_f1) may be published: without thresholds, and with them if there are any."""
    own, tuned = specialist(name), "tuned" in model_name(model).lower()
    accuracy, f1 = (TUNED_GATES if tuned and own in TUNED_GATES else GATES).get(own, (0.0, 0.0))
    ok = plain["accuracy"] >= accuracy and plain["macro_f1"] >= f1
    if tuned and own in TUNED_GATES and calibrated is not None:
        ok = ok and calibrated["macro_f1"] >= TUNED_CALIBRATED_F1
    return ok


def is_stale(cached_rows: int, rows: int | None) -> bool:
    """Whether what was fitted on cached_rows must be fitted again, as rows are there: after a stub (10 or fewer), a small sample
    (under 1,000 of 1,000 or more) or less than half of more than 100."""
    if not rows or rows <= 0:
        return False
    return cached_rows <= 10 < rows or cached_rows < 1000 <= rows or rows > 100 and cached_rows < rows * 0.5


def fit(train: DataFrame, pre: Preprocessor, label: str, name: str, weights: str = "sqrt_balanced", seed: int = 42, smoke: bool = False) -> PipelineModel | Boosted | Forest:
    """Model on preprocessed, encoded and weighted rows."""
    ready = pre.encode(pre.transform(profile.with_sample_weights(train, label, weights)), label)
    ready = ready.withColumns({"label_id": F.col("label_id").cast("double"), "sample_weight": F.col("sample_weight").cast("double")})
    safe = _safe_names(pre.features)
    if own := next((m for names, m in ((BOOSTED, boosting), (RANDOMISED, extra_trees)) if model_name(name) in names), None):
        return own.fit(_renamed(ready, safe), list(safe.values()), "label_id", len(pre.classes), classifier(name, seed, smoke), "sample_weight")
    return Pipeline(stages=[VectorAssembler(inputCols=list(safe.values()), outputCol="vector"), classifier(name, seed, smoke)]).fit(_renamed(ready, safe))


def _safe_names(features: Sequence[str]) -> dict[str, str]:
    return {f: f"_f{i}" for i, f in enumerate(features)}  # names with dots can't be assembled


def _renamed(df: DataFrame, safe: Mapping[str, str]) -> DataFrame:
    return df.withColumns({new: F.col(f"`{old}`").cast("double") for old, new in safe.items()})


def predict(df: DataFrame, pre: Preprocessor, model: PipelineModel | Boosted | Forest) -> DataFrame:
    """df with probabilities (local), predicted_local, confidence."""
    out = model.transform(_renamed(pre.transform(df), _safe_names(pre.features)))
    if "probability" in out.columns:
        out = out.withColumn("probabilities", vector_to_array("probability"))
    out = out.withColumn("predicted_local", F.col("prediction").cast("int")).withColumn("confidence", F.array_max("probabilities"))
    return out.select(*[f"`{c}`" for c in df.columns], "probabilities", "predicted_local", "confidence")


def evaluate(df: DataFrame, pre: Preprocessor, model: PipelineModel | Boosted | Forest, label: str, multipliers: Sequence[float] | None = None) -> dict[str, float]:
    """Metrics of a model, with each class's probability times its multiplier if there are any."""
    scored = pre.encode(predict(df, pre, model), label, "true_id")
    found = F.col("predicted_local") if multipliers is None else argmax(rescaled(F.col("probabilities"), multipliers))
    return metrics.summary(scored.select("true_id", found.alias("pred_id")), len(pre.classes)).first().asDict()


def train_specialist(name: str, train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], classes: Sequence[str], label: str = "final_label", models: Sequence[str] = ("DecisionTree", "RandomForest"), weights: str | None = None, screen: DataFrame | None = None, top_k: int = 2, seed: int = 42, done: dict | None = None, thresholds: bool = False) -> dict:
    """Fits candidates (with screen: all on it first, then the top_k on train), picks by validation macro F1 and accuracy,
    applies the gates, tests once.  done: results by model of an earlier run, which are not repeated unless they are stale for the
    rows that are there now (train_rows says what they were fitted on).  thresholds: each finalist's multipliers are tuned on val, and candidates are compared with them."""
    own = specialist(name)
    pre = Preprocessor.fit(train, features, classes)
    pre.validate(classes)
    n_rows = train.count()
    results = {m: r for m, r in (done or {}).items() if not is_stale(r.get("train_rows", n_rows), n_rows)}
    fitted: dict[str, PipelineModel | Boosted | Forest] = {}
    candidates = [model_name(m) for m in models]
    by_value = lambda found: lambda m: (-found[m]["macro_f1"], -found[m]["accuracy"], m)
    how = lambda m: weights or WEIGHTS.get(m, "sqrt_balanced")
    if screen is not None and len(candidates) > top_k:
        screened = {m: evaluate(val, pre, fit(screen, pre, label, m, how(m), seed), label) for m in candidates}
        candidates = sorted(screened, key=by_value(screened))[:top_k]
    for m in candidates:
        if m not in results:
            fitted[m] = fit(train, pre, label, m, how(m), seed)
            results[m] = evaluate(val, pre, fitted[m], label) | {"train_rows": n_rows}
            if thresholds:
                scored = pre.encode(predict(val, pre, fitted[m]), label, "true_id")
                multipliers = list(tune_thresholds(scored, "probabilities", "true_id", len(classes))["multipliers"])
                results[m] = evaluate(val, pre, fitted[m], label, multipliers) | {"multipliers": multipliers, "plain": results[m], "train_rows": n_rows}
    best = sorted(candidates, key=by_value(results))[0]
    model = fitted.get(best) or fit(train, pre, label, best, how(best), seed)
    found = results[best]
    multipliers = found.get("multipliers")
    passed = passes_gates(own, best, found.get("plain", found), found if multipliers else None)
    tested = evaluate(test, pre, model, label, multipliers) if passed else None
    return {"specialist": own, "model": model, "preprocessor": pre, "best_model": best, "multipliers": multipliers, "validation": results, "passed_gates": passed, "test": tested}


def save(found: dict, path: str) -> None:
    """Model and metadata, readable by every executor: both go through Spark's file systems.  The model lies under its name."""
    spark = SparkSession.getActiveSession()
    place = f"{path}/{found['best_model']}"
    if isinstance(found["model"], Boosted):
        boosting.save(found["model"], spark, f"{place}/boosted")
    elif isinstance(found["model"], Forest):
        extra_trees.save(found["model"], spark, f"{place}/extra_trees")
    else:
        found["model"].write().overwrite().save(place)
    meta = {k: found.get(k) for k in ("specialist", "best_model", "multipliers", "validation", "passed_gates", "test")} | {"preprocessor": vars(found["preprocessor"])}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def find_model(spark: SparkSession, path: str, name: str, named: str | None) -> tuple[str, str]:
    """(model, place) of a specialist's model: the named one, else its default ones, else any other, each also with
    candidate_ in front."""
    wanted = [named] if named else list(DEFAULT_MODELS.get(specialist(name), ("DecisionTree",)))
    for m in dict.fromkeys([*wanted, *OTHER_MODELS]):
        for place in (f"{path}/{m}", f"{path}/candidate_{m}"):
            if exists(spark, place):
                return m, place
    raise FileNotFoundError(f"no model of {name} in {path}")


def load(spark: SparkSession, path: str) -> dict:
    """A saved specialist: a candidate's metadata go before the standard ones, and name the model."""
    places = [p for p in (f"{path}/candidate_metadata", f"{path}/metadata") if exists(spark, p)]
    if not places:
        raise FileNotFoundError(f"no specialist in {path}")
    meta = json.loads(spark.read.text(places[0]).first()[0])
    best, place = find_model(spark, path, meta["specialist"], meta.get("best_model"))
    readers = {"boosted": boosting.load, "extra_trees": extra_trees.load}
    kind = next((k for k in readers if exists(spark, f"{place}/{k}")), None)
    model = readers[kind](spark, f"{place}/{kind}") if kind else PipelineModel.load(place)
    return meta | {"best_model": best, "model": model, "preprocessor": Preprocessor(**meta["preprocessor"])}


class Registry:
    """Loaded specialists by name; each is read once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.loaded = spark, root.rstrip("/"), {}

    def register(self, name: str, found: dict) -> None:
        self.loaded[specialist(name)] = found

    def load_all(self) -> list[str]:
        """Reads every specialist that is there; their names."""
        for own in SPECIALISTS:
            if own not in self.loaded and exists(self.spark, f"{self.root}/{own}"):
                self.get(own)
        return [s for s in SPECIALISTS if s in self.loaded]

    def get(self, name: str, reload: bool = False) -> dict:
        own = specialist(name)
        if reload or own not in self.loaded:
            self.loaded[own] = load(self.spark, f"{self.root}/{own}")
        return self.loaded[own]

    def score(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Scores rows of one schema: by the named specialist, or the one that their columns point to."""
        from .taxonomy import CLASS_IDS, align_aliases, project_posterior, reject_mac, route_schema

        reject_mac(df.columns)
        own = specialist(name) if name else route_schema(df.columns)
        found = self.get(own)
        pre = found["preprocessor"]
        scored = predict(align_aliases(df, pre.features), pre, found["model"])
        if found.get("multipliers"):
            p = rescaled(F.col("probabilities"), found["multipliers"])
            scored = scored.withColumn("probabilities", p).withColumns({"predicted_local": argmax(F.col("probabilities")), "confidence": F.array_max("probabilities")})
        ids = F.array(*[F.lit(CLASS_IDS[c]) for c in pre.classes])
        return scored.withColumns({"specialist": F.lit(own), "canonical_id": F.get(ids, F.col("predicted_local")), "posterior": project_posterior(F.col("probabilities"), own), "class_name": pre.decode(F.col("predicted_local"))})
