"""Evaluation, posteriors, thresholds, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, metrics, score, taxonomy
from ..sources.files import table
from .registry import Registry
from .views import posteriors, predictions, sql

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
K = len(taxonomy.CLASSES)
_GRID = f"SELECT t AS true_id, p AS pred_id, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, {K}))::INT AS t) CROSS JOIN (SELECT unnest(range(0, {K}))::INT AS p) LEFT JOIN (SELECT true_id, pred_id, count(*) AS n FROM predictions GROUP BY ALL) ON t = true_id AND p = pred_id"
_CLASS = f"""SELECT c AS class_id, tp + fn AS support, tp, fp, fn, total - tp - fp - fn AS tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN total - tp - fn > 0 THEN fp / (total - tp - fn) ELSE 0 END AS fpr, CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0 END AS fnr, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1
  FROM (SELECT c, count(*) FILTER (true_id = c AND pred_id = c) AS tp, count(*) FILTER (true_id <> c AND pred_id = c) AS fp, count(*) FILTER (true_id = c AND pred_id <> c) AS fn, count(*) AS total FROM predictions, (SELECT unnest(range(0, {K}))::INT AS c) GROUP BY c)"""
RATES = ("precision", "recall", "f1", "fpr", "fnr")
_R6 = lambda names: ", ".join(f'round("{c}", 6)::DOUBLE AS "{c}"' for c in names)


def _r6(df, names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@R.add(sql(_GRID, "predictions"))
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(predictions(spark, d), K)


@R.add(sql(f"SELECT class_id, support, tp, fp, fn, {_R6(RATES[:3])} FROM ({_CLASS})", "predictions"))
def per_class_metrics(spark, d):
    return _r6(metrics.per_class(predictions(spark, d), K), RATES[:3]).select("class_id", "support", "tp", "fp", "fn", *RATES[:3])


@R.add(sql(f"SELECT class_id, tn, {_R6(RATES[3:])} FROM ({_CLASS})", "predictions"))
def extended_metrics(spark, d):
    return _r6(metrics.per_class(predictions(spark, d), K), RATES[3:]).select("class_id", "tn", *RATES[3:])


SUMMARY = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")
_SUMMARY = f"""SELECT sum(support)::BIGINT AS total, sum(tp) / sum(support) AS accuracy, avg("precision") AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum("precision" * support) / sum(support) AS weighted_precision,
  sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1 FROM ({_CLASS})"""


@R.add(sql(f"SELECT total, {_R6(SUMMARY)} FROM ({_SUMMARY})", "predictions"))
def metric_summary(spark, d):
    return _r6(metrics.summary(predictions(spark, d), K), SUMMARY)


_BINARY = """SELECT count(*) FILTER (true_id <> 0 AND pred_id <> 0) AS tp, count(*) FILTER (true_id <> 0 AND pred_id = 0) AS fn, count(*) FILTER (true_id = 0 AND pred_id <> 0) AS fp, count(*) FILTER (true_id = 0 AND pred_id = 0) AS tn FROM predictions"""


@R.add(sql(f'SELECT tp, fn, fp, tn, round(tp / (tp + fn), 6)::DOUBLE AS detection_rate, round(tp / (tp + fp), 6)::DOUBLE AS "precision", round(fp / (fp + tn), 6)::DOUBLE AS false_alarm_rate FROM ({_BINARY})', "predictions"))
def binary_threat_metrics(spark, d):
    return _r6(metrics.threat_summary(predictions(spark, d)), ("detection_rate", "precision", "false_alarm_rate"))


def _other(spark, d):
    return predictions(spark, d).withColumn("pred_id", F.when(F.col("key") % 4 == 0, F.col("true_id")).otherwise(F.lit(0)))


@R.add(sql(f"SELECT 0::BIGINT AS total_delta, " + ", ".join(f"round(a.{c} - b.{c}, 4)::DOUBLE AS {c}_delta" for c in SUMMARY) + f" FROM ({_SUMMARY}) a, ({_SUMMARY.replace('FROM predictions,', 'FROM (SELECT * REPLACE (CASE WHEN key % 4 = 0 THEN true_id ELSE 0 END AS pred_id) FROM predictions),')}) b", "predictions"))
def metric_delta(spark, d):
    return metrics.delta(metrics.summary(predictions(spark, d), K), metrics.summary(_other(spark, d), K))


@R.add(sql("SELECT round(avg(seconds) * 1000, 4) AS mean_ms, round(quantile_cont(seconds, 0.5) * 1000, 4) AS median_ms, round(quantile_cont(seconds, 0.99) * 1000, 4) AS p99_ms FROM predictions", "predictions"))
def latency_percentiles(spark, d):
    out = metrics.latency(predictions(spark, d), "seconds")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@R.add(sql("SELECT true_id, pred_id, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY true_id), 4) AS percent FROM (SELECT true_id, pred_id, count(*) AS n FROM predictions GROUP BY ALL)", "predictions"))
def confusion_row_pct(spark, d):
    return metrics.row_percent(predictions(spark, d)).withColumn("percent", F.round("percent", 4))


def _models(spark, d):
    """Accuracy by event type, as if each were a model."""
    scored = predictions(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("model")), "key")
    return scored.groupBy("model").agg(F.round(F.avg((F.col("true_id") == F.col("pred_id")).cast("double")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


_MODELS = "SELECT event_type AS model, round(avg((true_id = pred_id)::INT), 6) AS accuracy, count(*) AS n FROM predictions JOIN events ON event_id = key GROUP BY ALL"


@R.add(sql(f"SELECT *, row_number() OVER (ORDER BY accuracy DESC, n DESC, model)::INT AS rank FROM ({_MODELS})", "predictions"))
def candidate_ranking(spark, d):
    return metrics.rank_candidates(_models(spark, d), "accuracy", "n")


@R.add(sql(f"SELECT model, accuracy FROM ({_MODELS}) ORDER BY accuracy DESC, model DESC LIMIT 1", "predictions"))
def best_model(spark, d):
    return metrics.best_model(_models(spark, d), "accuracy")


@R.add(sql("SELECT key, true_id = pred_id AS match, (SELECT bool_and(true_id = pred_id) FROM predictions) AS all_match FROM predictions", "predictions"))
def expected_matches(spark, d):
    """Expected and predicted classes of all predictions."""
    return metrics.expected_matches(predictions(spark, d), "true_id", "pred_id").select("key", "match", "all_match")


# --- posteriors --------------------------------------------------------------------------------------
def _entries(c, n):
    return [F.round(F.get(c, F.lit(i)), 6).alias(f"p{i}") for i in range(n)]


@R.add(sql("SELECT key, " + ", ".join(f"round({'p[' + str(i + 1) + ']' if i < 7 else '0::DOUBLE'}, 6) AS p{i}" for i in range(K)) + " FROM posteriors", "posteriors"))
def prob_projection(spark, d):
    return posteriors(spark, d).select("key", *_entries(taxonomy.project_posterior(F.col("p"), "IDS2018"), K))


@R.add(sql("SELECT key, round(CASE key % 3 WHEN 0 THEN 0 WHEN 1 THEN p[2] ELSE 0 END, 6) AS p9, round(CASE key % 3 WHEN 0 THEN p[3] WHEN 1 THEN p[3] ELSE 0 END, 6) AS p2, round(CASE key % 3 WHEN 2 THEN p[2] ELSE 0 END, 6) AS p12 FROM posteriors", "posteriors"))
def prob_projection_by_specialist(spark, d):
    name = F.get(F.array(F.lit("CICIoT2023"), F.lit("ARP_Spoofing"), F.lit("DNS_Tunneling")), (F.col("key") % 3).cast("int"))
    out = posteriors(spark, d).withColumn("q", taxonomy.project_by_column(F.col("p"), name))
    return out.select("key", *[F.round(F.get("q", F.lit(i)), 6).alias(f"p{i}") for i in (9, 2, 12)])


MULTIPLIERS = (1.25, 1.0, 2.0, 0.5, 1.0, 1.5, 3.0)
_SCALED = f"list_transform(list_zip(p, {list(MULTIPLIERS)}), lambda x: x[1] * x[2])"


@R.add(sql(f"SELECT key, (list_position(list_transform(q, lambda x: round(x / s, 9)), round(list_max(q) / s, 9)) - 1)::INT AS predicted_id, round(list_max(q) / s, 6) AS confidence FROM (SELECT key, q, list_sum(q) AS s FROM (SELECT key, {_SCALED} AS q FROM posteriors))", "posteriors"))
def threshold_argmax(spark, d):
    out = score.decide(posteriors(spark, d), "p", MULTIPLIERS)
    first = score.argmax(F.transform("posterior", lambda x: F.round(x, 9)))
    return out.select("key", first.alias("predicted_id"), F.round("confidence", 6).alias("confidence"))


_TRIED = f"SELECT m AS multiplier, true_id, (list_position(q, list_max(q)) - 1)::INT AS pred_id FROM (SELECT m, true_id, list_transform(list_zip(p, range(0, 7)), lambda x: CASE WHEN x[2] = 0 THEN x[1] * m ELSE x[1] END) AS q FROM posteriors, (SELECT unnest({list(score.BENIGN_SCALES)})::DOUBLE AS m))"


@R.add(sql(f"""SELECT multiplier, round(sum(tp) / any_value(total), 6)::DOUBLE AS accuracy, round(sum(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) / 7, 6)::DOUBLE AS macro_f1, round(coalesce(sum(CASE WHEN c = 0 THEN fn END) / sum(CASE WHEN c = 0 THEN tp + fn END), 0), 6)::DOUBLE AS benign_fpr
  FROM (SELECT multiplier, c, count(*) FILTER (true_id = c AND pred_id = c) AS tp, count(*) FILTER (true_id <> c AND pred_id = c) AS fp, count(*) FILTER (true_id = c AND pred_id <> c) AS fn, count(*) AS total FROM ({_TRIED}), (SELECT unnest(range(0, 7)) AS c) GROUP BY ALL) GROUP BY multiplier""", "posteriors"))
def threshold_grid(spark, d):
    return _r6(score.threshold_grid(posteriors(spark, d), "p", "true_id", 7), ("accuracy", "macro_f1", "benign_fpr"))


_MINORITY = f"SELECT c AS target, m AS multiplier, true_id, (list_position(q, list_max(q)) - 1)::INT AS pred_id FROM (SELECT c, m, true_id, list_transform(list_zip(p, range(0, 7)), lambda x: CASE WHEN x[2] = c THEN x[1] * m ELSE x[1] END) AS q FROM posteriors, (SELECT unnest({list(score.MINORITY_SCALES)})::DOUBLE AS m), (SELECT unnest(range(1, 7))::INT AS c))"


@R.add(sql(f"""SELECT target, multiplier, round(sum(tp) / any_value(total), 6)::DOUBLE AS accuracy, round(sum(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) / 7, 6)::DOUBLE AS macro_f1,
  round(coalesce(sum(CASE WHEN c = target THEN tp END) / nullif(sum(CASE WHEN c = target THEN tp + fn END), 0), 0), 6)::DOUBLE AS recall
  FROM (SELECT target, multiplier, c, count(*) FILTER (true_id = c AND pred_id = c) AS tp, count(*) FILTER (true_id <> c AND pred_id = c) AS fp, count(*) FILTER (true_id = c AND pred_id <> c) AS fn, count(*) AS total FROM ({_MINORITY}), (SELECT unnest(range(0, 7)) AS c) GROUP BY ALL) GROUP BY target, multiplier""", "posteriors"))
def threshold_minority_grid(spark, d):
    """Every scale of every class but the benign one, from one aggregation of the scales at which rows turn."""
    return _r6(score.minority_trials(posteriors(spark, d), "p", "true_id", 7, range(1, 7)), ("accuracy", "macro_f1", "recall"))


@R.add(sql("SELECT key, " + ", ".join(f"(true_id = {i})::INT::DOUBLE AS p{i}" for i in range(3)) + " FROM posteriors", "posteriors"))
def one_hot_posterior(spark, d):
    return posteriors(spark, d).select("key", *[F.get(score.one_hot(F.col("true_id")), F.lit(i)).alias(f"p{i}") for i in range(3)])


# --- boosting ---------------------------------------------------------------------------------------
#: Settings of the query: three rounds of small trees by all rows.
BOOSTING = boosting.Settings(rounds=3, depth=3, bins=64, step=0.3)
BOOSTED_ON = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def boosted_rows(spark, d):
    """Line items with their return flag as class number."""
    flag = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), *BOOSTED_ON, flag.cast("int").alias("true_id"))


@R.add()
def boosted_predictions(spark, d):
    """Class and probability of every line item by a model boosted on all of them.  Beyond SQL: held against a booster by hand."""
    rows = boosted_rows(spark, d)
    scored = boosting.fit(rows, BOOSTED_ON, "true_id", 3, BOOSTING, key="key").transform(rows)
    return scored.select("key", F.col("prediction").cast("int").alias("predicted_id"), F.round(F.array_max("probabilities"), 6).alias("confidence"))


# --- routing -----------------------------------------------------------------------------------------
SCHEMAS = (("query", "n"), ("arp_opcode", "frame_len"), ("Tot Fwd Pkts", "x"), ("Rate", "Srate"), ("gtp.teid", "y"), ("a", "b"), ("frame_number", "tcp_flag_syn"), ("Flow Duration", "Flow Byts/s"))
_ROUTES = ("DNS_Tunneling", "ARP_Spoofing", "IDS2018", "CICIoT2023", "IP_Spoofing", None, "ARP_Spoofing", "IDS2018")


@R.add("SELECT event_id, ['" + "', '".join(str(r) for r in _ROUTES) + "'][event_id % 8 + 1] AS specialist FROM events")
def schema_routing(spark, d):
    keys = F.get(F.array(*[F.array(*[F.lit(x) for x in s]) for s in SCHEMAS]), (F.col("event_id") % 8).cast("int"))
    return table(spark, d, "events").select("event_id", F.coalesce(taxonomy.route_row(keys), F.lit("None")).alias("specialist"))


@R.add("SELECT p_partkey, lower(p_name) LIKE '%mac%' OR p_partkey % 7 = 0 AS has_mac FROM part")
def mac_rejection(spark, d):
    keys = F.array(F.col("p_name"), F.when(F.col("p_partkey") % 7 == 0, "Src_MAC").otherwise("Rate"))
    return table(spark, d, "part").select("p_partkey", taxonomy.has_mac(keys).alias("has_mac"))


@R.add("SELECT event_id, specialist, CASE WHEN specialist = 'CICIoT2023' THEN CAST(event_id % 13 AS INT) WHEN specialist = 'DNS_Tunneling' THEN 12 END AS canonical_id, CASE WHEN specialist IS NULL THEN 'UNROUTED' ELSE 'OK' END AS status FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'CICIoT2023' WHEN 1 THEN 'DNS_Tunneling' END AS specialist FROM events)")
def mixed_batch(spark, d):
    """Records of two schemas and of none, each scored by its own specialist."""
    names = F.get(F.array(F.lit("Rate"), F.lit("query_length"), F.lit("other")), (F.col("event_id") % 3).cast("int"))
    records = table(spark, d, "events").select("event_id", F.create_map(names, F.col("value")).alias("features"))
    scorers = {
        "CICIoT2023": lambda df: df.withColumns({"canonical_id": (F.col("event_id") % 13).cast("int"), "confidence": F.lit(0.5)}),
        "DNS_Tunneling": lambda df: df.withColumns({"canonical_id": F.lit(12), "confidence": F.lit(0.9)}),
    }
    return score.score_mixed(records, scorers).select("event_id", "specialist", "canonical_id", "status")


@R.add("SELECT batch, CASE WHEN count(DISTINCT specialist) > 1 THEN 'Multi-Specialist' ELSE min(specialist) END AS specialist FROM (SELECT event_id // 2 AS batch, CASE event_id % 3 WHEN 0 THEN 'CICIoT2023' WHEN 1 THEN 'DNS_Tunneling' END AS specialist FROM events) GROUP BY batch")
def mixed_batch_labels(spark, d):
    """What each batch of two records is called."""
    scored = mixed_batch(spark, d).withColumn("batch", F.floor(F.col("event_id") / 2))
    return score.batch_label(scored, "batch")
