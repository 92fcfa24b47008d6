"""Preparation: cleaning, conflicts, duplicates, splits, overlaps, features, profiles, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dns_features, live_dns_features, row_digest
from ..operators import clean as clean_ops
from ..operators import dedup, profile, score, splits, taxonomy
from ..operators.features import ENGINEERED, engineered
from ..sources.files import table
from .registry import Registry
from .views import CLASSES, CLEAN, FEATURES, VECTOR, clean, hosts, labelled, sql

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
F6 = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
SPLIT_SQL = """SELECT *, CASE WHEN n < 3 OR rn <= n_tr THEN 'train' WHEN rn <= n_tr + round_even((n - n_tr) * 0.5::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, round_even(n * 0.7::DOUBLE, 0) AS n_tr FROM (SELECT *, row_number() OVER (PARTITION BY final_label ORDER BY md5('42|' || key), key) AS rn, count(*) OVER (PARTITION BY final_label) AS n FROM clean))"""
ROUNDED = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in FEATURES[:3]) + ", l_suppkey"


def _rounded(df):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in FEATURES[:3]})


@R.add(sql("SELECT final_label, count(*) AS n FROM clean GROUP BY ALL", *CLEAN))
def label_distribution(spark, d):
    return clean(spark, d).groupBy("final_label").agg(F.count(F.lit(1)).alias("n"))


@R.add(sql("SELECT coalesce(final_label, 'unmapped') AS final_label, raw_label, count(*) AS n FROM mapped GROUP BY ALL", *CLEAN[:2]))
def label_mapping(spark, d):
    mapped = taxonomy.map_labels(labelled(spark, d), taxonomy.label_map("IDS2018"), "raw_label", robust=True)
    return mapped.groupBy(F.coalesce("final_label", F.lit("unmapped")).alias("final_label"), "raw_label").agg(F.count(F.lit(1)).alias("n"))


_LABELS = ", ".join(f"('{ds}', '{raw}', '{c}')" for ds in taxonomy.LABELS for raw, c in taxonomy.label_map(ds).items())


@R.add(sql(f"SELECT l.*, coalesce(n, 0) AS n FROM (VALUES {_LABELS}) l(dataset, raw_label, class_name) LEFT JOIN (SELECT 'IDS2018' AS dataset, trim(raw_label) AS raw_label, count(*) AS n FROM labelled GROUP BY ALL) USING (dataset, raw_label)", "labelled"))
def label_dimension(spark, d):
    """All raw labels, with the rows that have them."""
    rows = labelled(spark, d).groupBy(F.lit("IDS2018").alias("dataset"), F.trim("raw_label").alias("raw_label")).agg(F.count(F.lit(1)).alias("n"))
    return taxonomy.label_dim(spark).join(rows, ["dataset", "raw_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@R.add(sql("""SELECT count(*) AS initial_rows, count(*) FILTER (ok) AS mapped_rows, count(*) FILTER (ok AND bad) AS invalid_rows, count(*) FILTER (ok AND NOT bad) AS clean_rows
  FROM (SELECT coalesce(final_label IN ('Benign', 'DoS', 'Botnet'), false) AS ok, l_quantity IS NULL OR isnan(l_quantity) OR isinf(l_quantity) AS bad FROM mapped)""", *CLEAN[:2]))
def clean_funnel(spark, d):
    mapped = taxonomy.map_labels(labelled(spark, d), taxonomy.label_map("IDS2018"), "raw_label", robust=True)
    return clean_ops.clean_funnel(mapped, "final_label", FEATURES, CLASSES)


@R.add(sql(f"SELECT key, {ROUNDED}, final_label FROM clean", *CLEAN))
def invalid_numeric_drop(spark, d):
    return _rounded(clean(spark, d)).select("key", *FEATURES, "final_label")


@R.add(sql(f"SELECT {ROUNDED}, count(DISTINCT final_label) AS n_labels, count(*) AS n_rows FROM clean GROUP BY {VECTOR} HAVING count(DISTINCT final_label) > 1", *CLEAN))
def conflict_groups(spark, d):
    return _rounded(dedup.conflict_groups(clean(spark, d), FEATURES, "final_label"))


@R.add(sql(f"SELECT min(key) AS key, {ROUNDED}, min(final_label) AS final_label FROM clean GROUP BY {VECTOR} HAVING count(DISTINCT final_label) = 1", *CLEAN))
def conflict_purge_dedup(spark, d):
    return _rounded(dedup.purge_and_dedup(clean(spark, d), FEATURES, "final_label", "key")).select("key", *FEATURES, "final_label")


@R.add(sql(f"SELECT min(key) AS key FROM clean GROUP BY {VECTOR}", *CLEAN))
def exact_dedup(spark, d):
    return dedup.dedup(clean(spark, d), FEATURES, "key").select("key")


def _split(spark, d):
    return splits.stratified_split(clean(spark, d), "final_label", "key")


@R.add(sql(f"SELECT key, final_label, split FROM ({SPLIT_SQL})", *CLEAN))
def stratified_split(spark, d):
    return _split(spark, d).select("key", "final_label", "split")


@R.add(sql("""SELECT key, CASE WHEN n >= 3 AND rn <= round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY final_label ORDER BY md5('42|' || key), key) AS rn, count(*) OVER (PARTITION BY final_label) AS n FROM clean)""", *CLEAN))
def validation_split(spark, d):
    return splits.validation_split(clean(spark, d), "final_label", "key").select("key", "split")


@R.add(sql(f"SELECT split, final_label, count(*) AS n FROM ({SPLIT_SQL}) GROUP BY ALL", *CLEAN))
def split_distribution(spark, d):
    return _split(spark, d).groupBy("split", "final_label").agg(F.count(F.lit(1)).alias("n"))


@R.add(sql("""SELECT key, final_label FROM (SELECT *, row_number() OVER (PARTITION BY final_label ORDER BY md5('42|' || key), key) AS rn, (SELECT greatest(1, 1000 // count(DISTINCT final_label)) FROM clean) AS cap FROM clean) WHERE rn <= cap""", *CLEAN))
def minority_sample(spark, d):
    return splits.minority_sample(clean(spark, d), "final_label", "key", 1000).select("key", "final_label")


@R.add(sql("SELECT key, final_label FROM (SELECT *, row_number() OVER (PARTITION BY final_label ORDER BY key) AS rn FROM clean) WHERE rn <= 50", *CLEAN))
def benchmark_sample(spark, d):
    return splits.per_class_head(clean(spark, d), "final_label", "key", 50).select("key", "final_label")


def _parts(spark, d):
    marked = _split(spark, d)
    return {s: marked.where(F.col("split") == s) for s in ("train", "val", "test")}


_OVERLAP = ", ".join(f"coalesce(list(DISTINCT final_label) FILTER (split = '{s}'), []) AS {s}" for s in ("train", "val", "test"))
_PAIR = """SELECT '{a}-{b}' AS pair, count(*) FILTER (len({a}) > 0 AND len({b}) > 0) AS shared, count(*) FILTER (len({a}) > 0) AS left_vectors, count(*) FILTER (len({b}) > 0) AS right_vectors,
  sum(len(list_intersect({a}, {b})))::BIGINT AS same_label_pairs, sum(len({a}) * len({b}) - len(list_intersect({a}, {b})))::BIGINT AS conflicting_pairs FROM v"""


@R.add(sql(f"""SELECT *, round(shared * 100.0::DOUBLE / left_vectors, 4) AS left_percent, round(shared * 100.0::DOUBLE / right_vectors, 4) AS right_percent FROM (
  WITH v AS (SELECT {VECTOR}, {_OVERLAP} FROM ({SPLIT_SQL}) GROUP BY {VECTOR}) """ + " UNION ALL ".join(_PAIR.format(a=a, b=b) for a, b in (("train", "val"), ("train", "test"), ("val", "test"))) + ")", *CLEAN))
def cross_split_overlap(spark, d):
    return dedup.overlap_report(_split(spark, d), "split", ("train", "val", "test"), FEATURES, "final_label")


@R.add(sql(f"SELECT key FROM s WHERE split = 'test' AND NOT EXISTS (SELECT 1 FROM s t WHERE t.split = 'train' AND " + " AND ".join(f"t.{c} = s.{c}" for c in FEATURES) + ")", *CLEAN).replace(" SELECT key FROM s", f", s AS ({SPLIT_SQL}) SELECT key FROM s", 1))
def anti_train_overlap(spark, d):
    parts = _parts(spark, d)
    return dedup.without(parts["test"], parts["train"], FEATURES).select("key")


@R.add(sql(f"SELECT key FROM s WHERE split = 'val' AND EXISTS (SELECT 1 FROM s t WHERE t.split = 'train' AND " + " AND ".join(f"t.{c} = s.{c}" for c in FEATURES) + ")", *CLEAN).replace(" SELECT key FROM s", f", s AS ({SPLIT_SQL}) SELECT key FROM s", 1))
def semi_train_overlap(spark, d):
    parts = _parts(spark, d)
    return dedup.within(parts["val"], parts["train"], FEATURES).select("key")


@R.add(sql(f"SELECT count(*) AS n FROM (SELECT {VECTOR} FROM s WHERE split = 'train' INTERSECT SELECT {VECTOR} FROM s WHERE split = 'test')", *CLEAN).replace(" SELECT count(*)", f", s AS ({SPLIT_SQL}) SELECT count(*)", 1))
def shared_vector_count(spark, d):
    parts = _parts(spark, d)
    return dedup.shared_vectors(parts["train"], parts["test"], FEATURES).agg(F.count(F.lit(1)).alias("n"))


@R.add(sql(f"""SELECT final_label_1, final_label_2, count(*) AS n FROM (SELECT DISTINCT {VECTOR}, final_label AS final_label_1 FROM s WHERE split = 'train')
  JOIN (SELECT DISTINCT {VECTOR}, final_label AS final_label_2 FROM s WHERE split = 'val') USING ({VECTOR}) GROUP BY ALL""", *CLEAN).replace(" SELECT final_label_1", f", s AS ({SPLIT_SQL}) SELECT final_label_1", 1))
def overlap_label_pairs(spark, d):
    parts = _parts(spark, d)
    return dedup.label_pairs(parts["train"], parts["val"], FEATURES, "final_label").groupBy("final_label_1", "final_label_2").agg(F.count(F.lit(1)).alias("n"))


@R.add(sql("""SELECT page_id, length(query)::INT AS query_length, (len(string_split(query, '.')) - 1)::INT AS num_dots, len(string_split(query, '.'))::INT AS num_subdomains,
  list_max(list_transform(string_split(query, '.'), lambda x: length(x)))::INT AS max_label_length, round(list_avg(list_transform(string_split(query, '.'), lambda x: length(x))), 6) AS avg_label_length,
  len(regexp_extract_all(query, '[0-9]'))::INT AS digit_count, len(regexp_extract_all(query, '[a-zA-Z]'))::INT AS alpha_count, len(regexp_extract_all(query, '[^a-zA-Z0-9.]'))::INT AS special_character_count,
  round(coalesce((SELECT -sum(n * 1.0 / t * log2(n * 1.0 / t)) FROM (SELECT count(*) AS n, length(query) AS t FROM (SELECT unnest(string_split(query, '')) AS c) GROUP BY c)), 0), 6) AS entropy FROM hosts""", "hosts"))
def dns_features_of_hosts(spark, d):
    out = hosts(spark, d).withColumns(dns_features(F.col("query"))).drop("query")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_label_length", "entropy")})


#: Columns of raw tables and what each rule leaves of them.
_RULES = {
    "label column": (("label", "frame_number", "label_name"), ("label_name",)),
    "label column, other case": (("x", "label", "Label"), ("Label",)),
    "label column, none": (("x", "y"), ("x",)),
    "ARP": (("frame_number", "tcp_seq", "frame_len", "arp_src_hw_mac", "data_len", "tcp_flag_fin", "label_name", "final_label"), ("frame_number", "tcp_seq", "data_len", "tcp_flag_fin", "final_label")),
    "5G": (("some_metric", "Src_IP", "Dst_IP", "Dst_MAC", "Attack_Type", "attack", "attack_cat", "sub_cat", "attack_tool", "Label", "final_label"), ("some_metric", "attack_tool", "final_label")),
    "features": (("flow_duration", "packet_count", "src_mac", "dst_ip", "label_name", "Label", "final_label"), ("flow_duration", "packet_count")),
    "suspicious": (("Target", "SourceIP", "Timestamp", "Src Port", "NormalFeature", "mac_count"), ("SourceIP", "Timestamp", "Src Port")),
    "original labels": (("a", "Label_Name", "label", "attack"), ("a", "attack")),
}


#: Columns of line items that stand under the raw names, in turn.
_HELD = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _held(rule: str, c: str) -> str:
    return _HELD[_RULES[rule][0].index(c) % len(_HELD)]


@R.add(" UNION ALL ".join(f"SELECT '{rule}' AS rule, {i} AS place, '{c}' AS \"column\", round(sum({_held(rule, c)}), 2) AS total FROM lineitem" for rule, (_, left) in _RULES.items() for i, c in enumerate(left)))
def selected_columns(spark, d):
    """What the rules of column selection leave of raw tables, and the sums of what is left."""
    raw = lambda rule: table(spark, d, "lineitem").select(*[F.col(_held(rule, c)).alias(c) for c in _RULES[rule][0]])
    left = {rule: [taxonomy.label_column(raw(rule).columns)] for rule in _RULES if rule.startswith("label")}
    left |= {
        "ARP": clean_ops.arp_columns(raw("ARP")).columns, "5G": clean_ops.fiveg_columns(raw("5G")).columns, "features": clean_ops.feature_columns(raw("features")),
        "suspicious": clean_ops.suspicious_columns(_RULES["suspicious"][0], "Target"), "original labels": clean_ops.drop_labels(raw("original labels")).columns,
    }
    sums = table(spark, d, "lineitem").agg(*[F.round(F.sum(c), 2).alias(c) for c in _HELD])  # one scan for all rules
    rows = [F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(_held(rule, c)).alias("total")) for rule, columns in left.items() for i, c in enumerate(columns)]
    return sums.select(F.inline(F.array(*rows)))


@R.add("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '10.0.' || (event_id // 254 + 1) || '.' || (event_id % 254 + 1) ELSE '10.9.0.' || (user_id % 20) END AS src_ip, '192.168.1.100' AS dst_ip,
  CASE WHEN event_id % 5 = 0 THEN 40000 + event_id % 20000 ELSE user_id END::INT AS src_port, CASE WHEN event_id % 2 = 0 THEN 80 ELSE 443 END::INT AS dst_port, CASE WHEN event_type = 'view' THEN 17 ELSE 6 END::INT AS proto FROM events""")
def connection_columns(spark, d):
    """Who talks to whom, in an upload of other names with gaps."""
    n = F.col("event_id")
    upload = table(spark, d, "events").select(n, F.when(n % 7 != 0, F.concat(F.lit("10.9.0."), (F.col("user_id") % 20).cast("string"))).alias("Source_IP"), F.when(n % 5 != 0, F.col("user_id")).alias("SPORT"), F.when(F.col("event_type") == "view", "17").when(F.col("event_type") == "click", "tcp").alias("Protocol Type"))
    return taxonomy.connection_columns(upload, "event_id").select("event_id", *taxonomy.CONNECTION)


@R.add(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9]'))::INT AS digit_count, len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]'))::INT AS alpha_count, len(regexp_extract_all(coalesce(text, ''), '[^a-zA-Z0-9.]'))::INT AS special_character_count FROM documents")
def character_counts(spark, d):
    """Counts of characters in texts of several languages, whose letters outside a-z are special characters."""
    counts = dns_features(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[counts[c].alias(c) for c in ("digit_count", "alpha_count", "special_character_count")])


@R.add("SELECT count(*) > 1000 AS sampled, count(*) AS original_train_rows, CASE WHEN count(*) > 1000 THEN (SELECT sum(least(n, greatest(1, 1000 // (SELECT count(DISTINCT event_type) FROM events)))) FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) ELSE count(*) END::BIGINT AS used_train_rows, CASE WHEN count(*) > 1000 THEN 'stratified_minority_preserving' ELSE 'none' END AS sampling_method, CASE WHEN count(*) > 1000 THEN greatest(1, 1000 // count(DISTINCT event_type)) END::BIGINT AS target_per_majority_class FROM events")
def minority_sample_metadata(spark, d):
    from ..operators.splits import sample_metadata

    return sample_metadata(table(spark, d, "events"), "event_type", 1000)


@R.add(sql("SELECT page_id, length(query)::INT AS query_length, len(string_split(query, '.'))::INT AS subdomain_count, len(regexp_extract_all(query, '[^\\p{L}\\p{N}.]'))::INT AS special_character_count FROM hosts", "hosts"))
def live_dns_features_of_hosts(spark, d):
    return hosts(spark, d).withColumns(live_dns_features(F.col("query"))).drop("query", "entropy")


def _wide(spark, d):
    """lineitem under the names that the engineered features need."""
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), F.col("l_quantity").alias("Total Fwd Packets"), F.col("l_linenumber").cast("double").alias("Total Backward Packets"), F.col("l_extendedprice").alias("Fwd Packets Length Total"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("Bwd Packets Length Total"), F.col("l_partkey").cast("double").alias("Fwd Header Length"), F.col("l_suppkey").cast("double").alias("Flow IAT Max"), F.col("l_tax").alias("Flow IAT Min"), F.lit(0).alias("Bwd PSH Flags"),
    )


@R.add("""SELECT key, round((f / (b + 1::FLOAT))::DOUBLE, 3) AS fwd_bwd_pkt_ratio, round((f + b)::DOUBLE, 3) AS total_flow_packets, round((x / (f + 1::FLOAT))::DOUBLE, 1) AS bytes_per_fwd_pkt, round((y / (b + 1::FLOAT))::DOUBLE, 1) AS bytes_per_bwd_pkt,
  round((h / (x + 1::FLOAT))::DOUBLE, 3) AS hdr_payload_ratio_fwd, round((hi - lo)::DOUBLE, 3) AS flow_iat_spread FROM (SELECT l_orderkey * 8 + l_linenumber AS key, l_quantity::FLOAT AS f, l_linenumber::FLOAT AS b, l_extendedprice::FLOAT AS x,
  (l_extendedprice * l_discount)::FLOAT AS y, l_partkey::FLOAT AS h, l_suppkey::FLOAT AS hi, l_tax::FLOAT AS lo FROM lineitem)""")
def engineered_features(spark, d):
    places = {"bytes_per_fwd_pkt": 1, "bytes_per_bwd_pkt": 1}
    out = engineered(_wide(spark, d))
    return out.select("key", *[F.round(F.col(n).cast("double"), places.get(n, 3)).alias(n) for n, _, _ in ENGINEERED if not n.endswith(("byte_ratio", "flow_bytes"))])


@R.add("SELECT count(*) AS n_rows, 15 AS n_columns FROM lineitem")
def engineered_representation(spark, d):
    out = clean_ops.representation(_wide(spark, d), "engineered").drop("key")
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(out.columns)).alias("n_columns"))


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _numbers(spark, d):
    return table(spark, d, "lineitem").select(*NUMBERS, (F.col("l_quantity") * 2 + 1).alias("doubled"), F.lit(7.0).alias("fixed"))


_UNPIVOTED = " UNION ALL ".join(f"SELECT '{c}' AS feature, {e}::DOUBLE AS value FROM lineitem" for c, e in (*((c, c) for c in NUMBERS), ("doubled", "l_quantity * 2 + 1"), ("fixed", "7.0")))
ALL_NUMBERS = (*NUMBERS, "doubled", "fixed")


@R.add(f"SELECT feature, count(DISTINCT value) AS n_distinct, count(DISTINCT value) <= 1 AS is_constant FROM ({_UNPIVOTED}) GROUP BY feature")
def constant_columns(spark, d):
    return profile.constant_columns(_numbers(spark, d), ALL_NUMBERS)


@R.add(f"SELECT row_number() OVER (ORDER BY variance DESC, feature)::INT AS rank, feature, round(variance, 3) AS variance FROM (SELECT feature, var_samp(value) AS variance FROM ({_UNPIVOTED}) GROUP BY feature)")
def feature_variance_rank(spark, d):
    return profile.variance_rank(_numbers(spark, d), ALL_NUMBERS).withColumn("variance", F.round("variance", 3))


@R.add(f"""SELECT feature, round(max(n) / sum(n), 6)::DOUBLE AS dominant_share, max(n) / sum(n) >= 0.999 AND count(*) > 1 AS is_quasi_constant FROM (SELECT feature, value, count(*) AS n FROM ({_UNPIVOTED}) GROUP BY ALL) GROUP BY feature""")
def quasi_constant(spark, d):
    return profile.quasi_constant(_numbers(spark, d), ALL_NUMBERS).withColumn("dominant_share", F.round("dominant_share", 6))


@R.add("SELECT 'l_quantity' AS feature_1, 'doubled' AS feature_2, round(abs(corr(l_quantity, l_quantity * 2 + 1)), 6) AS correlation FROM lineitem")
def high_correlation(spark, d):
    return profile.correlations(_numbers(spark, d), ALL_NUMBERS).withColumn("correlation", F.round("correlation", 6))


_SCALED = "SELECT feature, coalesce(value, m) AS v, m AS median FROM (SELECT feature, value, median(value) OVER (PARTITION BY feature) AS m FROM (SELECT 'l_quantity' AS feature, CASE WHEN isnan(l_quantity) OR isinf(l_quantity) THEN NULL ELSE l_quantity END AS value FROM labelled UNION ALL SELECT 'l_tax', l_tax FROM labelled))"
_STATS = f"SELECT feature, median, avg(v) AS mean, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS std FROM ({_SCALED}) GROUP BY feature, median"


@R.add(sql(f"SELECT feature, round(median, 6) AS median, round(round(mean, 12), 6) AS mean, round(round(std, 12), 6) AS std FROM ({_STATS})", "labelled"))
def scaler_stats(spark, d):
    stats = profile.scaler_statistics(labelled(spark, d), ("l_quantity", "l_tax"))
    # sums of doubles differ in their last digits by the order of rows: these go first, so that ties are rounded alike
    return stats.select("feature", F.round("median", 6).alias("median"), *[F.round(F.round(c, 12), 6).alias(c) for c in ("mean", "std")])


@R.add(sql(f"""SELECT key, round((coalesce(CASE WHEN isnan(l_quantity) OR isinf(l_quantity) THEN NULL ELSE l_quantity END, s.median) - s.mean) / s.std, 4) AS l_quantity, round((l_tax - t.mean) / t.std, 4) AS l_tax
  FROM labelled, (SELECT * FROM ({_STATS}) WHERE feature = 'l_quantity') s, (SELECT * FROM ({_STATS}) WHERE feature = 'l_tax') t""", "labelled"))
def standardize(spark, d):
    rows = labelled(spark, d)
    pre = score.Preprocessor.fit(rows, ("l_quantity", "l_tax"), CLASSES)
    scaled = {f: F.round(score.standardized(F.col(f), pre.medians[f], pre.means[f], pre.stds[f]), 4).alias(f) for f in pre.features}
    return rows.select("key", *scaled.values())


_N = "SELECT final_label AS label, count(*) AS n FROM clean GROUP BY ALL"
_INVERSE = "sum(n) OVER () * 1.0::DOUBLE / (count(*) OVER () * n)"
_RAW = {"unweighted": "1.0::DOUBLE", "balanced": _INVERSE, "capped_balanced": f"least({_INVERSE}, 25.0)", "sqrt_balanced": f"sqrt({_INVERSE})", "effective_samples": "(1 - 0.999::DOUBLE) / greatest(1 - pow(0.999::DOUBLE, n), 1e-8)"}


def _weights(strategy: str):
    scale = " / avg(w) OVER ()" if strategy in ("sqrt_balanced", "effective_samples") else ""
    text = sql(f"SELECT label, n, round(w{scale}, 6) AS weight FROM (SELECT label, n, {_RAW[strategy]} AS w FROM ({_N}))", *CLEAN)

    @R.add(text, name=f"class_weights_{strategy}")
    def run(spark, d):
        return profile.class_weights(clean(spark, d), "final_label", strategy).withColumn("weight", F.round("weight", 6))


for _s in profile.WEIGHTS:
    _weights(_s)


@R.add(sql(f"SELECT final_label, count(*) AS n, round(min(weight), 5) AS weight FROM clean JOIN (SELECT label, sqrt({_INVERSE}) / avg(sqrt({_INVERSE.replace('OVER ()', '')})) AS weight FROM ({_N})) ON label = final_label GROUP BY ALL", *CLEAN).replace(f"sqrt({_INVERSE}) / avg(sqrt({_INVERSE.replace('OVER ()', '')}))", "w / avg(w) OVER ()").replace(f"FROM ({_N})) ON", f"FROM (SELECT label, sqrt({_INVERSE}) AS w FROM ({_N}))) ON"))
def sample_weights(spark, d):
    weighted = profile.with_sample_weights(clean(spark, d), "final_label")
    return weighted.groupBy("final_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("sample_weight").cast("double"), 5).alias("weight"))


@R.add("SELECT count(*) AS n_rows, 5 AS n_columns, 0::BIGINT AS missing_cells, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)) AS duplicate_rows FROM lineitem")
def dataset_profile(spark, d):
    return profile.dataset_profile(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


_SIZED = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("o_orderkey", "o_custkey", "o_orderstatus"))


@R.add(f"SELECT o_orderkey, sha256({_SIZED}) AS digest FROM orders")
def row_digests(spark, d):
    return table(spark, d, "orders").select("o_orderkey", row_digest("o_orderkey", "o_custkey", "o_orderstatus").alias("digest"))


_COMMON = [c for c, _, _ in taxonomy.COMMON_SCHEMA]


@R.add("SELECT 'IDS2018' AS dataset, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem UNION ALL SELECT 'CICIoT2023', count(*), round(sum(o_totalprice), 2) FROM orders")
def common_schema_union(spark, d):
    a = table(spark, d, "lineitem").select(*[F.col("l_quantity").alias(x) for _, x, _ in taxonomy.COMMON_SCHEMA])
    b = table(spark, d, "orders").select(*[F.col("o_totalprice").alias(y) for _, _, y in taxonomy.COMMON_SCHEMA])
    return taxonomy.common_schema(a, b).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(_COMMON[-1]), 2).alias("total"))
