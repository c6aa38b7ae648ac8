"""Parsing, labels, cleaning, feature selection and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.functions.bounded import small_table
from flowguard.functions.numbers import clip, clip_error, missing_if_not_finite, sanitise, usable_threshold
from flowguard.functions.quantiles import quantiles
from flowguard.operators import cleaning, labels, messages, scaling

from flowguard.sources.paths import stage

from .testmap import (
    FLOW_FEATURES,
    FLOWS,
    FLOWS_WITH_COPIES_SQL,
    MESSAGE_WIDTH,
    MESSAGES,
    flows_with_copies,
    rounded,
    sql,
    table,
    view,
)

QUERIES, SQL = {}, {}


def query(name, text=None):
    def register(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return register


# --- messages ---

# Field rule of the SQL side: DuckDB's own cast, which agrees on these texts.
_PARSED = f"""m AS ({sql(MESSAGES)}),
parsed AS (
  SELECT event_id, coalesce(nullif(device_id, ''), 'unknown') AS device_id, csv_data, timestamp,
    str_split(csv_data, ',') AS fields,
    list_transform(str_split(csv_data, ','), lambda x: try_cast(x AS DOUBLE)) AS features FROM m),
checked AS (
  SELECT *, coalesce(len(features) = {MESSAGE_WIDTH} AND len(list_filter(features, lambda x: x IS NULL)) = 0, false)
    AS is_valid FROM parsed)"""


def parsed(spark, sf):
    return messages.parse_messages(view(spark, sf, MESSAGES), MESSAGE_WIDTH)


@query(
    "S5_bus_projection",
    "SELECT CAST(user_id AS VARCHAR) AS device_id, props AS csv_data, ts AS timestamp FROM events",
)
def bus(spark, sf):
    records = table(spark, sf, "events").selectExpr(
        "CAST(CAST(user_id AS STRING) AS BINARY) AS key", "CAST(props AS BINARY) AS value", "ts AS timestamp"
    )
    return messages.bus_messages(records)


@query(
    "P1_parse_csv",
    f"""WITH {_PARSED} SELECT event_id, round(features[1], 6) AS f0, round(features[2], 6) AS f1,
    round(features[3], 6) AS f2, CAST(len(features) AS INTEGER) AS width FROM parsed""",
)
def parse(spark, sf):
    return parsed(spark, sf).select(
        "event_id",
        *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(3)],
        F.when(F.col("features").isNotNull(), F.size("features")).alias("width"),
    )


@query(
    "P2_valid_and_rejected",
    f"""WITH {_PARSED} SELECT device_id, count(*) FILTER (is_valid) AS valid,
      count(*) FILTER (NOT is_valid) AS rejected FROM checked GROUP BY device_id""",
)
def validity(spark, sf):
    return parsed(spark, sf).groupBy("device_id").agg(
        F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("rejected")
    )


@query(
    "P2_rejected_messages",
    f"WITH {_PARSED} SELECT event_id, device_id, csv_data, timestamp FROM checked WHERE NOT is_valid",
)
def rejected(spark, sf):
    return messages.rejected_messages(parsed(spark, sf))


@query(
    "P3_default_device",
    f"WITH {_PARSED} SELECT device_id, count(*) AS n FROM parsed GROUP BY device_id",
)
def devices(spark, sf):
    return view(spark, sf, MESSAGES).groupBy(
        messages.device_or_unknown(F.col("device_id")).alias("device_id")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- scalar rules ---

_ODD = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN l_partkey % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN l_partkey % 7 = 1 THEN CAST('inf' AS DOUBLE)
       WHEN l_partkey % 7 = 2 THEN CAST('-inf' AS DOUBLE) WHEN l_partkey % 7 = 3 THEN NULL
       ELSE l_extendedprice - 50000 END AS v FROM lineitem"""
_ODD_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def odd_values(spark, sf):
    line = table(spark, sf, "lineitem")
    odd = _ODD[_ODD.index("CASE") : _ODD.index(" FROM")]
    return line.selectExpr(*_ODD_KEY, odd)


@query(
    "P5_missing_if_not_finite",
    f"""SELECT {', '.join(_ODD_KEY)}, round(CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END, 6) AS v
    FROM ({_ODD})""",
)
def not_finite(spark, sf):
    rows = odd_values(spark, sf)
    return rows.select(*_ODD_KEY, F.round(missing_if_not_finite(F.col("v")), 6).alias("v"))


@query(
    "P9_sanitise",
    f"""SELECT {', '.join(_ODD_KEY)}, round(CASE WHEN v IS NULL OR isnan(v) THEN 0.0
      WHEN isinf(v) AND v > 0 THEN 1e6 WHEN isinf(v) THEN -1e6 ELSE v END, 6) AS v FROM ({_ODD})""",
)
def sanitised(spark, sf):
    rows = odd_values(spark, sf)
    return rows.select(*_ODD_KEY, F.round(sanitise(F.col("v")), 6).alias("v"))


@query(
    "P10_clip_scaled",
    f"""SELECT {', '.join(_ODD_KEY)}, round(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN NULL
      ELSE greatest(-5, least(5, v / 3001)) END, 6) AS v FROM ({_ODD})""",
)
def clipped(spark, sf):
    rows = odd_values(spark, sf)
    scaled = missing_if_not_finite(F.col("v")) / 3001
    return rows.select(*_ODD_KEY, F.round(clip(scaled, -5.0, 5.0), 6).alias("v"))


@query(
    "P11_clamp_error",
    f"""SELECT {', '.join(_ODD_KEY)}, round(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN NULL
      ELSE greatest(1e-10, least(1e6, v * v)) END, 6) AS v FROM ({_ODD})""",
)
def clamped(spark, sf):
    rows = odd_values(spark, sf)
    value = missing_if_not_finite(F.col("v"))
    return rows.select(*_ODD_KEY, F.round(clip_error(value * value), 6).alias("v"))


@query(
    "S11_threshold_guard",
    f"""SELECT {', '.join(_ODD_KEY)}, round(CASE WHEN v IS NULL OR isnan(v) OR v <= 0 THEN 0.01 ELSE v END, 6) AS v
    FROM ({_ODD})""",
)
def guarded(spark, sf):
    rows = odd_values(spark, sf)
    return rows.select(*_ODD_KEY, F.round(usable_threshold(F.col("v")), 6).alias("v"))


# --- labels ---

_GROUP = """CASE WHEN Label IN ('DoS Hulk', 'DoS GoldenEye', 'DoS slowloris', 'DoS Slowhttptest', 'DDoS') THEN 'DoS'
  WHEN Label LIKE 'Web Attack%' THEN 'Web Attack' WHEN Label IN ('FTP-Patator', 'SSH-Patator') THEN 'Brute Force'
  WHEN Label = 'PortScan' THEN 'Reconnaissance' WHEN Label = 'Bot' THEN 'Malware'
  WHEN Label IN ('Infiltration', 'Heartbleed') THEN 'Advanced Attack' ELSE Label END"""
_CLEAN = f"""flows AS ({sql(FLOWS)}), copies AS ({FLOWS_WITH_COPIES_SQL}),
grouped AS (SELECT * REPLACE ({_GROUP} AS Label) FROM flows),
vocab AS (SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS BIGINT) AS class_index
  FROM (SELECT DISTINCT Label AS class FROM grouped))"""


def grouped(spark, sf):
    return view(spark, sf, FLOWS).withColumn("Label", labels.group_label(F.col("Label")))


@query("P4_label_groups", f"WITH {_CLEAN} SELECT device, Label, count(*) AS n FROM grouped GROUP BY ALL")
def label_groups(spark, sf):
    return grouped(spark, sf).groupBy("device", "Label").agg(F.count(F.lit(1)).alias("n"))


@query("C10_class_counts", f"WITH {_CLEAN} SELECT Label, count(*) AS count FROM grouped GROUP BY Label")
def class_counts(spark, sf):
    return cleaning.class_counts(grouped(spark, sf))


@query(
    "C11_label_occurrences",
    f"WITH {_CLEAN} SELECT Label AS class, count(*) AS occurrences_number FROM grouped GROUP BY Label",
)
def occurrences(spark, sf):
    return cleaning.label_occurrences(grouped(spark, sf))


@query("T8_vocabulary", f"WITH {_CLEAN} SELECT * FROM vocab")
def vocabulary(spark, sf):
    rows = grouped(spark, sf)
    parts = [rows.where(F.col("f_rare") == v) for v in (0.0, 1.0)]
    return labels.vocabulary_table(parts)


@query(
    "T9_encode_decode",
    f"""WITH {_CLEAN} SELECT Label AS label, class_index AS code, class AS decoded, count(*) AS n
    FROM grouped JOIN vocab ON class = Label GROUP BY ALL""",
)
def encode_decode(spark, sf):
    rows = grouped(spark, sf)
    classes = labels.vocabulary([rows])
    code = labels.encode(F.col("Label"), classes)
    coded = rows.select(F.col("Label").alias("label"), code.alias("code"))
    return coded.withColumn("decoded", labels.decode(F.col("code"), classes)).groupBy(
        "label", "code", "decoded"
    ).agg(F.count(F.lit(1)).alias("n"))


# --- cleaning ---


@query(
    "C1_distinct_rows",
    f"""WITH {_CLEAN}, d AS (SELECT DISTINCT * FROM copies)
    SELECT device, Label, count(*) AS n, round(sum(f_qty), 6) AS qty FROM d GROUP BY device, Label""",
)
def distinct_rows(spark, sf):
    rows = cleaning.drop_duplicate_rows(flows_with_copies(spark, sf))
    return rounded(
        rows.groupBy("device", "Label").agg(F.count(F.lit(1)).alias("n"), F.sum("f_qty").alias("qty"))
    )


@query(
    "C12_rows_removed",
    f"""WITH {_CLEAN} SELECT (SELECT count(*) FROM copies) AS rows_before,
      (SELECT count(*) FROM (SELECT DISTINCT * FROM copies)) AS rows_after,
      (SELECT count(*) FROM copies) - (SELECT count(*) FROM (SELECT DISTINCT * FROM copies)) AS rows_removed""",
)
def rows_removed(spark, sf):
    return cleaning.duplicates_removed(flows_with_copies(spark, sf))


@query(
    "P6_numeric_columns",
    "SELECT unnest(["
    + ", ".join(f"'{c}'" for c in FLOW_FEATURES)
    + "]) AS feature, (SELECT count(*) FROM lineitem) AS n",
)
def numeric(spark, sf):
    rows = view(spark, sf, FLOWS)
    n = rows.count()
    found = [{"feature": c, "n": n} for c in cleaning.numeric_columns(rows, ["Label"])]
    return small_table(spark, found, "feature string, n long")


@query(
    "P7_projection",
    f"WITH {_CLEAN} SELECT f_qty, f_disc, Label, count(*) AS n FROM grouped GROUP BY ALL",
)
def projection(spark, sf):
    return grouped(spark, sf).select("f_qty", "f_disc", "Label").groupBy("f_qty", "f_disc", "Label").agg(
        F.count(F.lit(1)).alias("n")
    )


_FINITE = ", ".join(f"CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in FLOW_FEATURES)
_FINITE_CTE = f"""{_CLEAN}, finite AS (SELECT {_FINITE}, device, Label FROM grouped)"""


def finite(spark, sf):
    return cleaning.missing_for_not_finite(grouped(spark, sf), FLOW_FEATURES)


@query(
    "C2_median_fill",
    f"""WITH {_FINITE_CTE}, m AS (SELECT quantile_cont(f_price, 0.5) AS m FROM finite)
    SELECT device, round(sum(coalesce(f_price, m)), 3) AS sum_price,
      count(*) FILTER (f_price IS NULL) AS filled FROM finite, m GROUP BY device""",
)
def median_fill(spark, sf):
    rows = finite(spark, sf)
    middle = cleaning.medians(rows, FLOW_FEATURES)
    marked = rows.withColumn("_gap", F.col("f_price").isNull())
    full = cleaning.fill_missing(marked, middle)
    return full.groupBy("device").agg(
        F.round(F.sum("f_price"), 3).alias("sum_price"), F.count_if("_gap").alias("filled")
    )


def _long_sql(expression: str, source: str = "finite") -> str:
    """One row per feature: ``expression`` with {c} for the column."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {expression.format(c=c)} FROM {source}" for c in FLOW_FEATURES
    )


def flags(spark, chosen) -> object:
    rows = [{"feature": c, "dropped": c in chosen} for c in FLOW_FEATURES]
    return small_table(spark, rows, "feature string, dropped boolean")


@query("C3_constant_columns", f"WITH {_FINITE_CTE} {_long_sql('count(DISTINCT {c}) <= 1 AS dropped')}")
def constant(spark, sf):
    spread = cleaning.column_spread(finite(spark, sf), FLOW_FEATURES)
    return flags(spark, cleaning.constant_columns(spread))


@query("C4_near_constant_columns", f"WITH {_FINITE_CTE} {_long_sql('stddev_samp({c}) < 1e-6 AS dropped')}")
def near_constant(spark, sf):
    spread = cleaning.column_spread(finite(spark, sf), FLOW_FEATURES)
    return flags(spark, cleaning.near_constant_columns(spread))


_QUARTILES = "quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3"


@query(
    "C5_outlier_bounds",
    f"""WITH {_FINITE_CTE}, q AS ({_long_sql(_QUARTILES)})
    SELECT feature, round(q1 - 3 * (q3 - q1), 6) AS low, round(q3 + 3 * (q3 - q1), 6) AS high,
      round(q2, 6) AS median FROM q""",
)
def bounds(spark, sf):
    found = quantiles(finite(spark, sf), FLOW_FEATURES, [0.25, 0.5, 0.75])
    rows = [
        dict(zip(("feature", "low", "high", "median"), (c, *cleaning.outlier_bounds(q), q[1])))
        for c, q in found.items()
    ]
    return rounded(small_table(spark, rows, "feature string, low double, high double, median double"))


_KEPT = ["f_qty", "f_price", "f_disc", "f_tax"]


def _clip_sql(c: str) -> str:
    return f"least(greatest(coalesce({c}, {c}_q2), {c}_q1 - 3 * ({c}_q3 - {c}_q1)), {c}_q3 + 3 * ({c}_q3 - {c}_q1))"


_ANOMALY_CLEAN = f"""{_FINITE_CTE},
q AS (SELECT {', '.join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_q2, quantile_cont({c}, 0.75) AS {c}_q3" for c in FLOW_FEATURES)} FROM finite),
smooth AS (SELECT {', '.join(f'{_clip_sql(c)} AS {c}' for c in FLOW_FEATURES)}, device FROM finite, q)"""


@query(
    "C5_winsorised",
    f"""WITH {_ANOMALY_CLEAN} SELECT device, count(*) AS n, round(sum(f_qty), 3) AS f_qty,
      round(sum(f_price), 3) AS f_price, round(max(f_tail), 6) AS f_tail FROM smooth GROUP BY device""",
)
def winsorised(spark, sf):
    rows = view(spark, sf, FLOWS)
    found = quantiles(finite(spark, sf), FLOW_FEATURES, [0.25, 0.5, 0.75])
    params = cleaning.CleanParams(
        FLOW_FEATURES,
        {c: q[1] for c, q in found.items()},
        {c: cleaning.outlier_bounds(q) for c, q in found.items()},
    )
    smooth = cleaning.apply_anomaly_cleaning(rows, params, keep=["device"])
    return smooth.groupBy("device").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("f_qty"), 3).alias("f_qty"),
        F.round(F.sum("f_price"), 3).alias("f_price"),
        F.round(F.max("f_tail"), 6).alias("f_tail"),
    )


def _correlated_sql(source: str, columns: list[str], limit: float) -> str:
    """Pairs computed as covariance over deviations, NULL where a side has none."""
    parts = []
    for j, b in enumerate(columns):
        tests = [
            f"coalesce(abs(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)) > {limit}, false)"
            for a in columns[:j]
        ]
        parts.append(f"SELECT '{b}' AS feature, {' OR '.join(tests) or 'count(*) < 0'} AS dropped FROM {source}")
    return " UNION ALL ".join(parts)


_VARYING = [c for c in FLOW_FEATURES if c != "f_const"]


@query(
    "C6_correlated_columns",
    f"""WITH {_FINITE_CTE}, m AS (SELECT quantile_cont(f_price, 0.5) AS m FROM finite),
    filled AS (SELECT finite.* REPLACE (coalesce(f_price, m) AS f_price) FROM finite, m)
    {_correlated_sql('filled', _VARYING, 0.95)}""",
)
def correlated(spark, sf):
    rows = finite(spark, sf)
    full = cleaning.fill_missing(rows, cleaning.medians(rows, _VARYING))
    found = cleaning.correlated_columns(cleaning.correlation_matrix(full, _VARYING), _VARYING, 0.95)
    return small_table(
        spark, [{"feature": c, "dropped": c in found} for c in _VARYING], "feature string, dropped boolean"
    )


@query(
    "C6_correlation_wide",
    f"""WITH {_FINITE_CTE}, m AS (SELECT quantile_cont(f_price, 0.5) AS m FROM finite),
    filled AS (SELECT finite.* REPLACE (coalesce(f_price, m) AS f_price) FROM finite, m)
    """
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM filled"
        for i, a in enumerate(_VARYING)
        for b in _VARYING[i + 1 :]
    ),
)
def correlation_wide(spark, sf):
    """All pairs of the varying columns."""
    rows = finite(spark, sf)
    full = cleaning.fill_missing(rows, cleaning.medians(rows, _VARYING))
    matrix = cleaning.correlation_matrix(full, _VARYING)
    cells = [
        {"a": a, "b": b, "r": float(matrix[i, j])}
        for i, a in enumerate(_VARYING)
        for j, b in enumerate(_VARYING)
        if i < j
    ]
    return rounded(small_table(spark, cells, "a string, b string, r double"))


@query("C7_low_variance_columns", f"WITH {_ANOMALY_CLEAN} {_long_sql('var_samp({c}) < 0.01 AS dropped', 'smooth')}")
def low_variance(spark, sf):
    rows = view(spark, sf, FLOWS)
    found = quantiles(finite(spark, sf), FLOW_FEATURES, [0.25, 0.5, 0.75])
    params = cleaning.CleanParams(
        FLOW_FEATURES,
        {c: q[1] for c, q in found.items()},
        {c: cleaning.outlier_bounds(q) for c, q in found.items()},
    )
    smooth = cleaning.apply_anomaly_cleaning(rows, params)
    return flags(spark, cleaning.low_variance_columns(cleaning.column_spread(smooth, FLOW_FEATURES)))


@query(
    "C8_anomaly_cleaned",
    f"""WITH {_ANOMALY_CLEAN} SELECT device, count(*) AS n, CAST(0 AS BIGINT) AS missing,
      {', '.join(f'round(sum({c}), 3) AS {c}' for c in _KEPT)} FROM smooth GROUP BY device""",
)
def anomaly_cleaned(spark, sf):
    """The whole recipe: which columns survive and what remains of them."""
    rows = view(spark, sf, FLOWS)
    params = cleaning.fit_anomaly_cleaning(rows, exclude=["device", "Label"])
    clean = cleaning.apply_anomaly_cleaning(rows, params, keep=["device"])
    kept = params.feature_columns
    gap = F.greatest(*[F.col(c).isNull() for c in kept])
    return clean.groupBy("device").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(gap).alias("missing"),
        *[F.round(F.sum(c), 3).alias(c) for c in kept],
    )


_CLASSIFIER_KEPT = ["f_qty", "f_price", "f_disc", "f_tax", "f_rare", "f_tail"]


@query(
    "P8_classifier_cleaned",
    f"""WITH c AS ({FLOWS_WITH_COPIES_SQL}), g AS (SELECT DISTINCT * REPLACE ({_GROUP} AS Label) FROM c),
    fin AS (SELECT * REPLACE (CASE WHEN isinf(f_price) THEN NULL ELSE f_price END AS f_price) FROM g),
    m AS (SELECT quantile_cont(f_price, 0.5) AS m FROM fin)
    SELECT Label, count(*) AS n, round(sum(coalesce(f_price, m)), 2) AS f_price,
      {', '.join(f'round(sum({c}), 3) AS {c}' for c in _CLASSIFIER_KEPT if c != 'f_price')}
    FROM fin, m GROUP BY Label""",
)
def classifier_cleaned(spark, sf):
    """Label grouping, de-duplication, selection and filling; the label stays on its row.

    The distinct rows are written once, as three fits and the result read them.
    """
    rows = stage(cleaning.prepare_labelled_flows(flows_with_copies(spark, sf)), "distinct")
    params = cleaning.fit_classifier_cleaning(rows, exclude=["device"])
    clean = cleaning.apply_classifier_cleaning(rows, params)
    return clean.groupBy("Label").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.sum(c), 2 if c == "f_price" else 3).alias(c) for c in params.feature_columns],
    )


@query(
    "C9_table_profile",
    f"""WITH {_FINITE_CTE} SELECT count(*) AS row_count, CAST({len(FLOW_FEATURES)} AS BIGINT) AS feature_count,
      round(least({', '.join(f'min({c})' for c in FLOW_FEATURES)}), 6) AS lowest,
      round(greatest({', '.join(f'max({c})' for c in FLOW_FEATURES)}), 6) AS highest FROM finite""",
)
def profile(spark, sf):
    return rounded(cleaning.table_profile(finite(spark, sf), FLOW_FEATURES))


# --- scaling ---

_SCALED = ["f_qty", "f_disc", "f_const", "f_rare"]


def _scaled_output(df):
    """Sums of exact decimals: unlike those of doubles they don't depend on the order of the rows."""
    return df.groupBy("device").agg(
        *[F.sum(F.round(c, 6).cast("decimal(20,6)")).cast("double").alias(c) for c in _SCALED],
        *[F.round(F.max(c), 6).alias(f"{c}_max") for c in _SCALED],
    )


def _scaled_sql(expression: str, fit: str) -> str:
    columns = ", ".join(f"{expression.format(c=c)} AS {c}" for c in _SCALED)
    sums = ", ".join(
        f"sum(round({c}, 6)::DECIMAL(20, 6))::DOUBLE AS {c}, round(max({c}), 6) AS {c}_max" for c in _SCALED
    )
    fits = ", ".join(fit.format(c=c) for c in _SCALED)
    return f"""WITH {_CLEAN}, fit AS (SELECT {fits} FROM flows),
    scaled AS (SELECT device, {columns} FROM flows, fit) SELECT device, {sums} FROM scaled GROUP BY device"""


@query(
    "F1_standardise",
    _scaled_sql(
        "({c} - {c}_a) / coalesce(nullif({c}_s, 0), 1)", "avg({c}) AS {c}_a, stddev_pop({c}) AS {c}_s"
    ),
)
def standardise(spark, sf):
    rows = view(spark, sf, FLOWS)
    return _scaled_output(scaling.scale_columns(rows, scaling.fit_standard(rows, _SCALED)))


_ROBUST_FIT = "quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_r"


@query("F2_robust_scale", _scaled_sql("({c} - {c}_m) / coalesce(nullif({c}_r, 0), 1)", _ROBUST_FIT))
def robust(spark, sf):
    rows = view(spark, sf, FLOWS)
    return _scaled_output(scaling.scale_columns(rows, scaling.fit_robust(rows, _SCALED)))


@query(
    "F3_robust_min_max",
    _scaled_sql(
        "-1 + 2 * ({c} - {c}_l) / coalesce(nullif({c}_h - {c}_l, 0), 1)", "min({c}) AS {c}_l, max({c}) AS {c}_h"
    ),
)
def robust_min_max(spark, sf):
    """Min-max after robust scaling: the inner linear map cancels out of the result."""
    rows = view(spark, sf, FLOWS)
    return _scaled_output(scaling.scale_columns(rows, scaling.fit_robust_min_max(rows, _SCALED)))


@query(
    "F4_safe_sample_scaling",
    f"""WITH {_CLEAN}, fit AS (SELECT quantile_cont(f_qty, 0.5) AS qm,
      quantile_cont(f_qty, 0.75) - quantile_cont(f_qty, 0.25) AS qr,
      quantile_cont(f_price, 0.5) AS pm, quantile_cont(f_price, 0.75) - quantile_cont(f_price, 0.25) AS pr
      FROM (SELECT * REPLACE (CASE WHEN isinf(f_price) THEN NULL ELSE f_price END AS f_price) FROM flows)),
    s AS (SELECT device, greatest(-5, least(5, (f_qty - qm) / qr)) AS q,
      greatest(-5, least(5, (CASE WHEN f_price IS NULL THEN 0 WHEN isinf(f_price) THEN 1e6 ELSE f_price END - pm) / pr)) AS p
      FROM flows, fit)
    SELECT device, round(sum(q), 4) AS sum_q, round(sum(p), 4) AS sum_p, round(max(p), 6) AS max_p,
      CAST(0 AS BIGINT) AS failed FROM s GROUP BY device""",
)
def safe_scaling(spark, sf):
    rows = view(spark, sf, FLOWS)
    known = cleaning.missing_for_not_finite(rows, ["f_qty", "f_price"])
    params = scaling.fit_robust(known, ["f_qty", "f_price"])
    scaled = rows.select("device", scaling.scale_features(F.array("f_qty", "f_price"), params).alias("v"))
    return scaled.groupBy("device").agg(
        F.round(F.sum(F.col("v")[0]), 4).alias("sum_q"),
        F.round(F.sum(F.col("v")[1]), 4).alias("sum_p"),
        F.round(F.max(F.col("v")[1]), 6).alias("max_p"),
        F.count_if(F.col("v").isNull()).alias("failed"),
    )
