"""Sequences, reconstruction errors, thresholds, verdicts and diagnostic tables."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from flowguard.functions.bounded import small_table
from flowguard.functions.vectors import rebuild_by_mean
from flowguard.operators import anomaly, diagnostics, sampling, sequences
from flowguard.operators.ordering import time_slice

from flowguard.sources.paths import stage

from .testmap import SEQUENCES, WEEK, rounded, sql, view

QUERIES, SQL = {}, {}


def query(name, text=None):
    def register(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return register


KEYS, ORDER = ["device_id"], ["ts", "event_id"]


def values(spark, sf):
    return view(spark, sf, SEQUENCES).withColumn("x", F.array("value"))


def windows(spark, sf):
    """Windows of ten rows, stride three, per device; weeks are the slices of a device."""
    return sequences.strided_sequences(
        values(spark, sf), KEYS, ORDER, "x", length=10, stride=3, slice_by=time_slice(F.col("ts"), WEEK)
    )


def errors(spark, sf):
    """Errors under reconstruction by the window mean."""
    rows = windows(spark, sf).withColumn("rebuilt", rebuild_by_mean(F.col("sequence")))
    return anomaly.add_errors(rows).drop("sequence", "rebuilt")


def fit_errors(spark, sf):
    """The errors as a written table, for queries that fit on them and read them again."""
    return stage(errors(spark, sf), "errors")


_WINDOWS = f"""s AS ({sql(SEQUENCES)}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS n FROM s),
windows AS (
  SELECT device_id, (n - 10) // 3 AS window_no, ts, event_id, n,
    list(value) OVER w AS seq, avg(value) OVER w AS mean
  FROM numbered WINDOW w AS (PARTITION BY device_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
  QUALIFY n >= 10 AND (n - 10) % 3 = 0),
errors AS (
  SELECT device_id, window_no, event_id, list_avg(list_transform(seq, lambda v: (v - mean) * (v - mean))) AS mse,
    list_avg(list_transform(seq, lambda v: abs(v - mean))) AS mae FROM windows),
stat AS (SELECT avg(mse) AS mse_mean, stddev_pop(mse) AS mse_std, quantile_cont(mse, 0.25) AS q1,
    quantile_cont(mse, 0.5) AS median, quantile_cont(mse, 0.75) AS q3, quantile_cont(mse, 0.9) AS p90 FROM errors),
cand AS (SELECT *, mse_mean + 2.5 * mse_std AS statistical, p90 AS percentile, q3 + 1.5 * (q3 - q1) AS iqr FROM stat),
thr AS (SELECT *, list_sort([statistical, percentile, iqr])[2] AS threshold FROM cand),
detected AS (SELECT errors.*, threshold, mse > threshold AS is_anomaly,
    abs(mse - threshold) / nullif(mse_std, 0) AS anomaly_confidence FROM errors, thr)"""


@query(
    "W1_strided_sequences",
    f"""WITH {_WINDOWS} SELECT device_id, window_no, event_id, CAST(len(seq) AS INTEGER) AS width,
      round(seq[1], 6) AS oldest, round(seq[5], 6) AS fifth, round(seq[10], 6) AS newest FROM windows""",
)
def strided(spark, sf):
    return windows(spark, sf).select(
        "device_id",
        "window_no",
        "event_id",
        F.size("sequence").alias("width"),
        *[
            F.round(F.col("sequence")[i][0], 6).alias(n)
            for i, n in ((0, "oldest"), (4, "fifth"), (9, "newest"))
        ],
    )


@query(
    "W1_global_sequences",
    f"""WITH s AS ({sql(SEQUENCES)}), n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n,
      list(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS seq FROM s)
    SELECT (n - 10) // 3 AS window_no, event_id, round(list_sum(seq), 6) AS total FROM n
    WHERE n >= 10 AND (n - 10) % 3 = 0""",
)
def global_windows(spark, sf):
    """One order over all devices: no key at all, so the slices carry the whole load."""
    rows = sequences.strided_sequences(
        values(spark, sf), [], ORDER, "value", length=10, stride=3, slice_by=time_slice(F.col("ts"), 6 * 3600)
    )
    total = F.aggregate("sequence", F.lit(0.0), lambda s, v: s + v)
    return rows.select("window_no", "event_id", F.round(total, 6).alias("total"))


_ROLLING = f"""s AS ({sql(SEQUENCES)}),
recent AS (SELECT *, list(value) OVER (PARTITION BY device_id ORDER BY ts, event_id
  ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent FROM s),
rolling AS (SELECT *, list_concat(list_transform(range(10 - len(recent)), lambda i: value), recent) AS seq FROM recent)"""


@query(
    "W2_rolling_sequences",
    f"""WITH {_ROLLING} SELECT device_id, event_id, CAST(len(seq) AS INTEGER) AS width, round(seq[1], 6) AS oldest,
      round(seq[6], 6) AS sixth, round(seq[10], 6) AS newest, round(list_sum(seq), 6) AS total FROM rolling""",
)
def rolling(spark, sf):
    rows = sequences.rolling_sequences(
        values(spark, sf), KEYS, ORDER, "x", length=10, slice_by=time_slice(F.col("ts"), WEEK)
    )
    flat = F.flatten("sequence")
    return rows.select(
        "device_id",
        "event_id",
        F.size("sequence").alias("width"),
        *[F.round(flat[i], 6).alias(n) for i, n in ((0, "oldest"), (5, "sixth"), (9, "newest"))],
        F.round(F.aggregate(flat, F.lit(0.0), lambda s, v: s + v), 6).alias("total"),
    )


@query(
    "W4_mean_reconstruction",
    f"WITH {_WINDOWS} SELECT device_id, window_no, round(mean, 6) AS rebuilt FROM windows",
)
def mean_rebuilt(spark, sf):
    rows = windows(spark, sf).withColumn("rebuilt", rebuild_by_mean(F.col("sequence")))
    return rows.select("device_id", "window_no", F.round(F.col("rebuilt")[0][0], 6).alias("rebuilt"))


@query(
    "W5_sequence_errors",
    f"WITH {_WINDOWS} SELECT device_id, window_no, round(mse, 6) AS mse, round(mae, 6) AS mae FROM errors",
)
def sequence_errors(spark, sf):
    return rounded(errors(spark, sf).select("device_id", "window_no", "mse", "mae"))


_PARTS = f"""{_WINDOWS}, ranked AS (SELECT *, count(*) OVER () AS n,
    row_number() OVER (ORDER BY md5(concat('42:', device_id, ':', window_no))) AS r FROM errors),
  parts AS (SELECT *, CASE WHEN r <= ceil(0.2::DOUBLE * n) THEN 'test'
    WHEN r <= ceil(0.2::DOUBLE * n) + ceil(0.15::DOUBLE / (1 - 0.2::DOUBLE) * (n - ceil(0.2::DOUBLE * n)))
    THEN 'validation' ELSE 'train' END AS split FROM ranked)"""


@query(
    "W6_split_errors",
    f"""WITH {_PARTS}, m AS (SELECT avg(mse) FILTER (split = 'train') AS train_mse,
      avg(mse) FILTER (split = 'validation') AS validation_mse, avg(mae) FILTER (split = 'train') AS train_mae,
      avg(mae) FILTER (split = 'validation') AS validation_mae FROM parts)
    SELECT round(train_mse, 6) AS train_mse, round(validation_mse, 6) AS validation_mse,
      round(train_mae, 6) AS train_mae, round(validation_mae, 6) AS validation_mae,
      round(train_mse / validation_mse, 6) AS overfit_ratio FROM m""",
)
def split_errors(spark, sf):
    parts = sampling.random_split(fit_errors(spark, sf), ["device_id", "window_no"])
    return rounded(anomaly.overfit_ratio(parts))


@query(
    "W6_errors_by_split",
    f"WITH {_PARTS} SELECT split, round(avg(mse), 6) AS mse, round(avg(mae), 6) AS mae FROM parts GROUP BY split",
)
def errors_by_split(spark, sf):
    parts = sampling.random_split(fit_errors(spark, sf), ["device_id", "window_no"])
    return rounded(anomaly.split_errors(parts))


@query(
    "W7_error_distribution",
    f"""WITH {_WINDOWS} SELECT round(mse_mean, 6) AS mean, round(mse_std, 6) AS std, round(median, 6) AS median,
      round(q1, 6) AS q1, round(q3, 6) AS q3 FROM stat""",
)
def distribution(spark, sf):
    found = anomaly.error_distribution(fit_errors(spark, sf))
    return rounded(
        small_table(spark, [found], "mean double, std double, median double, q1 double, q3 double")
    )


@query(
    "W8_dynamic_threshold",
    f"""WITH {_WINDOWS} SELECT round(statistical, 6) AS statistical, round(percentile, 6) AS percentile,
      round(iqr, 6) AS iqr, round(threshold, 6) AS threshold FROM thr""",
)
def threshold(spark, sf):
    found = anomaly.threshold_candidates(fit_errors(spark, sf))
    return rounded(
        small_table(spark, [found], "statistical double, percentile double, iqr double, threshold double")
    )


@query(
    "W9_expected_rate",
    f"WITH {_WINDOWS} SELECT round(avg(CASE WHEN is_anomaly THEN 1.0 ELSE 0.0 END), 6) AS expected_rate FROM detected",
)
def expected_rate(spark, sf):
    found = fit_errors(spark, sf)
    return rounded(anomaly.expected_anomaly_rate(found, anomaly.fit_threshold(found).threshold))


def detected(spark, sf):
    found = fit_errors(spark, sf)
    return anomaly.detect_anomalies(found, anomaly.fit_threshold(found))


@query(
    "W10_detect_anomalies",
    f"""WITH {_WINDOWS} SELECT device_id, window_no, round(mse, 6) AS mse, is_anomaly,
      round(anomaly_confidence, 6) AS anomaly_confidence FROM detected""",
)
def detect(spark, sf):
    return rounded(
        detected(spark, sf).select("device_id", "window_no", "mse", "is_anomaly", "anomaly_confidence")
    )


@query(
    "W11_detection_summary",
    f"""WITH {_WINDOWS} SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies,
      count(*) FILTER (NOT is_anomaly) AS normal, round(min(mse), 6) AS lowest_mse, round(max(mse), 6) AS highest_mse,
      round(avg(anomaly_confidence), 6) AS mean_confidence,
      round(100.0::DOUBLE * count(*) FILTER (is_anomaly) / count(*), 6) AS anomaly_percent,
      round(100.0::DOUBLE * count(*) FILTER (NOT is_anomaly) / count(*), 6) AS normal_percent FROM detected""",
)
def summary(spark, sf):
    return rounded(anomaly.detection_summary(detected(spark, sf)))


@query(
    "W12_anomaly_score",
    f"""WITH {_WINDOWS}, r AS (SELECT device_id, window_no, mse / 151 AS r FROM errors)
    SELECT device_id, window_no, round(CASE WHEN r > 10 THEN least(100, 10 + log10(r - 9)) ELSE r END, 6)
      AS anomaly_score FROM r""",
)
def score(spark, sf):
    """A low threshold, so that both the linear and the compressed range occur."""
    value = anomaly.anomaly_score(F.col("mse"), F.lit(151.0))
    return errors(spark, sf).select(
        "device_id", "window_no", F.round(value, 6).alias("anomaly_score")
    )


def verdicts(spark, sf):
    """Rolling sequences judged by mean reconstruction; some values are made unusable."""
    bad = F.when(F.col("event_id") % 500 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = sequences.rolling_sequences(
        values(spark, sf).withColumn("x", F.array(bad)),
        KEYS, ORDER, "x", length=10, slice_by=time_slice(F.col("ts"), WEEK),
    ).withColumn("rebuilt", rebuild_by_mean(F.col("sequence")))
    return anomaly.add_verdict(rows, anomaly.AnomalyParams(907.0, 0.0, 1.0))


_VERDICTS = f"""{_ROLLING.replace('list(value) OVER', "list(CASE WHEN event_id % 500 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END) OVER").replace('lambda i: value', "lambda i: CASE WHEN event_id % 500 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END")},
judged AS (SELECT *, len(list_filter(seq, lambda v: isnan(v))) = 0 AS usable FROM rolling),
measured AS (SELECT *, CASE WHEN usable THEN greatest(1e-10, least(1e6,
    list_avg(list_transform(seq, lambda v: (v - list_avg(seq)) * (v - list_avg(seq)))))) END AS mse FROM judged),
verdict AS (SELECT *, CASE WHEN mse IS NULL THEN 'ERROR' WHEN mse > 907 THEN 'ANOMALY' ELSE 'BENIGN' END AS tier2_status,
    CASE WHEN mse / 907 > 10 THEN least(100, 10 + log10(mse / 907 - 9)) ELSE mse / 907 END AS score FROM measured)"""


@query(
    "W13_verdict",
    f"""WITH {_VERDICTS} SELECT device_id, event_id, tier2_status, round(mse, 6) AS reconstruction_error,
      CASE WHEN mse IS NOT NULL THEN 907.0::DOUBLE END AS threshold, round(score, 6) AS anomaly_score,
      mse > 907 AS is_anomaly, CASE WHEN mse IS NOT NULL THEN 'standard' END AS model_type FROM verdict""",
)
def verdict(spark, sf):
    rows = verdicts(spark, sf)
    return rows.select("device_id", "event_id", "tier2_status", "tier2_detail.*").withColumns(
        {c: F.round(c, 6) for c in ("reconstruction_error", "anomaly_score")}
    )


@query(
    "ST7_tier2_counters",
    f"""WITH {_VERDICTS} SELECT device_id, count(*) AS total,
      count(*) FILTER (tier2_status IN ('ANOMALY', 'BENIGN')) AS analysed,
      count(*) FILTER (tier2_status = 'ANOMALY') AS confirmed_anomaly,
      count(*) FILTER (tier2_status = 'BENIGN') AS confirmed_benign,
      count(*) FILTER (tier2_status = 'ERROR') AS tier2_errors,
      round(100.0::DOUBLE * count(*) FILTER (tier2_status = 'ANOMALY')
        / nullif(count(*) FILTER (tier2_status <> 'ERROR'), 0), 6) AS anomaly_rate,
      round(CASE WHEN count(*) FILTER (tier2_status <> 'ERROR') > 0
        THEN 100.0::DOUBLE * count(*) FILTER (tier2_status <> 'ERROR') / count(*) END, 6) AS success_rate
    FROM verdict GROUP BY device_id""",
)
def tier2_counters(spark, sf):
    from flowguard.operators import stats

    rows = verdicts(spark, sf).withColumn("traffic_type", F.lit("DOUBT"))
    counted = stats.add_rates(stats.device_counters(rows))
    return rounded(
        counted.select(
            "device_id", "total", "analysed", "confirmed_anomaly", "confirmed_benign", "tier2_errors",
            "anomaly_rate", "success_rate",
        )
    )


# --- diagnostic tables ---


def _histogram_sql(c: str) -> str:
    return f"""WITH {_WINDOWS}, r AS (SELECT min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / 50 AS w FROM errors),
    b AS (SELECT least(CAST(floor(({c} - lo) / w) AS BIGINT), 49) AS bin, count(*) AS n FROM errors, r GROUP BY 1)
    SELECT g.bin, round(lo + g.bin * w, 6) AS low, round(lo + (g.bin + 1) * w, 6) AS high, coalesce(b.n, 0) AS n
    FROM (SELECT unnest(range(50)) AS bin) g CROSS JOIN r LEFT JOIN b ON b.bin = g.bin"""


@query("V1_mse_histogram", _histogram_sql("mse"))
def mse_histogram(spark, sf):
    return rounded(diagnostics.histogram(fit_errors(spark, sf), "mse"))


@query("V1_mae_histogram", _histogram_sql("mae"))
def mae_histogram(spark, sf):
    return rounded(diagnostics.histogram(fit_errors(spark, sf), "mae"))


@query(
    "V2_error_timeline",
    f"""WITH {_WINDOWS} SELECT device_id, window_no, round(mse, 6) AS mse, round(threshold, 6) AS threshold
    FROM detected""",
)
def timeline(spark, sf):
    found = fit_errors(spark, sf)
    limit = anomaly.fit_threshold(found).threshold
    return rounded(diagnostics.error_timeline(found, ["device_id", "window_no"], limit))


_NORMAL = ", ".join(f"({i}, {NormalDist().inv_cdf(i / 100)!r}::DOUBLE, {i / 100}::DOUBLE)" for i in range(1, 100))


@query(
    "V3_normal_qq",
    f"""WITH {_WINDOWS}, grid(point, theoretical, p) AS (VALUES {_NORMAL}),
    sorted AS (SELECT list_sort(list(mse)) AS v, count(*) AS n FROM errors),
    pos AS (SELECT point, theoretical, v, CAST(floor(p * (n - 1)) AS BIGINT) AS k, p * (n - 1) AS spot FROM grid, sorted)
    SELECT CAST(point AS BIGINT) AS point, round(theoretical, 6) AS theoretical,
      round(v[k + 1] + (spot - k) * (coalesce(v[k + 2], v[k + 1]) - v[k + 1]), 3) AS observed FROM pos""",
)
def qq(spark, sf):
    points = diagnostics.normal_qq(fit_errors(spark, sf), "mse")
    return rounded(points.withColumn("observed", F.round("observed", 3)))


@query(
    "V4_error_scatter",
    f"WITH {_WINDOWS} SELECT device_id, window_no, round(mse, 6) AS mse, round(mae, 6) AS mae, is_anomaly FROM detected",
)
def scatter(spark, sf):
    return rounded(diagnostics.error_scatter(detected(spark, sf), ["device_id", "window_no"]))


@query(
    "V5_box_summary",
    f"""WITH {_WINDOWS}, b AS (SELECT is_anomaly, quantile_cont(mse, 0.25) AS q1, quantile_cont(mse, 0.5) AS median,
      quantile_cont(mse, 0.75) AS q3 FROM detected GROUP BY is_anomaly)
    SELECT d.is_anomaly, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
      round(any_value(q3), 6) AS q3,
      round(min(mse) FILTER (mse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS low_whisker,
      round(max(mse) FILTER (mse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS high_whisker,
      count(*) FILTER (mse NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM detected d JOIN b ON b.is_anomaly = d.is_anomaly GROUP BY d.is_anomaly""",
)
def box(spark, sf):
    return rounded(diagnostics.box_summary(detected(spark, sf)))


@query(
    "V5_box_by_group",
    f"""WITH {_WINDOWS}, g AS (SELECT mse, 'class ' || (event_id % 7) AS part FROM errors), b AS (SELECT part, quantile_cont(mse, 0.25) AS q1,
      quantile_cont(mse, 0.5) AS median, quantile_cont(mse, 0.75) AS q3 FROM g GROUP BY part)
    SELECT part, count(*) AS n, round(any_value(q1), 3) AS q1, round(any_value(median), 3) AS median, round(any_value(q3), 3) AS q3,
      round(min(mse) FILTER (mse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 3) AS low_whisker,
      round(max(mse) FILTER (mse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 3) AS high_whisker,
      count(*) FILTER (mse NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM g JOIN b USING (part) GROUP BY part""",
)
def box_by_part(spark, sf):
    """Boxes by a column of several values, from the same passes as by two classes."""
    rows = fit_errors(spark, sf).withColumn("part", F.concat(F.lit("class "), F.col("event_id") % 7))
    return rounded(diagnostics.box_summary(rows, "mse", "part"), 3)
