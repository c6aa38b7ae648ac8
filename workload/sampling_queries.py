"""Splits, class creation, resampling and synthetic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.operators import sampling

from .testmap import rounded, table

QUERIES, SQL = {}, {}


def query(name, text=None):
    def register(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return register


def events(spark, sf):
    """Event type 'view' plays the benign class."""
    rows = table(spark, sf, "events")
    return rows.select("event_id", F.expr(_LABEL).alias("Label"), "value")


_LABEL = "CASE WHEN event_type = 'view' THEN 'BENIGN' ELSE event_type END"
_EVENTS = f"ev AS (SELECT event_id, {_LABEL} AS Label, value FROM events)"

# Quotas: floors of the proportional shares plus the largest remainders.
_SPLIT = f"""{_EVENTS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY Label ORDER BY md5(concat('42:', event_id))) AS r FROM ev),
c AS (SELECT Label, count(*) AS n FROM ev GROUP BY Label),
t AS (SELECT *, CAST(ceil(0.05::DOUBLE * sum(n) OVER ()) AS HUGEINT) AS want, sum(n) OVER () AS total FROM c),
t2 AS (SELECT *, (n * want) // total AS base,
    row_number() OVER (ORDER BY (n * want) % total DESC, Label) AS place,
    want - sum((n * want) // total) OVER () AS spare FROM t),
t3 AS (SELECT Label, n, base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS test_n FROM t2),
v AS (SELECT *, n - test_n AS rest, sum(n - test_n) OVER () AS total,
    CAST(ceil(0.263::DOUBLE * sum(n - test_n) OVER ()) AS HUGEINT) AS want FROM t3),
v2 AS (SELECT *, (rest * want) // total AS base,
    row_number() OVER (ORDER BY (rest * want) % total DESC, Label) AS place,
    want - sum((rest * want) // total) OVER () AS spare FROM v),
quota AS (SELECT Label, test_n, base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS val_n FROM v2),
parts AS (SELECT event_id, Label, value, CASE WHEN r <= test_n THEN 'test' WHEN r <= test_n + val_n THEN 'validation'
    ELSE 'train' END AS split FROM ranked JOIN quota USING (Label))"""


@query("T1_stratified_split", f"WITH {_SPLIT} SELECT event_id, Label, split FROM parts")
def stratified(spark, sf):
    return sampling.stratified_split(events(spark, sf), "Label", ["event_id"]).drop("value")


_DOUBT = f"""{_SPLIT}, train AS (SELECT * FROM parts WHERE split = 'train'),
benign AS (SELECT event_id, row_number() OVER (ORDER BY md5(concat('42:doubt:', event_id))) AS r FROM train
  WHERE Label = 'BENIGN'),
doubted AS (SELECT event_id, value, CASE WHEN event_id IN (SELECT event_id FROM benign
  WHERE r <= (SELECT CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) FROM benign)) THEN 'DOUBT' ELSE Label END AS Label
  FROM train)"""


def doubted(spark, sf):
    parts = sampling.stratified_split(events(spark, sf), "Label", ["event_id"])
    return sampling.create_doubt_class(parts.where("split = 'train'").drop("split"), "Label", ["event_id"])


@query("T2_doubt_class", f"WITH {_DOUBT} SELECT event_id, Label FROM doubted")
def doubt_class(spark, sf):
    return doubted(spark, sf).select("event_id", "Label")


@query(
    "T3_undersample",
    f"""WITH {_EVENTS}, capped AS (SELECT *, row_number() OVER (PARTITION BY Label
      ORDER BY md5(concat('42:under:', event_id))) AS r FROM ev)
    SELECT event_id, Label FROM capped WHERE Label <> 'BENIGN' OR r <= 500""",
)
def undersampled(spark, sf):
    rows = sampling.undersample(events(spark, sf), "Label", ["event_id"], caps={"BENIGN": 500})
    return rows.select("event_id", "Label")


# --- minority classes: embedding labels, some of them made rare ---

_SIZED = "CASE WHEN label > 2 OR vec_id % (label + 2) = 0 THEN CAST(label AS VARCHAR(9)) ELSE 'BENIGN' END AS Label"
_MINORITY = f"""mi AS (SELECT vec_id, {_SIZED}, embedding FROM embeddings),
plan AS (SELECT Label, count(*) AS n, least(2000, count(*) * 3) AS target FROM mi WHERE Label <> 'BENIGN' GROUP BY Label
  HAVING count(*) < 1000),
k AS (SELECT min(n) AS smallest, CASE WHEN min(n) > 1 THEN least(5, min(n) - 1) WHEN min(n) = 1 THEN 1 END AS k FROM plan)"""


def minority(spark, sf):
    """All embeddings: classes of several sizes, and the large class that is never oversampled."""
    return table(spark, sf, "embeddings").selectExpr("vec_id", _SIZED, "embedding")


@query("T4_oversampling_plan", f"WITH {_MINORITY} SELECT Label, n, CAST(target AS BIGINT) AS target FROM plan")
def plan(spark, sf):
    return sampling.oversampling_plan(minority(spark, sf), "Label")


@query("T5_neighbour_count", f"WITH {_MINORITY} SELECT smallest, CAST(k AS BIGINT) AS k_neighbours FROM k")
def neighbours(spark, sf):
    return sampling.neighbour_count(sampling.oversampling_plan(minority(spark, sf), "Label"))


_NEAR = f"""{_MINORITY},
pairs AS (SELECT a.Label, a.vec_id, b.vec_id AS neighbour_id,
    list_sum(list_transform(list_zip(a.embedding, b.embedding),
      lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d
  FROM mi a JOIN mi b ON a.Label = b.Label AND a.vec_id <> b.vec_id AND a.Label IN (SELECT Label FROM plan)),
near AS (SELECT Label, vec_id, neighbour_id, row_number() OVER (PARTITION BY Label, vec_id ORDER BY d, neighbour_id) AS rank
  FROM pairs QUALIFY rank <= (SELECT k FROM k))"""


@query("T6_minority_neighbours", f"WITH {_NEAR} SELECT Label, vec_id, rank, neighbour_id FROM near")
def near(spark, sf):
    rows = minority(spark, sf)
    planned = sampling.oversampling_plan(rows, "Label")
    k = sampling.neighbour_count(planned).first()["k_neighbours"]
    return sampling.minority_neighbours(rows, "Label", "vec_id", "embedding", planned, k)


_HEX = "CAST(concat('0x', substr(h, {0}, 8)) AS BIGINT)"


@query(
    "T6_smote",
    f"""WITH {_NEAR}, ordered AS (SELECT Label, vec_id, embedding,
      row_number() OVER (PARTITION BY Label ORDER BY vec_id) - 1 AS place FROM mi),
    draws AS (SELECT Label, n, j, md5(concat('42:', Label, ':', j)) AS h
      FROM (SELECT Label, n, unnest(range(0, target - n)) AS j FROM plan)),
    chosen AS (SELECT d.Label, d.j AS synthetic_no, o.vec_id AS base_id, o.embedding AS a,
        {_HEX.format(9)} % (SELECT least(k, d.n - 1) FROM k) + 1 AS pick, {_HEX.format(17)} / 4294967296.0::DOUBLE AS u
      FROM draws d JOIN ordered o ON o.Label = d.Label AND o.place = {_HEX.format(1)} % d.n)
    SELECT c.Label, c.synthetic_no, c.base_id, n.neighbour_id,
      round(list_sum(list_transform(range(1, 65), lambda i:
        i * (c.a[i]::DOUBLE + c.u * (m.embedding[i]::DOUBLE - c.a[i]::DOUBLE)))), 4) AS weighted_values,
      round(list_sum(list_transform(range(1, 65), lambda i:
        abs(c.a[i]::DOUBLE + c.u * (m.embedding[i]::DOUBLE - c.a[i]::DOUBLE)))), 4) AS absolute_values
    FROM chosen c JOIN near n ON n.vec_id = c.base_id AND n.rank = c.pick JOIN mi m ON m.vec_id = n.neighbour_id""",
)
def smote(spark, sf):
    rows = minority(spark, sf)
    planned = sampling.oversampling_plan(rows, "Label")
    k = sampling.neighbour_count(planned).first()["k_neighbours"]
    made = sampling.smote(rows, "Label", "vec_id", "embedding", planned, k)
    return rounded(
        made.select(
            "Label",
            "synthetic_no",
            "base_id",
            "neighbour_id",
            # All 64 values, each with its own weight.
            F.round(_folded(F.transform("embedding", lambda v, i: v * (i + 1))), 4).alias("weighted_values"),
            F.round(_folded(F.transform("embedding", F.abs)), 4).alias("absolute_values"),
        )
    )


def _folded(values):
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


@query(
    "T6_balanced_classes",
    f"""WITH {_MINORITY} SELECT Label, CAST(greatest(n, target) AS BIGINT) AS n FROM plan
    UNION ALL SELECT Label, count(*) FROM mi GROUP BY Label HAVING count(*) >= 1000 OR Label = 'BENIGN'""",
)
def balanced(spark, sf):
    columns = [f"x{i}" for i in range(4)]
    rows = minority(spark, sf).select(
        "vec_id", "Label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)]
    )
    return sampling.balance(rows, "Label", "vec_id", columns).groupBy("Label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "T7_random_split",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5(concat('42:', event_id))) AS r, count(*) OVER () AS n
      FROM events),
    q AS (SELECT *, ceil(0.2::DOUBLE * n) AS t FROM r)
    SELECT event_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil(0.15::DOUBLE / (1 - 0.2::DOUBLE) * (n - t))
      THEN 'validation' ELSE 'train' END AS split FROM q""",
)
def random_split(spark, sf):
    rows = table(spark, sf, "events").select("event_id")
    return sampling.random_split(rows, ["event_id"])


@query(
    "T7_split_by_key",
    """WITH h AS (SELECT user_id, event_id, CAST(concat('0x', substr(md5(concat('42:', user_id)), 1, 8)) AS BIGINT)
      / 4294967296.0::DOUBLE AS u FROM events)
    SELECT event_id, user_id, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.35 THEN 'validation' ELSE 'train' END AS split
    FROM h""",
)
def key_split(spark, sf):
    return sampling.split_by_key(table(spark, sf, "events").select("event_id", "user_id"), ["user_id"])
