"""Cleaning, encoding, scaling, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.tables import (
    EVENTS_NULLS, LINEITEM_GROSS, div, events_nulls, lineitem_gross, r, rounded, table, union,
)
from tabassay.functions.missing import nan_to_null, normalize_missing
from tabassay.functions.scalars import band, clamp_percent, elapsed_seconds, normalized_name
from tabassay.operators import cleaning as cl
from tabassay.operators.folds import hash_folds, rank_folds
from tabassay.sources.sampling import in_test_split, split


def _nulls(sql: str) -> str:
    return f"WITH e AS ({EVENTS_NULLS}) {sql}"


# Events with NaN, infinities and token strings, the same in both engines.
DIRTY = """SELECT event_id,
  CASE WHEN event_id % 6 = 0 THEN CAST('NaN' AS DOUBLE)
       WHEN event_id % 6 = 1 THEN CAST('Infinity' AS DOUBLE)
       WHEN event_id % 6 = 2 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS value,
  CASE WHEN event_id % 5 = 0 THEN 'NA' WHEN event_id % 5 = 1 THEN ' nan '
       ELSE event_type END AS event_type FROM events"""


def _dirty(spark, d):
    key = F.col("event_id")
    value = (
        F.when(key % 6 == 0, float("nan"))
        .when(key % 6 == 1, float("inf"))
        .when(key % 6 == 2, float("-inf"))
        .otherwise(F.col("value"))
    )
    text = F.when(key % 5 == 0, "NA").when(key % 5 == 1, " nan ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(
        "event_id", value.alias("value"), text.alias("event_type")
    )


def _nested(spark, d):
    """The same values inside a struct, an array and a map."""
    df = _dirty(spark, d)
    v = F.col("value")
    nested = df.select(
        "event_id",
        F.struct(v.alias("inner")).alias("s"),
        F.array(v, F.lit(1.0)).alias("a"),
        F.create_map(F.lit("k"), v).alias("m"),
    )
    return nan_to_null(nested).select(
        "event_id", F.col("s.inner").alias("s"), F.col("a")[0].alias("a"), F.col("m")["k"].alias("m")
    )


def _clean(spark, d):
    events = table(spark, d, "events").withColumn("empty", F.lit(None).cast("double"))
    return cl.clean(events, "value", keep=["event_id"])


def _mixed(spark, d):
    """Orders with a boolean-like and two string features."""
    return table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"
    )


STATUS = ["F", "O", "P"]
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _one_hot_sql() -> str:
    dummies = [
        f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{c}_{v}\""
        for c, vs in (("o_orderstatus", STATUS), ("o_orderpriority", PRIORITY))
        for v in vs[1:]
    ]
    return f"SELECT o_orderkey, o_totalprice, {', '.join(dummies)} FROM orders"


def _one_hot(spark, d):
    df = _mixed(spark, d)
    return cl.one_hot(df, cl.levels(df, ["o_orderstatus", "o_orderpriority"]))


SCALED = ["l_quantity", "l_extendedprice", "doubled", "constant"]


def _scaled(method):
    def run(spark, d):
        df = lineitem_gross(spark, d).select(*SCALED)
        return rounded(cl.scale(df, SCALED, method))

    return run


def _scaled_sql(center: str, spread: str) -> str:
    stats = ", ".join(
        f"{center.format(c=c)} AS a_{c}, {spread.format(c=c)} AS b_{c}" for c in SCALED
    )
    out = ", ".join(
        r(f"({c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END") + f" AS {c}" for c in SCALED
    )
    return f"""WITH g AS ({LINEITEM_GROSS}), st AS (SELECT {stats} FROM g)
      SELECT {out} FROM g, st"""


HASH = "(((o_orderkey % 2147483648) * 2654435761 + {seed}) % 4294967296)"
# Keys whose low 31 bits are zero are folded by their high bits.
HIGH_KEYS = "(SELECT o_orderkey * 2147483648 AS o_orderkey FROM orders)"
HIGH_HASH = HASH.replace(
    "(o_orderkey % 2147483648)", "(((o_orderkey // 2147483648) * 40503) % 2147483648)"
)


def _high_keys(spark, d):
    return table(spark, d, "orders").select(
        (F.col("o_orderkey") * 2147483648).alias("o_orderkey")
    )


def _split_counts(df):
    return df.groupBy(
        F.when(in_test_split(df, "o_orderkey"), "test").otherwise("train").alias("part")
    ).agg(F.count(F.lit(1)).alias("cnt"), F.sum("o_orderkey").alias("keys"))


def _exact_split(spark, d):
    train, test = split(table(spark, d, "orders"), "o_orderkey", exact=True)
    parts = [x.select("o_orderkey", F.lit(n).alias("part")) for n, x in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


def _fold_sizes(df, by=()):
    return df.groupBy(*by, "fold").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("o_orderkey").alias("first_key"),
        F.max("o_orderkey").alias("last_key"),
    )


CHECKS = {
    "missing_normalised": (
        lambda s, d: normalize_missing(_dirty(s, d), ("NA", "nan")),
        f"""SELECT event_id, CASE WHEN isnan(value) THEN NULL ELSE value END AS value,
        CASE WHEN trim(event_type) IN ('NA', 'nan') THEN NULL ELSE event_type END AS event_type
        FROM ({DIRTY})""",
    ),
    "nan_to_null": (
        lambda s, d: nan_to_null(_dirty(s, d)),
        f"""SELECT event_id, CASE WHEN isfinite(value) THEN value END AS value, event_type
        FROM ({DIRTY})""",
    ),
    "nan_to_null_nested": (
        _nested,
        f"""SELECT event_id, CASE WHEN isfinite(value) THEN value END AS s,
        CASE WHEN isfinite(value) THEN value END AS a,
        CASE WHEN isfinite(value) THEN value END AS m FROM ({DIRTY})""",
    ),
    "drop_datetime": (
        lambda s, d: cl.drop_datetime(table(s, d, "events")),
        "SELECT event_id, user_id, event_type, value, props FROM events",
    ),
    "clean_columns": (
        lambda s, d: _clean(s, d).issues,
        """SELECT 'datetime' AS step, 'ts' AS column_name
        UNION ALL SELECT 'all_null', 'empty'
        UNION ALL SELECT 'high_cardinality', 'props' FROM events
          HAVING count(DISTINCT props) > 50""",
    ),
    "cleaned_rows": (
        lambda s, d: _clean(s, d).data,
        "SELECT event_id, user_id, event_type, value FROM events",
    ),
    "feature_columns": (
        lambda s, d: cl.split_features_target(table(s, d, "part"), "p_retailprice")[0],
        "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part",
    ),
    "attach_labels": (
        lambda s, d: cl.attach_labels(
            table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"),
            table(s, d, "labels"),
            "doc_id",
        ),
        """SELECT doc_id, lang, source, n_chars, quality, toxic
        FROM documents JOIN labels USING (doc_id)""",
    ),
    "drop_null_rows": (
        lambda s, d: cl.drop_null_rows(events_nulls(s, d), ["event_type", "value"]).withColumn(
            "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        ),
        _nulls("""SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts) FROM e WHERE event_type IS NOT NULL
          AND value IS NOT NULL"""),
    ),
    "impute_mean": (
        lambda s, d: rounded(
            cl.impute_mean(events_nulls(s, d).select("event_id", "value"), ["value"])
        ),
        _nulls(
            f"SELECT event_id, {r('coalesce(value, (SELECT avg(value) FROM e))')} AS value FROM e"
        ),
    ),
    "impute_mode": (
        lambda s, d: cl.impute_mode(events_nulls(s, d).select("event_id", "event_type")),
        _nulls(
            """SELECT event_id, coalesce(event_type, (SELECT event_type FROM e
            WHERE event_type IS NOT NULL GROUP BY event_type
            ORDER BY count(*) DESC, event_type LIMIT 1), 'Unknown') AS event_type FROM e"""
        ),
    ),
    "one_hot_drop_first": (_one_hot, _one_hot_sql()),
    "align_columns": (
        lambda s, d: cl.align_columns(
            table(s, d, "orders"), ["o_totalprice", "absent_level", "o_orderkey"]
        ),
        """SELECT o_totalprice, CAST(0 AS DOUBLE) AS absent_level,
        CAST(o_orderkey AS DOUBLE) AS o_orderkey FROM orders""",
    ),
    "sanitize_names": (
        lambda s, d: cl.sanitize_names(_one_hot(s, d)),
        "SELECT "
        + ", ".join(
            ["o_orderkey", "o_totalprice"]
            + [
                f"\"{c}_{v}\" AS {cl.sanitize(f'{c}_{v}')}"
                for c, vs in (("o_orderstatus", STATUS), ("o_orderpriority", PRIORITY))
                for v in vs[1:]
            ]
        )
        + f" FROM ({_one_hot_sql()})",
    ),
    "cast_scored": (
        lambda s, d: cl.cast_scored(
            table(s, d, "events").select(
                "event_id",
                (F.col("event_id") % 2).cast("string").alias("y"),
                F.col("value").cast("string").alias("p"),
            )
        ),
        "SELECT event_id, CAST(event_id % 2 AS INTEGER) AS y, value AS p FROM events",
    ),
    "scale_standard": (_scaled("standard"), _scaled_sql("avg({c})", "stddev_pop({c})")),
    "scale_minmax": (_scaled("minmax"), _scaled_sql("min({c})", "max({c}) - min({c})")),
    "scale_robust": (
        _scaled("robust"),
        _scaled_sql(
            "quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"
        ),
    ),
    "split_counts": (
        lambda s, d: _split_counts(table(s, d, "orders")),
        f"""SELECT CASE WHEN {HASH.format(seed=42)} % 100 < 20 THEN 'test' ELSE 'train' END AS part,
        count(*) AS cnt, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""",
    ),
    "split_exact": (
        _exact_split,
        f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {HASH.format(seed=42)},
          o_orderkey) <= ceil(0.2 * (SELECT count(*) FROM orders))
          THEN 'test' ELSE 'train' END AS part FROM orders""",
    ),
    "kfold_sizes": (
        lambda s, d: _fold_sizes(rank_folds(table(s, d, "orders"), "o_orderkey", 5)),
        """SELECT CAST(f - 1 AS INTEGER) AS fold, count(*) AS cnt, min(o_orderkey) AS first_key,
        max(o_orderkey) AS last_key FROM (SELECT o_orderkey,
        ntile(5) OVER (ORDER BY o_orderkey) AS f FROM orders) GROUP BY f""",
    ),
    "kfold_stratified_sizes": (
        lambda s, d: _fold_sizes(
            rank_folds(table(s, d, "orders"), "o_orderkey", 5, "o_orderstatus"), ["o_orderstatus"]
        ),
        """SELECT o_orderstatus, CAST(f - 1 AS INTEGER) AS fold, count(*) AS cnt,
        min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
        FROM (SELECT o_orderkey, o_orderstatus,
          ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS f FROM orders)
        GROUP BY o_orderstatus, f""",
    ),
    "split_counts_high_keys": (
        lambda s, d: _split_counts(_high_keys(s, d)).drop("keys"),
        f"""SELECT CASE WHEN {HIGH_HASH.format(seed=42)} % 100 < 20 THEN 'test' ELSE 'train' END
        AS part, count(*) AS cnt FROM {HIGH_KEYS} GROUP BY 1""",
    ),
    "kfold_high_keys": (
        lambda s, d: _fold_sizes(hash_folds(_high_keys(s, d), "o_orderkey", 5)),
        f"""SELECT CAST(({HIGH_HASH.format(seed=7)} // 1024) % 5 AS INTEGER) AS fold,
        count(*) AS cnt, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
        FROM {HIGH_KEYS} GROUP BY 1""",
    ),
    "kfold_hashed_sizes": (
        lambda s, d: _fold_sizes(hash_folds(table(s, d, "orders"), "o_orderkey", 5)),
        f"""SELECT CAST(({HASH.format(seed=7)} // 1024) % 5 AS INTEGER) AS fold, count(*) AS cnt,
        min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1""",
    ),
    "scalar_functions": (
        lambda s, d: table(s, d, "events").select(
            "event_id",
            normalized_name(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))).alias("name"),
            F.round("value", 1).alias("rounded"),
            elapsed_seconds(F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")).alias("elapsed"),
            clamp_percent(F.col("value") - 20).alias("clamped"),
            band(F.col("value"), ((90.0, "Excellent"), (75.0, "Good"), (50.0, "Fair")), "Poor").alias(
                "band"
            ),
        ),
        """SELECT event_id, lower(trim('  ' || upper(event_type) || ' ')) AS name,
        round(value, 1) AS rounded,
        CAST(datediff('microsecond', TIMESTAMP '2024-01-01', ts) // 1000000 AS BIGINT) AS elapsed,
        CAST(least(100, greatest(0, value - 20)) AS DOUBLE) AS clamped,
        CASE WHEN value >= 90 THEN 'Excellent' WHEN value >= 75 THEN 'Good'
             WHEN value >= 50 THEN 'Fair' ELSE 'Poor' END AS band FROM events""",
    ),
}
