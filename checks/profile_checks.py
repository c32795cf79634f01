"""Dataset description and exploratory analysis."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.tables import (
    EVENTS_NULLS, GROSS_COLUMNS, LINEITEM_GROSS, LINEITEM_NUMBERS, MEASURES, div, events_nulls,
    lineitem_gross, r, rounded, table, union,
)
from tabassay.operators import correlation as corr
from tabassay.operators import outliers as out
from tabassay.operators import profile as prof
from tabassay.operators import quality as qual
from tabassay.plans.eda import analyze, read_section, store_analysis
from tabassay.session import fresh_dir
from tabassay.sources import manifest as man
from tabassay.sources.sampling import sample_rows

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _numeric_profile_sql(source: str, columns: list[str]) -> str:
    def one(c: str) -> str:
        skew = f"""CASE WHEN count({c}) < 3 THEN NULL WHEN min({c}) = max({c}) THEN 0.0
          ELSE skewness({c}) END"""
        kurt = f"""CASE WHEN count({c}) < 4 THEN NULL WHEN min({c}) = max({c}) THEN 0.0
          ELSE kurtosis({c}) END"""
        return f"""SELECT '{c}' AS column_name, {r(f"avg({c})")} AS mean,
          {r(f"quantile_cont({c}, 0.5)")} AS median, {r(f"stddev_samp({c})")} AS std,
          {r(f"CAST(min({c}) AS DOUBLE)")} AS min, {r(f"CAST(max({c}) AS DOUBLE)")} AS max,
          {r(f"quantile_cont({c}, 0.25)")} AS q25, {r(f"quantile_cont({c}, 0.75)")} AS q75,
          {r(skew)} AS skewness, {r(kurt)} AS kurtosis, count({c}) AS count
          FROM {source} HAVING count({c}) > 0"""

    return union([one(c) for c in columns])


def _describe_sql(source: str, columns: list[str]) -> str:
    return union(
        [
            f"""SELECT '{c}' AS column_name, count({c}) AS count, {r(f"avg({c})")} AS mean,
            {r(f"stddev_samp({c})")} AS std, {r(f"CAST(min({c}) AS DOUBLE)")} AS min,
            {r(f"quantile_cont({c}, 0.25)")} AS q25, {r(f"quantile_cont({c}, 0.5)")} AS q50,
            {r(f"quantile_cont({c}, 0.75)")} AS q75, {r(f"CAST(max({c}) AS DOUBLE)")} AS max
            FROM {source}"""
            for c in columns
        ]
    )


EVENT_COLUMNS = ["event_id", "user_id", "ts", "props", "event_type", "value", "empty"]
EVENT_NUMBERS = ["event_id", "user_id", "value", "empty"]


def _counts_sql(source: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt FROM {source} "
            f"WHERE {c} IS NOT NULL GROUP BY {c}"
            for c in columns
        ]
    )


def _categorical_sql(source: str, columns: list[str]) -> str:
    return union(
        [
            f"""SELECT '{c}' AS column_name,
            (SELECT count(DISTINCT {c}) FROM {source}) AS unique_values,
            (SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}
               ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
            coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM {source}
               WHERE {c} IS NOT NULL GROUP BY {c})), 0) AS mode_frequency,
            (SELECT count(*) - count({c}) FROM {source}) AS missing_count,
            {r(f"(SELECT 100.0 * {div(f'count(*) - count({c})', 'count(*)')} FROM {source})")}
              AS missing_percentage"""
            for c in columns
        ]
    )


def _missing_sql(source: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM {source}"
            for c in columns
        ]
    )


def _missing_pct_sql(source: str, columns: list[str]) -> str:
    return union(
        [
            f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count,
            {r(f"100.0 * {div(f'count(*) - count({c})', 'count(*)')}")} AS missing_percentage
            FROM {source} HAVING count(*) > count({c})"""
            for c in columns
        ]
    )


def _missing_summary_sql(source: str, columns: list[str]) -> str:
    total = " + ".join(f"(count(*) - count({c}))" for c in columns)
    anyone = " OR ".join(f"{c} IS NULL" for c in columns)
    full = ", ".join(f"CASE WHEN count({c}) = 0 THEN '{c}' END" for c in columns)
    return f"""SELECT count(*) AS total_rows, CAST({len(columns)} AS BIGINT) AS total_columns,
      CAST({total} AS BIGINT) AS total_missing,
      {r(f"100.0 * {div(total, f'count(*) * {len(columns)}')}")} AS total_missing_percentage,
      count(*) FILTER (WHERE {anyone}) AS rows_with_missing,
      concat_ws(',', {full}) AS fully_missing_columns FROM {source}"""


def _outliers_sql(source: str, columns: list[str], digits: int = 4) -> str:
    return union(
        [
            f"""SELECT '{c}' AS column_name, {r("lo", digits)} AS lower_bound,
            {r("hi", digits)} AS upper_bound,
            count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outlier_count,
            {r(f"100.0 * {div(f'count(*) FILTER (WHERE {c} < lo OR {c} > hi)', 'count(*)')}", digits)}
              AS outlier_percentage
            FROM {source}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
              FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3
                FROM {source}) WHERE q3 - q1 <> 0) GROUP BY lo, hi"""
            for c in columns
        ]
    )


def _corr_sql(source: str, a: str, b: str) -> str:
    """Pairwise-complete correlation, null when either side does not vary."""
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return div(f"covar_pop({x}, {y})", f"stddev_pop({x}) * stddev_pop({y})")


def _matrix_sql(source: str, columns: list[str]) -> str:
    parts = []
    for a in columns:
        for b in columns:
            v = (
                f"CASE WHEN min({a}) < max({a}) THEN 1.0 END"
                if a == b
                else _corr_sql(source, a, b)
            )
            parts.append(
                f"SELECT '{a}' AS feature1, '{b}' AS feature2, {r(f'CAST({v} AS DOUBLE)')} "
                f"AS correlation FROM {source}"
            )
    return union(parts)


def _strong_sql(source: str, columns: list[str]) -> str:
    parts = [
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, {r(_corr_sql(source, a, b))} "
        f"AS correlation FROM {source}"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    return f"SELECT * FROM ({union(parts)}) WHERE abs(correlation) > 0.7"


def _gross(sql: str) -> str:
    return f"WITH g AS ({LINEITEM_GROSS}) {sql}"


def _nulls(sql: str) -> str:
    return f"WITH e AS ({EVENTS_NULLS}) {sql}"


# ---- quality, insights and summary over all columns but the key ----


@dataclass(frozen=True)
class Body:
    """What SQL has to know of an analysed table."""

    source: str
    columns: list[str]
    numbers: list[str]
    texts: list[str]
    spread: list[str]  # numbers whose quartiles differ
    width: int  # bytes of the columns of fixed width


EVENTS = Body(
    EVENTS_NULLS, [c for c in EVENT_COLUMNS if c != "event_id"], ["user_id", "value", "empty"],
    ["props", "event_type"], ["user_id", "value"], 32,
)
DOCUMENTS = Body(
    "SELECT * FROM documents", ["text", "lang", "source", "n_chars"], ["n_chars"],
    ["text", "lang", "source"], ["n_chars"], 8,
)


def _quality_ctes(body: Body) -> str:
    no_pairs = """SELECT '' AS feature1, '' AS feature2, 0.0::DOUBLE AS correlation WHERE false"""
    strong = _strong_sql("e", body.numbers) if len(body.numbers) > 1 else no_pairs
    return f"""WITH e AS (SELECT {", ".join(body.columns)} FROM ({body.source})),
miss AS ({_missing_summary_sql("e", body.columns)}),
miss_cols AS ({_missing_pct_sql("e", body.columns)}),
dup AS (SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
  100.0 * {div("sum(n - 1)", "sum(n)")} AS duplicate_percentage
  FROM (SELECT count(*) AS n FROM e GROUP BY {", ".join(body.columns)})),
outl AS ({_outliers_sql("e", body.spread)}),
strong AS ({strong}),
cats AS ({_categorical_sql("e", body.texts)}),
qual0 AS (SELECT greatest(0.0, 100.0 - total_missing_percentage_raw) AS completeness,
  100.0 - duplicate_percentage AS uniqueness,
  total_missing_percentage_raw AS missing_percentage, duplicate_rows, duplicate_percentage,
  CAST((SELECT coalesce(sum(outlier_count), 0) FROM outl) AS BIGINT) AS outlier_count
  FROM (SELECT 100.0 * {div("total_missing", "total_rows * total_columns")}
    AS total_missing_percentage_raw FROM miss), dup),
qual AS (SELECT (completeness + uniqueness) / 2 AS overall_score,
  CASE WHEN (completeness + uniqueness) / 2 >= 90 THEN 'Excellent'
       WHEN (completeness + uniqueness) / 2 >= 75 THEN 'Good'
       WHEN (completeness + uniqueness) / 2 >= 50 THEN 'Fair' ELSE 'Poor' END AS assessment,
  * FROM qual0),
advice AS (
  SELECT 1 AS ord, 'High missing data: Consider imputation or removal' AS recommendation
    FROM qual WHERE missing_percentage > 30
  UNION ALL SELECT 1, 'Moderate missing data: Review and handle missing values'
    FROM qual WHERE missing_percentage > 10 AND missing_percentage <= 30
  UNION ALL SELECT 2, 'Data quality is below optimal: Consider data cleaning'
    FROM qual WHERE assessment IN ('Poor', 'Fair')
  UNION ALL SELECT 3, 'Data quality is good - proceed with analysis'
    FROM qual WHERE missing_percentage <= 10 AND assessment NOT IN ('Poor', 'Fair')),
found AS (
  SELECT CASE WHEN missing_percentage >= 100 THEN 'CRITICAL' WHEN missing_percentage > 30
      THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    CASE WHEN missing_percentage >= 100 THEN 'Column is empty: ' || column_name
      ELSE 'Missing values in ' || column_name END AS title,
    column_name, missing_percentage AS value FROM miss_cols WHERE missing_percentage > 10
  UNION ALL SELECT CASE WHEN duplicate_percentage > 10 THEN 'HIGH' ELSE 'LOW' END,
    'Duplicate rows', NULL, duplicate_percentage FROM dup WHERE duplicate_percentage > 0
  UNION ALL SELECT 'MEDIUM', 'Strong correlation: ' || feature1 || ' and ' || feature2,
    feature1, correlation FROM strong
  UNION ALL SELECT CASE WHEN outlier_percentage > 5 THEN 'MEDIUM' ELSE 'LOW' END,
    'Outliers in ' || column_name, column_name, outlier_percentage FROM outl
    WHERE outlier_percentage > 0
  UNION ALL SELECT 'LOW', 'Many distinct values in ' || column_name, column_name,
    CAST(unique_values AS DOUBLE) FROM cats WHERE unique_values > 50)
"""


_QUALITY_CTES = _quality_ctes(EVENTS)

_QUALITY_SQL = f"""{_QUALITY_CTES} SELECT {r("overall_score")} AS overall_score, assessment,
  {r("completeness")} AS completeness, {r("uniqueness")} AS uniqueness,
  {r("missing_percentage")} AS missing_percentage, duplicate_rows,
  {r("duplicate_percentage")} AS duplicate_percentage, outlier_count FROM qual"""

_FOUND = f"""SELECT severity, title, column_name, {r("value")} AS value FROM found"""


def _summary_sql(body: Body) -> str:
    return f"""SELECT {r("overall_score")} AS quality_score, assessment,
  {r("completeness")} AS completeness, {r("uniqueness")} AS uniqueness,
  CAST({len(body.columns)} AS BIGINT) AS features,
  (SELECT count(*) FROM found) AS insights_count,
  (SELECT count(*) FROM found WHERE severity = 'CRITICAL') AS issues_critical,
  (SELECT count(*) FROM found WHERE severity = 'HIGH') AS issues_high,
  (SELECT count(*) FROM found WHERE severity = 'MEDIUM') AS issues_medium,
  (SELECT title FROM found ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2
     WHEN 'MEDIUM' THEN 3 ELSE 4 END, title LIMIT 1) AS top_concern,
  (SELECT recommendation FROM advice ORDER BY ord LIMIT 1) AS recommendation FROM qual"""


def _long_sql(section: str, item: str, source: str, numbers: list[str], texts: list[str]) -> str:
    parts = [
        f"SELECT '{section}' AS section, {item} AS item, '{m}' AS metric, "
        f"{r(f'CAST({m} AS DOUBLE)')} AS value, CAST(NULL AS VARCHAR) AS text FROM {source}"
        for m in numbers
    ] + [
        f"SELECT '{section}' AS section, {item} AS item, '{m}' AS metric, "
        f"CAST(NULL AS DOUBLE) AS value, {m} AS text FROM {source}"
        for m in texts
    ]
    return union(parts)


def _eda_full_sql(body: Body) -> str:
    lengths = " + ".join(f"coalesce(strlen({c}), 0)" for c in body.texts)
    ctes = (
        _quality_ctes(body)
        + f""", hist AS ({_numeric_profile_sql("e", body.numbers)}),
    info AS (SELECT count(*) AS rows, {len(body.columns)} AS columns,
      {len(body.numbers)} AS numeric_features, {len(body.texts)} AS categorical_features,
      sum({body.width} + {lengths}) / 1048576.0 AS memory_usage_mb FROM e),
    tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name
      ORDER BY cnt DESC, value) AS rnk FROM ({_counts_sql("e", body.texts)})) WHERE rnk <= 10),
    summ AS ({_summary_sql(body)})
    """
    )
    pairs = len(body.numbers) > 1
    if pairs:
        ctes += f", matrix AS ({_matrix_sql('e', body.numbers)})"
    parts = [
        _long_sql(
            "dataset_info", "''", "info",
            ["rows", "columns", "numeric_features", "categorical_features", "memory_usage_mb"], [],
        ),
        _long_sql(
            "histogram", "column_name", "hist",
            ["mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis", "count"],
            [],
        ),
        _long_sql(
            "categorical", "column_name", "cats",
            ["unique_values", "mode_frequency", "missing_count", "missing_percentage"], ["mode"],
        ),
        _long_sql(
            "missing_summary", "''", "miss",
            ["total_rows", "total_columns", "total_missing", "total_missing_percentage",
             "rows_with_missing"], ["fully_missing_columns"],
        ),
        _long_sql(
            "missing_per_column", "column_name", "miss_cols",
            ["missing_count", "missing_percentage"], [],
        ),
        _long_sql(
            "outliers", "column_name", "outl",
            ["lower_bound", "upper_bound", "outlier_count", "outlier_percentage"], [],
        ),
        _long_sql(
            "quality", "''", "qual",
            ["overall_score", "completeness", "uniqueness", "missing_percentage",
             "duplicate_rows", "duplicate_percentage", "outlier_count"], ["assessment"],
        ),
        _long_sql(
            "summary", "''", "summ",
            ["quality_score", "completeness", "uniqueness", "features", "insights_count",
             "issues_critical", "issues_high", "issues_medium"],
            ["assessment", "top_concern", "recommendation"],
        ),
        """SELECT 'top_values', column_name, 'rank_' || rnk, CAST(cnt AS DOUBLE), value
           FROM tops""",
    ]
    if pairs:
        parts.append(
            """SELECT 'correlation', feature1 || '|' || feature2, 'correlation', correlation, NULL
           FROM matrix"""
        )
    return ctes + union(parts)


SECTIONS = ["quality", "missing_per_column"]


def _sections(spark, d):
    """Two stored analyses, of which single sections are read."""
    path = fresh_dir(spark, "analyses")
    for name, df, key in (
        ("events", events_nulls(spark, d), "event_id"),
        ("documents", table(spark, d, "documents"), "doc_id"),
    ):
        store_analysis(analyze(df, key=key), name, path)
    parts = [read_section(spark, path, name, s) for name in ("events", "documents") for s in SECTIONS]
    return rounded(reduce(DataFrame.unionByName, parts))


def _sections_sql() -> str:
    listed = ", ".join(f"'{s}'" for s in SECTIONS)
    return union(
        [
            f"SELECT '{name}' AS eda_id, * FROM ({_eda_full_sql(body)}) WHERE section IN ({listed})"
            for name, body in (("events", EVENTS), ("documents", DOCUMENTS))
        ]
    )


def _body(spark, d):
    return events_nulls(spark, d).drop("event_id")


def _quality_inputs(spark, d):
    """The one-row results the quality score is built from."""
    df = _body(spark, d)
    return prof.missing_summary(df), qual.duplicates(df), out.outlier_total(df)


def _insights(spark, d):
    return analyze(events_nulls(spark, d), key="event_id").insights


_SHAPES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
    "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3,
    "conversations": 4,
}


_SAMPLE_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
FROM (SELECT *, (((o_orderkey % 2147483648) * 2654435761 + 42) % 4294967296) AS h FROM orders)
ORDER BY h, o_orderkey LIMIT {n}"""

ORDER_STRINGS = ["o_orderstatus", "o_orderpriority"]
PART_STRINGS = ["p_name", "p_brand", "p_type"]
ORDER_KEEP = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]

CHECKS = {
    "numeric_profile": (
        lambda s, d: rounded(prof.numeric_profile(table(s, d, "lineitem"))),
        _numeric_profile_sql("lineitem", LINEITEM_NUMBERS),
    ),
    "numeric_profile_nulls": (
        lambda s, d: rounded(prof.numeric_profile(events_nulls(s, d))),
        _nulls(_numeric_profile_sql("e", EVENT_NUMBERS)),
    ),
    "describe": (
        lambda s, d: rounded(prof.describe(table(s, d, "lineitem"))),
        _describe_sql("lineitem", LINEITEM_NUMBERS),
    ),
    "describe_strings": (
        lambda s, d: prof.describe_strings(table(s, d, "conversations")),
        union(
            [
                f"""SELECT '{c}' AS column_name, (SELECT count({c}) FROM conversations) AS count,
                (SELECT count(DISTINCT {c}) FROM conversations) AS "unique",
                (SELECT {c} FROM conversations GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)
                  AS top,
                (SELECT max(n) FROM (SELECT count(*) AS n FROM conversations GROUP BY {c}))
                  AS freq"""
                for c in ("role", "text")
            ]
        ),
    ),
    "dataset_statistics": (
        lambda s, d: rounded(prof.dataset_statistics(events_nulls(s, d))),
        _nulls(
            "SELECT *, CAST(NULL AS VARCHAR) AS text FROM ("
            + union(
                [
                    "SELECT '' AS column_name, 'row_count' AS metric, "
                    "CAST(count(*) AS DOUBLE) AS value FROM e",
                    "SELECT '', 'column_count', CAST(7 AS DOUBLE)",
                ]
                + [
                    f"SELECT '{c}', 'missing', CAST(count(*) - count({c}) AS DOUBLE) FROM e"
                    for c in EVENT_COLUMNS
                ]
                + [
                    f"SELECT '{c}', 'unique', CAST(count(DISTINCT {c}) AS DOUBLE) FROM e"
                    for c in EVENT_COLUMNS
                ]
                + [
                    f"SELECT '{c}', '{m}', {r(f'CAST({e.format(c=c)} AS DOUBLE)')} FROM e"
                    for c in EVENT_NUMBERS
                    for m, e in {
                        "count": "count({c})",
                        "mean": "avg({c})",
                        "std": "stddev_samp({c})",
                        "min": "min({c})",
                        "q25": "quantile_cont({c}, 0.25)",
                        "median": "quantile_cont({c}, 0.5)",
                        "q75": "quantile_cont({c}, 0.75)",
                        "max": "max({c})",
                    }.items()
                ]
            )
            + ")"
            + "".join(
                f""" UNION ALL SELECT '{c}', 'dtype', NULL, CASE typeof(first({c}))
                WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double'
                WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'string' END FROM e"""
                for c in EVENT_COLUMNS
            )
        ),
    ),
    "missing_counts": (
        lambda s, d: prof.missing_counts(events_nulls(s, d)),
        _nulls(_missing_sql("e", EVENT_COLUMNS)),
    ),
    "missing_summary": (
        lambda s, d: rounded(prof.missing_summary(events_nulls(s, d))),
        _nulls(_missing_summary_sql("e", EVENT_COLUMNS)),
    ),
    "missing_per_column": (
        lambda s, d: rounded(prof.missing_per_column(events_nulls(s, d))),
        _nulls(_missing_pct_sql("e", EVENT_COLUMNS)),
    ),
    "unique_counts": (
        lambda s, d: prof.unique_counts(table(s, d, "customer")).unionByName(
            prof.unique_counts(table(s, d, "part"))
        ),
        union(
            [
                f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count FROM {t}"
                for t, cols in {
                    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
                }.items()
                for c in cols
            ]
        ),
    ),
    "dataset_info": (
        lambda s, d: rounded(prof.dataset_info(table(s, d, "events")), 6),
        f"""SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns,
        CAST(3 AS BIGINT) AS numeric_features, CAST(2 AS BIGINT) AS categorical_features,
        {r("CAST(sum(32 + strlen(event_type) + strlen(props)) AS DOUBLE) / 1048576.0", 6)}
          AS memory_usage_mb FROM events""",
    ),
    "dataset_manifest": (
        lambda s, d: man.manifest(s, {t: f"{d}/{t}.parquet" for t in TABLES}).select(
            "dataset_id", "row_count", "column_count", F.concat_ws(",", "columns").alias("columns")
        ),
        union(
            [
                f"SELECT '{t}' AS dataset_id, count(*) AS row_count, "
                f"CAST({n} AS INTEGER) AS column_count, "
                f"'{{{t}}}' AS columns FROM {t}"
                for t, n in _SHAPES.items()
            ]
        ),
    ),
    "dataset_list": (
        lambda s, d: man.list_datasets(
            man.manifest(s, {t: f"{d}/{t}.parquet" for t in TABLES})
        ).select("name", "row_count", "total"),
        union(
            [
                f"SELECT '{t}' AS name, count(*) AS row_count, CAST({len(_SHAPES)} AS BIGINT) "
                f"AS total FROM {t}"
                for t in _SHAPES
            ]
        ),
    ),
    "preview": (
        lambda s, d: man.preview(table(s, d, "orders").drop("o_orderdate"), "o_orderkey", 10),
        f"SELECT {', '.join(ORDER_KEEP)} FROM orders ORDER BY o_orderkey LIMIT 10",
    ),
    "dataset_sample": (
        lambda s, d: man.preview(table(s, d, "part"), "p_partkey", 5),
        "SELECT * FROM part ORDER BY p_partkey LIMIT 5",
    ),
    "sample_rows": (
        lambda s, d: sample_rows(table(s, d, "orders").select(*ORDER_KEEP), "o_orderkey", 1000),
        _SAMPLE_SQL.format(n=1000),
    ),
    "categorical_profile": (
        lambda s, d: rounded(
            prof.categorical_profile(table(s, d, "part").select(*PART_STRINGS)).unionByName(
                prof.categorical_profile(events_nulls(s, d))
            )
        ),
        _nulls(
            union(
                [
                    _categorical_sql("part", PART_STRINGS),
                    _categorical_sql("e", ["props", "event_type"]),
                ]
            )
        ),
    ),
    "top_values": (
        lambda s, d: prof.top_values(prof.value_counts(table(s, d, "part"))),
        f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY column_name
          ORDER BY cnt DESC, value) AS INTEGER) AS rnk
          FROM ({_counts_sql("part", PART_STRINGS)})) WHERE rnk <= 10""",
    ),
    "outliers": (
        lambda s, d: rounded(out.outliers(events_nulls(s, d).drop("event_id")), 6),
        _nulls(_outliers_sql("e", ["user_id", "value"], 6)),
    ),
    "outliers_lineitem": (
        lambda s, d: rounded(out.outliers(table(s, d, "lineitem").select(*MEASURES)), 6),
        _outliers_sql("lineitem", MEASURES, 6),
    ),
    "outlier_ids": (
        lambda s, d: out.outlier_ids(events_nulls(s, d), "event_id"),
        _nulls(
            """SELECT 'value' AS column_name, event_id AS row_key,
            CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS rnk
            FROM e, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
              FROM e)
            WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
            ORDER BY event_id LIMIT 100"""
        ),
    ),
    "outlier_total": (
        lambda s, d: out.outlier_total(_body(s, d)),
        _nulls(
            f"""SELECT CAST(sum(outlier_count) AS BIGINT) AS outlier_count
            FROM ({_outliers_sql("e", ["user_id", "value"])})"""
        ),
    ),
    "correlation_matrix": (
        lambda s, d: rounded(corr.correlation_matrix(lineitem_gross(s, d))),
        _gross(_matrix_sql("g", GROSS_COLUMNS)),
    ),
    "strong_correlations": (
        lambda s, d: rounded(corr.strong_correlations(lineitem_gross(s, d))),
        _gross(_strong_sql("g", GROSS_COLUMNS)),
    ),
    "feature_target_rank_class": (
        lambda s, d: rounded(
            corr.feature_target_rank(
                table(s, d, "events").select(
                    "event_type", "value", "user_id", (F.col("event_id") % 10).alias("digit")
                ),
                "event_type",
            )
        ),
        """WITH e AS (SELECT event_type, value, user_id, event_id % 10 AS digit FROM events)
        SELECT CAST(row_number() OVER (ORDER BY c DESC, feature) AS INTEGER) AS rank, feature,
        round(c, 4) AS correlation, round(c, 4) AS importance FROM ("""
        + union(
            [
                f"""SELECT '{f}' AS feature, sqrt(sum(n * (m - g) ** 2) / max(v)) AS c
                FROM (SELECT count({f}) AS n, avg({f}) AS m FROM e GROUP BY event_type),
                (SELECT avg({f}) AS g, var_pop({f}) * count({f}) AS v FROM e)"""
                for f in ("value", "user_id", "digit")
            ]
        )
        + ")",
    ),
    "feature_target_rank": (
        lambda s, d: rounded(corr.feature_target_rank(lineitem_gross(s, d), "gross")),
        _gross(
            f"""SELECT CAST(row_number() OVER (ORDER BY abs(c) DESC NULLS LAST, feature) AS INTEGER)
            AS rank, feature, {r("c")} AS correlation, {r("abs(c)")} AS importance FROM ("""
            + union(
                [
                    f"SELECT '{f}' AS feature, {_corr_sql('g', f, 'gross')} AS c FROM g"
                    for f in GROSS_COLUMNS
                    if f != "gross"
                ]
            )
            + ")"
        ),
    ),
    "duplicates": (
        lambda s, d: rounded(
            qual.duplicates(events_nulls(s, d).select("user_id", "event_type", "empty"))
        ),
        _nulls(
            f"""SELECT CAST(sum(n) AS BIGINT) AS total_rows,
            CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
            {r(f"100.0 * {div('sum(n - 1)', 'sum(n)')}")} AS duplicate_percentage
            FROM (SELECT count(*) AS n FROM e GROUP BY user_id, event_type, empty)"""
        ),
    ),
    "quality_score": (
        lambda s, d: rounded(qual.quality_score(*_quality_inputs(s, d))),
        _QUALITY_SQL,
    ),
    "recommendations": (
        lambda s, d: qual.recommendations(qual.quality_score(*_quality_inputs(s, d))).select(
            "recommendation"
        ),
        f"{_QUALITY_CTES} SELECT recommendation FROM advice",
    ),
    "insights": (lambda s, d: rounded(_insights(s, d)), f"{_QUALITY_CTES} {_FOUND}"),
    "insights_documents": (
        lambda s, d: rounded(analyze(table(s, d, "documents"), key="doc_id").insights),
        f"{_quality_ctes(DOCUMENTS)} {_FOUND}",
    ),
    "insight_totals": (
        lambda s, d: qual.insight_totals(_insights(s, d)),
        f"""{_QUALITY_CTES} SELECT count(*) AS total,
        count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
        count(*) FILTER (WHERE severity = 'HIGH') AS high,
        count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
        count(*) FILTER (WHERE severity = 'LOW') AS low FROM found""",
    ),
    "eda_summary": (
        lambda s, d: rounded(analyze(events_nulls(s, d), key="event_id").summary),
        f"{_QUALITY_CTES} {_summary_sql(EVENTS)}",
    ),
    "eda_full": (
        lambda s, d: rounded(analyze(events_nulls(s, d), key="event_id").long()),
        _eda_full_sql(EVENTS),
    ),
    "eda_documents": (
        lambda s, d: rounded(analyze(table(s, d, "documents"), key="doc_id").long()),
        _eda_full_sql(DOCUMENTS),
    ),
    "eda_sections": (_sections, _sections_sql()),
}
_COLUMNS = {
    "region": "r_regionkey,r_name",
    "nation": "n_nationkey,n_name,n_regionkey",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,"
    "l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate",
    "events": "event_id,ts,user_id,event_type,value,props",
    "documents": "doc_id,text,lang,source,n_chars",
    "embeddings": "vec_id,embedding,label",
    "pages": "page_id,url,html",
    "benchmark": "item_id,text",
    "labels": "doc_id,quality,toxic",
    "conversations": "conv_id,turn,role,text",
}
CHECKS["dataset_manifest"] = (
    CHECKS["dataset_manifest"][0],
    CHECKS["dataset_manifest"][1].format(**_COLUMNS),
)
