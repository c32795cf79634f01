"""Training, scoring, registries and job history."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.tables import div, r, rounded, table, union
from tabassay.operators import algorithms as alg
from tabassay.operators import leaderboard as lead
from tabassay.operators import modeling as mod
from tabassay.operators import registry as reg
from tabassay.operators import runlog as log
from tabassay.operators.business import running_share
from tabassay.operators.explain import linear_contributions, model_contributions
from tabassay.operators.features import polynomial
from tabassay.plans import training as tr
from tabassay.session import fresh_dir
from tabassay.sources import sinks
from tabassay.sources.readers import read_csv
from tabassay.streaming.scoring import score_arrivals


def class_rows(spark, d):
    """Events with a learnable class and some missing values."""
    key = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id",
        "ts",
        "event_type",
        F.when(key % 7 != 0, F.col("value")).alias("value"),
        (key % 3).alias("third"),
        ((F.col("value") + 20 * (key % 3)) > 60).cast("int").alias("target"),
    )


def reg_rows(spark, d):
    """Line items with a learnable number."""
    target = (
        3 * F.col("l_quantity")
        - 200 * F.col("l_discount")
        + 0.001 * F.col("l_extendedprice")
        + (F.col("l_orderkey") * 7919) % 11
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag",
        target.alias("target"),
    )


REG_ROWS = """SELECT l_orderkey, l_quantity AS x, 3 * l_quantity - 200 * l_discount
  + 0.001 * l_extendedprice + (l_orderkey * 7919) % 11 AS y,
  (((l_orderkey % 2147483648) * 2654435761 + 42) % 4294967296) % 100 < 20 AS test FROM lineitem"""

# Slope of y on x for a penalty on the slope: alpha is the ridge, lambda the lasso weight.
SLOPES = {
    "linear": "covar_pop(y, x) / var_pop(x)",
    "ridge": "covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 1)",
    "lasso": "greatest(covar_pop(y, x) - 1, 0) / var_pop(x)",
}


def _config(**options):
    return tr.TrainingConfig(**({"use_feature_engineering": True} | options))


# Trees and rounds of all candidates beside one another on five folds; each has an entry of
# its own with the documented hundred. README has the figures.
COMPARED = alg.Effort(trees=20, rounds=20, tree_depth=12)


def _fit_ctes(name: str) -> str:
    return f"""WITH rows_ AS ({REG_ROWS}), st AS (SELECT {SLOPES[name]} AS slope, avg(y) AS my,
      avg(x) AS mx FROM rows_ WHERE NOT test)"""


def _one_feature(spark, d, name, cv_folds=0):
    """A model of one feature, so that SQL can state its numbers."""
    rows = reg_rows(spark, d).select("l_orderkey", "l_quantity", "target")
    config = _config(use_feature_engineering=False, cv_folds=cv_folds)
    return tr.train(rows, "target", name, "regression", "l_orderkey", config)


def _line(name):
    def run(spark, d):
        result = _one_feature(spark, d, name, cv_folds=5)
        fitted = mod.predictor(result.model)
        return result.scores.select(
            F.round(F.lit(float(fitted.coefficients[0])), 3).alias("slope"),
            F.round(F.lit(float(fitted.intercept)), 2).alias("intercept"),
            F.round("train_score", 3).alias("train_score"),
            F.round("test_score", 3).alias("test_score"),
            F.round("cv_score", 3).alias("cv_score"),
            F.round("cv_std", 3).alias("cv_std"),
            "train_size",
            "test_size",
        )

    return run


REG_FOLDS = f"""SELECT *, (((l_orderkey % 2147483648) * 2654435761 + 7) % 4294967296 // 1024) % 5
  AS fold FROM ({REG_ROWS}) WHERE NOT test"""


def _line_sql(name: str) -> str:
    r2 = "1 - avg((y - my - slope * (x - mx)) ** 2) FILTER (WHERE {w}) / var_pop(y) FILTER (WHERE {w})"
    return f"""{_fit_ctes(name)}, f AS ({REG_FOLDS}),
      fs AS (SELECT k, {SLOPES[name]} AS fold_slope, avg(y) AS fold_y, avg(x) AS fold_x
        FROM f, range(5) r(k) WHERE fold <> k GROUP BY k),
      sc AS (SELECT k, 1 - avg((y - fold_y - fold_slope * (x - fold_x)) ** 2) / var_pop(y) AS r2
        FROM f JOIN fs ON fold = k GROUP BY k)
      SELECT (SELECT round(round(avg(r2), 4), 3) FROM sc) AS cv_score,
      (SELECT round(round(stddev_pop(r2), 4), 3) FROM sc) AS cv_std,
      round(max(slope), 3) AS slope,
      round(max(my - slope * mx), 2) AS intercept,
      round(round({r2.format(w="NOT test")}, 4), 3) AS train_score,
      round(round({r2.format(w="test")}, 4), 3) AS test_score,
      count(*) FILTER (WHERE NOT test) AS train_size,
      count(*) FILTER (WHERE test) AS test_size FROM rows_, st"""


def _rows_and_key(spark, d, problem_type):
    if problem_type == "classification":
        return class_rows(spark, d), "event_id"
    return reg_rows(spark, d), "l_orderkey"


def _constant_score(rows, problem_type):
    """What predicting one constant scores: the largest class share, or an R2 of 0."""
    if problem_type == "regression":
        return F.lit(0.0)
    sizes = rows.groupBy("target").count()
    return F.lit(float(sizes.agg(F.max("count") / F.sum("count")).first()[0]))


def _facts(result, rows, problem_type):
    """What SQL can say of a training run: its parts, its features, and that it learned."""
    best = _constant_score(rows, problem_type)
    return result.scores.select(
        "algorithm", "problem_type", "train_size", "test_size", "n_features",
        "rows_without_label", (F.col("test_score") > best).alias("learned"),
    )


PART_SIZES = {
    "classification": """SELECT count(*) FILTER (WHERE NOT test) AS train_size,
      count(*) FILTER (WHERE test) AS test_size,
      CAST(2 + count(DISTINCT event_type) FILTER (WHERE NOT test) - 1 AS INTEGER) AS n_features
      FROM (SELECT *, (((event_id % 2147483648) * 2654435761 + 42) % 4294967296) % 100 < 20
        AS test FROM events)""",
    "regression": """SELECT count(*) FILTER (WHERE NOT test) AS train_size,
      count(*) FILTER (WHERE test) AS test_size,
      CAST(3 + count(DISTINCT l_returnflag) FILTER (WHERE NOT test) - 1 AS INTEGER) AS n_features
      FROM (SELECT *, (((l_orderkey % 2147483648) * 2654435761 + 42) % 4294967296) % 100 < 20
        AS test FROM lineitem)""",
}


def _facts_sql(algorithm, problem_type, features="n_features", sizes=None):
    return f"""SELECT '{algorithm}' AS algorithm, '{problem_type}' AS problem_type, train_size,
      test_size, {features} AS n_features, CAST(0 AS BIGINT) AS rows_without_label,
      true AS learned FROM ({sizes or PART_SIZES[problem_type]})"""


def _train(algorithm, problem_type, **options):
    def run(spark, d):
        rows, key = _rows_and_key(spark, d, problem_type)
        result = tr.train(rows, "target", algorithm, problem_type, key, _config(**options))
        return _facts(result, rows, problem_type)

    return run


def _scored(algorithm, problem_type, **options):
    """The sizes and real scores of a training run; pytest holds the learners to their maths."""

    def run(spark, d):
        rows, key = _rows_and_key(spark, d, problem_type)
        result = tr.train(rows, "target", algorithm, problem_type, key, _config(**options))
        return result.scores.drop("training_time_seconds")

    return run


def _automl(problem_type, effort=COMPARED):
    """Every candidate on five folds: the leaderboard and the winner's test metrics."""

    def run(spark, d):
        rows, key = _rows_and_key(spark, d, problem_type)
        found = tr.automl(rows, "target", problem_type, key, config=_config(effort=effort))
        board = found.leaderboard.drop("training_time_seconds")
        test = found.metrics.select([F.col(c).alias(f"test_{c}") for c in found.metrics.columns])
        best = F.col("algorithm") == found.best_algorithm
        return board.join(test, best, "left")

    return run


def _saved_line(spark, d):
    """A one-feature model after a save and a load."""
    path = fresh_dir(spark, "model")
    _one_feature(spark, d, "linear").model.save(path)
    return mod.FittedModel.load(spark, path)


def _batch_score(spark, d):
    rows = reg_rows(spark, d).select("l_orderkey", "l_quantity")
    scored = mod.predict(_saved_line(spark, d), rows)
    path = fresh_dir(spark, "scored")
    sinks.write_scored(scored, path)
    return spark.read.parquet(path).withColumn("prediction", F.round("prediction", 3))


def _stream_score(spark, d):
    model = _saved_line(spark, d)
    rows = reg_rows(spark, d).select("l_orderkey", "l_quantity")
    source = fresh_dir(spark, "arrivals")
    rows.write.parquet(source)
    scored = score_arrivals(
        spark, model, source, rows.schema, fresh_dir(spark, "scored"),
        fresh_dir(spark, "progress"), files_per_batch=2,
    )
    return scored.withColumn("prediction", F.round("prediction", 3))


SCORE_SQL = f"""{_fit_ctes("linear")} SELECT l_orderkey, x AS l_quantity,
  {r("my + slope * (x - mx)", 3)} AS prediction FROM rows_, st"""


def _chances(spark, d):
    """Logistic chances of one feature, whose gaps are filled with the training mean."""
    rows = class_rows(spark, d).select("event_id", "value", "target")
    config = _config(use_feature_engineering=False)
    model = tr.train(rows, "target", "logistic", "classification", "event_id", config).model
    scored = mod.predict(model, rows)

    def hundredths(chance):  # of four digits, never halfway between two hundredths
        return F.floor(chance * 100 + 0.495).cast("int")

    return scored.select(
        "event_id", "prediction", hundredths(F.col("probability")["1"]).alias("chance"),
        hundredths(F.col("confidence")).alias("confidence"),
    )


# Newton's steps for the penalised chances, the penalty being half the squared slope.
CHANCES = """WITH RECURSIVE r AS (SELECT event_id,
  CASE WHEN event_id % 7 <> 0 THEN value END AS v, (value + 20 * (event_id % 3) > 60)::INT AS y,
  (((event_id % 2147483648) * 2654435761 + 42) % 4294967296) % 100 < 20 AS test FROM events),
x AS (SELECT event_id, y, test, coalesce(v, (SELECT avg(v) FROM r WHERE NOT test)) AS x FROM r),
w AS (SELECT 0 AS step, 0.0::DOUBLE AS b, 0.0::DOUBLE AS m UNION ALL
  SELECT any_value(step) + 1,
    any_value(b) - (sum(p - y) * (sum(h * x * x) + 1) - (sum((p - y) * x) + any_value(m)) * sum(h * x))
      / (sum(h) * (sum(h * x * x) + 1) - sum(h * x) ** 2),
    any_value(m) - ((sum((p - y) * x) + any_value(m)) * sum(h) - sum(p - y) * sum(h * x))
      / (sum(h) * (sum(h * x * x) + 1) - sum(h * x) ** 2)
  FROM (SELECT *, p * (1 - p) AS h FROM (SELECT step, b, m, x, y, 1 / (1 + exp(-b - m * x)) AS p
    FROM w, x WHERE NOT test AND step < 30)) HAVING count(*) > 0)
SELECT event_id, CASE WHEN p > 0.5 THEN '1' ELSE '0' END AS prediction,
  CAST(floor(round(p, 4) * 100 + 0.495) AS INTEGER) AS chance,
  CAST(floor(round(greatest(p, 1 - p), 4) * 100 + 0.495) AS INTEGER) AS confidence
FROM (SELECT event_id, 1 / (1 + exp(-b - m * x)) AS p FROM x, w WHERE step = 30)"""


def _tuned(spark, d):
    """Every setting that a random search drew, with its scores on all folds."""
    config = _config(
        tune_hyperparameters=True, tuning_search_type="random", tuning_halving=False
    )
    rows = class_rows(spark, d)
    return tr.train(rows, "target", "decision_tree", "classification", "event_id", config).tuning


def _explain(spark, d):
    result = _one_feature(spark, d, "linear")
    rows = reg_rows(spark, d).select("l_orderkey", "l_quantity")
    return model_contributions(result.model, rows, "l_orderkey").withColumn(
        "contribution", F.round("contribution", 3)
    )


def _importance(algorithm, problem_type):
    def run(spark, d):
        rows, key = (
            (class_rows(spark, d), "event_id")
            if problem_type == "classification"
            else (reg_rows(spark, d), "l_orderkey")
        )
        found = tr.train(rows, "target", algorithm, problem_type, key, _config())
        return found.feature_importance

    return run


def _importance_facts(algorithm, problem_type):
    def run(spark, d):
        return _importance(algorithm, problem_type)(spark, d).agg(
            F.count(F.lit(1)).cast("int").alias("features"),
            F.round(F.sum("importance"), 2).alias("total"),
            F.max("rank").alias("last_rank"),
        )

    return run


# Coefficients of the standardised features follow from how the target is made.
TOP_FEATURES = """SELECT CAST(row_number() OVER (ORDER BY s DESC) AS INTEGER) AS rank, feature
  FROM (SELECT 'l_quantity' AS feature, 3 * stddev_pop(l_quantity) AS s FROM lineitem
    UNION ALL SELECT 'l_discount', 200 * stddev_pop(l_discount) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 0.001 * stddev_pop(l_extendedprice) FROM lineitem)"""




def _cv_line(spark, d):
    rows = reg_rows(spark, d).select("l_orderkey", "l_quantity", "target")
    config = tr.TrainingConfig(cv_folds=5)
    scores = tr.train(rows, "target", "linear", "regression", "l_orderkey", config).scores
    return scores.select(
        F.round("cv_score", 3).alias("cv_score"), F.round("cv_std", 3).alias("cv_std")
    )


def _registered(spark, d):
    """What the registry and the importance table say after a training run."""
    home = fresh_dir(spark, "registered")
    config = tr.TrainingConfig(
        cv_folds=0, model_dir=f"{home}/models", registry_path=f"{home}/registry",
        importance_path=f"{home}/importance",
    )
    rows = reg_rows(spark, d).select("l_orderkey", "l_quantity", "target")
    found = tr.train(rows, "target", "linear", "regression", "l_orderkey", config)
    model = mod.FittedModel.load(spark, f"{home}/models/{found.model_id}")
    row = reg.get_model(spark.read.parquet(f"{home}/registry"), found.model_id)
    shares = reg.importance_of(spark.read.parquet(f"{home}/importance"), found.model_id)
    return row.join(shares, "model_id").select(
        "name", "problem_type", "metric", F.round("score", 3).alias("score"), "is_deployed",
        "feature", "importance", F.lit(model.target).alias("target"),
    )


def _csv_codes(spark, d):
    """Codes that end like number types, written as CSV and read back."""
    end = F.when(F.col("p_partkey") % 2 == 0, "D").otherwise("F")
    codes = table(spark, d, "part").select(
        "p_partkey", F.concat((F.col("p_partkey") % 100).cast("string"), end).alias("code")
    )
    path = fresh_dir(spark, "codes") + ".csv"
    sinks.write_csv(codes, path)
    return read_csv(spark, path)


def _csv_roundtrip(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus",
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"),
    )
    path = fresh_dir(spark, "orders") + ".csv"
    sinks.write_csv(orders, path)
    return read_csv(spark, path)


# Algorithm results derived from the events: one "algorithm" per event type.
RESULTS = """SELECT event_type AS algorithm, avg(value) / 100 AS score,
  sum(value) AS training_time_seconds, min(event_id) AS algo_order FROM events GROUP BY event_type"""


def _results(spark, d):
    return (
        table(spark, d, "events")
        .groupBy(F.col("event_type").alias("algorithm"))
        .agg(
            (F.avg("value") / 100).alias("score"),
            F.sum("value").alias("training_time_seconds"),
            F.min("event_id").alias("algo_order"),
        )
    )


def _board_csv(spark, d):
    path = fresh_dir(spark, "leaderboard") + ".csv"
    board = lead.rank_leaderboard(_results(spark, d)).select("rank", "algorithm", "algo_order")
    sinks.write_leaderboard(board, path)
    return read_csv(spark, path)


# Registry events derived from the user events: model = user.
REGISTRY = """SELECT user_id AS model_id, ts AS event_ts, event_id AS seq, value AS score,
  CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'deploy'
    WHEN 'error' THEN 'undeploy' ELSE 'view' END AS event FROM events"""


def _registry(spark, d):
    kind = (
        F.when(F.col("event_type") == "signup", "register")
        .when(F.col("event_type") == "purchase", "deploy")
        .when(F.col("event_type") == "error", "undeploy")
        .otherwise("view")
    )
    return table(spark, d, "events").select(
        F.col("user_id").alias("model_id"), F.col("ts").alias("event_ts"),
        F.col("event_id").alias("seq"), F.col("value").alias("score"), kind.alias("event"),
    )


STATE = f"""SELECT model_id, arg_max(score, (event_ts, seq)) FILTER (WHERE event = 'register')
    AS score, min(event_ts) FILTER (WHERE event = 'register') AS created_at,
  coalesce(arg_max(event = 'deploy', (event_ts, seq))
    FILTER (WHERE event IN ('deploy', 'undeploy')), false) AS is_deployed
  FROM ({REGISTRY}) GROUP BY model_id"""


def _job_log(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


JOB_STATE = """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status,
  CAST(least(100, greatest(0, arg_max(value, (ts, event_id)))) AS DOUBLE) AS progress,
  min(ts) AS created_at, max(ts) AS updated_at,
  CAST(datediff('microsecond', min(ts), max(ts)) // 1000000 AS BIGINT) AS elapsed_seconds,
  count(*) AS events FROM events GROUP BY user_id"""


def _state(spark, d):
    return log.latest_state(_job_log(spark, d), "user_id", ["ts", "event_id"], "event_type", "value")


COEFFICIENTS = {"l_quantity": 3.0, "l_discount": -200.0, "l_tax": 12.5}


def _select_top(spark, d):
    config = _config(n_features=2)
    result = tr.train(
        reg_rows(spark, d), "target", "linear", "regression", "l_orderkey", config
    )
    return result.feature_importance


def _polynomial(spark, d):
    return tr.train(
        reg_rows(spark, d).drop("l_returnflag"), "target", "ridge", "regression", "l_orderkey",
        _config(polynomial_degree=2),
    )


CHECKS = {
    **{f"train_{n}": (_line(n), _line_sql(n)) for n in SLOPES},
    **{
        f"train_{n}": (_scored(n, "classification"), None)
        for n in ("random_forest", "xgboost", "gradient_boosting", "svm")
    },
    **{
        f"train_{n}": (_train(n, "classification"), _facts_sql(n, "classification"))
        for n in ("logistic", "decision_tree")
    },
    **{
        f"train_{n}_regression": (_scored(n, "regression"), None)
        for n in ("xgboost", "gradient_boosting", "decision_tree", "svr")
    },
    "train_random_forest_regression": (_scored("random_forest", "regression", cv_folds=0), None),
    "automl_classification": (_automl("classification"), None),
    "automl_regression": (_automl("regression"), None),
    "train_job": (
        lambda s, d: _facts(
            tr.train(
                class_rows(s, d), "target", "decision_tree", "classification", "event_id",
                _config(scaling_method="robust", exact_split=True, exact_folds=True),
            ),
            class_rows(s, d), "classification",
        ),
        _facts_sql(
            "decision_tree", "classification",
            sizes="""SELECT count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) AS train_size,
            CAST(ceil(0.2 * count(*)) AS BIGINT) AS test_size,
            CAST(1 + count(DISTINCT event_type) AS INTEGER) AS n_features FROM events""",
        ),
    ),
    "tuned": (
        lambda s, d: _facts(
            tr.train(
                class_rows(s, d), "target", "logistic", "classification", "event_id",
                _config(tune_hyperparameters=True),
            ),
            class_rows(s, d), "classification",
        ),
        _facts_sql("logistic", "classification"),
    ),
    "tuned_settings": (_tuned, None),
    "model_importance": (
        _importance_facts("random_forest", "classification"),
        f"""SELECT n_features AS features, CAST(1 AS DOUBLE) AS total, n_features AS last_rank
        FROM ({PART_SIZES["classification"]})""",
    ),
    "linear_importance": (
        lambda s, d: _importance("linear", "regression")(s, d)
        .filter("rank <= 3").select("rank", "feature"),
        TOP_FEATURES,
    ),
    "select_top_features": (
        lambda s, d: _select_top(s, d).select("feature"),
        f"""WITH t AS (SELECT *, 3 * l_quantity - 200 * l_discount + 0.001 * l_extendedprice
          + (l_orderkey * 7919) % 11 AS y FROM lineitem WHERE NOT
          (((l_orderkey % 2147483648) * 2654435761 + 42) % 4294967296) % 100 < 20)
        SELECT feature FROM ({union([
            f"SELECT '{f}' AS feature, abs({e}) AS c FROM t" for f, e in (
                ("l_quantity", "corr(y, l_quantity)"), ("l_discount", "corr(y, l_discount)"),
                ("l_extendedprice", "corr(y, l_extendedprice)"),
                ("l_returnflag_N", "corr(y, (l_returnflag = 'N')::INT)"),
                ("l_returnflag_R", "corr(y, (l_returnflag = 'R')::INT)"))
        ])}) ORDER BY c DESC LIMIT 2""",
    ),
    "polynomial_features": (
        lambda s, d: _facts(_polynomial(s, d), reg_rows(s, d), "regression"),
        _facts_sql("ridge", "regression", "CAST(9 AS INTEGER)"),
    ),
    "batch_score": (_batch_score, SCORE_SQL),
    "stream_score": (_stream_score, SCORE_SQL),
    "class_scores": (_chances, CHANCES),
    "explain": (
        _explain,
        f"""{_fit_ctes("linear")} SELECT l_orderkey AS row_key, 'l_quantity' AS feature,
        {r("slope * (x - (SELECT avg(x) FROM rows_))", 3)} AS contribution FROM rows_, st""",
    ),
    "linear_contributions": (
        lambda s, d: rounded(
            linear_contributions(table(s, d, "lineitem"), "l_orderkey", COEFFICIENTS)
        ),
        union(
            [
                f"""SELECT l_orderkey AS row_key, '{n}' AS feature,
                {r(f"{c} * ({n} - (SELECT avg({n}) FROM lineitem))")} AS contribution
                FROM lineitem"""
                for n, c in COEFFICIENTS.items()
            ]
        ),
    ),
    "polynomial_values": (
        lambda s, d: rounded(
            polynomial(
                table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax"),
                ["l_quantity", "l_tax"], 2,
            ).drop("l_quantity", "l_tax")
        ),
        f"""SELECT l_orderkey, {r("l_quantity")} AS poly_1,
        {r("l_quantity * l_quantity")} AS poly_2, {r("l_tax")} AS poly_3,
        {r("l_quantity * l_tax")} AS poly_4, {r("l_tax * l_tax")} AS poly_5
        FROM lineitem""",
    ),
    "cv_scores_linear": (
        _cv_line,
        f"""WITH rows_ AS ({REG_FOLDS}), st AS (SELECT k, {SLOPES["linear"]} AS slope,
          avg(y) AS my, avg(x) AS mx FROM rows_, range(5) f(k) WHERE fold <> k GROUP BY k),
        sc AS (SELECT k, 1 - avg((y - my - slope * (x - mx)) ** 2) / var_pop(y) AS r2
          FROM rows_ JOIN st ON fold = k GROUP BY k)
        SELECT round(round(avg(r2), 4), 3) AS cv_score,
          round(round(stddev_pop(r2), 4), 3) AS cv_std FROM sc""",
    ),
    "registered_models": (
        _registered,
        f"""SELECT 'linear' AS name, 'regression' AS problem_type, 'r2' AS metric,
        test_score AS score, false AS is_deployed, 'l_quantity' AS feature,
        CAST(1 AS DOUBLE) AS importance, 'target' AS target FROM ({_line_sql("linear")})""",
    ),
    "csv_codes": (
        _csv_codes,
        """SELECT p_partkey, CAST(p_partkey % 100 AS VARCHAR) ||
        CASE WHEN p_partkey % 2 = 0 THEN 'D' ELSE 'F' END AS code FROM part""",
    ),
    "csv_roundtrip": (
        _csv_roundtrip,
        """SELECT o_orderkey, o_totalprice, o_orderstatus,
        CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders""",
    ),
    "leaderboard_rank": (
        lambda s, d: rounded(lead.rank_leaderboard(_results(s, d))),
        f"""SELECT algorithm, {r("score")} AS score,
        {r("training_time_seconds")} AS training_time_seconds, algo_order,
        CAST(row_number() OVER (ORDER BY round(score, 4) DESC, algo_order) AS INTEGER) AS rank
        FROM ({RESULTS})""",
    ),
    "leaderboard_best": (
        lambda s, d: rounded(lead.best_algorithm(_results(s, d))),
        f"""SELECT algorithm AS best_algorithm, {r("score")} AS best_score FROM ({RESULTS})
        ORDER BY score DESC, algo_order LIMIT 1""",
    ),
    "leaderboard_time": (
        lambda s, d: lead.total_time(_results(s, d)),
        f"""SELECT round(sum(training_time_seconds), 2) AS total_training_time_seconds
        FROM ({RESULTS})""",
    ),
    "leaderboard_csv": (
        _board_csv,
        f"""SELECT row_number() OVER (ORDER BY round(score, 4) DESC, algo_order) AS rank,
        algorithm, algo_order FROM ({RESULTS})""",
    ),
    "normalised_shares": (
        lambda s, d: rounded(
            running_share(_results(s, d).select("algorithm", "score"), "score")
        ),
        f"""SELECT algorithm, {r("score")} AS score, {r(div("score", "sum(score) OVER ()"))} AS share
        FROM ({RESULTS})""",
    ),
    "registry_state": (
        lambda s, d: reg.current_models(_registry(s, d), "seq").withColumn(
            "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        ),
        f"""SELECT model_id, score, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
        is_deployed, CASE WHEN is_deployed THEN '{reg.ENDPOINT}' || model_id END
          AS deployment_endpoint FROM ({STATE})""",
    ),
    "running_best": (
        lambda s, d: log.running_best(
            _job_log(s, d).drop("event_type"), "user_id", ["ts", "event_id"], "value"
        ).drop("ts"),
        """SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id
        ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best_so_far FROM events""",
    ),
    "last_logs": (
        lambda s, d: log.last_logs(_job_log(s, d), "user_id", ["ts", "event_id"], 50).drop("ts"),
        """SELECT * FROM (SELECT event_id, user_id, event_type, value,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER)
          AS rnk FROM events) WHERE rnk <= 50""",
    ),
    "latest_state": (
        lambda s, d: rounded(_state(s, d).drop("created_at", "updated_at")),
        f"""SELECT user_id, status, {r("progress")} AS progress, elapsed_seconds, events
        FROM ({JOB_STATE})""",
    ),
    "job_list": (
        lambda s, d: log.job_list(_state(s, d), "user_id", status="error").select(
            "user_id", "status", "elapsed_seconds"
        ),
        f"SELECT user_id, status, elapsed_seconds FROM ({JOB_STATE}) WHERE status = 'error'",
    ),
}

