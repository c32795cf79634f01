import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabassay.operators import algorithms as alg
from tabassay.operators import modeling as mod
from tabassay.operators import registry as reg
from tabassay.operators import runlog as log
from tabassay.operators.features import LABEL
from tabassay.operators.explain import explain, model_contributions
from tabassay.plans import training as tr
from tabassay.sources.sinks import write_leaderboard
from tabassay.streaming.scoring import score_arrivals

EFFORT = alg.Effort(trees=5, rounds=3, tree_depth=4, iterations=30, kernel_width=16)


def config(**options):
    return tr.TrainingConfig(**({"cv_folds": 0, "effort": EFFORT} | options))


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = 2 * x[:, 0] - 3 * x[:, 1] + 1 + rng.normal(0, 0.5, 400)
    pdf = pd.DataFrame({"id": range(400), "x1": x[:, 0], "x2": x[:, 1], "y": y})
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=400)
    c = rng.choice(["red", "blue", None], 400)
    y = np.where(x + (c == "red") > 0.3, "yes", "no")
    pdf = pd.DataFrame({"id": range(400), "x": x, "c": c, "target": y})
    return spark.createDataFrame(pdf)


def _train_part(pdf):
    h = ((pdf["id"] * 2654435761 + 42) % 2**32) % 100
    return pdf[h >= 20]


@pytest.mark.parametrize("name,alpha", [("linear", 0.0), ("ridge", 1.0)])
def test_linear_models_equal_the_closed_form(numbers, name, alpha):
    pdf, df = numbers
    result = tr.train(df, "y", name, "regression", "id", config())
    part = _train_part(pdf)
    x = part[["x1", "x2"]].to_numpy()
    centred = x - x.mean(axis=0)
    want = np.linalg.solve(
        centred.T @ centred + alpha * np.eye(2), centred.T @ (part["y"] - part["y"].mean())
    )
    got = mod.predictor(result.model)
    assert np.allclose(got.coefficients.toArray(), want, atol=1e-6)
    assert got.intercept == pytest.approx(part["y"].mean() - x.mean(axis=0) @ want, abs=1e-6)


def test_lasso_shrinks(numbers):
    _, df = numbers
    fitted = mod.predictor(tr.train(df, "y", "lasso", "regression", "id", config()).model)
    assert 0 < fitted.coefficients[0] < 2 and -3 < fitted.coefficients[1] < 0


def test_classifier_save_load_stream_and_single_record(spark, classes, tmp_path):
    result = tr.train(classes, "target", "logistic_regression", "classification", "id", config())
    rows = classes.drop("target")
    batch = mod.predict(result.model, rows)
    chances = batch.select("probability", "prediction", "confidence").collect()
    for r in chances:
        assert sum(r["probability"].values()) == pytest.approx(1, abs=2e-4)
        assert r["confidence"] == max(r["probability"].values())
        assert r["probability"][r["prediction"]] == r["confidence"]
    result.model.save(str(tmp_path / "m"))
    again = mod.FittedModel.load(spark, str(tmp_path / "m"))
    key = ["id", "prediction", "confidence"]
    assert mod.predict(again, rows).select(key).exceptAll(batch.select(key)).isEmpty()
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    streamed = score_arrivals(
        spark, again, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"),
        str(tmp_path / "cp"), files_per_batch=1,
    )
    assert streamed.count() == 400
    assert streamed.select(key).exceptAll(batch.select(key)).isEmpty()
    # One record is encoded like the batch it came from.
    one = batch.filter("c = 'red'").first()
    alone = mod.predict(again, rows.filter(F.col("id") == one["id"])).first()
    assert alone["confidence"] == one["confidence"]
    # Unknown level and absent columns still give a prediction.
    odd = spark.createDataFrame([(1, "green")], "id bigint, c string")
    assert mod.predict(again, odd).first()["prediction"] in ("yes", "no")


@pytest.mark.parametrize("name", ["random_forest", "svm"])
def test_learners_beat_the_majority(classes, name):
    result = tr.train(classes, "target", name, "classification", "id", config(use_feature_engineering=True))
    scores = result.scores.first()
    assert scores["test_score"] > 0.75
    importance = result.feature_importance.collect()
    if name == "svm":
        assert importance == []
        assert mod.predict(result.model, classes).first()["confidence"] >= 0.5
    else:
        assert sum(r["importance"] for r in importance) == pytest.approx(1, abs=1e-3)
        assert [r["rank"] for r in importance] == list(range(1, len(importance) + 1))


def test_chances_come_from_margins_of_unseen_rows(spark):
    """Many noise features: margins of seen rows are too sure, and so would be the chances."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(360, 40))
    y = (x[:, 0] + rng.normal(0, 1.5, 360) > 0).astype(float)
    rows = [(Vectors.dense(v), float(c), k < 160) for k, (v, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, ["features", "label", "seen"]).repartition(4)
    seen = df.filter("seen").withColumnRenamed("label", LABEL).persist()
    made = LinearSVC(featuresCol="features", labelCol=LABEL, regParam=1e-4, maxIter=200)
    machine = made.fit(seen)
    plain = LogisticRegression(featuresCol="rawPrediction", labelCol=LABEL, predictionCol="c",
                               rawPredictionCol="r").fit(machine.transform(seen))

    def loss(chances):
        scored = chances.transform(machine.transform(df.filter("NOT seen")))
        p = vector_to_array(F.col("probability"))[F.col("label").cast("int")]
        return scored.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15))))).first()[0]

    ours = loss(mod.calibrated(made, seen))
    assert ours < 0.75 < loss(plain)


def test_random_search_halves_its_settings(numbers):
    _, df = numbers
    options = config(cv_folds=3, tune_hyperparameters=True, tuning_search_type="random", tuning_iterations=8)
    result = tr.train(df, "y", "ridge", "regression", "id", options)
    rows = result.tuning.collect()
    assert sorted(r["folds"] for r in rows) == [1, 1, 1, 1, 2, 2, 3, 3]
    chosen = [r for r in rows if r["chosen"]]
    assert len(chosen) == 1 and json.loads(chosen[0]["settings"]) == result.best_params
    assert chosen[0]["mean_score"] == max(r["mean_score"] for r in rows if r["folds"] == 3)
    low, high = alg.SPACES["ridge"]["regParam"][1:]
    drawn = alg.drawn_settings("ridge", 50)
    assert all(low <= s["regParam"] <= high for s in drawn) and drawn == alg.drawn_settings("ridge", 50)


def test_every_drawn_setting_sees_all_folds(classes):
    """Without halving none is dropped, and weighted rows that all share give the same scores."""
    options = config(
        cv_folds=3, tune_hyperparameters=True, tuning_search_type="random", tuning_iterations=6,
        tuning_halving=False,
    )
    result = tr.train(classes, "target", "decision_tree", "classification", "id", options)
    rows = result.tuning.collect()
    drawn = alg.drawn_settings("decision_tree", 6)
    assert [json.loads(r["settings"]) for r in rows] == drawn and {r["folds"] for r in rows} == {3}
    assert [r["mean_score"] for r in rows if r["chosen"]] == [max(r["mean_score"] for r in rows)]
    ready = tr.prepare(classes, "target", "classification", "id", options)
    recipe = tr._recipe(ready, "classification", None, options)
    alone = [
        mod._fold_score("decision_tree", recipe, *fold, drawn[0])
        for fold in mod.each_fold(ready.train, recipe, False, 3)
    ]
    assert rows[0]["mean_score"] == pytest.approx(np.mean(alone), abs=1e-4)


def test_boosted_folds_and_model_from_one_run(classes):
    """The joint run gives the scores of folds fitted one by one, and the model of all rows."""
    joint = tr.train(classes, "target", "xgboost", "classification", "id", config(cv_folds=3))
    row = joint.scores.first()
    ready = tr.prepare(classes, "target", "classification", "id", config(cv_folds=3))
    recipe = tr._recipe(ready, "classification", None, config())
    alone = [
        mod._fold_score("xgboost", recipe, *fold, None)
        for fold in mod.each_fold(ready.train, recipe, False, 3)
    ]
    assert row["cv_score"] == pytest.approx(np.mean(alone), abs=1e-4)
    single = tr.train(classes, "target", "xgboost", "classification", "id", config())
    assert single.scores.first()["test_score"] == row["test_score"]
    key = ["id", "prediction", "confidence"]
    one, two = (mod.predict(r.model, classes).select(key) for r in (joint, single))
    assert one.exceptAll(two).isEmpty()


def test_more_than_two_classes(spark):
    rng = np.random.default_rng(2)
    x = rng.random(300)
    pdf = pd.DataFrame({"id": range(300), "x": x, "target": (x * 3).astype(int)})
    df = spark.createDataFrame(pdf)
    result = tr.train(df, "target", "gradient_boosting", "classification", "id", config())
    assert result.scores.first()["test_score"] > 0.9
    row = mod.predict(result.model, df).first()
    assert set(row["probability"]) == {"0", "1", "2"}
    assert sum(row["probability"].values()) == pytest.approx(1, abs=3e-4)


def test_odd_labels(spark):
    rows = [(i, float(i % 2), 1e20 if i % 2 else (float("nan") if i % 10 == 0 else 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, x double, target double")
    result = tr.train(df, "target", "decision_tree", "classification", "id", config())
    assert result.model.classes == ["0.5", "1.0E20"]
    row = result.scores.first()
    assert row["rows_without_label"] == 20 and row["test_score"] == 1.0
    flags = df.select("id", "x", (F.col("x") > 0).alias("target"))
    assert tr.train(flags, "target", "logistic", "classification", "id", config()).model.classes == [
        "false", "true",
    ]


def test_features_may_carry_any_name(spark, numbers):
    _, df = numbers
    renamed = df.select("id", F.col("x1").alias("label"), F.col("x2").alias("features"), "y")
    result = tr.train(renamed, "y", "linear", "regression", "id", config())
    plain = tr.train(df, "y", "linear", "regression", "id", config())
    assert result.scores.first()["test_score"] == plain.scores.first()["test_score"]
    assert result.model.features == ["label", "features"]
    with pytest.raises(ValueError):
        tr.train(df.withColumnRenamed("x1", "prediction"), "y", "linear", "regression", "id", config())


def test_svr_learns(numbers):
    _, df = numbers
    scores = tr.train(df, "y", "svr", "regression", "id", config(use_feature_engineering=True)).scores.first()
    assert scores["test_score"] > 0.3


def test_unknown_names_fail_before_any_job(numbers):
    _, df = numbers
    for algorithm, kind in (("perceptron", "regression"), ("linear", "classification"), ("svm", "x")):
        with pytest.raises(ValueError):
            tr.train(df, "y", algorithm, kind, "id", config())
    with pytest.raises(ValueError):
        tr.train(df, "absent", "linear", "regression", "id", config())
    assert alg.resolve("  Ridge ", "regression") == "ridge"


def test_catalogue(spark):
    rows = alg.catalogue(spark).groupBy("problem_type").count().collect()
    assert {tuple(r) for r in rows} == {("classification", 5), ("regression", 7)}


def test_automl_keeps_failures_and_writes_its_log(spark, numbers, tmp_path, monkeypatch):
    _, df = numbers
    real = mod.fit_stages

    def broken(vectors, algorithm, *rest, **options):
        if algorithm == "lasso":
            raise RuntimeError("no luck")
        return real(vectors, algorithm, *rest, **options)

    monkeypatch.setattr(mod, "fit_stages", broken)
    run_log = log.RunLog(spark, str(tmp_path / "log"), "job-1", "automl")
    found = tr.automl(
        df, "y", "regression", "id", cv_folds=2, algorithms=["ridge", "lasso", "linear"],
        config=config(run_log=run_log),
    )
    board = {r["algorithm"]: r for r in found.leaderboard.collect()}
    assert board["lasso"]["status"] == "failed" and "no luck" in board["lasso"]["error"]
    assert sorted(r["rank"] for r in board.values() if r["rank"]) == [1, 2]
    assert found.best_algorithm in ("ridge", "linear") and found.metrics.first()["r2"] > 0.9
    write_leaderboard(found.leaderboard, str(tmp_path / "board.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "board.csv")).count() == 3
    events = spark.read.parquet(str(tmp_path / "log"))
    state = log.latest_state(events, "job_id", ["event_ts"], "status", "progress").first()
    assert (state["status"], state["progress"]) == ("completed", 100.0)
    assert log.phase_state(events).filter("phase = 'model_training'").first()["label"] == "Model Training"
    monkeypatch.setattr(mod, "fit_stages", lambda *a: 1 / 0)
    with pytest.raises(tr.NoAlgorithmSucceeded) as failure:
        tr.automl(df, "y", "regression", "id", cv_folds=2, algorithms=["ridge"], config=config())
    assert failure.value.leaderboard.first()["status"] == "failed"


def test_tuning_and_feature_options(numbers):
    _, df = numbers
    result = tr.train(
        df, "y", "decision_tree", "regression", "id",
        config(cv_folds=2, tune_hyperparameters=True, tuning_search_type="random", tuning_iterations=2,
               polynomial_degree=2, n_features=3),
    )
    assert set(result.best_params) == set(alg.SPACES["decision_tree"])
    assert result.scores.first()["n_features"] == 3
    assert result.scores.first()["cv_score"] is not None


def test_rows_without_label_are_counted(numbers):
    _, df = numbers
    holes = df.withColumn("y", F.when(F.col("id") % 10 != 0, F.col("y")))
    row = tr.train(holes, "y", "linear", "regression", "id", config()).scores.first()
    assert row["rows_without_label"] == 40 and row["train_size"] + row["test_size"] == 360


def test_contributions_add_up(numbers):
    pdf, df = numbers
    result = tr.train(df, "y", "linear", "regression", "id", config())
    predictions, importance = explain(result.model, df)
    total = model_contributions(result.model, df, "id").groupBy("row_key").agg(F.sum("contribution").alias("s"))
    got = {r["row_key"]: r["s"] for r in total.collect()}
    said = {r["id"]: r["prediction"] for r in predictions.collect()}
    mean = np.mean(list(said.values()))
    assert all(said[k] - mean == pytest.approx(got[k], abs=1e-8) for k in said)
    assert importance.count() == 2


def test_registry(spark, tmp_path):
    path = str(tmp_path / "models")
    reg.append_event(spark, path, "m1", "register", name="first", score=0.5, algorithm="ridge")
    reg.append_event(spark, path, "m2", "register", name="second")
    reg.append_event(spark, path, "m1", "deploy")
    events = spark.read.parquet(path)
    one = reg.get_model(events, "m1").first()
    assert one["is_deployed"] and one["score"] == 0.5
    assert one["deployment_endpoint"] == "/api/predictions/realtime/m1"
    reg.append_event(spark, path, "m1", "undeploy")
    rows = {r["model_id"]: r for r in reg.list_models(spark.read.parquet(path)).collect()}
    assert not rows["m1"]["is_deployed"] and rows["m2"]["total"] == 2
    with pytest.raises(ValueError):
        reg.get_model(events, "zz")
    with pytest.raises(ValueError):
        reg.append_event(spark, path, "m1", "deploy", colour="red")
    importance = spark.createDataFrame([(1, "x", 0.9)], mod.IMPORTANCE_SCHEMA)
    reg.save_importance(importance, "m1", str(tmp_path / "imp"))
    assert reg.importance_of(spark.read.parquet(str(tmp_path / "imp")), "m1").count() == 1


def test_running_best_of_a_hot_job(spark):
    rows = [(i, "hot" if i % 10 else "cold", (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "seq bigint, job string, score int")
    got = {r["seq"]: r["best_so_far"] for r in log.running_best(df, "job", ["seq"], "score", rows_per_chunk=40).collect()}
    best: dict = {}
    for seq, job, score in rows:
        best[job] = max(best.get(job, -1), score)
        assert got[seq] == best[job]


def test_training_rows_of_one_task_are_dealt_out(spark):
    rows = spark.range(60_000, numPartitions=1).select(
        "id", F.rand(1).alias("x"), (F.col("id") % 2).alias("target")
    )
    ready = tr.prepare(rows, "target", "classification", "id", config(cv_folds=3))
    tasks = ready.train.select(F.spark_partition_id()).distinct().count()
    assert tasks == 3
    assert ready.train.count() == ready.train_size == 60_000 - ready.test.count()
    ready.let_go()
    few = tr.prepare(rows.limit(500), "target", "classification", "id", config(cv_folds=3))
    assert few.kept is None
