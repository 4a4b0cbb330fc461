"""Fits recover known coefficients; effects lie between area and ward; draws follow their rate."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions.stats import normal_cdf, normal_quantile, uniform
from tesserae.operators import features, irls, model


def simulated(spark, n=4000):
    rows = spark.range(n).select(
        (F.col("id") % 50).alias("area"), F.add_months(F.lit("2000-01-01").cast("date"), F.floor(F.col("id") / 50).cast("int")).alias("month"),
        (uniform(F.col("id"), "a") - 0.5).alias("a"), (uniform(F.col("id"), "b") - 0.5).alias("b"),
    )
    rate = F.exp(0.7 + 1.5 * F.col("a") - 0.8 * F.col("b"))
    drawn = model.draw_counts(rows.withColumn("rate", rate), 1, seed=5).select("area", "month", F.col("value").alias("n"))
    return rows.join(drawn, ["area", "month"])


def test_recovers_coefficients(spark):
    fit = model.fit_rate(simulated(spark), ["a", "b"], scale=False)
    for got, want, e in zip([*fit.coefficients, fit.intercept], [1.5, -0.8, 0.7], fit.errors, strict=True):
        assert abs(got - want) < 4 * e
    out = model.coef_summary(spark, fit, {"g": ["a", "b"]})
    assert {r["column"] for r in model.significant(out).collect()} == {"a", "b"}


def test_draws_have_the_rate(spark):
    rates = spark.range(1).select(F.col("id").alias("area"), F.lit("2000-01-01").cast("date").alias("month"), F.lit(3.0).alias("rate"))
    row = model.draw_counts(rates, 4000).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).first()
    assert abs(row["m"] - 3) < 0.15 and abs(row["v"] - 3) < 0.3


def test_shrinkage_lies_between(spark):
    rows = spark.createDataFrame([("a", "w", 30.0, 10.0), ("b", "w", 10.0, 10.0), ("c", "v", 10.0, 10.0)], "area string, ward string, n double, mu double")
    out = {r["area"]: r for r in model.pooled_effects(rows, 10.0).collect()}
    assert out["a"]["ward_effect"] < out["a"]["effect"] < 3 and 1 < out["b"]["effect"] < out["b"]["ward_effect"] and out["c"]["effect"] == 1


def test_normal(spark):
    row = spark.range(1).select(normal_cdf(F.lit(1.0)), normal_quantile(F.lit(0.975))).first()
    assert abs(row[0] - 0.5 * (1 + math.erf(1 / math.sqrt(2)))) < 1e-6 and abs(row[1] - 1.959964) < 1e-4


def test_normal_quantile_in_the_tails(spark):
    from statistics import NormalDist

    us = [1e-6, 1e-4, 0.0005, 0.02, 0.02425, 0.3, 0.5, 0.7, 0.98, 0.998, 0.999, 1 - 1e-6]
    for r in spark.createDataFrame([(u,) for u in us], "u double").select("u", normal_quantile(F.col("u")).alias("z")).collect():
        assert abs(r["z"] - NormalDist().inv_cdf(r["u"])) < 1e-7


def test_summary_means_are_the_coefficients(spark):
    fit = model.RateModel(["a", "b"], [-0.8, 0.02], 0.0, [0.05, 0.05])
    out = {r["column"]: r for r in model.coef_summary(spark, fit, {"g": ["a", "b"]}).collect()}
    assert abs(out["a"]["mean"] + 0.8) < 0.02 and abs(out["a"]["low"] + 0.898) < 0.03 and out["a"]["significant"]
    assert abs(out["b"]["mean"] - 0.02) < 0.02 and not out["b"]["significant"]


def test_counts_of_any_rate(spark):
    rows = spark.createDataFrame([(float(r),) for r in (0.0, 0.1, 46, 150, 900, 5000)], "rate double").withColumn("area", F.col("rate")).withColumn("month", F.lit("2000-01-01").cast("date"))
    for r in model.draw_counts(rows, 3000).groupBy("area").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).collect():
        assert abs(r["m"] - r["area"]) <= 5 * math.sqrt(r["area"] / 3000) and abs(r["v"] - r["area"]) <= 0.15 * r["area"] + 0.01


def test_predictive_draws_are_wider_than_draws_of_one_rate(spark):
    rows = spark.range(400).select(F.col("id").alias("area"), F.lit("2000-01-01").cast("date").alias("month"), F.lit(1.0).alias("a"))
    fit = model.RateModel(["a"], [2.0], 0.0, [0.3])
    effects = rows.select("area", F.lit(1.5).alias("effect"), F.lit(0.2).alias("spread"))
    out = model.predictive_draws(rows, fit, 100, effects)
    row = out.agg(F.avg(F.log("rate")).alias("m"), F.stddev("rate").alias("s"), F.max("rate").alias("top")).first()
    assert abs(row["m"] - 2 - math.log(1.5)) < 0.1 and row["s"] > 2.5 and row["top"] <= math.exp(4) + 1e-9
    rate = model.predict_rate(rows, model.RateModel(["a"], [5.0], 0.0), effects).first()["rate"]
    assert abs(rate - math.exp(4)) < 1e-9  # the effect is inside the clamp


def test_strength_by_moments(spark):
    even = spark.createDataFrame([(i, i % 4, 10.0, 10.0) for i in range(40)], "area long, ward long, n double, mu double")
    assert all(abs(r["effect"] - 1) < 1e-3 for r in model.pooled_effects(even).collect())
    apart = spark.createDataFrame([(i, i % 4, 100.0 * (1 + i % 3), 100.0) for i in range(40)], "area long, ward long, n double, mu double")
    assert all(abs(r["effect"] - (1 + r["area"] % 3)) < 0.2 for r in model.pooled_effects(apart).collect())


def test_selection(spark):
    rows = simulated(spark, 1000)
    train, val = rows.where("month < '2001-06-01'"), rows.where("month >= '2001-06-01'")
    assert model.select_forward(train, val, ["a", "b"], 1).first()["column"] == "a"
    assert model.select_by_corr(rows, {"g": ["a", "b"]}, 1).first()["column"] == "a"
    assert model.grid_search(train, val, ["a", "b"], [0.0, 10.0]).first()["reg"] == 0.0


def confounded(spark, n=6000):
    """Areas whose effects go with the column a."""
    rows = spark.range(n).select((F.col("id") % 60).alias("area"), F.add_months(F.lit("2000-01-01").cast("date"), F.floor(F.col("id") / 60).cast("int")).alias("month"), "id")
    rows = rows.withColumn("e", (uniform(F.col("area"), "e") - 0.5) * 2).withColumns({"a": F.col("e") * 0.8 + (uniform(F.col("id"), "a") - 0.5) * 1.2, "b": uniform(F.col("id"), "b") - 0.5})
    rate = F.exp(0.7 + 0.5 * F.col("a") - 0.8 * F.col("b") + F.col("e"))
    drawn = model.draw_counts(rows.withColumn("rate", rate), 1, seed=5).select("area", "month", F.col("value").alias("n"))
    return rows.join(drawn, ["area", "month"])


def test_joint_fit_tells_areas_from_columns(spark):
    rows = confounded(spark).persist()
    alone = model.fit_rate(rows, ["a", "b"], scale=False)
    assert abs(alone.coefficients[0] - 0.5) > 0.5  # without effects, the column takes what is the areas'
    fit, effects = model.fit_joint(rows, ["a", "b"], rows.select("area", (F.col("area") % 6).alias("ward")).distinct())
    for c, b, want in zip(fit.cols, fit.coefficients, (0.5, -0.8), strict=True):
        assert abs(b / fit.scaler[c][1] - want) < 0.08
    row = effects.join(rows.select("area", "e").distinct(), "area").agg(F.corr(F.log("effect"), "e").alias("r"), F.count(F.lit(1)).alias("n")).first()
    assert row["n"] == 60 and row["r"] > 0.97


def test_batched_fits_are_single_fits(spark):
    """Settings, columns and months together give what each gives alone, and what the library's own regression gives."""
    rows = simulated(spark, 2000).persist()
    late = rows.agg(F.max(irls.month_number())).first()[0] - 5
    x = irls.matrix(rows, ["a", "b"], t=irls.month_number())
    settings = [([0, 1], 0.0, "log", None), ([0], 0.1, "log", None), ([0, 1], 0.01, "log", late), ([1], 0.5, "sqrt", None), ([0, 1], 0.0, "sqrt", late)]
    together = irls.fit(x, [irls.Problem(*s) for s in settings])
    for s, p in zip(settings, together, strict=True):
        (alone,) = irls.fit(x, [irls.Problem(*s)])
        assert p.settled and np.allclose(alone.beta, p.beta, atol=1e-8)
    for (own, reg, link, before), p in zip(settings, together, strict=True):
        if link == "log":
            names = [["a", "b"][i] for i in own]
            glm = model.fit_rate(rows if before is None else rows.where(irls.month_number() < before), names, reg)
            assert np.allclose([*glm.coefficients, glm.intercept], p.beta, atol=2e-4)
            if not reg:
                assert np.allclose(glm.errors, np.sqrt(np.diag(p.covariance)), rtol=1e-3)


def test_collinear_columns_and_empty_batches(spark):
    rows = simulated(spark, 500).withColumns({"c": F.col("a") * 2, "one": F.lit(3.0)})
    fit = irls.fit(irls.matrix(rows.repartition(40), ["a", "c", "one"]), [irls.Problem([0, 1, 2]), irls.Problem([0])])
    assert abs(fit[0].plain()[0] + 2 * fit[0].plain()[1] - fit[1].plain()[0]) < 1e-6 and abs(fit[0].beta[2]) < 1e-9
    with pytest.raises(ValueError):
        irls.fit(irls.matrix(rows.where("false"), ["a"]), [irls.Problem([0])])


def test_draws_have_the_fitted_covariance(spark):
    rows = simulated(spark, 1500).withColumn("c", F.col("a") + 0.1 * F.col("b"))
    fit = model.fit_rate(rows, ["a", "c"], scale=False)
    wanted = fit.covariance[0, 1] / math.sqrt(fit.covariance[0, 0] * fit.covariance[1, 1])
    assert wanted < -0.95  # the columns are nearly the same
    out = model.coefficient_draws(spark, fit, 3000)
    row = out.agg(F.corr("a", "c").alias("r"), F.stddev("a").alias("s"), F.avg("c").alias("m")).first()
    assert abs(row["r"] - wanted) < 0.01 and abs(row["s"] / math.sqrt(fit.covariance[0, 0]) - 1) < 0.06
    assert abs(row["m"] - fit.coefficients[1]) < 4 * math.sqrt(fit.covariance[1, 1] / 3000)
    flat = model.RateModel(["a", "c"], [1.0, 2.0], 0.0, covariance=np.array([[1.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0]]))
    row = model.coefficient_draws(spark, flat, 500).agg(F.corr("a", "c").alias("r"), F.stddev("intercept").alias("s")).first()
    assert row["r"] > 1 - 1e-9 and row["s"] == 0


def test_intervals_are_the_closed_form(spark):
    rows = simulated(spark, 2000)
    fit = model.fit_rate(rows, ["a", "b"], scale=False)
    for r in model.coef_summary(spark, fit, {"g": ["a", "b"]}, draws=3000).collect():
        k = fit.cols.index(r["column"])
        assert abs((r["high"] - r["low"]) / (2 * 1.96 * fit.errors[k]) - 1) < 0.08


def test_settings_folds_and_choices(spark):
    rows = simulated(spark, 2500).withColumns({f"u{k}": uniform(F.col("area"), F.col("month"), k) for k in range(6)}).persist()
    cols = ["u0", "u1", "a", "u2", "b", "u3", "u4", "u5"]
    train, val = features.split_last_n(rows, 10)
    out = model.grid_search(train, val, cols, [0.0, 0.1, 10.0], ["log", "sqrt"]).collect()
    assert len(out) == 6 and out[0]["reg"] < 10 and [r["loss"] for r in out] == sorted(r["loss"] for r in out)
    assert [r["column"] for r in model.select_forward(train, val, cols, 2).collect()] == ["a", "b"]
    assert [r["column"] for r in model.select_projection(train, cols, 2).collect()] == ["a", "b"]
    wards = rows.select("area", (F.col("area") % 5).alias("ward")).distinct()
    folds = {r["fold"]: r for r in model.cross_validate(rows, ["a", "b"], 3, draws=60, wards=wards).collect()}
    assert sorted(folds) == [0, 1, 2, 3] and abs(sum(folds[k]["rmse"] for k in (1, 2, 3)) / 3 - folds[0]["rmse"]) < 1e-9
    assert all(0.5 < folds[k]["rmse"] < 3 and 0 < folds[k]["crps"] < folds[k]["mae"] * 1.2 for k in folds)


def test_significant_columns(spark):
    """M13 on planted effects: the columns with one, and no other."""
    rows = simulated(spark).withColumns({"u": uniform(F.col("area"), F.col("month"), "u"), "v": uniform(F.col("area"), F.col("month"), "v")})
    fit = model.fit_rate(rows, ["a", "u", "b", "v"])
    assert {r["column"] for r in model.significant(model.coef_summary(spark, fit, {"g": fit.cols}, 0.01)).collect()} == {"a", "b"}


def test_rounds_of_the_joint_fit_take_few_tasks(spark):
    """Some tables of a few areas each round: their tasks go with their rows, not with the partitions that a shuffle may have."""
    rows, sc = confounded(spark).persist(), spark.sparkContext
    wards = rows.select("area", (F.col("area") % 6).alias("ward")).distinct()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    sc.setJobGroup("joint-fit", "joint-fit")
    try:
        model.fit_joint(rows, ["a", "b"], wards)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {i for j in tracker.getJobIdsForGroup("joint-fit") for i in tracker.getJobInfo(j).stageIds}
    ran = [t.numCompletedTasks for t in map(tracker.getStageInfo, stages) if t]
    print(len(ran), sum(ran))
    assert sum(ran) <= 10 * len(ran)
