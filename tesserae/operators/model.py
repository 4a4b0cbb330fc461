"""Count models (M8-M20): Poisson log-linear rates, pooled area effects, draws as rows, selection of features.

Settings, folds and candidate columns are fitted together, a scan for all of them at each step (tesserae.operators.irls);
the driver solves systems as large as a model has columns and never loops over rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import UnsupportedOperationException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.clean import rate_of
from tesserae.functions.stats import normal_cdf, normal_pdf, normal_quantile, poisson_quantile, uniform
from tesserae.operators import evaluate, irls
from tesserae.operators.aggregate import target_corr
from tesserae.operators.clean import interact
from tesserae.operators.features import apply_scaler, fit_scaler
from tesserae.sources.shared import materialise

#: The strength of pooling where counts vary no more than by chance.
STRONG = 1e6
#: Rounds of the joint fit at most, the largest change of a coefficient at which it has settled, and rounds that it looks back on.
JOINT_ROUNDS, SETTLED, BACK = 40, 1e-5, 5


@dataclass
class RateModel:
    """Coefficients of scaled columns, an intercept and, where the fit gives them, their standard errors (the intercept's may
    follow) and the covariance of all of them, the intercept last."""

    cols: list[str]
    coefficients: list[float]
    intercept: float
    errors: list[float] | None = None
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    covariance: np.ndarray | None = None

    def factor(self) -> np.ndarray:
        """L with L L' = covariance, columns and intercept; of the standard errors alone where that is all there is. Directions
        without variance stay so."""
        if self.covariance is None:
            return np.diag([*(self.errors or [0.0] * len(self.cols)), 0.0][: len(self.cols) + 1])
        try:
            return np.linalg.cholesky(self.covariance)
        except np.linalg.LinAlgError:
            values, vectors = np.linalg.eigh(self.covariance)
            return vectors * np.sqrt(np.maximum(values, 0))

    def log_rate(self) -> Column:
        out = F.lit(self.intercept)
        for c, b in zip(self.cols, self.coefficients, strict=True):
            out = out + F.col(c) * F.lit(b)
        return out


def fit_rate(df: DataFrame, cols: list[str], reg: float = 0.0, y: str = "n", scale: bool = True) -> RateModel:
    """M8. Poisson log-linear rate; a small reg is needed where columns are collinear."""
    stats = fit_scaler(df, cols) if scale else {}
    rows = apply_scaler(df, stats).select(*(F.col(c).cast("double").alias(c) for c in cols), F.col(y).cast("double").alias("_y")) if cols else df.select(F.col(y).cast("double").alias("_y"))
    if not cols:
        mean = rows.agg(F.avg("_y")).first()[0] or 0.0
        return RateModel([], [], math.log(max(mean, 1e-9)))
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol="_y", featuresCol="_x", regParam=reg, maxIter=50)
    model = glm.fit(VectorAssembler(inputCols=cols, outputCol="_x").transform(rows))
    try:
        errors = [float(e) for e in model.summary.coefficientStandardErrors]
    except (UnsupportedOperationException, Py4JJavaError) as e:  # there are none where the normal equations are singular or another solver was used
        if "tandard error" not in str(e) and "ingular" not in str(e):
            raise
        errors = None
    own = irls.Problem(list(range(len(cols))), reg, beta=np.array([*model.coefficients, model.intercept]), mean=np.zeros(len(cols)), std=np.ones(len(cols)))
    irls.fit(irls.matrix(rows, cols, "_y"), [own], rounds=1)
    return RateModel(list(cols), [float(b) for b in model.coefficients], float(model.intercept), errors, stats, own.covariance)


def _as_model(cols: list[str], p: irls.Problem) -> RateModel:
    own = [cols[i] for i in p.cols]
    scaler = {c: (float(m), float(v)) for c, m, v in zip(own, p.mean, p.std, strict=True)}
    return RateModel(own, [float(b) for b in p.beta[:-1]], float(p.beta[-1]), [float(e) for e in np.sqrt(np.maximum(np.diag(p.covariance)[:-1], 0))], scaler, p.covariance)


def _strength(seen: Column, expected: Column) -> Column:
    """By moments: counts about their expectation vary by it and its square over the strength. An aggregate."""
    beyond = F.sum(F.pow(seen - expected, 2) - expected)
    return F.when(beyond > 0, F.least(F.lit(STRONG), F.sum(expected * expected) / beyond)).otherwise(STRONG)


def pooled_effects(df: DataFrame, strength: float | None = None, y: str = "n", mu: str = "mu", by: tuple[str, ...] = ()) -> DataFrame:
    """M9. area, ward, ward_effect, effect, spread: multipliers of the rate, shrunk from areas to wards and from wards to 1, and the
    deviation of the effect's logarithm. Without a strength, both are estimated: one for wards, one per ward for its areas.
    by: columns that tell apart frames of their own."""
    by = list(by)
    areas = df.groupBy(*by, "area", "ward").agg(F.sum(y).cast("double").alias("_y"), F.sum(mu).cast("double").alias("_mu"))
    wards = areas.groupBy(*by, "ward").agg(F.sum("_y").alias("_wy"), F.sum("_mu").alias("_wmu"))
    given = F.lit(float(strength)) if strength is not None else None
    overall = wards.groupBy(*by).agg((_strength(F.col("_wy"), F.col("_wmu")) if given is None else F.first(given)).alias("_k"))
    wards = wards.join(overall, by) if by else wards.crossJoin(overall)  # one row
    wards = wards.select(*by, "ward", "_wy", "_wmu", ((F.col("_wy") + F.col("_k")) / (F.col("_wmu") + F.col("_k"))).alias("ward_effect"))
    inside = areas.join(wards, [*by, "ward"])
    own = inside.groupBy(*by, "ward").agg((_strength(F.col("_y"), F.col("_mu") * F.col("_wy") / F.col("_wmu")) if given is None else F.first(given)).alias("_k"))
    shape, rate = F.col("_y") + F.col("_k") * F.col("ward_effect"), F.col("_mu") + F.col("_k")
    return inside.join(own, [*by, "ward"]).select(*by, "area", "ward", "ward_effect", (shape / rate).alias("effect"), (1 / F.sqrt(shape)).alias("spread"))


def _linear(b: np.ndarray, x: Column) -> Column:
    """The linear predictor of unscaled columns in an array, the intercept last in b."""
    out = F.lit(float(b[-1]))
    for i, v in enumerate(b[:-1]):
        out = out + F.get(x, i) * F.lit(float(v))
    return out


def _ahead(seen: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Where the steps (point, step from it) of an iteration are heading: the mix of the last points whose steps cancel best (Anderson's method)."""
    x, f = seen[-1]
    if len(seen) == 1:
        return x + f
    dx, df = (np.stack([b[k] - a[k] for a, b in zip(seen, seen[1:], strict=False)], axis=1) for k in (0, 1))
    mix = np.linalg.lstsq(df, f, rcond=1e-10)[0]
    return x + f - (dx + df) @ mix


def fit_joint(df: DataFrame, cols: list[str], wards: DataFrame, reg: float = 0.0, strength: float | None = None, y: str = "n") -> tuple[RateModel, DataFrame]:
    """M8 and M9 together: the model and the areas' effects. wards: (area, ward). A round takes the effects from the rates without
    them, and then one step of the regression with the effects' logarithms as an offset, until a step changes nothing. Effects
    and columns that go together share what they explain, instead of all of it going to the columns. Areas' sums and effects are
    written each round, so that a round has as few tasks as its tables need; a kept plan has as many as a shuffle may have."""
    rows = irls.matrix(df, cols, y, None, None, "area").drop("offset").persist()
    ward_of = materialise(wards.select("area", "ward").distinct(), "wards")

    def effects_of(b: np.ndarray) -> DataFrame:
        rated = rows.select("area", "y", F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), _linear(b, F.col("x"))))).alias("mu"))
        sums = materialise(rated.groupBy("area").agg(F.sum("y").alias("y"), F.sum("mu").alias("mu")).join(ward_of, "area"), "area-sums")
        pooled = materialise(pooled_effects(sums, strength, "y"), "pooled-effects")
        # the level of all is the intercept's: else each of many intercepts would have effects to go with it
        level = pooled.join(sums.select("area", "mu"), "area").agg(F.sum(F.col("effect") * F.col("mu")) / F.sum("mu")).first()[0] or 1.0
        return pooled.withColumns({k: F.col(k) / F.lit(level) for k in ("effect", "ward_effect")})

    try:
        own = irls.Problem(list(range(len(cols))), reg)
        irls.fit(rows.withColumn("offset", F.lit(0.0)), [own], rounds=4)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(JOINT_ROUNDS):
            at = own.beta
            known = effects_of(own.plain()).select("area", F.log("effect").alias("offset"))
            irls.fit(rows.join(known, "area", "left").withColumn("offset", F.coalesce("offset", F.lit(0.0))), [own], rounds=1)
            step = own.beta - at
            if np.max(np.abs(step)) <= SETTLED * (1 + np.max(np.abs(at))):
                break
            if seen and np.linalg.norm(step) > 2 * np.linalg.norm(seen[-1][1]):
                seen = []  # looking ahead went wrong: begin again from here
            seen = [*seen[-BACK:], (at, step)]
            own.beta = _ahead(seen)
        return _as_model(cols, own), materialise(effects_of(own.plain()), "area-effects")
    finally:
        rows.unpersist()


def predict_rate(df: DataFrame, model: RateModel, effects: DataFrame | None = None) -> DataFrame:
    """M10. Adds rate: exp of the clamped log rate, to which the area's effect adds its logarithm where there is one."""
    rows = apply_scaler(df, model.scaler).select("area", "month", model.log_rate().alias("_log"))
    if effects is not None:
        rows = rows.join(effects.select("area", F.log("effect").alias("_effect")), "area", "left").withColumn("_log", F.col("_log") + F.coalesce("_effect", F.lit(0.0)))
    return df.join(rows.select("area", "month", rate_of(F.col("_log")).alias("rate")), ["area", "month"])


def draw_counts(rates: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """M11. area, month, draw, value: counts drawn from each cell's rate, the same in every run and engine."""
    rows = rates.select("area", "month", "rate", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = uniform(F.col("area"), F.date_format("month", "yyyy-MM-dd"), F.col("draw"), *([seed] if seed else []))
    return rows.select("area", "month", "draw", poisson_quantile(u, F.col("rate")).alias("value"))


def _normal(*keys) -> Column:
    return normal_quantile(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), uniform(*keys))))


def coefficient_draws(spark, model: RateModel, draws: int, seed: int = 0) -> DataFrame:
    """draw and a column for each coefficient and `intercept`: normal about the fitted ones with their covariance."""
    names = [*model.cols, "intercept"]
    one = spark.range(1, draws + 1).select(F.col("id").cast("int").alias("draw"))
    z = [_normal(F.lit(c), F.col("draw"), *([seed] if seed else [])).alias(f"_z{k}") for k, c in enumerate(names)]
    lower, values = model.factor(), []
    for k, (c, b) in enumerate(zip(names, [*model.coefficients, model.intercept], strict=True)):
        own = F.lit(float(b))
        for m in np.flatnonzero(lower[k]).tolist():
            own = own + F.col(f"_z{m}") * F.lit(float(lower[k, m]))
        values.append(own.alias(c))
    return one.select("draw", *z).select("draw", *values)


def _standard_draws(spark, cols: list[str], draws: int, seed: int = 0) -> np.ndarray:
    """The standard normals behind coefficient_draws, draws x columns and intercept."""
    unit = RateModel(cols, [0.0] * len(cols), 0.0, covariance=np.eye(len(cols) + 1))
    rows = coefficient_draws(spark, unit, draws, seed).orderBy("draw").drop("draw").collect()
    return np.array([list(r) for r in rows])


def _counts(rows: DataFrame, log: Column, effects: DataFrame | None, on: list[str], seed: int) -> DataFrame:
    """Adds rate and value: the clamped rate of log, to which a drawn effect of the area adds its logarithm, and a count of that rate."""
    if effects is not None:
        rows = rows.join(effects.select(*on, "effect", "spread"), on, "left")
        log = log + F.coalesce(F.log("effect") + F.col("spread") * _normal(F.lit("effect"), F.col("area"), F.col("draw"), seed), F.lit(0.0))
    u = uniform(F.col("area"), F.date_format("month", "yyyy-MM-dd"), F.col("draw"), *([seed] if seed else []))
    return rows.withColumns({"rate": rate_of(log), "_u": u}).withColumn("value", poisson_quantile(F.col("_u"), F.col("rate"))).drop("_u")


def predictive_draws(df: DataFrame, model: RateModel, draws: int, effects: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """M11. area, month, draw, rate, value: each draw has its own coefficients (normal about the fitted ones, with their
    covariance) and area effects (log-normal with the effect's spread), the clamped rate of these, and a count of that rate."""
    one = coefficient_draws(df.sparkSession, model, draws, seed)
    one = one.select("draw", *(F.col(c).alias(f"_b{k}") for k, c in enumerate([*model.cols, "intercept"])))
    scaled = apply_scaler(df, model.scaler).select("area", "month", *(F.col(c).alias(f"_x{k}") for k, c in enumerate(model.cols)))
    rows = scaled.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).join(F.broadcast(one), "draw")  # one row per draw
    log = F.col(f"_b{len(model.cols)}")
    for k in range(len(model.cols)):
        log = log + F.col(f"_x{k}") * F.col(f"_b{k}")
    return _counts(rows, log, effects, ["area"], seed).select("area", "month", "draw", "rate", "value")


def coef_summary(spark, model: RateModel, groups: dict[str, list[str]], alpha: float = 0.05, draws: int = 200) -> DataFrame:
    """M12. grp, column, mean, low, high, p (two-sided tail share of draws), significant; sorted."""
    if model.errors is None and model.covariance is None:
        raise ValueError("the fit has no standard errors; use a positive reg")
    of = F.create_map(*(F.lit(x) for g, cols in groups.items() for c in cols for x in (c, g)))
    drawn = coefficient_draws(spark, model, draws).unpivot(["draw"], list(model.cols), "column", "v").withColumn("grp", F.coalesce(F.try_element_at(of, F.col("column")), F.lit("")))
    out = drawn.groupBy("grp", "column").agg(
        F.avg("v").alias("mean"), F.percentile("v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"), (2 * F.least(F.avg((F.col("v") > 0).cast("int")), F.avg((F.col("v") < 0).cast("int")))).alias("p")
    )
    return out.select("grp", "column", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p", (F.col("p") < alpha).alias("significant")).orderBy("p", "column")


def significant(summary: DataFrame) -> DataFrame:
    """M13."""
    return summary.where("significant")


def grid_search(train: DataFrame, val: DataFrame, cols: list[str], regs: Sequence[float], links: Sequence[str] = ("log",)) -> DataFrame:
    """M14. reg, link, loss (mean Poisson deviance on val) of all pairs of settings, the best first; all fitted together."""
    settings = [(float(r), link) for link in links for r in regs]
    rows = irls.matrix(train, cols).persist()
    try:
        found = irls.fit(rows, [irls.Problem(list(range(len(cols))), r, link) for r, link in settings])
    finally:
        rows.unpersist()
    loss = irls.losses(irls.matrix(val, cols), found)
    out = [(r, link, float(v[2] / v[0])) for (r, link), v in zip(settings, loss, strict=True)]
    return train.sparkSession.createDataFrame(out, "reg double, link string, loss double").orderBy("loss", "reg", "link")


def train_eval(train: DataFrame, test: DataFrame, cols: list[str], reg: float = 0.01, draws: int = 50, wards: DataFrame | None = None) -> DataFrame:
    """M16. One row: rmse, mae, crps of the draws on test; with wards (area, ward), area effects are fitted jointly."""
    model, effects = (fit_rate(train, cols, reg), None) if wards is None else fit_joint(train, cols, wards, reg)
    drawn = predictive_draws(test, model, draws, effects).select("area", "month", "draw", "value")
    observed = test.select("area", "month", "n")
    return evaluate.rmse(drawn, observed).crossJoin(evaluate.mae(drawn, observed)).crossJoin(evaluate.crps(drawn, observed))  # one row each


def cross_validate(df: DataFrame, cols: list[str], n: int, reg: float = 0.01, draws: int = 50, wards: DataFrame | None = None) -> DataFrame:
    """M15. fold, rmse, mae, crps of the last n months, each with all months before it; fold 0 holds the means. All folds are fitted
    together; with wards, each fold has effects of its own from the rates of its fit, as pooled_effects has them."""
    spark, last = df.sparkSession, df.agg(F.max(irls.month_number())).first()[0]
    cuts = list(range(last - n + 1, last + 1))
    rows = irls.matrix(df, cols, "n", irls.month_number(), None, "area", "month").persist()
    try:
        found = irls.fit(rows, [irls.Problem(list(range(len(cols))), reg, before=c) for c in cuts])
        models = [_as_model(cols, p) for p in found]
        effects = None
        if wards is not None:
            rated = F.array(*(F.struct(F.lit(c).alias("fold"), F.when(F.col("t") < c, F.exp(_linear(p.plain(), F.col("x")))).alias("mu")) for c, p in zip(cuts, found, strict=True)))
            sums = rows.select("area", "y", F.explode(rated).alias("r")).where("r.mu is not null").groupBy("area", "r.fold").agg(F.sum("y").alias("y"), F.sum("r.mu").alias("mu"))
            effects = pooled_effects(sums.join(wards.select("area", "ward"), "area"), None, "y", by=("fold",))
        z = _standard_draws(spark, cols, draws)
        drawn = []
        for c, m, p in zip(cuts, models, found, strict=True):
            b = p.beta + z @ m.factor().T
            plain = b[:, :-1] / p.std
            drawn += [(c, d + 1, plain[d].tolist(), float(b[d, -1] - plain[d] @ p.mean)) for d in range(draws)]
        drawn = spark.createDataFrame(drawn, "fold int, draw int, b array<double>, b0 double")
        test = rows.where(F.col("t") >= cuts[0]).select("area", "month", F.col("t").cast("int").alias("fold"), "x", "y")
        log = F.col("b0") + F.aggregate(F.zip_with("x", "b", lambda x, b: x * b), F.lit(0.0), lambda acc, v: acc + v)
        counts = _counts(test.join(F.broadcast(drawn), "fold"), log, effects, ["fold", "area"], 0)
        cells = counts.groupBy("fold", "area", "month").agg(
            F.first("y").alias("y"), F.avg("value").alias("m"), F.greatest(F.stddev_samp("value"), F.lit(1e-6)).alias("s"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median")
        )
        z, off = (F.col("y") - F.col("m")) / F.col("s"), F.col("median") - F.col("y")
        score = F.col("s") * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / F.sqrt(F.pi()))
        folds = cells.groupBy((F.col("fold") - cuts[0] + 1).alias("fold")).agg(F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"), F.avg(score).alias("crps"))
        folds = materialise(folds, "folds")
    finally:
        rows.unpersist()
    means = folds.agg(F.lit(0).alias("fold"), *(F.avg(k).alias(k) for k in ("rmse", "mae", "crps")))
    return means.unionByName(folds).orderBy("fold")


def _greedy(n: int, cap: int, scores) -> list[tuple[int, int, float]]:
    """Adds, step by step, the column with the least score while that falls; scores: of all candidates of a step at once."""
    chosen: list[int] = []
    path: list[tuple[int, int, float]] = []
    best = float("inf")
    while len(chosen) < min(cap, n):
        left = [c for c in range(n) if c not in chosen]
        value, col = min(zip(scores([[*chosen, c] for c in left]), left, strict=True))
        if value >= best:
            break
        best = value
        chosen.append(col)
        path.append((len(chosen), col, float(value)))
    return path


def select_forward(train: DataFrame, val: DataFrame, cols: list[str], cap: int, reg: float = 0.01) -> DataFrame:
    """M17. step, column, rmse on val: greedy, until nothing gets better or cap columns are chosen. All candidates of a step are
    fitted together, and scored together."""
    rows, held_out = irls.matrix(train, cols).persist(), irls.matrix(val, cols).persist()
    try:
        whole = irls.Problem(list(range(len(cols))))
        irls.scale(rows, [whole])

        def scores(candidates: list[list[int]]) -> list[float]:
            found = irls.fit(rows, [irls.Problem(own, reg, mean=whole.mean[own], std=whole.std[own]) for own in candidates])
            return [float(np.sqrt(v[1] / v[0])) for v in irls.losses(held_out, found)]

        path = [(k, cols[c], v) for k, c, v in _greedy(len(cols), cap, scores)]
    finally:
        rows.unpersist()
        held_out.unpersist()
    return train.sparkSession.createDataFrame(path, "step int, column string, rmse double")


def select_by_corr(df: DataFrame, groups: dict[str, list[str]], k: int, y: str = "n") -> DataFrame:
    """M18. The k columns of all groups with the highest absolute correlation with y: grp, column, r."""
    of = [(c, g) for g, cols in groups.items() for c in cols]
    names = df.sparkSession.createDataFrame(of, "column string, grp string")
    return target_corr(df, [c for c, _ in of], y).join(names, "column").where("r is not null").select("grp", "column", F.abs("r").alias("r")).orderBy(F.desc("r"), "column").limit(k)


def select_projection(train: DataFrame, cols: list[str], cap: int, reg: float = 0.01) -> DataFrame:
    """M19. step, column, mse: greedy, to match the rates of the model with all columns; candidates are fitted to these rates, all
    of a step together."""
    rows = irls.matrix(train, cols).persist()
    target = None
    try:
        (full,) = irls.fit(rows, [irls.Problem(list(range(len(cols))), reg)])
        target = irls.expected(rows, full).persist()

        def scores(candidates: list[list[int]]) -> list[float]:
            found = irls.fit(target, [irls.Problem(own, reg, mean=full.mean[own], std=full.std[own]) for own in candidates])
            return irls.distances(target, found, full).tolist()

        path = [(k, cols[c], v) for k, c, v in _greedy(len(cols), cap, scores)]
    finally:
        rows.unpersist()
        if target is not None:
            target.unpersist()
    return train.sparkSession.createDataFrame(path, "step int, column string, mse double")


def filter_and_interact(df: DataFrame, groups: dict[str, list[str]], threshold: float, flag: str, y: str = "n") -> tuple[DataFrame, dict[str, list[str]]]:
    """M20. Keeps columns with |r| >= threshold and crosses each with the flag."""
    strong = {r["column"] for r in target_corr(df, [c for cols in groups.values() for c in cols], y).where(F.abs("r") >= threshold).collect()}  # one row per column
    kept = {g: [c for c in cols if c in strong] for g, cols in groups.items()}
    out = interact(df, [c for cols in kept.values() for c in cols], flag)
    return out, {g: cols + [f"{c}_x_{flag}" for c in cols] for g, cols in kept.items()}


def as_array(df: DataFrame, cols: list[str]) -> DataFrame:
    """The assembled matrix as an array column x."""
    return VectorAssembler(inputCols=cols, outputCol="_x").transform(df).withColumn("x", vector_to_array("_x")).drop("_x")
