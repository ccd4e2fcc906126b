import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigauge.plans import curves, mixed, regression


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 2)) * [1, 50] + [3, 1000]
    y = 2 + x @ [1.5, -0.2] + 0.01 * x[:, 0] * x[:, 1] + rng.standard_normal(300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1.0)], "a double, b double, y double").repartition(5)
    fit = regression.least_squares(df, "y", regression.terms(["a", "b"]))
    design = np.column_stack([np.ones(300), x, x[:, 0] * x[:, 1]])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert fit.n == 300 and fit.coef == pytest.approx(beta, rel=1e-5)
    assert fit.r2 == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    se = np.sqrt(rss[0] / 296 * np.diag(np.linalg.inv(design.T @ design)))
    assert fit.t == pytest.approx(beta / se, rel=1e-4)
    assert fit.aic == pytest.approx(300 * (math.log(2 * math.pi * rss[0] / 300) + 1) + 8)
    assert 0 < regression.predictive_power(df, ["y"], ["a"], "b", False) <= 1
    same = regression.least_squares(df.withColumn("c", F.col("a") * 2), "y", regression.terms(["a", "c"], False))
    assert same.r2 == pytest.approx(regression.least_squares(df, "y", regression.terms(["a"], False)).r2)
    assert math.isnan(regression.least_squares(df.where("false"), "y", regression.terms(["a"])).r2)


def subjects(spark, slope, n=30, k=40, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n):
        b = 5 + slope * rng.standard_normal()
        for _ in range(k):
            x = rng.standard_normal()
            rows.append((f"s{s}", float(10 + b * x + slope * 3 * (s % 2) + rng.standard_normal()), float(x)))
    return spark.createDataFrame(rows, "subid string, y double, x double")


def test_mixed_model(spark):
    df = subjects(spark, 2.0)
    stats = mixed.subject_statistics(df, "subid", F.col("y"), [F.lit(1.0), F.col("x")])
    fit = mixed.fit_statistics(stats, 2)
    assert fit.n == 1200 and fit.theta[1] == pytest.approx(2, abs=0.7)
    # at theta = 0 the deviance is that of least squares
    rows = df.toPandas()
    x = np.column_stack([np.ones(len(rows)), rows.x])
    y = rows.y.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rss = ((y - x @ beta) ** 2).sum()
    zero = np.concatenate([[0.0], np.zeros(4), np.zeros(2), [0.0], np.zeros(2), np.zeros(2 * 9)])
    assert mixed.deviance(zero, len(y), x.T @ x, x.T @ y, y @ y)[0] == pytest.approx(len(y) * (1 + math.log(2 * math.pi * rss / len(y))))
    assert fit.loglik > -len(y) / 2 * (1 + math.log(2 * math.pi * rss / len(y)))
    # the dense likelihood at the optimum
    dev = 0
    v = [np.column_stack([np.ones(40), g.x]) for _, g in rows.groupby("subid")]
    ys = [g.y.to_numpy() for _, g in rows.groupby("subid")]
    t = np.diag(np.square(fit.theta))
    ws = [np.eye(len(z)) + z @ t @ z.T for z in v]
    a = sum(z.T @ np.linalg.solve(w, z) for z, w in zip(v, ws, strict=True))
    b = sum(z.T @ np.linalg.solve(w, u) for z, w, u in zip(v, ws, ys, strict=True))
    beta = np.linalg.solve(a, b)
    r2 = sum((u - z @ beta) @ np.linalg.solve(w, u - z @ beta) for z, w, u in zip(v, ws, ys, strict=True))
    dev = sum(np.linalg.slogdet(w)[1] for w in ws) + len(y) * (1 + math.log(2 * math.pi * r2 / len(y)))
    assert -2 * fit.loglik == pytest.approx(dev, abs=1e-3)


def test_many_subjects_are_summed_in_spark(spark, monkeypatch):
    df = subjects(spark, 1.0, 6, 12)
    stats = mixed.subject_statistics(df, "subid", F.col("y"), [F.lit(1.0)]).cache()
    here = mixed.fit_statistics(stats, 1)
    monkeypatch.setattr(mixed, "DRIVER_SUBJECTS", 1)
    assert mixed.fit_statistics(stats, 1).loglik == pytest.approx(here.loglik, abs=1e-6)


def test_delta_loglik(spark):
    df = subjects(spark, 1.0).withColumn("z", F.rand(3))
    out = mixed.delta_loglik(df, "subid", "y", ["x", "z"], ["z"])
    assert out["delta"] > 100 and out["mcfadden"] == pytest.approx(1 - out["full"] / out["base"])


def test_sigmoid_fits():
    ages = np.arange(16, 31.0)
    y = curves.sigmoid(np.array([0.9, 0.5, 22.0, 0.02]), ages)
    p, age, kind = curves.child_age(ages, y)
    assert kind == "ok" and p == pytest.approx([0.9, 0.5, 22, 0.02], abs=0.02)
    assert age == pytest.approx(22 - math.log(0.9 / (0.5 - 0.02) - 1) / 0.5, abs=0.05)
    assert curves.child_age(ages[:2], y[:2])[2] == "too few points"
    assert curves.child_age(ages, np.full(15, 0.1) + 0.001 * ages)[1] is None
    steps = np.array([0, 1, 10, 100, 1000, 10000, 100000.0])
    s = 12 - curves.sigmoid(np.array([9.0, 3.0, 3.0, 0.0]), np.log10(steps + 1))
    _, at, kind = curves.model_age(steps, s, 12.0)
    assert kind == "ok" and 2.5 < at < 3.5
    assert curves.model_age(steps, np.full(7, 4.0), 12.0)[2] == "bad shape"


def test_curves_in_spark(spark):
    rows = [(w, int(a), float(curves.sigmoid(np.array([0.95, 0.6, 18.0 + k, 0.0]), np.array([a]))[0])) for k, w in enumerate(["dog", "cat", "sun", "cow"]) for a in range(16, 31)]
    child = curves.child_curves(spark.createDataFrame([*rows, ("one", 16, 0.5)], "word string, age int, proportion double"))
    ages = {r.word: r.aoa for r in child.collect()}
    assert ages["one"] is None and ages["dog"] < ages["cat"] < ages["sun"] < ages["cow"]
    model = child.select("word", (F.col("aoa") / 10).alias("aoa"))
    out = curves.curve_fitness(model, child)
    assert out["n"] == 4 and out["fitness"] == pytest.approx(1)


def test_beta_search():
    rng = np.random.default_rng(0)
    scores = rng.standard_normal((50, 4))
    z = np.exp(3.0 * scores)
    beta, kl = curves.best_beta(z / z.sum(1, keepdims=True), scores)
    assert beta == pytest.approx(3, rel=1e-3) and kl < 1e-9


def test_temperatures_by_group_are_those_of_each_group(spark):
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(300, 4))
    of = ["hot" if k % 3 else "ab"[k % 2] for k in range(300)]
    shares = np.exp(scores * np.array([{"hot": 2.0, "a": 0.5, "b": 9.0}[g] for g in of])[:, None] + rng.normal(size=scores.shape) / 4)
    shares /= shares.sum(1, keepdims=True)
    rows = [(g, h.tolist(), m.tolist()) for g, h, m in zip(of, shares, scores, strict=True)]
    df = spark.createDataFrame([*rows, ("a", None, [1.0]), (None, [1.0], [1.0])], "g string, h array<double>, m array<double>").repartition(7)
    got = {r.g: r for r in curves.beta_by_group(df, "g", "h", "m").collect()}
    assert set(got) == {"hot", "a", "b"}
    for g, r in got.items():
        own = [k for k in range(300) if of[k] == g]
        beta, kl = curves.best_beta(shares[own], scores[own])
        assert r.n == len(own) and r.beta == pytest.approx(beta, rel=1e-6) and r.kl == pytest.approx(kl, rel=1e-9)
    assert curves.beta_by_group(df.where("g = 'none'"), "g", "h", "m").count() == 0


def _made(rng, subjects, p):
    """A table of readings with slopes by subject, and its products by subject."""
    names = [f"v{k}" for k in range(p - 1)]
    fixed, spread = rng.normal(size=p), np.concatenate([[0.7], rng.uniform(0, 0.6, p - 1) * (rng.random(p - 1) < 0.6)])
    rows, zz, zy, total = [], [], [], [np.zeros((p, p)), np.zeros(p), 0.0, 0]
    for s in range(subjects):
        n = int(rng.integers(15, 40))
        z = np.column_stack([np.ones(n), rng.normal(size=(n, p - 1))])
        y = z @ (fixed + spread * rng.normal(size=p)) + rng.normal(size=n)
        rows += [(f"s{s}", float(v), *map(float, x[1:])) for v, x in zip(y, z, strict=True)]
        zz.append(z.T @ z)
        zy.append(z.T @ y)
        total = [total[0] + zz[-1], total[1] + zy[-1], total[2] + y @ y, total[3] + n]
    return rows, names, np.array(zz), np.array(zy), total


@pytest.mark.parametrize("p", [2, 8, 11])
def test_gradient_of_the_deviance(p):
    rng = np.random.default_rng(p)
    _, _, zz, zy, (xx, xy, yy, n) = _made(rng, 12, p)

    def f(theta):
        return mixed.deviance(mixed.block_sums(theta, zz, zy), n, xx, xy, yy)

    for theta in (np.full(p, 1.0), rng.uniform(0.05, 1.5, p), np.where(np.arange(p) % 2, 0.3, 0.0)):
        value, gradient = f(theta)
        for k in range(p):
            e = np.zeros(p)
            e[k] = 1e-5
            assert (f(theta + e)[0] - f(theta - e)[0]) / 2e-5 == pytest.approx(gradient[k], rel=1e-4, abs=1e-3)
        # the plain deviance, with the whole covariance matrix of each subject
        assert value == pytest.approx(f(np.abs(theta))[0])


@pytest.mark.parametrize("p", [11, 8])
def test_columns_of_the_full_and_the_base_model(spark, p):
    """The optimum against a plain likelihood over whole covariance matrices, from many random directions; to a hundredth, as results are compared."""
    rng = np.random.default_rng(40 + p)
    rows, names, *_ = _made(rng, 20, p)
    df = spark.createDataFrame(rows, ["subid", "y", *names])
    fit = mixed.mixed_model(df, "subid", "y", names)
    data = np.array([r[1:] for r in rows])
    y, x = data[:, 0], data[:, 1:]
    x = np.column_stack([np.ones(len(y)), (x - x.mean(0)) / x.std(0, ddof=1)])
    subject = np.array([r[0] for r in rows])

    def loglik(theta):
        logdet, a, b, c = 0.0, np.zeros((p, p)), np.zeros(p), 0.0
        for s in np.unique(subject):
            z, v = x[subject == s], y[subject == s]
            cov = np.eye(len(v)) + (z * theta**2) @ z.T
            logdet += np.linalg.slogdet(cov)[1]
            w = np.linalg.solve(cov, np.column_stack([z, v]))
            a, b, c = a + z.T @ w[:, :p], b + z.T @ w[:, p], c + v @ w[:, p]
        r2 = c - b @ np.linalg.solve(a, b)
        return -(logdet + len(y) * (1 + math.log(2 * math.pi * r2 / len(y)))) / 2

    theta = np.array(fit.theta)
    assert fit.loglik == pytest.approx(loglik(theta), abs=1e-6)
    for _ in range(60):
        near = np.maximum(theta + rng.normal(size=p) * rng.choice([0.001, 0.01, 0.1]), 0)
        assert loglik(near) <= fit.loglik + 1e-2


def test_one_job_a_step(spark, monkeypatch):
    """Beyond DRIVER_SUBJECTS each evaluation of value and gradient is one job, and the result is the same."""
    rng = np.random.default_rng(9)
    rows, names, *_ = _made(rng, 10, 4)
    df = spark.createDataFrame(rows, ["subid", "y", *names])
    stats = mixed.subject_statistics(df, "subid", F.col("y"), [F.lit(1.0), *map(F.col, names)]).cache()
    here = mixed.fit_statistics(stats, 4)
    monkeypatch.setattr(mixed, "DRIVER_SUBJECTS", 1)
    monkeypatch.setattr(mixed, "BLOCK", 3)
    asked = []
    plain = mixed.deviance
    monkeypatch.setattr(mixed, "deviance", lambda *a: asked.append(1) or plain(*a))
    spark.sparkContext.setJobGroup("mixed", "")
    try:
        there = mixed.fit_statistics(stats, 4)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("mixed"))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert there.loglik == pytest.approx(here.loglik, abs=1e-6) and there.theta == pytest.approx(here.theta, abs=1e-3)
    # an adaptive plan runs an aggregation as one job a stage; the totals are one more
    assert jobs <= 2 * (len(asked) + 1)


def test_minimum_that_starts_at_an_even_saddle():
    x, v = mixed.minimise(lambda t: (float((t[0] ** 2 - 1) ** 2 + t[1] ** 2), np.array([4 * t[0] * (t[0] ** 2 - 1), 2 * t[1]])), np.array([0.0, 1.0]))
    assert v == pytest.approx(0, abs=1e-6) and x == pytest.approx([1, 0], abs=1e-3)


def test_subjects_are_packed_once(spark, monkeypatch):
    """Evaluations read blocks of many subjects and give a row a task, whatever the number of subjects."""
    df = subjects(spark, 0.5, n=50, k=8)
    stats = mixed.subject_statistics(df, "subid", F.col("y"), [F.lit(1.0), F.col("x")]).coalesce(2).cache()
    here = mixed.fit_statistics(stats, 2)
    monkeypatch.setattr(mixed, "DRIVER_SUBJECTS", 1)
    monkeypatch.setattr(mixed, "BLOCK", 20)
    rows = mixed.packed_statistics(stats, 2).collect()
    assert 3 <= len(rows) <= 5 and sum(len(r.zz) for r in rows) == 50 * 4 * 8 and sum(len(r.zy) for r in rows) == 50 * 2 * 8
    there = mixed.fit_statistics(stats, 2)
    assert there.loglik == pytest.approx(here.loglik, abs=1e-6) and there.theta == pytest.approx(here.theta, abs=1e-3)


def test_divergences_of_a_grid_are_those_of_each_point():
    rng = np.random.default_rng(4)
    h, m = rng.dirichlet(np.ones(4), 50), 30 * rng.standard_normal((50, 4))
    h[0] = [1, 0, 0, 0]
    betas = [0.025, 1.0, 40.0]
    for beta, got in zip(betas, curves.divergences(betas, h, m), strict=True):
        q = np.exp(beta * (m - m.max(1, keepdims=True)))
        q, p = np.clip(q / q.sum(1, keepdims=True), 1e-10, 1), np.clip(h, 1e-10, 1)
        assert got == pytest.approx((p * np.log(p / q)).sum(1).mean(), rel=1e-12, abs=1e-12)


def test_curves_fitted_together_are_those_fitted_alone():
    rng = np.random.default_rng(3)
    x = np.tile(np.arange(16.0, 31), (40, 1))
    p = np.stack([rng.uniform(0.5, 1, 40), rng.uniform(0.3, 0.9, 40), rng.uniform(19, 26, 40), rng.uniform(0, 0.1, 40)], 1)
    y = np.stack([curves.sigmoid(q, v) for q, v in zip(p, x, strict=True)]) + rng.normal(0, 0.01, x.shape)
    start, low, high = (np.tile(v, (40, 1)) for v in ([1, 0.1, 23, 0], [0, 0, 16, -0.5], [2, 1, 30, 0.5]))
    got = curves.bounded_fits(x, y, start, low, high)
    for k in range(40):
        alone = curves.bounded_fit(x[k], y[k], start[k], low[k], high[k])
        assert np.allclose(got[k], alone, atol=1e-4)
