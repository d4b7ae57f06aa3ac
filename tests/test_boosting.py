"""M8: boosting against a plain trainer, and its forecasts at any number of shuffle partitions."""

import datetime as dt

import numpy as np
import pytest

from shelfcast.operators import boosting as bo
from shelfcast.operators import forecast as fc
from shelfcast.operators.features import feature_columns, feature_frame


def plain_fit(x, y, p):
    """Greedy trees by trying every feature and every cut at every node, on raw values; returns a predictor."""
    trees, base = [], y.mean()
    predicted = np.full(len(y), base)
    for kept, columns in bo.samples(p, *x.shape):
        g = predicted - y

        def grow(rows, level):
            used = [i for i in rows if kept[i]]
            score = lambda r: sum(g[i] for i in r) ** 2 / (len(r) + p.l2)
            best = None
            if level < p.depth:
                for j in columns:
                    for c in sorted(set(x[:, j]))[1:]:
                        left, right = [i for i in used if x[i, j] < c], [i for i in used if x[i, j] >= c]
                        if left and right:
                            gain = score(left) + score(right) - score(used)
                            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, j, c)
            if best is None:
                return -p.rate * sum(g[i] for i in used) / (len(used) + p.l2)
            _, j, c = best
            return j, c, grow([i for i in rows if x[i, j] < c], level + 1), grow([i for i in rows if x[i, j] >= c], level + 1)
        tree = grow(range(len(y)), 0)
        trees.append(tree)
        predicted = predicted + np.array([walk(tree, r) for r in x])
    return lambda row: base + sum(walk(t, row) for t in trees)


def walk(tree, row):
    while isinstance(tree, tuple):
        j, c, left, right = tree
        tree = left if row[j] < c else right
    return tree


def rows(n, m, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, m))
    x[:, 1] = rng.integers(0, 4, n)
    return x, 50 * np.sin(x[:, 0]) + 10 * x[:, 1] + rng.normal(size=n)


@pytest.mark.parametrize("p", [bo.Boosting(rounds=12), bo.Boosting(rounds=8, depth=2, l2=0.3, rate=0.3, rows=0.5, columns=0.4, seed=7)])
def test_fit_equals_a_plain_trainer(p):
    x, y = rows(80, 6)
    model = bo.unpack(bo.pack(bo.fit(x, y, p)), p)
    plain = plain_fit(x, y, p)
    for row in np.vstack([x[:20], x[:10] + 0.13, np.full(6, 9.0), np.full(6, -9.0)]):
        assert bo.predict(model, row, p.depth) == pytest.approx(plain(row), rel=1e-9)


def test_many_values_constant_targets_and_few_rows():
    p = bo.Boosting(rounds=40, rate=0.3)
    x, y = rows(2000, 3, 1)
    model = bo.fit(x, y, p)
    assert len(bo.cut_points(x[:, 0])) == bo.MAX_BINS - 1
    error = np.array([bo.predict(model, r, p.depth) for r in x[:300]]) - y[:300]
    assert np.abs(error).mean() < 5
    assert bo.predict(bo.fit(x[:9], np.full(9, 4.0), p), x[0], p.depth) == 4.0
    assert np.isfinite(bo.predict(bo.fit(x[:1], y[:1], p), x[0], p.depth))


def monthly(spark):
    out = []
    for key, n in (("a", 9), ("b", 14), ("c", 40), ("d", 5), ("e", 30)):
        for i in range(n):
            value = 0.0 if key == "e" else 100.0 + 7 * i + 30 * np.sin(i) + len(key)
            out.append((key, dt.date(2020 + i // 12, i % 12 + 1, 1), float(value)))
    return spark.createDataFrame(out, "k string, date date, target double")


def test_forecasts_do_not_depend_on_partitions(spark):
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        run = fc.tree_model(monthly(spark).repartition(3), fc.BOOSTING, fc.boosting(rounds=30), ["k"])
        found.append((sorted(map(tuple, run.forecasts.collect())), sorted(map(repr, run.results.collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    assert {r[0] for r in found[0][0]} == {"a", "b", "c"}, "d is too short, and e has no feature row but zeros"


def test_a_keyed_series_forecasts_as_it_does_alone(spark):
    one = monthly(spark).where("k = 'c'")
    alone = fc.tree_model(one.drop("k"), fc.BOOSTING, fc.boosting(rounds=30)).forecasts.orderBy("date").collect()
    keyed = fc.tree_model(monthly(spark), fc.BOOSTING, fc.boosting(rounds=30), ["k"]).forecasts.where("k = 'c'").orderBy("date").collect()
    assert [(r.date, r.value) for r in alone] == [(r.date, r.value) for r in keyed]
    # the first step is the model of all feature rows, applied to the next month's row
    f = feature_frame(one.drop("k")).orderBy("date").toPandas()
    cols = feature_columns(40)
    p = bo.Boosting(rounds=30)
    values = [r.target for r in one.orderBy("date").collect()]
    m = 40 % 12 + 1
    row = [40, m, (m - 1) // 3 + 1, np.sin(2 * np.pi * m / 12), np.cos(2 * np.pi * m / 12), *(values[-j] for j in (1, 2, 3, 6, 12)),
           np.mean(values[-3:]), np.std(values[-3:], ddof=1), np.mean(values[-6:]), values[-1] / values[-2] - 1, values[-1] / values[-4] - 1]
    want = plain_fit(f[cols].to_numpy(float), f["target"].to_numpy(float), p)(np.array(row))
    assert alone[0].value == pytest.approx(want, abs=0.011)
