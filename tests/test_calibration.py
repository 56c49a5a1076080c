import math

import numpy as np
import pytest

from tallyweave.functions import scoring as sc
from tallyweave.operators import calibration as cal

# Published control points (score, verdict) and what a fit to them gives.
CONTROLS = [
    (0.5168783291958381, 1), (0.08904928075770538, 0), (0.05451007840534052, 0),
    (0.06648260907897231, 0), (0.4913040177689659, 1), (0.47373158682699074, 1),
    (0.08059178197549449, 0), (0.5041291253434288, 1), (0.6982338190078736, 1),
    (0.09999720753992306, 0), (0.0977601790114453, 0), (0.5525758552027273, 1),
    (0.06348625304607246, 0), (0.0879758887670257, 0), (0.09284622544485534, 0),
    (0.08262881063497984, 0), (0.5859527158213186, 1), (0.0500084850872899, 0),
    (0.09039844665296225, 0), (0.9987794160842896, 1), (0.0754959624358698, 0),
    (0.06659716529252588, 0), (0.049960214599967, 0), (0.9944869995117188, 1),
    (0.06742808794083655, 0), (0.06054896893071348, 0), (0.5689277708530427, 1),
    (0.07199975700680612, 0), (0.06955108068111102, 0), (0.062034116674644445, 0),
    (0.6472694499152047, 1), (0.06993197619529634, 0), (0.07256320220515577, 0),
]
A, B = 10.525909422604663, -3.6973194221231505
X, Y = [x for x, _ in CONTROLS], [y for _, y in CONTROLS]


def test_fit_reproduces_the_published_map(spark):
    assert cal.fit_points(X, Y) == pytest.approx((A, B), abs=1e-9)
    assert cal.fit_global(spark.createDataFrame(CONTROLS, "x double, y int")) == pytest.approx((A, B), abs=1e-7)


def test_stability_and_brier(spark):
    worst, bad = cal.jackknife(X, Y)
    assert round(worst, 4) == 0.0372 and bad == 0
    got = cal.calibrate_groups(spark.createDataFrame([(1, x, y) for x, y in CONTROLS], "doc int, x double, y int"), "doc").first()
    assert got.fitted and round(got.loo_brier, 4) == 0.0085


@pytest.mark.parametrize(("fused", "low", "high", "conf"), [(X[0], 0.8, 1.0, 0.8734), (0.4913040177689659, 0.6667, 1.0, 0.8416), (0.47373158682699074, 0.5, 1.0, 0.8164)])
def test_published_relations(spark, fused, low, high, conf):
    from pyspark.sql import functions as F

    ends = cal.venn_abers(X, Y, fused)
    assert [round(e, 4) for e in ends] == [low, high]
    p = spark.range(1).select(sc.relation_confidence(F.lit(fused), F.lit("pass"), A, B).alias("p")).first().p
    assert round(p, 4) == conf


def test_few_or_degenerate_controls():
    assert cal.fit_points([0.1, 0.9], [0, 1]) is None
    assert cal.fit_points([0.5] * 8, [0, 1] * 4) is None  # one score: nothing to fit
    assert cal.venn_abers([0.1, 0.9], [0, 1], 0.5) is None
    assert cal.jackknife([0.1, 0.2, 0.3, 0.7, 0.8, 0.9], [0, 0, 0, 1, 1, 1]) is None  # under eight points


def test_isotonic_against_min_max():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, y = rng.integers(0, 8, 20).astype(float), rng.integers(0, 2, 20).astype(float)
        s = np.unique(x)
        sums, n = np.array([y[x == v].sum() for v in s]), np.array([(x == v).sum() for v in s])
        for i, v in enumerate(s):
            want = max(min(sums[lo : hi + 1].sum() / n[lo : hi + 1].sum() for hi in range(i, len(s))) for lo in range(i + 1))
            assert cal.isotonic_at(x, y, v) == pytest.approx(want)


def test_intervals_and_tests():
    low, high = sc.clopper_pearson(199, 201)
    assert (round(low, 4), round(high, 4)) == (0.9645, 0.9988)
    assert sc.clopper_pearson(0, 0) == (0.0, 1.0)
    assert round(sc.mcnemar_exact(0, 6), 3) == 0.031
    assert sc.p_star(1, 20) == 0.95 and sc.p_star(1, 1) == 0 and sc.p_star(5, 2) == 0
    with pytest.raises(ValueError):
        sc.p_star(1, 0)


def test_interval_of_many_trials():
    # the ends of the published tables' size hold, and binomials beyond a double's range do not fail
    for k, n in ((1, 40), (17, 40), (39, 40)):
        low, high = sc.clopper_pearson(k, n)
        tail = lambda p, at: math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(at, n + 1))  # noqa: B023, E731
        assert tail(low, k) == pytest.approx(0.025, abs=1e-10) and 1 - tail(high, k + 1) == pytest.approx(0.025, abs=1e-10)
    for k, n in ((0, 1200), (540, 1200), (1200, 1200), (20_000, 36_000)):
        low, high = sc.clopper_pearson(k, n)
        spread = 2.1 * math.sqrt(n) / n
        assert 0 <= low <= k / n <= high <= 1 and high - low < spread


def test_left_out_fits_of_equal_points():
    def plain(x, y):
        full, errors, worst, bad = cal.fit_points(x, y), [], 0.0, 0
        curve = lambda f: 1 / (1 + np.exp(-(f[0] * x + f[1])))
        for i in range(len(x)):
            if (left := cal.fit_points(np.delete(x, i), np.delete(y, i))) is None:
                bad += 1
                continue
            worst = max(worst, float(np.abs(curve(left) - curve(full)).max()))
            errors.append((curve(left)[i] - y[i]) ** 2)
        return worst, bad, float(np.mean(errors)) if errors else None

    rng = np.random.default_rng(4)
    for size, overlap in ((8, 0.5), (30, 0.9), (60, 0.2), (7, 0.4)):
        y = np.array([0, 0, 0, 1, 1, 1, *rng.integers(0, 2, size - 6)])
        x = np.round(0.5 * y + overlap * rng.random(size), 1)
        full, knife, score = cal.stability(x, y)
        if full is None:
            continue
        worst, bad, want = plain(x, y)
        assert score == pytest.approx(want, abs=1e-10)
        assert knife == ((pytest.approx(worst, abs=1e-9), bad) if size >= 8 else None)


def test_large_groups_are_counted(spark):
    # thirty thousand points at forty places: one left out at a time, that was thirty thousand fits over all of them
    import time

    points = spark.range(30_000).selectExpr("1 AS doc", "0.4 * (id % 2) + (id % 20) / 20.0D AS x", "cast(id % 2 AS int) AS y")
    started = time.time()
    got = cal.calibrate_groups(points, "doc").first()
    assert got.fitted and got.loo_degenerate == 0 and got.loo_max_dp < 1e-3 and time.time() - started < 60
