import numpy as np
import pytest

from veldspar.operators import forecast as FC


def test_isotonic_by_the_min_max_formula():
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 60):
        x, y = rng.integers(0, 8, n) / 7, rng.integers(0, 2, n).astype(float)
        ends, means = FC.isotonic(x, y)
        ys = y[np.argsort(x, kind="stable")]
        best = [max(min(ys[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        fitted, at = [], 0
        for mean in best:  # each place takes the mean of its block
            while at < len(means) and abs(means[at] - mean) > 1e-9:
                at += 1
            assert at < len(means)
            fitted.append(means[at])
        assert fitted == pytest.approx(best) and (np.diff(means) > -1e-9).all() and ends[-1] == x.max()


def test_isotonic_steps():
    ends, means = np.array([0.2, 0.5, 0.9]), np.array([0.0, 0.4, 1.0])
    assert FC.isotonic_at(np.array([0.1, 0.2, 0.3, 0.5, 0.6, 0.9, 2.0]), ends, means).tolist() == [0.0, 0.0, 0.4, 0.4, 1.0, 1.0, 1.0]


def test_platt_has_no_slope_left():
    rng = np.random.default_rng(4)
    x = rng.random(80)
    y = (rng.random(80) < x).astype(float)
    a, b = FC.platt(x, y)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (80 - y.sum() + 2))
    e = 1 / (1 + np.exp(-(a * x + b))) - target
    assert abs(e.sum()) < 1e-4 and abs((e * x).sum()) < 1e-4 and a > 0


def _bars(spark, n=140):
    rng = np.random.default_rng(5)
    rows = [(s, t, float(c), float(f)) for s in ("a", "b") for t, (c, f) in enumerate(zip(100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), rng.normal(size=n), strict=True))]
    return spark.createDataFrame(rows + [("short", 0, 1.0, 1.0)], "symbol string, ts long, close double, f double")


def test_blocks_do_not_change_a_walk(spark):
    bars = _bars(spark)
    one, many = (FC.walk_forward(bars, 3, 5, ["f"], 20, 0.3, block=k).toPandas().sort_values(["symbol", "idx"]).reset_index(drop=True) for k in (4096, 16))
    assert one.equals(many) and set(one["symbol"]) == {"a", "b"}
    own = one[one["symbol"] == "a"]
    fit = int(len(own) * 0.3)
    use = own["idx"] >= own["idx"].iloc[fit - 1] + 3
    assert own["cal_p_up_iso"].notna().tolist() == use.tolist() == own["cal_p_up_platt"].notna().tolist()


def test_a_walk_sees_no_later_bar(spark):
    bars = _bars(spark)
    whole, cut = (FC.walk_forward(df, 3, 5, ["f"], 20).toPandas().sort_values(["symbol", "idx"]) for df in (bars, bars.where("ts < 100")))
    columns = ["symbol", "idx", "p_up", "q05", "q50", "q95", "vol20"]
    both = cut[columns].merge(whole[columns], on=["symbol", "idx"])
    assert len(both) == len(cut) and all(np.allclose(both[c + "_x"], both[c + "_y"]) for c in columns[2:])
