"""Exact quantiles, tail compression, translation, stability and name matching against plain numpy / Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchline.functions.scalars import CLUB_WORDS  # noqa: F401
from pitchline.operators import common, names, seasons
from pitchline.plans import stability, translation


def test_quantile_of_large_groups_with_heavy_ties(spark):
    rng = np.random.default_rng(1)
    hot = np.round(rng.exponential(size=30_000), 2)
    hot[:12_000] = 0.5
    groups = {"hot": hot, "tiny": np.array([3.0]), "two": np.array([1.0, 2.0]), "same": np.full(50, 4.0)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, x double")
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = {r.g: r.quantile for r in common.exact_quantile(df, "x", q, ["g"]).collect()}
        assert got == pytest.approx({g: float(np.quantile(x, q)) for g, x in groups.items()}, abs=1e-12)
    assert common.exact_quantile(df, "x", 0.95).first()[0] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.95))


def test_most_frequent_value(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (1, "b"), (1, "c"), (2, None), (2, ""), (2, "null"), (2, "z"), (3, None)]
    got = {r.k: r.v for r in common.most_frequent(spark.createDataFrame(rows, "k int, v string"), ["k"], "v").collect()}
    assert got == {1: "a", 2: "z"}


def test_padding_of_short_seasons(spark):
    rows = [("L", "S", 1, "GK", 100.0, 4.0), ("L", "S", 2, "GK", 0.0, 2.0), ("L", "S", 3, None, 90.0, 1.0)]
    df = spark.createDataFrame(rows, "league string, season string, player_id bigint, position string, minutes double, goals double")
    df = df.withColumn("player", F.lit("x"))
    stats = seasons.season_totals(df, ["goals"])
    out = {r.player_id: r for r in seasons.pad_rates(stats, 150, ["goals"]).collect()}
    rates = {1: 4 / (100 / 90), 2: 0.0}
    low = np.mean(list(rates.values())) - 1.5 * np.std(list(rates.values()))
    assert out[2].goals_p90 == pytest.approx(low * 150 / (150 + 1e-9)) and out[2].position == "GK"
    assert out[1].goals_p90 == pytest.approx((rates[1] * 100 + low * 50) / (150 + 1e-9))
    assert out[3].position == "UNK" and out[3].goals_p90 == pytest.approx(1.0, abs=1e-9)


RATING = "player_id bigint, player string, position string, minutes double, league string, season string, epm double"


def test_translation(spark):
    rows = [(1, "p", "x", 1000.0, "A", "2020_2021", 1.0), (1, "p", "x", 2000.0, "B", "2021_2022", 3.0),
            (2, "p", "x", 950.0, "B", "2019_2020", 0.5), (2, "p", "x", 900.0, "C", "2022_2023", 0.25),
            (3, "p", "x", 899.0, "A", "2020_2021", 9.0), (3, "p", "x", 3000.0, "C", "2021_2022", 1.0),
            (4, "p", "x", 3000.0, "D", "2021_2022", 1.0)]
    df = spark.createDataFrame(rows, RATING)
    samples = {(r.player_id, r.origin, r.dest, r.y, r.weight) for r in translation.transfer_samples(df).collect()}
    assert samples == {(1, "A", "B", 2.0, 1000.0), (2, "B", "C", -0.25, 900.0)}
    x = np.array([[-1, 1, 0, 0], [0, -1, 1, 0]], float)
    w, y = np.diag([1000.0, 900.0]), np.array([2.0, -0.25])
    beta = np.linalg.solve(x.T @ w @ x + np.eye(4), x.T @ w @ y)
    beta -= beta.mean()
    got = {r.league: r.coef for r in translation.league_coefficients(df).collect()}
    assert got == pytest.approx(dict(zip("ABCD", beta)), abs=1e-12)
    none = {r.league: r.coef for r in translation.league_coefficients(df, min_minutes=10_000).collect()}
    assert none == dict.fromkeys("ABCD", 0.0)


def test_tail_compression(spark):
    values = {"A": [1.0, 1.1, 0.9, 1.2, 0.8, 9.0], "B": [2.0, 2.0]}
    df = spark.createDataFrame([(l, v) for l, vs in values.items() for v in vs], "league string, epm double")

    def plain(v, q=0.8, k=2.0):
        v = np.array(v)
        if v.std() == 0:
            return v.tolist()
        z = np.abs(v - v.mean()) / v.std()
        cut = np.quantile(z, q)
        z = np.where(z > cut, cut + np.log1p(k * np.clip(z - cut, 0, None)) / k, z)
        return (v.mean() + np.sign(v - v.mean()) * z * v.std()).tolist()

    got = translation.compress_tails(df, "epm", q=0.8, k=2.0, by=["league"]).collect()
    for league, v in values.items():
        mine = [(r.epm, r.gpm) for r in got if r.league == league]
        assert sorted(g for _, g in mine) == pytest.approx(sorted(plain(v)))
    whole = translation.compress_tails(df, "epm", q=0.8, k=2.0).collect()
    assert sorted(r.gpm for r in whole) == pytest.approx(sorted(plain(values["A"] + values["B"])))


def dense_loglik(x, phi, mu, var):
    n = len(x)
    cov = var / (1 - phi**2) * phi ** np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    d = x - mu
    return -0.5 * (n * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + d @ np.linalg.solve(cov, d))


def test_stability_is_the_likelihood_maximum(spark):
    rng = np.random.default_rng(4)
    series = {1: rng.normal(size=7), 2: np.cumsum(rng.normal(size=9)), 3: np.full(5, 2.0), 4: rng.normal(size=3)}
    rows = [(p, f"P{p}", "x", 1000.0, "L", f"{2000 + i}_{2001 + i}", float(v)) for p, vs in series.items() for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    got = {r.player_id: r for r in stability.player_stability(spark.createDataFrame(rows, RATING), "epm").collect()}
    assert set(got) == {1, 2, 3}
    assert got[3].ar1 is None and got[3].aic is None and got[3].value_std == 0 and got[3].ewma_resid_std == 0
    for p in (1, 2):
        x, r = series[p], got[p]
        ewma = [x[0]]
        for v in x[1:]:
            ewma.append(0.5 * v + 0.5 * ewma[-1])
        assert r.ewma_resid_std == pytest.approx(np.std(x - np.array(ewma))) and r.seasons == len(x)
        one = np.ones(len(x))

        def profile(phi):
            inv = np.linalg.inv(phi ** np.abs(np.subtract.outer(np.arange(len(x)), np.arange(len(x)))) / (1 - phi**2))
            mu = (one @ inv @ x) / (one @ inv @ one)
            var = (x - mu) @ inv @ (x - mu) / len(x)
            return dense_loglik(x, phi, mu, var), var

        top = max(profile(phi)[0] for phi in np.arange(-0.999, 1, 0.001))
        ll, var = profile(r.ar1)
        assert ll >= top - 1e-9 and r.aic == pytest.approx(6 - 2 * ll) and r.resid_std == pytest.approx(math.sqrt(var))


def test_ewma_frame_covers_long_series(spark):
    x = np.random.default_rng(2).normal(size=300)
    rows = [(1, "P", "x", 1000.0, f"L{i:03d}", "2000_2001", float(v)) for i, v in enumerate(x)]
    steps = stability.series_steps(spark.createDataFrame(rows, RATING), "epm", 9).orderBy("t").collect()
    e = [x[0]]
    for v in x[1:]:
        e.append(0.2 * v + 0.8 * e[-1])
    assert [r.ewma for r in steps] == pytest.approx(e, abs=1e-12)


def test_names_against_brute_force(spark):
    rng = random.Random(6)
    words = ["ash", "ashford", "ford", "oak", "oakham", "ham", "united", "fc", "x"]
    teams = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(40)})
    files = list(dict.fromkeys("-".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(12)))
    import re

    def norm(t):
        t = re.sub(r"\b(" + "|".join(CLUB_WORDS) + r")\b", "", t.lower().replace(" ", "-").replace("_", "-"))
        return re.sub("-+", "-", t).strip("-")

    listed = {}
    for f in files:
        if norm(f):
            listed[norm(f)] = f
    want = {}
    for t in teams:
        k = norm(t)
        want[t] = listed[k] if k in listed else next((f for n, f in listed.items() if k in n or n in k), None)
    got = names.match_names(spark.createDataFrame([(t,) for t in teams], "name string"),
                            spark.createDataFrame([(f, i) for i, f in enumerate(files)], "candidate string, position int"))
    found = {r.name: r.candidate for r in got.collect()}
    assert found == want and None in want.values()


def test_moving_average_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(stability, "BLOCK", 4)
    values = [float((i * 37) % 11) for i in range(90)]
    rows = [(k, i + 1, v + (k or 0)) for k in (1, 2, None) for i, v in enumerate(values[:90 - 40 * (k == 2)])]
    got = stability.moving_average(spark.createDataFrame(rows, "k long, t int, x double"), "x", 0.1, "k", "t").collect()
    assert len(got) == len(rows)
    for k in (1, 2, None):
        e = None
        for r in sorted((r for r in got if r.k == k), key=lambda r: r.t):
            e = r.x if e is None else 0.1 * r.x + 0.9 * e
            assert r.ewma == pytest.approx(e, abs=1e-12)
