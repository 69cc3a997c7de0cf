from pyspark.sql import functions as F

from pitchline.functions import scalars as S
from pitchline.operators.shots import label_shots


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_season_key(spark):
    rows = [(x,) for x in ("2023_2024", "2324", "9900", "2023", "2021", "17", "abc", "x_1", None)]
    assert values(spark, rows, "s string", S.season_key("s")) == [2023, 2023, 2099, 2023, 2020, 17, 0, 0, 0]
    assert values(spark, [("2023",)], "s string", S.season_key("s", calendar_years=False)) == [2020]


def test_safe_numbers(spark):
    rows = [(x,) for x in (" 3 ", "3.7", "", None, "x", "-4", "1.5d", "1e3", "nan")]
    assert values(spark, rows, "s string", S.safe_int("s")) == [3, None, None, None, None, -4, None, None, None]
    floats = values(spark, rows, "s string", S.safe_float("s"))
    assert floats[:8] == [3.0, 3.7, None, None, None, -4.0, None, 1000.0] and floats[8] != floats[8]


def test_event_minute_and_kind(spark):
    df = spark.createDataFrame([(45, 2, "Goal", "x"), (None, 3, "CARD", "Red Card"), (90, None, "card", "Yellow Card"),
                                (1, 1, "Subst", None), (None, None, None, None)], "a int, b int, t string, d string")
    got = df.select(S.event_minute("a", "b"), S.feed_event_kind("t", "d")).collect()
    assert [tuple(r) for r in got] == [(47, "goal"), (3, "red"), (90, None), (2, "sub"), (0, None)]


def test_goal_difference_labels(spark):
    rows = [("h", 5, 1), ("a", 5, 1), ("h", 12, 2), ("a", 1, 1), ("h", 0, 3)]
    shots = spark.createDataFrame([(h, x, y, "Goal", 10, "A", "B") for h, x, y in rows],
                                  "h_a string, h_goals int, a_goals int, result string, minute int, h_team string, a_team string")
    got = [(r.goal_diff, r.game_state, r.kicker_team) for r in label_shots(shots).collect()]
    assert got == [("4+", "leading", "A"), ("-4-", "trailing", "B"), ("4+", "leading", "A"), ("0", "tie", "B"), ("-3", "trailing", "A")]


def test_match_name(spark):
    rows = [("AFC Bournemouth",), ("Wolverhampton Wanderers",), ("fc-brighton_and_hove albion",), ("United",), ("Sandtown",)]
    assert values(spark, rows, "n string", S.match_name("n")) == ["bournemouth", "wolverhampton", "brighton", "", "sandtown"]


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (0.25, 1)], "p double, y int")
    assert abs(df.agg(S.mean_log_loss("p", "y")).first()[0] - 1.3862943611198906 / 3) < 1e-12


def test_current_season(spark):
    schema = "seasons array<struct<year: int, current: boolean, coverage: string>>"
    rows = [([(2020, False, ""), (2021, True, ""), (2022, True, "")],), ([(2020, None, ""), (2019, False, "")],), ([],)]
    assert values(spark, rows, schema, S.current_season("seasons")) == [2021, 2019, None]


def test_odds_of_a_sure_shot_do_not_fail(spark):
    assert values(spark, [(1.0,), (0.5,)], "p double", S.odds("p")) == [None, 1.0]
    assert values(spark, [(1.0,)], "p double", S.from_odds(F.col("p"))) == [0.5]


def test_p_values_against_the_tables(spark):
    """Student's table (two-sided): t with nu degrees of freedom as r = t / sqrt(t^2 + nu); and exact values of the beta function."""
    table = [(1, 12.706205, 0.05), (2, 4.302653, 0.05), (5, 2.570582, 0.05), (10, 3.169273, 0.01), (30, 2.042272, 0.05), (120, 2.617421, 0.01),
             (1000, 1.962339, 0.05), (7, 0.0, 1.0)]
    rows = [(t / (t * t + nu) ** 0.5, nu + 2, p) for nu, t, p in table]
    got = spark.createDataFrame(rows, "r double, n long, p double").select(S.correlation_p(F.col("r"), F.col("n")).alias("q"), "p").collect()
    assert all(abs(r.q - r.p) < 1e-6 for r in got)
    exact = [(0.3, 1.0, 1.0, 0.3), (0.3, 2.0, 1.0, 0.09), (0.3, 1.0, 3.0, 1 - 0.7 ** 3), (0.5, 40.0, 40.0, 0.5), (0.0, 2.0, 3.0, 0.0), (1.0, 2.0, 3.0, 1.0)]
    got = spark.createDataFrame(exact, "x double, a double, b double, s double").select(
        S.beta_share(F.col("x"), F.col("a"), F.col("b")).alias("q"), "s").collect()
    assert all(abs(r.q - r.s) < 1e-10 for r in got)
    assert spark.range(1).select(S.correlation_p(F.lit(0.5), F.lit(2)).alias("p")).first().p is None
