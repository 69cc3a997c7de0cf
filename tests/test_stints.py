"""Stints on small hand-made matches, and invariants on random ones."""

import random

from pyspark.sql import functions as F

from pitchline.operators import feed, stints
from pitchline.operators.design import CONTEXT, design_long


def tables(spark, players, shots, schedule=((1, 10, 20),)):
    s = spark.createDataFrame([("L", "S", *r) for r in schedule],
                              "league string, season string, game_id bigint, home_team_id bigint, away_team_id bigint")
    p = spark.createDataFrame([("L", "S", *r) for r in players], "league string, season string, game_id bigint, team_id bigint, "
                              "player_id bigint, position string, minutes double, red_cards double")
    t = spark.createDataFrame([("L", "S", *r) for r in shots],
                              "league string, season string, game_id bigint, team_id bigint, minute int, xg double, result string")
    return s, p, t


def rows(df):
    return [(r.start, r.end, list(r.home_players), list(r.away_players), round(r.xg_diff, 9), r.score_diff, r.red_home, r.red_away)
            for r in df.orderBy("game_id", "start").collect()]


def test_one_match(spark):
    players = [(1, 10, 1, "GK", 90.0, 0.0), (1, 10, 2, "FW", 60.0, 0.0), (1, 10, 3, "sub", 30.0, 0.0),
               (1, 20, 4, "GK", 90.0, 0.0), (1, 20, 5, "DF", 70.0, 1.0), (1, 20, 6, "DF", 0.0, 0.0)]
    shots = [(1, 10, 10, 0.5, "GOAL"), (1, 20, 45, 0.25, "Goal"), (1, 10, 60, 0.1, "Saved"), (1, 10, 90, 0.9, "Goal"),
             (1, 20, None, 0.9, "Goal")]
    got = rows(stints.build_stints(*tables(spark, players, shots)))
    assert got == [
        (0, 10, [1, 2], [4, 5], 0.0, 0.0, 0.0, 0.0), (10, 45, [1, 2], [4, 5], 0.5, 0.0, 0.0, 0.0),
        (45, 60, [1, 2], [4, 5], -0.25, 1.0, 0.0, 0.0), (60, 70, [1, 3], [4, 5], 0.1, 0.0, 0.0, 0.0),
        # The shot at the last minute belongs to no stint; the card at 70 counts only for stints that start after 70.
        (70, 90, [1, 3], [4], 0.0, 0.0, 0.0, 0.0)]


def test_minutes_round_half_to_even_and_short_stints_are_dropped(spark):
    players = [(1, 10, 1, "GK", 44.5, 0.0), (1, 10, 2, "FW", 90.0, 0.0), (1, 20, 4, "GK", 95.5, 0.0)]
    s, p, t = tables(spark, players, [])
    assert [r[:2] for r in rows(stints.build_stints(s, p, t))] == [(0, 44), (44, 45), (45, 90)]
    assert [r[:2] for r in rows(stints.build_stints(s, p, t, 2.0))] == [(0, 44), (45, 90)]


def test_a_side_without_players_gives_no_stint(spark):
    s, p, t = tables(spark, [(1, 10, 1, "GK", 90.0, 0.0)], [(1, 20, 5, 0.1, "Goal")])
    assert rows(stints.build_stints(s, p, t)) == []


def test_repeated_player_adds_up_in_the_design(spark):
    players = [(1, 10, 1, "GK", 90.0, 0.0), (1, 10, 1, "GK", 90.0, 0.0), (1, 20, 4, "GK", 90.0, 0.0)]
    out = stints.build_stints(*tables(spark, players, []))
    long = design_long(out, ("league", "season")).filter(~F.col("feature").isin(list(CONTEXT.values())))
    assert {(r.start, r.feature, r.value) for r in long.collect()} == {(0, 1, 2.0), (0, 4, -1.0), (45, 1, 2.0), (45, 4, -1.0)}


def feed_tables(spark, events, home=(1, 2), away=(3, 4), goals=(0, 0), elapsed=90):
    from pitchline import schemas

    fx = spark.createDataFrame([((7, "2024-01-01", ("FT", elapsed)), ((10, "H"), (20, "A")), (float(goals[0]), float(goals[1])),
                                 (1, 2024, "L", "R"))], schemas.FIXTURE)
    st = spark.createDataFrame([], f"fixture_id bigint, stat_pos bigint, {schemas.STATISTIC[7:-1].replace(': ', ' ', 1).replace(', statistics: ', ', statistics ')}")
    ev = spark.createDataFrame(
        [(7, i, (m, x), (t, None), (p,), (a,), k, d) for i, (m, x, t, p, a, k, d) in enumerate(events)],
        "fixture_id bigint, event_pos bigint, time struct<elapsed: int, extra: int>, team struct<id: bigint, name: string>, "
        "player struct<id: bigint>, assist struct<id: bigint>, type string, detail string")
    li = spark.createDataFrame([(7, 0, (10,), [((99,),)]), (7, 1, (10,), [((p,),) for p in home]), (7, 2, (20,), [((p,),) for p in away])],
                               "fixture_id bigint, lineup_pos bigint, team struct<id: bigint>, startXI array<struct<player: struct<id: bigint>>>")
    return fx, st, ev, li


def test_feed_order_within_a_minute(spark):
    events = [
        (45, 2, 10, 1, 5, "subst", "Substitution 1"),     # 1 off, 5 on at 47
        (47, None, 10, 5, None, "Card", "Red Card"),      # and 5 straight off again
        (60, None, 20, 3, None, "Goal", "Own Goal"),      # own goal of the away side counts for home
        (70, None, 20, 3, 3, "subst", "Substitution 2"),  # off and on in one event: stays on
        (80, None, 10, None, None, "card", "Yellow Red Card"),
    ]
    fx, st, ev, li = feed_tables(spark, events, goals=(2, 1))
    got = rows(feed.build_feed_stints(fx, st, ev, li))
    rate = (2 - 1) / 90
    assert got == [
        (0, 45, [1, 2], [3, 4], round(45 * rate, 9), 0.0, 0.0, 0.0), (45, 47, [1, 2], [3, 4], round(2 * rate, 9), 0.0, 0.0, 0.0),
        (47, 60, [2], [3, 4], round(13 * rate, 9), 0.0, 1.0, 0.0), (60, 70, [2], [3, 4], round(10 * rate, 9), 1.0, 1.0, 0.0),
        (70, 80, [2], [3, 4], round(10 * rate, 9), 1.0, 1.0, 0.0), (80, 90, [2], [3, 4], round(10 * rate, 9), 1.0, 2.0, 0.0)]


def test_presence_against_a_fold_over_the_events(spark):
    """Random substitutions and cards: the interval form equals adding and discarding ids event by event."""
    rng = random.Random(5)
    for _ in range(4):
        events = []
        for _ in range(40):
            kind = rng.choice(["subst", "Card", "Goal"])
            events.append((rng.randint(0, 89), None, rng.choice([10, 20]), rng.choice([None, *range(1, 9)]),
                           rng.choice([None, *range(1, 9)]), kind, "Red Card" if kind == "Card" else "Normal Goal"))
        fx, st, ev, li = feed_tables(spark, events)
        sides = {10: {1, 2}, 20: {3, 4}}
        score, red = {10: 0, 20: 0}, {10: 0, 20: 0}
        start, want = 0, []
        for minute in sorted({45, 90, *[e[0] for e in events]}):
            if minute - start >= 1 and sides[10] and sides[20]:
                want.append((start, minute, sorted(sides[10]), sorted(sides[20]), 0.0, float(score[10] - score[20]), float(red[10]), float(red[20])))
            for m, _, team, player, other, kind, _ in events:
                if m != minute:
                    continue
                if kind == "Goal":
                    score[team] += 1
                elif kind == "Card":
                    red[team] += 1
                    sides[team].discard(player)
                else:
                    sides[team].discard(player)
                    if other is not None:
                        sides[team].add(other)
            start = minute
        assert rows(feed.build_feed_stints(fx, st, ev, li)) == want


def test_durations_and_xg_are_kept_whole(spark):
    rng = random.Random(3)
    players = [(g, t, t * 100 + k, "FW", 90.0, 0.0) for g in (1, 2) for t in (10, 20) for k in range(3)]
    shots = [(g, rng.choice([10, 20]), rng.randint(0, 89), rng.random(), "Saved") for g in (1, 2) for _ in range(30)]
    out = stints.build_stints(*tables(spark, players, shots, ((1, 10, 20), (2, 10, 20)))).groupBy("game_id").agg(
        F.sum("duration").alias("d"), F.sum("xg_diff").alias("x")).collect()
    for r in out:
        want = sum(x if t == 10 else -x for g, t, _, x, _ in shots if g == r.game_id)
        assert r.d == 90 and abs(r.x - want) < 1e-9


def test_squads_in_a_row_give_the_stints_of_single_rows(spark):
    """Line-ups taken once a span and minutes told apart inside a game's row: the same stints as from one row per appearance."""
    draw = random.Random(5)
    of = lambda n, *options: [draw.choice(options) for _ in range(n)]
    players = [("L", "S", g, team, 100 * team + k, *of(1, None, 0.0, 0.4, 20.5, 45.0, 70.0, 90.0, 97.0), *of(1, "Sub", "sub", "FW", None),
                *of(1, None, 0.0, 1.0)) for g in (1, 2, 3, None) for team in (10, 20, 30, None) for k in range(9) if team is not None]
    players += players[:5]
    shots = [("L", "S", g, team, *of(1, None, -1, 0, 12, 44, 45, 88, 93, 140), draw.random(), *of(1, "Goal", "goal", "Saved", None))
             for g in (1, 2, 4, None) for team in (10, 20, 30) for _ in range(12)]
    p = spark.createDataFrame(players, "league string, season string, game_id bigint, team_id bigint, player_id bigint, minutes double, "
                                       "position string, red_cards double")
    t = spark.createDataFrame(shots, "league string, season string, game_id bigint, team_id bigint, minute int, xg double, result string")
    once = [("L", "S", 1, 10, 20), ("L", "S", 2, 20, 10), ("L", "S", 3, 10, 20), ("L", "S", 4, 10, 20), ("L", "S", None, 10, 20)]
    text = lambda df: sorted(str([(c, round(v, 9) if isinstance(v, float) else v) for c, v in r.asDict().items()]) for r in df.collect())
    for listed in (once, once + once[:1]):
        s = spark.createDataFrame(listed, "league string, season string, game_id bigint, home_team_id bigint, away_team_id bigint")
        by_minute = stints.shots_by_minute(t)
        ends = stints.match_ends(s, p, by_minute)
        intervals = stints.player_intervals(p, ends)
        segments = stints.cut_stints(ends, stints.boundary_deltas(ends, intervals, by_minute))
        want = stints.lineups_from_squads(segments, stints.squads(intervals))
        got = stints.build_stints(s, p, t)
        assert got.columns == want.columns and text(got) == text(want) and got.count() > 0
        games = stints.squads_of_games(s, p, by_minute)
        assert text(games.drop("intervals")) == text(ends)
        per_game = stints.lineup_spans(games).groupBy("game_id").count().collect()
        assert all(r["count"] < 18 for r in per_game)
