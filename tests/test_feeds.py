"""File readers, live payloads, keyed state and streams."""

import json

import pytest
from pyspark.sql import functions as F

from pitchline import sinks
from pitchline.plans import ratings
from pitchline.sources import batch
from pitchline.sources import feed as feed_source
from pitchline.streaming import jobs, state
from pitchline.streaming.normalize import normalize


def live(spark, *payloads, **kw):
    df = spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "value string")
    return normalize(df, **kw)


def test_minutes_scores_and_types(spark):
    minutes = ["45+2", 90.7, "90:00", "", None, "45+x", True, 12, "7'", {"elapsed": 30}]
    got = live(spark, [{"id": i, "minute": m} for i, m in enumerate(minutes)]).orderBy(F.col("match_id").cast("int")).collect()
    assert [r.minute for r in got] == [47, 90, 9000, None, None, 45, 1, 12, 7, 30]
    assert {r.event_type for r in got} == {"match_snapshot"}
    scores = ["2-1", "x-1", {"home": 0, "away": 1}, {"home_score": 3, "awayScore": "2"}, "2-1-0", None, 5]
    got = live(spark, [{"id": i, "score": s} for i, s in enumerate(scores)]).orderBy("match_id").collect()
    assert [(r.score_home, r.score_away) for r in got] == [(2, 1), (None, 1), (0, 1), (3, 2), (2, None), (None, None), (None, None)]
    kinds = live(spark, [{"id": 1, "type": "GOAL", "xg": "0.5"}, {"id": 2, "type": "", "xg": "a"}, {"id": 3, "event_type": None, "action": "Card",
                 "expectedGoals": 0.25}]).orderBy("match_id").collect()
    assert [(r.event_type, r.xg) for r in kinds] == [("goal", 0.5), ("match_snapshot", None), ("card", 0.25)]


def test_shapes_of_payloads(spark):
    event = {"type": "Goal", "player": 9, "player_in_id": 0, "playerInId": "4"}
    embedded = {"fixtureId": 5, "homeTeamId": 1, "away_id": 2, "score": "1-0", "events": [event, "junk", {"type": "card", "score": "3-3"}]}
    got = live(spark, {"result": {"data": [embedded]}}).orderBy("event_type").collect()
    assert [(r.match_id, r.event_type, r.home_team_id, r.away_team_id, r.score_home, r.score_away, r.player_in_id) for r in got] == [
        ("5", "card", "1", "2", 3, 3, None), ("5", "goal", "1", "2", 1, 0, "4")]
    assert json.loads(got[1].raw.toJson()) == event
    count = lambda *p, **kw: live(spark, *p, **kw).count()
    assert count({"result": None}) == 0 and count("not json") == 0 and count({"a": 1}) == 0 and count([]) == 0
    assert count([{"id": 1}, 2]) == 0                                         # a list counts only when all its items are objects
    assert count([{"id": 1, "events": []}]) == 1 and count([{"id": 1, "events": ["junk"]}]) == 0
    assert count({"matches": [{"id": 1}], "other": [{"id": 2}, {"id": 3}]}) == 3
    assert count({"matches": [{"id": 1}], "other": [{"id": 2}, {"id": 3}]}, repeat_known_keys=True) == 4
    assert live(spark, [{"match_id": None, "game_id": 7}]).first().match_id == "7"


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    lines = [json.dumps([{"id": i, "minute": i, "type": "shot"}]) for i in range(20)] + [""]
    (landing / "a.json").write_text("\n".join(lines[:10]))
    (landing / "b.json").write_text("\n".join(lines[10:]))
    run = lambda cp: jobs.publish(feed_source.stream_payloads(spark, str(landing), 1), str(tmp_path / "raw"), str(tmp_path / "ev"),
                                  str(tmp_path / cp), None).awaitTermination()
    read = lambda: sorted((r.match_id, r.minute) for r in spark.read.json(str(tmp_path / "ev")).collect())
    run("cp")
    want = sorted((r.match_id, r.minute) for r in live(spark, *lines[:20]).collect())
    assert read() == want and spark.read.text(str(tmp_path / "raw")).count() == 20
    run("cp2")
    assert read() == want


def bundle(fid, status, home=(1, 2), away=(3, 4), events=(), league=1, players=False):
    block = lambda team, ids: {"team": {"id": team}, "players": [{"player": {"id": p, "name": f"P{p}"}, "statistics": [
        {"games": {"minutes": 90, "position": "F"}, "goals": {"total": p % 2}}]} for p in ids]}
    return {
        "fixture": {"id": fid, "date": f"2024-01-{fid:02d}", "status": {"short": status, "elapsed": 90}},
        "teams": {"home": {"id": 10, "name": "H"}, "away": {"id": 20, "name": "A"}}, "goals": {"home": fid % 3, "away": 1},
        "league": {"id": league, "season": 2024, "name": "L"},
        "events": [{"time": {"elapsed": m}, "team": {"id": t}, "player": {"id": p}, "type": "Goal"} for m, t, p in events],
        "lineups": [{"team": {"id": 10}, "startXI": [{"player": {"id": p}} for p in home]},
                    {"team": {"id": 20}, "startXI": [{"player": {"id": p}} for p in away]}],
        "statistics": [{"team": {"id": 10}, "statistics": [{"type": "expected_goals", "value": "1.5"}]}],
        "players": [block(10, home), block(20, away)] if players else []}


def polls(spark, tmp_path, name, *documents):
    folder = tmp_path / name
    folder.mkdir()
    for i, (at, bundles) in enumerate(documents):
        (folder / f"{i}.json").write_text(json.dumps({"polled_at": at, "response": bundles}))
    return str(folder)


def test_state_is_replaced_by_key_and_replay_is_idempotent(spark, tmp_path):
    from pitchline import schemas

    root = str(tmp_path / "state")
    load = lambda folder: feed_source.split_polls(spark.read.schema(schemas.POLL).json(folder))
    done = load(polls(spark, tmp_path, "done", ("t0", [bundle(i, "FT", events=[(30, 10, 1)], players=True) for i in range(1, 5)])))
    for _ in range(2):
        assert jobs.sync_finished(root, done["fixtures"], done).first()[0] == 4
        assert state.read_stints(spark, root).count() == 4 * 3 and state.read_player_rows(spark, root).count() == 16
    first = state.read_stints(spark, root).filter("game_id = 1").first()
    assert list(first.home_players) == [1, 2] and first.season == 2024

    # Without line-ups and player blocks the stints and rows of a finished fixture are cleared, others stay.
    empty = bundle(2, "FT", home=(), away=())
    cleared = load(polls(spark, tmp_path, "cleared", ("t1", [empty])))
    jobs.sync_finished(root, cleared["fixtures"], cleared)
    assert state.read_stints(spark, root).filter("game_id = 2").count() == 0
    assert state.read_stints(spark, root).count() == 9 and state.read_player_rows(spark, root).count() == 12

    # Live: fixture 8 is gone in the last poll, fixture 9 has no line-up yet and keeps what it has.
    live_root = polls(spark, tmp_path, "live", ("t2", [bundle(8, "1H"), bundle(9, "1H")]),
                      ("t3", [bundle(9, "1H", home=()), bundle(30, "1H", league=2)]))
    out = str(tmp_path / "out")
    jobs.run_live(feed_source.stream_polls(spark, live_root), root, str(tmp_path / "cp"), out, league_id=1, every=None).awaitTermination()
    fixtures = {r.fixture_id: (r.is_live, r.is_finished) for r in state.read_fixtures(spark, root).collect()}
    assert fixtures == {1: (False, True), 2: (False, True), 3: (False, True), 4: (False, True), 8: (False, False), 9: (True, False)}
    summary = spark.read.json(f"{out}/summary").first()
    assert summary.players_scored == 4 and summary.live_fixtures == 1 and len(summary.top_players) == 4
    rated = spark.read.option("header", True).csv(f"{out}/metrics_current")
    assert rated.count() == 4 and {"rapm", "spm", "bpm", "epm", "rapm_intercept"} <= set(rated.columns)

    # A poll without fixtures clears every live flag of the league.
    none = polls(spark, tmp_path, "none", ("t4", []))
    jobs.run_live(feed_source.stream_polls(spark, none), root, str(tmp_path / "cp2"), None, league_id=1, every=None).awaitTermination()
    assert state.read_fixtures(spark, root).filter("is_live").count() == 0


def test_nothing_stored_is_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError, match="no stints"):
        jobs.current_ratings(spark, str(tmp_path / "nowhere"))


def test_batch_tables(spark, tmp_path):
    for league in ("ENG", "ESP"):
        folder = tmp_path / league
        folder.mkdir()
        (folder / "2324_schedule.csv").write_text("game_id,extra,home_team_id,away_team_id\n1,x,10,20\n")
        (folder / "2324_player_match_stats.csv").write_text("game_id,player_id,player,team_id,position,minutes,red_cards\n1,5,Zoé,10,GK,90,\n1,6,B,20,Sub,nan,1\n")
        (folder / "2324_shot_events.csv").write_text("minute,game_id,team_id,xg,result\n12.0,1,10,0.5,Goal\n,1,20,0.1,Saved\n")
    schedule, players, shots = batch.read_league_seasons(spark, str(tmp_path))
    assert {(r.league, r.season, r.home_team_id) for r in schedule.collect()} == {("ENG", "2324", 10), ("ESP", "2324", 10)}
    assert [(r.player, r.minutes, r.red_cards, r.goals) for r in players.filter("league = 'ENG'").orderBy("player_id").collect()] == [
        ("Zoé", 90.0, None, None), ("B", None, 1.0, None)]
    assert shots.filter("minute = 12").count() == 2
    assert [tuple(r) for r in batch.list_seasons(spark, str(tmp_path)).collect()] == [("ENG", "2324"), ("ESP", "2324")]


def test_match_documents(spark, tmp_path):
    shot = {"player_id": "1", "player": "A", "minute": "12", "X": "0.9", "Y": "bad", "xG": "0.3", "h_goals": "1", "a_goals": "0",
            "result": "Goal", "h_a": "h", "match_id": "7", "lastAction": "Pass", "shotType": "Head", "season": "2024"}
    doc = {"match_id": "7", "shotsData": {"h": [shot], "a": [shot, shot]},
           "rostersData": {"h": {"55": {"player_id": "1", "time": "90", "xG": "0.3"}}, "a": {"56": {"player_id": "2", "time": "10"}}}}
    (tmp_path / "1.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "2.json").write_text(json.dumps({**doc, "match_id": "8", "timelineData": {"a": 1}}))
    (tmp_path / "3.json").write_text("{broken")
    (tmp_path / "4.json").write_text(json.dumps({"match_id": "9", "shotsData": {"h": [shot]}, "rostersData": {"a": {}}}))
    docs = batch.read_match_documents(spark, str(tmp_path / "*.json"))
    assert sorted(r.match_id for r in docs.collect()) == ["7", "9"]
    shots = batch.document_shots(docs).collect()
    assert len(shots) == 4 and shots[0].xg == 0.3 and shots[0].y is None and shots[0].minute == 12
    assert sorted((r.game_id, r.player_id, r.minutes) for r in batch.document_appearances(docs).collect()) == [("7", "1", 90), ("7", "2", 10)]


def test_feed_folders(spark, tmp_path):
    b = bundle(3, "FT", events=[(10, 10, 1), (5, 20, 3)], players=True)
    (tmp_path / "fixtures.json").write_text(json.dumps({"response": [{k: b[k] for k in ("fixture", "teams", "goals", "league")}]}))
    for name in ("events", "lineups", "players", "statistics"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "3.json").write_text(json.dumps({"fixture": 3, "response": b[name]}))
    fixtures = feed_source.read_fixtures(spark, str(tmp_path / "fixtures.json"))
    parts = feed_source.read_bundles(spark, str(tmp_path))
    assert fixtures.first().teams.home.id == 10 and feed_source.of_league(fixtures, 2).count() == 0
    assert [(r.event_pos, r.time.elapsed) for r in parts["events"].orderBy("event_pos").collect()] == [(0, 10), (1, 5)]
    assert parts["players"].count() == 2 and "players" not in feed_source.read_bundles(spark, str(tmp_path), with_players=False)
    (tmp_path / "leagues.json").write_text(json.dumps({"response": [{"league": {"id": 1, "name": "L"}, "country": {"name": "X"},
                                           "seasons": [{"year": 2023, "current": True, "coverage": {"events": True}}]}]}))
    assert feed_source.read_leagues(spark, str(tmp_path / "leagues.json")).first().seasons[0].year == 2023


def test_series_precedence_and_missing_columns(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        batch.read_series(spark, root)
    write = lambda name, column: (tmp_path / name).write_text(f"player_id,player,position,minutes,league,season,{column}\n1,A,GK,900,L,0910,1.5\n")
    write("L_1_epm.csv", "epm")
    write("M_1_epm.csv", "epm")
    assert batch.read_series(spark, root)[1] == "epm"
    epm = batch.read_epm(spark, root)
    assert epm.count() == 2 and epm.first().season == "0910"
    write("epm_translated.csv", "epm_translated")
    assert batch.read_series(spark, root)[1] == "epm_translated"
    write("gpm.csv", "gpm")
    df, column = batch.read_series(spark, root)
    assert column == "gpm" and df.first().gpm == 1.5
    assert batch.read_series(spark, root, "epm_translated")[1] == "epm_translated"
    assert batch.read_series(spark, root, input_file=f"{root}/epm_translated.csv")[1] == "epm_translated"
    with pytest.raises(ValueError):
        batch.read_series(spark, root, "gpm", f"{root}/epm_translated.csv")
    with pytest.raises(ValueError):
        batch.require_columns(epm, {"nope"}, "test")


def test_written_outputs(spark, tmp_path):
    rated = spark.createDataFrame([(1, "A", "GK", 900.0, "L", "S", 0.1, 0.2, 0.3, 0.5), (2, "B", "FW", 90.0, "L", "T", 0.4, 0.1, 0.1, 0.2)],
                                  "player_id bigint, player string, position string, minutes double, league string, season string, "
                                  "rapm double, spm double, bpm double, epm double")
    sinks.write_metric_files(rated, str(tmp_path / "m"), ("rapm", "epm", "nope"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert {(r.metric, r.season, float(r.value)) for r in back.collect()} == {
        ("rapm", "S", 0.1), ("epm", "S", 0.5), ("rapm", "T", 0.4), ("epm", "T", 0.2)}
    stints = spark.createDataFrame([([1, 2],)], "home_players array<bigint>")
    sinks.write_run(rated, stints, rated, rated.limit(1), str(tmp_path / "run"), league_id=1, season=2024)
    meta = spark.read.json(str(tmp_path / "run/metadata")).first()
    assert (meta.players_scored, meta.stints_built, meta.fixtures_used, meta.league_id) == (2, 1, 1, 1)
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "run/stints")).first().home_players == "[1,2]"
    top = ratings.top_report(rated).first()
    assert [p.player_id for p in top.top_players] == [1, 2] and top.top_players[0].epm == 0.5
    sinks.write_translation(rated, rated, None, str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["league_translation"]
    assert json.loads(sinks.as_messages(rated.limit(1), "live-events").first().value)["player"] in ("A", "B")


def test_league_and_season_are_worked_out_once_a_file(spark, tmp_path):
    """Names come from a small table of files, not from the path of every row."""
    from pitchline.sources import batch

    for league, line in (("A+B", "game_id,home_team_id,away_team_id\n1,2,3\n"), ("C", "away_team_id,game_id,home_team_id\n6,4,5\n")):
        (tmp_path / league).mkdir()
        for suffix in ("schedule", "player_match_stats", "shot_events"):
            (tmp_path / league / f"2020_{suffix}.csv").write_text(line)
    schedule = batch.read_league_seasons(spark, str(tmp_path))[0]
    plan = schedule._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "decode" not in plan
    got = sorted((r.league, r.season, r.game_id, r.home_team_id, r.away_team_id) for r in schedule.collect())
    assert got == [("A+B", "2020", 1, 2, 3), ("C", "2020", 4, 5, 6)]
