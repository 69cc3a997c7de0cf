"""Nothing is lost or swapped: keyed state under corrections and failures, readers of uneven files, scratch tables, scans."""

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pitchline import schemas, session
from pitchline.operators import shots as shot_ops
from pitchline.plans import chance_quality, finishing
from pitchline.sources import batch, quality
from pitchline.streaming import state, windows


def records(spark, rows):
    """(fixture, league, season, status, second) as state rows."""
    full = [(f, None, s, None, None, None, None, None, None, None, None, None, True, False, datetime(2024, 1, 1, 0, 0, t), lg, se)
            for f, lg, se, s, t in rows]
    return spark.createDataFrame(full, schemas.STATE_FIXTURES)


def stored(spark, root):
    return sorted(((r.fixture_id, r.league_id, r.season, r.status) for r in state.read_fixtures(spark, root).collect()), key=str)


def test_corrected_and_unassigned_fixtures(spark, tmp_path):
    root = str(tmp_path)
    state.upsert_fixtures(root, records(spark, [(1, None, None, "FT", 1), (2, 5, 2024, "1H", 1), (4, 5, 2024, "FT", 1)]))
    state.upsert_fixtures(root, records(spark, [(3, None, 2024, "NS", 2), (2, 6, 2024, "2H", 2), (2, 6, 2024, "FT", 3)]))
    state.upsert_fixtures(root, records(spark, [(5, None, None, "NS", 2)]))
    assert stored(spark, root) == sorted([(1, None, None, "FT"), (2, 6, 2024, "FT"), (3, None, 2024, "NS"), (4, 5, 2024, "FT"),
                                          (5, None, None, "NS")], key=str)
    state.upsert_fixtures(root, records(spark, [(2, 6, 2024, "FT", 3)]))
    assert len(stored(spark, root)) == 5
    state.mark_not_live(root, spark.createDataFrame([(2,)], "fixture_id long"))
    assert {r.fixture_id for r in state.read_fixtures(spark, root).filter("is_live").collect()} == {2}
    state.mark_not_live(root, spark.createDataFrame([], "fixture_id long"))
    assert state.read_fixtures(spark, root).filter("is_live").count() == 0 and len(stored(spark, root)) == 5


def test_other_partitions_are_left_alone(spark, tmp_path):
    root = str(tmp_path)
    state.upsert_fixtures(root, records(spark, [(1, 5, 2024, "1H", 1), (2, 6, 2024, "1H", 1)]))
    files = lambda league: sorted(x.name for x in (tmp_path / "fixtures").glob(f"league_id={league}/season=2024/*.parquet"))
    before = files(5), files(6)
    state.upsert_fixtures(root, records(spark, [(2, 6, 2024, "FT", 2)]))
    assert files(5) == before[0] and files(6) != before[1]
    state.upsert_fixtures(root, records(spark, [(2, 7, 2024, "FT", 3)]))        # league 6 keeps no fixture
    assert stored(spark, root) == [(1, 5, 2024, "1H"), (2, 7, 2024, "FT")]


def test_same_time_has_one_winner(spark):
    twice = records(spark, [(1, 5, 2024, "1H", 1), (1, 5, 2024, "2H", 1)])
    assert [r.status for r in state.latest(twice.repartition(2)).collect()] == ["2H"]
    assert [r.status for r in state.latest(twice.orderBy(F.desc("status")).coalesce(1)).collect()] == ["2H"]


def test_failed_write_leaves_the_old_state(spark, tmp_path):
    root = str(tmp_path)
    state.upsert_fixtures(root, records(spark, [(1, 5, 2024, "1H", 1)]))
    broken = records(spark, [(1, 5, 2024, "FT", 2), (2, 5, 2024, "FT", 2)]).withColumn(
        "home_name", F.when(F.col("fixture_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("home_name")))
    with pytest.raises(Exception, match="lost"):
        state.upsert_fixtures(root, broken)
    assert stored(spark, root) == [(1, 5, 2024, "1H")]


def test_overlapping_scratch_blocks_keep_to_themselves(spark):
    first_written, second_done, out = threading.Event(), threading.Event(), {}

    def first():
        with session.scratch(spark):
            table = session.materialize(spark.range(10), "first")
            first_written.set()
            second_done.wait(60)
            out["rows"] = table.count()

    def second():
        first_written.wait(60)
        with session.scratch(spark):
            session.materialize(spark.range(5), "second")
        second_done.set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert out == {"rows": 10}


def test_tables_are_joined_by_column_name(spark, tmp_path):
    league = tmp_path / "ESP-La Liga+1"
    league.mkdir()
    (league / "2000_2001_schedule.csv").write_text("game_id,home_team_id,away_team_id\n1,10,20\n2,11,21\n")
    (league / "2001_2002_schedule.csv").write_text("away_team_id,game_id,extra,home_team_id\n2,77,x,66\n")
    for season in ("2000_2001", "2001_2002"):
        (league / f"{season}_player_match_stats.csv").write_text("player_id,game_id\n1,1\n")
        (league / f"{season}_shot_events.csv").write_text("xg,game_id\nNaN,1\n0.5,2\n")
    schedule, players, shots = batch.read_league_seasons(spark, str(tmp_path))
    assert sorted(tuple(r) for r in schedule.collect()) == [
        ("ESP-La Liga+1", "2000_2001", 1, 10, 20), ("ESP-La Liga+1", "2000_2001", 2, 11, 21), ("ESP-La Liga+1", "2001_2002", 77, 66, 2)]
    assert {(r.league, r.season) for r in batch.list_seasons(spark, str(tmp_path)).collect()} == {
        (r.league, r.season) for r in players.collect()}
    assert sorted((r.game_id, r.xg) for r in shots.filter("season = '2000_2001'").collect()) == [(1, None), (2, 0.5)]


def test_ratings_are_joined_by_column_name(spark, tmp_path):
    (tmp_path / "a_epm.csv").write_text("player_id,player,position,minutes,league,season,epm\n1,A,FW,900,x,2000_2001,0.25\n")
    (tmp_path / "b_epm.csv").write_text("epm,season,league,minutes,player_id\n0.5,2001_2002,y,450,2\n")
    got = sorted(tuple(r) for r in batch.read_epm(spark, str(tmp_path)).collect())
    assert got == [(1, "A", "FW", 900.0, "x", "2000_2001", 0.25), (2, None, None, 450.0, "y", "2001_2002", 0.5)]


def scans(spark, run):
    """How often rows leave the counted source while ``run`` builds and executes its plan."""
    counter = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            counter.add(b.num_rows)
            yield b

    rows = [(1, 1, 1, "h", "Goal" if i % 3 == 0 else "Miss", f"S{i % 4}", 0.1 + i % 5 / 10, 1 + i % 2, f"P{1 + i % 2}", "A", "B",
             "leading" if i % 2 else "trailing", int(i % 3 == 0)) for i in range(60)]
    schema = "game_id int, home_team_id int, away_team_id int, h_a string, result string, situation string, xg double, player_id int, " \
             "player string, kicker_team string, conceded_team string, game_state string, result_boolean int"
    source = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    run(source).collect()
    return counter.value / 60


def test_sources_are_scanned_once_per_use(spark):
    assert scans(spark, chance_quality.by_situation) == 1
    assert scans(spark, chance_quality.by_scoreline) == 1
    assert scans(spark, lambda s: finishing.true_xg_by_player(finishing.true_xg_shots(s))) == 2

    def teams(s):
        counts = shot_ops.counts_by(s)
        rated, totals = finishing.true_xg_shots(s, counts), shot_ops.totals_of(counts)
        pairs = finishing.team_pairs(rated)
        return finishing.team_true_xg(finishing.adjusted_pairs(
            s, finishing.team_skill(pairs, totals), finishing.team_skill(pairs, totals, "conceded_team")))

    assert scans(spark, teams) == 3


def test_headers_are_found_without_the_driver(spark, tmp_path, monkeypatch):
    """Many files of several headers: one text scan for the headers, one scan for the rows, quoted names and values, empty files."""
    for i in range(40):
        body = {0: "a,b\n{},x\n", 1: "b,a\ny,{}\n", 2: '"a","c, d"\n{},"q, ""r"""\n', 3: ""}[i % 4].format(i)
        (tmp_path / f"f{i:02d}.csv").write_text(body)
    (tmp_path / "g.csv").write_text("﻿b,a,z\n\n1,2\n3,4,5,6\n")
    monkeypatch.setattr(batch, "_exists", None)
    got = batch.read_text_tables(spark, f"{tmp_path}/*.csv")
    assert set(got.columns) == {"a", "b", "c, d", "z", "file"}
    rows = {(r.a, r.b, r["c, d"], r.z) for r in got.collect()}
    want = {(str(i), "x", None, None) for i in range(0, 40, 4)} | {(str(i), "y", None, None) for i in range(1, 40, 4)}
    assert rows == want | {(str(i), None, 'q, "r"', None) for i in range(2, 40, 4)} | {("2", "1", None, None), ("4", "3", None, "5")}
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "e.csv").write_text("")
        batch.read_text_tables(spark, f"{tmp_path}/none/*.csv")


def test_losses_are_counted_in_a_stream(spark, tmp_path):
    for k, lines in enumerate((["1", "x", " "], ["2", "3", "y", "z"])):
        (tmp_path / f"in{k}.txt").write_text("\n".join(lines))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in*.txt"))
    typed = quality.counted_casts(stream, {"value": "int"}, "casts")
    query = typed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")) \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [p.observedMetrics["casts"] for p in query.recentProgress if "casts" in p.observedMetrics]
    assert sum(s.rows for s in seen) == 7 and sum(s.bad_value for s in seen) == 3 and sum(s.none_value for s in seen) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_state_of_closed_windows_shrinks(spark, tmp_path):
    """Rows on both sides of the watermark; closed windows leave the state, late rows don't come back."""
    minutes = [[0, 5, 20], [60, 70, 1], [300, 310], [900, 2]]            # 1 comes in time, 2 too late
    for k, batch_ in enumerate(minutes):
        rows = [(f"m{k}", datetime(2024, 1, 1 , m // 60, m % 60), 1.0) for m in batch_]
        spark.createDataFrame(rows, "match_id string, ts timestamp, xg double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("match_id string, ts timestamp, xg double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windows.to_table(windows.windowed_xg(stream, "15 minutes", None, "ts"), str(tmp_path / "out"), str(tmp_path / "cp"), None)
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    late = sum(p.stateOperators[0].numRowsDroppedByWatermark for p in query.recentProgress)
    got = {(r.match_id, r.window_start.hour * 60 + r.window_start.minute): r.events for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert late == 1 and held[-1] == 1 and max(held) > 1
    assert got == {("m0", 0): 2, ("m0", 15): 1, ("m1", 0): 1, ("m1", 60): 2, ("m2", 300): 2}


def test_spell_state_is_read_and_written_once_a_batch():
    """Each access of state is a message to the executor: their number must not grow with the polls of a batch."""
    import pandas as pd

    from pitchline.streaming.live_state import _Spells

    class Store:
        def __init__(self):
            self.value, self.calls = None, 0

        def __getattr__(self, name):
            def call(*given):
                self.calls += 1
                if name in ("update", "put"):
                    self.value = given[0]
                elif name == "appendValue":
                    self.value = [*(self.value or []), given[0]]
                elif name == "clear":
                    self.value = None
                elif name == "exists":
                    return self.value is not None
                elif name == "listTimers":
                    return []
                return self.value if name == "get" and self is handle.spell else iter(self.value or []) if name == "get" else None
            return call

    class Handle(Store):
        spell, kinds = Store(), Store()
        getValueState = lambda self, *_: self.spell
        getListState = lambda self, *_: self.kinds

    handle = Handle()
    work = _Spells(1000)
    work.init(handle)
    at = [*range(0, 50 * 10**5, 10**5), 10**8, 10**8 + 5]
    polls = pd.DataFrame({"at": at, "poll_id": range(len(at)), "kind": ["a", "b"] * 26, "xg": [0.5] * len(at)})
    out = pd.concat(list(work.handleInputRows((3,), iter([polls.iloc[30:], polls.iloc[:30]]), None)))
    assert out[["fixture_id", "polls", "xg", "kinds"]].values.tolist() == [[3, 50, 25.0, "a,b"]]
    assert handle.spell.value == (10**8, 10**8 + 5, 2, 1.0) and handle.kinds.value == [("a",), ("b",)]
    assert handle.calls + handle.spell.calls + handle.kinds.calls <= 8


def test_members_are_read_once_an_object(spark, monkeypatch):
    """Items and events go on with the members that were read when they were found to be objects."""
    from pitchline.streaming import normalize as N

    calls, members = [], N.members
    monkeypatch.setattr(N, "members", lambda v: calls.append(v) or members(v))
    payloads = spark.createDataFrame([('{"matches":[{"id":1,"score":null,"events":[{"minute":3,"team":null},7,{"minute":"45+2"}]},{"id":2,"minute":5}]}',),
                                      ('[{"id":3,"events":[]}]',)], "value string")
    events = N.normalize(payloads)
    assert len(calls) == 7             # payload, body, its lists or itself, embedded events, two scores
    got = sorted((r.match_id, -1 if r.minute is None else r.minute) for r in events.select("match_id", "minute").collect())
    assert got == [("1", 3), ("1", 47), ("2", 5), ("3", -1)]
