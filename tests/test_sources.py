"""Readers on small inline files, table merges and the registry."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException

from contestry.sources import feed, rating_history, results, schedule, tables

HEAD = "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HS,AS,B365H,B365D,B365A,AvgCH,AvgCD,AvgCA"


def write(tmp_path, name, text, encoding="latin-1"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_results_file(spark, tmp_path):
    path = write(tmp_path, "a.csv", f"{HEAD}\nX,18/08/2018,Málaga,Barça,1,2.0,A,10,,1.5,3.3,4.6,1.4,,4\nX,19/08/18,B,C,0,0,D,1,2,,,,1.4,3,4\n,,,,,,,,,,,,,,\n")
    raw = results.read_results(spark, path)
    rows = results.parse_results(raw).orderBy("date").collect()
    assert [(r["home_name"], r["away_goals"], str(r["date"]), r["away_shots"]) for r in rows] == [
        ("Málaga", 2, "2018-08-18", None), ("B", 0, "2018-08-19", 2)]
    prices = {(r["HomeTeam"], r["bookmaker"]): r for r in results.price_rows(raw, ("HomeTeam",)).collect()}
    assert set(prices) == {("Málaga", "bet365"), ("B", "market_avg")}
    assert prices[("Málaga", "bet365")]["open_d"] == 3.3 and prices[("B", "market_avg")]["open_h"] is None
    assert results.invalid_results(raw).count() == 0


def test_results_files_with_different_headers(spark, tmp_path):
    short = HEAD.replace(",AvgCH,AvgCD,AvgCA", "").replace("Date,", "Date,Time,")
    paths = [
        write(tmp_path, "old season.csv", f"{HEAD}\nX,18/08/2018,A,B,1,2,A,10,,1.5,3.3,4.6,1.4,,4\n"),
        write(tmp_path, "new.csv", f"{short}\nX,19/08/2019,20:00,C,D,3,0,H,7,8,2.5,3.0,2.6\n"),
        write(tmp_path, "same.csv", f"{HEAD}\nX,20/08/2018,E,F,0,0,D,1,2,,,,,,\n"),
    ]
    raw = results.read_results(spark, paths)
    rows = {(r["home_name"], r["home_goals"], r["away_shots"]) for r in results.parse_results(raw).collect()}
    assert rows == {("A", 1, None), ("C", 3, 8), ("E", 0, 2)}
    prices = {(r["HomeTeam"], r["open_h"], r["close_h"]) for r in results.price_rows(raw, ("HomeTeam",)).filter("bookmaker = 'bet365'").collect()}
    assert prices == {("A", 1.5, None), ("C", 2.5, None)}


def test_results_file_fails_loudly(spark, tmp_path):
    with pytest.raises(results.LayoutError):
        results.read_results(spark, write(tmp_path, "b.csv", "Date,HomeTeam\n1,2\n"))
    bad = results.read_results(spark, write(tmp_path, "c.csv", f"{HEAD}\nX,someday,A,B,1,2,A,,,,,,,,\n"))
    assert results.invalid_results(bad).count() == 1
    with pytest.raises(PySparkException):
        results.parse_results(bad).collect()
    with pytest.raises(results.LayoutError):
        results.require_rows(bad.limit(0), "nothing there")


def page(rows):
    cells = ("gameweek", "date", "home_team", "home_xg", "score", "away_xg", "away_team")
    body = "".join("<tr>" + "".join(f'<td class="x" data-stat="{n}"><a href="#">{v}</a></td>' for n, v in zip(cells, r)) + "</tr>\n" for r in rows)
    return f'<table id="other"><tbody><tr><td data-stat="score">9–9</td></tr></tbody></table><table class="s" id="sched_1"><tbody>\n{body}</tbody></table>'


def test_schedule_page(spark):
    html = page([("1", "2018-08-18", "M&aacute;laga", "1.2", "1–2", "2.0", "B"), ("", "", "", "", "", "", ""),
                 ("2", "2019-05-01", "C", "", "", "", "D"), ("", "2018-08-20", "E", "", "3-0", "", "F")])
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = schedule.parse_schedule(df, ("page_id",)).orderBy("date").collect()
    assert [(r["matchday"], r["home_name"], r["home_goals"], r["away_goals"], r["home_xg"]) for r in rows] == [
        (1, "Málaga", 1, 2, 1.2), (None, "E", 3, 0, None)]
    odd = spark.createDataFrame([(1, page([("1", "2018-08-18", "A", "", "walkover", "", "B")]))], df.schema)
    with pytest.raises(PySparkException):
        schedule.parse_schedule(odd).collect()
    assert schedule.pages_without_schedule(spark.createDataFrame([(2, "<p>blocked</p>")], df.schema), ("page_id",)).count() == 1


def test_best_snapshot(spark):
    rows = [("p", f"2020010100000{i}", i == 2, i != 9) for i in range(10)]
    snaps = spark.createDataFrame(rows, "page string, stamp string, has_xg boolean, usable boolean")
    assert schedule.best_snapshot(snaps, ["page"]).first()["stamp"] == "20200101000002"
    far = spark.createDataFrame([("p", f"2020010100000{i}", i == 1, i != 9) for i in range(10)], snaps.schema)
    assert schedule.best_snapshot(far, ["page"], 8).first()["stamp"] == "20200101000008"  # of the eight newest


def test_feed_envelopes(spark):
    e = {"id": 5, "isResult": True, "h": {"title": "A"}, "a": {"title": "B"}, "goals": {"h": "1", "a": "2"}, "xG": {"h": "1.25", "a": "0.5"}, "datetime": "2018-08-18 18:00:00"}
    future = {**e, "isResult": False, "goals": {"h": None, "a": None}}
    docs = [json.dumps([e, future]), json.dumps({"datesData": [e]}), json.dumps({"dates": [e], "x": 1})]
    df = spark.createDataFrame([(d,) for d in docs], "text string")
    rows = feed.parse_feed(df).collect()
    assert len(rows) == 3 and {(r["home_goals"], r["away_xg"], r["feed_id"]) for r in rows} == {(1, 0.5, "5")}
    bad = spark.createDataFrame([('{"nope": 1}',)], "text string")
    assert feed.feeds_without_list(bad, ()).count() == 1
    with pytest.raises(PySparkException):
        feed.parse_feed(bad).collect()


def test_rating_history(spark, tmp_path):
    head = "Rank,Club,Country,Level,Elo,From,To\n"
    write(tmp_path, "A.csv", head + "None,A,X,1,1520,2018-05-01,2018-06-30\nNone,A,X,1,1550.5,2018-07-01,2018-08-19\n")
    write(tmp_path, "B.csv", head)
    raw = rating_history.read_rating_history(spark, str(tmp_path))
    assert [(r["club"], r["rating"]) for r in rating_history.parse_rating_history(raw, "2018-07-01").collect()] == [("A", 1550.5)]
    expected = spark.createDataFrame([("A",), ("B",)], "club string")
    assert [r[0] for r in rating_history.clubs_without_history(raw, expected).collect()] == ["B"]


def test_merge_rows_keeps_old_values_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "id int, s string, x double")
    new = spark.createDataFrame([(1, None, 2.0, 1), (1, "c", None, 2), (3, "d", 3.0, 1)], "id int, s string, x double, seq int")
    once = tables.merge_rows(old, new, ["id"], "seq")
    want = {(1, "c", 2.0), (2, "b", None), (3, "d", 3.0)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in tables.merge_rows(once, new, ["id"], "seq").collect()} == want


def test_registry_and_gate(spark):
    rows = [("v1", "2020-01-01", '{"reference_logloss": 1.0}'), ("v2", "2020-02-01", '{"reference_logloss": 0.9, "promoted": false}')]
    reg = spark.createDataFrame(rows, "model_version string, trained_at string, metrics_json string")
    assert tables.latest_promoted(reg).first()["model_version"] == "v1"
    cand = spark.createDataFrame([("ok", 1.1), ("bad", 1.1001)], "name string, val_loss double")
    got = {r["name"]: r["promoted"] for r in tables.promotion_gate(cand, reg, 0.10).collect()}
    assert got == {"ok": True, "bad": False}
    assert tables.promotion_gate(cand, reg.limit(0), 0.10).filter("promoted").count() == 2
