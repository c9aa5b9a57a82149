"""Declared metadata read from files, column checks and exports of stages and books."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tideline.operators import membership as m
from tideline.operators import quality as q
from tideline.operators.ledger import LedgerOptions
from tideline.operators.robustness import neighbour_scores, robustness, winner_scores
from tideline.operators.search import development_bars, evaluate_grid
from tideline.sources import manifests, sinks

GOOD = {"schema_version": 1, "dataset_id": "eod-1", "ticker": "AAA", "source": "a vendor", "license": "CC0", "currency": "USD", "calendar": "exchange",
        "frequency": "1d", "price_adjustment": "split_adjusted", "csv_file": "aaa.csv", "sha256": "0" * 64, "annualization": 252}


def write(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(content, indent=1))


def test_dataset_manifests(spark, tmp_path):
    bad = {"schema_version": 2, "dataset_id": "no spaces", "ticker": "aaa", "currency": "usd", "calendar": "moon", "frequency": "1h",
           "price_adjustment": "guessed", "annualization": 367, "csv_file": "../aaa.csv", "sha256": "ABC"}
    write(tmp_path / "sets", "good.json", GOOD)
    for field, value in bad.items():
        write(tmp_path / "sets", f"{field}.json", {**GOOD, field: value, "license": field})
    for field in ("source", "license"):
        for i, value in enumerate((" padded", "", "tab\there", None)):
            write(tmp_path / "sets", f"{field}{i}.json", {**GOOD, field: value, "dataset_id": f"text-{field}-{i}"})
    rows = manifests.read_dataset_manifests(spark, str(tmp_path / "sets")).collect()
    assert len(rows) == 1 + len(bad) + 8
    for r in rows:
        want = ["text"] if r.dataset_id and r.dataset_id.startswith("text-") else [] if r.license == "CC0" else [r.license]
        assert r.problems == want, r
    (tmp_path / "sets" / "broken.json").write_text('{"schema_version": 1,')
    with pytest.raises(Exception):
        manifests.read_dataset_manifests(spark, str(tmp_path / "sets")).collect()


def test_membership_file_to_eligibility(spark, tmp_path):
    day = lambda n: f"2020-01-{n:02d}"
    write(tmp_path / "members", "index.json", {
        "schema_version": 1, "universe_id": "u", "source": "s", "license": "l", "coverage_start": day(1), "coverage_end": day(31), "initial_known_on": day(1),
        "initial_members": ["aaa"], "events": [{"ticker": "bbb", "known_on": day(3), "effective_on": day(5), "action": "add"},
                                               {"ticker": "AAA", "known_on": day(6), "effective_on": day(8), "action": "remove"},
                                               {"ticker": "bbb", "known_on": day(12), "effective_on": day(10), "action": "add"}]})
    manifest = manifests.read_membership(spark, str(tmp_path / "members"))
    events, opening = manifests.membership_events(manifest), manifests.membership_opening(manifest)
    assert [(r.universe_id, r.ticker) for r in opening.collect()] == [("u", "AAA")]
    assert {(r.ticker, r.effective_on.day, tuple(r.problems)) for r in m.event_problems(events, opening).collect()} == {("BBB", 10, ("retroactive", "redundant"))}
    sessions = spark.createDataFrame([(t, dt.date(2020, 1, n)) for t in ("AAA", "BBB") for n in (2, 6, 7, 9)], "ticker string, date date")
    sound = events.where("effective_on < '2020-01-10'")
    got = {(r.ticker, r.date.day) for r in m.eligibility(sessions, sound, opening).where("eligible").collect()}
    assert got == {("AAA", 2), ("AAA", 6), ("AAA", 7), ("BBB", 6), ("BBB", 7), ("BBB", 9)}
    assert m.coverage_problems(sessions, sound, opening, "2020-01-01", "2020-01-08").first().problem == "coverage"


def test_calendar_file_to_missing_sessions(spark, tmp_path):
    write(tmp_path / "cal", "x.json", {"schema_version": 1, "calendar_id": "X", "source": "s", "license": "l", "coverage_start": "2020-01-01",
                                       "coverage_end": "2020-01-31", "sessions": ["2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07"]})
    calendar = manifests.read_calendar(spark, str(tmp_path / "cal"))
    assert calendar.count() == 4 and {r.calendar_id for r in calendar.collect()} == {"X"}
    bars = spark.createDataFrame([("AAA", dt.date(2020, 1, n), 1.0) for n in (2, 4, 7)], "ticker string, date date, volume double")
    ask = bars.select("ticker").distinct().withColumns({"start": F.lit(None).cast("date"), "end": F.lit(None).cast("date")})
    meta = q.asset_metadata(bars, ask).withColumns({"calendar": F.lit("exchange"), "calendar_id": F.lit("X")})
    expected = q.expected_sessions(meta, calendar)
    assert sorted(r.date.day for r in q.missing_sessions(expected, bars).collect()) == [3, 6]
    assert [r.date.day for r in q.unexpected_sessions(expected, bars, meta).collect()] == [4]
    assert q.expected_sessions(meta.withColumn("calendar_id", F.lit("Y")), calendar).count() == 0


def test_column_problems():
    assert q.column_problems([" Date", "OPEN", "high", "low", "close", "ticker"]) == {"missing": [], "unknown": [], "duplicate": []}
    assert q.column_problems(["date", "Date ", "open", "high", "low", "extra"]) == {"missing": ["close"], "unknown": ["extra"], "duplicate": ["date"]}
    assert q.column_problems(["date", "open", "high", "low", "close", "vwap"], optional=("vwap",))["unknown"] == []


def test_stage_export_is_ordered_and_never_overwrites(spark, tmp_path):
    rows = [(s, n, json.dumps({"a": i}), [0.5, None], float(i)) for i, (s, n) in enumerate([(2, "b"), (0, "b"), (1, "a"), (0, "a"), (0, "a")])]
    stages = spark.createDataFrame(rows, "stage int, strategy string, params string, folds array<double>, score double")
    path = str(tmp_path / "stages")
    sinks.export_stages(stages, path)
    files = sorted((tmp_path / "stages").glob("part-*.csv"))
    back = [r for f in files for r in spark.read.option("header", True).option("escape", '"').csv(str(f)).collect()]
    keys = [(r.stage, r.strategy) for r in back]
    assert keys == sorted(keys) and len(keys) == 5 and {json.dumps(json.loads(r.folds)) for r in back} == {"[0.5, null]"}
    with pytest.raises(Exception):
        sinks.export_stages(stages, path)


def test_book_export(spark, tmp_path):
    nav = spark.createDataFrame([("s", dt.date(2020, 1, 2), 1.0)], "book string, date date, nav double")
    legs = spark.createDataFrame([("s", dt.date(2020, 1, 2), t, w) for t, w in (("A", 0.25), ("B", 0.75))], "book string, date date, ticker string, weight double")
    folder = str(tmp_path / "book")
    sinks.export_book({"nav": nav, "legs": legs}, folder)
    assert spark.read.parquet(f"{folder}/nav").collect() == nav.collect()
    assert spark.read.parquet(f"{folder}/legs").exceptAll(legs).count() == 0
    wide = sinks.wide(spark.read.parquet(f"{folder}/legs"), "weight", ["A", "B", "C"]).first()
    assert (wide.A, wide.B, wide.C) == (0.25, 0.75, None)
    with pytest.raises(Exception):
        sinks.export_book({"nav": nav}, folder)


def test_robustness_around_each_tickers_own_winner(spark, walk):
    """Equal to the neighbours of one set at a time, for tickers with different and with shared sets."""
    bars, _ = walk
    opts = LedgerOptions(cost_bps=1, execution_lag=1)
    dev = development_bars(bars, opts)
    results = evaluate_grid(dev, "ma_cross", opts, {"fast": [3, 5], "slow": [20, 21]}, smooth=[0])
    sets = {r.params: json.loads(r.params) for r in results.select("params").distinct().collect()}
    a, b = sorted(sets)[0], sorted(sets)[-1]
    plain = {p: {(r.ticker, r.params): (r.baseline, r.val_sharpe) for r in neighbour_scores(dev, "ma_cross", sets[p], opts).collect()} for p in (a, b)}
    for chosen in ({"AAA": a, "BBB": b}, {"AAA": b, "BBB": b}):
        winners = spark.createDataFrame([(t, "ma_cross", p, 1) for t, p in chosen.items()] + [("AAA", "tsmom", "{}", 2)], "ticker string, strategy string, params string, rank int")
        scores = winner_scores(dev, winners, "ma_cross", opts)
        got = {(r.ticker, r.params): (r.baseline, r.val_sharpe) for r in scores.collect()}
        assert got == {key: v for t, p in chosen.items() for key, v in plain[p].items() if key[0] == t}
        assert robustness(scores).count() == 2
    assert winner_scores(dev, winners, "macd", opts).count() == 0
