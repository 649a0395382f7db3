"""The registered queries: each runs one operator over the whole adapted tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contestry.functions import columns as C
from contestry.functions.bounded import materialise, scratch_dir
from contestry.operators import aggregates as agg
from contestry.operators import form, joins, keys, odds, selection
from contestry.plans.adapt import CURRENT_SEASON, ContestTables, demo_settings
from contestry.settings import LeagueSettings
from contestry.sources import feed, rating_history, results, schedule, tables, versions

Query = Callable[[ContestTables], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query):
        return lambda spark, folder: fn(ContestTables(spark, folder))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Rounds doubles for comparison; adding zero turns a negative zero into zero."""
    return df.withColumns({n: F.round(n, places) + F.lit(0.0) for n in names})


_CACHE: dict[tuple, object] = {}


def _once(t: ContestTables, name: str, build):
    """Model inputs shared by several queries of one session are written once, as long as the data stay the same."""
    key = (t.spark.sparkContext.applicationId, t.folder, t.version(), name)
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


SETTINGS = demo_settings()
SMALL_LEAGUE = LeagueSettings(teams_per_season=25)


def with_matchdays(t: ContestTables) -> DataFrame:
    c = t.contests()
    return c.join(form.counted_matchdays(c), "match_id")


# --- sources and sinks -------------------------------------------------------------------------


def _result_file_rows(t: ContestTables) -> DataFrame:
    """Contests written the way a season file has them: text columns, blank tail rows included."""
    wide = t.odds_wide().drop("league_id", "season")
    names = t.raw("nation").select("n_nationkey", "n_name")
    home = names.select(F.col("n_nationkey").alias("home_id"), F.col("n_name").alias("HomeTeam"))
    away = names.select(F.col("n_nationkey").alias("away_id"), F.col("n_name").alias("AwayTeam"))
    rows = t.finished().join(home, "home_id").join(away, "away_id").join(wide, "match_id", "left")
    price = {}
    for prefix, b in results.BOOKMAKER_PREFIXES.items():
        for x in "HDA":
            price[f"{prefix}{x}"] = F.col(f"{b}_open_{x.lower()}").cast("string")
            price[f"{prefix}C{x}"] = F.col(f"{b}_close_{x.lower()}").cast("string")
    k = F.col("match_id")
    day = F.when(k % 2 == 0, F.date_format("date", "dd/MM/yyyy")).otherwise(F.date_format("date", "dd/MM/yy"))
    return rows.select(
        k.cast("string").alias("Ref"),
        day.alias("Date"),
        F.when(k % 50 != 0, F.col("HomeTeam")).otherwise(F.lit("")).alias("HomeTeam"),
        "AwayTeam",
        F.concat(F.col("home_goals").cast("string"), F.when(k % 3 == 0, ".0").otherwise("")).alias("FTHG"),
        F.col("away_goals").cast("string").alias("FTAG"),
        F.when(k % 101 == 0, "X").otherwise(C.outcome("home_goals", "away_goals")).alias("FTR"),
        F.when(k % 4 != 0, (k % 20).cast("string")).otherwise("").alias("HS"),
        (k % 17).cast("string").alias("AS"),
        *[c.alias(n) for n, c in price.items()],
    )


def _result_file(t: ContestTables) -> DataFrame:
    path = scratch_dir(t.spark)
    _result_file_rows(t).write.mode("overwrite").option("encoding", "ISO-8859-1").csv(path, header=True)
    return results.read_results(t.spark, path)


@query("a1_results_csv")
def _(t):
    parsed = results.parse_results(_result_file(t), keep=("Ref",))
    return parsed.select(
        F.col("Ref").cast("long").alias("match_id"), "date", "home_name", "away_name",
        "home_goals", "away_goals", "file_result", "home_shots", "away_shots", "home_corners",
    )


@query("a2_odds_unpivot")
def _(t):
    return results.price_rows(_result_file_rows(t), keep=("Ref",)).withColumn("match_id", F.col("Ref").cast("long")).drop("Ref")


@query("a3_side_statistics")
def _(t):
    parsed = results.parse_results(_result_file_rows(t), keep=("Ref",)).withColumn("match_id", F.col("Ref").cast("long"))
    aliases = keys.explode_aliases(t.alias_config())
    named = joins.resolve_names(parsed, aliases, "results", {"home_name": "home_id", "away_name": "away_id"})
    return results.side_rows_of_results(named).select("match_id", "team_id", "is_home", "shots", "fouls")


def _schedule_pages(t: ContestTables) -> DataFrame:
    """One schedule page per league and day, with a spacer row and the unplayed contests."""
    names = t.raw("nation").select("n_nationkey", "n_name")
    home = names.select(F.col("n_nationkey").alias("home_id"), F.col("n_name").alias("home_name"))
    away = names.select(F.col("n_nationkey").alias("away_id"), F.col("n_name").alias("away_name"))
    rows = t.contests().join(home, "home_id").join(away, "away_id")
    score = F.when(
        F.col("status") == "finished",
        F.concat(F.col("home_goals").cast("string"), F.lit("–"), F.col("away_goals").cast("string")),
    ).otherwise("")

    def cell(name: str, value):
        return F.concat(F.lit(f'<td data-stat="{name}"><a href="/x">'), F.coalesce(value, F.lit("")), F.lit("</a></td>"))

    tr = F.concat(
        F.lit("<tr>"),
        F.concat(F.lit('<th scope="row" data-stat="gameweek">'), (F.col("match_id") % 38 + 1).cast("string"), F.lit("</th>")),
        cell("date", F.col("date").cast("string")),
        cell("home_team", F.concat(F.col("home_name"), F.lit(" &amp; Co"))),
        cell("home_xg", F.col("home_xg").cast("string")),
        cell("score", score),
        cell("away_xg", F.col("away_xg").cast("string")),
        cell("away_team", F.col("away_name")),
        cell("referee", F.col("match_id").cast("string")),
        F.lit("</tr>"),
    )
    return (
        rows.withColumn("tr", tr)
        .groupBy("league_id", "date")
        .agg(F.array_join(F.collect_list("tr"), "").alias("body"))
        .select(
            "league_id",
            F.concat(
                F.lit('<html><table class="t" id="sched_1"><thead><tr><th data-stat="score">Score</th></tr></thead><tbody>'),
                F.lit('<tr class="spacer"><td data-stat="home_team"></td></tr>'),
                F.col("body"),
                F.lit("</tbody></table></html>"),
            ).alias("html"),
        )
    )


@query("a4_schedule_pages")
def _(t):
    return schedule.parse_schedule(_schedule_pages(t), keep=("league_id",))


@query("a4_page_links")
def _(t):
    return schedule.page_links(t.raw("pages"))


def _feed_documents(t: ContestTables) -> DataFrame:
    """League feeds as JSON documents, one per league and day, in three envelope shapes."""
    num = lambda c: F.col(c).cast("string")
    entry = F.struct(
        F.col("match_id").cast("string").alias("id"),
        (F.col("status") == "finished").alias("isResult"),
        F.struct(num("home_id").alias("title")).alias("h"),
        F.struct(num("away_id").alias("title")).alias("a"),
        F.struct(num("home_goals").alias("h"), num("away_goals").alias("a")).alias("goals"),
        F.struct(num("home_xg").alias("h"), num("away_xg").alias("a")).alias("xG"),
        F.date_format("date", "yyyy-MM-dd 18:00:00").alias("datetime"),
    )
    docs = t.contests().groupBy("league_id", "date").agg(F.collect_list(entry).alias("e"))
    shape = F.when(F.col("league_id") == 0, F.to_json("e")).when(
        F.col("league_id") == 1, F.to_json(F.struct(F.col("e").alias("datesData")))
    ).otherwise(F.to_json(F.struct(F.lit(1).alias("version"), F.col("e").alias("matches"))))
    return docs.select("league_id", shape.alias("text"))


@query("a5_league_feed")
def _(t):
    return feed.parse_feed(_feed_documents(t), keep=("league_id",))


@query("a5_event_properties")
def _(t):
    props = F.from_json("props", "struct<k:bigint>")
    return t.raw("events").select("event_id", props["k"].alias("k")).filter(F.col("k").isNotNull())


@query("a6_rating_history")
def _(t):
    path = scratch_dir(t.spark)
    t.ratings().select(
        F.col("team_id").alias("Club"),
        F.col("rating").alias("Elo"),
        F.col("date").alias("From"),
        F.date_add("date", 7).alias("To"),
    ).write.mode("overwrite").csv(path, header=True)
    parsed = rating_history.parse_rating_history(rating_history.read_rating_history(t.spark, path), "1997-07-01")
    return parsed.select(F.col("club").cast("int").alias("team_id"), "date", "rating")


def _stamp_lines(t: ContestTables) -> DataFrame:
    ts = F.date_format("ts", "yyyyMMddHHmmss")
    return t.raw("events").select(
        "user_id", "event_type",
        F.when(F.col("event_id") % 10 == 0, F.concat(ts, F.lit("x"))).otherwise(F.concat(F.lit(" "), ts)).alias("value"),
    )


@query("a7_archive_index")
def _(t):
    return schedule.newest_stamps(schedule.snapshot_stamps(_stamp_lines(t)))


@query("a7_archive_index_all")
def _(t):
    return schedule.snapshot_stamps(_stamp_lines(t), keep=("user_id",))


@query("a8_best_snapshot")
def _(t):
    snaps = t.raw("events").groupBy("user_id", F.date_format("ts", "yyyyMMddHHmmss").alias("stamp")).agg(
        F.bool_or(F.col("event_type") == "purchase").alias("has_xg"),
        F.bool_and(F.col("event_type") != "error").alias("usable"),
    )
    return schedule.best_snapshot(snaps, ["user_id"])


@query("a9_feature_snapshot")
def _(t):
    path = scratch_dir(t.spark)
    frame = keys.with_calendar(keys.with_label(t.contests()), SETTINGS.features.no_crowd_seasons)
    table = versions.feature_table(t.spark, path, frame)
    table.replace(frame)
    return table.read().select("match_id", "league_id", "season", "as_of_date", "result", "home_xg")


@query("a10_payload")
def _(t):
    frame = keys.with_calendar(keys.with_label(t.contests()), SETTINGS.features.no_crowd_seasons)
    columns = [f.name for f in frame.schema if f.name not in ("match_id", "as_of_date")]
    rows = tables.payload_rows(frame, columns, "v1")
    table = versions.payload_table(t.spark, scratch_dir(t.spark))
    table.replace(rows.filter("match_id % 3 = 0").withColumn("payload", F.lit("{}")))
    table.upsert(rows)  # replaces a third of the payloads, adds the others
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.select(*columns).schema)
    return tables.read_payload(table.read(), kinds)


@query("a11_prediction_log")
def _(t):
    path = scratch_dir(t.spark)
    for component in ("score_model", "third"):
        rows = t.probs().filter(F.col("component") == component)
        tables.append_rows(rows.select("match_id", "component", "p_home", "p_draw", "p_away"), path)
    return rounded(t.spark.read.parquet(path), "p_home", "p_draw", "p_away")


def _stored_xg(t: ContestTables) -> DataFrame:
    k = F.col("match_id")
    return t.finished().filter(k % 4 != 0).select(
        "match_id",
        F.when(k % 3 != 0, F.col("home_xg")).alias("home_xg"),
        F.when(k % 3 != 0, F.col("away_xg")).alias("away_xg"),
        F.lit("results").alias("source"),
    )


@query("a12_keyed_upsert")
def _(t):
    new = t.second_source().select("match_id", "home_xg", "away_xg", F.lit("feed").alias("source"))
    return tables.merge_rows(_stored_xg(t), new, ["match_id"])


@query("a12_versioned_upsert")
def _(t):
    new = t.second_source().select("match_id", "home_xg", "away_xg", F.lit("feed").alias("source"))
    stored = _stored_xg(t)
    table = versions.VersionedTable(t.spark, scratch_dir(t.spark), stored.schema, ["match_id"], ["source"])
    table.replace(stored)
    table.upsert(new)  # contests move from one source's partition to the other's
    return table.read()


@query("a13_provenance_tags")
def _(t):
    k = F.col("match_id")
    old = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "results").when(k % 4 == 2, "results+feed").otherwise("feed")
    return t.contests().select("match_id", C.merged_tag(old.cast("string"), F.lit("feed")).alias("source"))


@query("a14_table_counts")
def _(t):
    return tables.table_counts({n: t.raw(n) for n in ("orders", "customer", "lineitem", "supplier", "part", "nation", "region")})


@query("a14_season_status")
def _(t):
    return tables.season_status(t.contests())


def _registry(t: ContestTables) -> DataFrame:
    k = F.col("match_id")
    metrics = F.concat(
        F.lit('{"val_season": "'), F.col("season"), F.lit('", "reference_logloss": '),
        (F.lit(0.9) + (k % 211) / 1000.0).cast("string"),
        F.when(k % 3 == 0, F.lit("}")).when(k % 3 == 1, F.lit(', "promoted": true}')).otherwise(', "promoted": false}'),
    )
    return t.contests().select(
        "league_id",
        F.concat(F.lit("v1-"), F.lpad(k.cast("string"), 10, "0")).alias("model_version"),
        F.col("date").cast("string").alias("trained_at"),
        F.concat(F.lit("1995.."), F.col("season")).alias("train_window"),
        metrics.alias("metrics_json"),
    )


@query("a15_latest_promoted")
def _(t):
    return tables.latest_promoted(_registry(t), ["league_id"]).drop("metrics_json")


# --- keys, labels, filters ---------------------------------------------------------------------


@query("b1_natural_key")
def _(t):
    return t.contests().select("match_id", C.natural_key().alias("natural_key"))


@query("b2_season_forms")
def _(t):
    start = F.year("o_orderdate")
    label = F.concat_ws("-", start, F.right((start + 1).cast("string"), F.lit(2)))
    return t.raw("orders").select("o_orderkey", label.alias("season")).select(
        "o_orderkey", "season", C.season_code("season").alias("code"),
        C.season_span("season").alias("span"), C.season_start("season").alias("start_year"),
    )


@query("b3_alias_rows")
def _(t):
    return keys.explode_aliases(t.alias_config())


@query("b4_result_label")
def _(t):
    return keys.with_label(t.contests()).select("match_id", "result")


@query("b5_cutoff_and_month")
def _(t):
    return keys.with_calendar(t.contests(), ()).select("match_id", "as_of_date", "month")


@query("b6_season_flag")
def _(t):
    return keys.with_calendar(t.contests(), SETTINGS.features.no_crowd_seasons).select("match_id", "no_crowd")


@query("b7_derby_flag")
def _(t):
    return keys.with_derby(t.contests(), SETTINGS.features.derbies).select("match_id", "derby")


@query("b8_differences")
def _(t):
    pairs = {"goal_diff": ("home_goals", "away_goals"), "xg_diff": ("home_xg", "away_xg"), "absent_diff": ("nope_h", "nope_a")}
    return keys.with_differences(t.contests(), pairs).select("match_id", *pairs)


@query("b9_status_filter")
def _(t):
    return keys.with_status(t.contests()).select("match_id", "status")


@query("b9_status_filter_all")
def _(t):
    return keys.with_status(t.contests(), include_scheduled=True).select("match_id", "status")


@query("b10_variant_columns")
def _(t):
    frame = t.contests().join(odds.opening_probabilities(t.odds()), "match_id", "left")
    frame = keys.with_calendar(frame, ())
    return frame.select("match_id", *keys.variant_columns(frame.columns, keys.NO_MARKET))


@query("b11_side_points")
def _(t):
    return form.side_rows(t.contests()).select("match_id", "team", "is_home", "points", "won", "lost", "g_minus_xg")


@query("b12_season_split")
def _(t):
    rows = keys.with_label(with_matchdays(t)).filter(F.col("season") == CURRENT_SEASON)
    played, remaining = keys.split_season(rows, None)
    past, future = keys.split_season(rows, 10)
    parts = {"played": played, "remaining": remaining, "before_10": past, "from_10": future}
    return tables.table_counts(parts).withColumnRenamed("table_name", "part")


@query("b13_variant_choice")
def _(t):
    rows = t.contests().join(odds.opening_probabilities(t.odds()), "match_id", "left")
    return keys.variant_choice(rows, ["league_id", "season", "home_id"])


@query("b14_predicted_class")
def _(t):
    return t.probs().select("match_id", "component", C.first_argmax().alias("pred_result"))


# --- joins -------------------------------------------------------------------------------------


@query("c1_side_xg")
def _(t):
    return joins.attach_side_xg(t.contests(), t.side_stats()).select("match_id", "home_xg", "away_xg")


@query("c2_asof_ratings")
def _(t):
    return joins.external_ratings(t.contests(), t.ratings())


@query("c2_asof_events")
def _(t):
    ev = t.raw("events").select("event_id", "user_id", "ts", "event_type", "value")
    probes = ev.filter(F.col("event_type") == "purchase")
    views = ev.filter(F.col("event_type") == "view")
    return joins.asof_by_time(probes, views, "user_id", "ts", "event_id", "value").select("event_id", "value")


@query("c3_feature_blocks")
def _(t):
    sides = form.side_form(form.side_rows(t.contests()), (5,), ("points",))
    folded = form.fold_to_contests(sides, ["points_ma5", "rest_days"])
    out = t.contests().select("match_id").join(folded, "match_id", "left")
    return out.join(odds.opening_probabilities(t.odds()).select("match_id", F.round("imp_home", 6).alias("imp_home")), "match_id", "left")


@query("c4_alias_lookup")
def _(t):
    aliases = keys.explode_aliases(t.alias_config())
    named = joins.resolve_names(t.second_source(), aliases, "schedule", {"home_name": "home_id", "away_name": "away_id"})
    return named.select("match_id", "home_id", "away_id")


@query("c5_unknown_names")
def _(t):
    aliases = keys.explode_aliases(t.alias_config())
    return joins.unknown_names(t.second_source(), aliases, "schedule", ["home_name", "away_name"])


@query("c6_reconciliation")
def _(t):
    base = t.finished().filter(F.col("match_id") % 83 != 0)
    return joins.reconcile(base, t.second_source()).select("match_id", "violation")


@query("c7_official_matchday")
def _(t):
    return joins.official_matchdays(with_matchdays(t), t.second_source()).select("match_id", "matchday")


@query("c8_gap_fill")
def _(t):
    stored = t.finished().select("match_id").join(_stored_xg(t), "match_id", "left")
    return joins.fill_missing_xg(stored, t.second_source(), "feed")


@query("c9_semi_join")
def _(t):
    wanted = t.contests().filter(F.col("season") == "1999").select("match_id")
    return t.odds().join(wanted, "match_id", "left_semi").select("match_id", "bookmaker")


@query("c10_test_with_closing")
def _(t):
    test = keys.with_label(t.finished()).filter(F.col("season") >= "1999").select("match_id", "season", "result")
    return rounded(test.join(odds.closing_probabilities(t.odds()), "match_id"), *C.PROBS)


@query("c11_unrated_teams")
def _(t):
    rated = t.ratings().filter(F.col("team_id") % 5 != 0)
    return joins.teams_without_rating(t.contests(), rated)


@query("c12_promoted_flags")
def _(t):
    thin = t.contests().filter((F.col("home_id") + F.col("season").cast("int")) % 6 != 0)
    thin = thin.filter((F.col("away_id") + F.col("season").cast("int")) % 6 != 0)
    return joins.promoted_flags(thin).select("match_id", "promoted_home", "promoted_away")


def _prediction_log(t: ContestTables) -> DataFrame:
    preds = t.probs().select("match_id", "component", C.first_argmax().alias("pred_result"))
    now = keys.with_label(t.contests()).select("match_id", "league_id", "result")
    return preds.join(now, "match_id").withColumn("hit", F.when(F.col("result").isNotNull(), F.col("pred_result") == F.col("result")))


@query("c13_log_with_outcome")
def _(t):
    return _prediction_log(t)


@query("c14_matchday_view")
def _(t):
    from contestry.operators.tables import matchday_view

    preds = t.probs().filter(F.col("component") == "third").select("match_id", "home_id", "away_id", C.first_argmax().alias("pred_result"))
    rows = keys.with_label(with_matchdays(t)).select("match_id", "season", "matchday", "result")
    return matchday_view(preds, rows, t.alias_config(), "2000", 7)


@query("c15_walk_forward_pairs")
def _(t):
    return joins.earlier_seasons(t.contests())


# --- aggregates --------------------------------------------------------------------------------


@query("d1_standings")
def _(t):
    return agg.standings(t.contests())


@query("d2_ranked_standings")
def _(t):
    return agg.ranked_standings(t.contests())


@query("d3_teams_per_season")
def _(t):
    return agg.teams_per_season(t.contests())


@query("d4_off_schedule_teams")
def _(t):
    return agg.off_schedule_teams(t.contests(), 40)


@query("d5_value_checks")
def _(t):
    return agg.value_checks(with_matchdays(t), 38)


@query("d6_coverage")
def _(t):
    return agg.coverage(t.contests(), t.side_stats(), t.odds())


@query("d7_check_suite")
def _(t):
    c = materialise(with_matchdays(t))
    expected = c.select("league_id").distinct().select("league_id", F.explode(F.array(*[F.lit(s) for s in (*SETTINGS.seasons, "2002")])).alias("season"))
    rated = t.ratings().filter(F.col("team_id") % 5 != 0)
    return agg.check_suite(c, t.side_stats(), t.odds(), rated, expected, SMALL_LEAGUE)


@query("d8_training_frequencies")
def _(t):
    return rounded(agg.outcome_frequencies(keys.with_label(t.finished())), *C.PROBS)


def _score_query(name: str, metric):
    @query(name)
    def _(t):
        return rounded(t.probs().groupBy("component", "league_id").agg(metric().alias("value")), "value")


_score_query("d9_log_loss", agg.log_loss)
_score_query("d10_brier", agg.brier)
_score_query("d11_rps", agg.ranked_probability)
_score_query("d12_accuracy", agg.accuracy)
_SCORES = ("log_loss", "brier", "rps", "accuracy")


@query("d13_scores_by_season")
def _(t):
    out = agg.focus_evaluation(t.probs(), ["league_id", "component", "season"], SETTINGS.focus_team)
    return rounded(out, *_SCORES, "focus_accuracy")


@query("d14_mean_scores")
def _(t):
    return rounded(agg.mean_of_seasons(agg.evaluate(t.probs(), ["component", "season"]), ["component"]), *_SCORES)


def _model_and_baseline_means(t: ContestTables):
    scored = agg.mean_of_seasons(agg.evaluate(t.probs(), ["league_id", "component", "season"]), ["league_id", "component"])
    model = scored.select(
        "league_id", "log_loss",
        F.when(F.col("component") == "trees", "ensemble_no_market").when(F.col("component") == "third", "ensemble_with_market").otherwise("score_model").alias("model"),
    )
    closing = keys.with_label(t.finished()).join(odds.closing_probabilities(t.odds()), "match_id")
    base = agg.mean_of_seasons(agg.evaluate(closing, ["league_id", "season"]), ["league_id"]).withColumn("baseline", F.lit("closing_odds"))
    rating = scored.filter(F.col("component") == "score_model").withColumn("baseline", F.lit("rating"))
    return model, base.select("league_id", "baseline", "log_loss").unionByName(rating.select("league_id", "baseline", "log_loss"))


@query("d15_acceptance_gates")
def _(t):
    return rounded(agg.acceptance(*_model_and_baseline_means(t)), "ours", "limit")


@query("d16_reliability")
def _(t):
    return rounded(agg.reliability(t.probs(), ("component",)), "mean_predicted", "observed")


@query("d17_baselines_sql")
def _(t):
    from contestry.plans.baselines import closing_baseline, frequency_baseline

    labelled = keys.with_label(t.finished())
    preds = frequency_baseline(labelled, 3).unionByName(closing_baseline(labelled, t.odds(), 3))
    return rounded(agg.evaluate(preds, ["league_id", "baseline", "season"]), *_SCORES)


@query("d18_hit_rate")
def _(t):
    return rounded(agg.hit_rate(_prediction_log(t), ["component", "league_id"]), "hit_rate")


# --- windows -----------------------------------------------------------------------------------


def _flat_form(t: ContestTables, names: list[str]) -> DataFrame:
    return form.side_form(form.side_rows(t.contests())).select("match_id", "team", "is_home", *names)


@query("e1_trailing_form")
def _(t):
    return _flat_form(t, [c for c in form.rolling_columns((5, 10)) if "_venue" not in c])


@query("e2_venue_form")
def _(t):
    return _flat_form(t, [c for c in form.rolling_columns((5, 10)) if "_venue" in c])


@query("e1_e2_trailing_form_split")
def _(t):
    rows = form.side_form(form.side_rows(t.contests()), mode="split", bucket_rows=64)
    return rows.select("match_id", "team", "is_home", *form.rolling_columns((5, 10)), "rest_days", "win_streak", "loss_streak")


@query("e3_rest_days")
def _(t):
    return _flat_form(t, ["rest_days"])


@query("e4_streaks")
def _(t):
    return _flat_form(t, ["win_streak", "loss_streak"])


@query("e5_head_to_head")
def _(t):
    return form.head_to_head(t.contests()).select("match_id", "h2h_home_ppg")


@query("e5_head_to_head_split")
def _(t):
    return form.head_to_head(t.contests(), mode="split", bucket_rows=8).select("match_id", "h2h_home_ppg")


@query("e6_counted_matchday")
def _(t):
    return form.counted_matchdays(t.contests())


@query("e6_counted_matchday_split")
def _(t):
    return form.counted_matchdays(t.contests(), mode="split")


@query("e7_opening_probabilities")
def _(t):
    return rounded(odds.opening_probabilities(t.odds()), *keys.MARKET_COLUMNS)


@query("e8_closing_probabilities")
def _(t):
    return rounded(odds.closing_probabilities(t.odds()), *C.PROBS)


@query("e10_expanding_statistics")
def _(t):
    out = agg.expanding_statistics(t.finished(), ["home_xg", "away_xg"])
    return rounded(out, "home_xg_mean", "home_xg_std", "away_xg_mean", "away_xg_std")


# --- order, limit, samples, sets ---------------------------------------------------------------


@query("f1_chronological")
def _(t):
    return selection.chronological(t.contests()).select("match_id", "position")


@query("f2_next_matchday")
def _(t):
    return selection.next_matchday(with_matchdays(t), CURRENT_SEASON).select("match_id", "league_id", "matchday")


@query("f3_matchdays")
def _(t):
    return selection.available_matchdays(with_matchdays(t), "2000")


@query("f4_best_candidate")
def _(t):
    losses = agg.evaluate(t.probs(), ["league_id", "component", "season"])
    means = agg.mean_of_seasons(losses, ["league_id", "component"]).withColumn("ordinal", F.col("component"))
    return rounded(selection.best_candidate(means, ["league_id"], "component", "ordinal", "log_loss"), "log_loss")


@query("f5_weakest_teams")
def _(t):
    return selection.weakest_teams(_params(t), ["league_id"])


@query("f6_top_rows")
def _(t):
    return selection.top_rows(t.contests().select("match_id", "home_xg"), "home_xg", "match_id", 15)


@query("f7_ordered_projection")
def _(t):
    return agg.standings(t.contests()).orderBy("league_id", "season", F.desc("points"), "team_id").select("league_id", "season", "team_id", "points")


@query("f8_seeded_sample")
def _(t):
    return selection.seeded_sample(t.contests().select("match_id", "league_id"), "match_id", 400)


@query("g1_team_set")
def _(t):
    return t.contests().select("league_id", F.explode(F.array("home_id", "away_id")).alias("team_id")).distinct()


@query("g2_side_rows")
def _(t):
    return form.side_rows(t.contests()).select("match_id", "team", "opponent", "is_home", "goals_for", "xg_for")


@query("g3_other_seasons")
def _(t):
    from contestry.operators.calibrate import leave_one_out

    pool = t.probs().filter(F.col("component") == "third").select("league_id", "season", "match_id")
    return leave_one_out(pool).groupBy("league_id", "held_out").agg(F.count("*").alias("n"))


# --- score model and blends --------------------------------------------------------------------

from contestry.operators import ratings as own  # noqa: E402
from contestry.operators import scenarios, score_model, stacking  # noqa: E402
from contestry.plans.adapt import HOME_EFFECT, RHO  # noqa: E402


def _fits(t: ContestTables) -> DataFrame:
    return _params(t).select("league_id").distinct().select(
        "league_id", F.lit(HOME_EFFECT).alias("home_effect"), F.lit(RHO).alias("rho")
    )


def _params(t: ContestTables) -> DataFrame:
    """Team strengths as the small stored table a fit leaves behind."""
    return _once(t, "params", lambda: materialise(t.params()))


def _with_goals(t: ContestTables, contests: DataFrame) -> DataFrame:
    return score_model.expected_goals(contests, _params(t), _fits(t), ["league_id"])


@query("d19_negative_log_likelihood")
def _(t):
    rows = _with_goals(t, t.finished())
    last = t.finished().groupBy("league_id").agg(F.max("date").alias("last"))
    rows = rows.join(last, "league_id").withColumn("weight", score_model.time_weight("last", "date", 0.0019))
    return rounded(score_model.negative_log_likelihood(rows, ["league_id"]), "nll", places=4)


@query("h7_optimal_weights")
def _(t):
    out = stacking.optimal_weights(t.probs(), ["league_id"], ("score_model", "trees", "third"))
    return rounded(out, "loss", "weight")


@query("h8_optimal_pair_weight")
def _(t):
    return rounded(stacking.optimal_weight(t.probs(), ["league_id"], ("score_model", "trees")), "weight", "loss")


@query("h8_pair_blend")
def _(t):
    wide = t.probs().groupBy("match_id").agg(
        *[F.max(F.when(F.col("component") == c, F.col(p))).alias(f"{c}_{p}") for c in ("score_model", "trees") for p in C.PROBS]
    )
    first, second = ([f"{c}_{p}" for p in C.PROBS] for c in ("score_model", "trees"))
    return rounded(stacking.blend_pair(wide, first, second, 0.35).select("match_id", *C.PROBS), *C.PROBS)


@query("h9_weighted_blend")
def _(t):
    weights = stacking.optimal_weights(t.probs(), ["league_id"], ("score_model", "trees", "third"))
    return rounded(stacking.blend(t.probs(), weights, ["league_id"], ["result"]), *C.PROBS)


@query("h10_time_weights")
def _(t):
    last = t.finished().groupBy("league_id").agg(F.max("date").alias("last"))
    rows = t.finished().join(last, "league_id")
    return rounded(rows.select("match_id", score_model.time_weight("last", "date", 0.0019).alias("weight")), "weight")


@query("h12_expected_goals")
def _(t):
    return rounded(_with_goals(t, t.contests()).select("match_id", "lam", "mu"), "lam", "mu")


@query("h13_score_grid")
def _(t):
    pairings = t.contests().select("league_id", "home_id", "away_id").distinct()
    return rounded(score_model.grid_rows(_with_goals(t, pairings), ["league_id", "home_id", "away_id"], 10), "p", places=8)


@query("h14_score_outcomes")
def _(t):
    rows = score_model.scored(t.contests(), _params(t), _fits(t), ["league_id"])
    return rounded(rows.select("match_id", *C.PROBS), *C.PROBS)


@query("h15_likely_score")
def _(t):
    rows = score_model.scored(t.contests(), _params(t), _fits(t), ["league_id"], likely=True)
    return rounded(rows.select("match_id", "pred_score", "pred_score_prob"), "pred_score_prob")


@query("h16_market_or_fallback")
def _(t):
    frame = t.probs().filter(F.col("component") == "score_model").join(odds.opening_probabilities(t.odds()), "match_id", "left")
    out = odds.market_or_fallback(frame, C.PROBS)
    return rounded(out.select("match_id", *C.PROBS), *C.PROBS)


@query("h19_promotion_gate")
def _(t):
    k = F.col("match_id")
    candidates = t.contests().select(k.alias("candidate"), (F.lit(0.9) + (k % 307) / 1000.0).alias("val_loss"))
    return rounded(tables.promotion_gate(candidates, _registry(t), 0.10), "val_loss", "previous_loss")


@query("h21_own_ratings")
def _(t):
    out = own.own_ratings(t.contests(), SETTINGS.features.rating)
    cols = ["rating_own_home", "rating_own_away", "rating_own_home_post", "rating_own_away_post"]
    return rounded(out.select("match_id", *cols), *cols)


@query("h21_own_ratings_blocks")
def _(t):
    n = t.contests().groupBy("league_id").count().agg(F.max("count")).first()[0]
    out = own.own_ratings(t.contests(), SETTINGS.features.rating, block_rows=max(1, n // 4))
    cols = ["rating_own_home", "rating_own_away", "rating_own_home_post", "rating_own_away_post"]
    return rounded(out.select("match_id", *cols), *cols)


@query("h22_rating_log")
def _(t):
    log = own.rating_log(t.contests(), own.own_ratings(t.contests(), SETTINGS.features.rating))
    return log.select("team_id", "match_id", "date", "rating", "rating_kind")


# --- scenarios ---------------------------------------------------------------------------------

N_SIMS = 200
FROM_MATCHDAY = 20


def _remaining(t: ContestTables) -> tuple[DataFrame, DataFrame]:
    """(remaining contests with model columns, played contests) of the current season."""
    rows = keys.with_label(with_matchdays(t)).filter(F.col("season") == CURRENT_SEASON)
    past, future = keys.split_season(rows, FROM_MATCHDAY)
    k = F.col("match_id")
    a, b, c = 1 + k % 7, 1 + k % 5, 1 + k % 3
    total = a + b + c
    rows = score_model.scored(future, _params(t), _fits(t), ["league_id"], margins=True)
    return rows.withColumns({"p_home": a / total, "p_draw": b / total, "p_away": c / total}), past


def _season_teams(t: ContestTables) -> DataFrame:
    rows = t.contests().filter(F.col("season") == CURRENT_SEASON)
    return rows.select("league_id", "season", F.explode(F.array("home_id", "away_id")).alias("team_id")).distinct()


def _ranked(t: ContestTables) -> DataFrame:
    remaining, played = _remaining(t)
    drawn = scenarios.scenario_tables(
        scenarios.remaining_table(remaining), played.filter(F.col("result").isNotNull()), _season_teams(t), N_SIMS
    )
    return scenarios.ranked_scenarios(drawn)


@query("i1_margin_distribution")
def _(t):
    remaining, _played = _remaining(t)
    long = remaining.select("match_id", "home_margin", "away_margin", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("margin"))
    at = F.col("margin") - 1
    out = long.select("match_id", "margin", F.get("home_margin", at).alias("p_home_margin"), F.get("away_margin", at).alias("p_away_margin"))
    return rounded(out, "p_home_margin", "p_away_margin", places=8)


@query("i2_remaining_table")
def _(t):
    table = scenarios.remaining_table(_remaining(t)[0])
    long = table.select("match_id", *C.PROBS, "home_cdf", "away_cdf", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("margin"))
    at = F.col("margin") - 1
    out = long.select("match_id", *C.PROBS, "margin", F.get("home_cdf", at).alias("home_cdf"), F.get("away_cdf", at).alias("away_cdf"))
    return rounded(out, *C.PROBS, "home_cdf", "away_cdf")


@query("i3_scenario_draws")
def _(t):
    table = scenarios.remaining_table(_remaining(t)[0])
    return scenarios.scenario_draws(table, N_SIMS).select("sim", "match_id", "outcome", "goal_diff")


@query("i4_scenario_tables")
def _(t):
    return _ranked(t).select("league_id", "sim", "team_id", "points", "goal_diff")


@query("e9_scenario_rank")
def _(t):
    return _ranked(t).select("league_id", "sim", "team_id", "pos")


@query("i5_position_counts")
def _(t):
    return rounded(scenarios.position_distribution(scenarios.position_counts(_ranked(t))), "p").drop("season")


@query("i5_position_summary")
def _(t):
    out = scenarios.position_summary(scenarios.position_counts(_ranked(t)))
    return rounded(out, "expected_pos", "expected_points").drop("season")


@query("i6_zone_probabilities")
def _(t):
    zones = scenarios.zone_probabilities(scenarios.position_counts(_ranked(t)), SETTINGS.league.zones)
    return rounded(zones, "p").drop("season")


@query("i8_position_matrix")
def _(t):
    out = scenarios.position_matrix(scenarios.position_counts(_ranked(t)), 25)
    return rounded(out, "expected_pos", *[f"pos_{k}" for k in range(1, 26)]).drop("season")


@query("i9_projection_table")
def _(t):
    out = scenarios.projection_table(scenarios.position_counts(_ranked(t)), SETTINGS.league.zones)
    names = [f"p_{z}" for z in SETTINGS.league.zones]
    return rounded(out, "expected_points", "expected_pos", *names).drop("season")


# --- features and models -----------------------------------------------------------------------

from contestry.operators import boosting, calibrate, logit, trees  # noqa: E402
from contestry.plans import backtest, baselines, bundles, walkforward  # noqa: E402
from contestry.plans.features import build_features  # noqa: E402

LEARN = demo_settings()
def _feature_frame(t: ContestTables) -> DataFrame:
    def build():
        base = materialise(with_matchdays(t))
        return materialise(build_features(base, t.ratings(), t.odds(), LEARN.features, include_scheduled=True))

    return _once(t, "features", build)


@query("h23_feature_set")
def _(t):
    base = materialise(with_matchdays(t))
    out = build_features(base, t.ratings(), t.odds(), LEARN.features, include_scheduled=True)
    out = out.select("match_id", "league_id", "season", "as_of_date", "result", *keys.feature_columns(out.columns))
    return rounded(out, "rating_own_home", "rating_own_away", "rating_own_diff", *keys.MARKET_COLUMNS, "h2h_home_ppg")


@query("d17_baselines")
def _(t):
    preds = baselines.run_baselines(_feature_frame(t), t.odds(), 3)
    return rounded(agg.evaluate(preds, ["league_id", "baseline", "season"]), *_SCORES)


@query("h2_rating_logistic")
def _(t):
    return rounded(baselines.rating_baseline(_feature_frame(t), 3).select("match_id", "season", *C.PROBS), *C.PROBS)


@query("h3_linear_component")
def _(t):
    rows = walkforward.with_linear_inputs(_feature_frame(t)).filter(F.col("result").isNotNull())
    tests = baselines.last_seasons(rows, 3)
    fits = logit.fit_folds(rows, tests, walkforward.LINEAR, LEARN.models.linear.candidates, impute=True)
    scored = logit.predict_folds(rows.join(tests, ["league_id", "season"], "left_semi"), fits, walkforward.LINEAR)
    return rounded(scored.select("match_id", "c", *C.PROBS), *C.PROBS)


@query("h4_boosted_trees")
def _(t):
    rows = walkforward.with_linear_inputs(_feature_frame(t)).filter(F.col("result").isNotNull())
    columns = walkforward.tree_columns(rows, keys.NO_MARKET)
    rows = rows.join(logit.season_order(rows), ["league_id", "season"])
    tests = rows.join(baselines.last_seasons(rows, 3), ["league_id", "season"], "left_semi").withColumn("fold", F.col("season"))
    cuts = tests.select("league_id", "fold", F.col("ord").alias("cut")).distinct()
    return boosting.fit_predict(rows, cuts, tests, columns, LEARN.models.trees).select("match_id", *C.PROBS)


@query("h5_isotonic")
def _(t):
    group = ["league_id", "component"]
    fits = calibrate.fit_isotonic(t.probs(), group)
    return rounded(calibrate.apply_isotonic(t.probs(), fits, group).select("match_id", "component", *C.PROBS), *C.PROBS)


@query("h6_leave_one_season_out")
def _(t):
    held = calibrate.leave_one_out(t.probs())
    group = ["league_id", "component", "season"]
    fits = calibrate.fit_isotonic(held, ["league_id", "component", "held_out"]).withColumnRenamed("held_out", "season")
    return rounded(calibrate.apply_isotonic(t.probs(), fits, group).select("match_id", "component", *C.PROBS), *C.PROBS)


@query("h11_score_model_fit")
def _(t):
    rows = t.finished().join(logit.season_order(t.finished()), ["league_id", "season"])
    folds = rows.select("league_id", F.col("season").alias("fold"), F.col("ord").alias("cut")).distinct().filter(F.col("cut") > 1)
    sums = score_model.pair_sums(rows, LEARN.models.score.candidates, "2001-12-31")
    fitted = score_model.fit_score_model(sums, folds, LEARN.models.score)
    return rounded(fitted, "attack", "defence", "home_effect", "rho", places=5)


def _pool(t: ContestTables) -> DataFrame:
    return _once(t, "pool", lambda: walkforward.season_pool(_feature_frame(t), LEARN))


def _bundle(t: ContestTables):
    return _once(t, "bundle", lambda: walkforward.train(_feature_frame(t), LEARN, pool=_pool(t)))


@query("h1_walk_forward_pool")
def _(t):
    return rounded(_pool(t), *C.PROBS)


@query("h17_training")
def _(t):
    bundle = _bundle(t)
    return rounded(bundle.weights.select("league_id", "variant", "component", "weight", "loss"), "weight", "loss")


@query("h17_validation_scores")
def _(t):
    return rounded(_bundle(t).validation, *_SCORES)


@query("h18_predictions")
def _(t):
    rows = _feature_frame(t).filter(F.col("season") == CURRENT_SEASON)
    out = walkforward.predict(_bundle(t), rows, keys.NO_MARKET)
    return rounded(out.drop("home_margin", "away_margin"), *C.PROBS, "pred_score_prob", "expected_goals_h", "expected_goals_a")


@query("h18_predictions_with_market")
def _(t):
    rows = _feature_frame(t).filter(F.col("season") == CURRENT_SEASON)
    out = walkforward.predict(_bundle(t), rows, keys.WITH_MARKET)
    return rounded(out.drop("home_margin", "away_margin"), *C.PROBS, "pred_score_prob", "expected_goals_h", "expected_goals_a")


def _backtest(t: ContestTables) -> DataFrame:
    # Trees per season: about 1,360 refits, one per round, take some ten minutes at sf0.01 (README).
    return _once(t, "backtest", lambda: backtest.run_backtest(_feature_frame(t), LEARN, 3, pool=_pool(t), tree_refit="season"))


@query("a15_stored_bundle")
def _(t):
    """Predictions of a saved, registered and reloaded bundle, beside those of the bundle in memory."""
    folder = scratch_dir(t.spark)
    bundles.register(_bundle(t), f"{folder}/models", f"{folder}/registry", "v1", "2002-01-01", keys.NO_MARKET)
    rows = _feature_frame(t).filter(F.col("season") == CURRENT_SEASON)
    again = walkforward.predict(bundles.load_latest(t.spark, f"{folder}/models", f"{folder}/registry"), rows, keys.NO_MARKET)
    direct = walkforward.predict(_bundle(t), rows, keys.NO_MARKET).select("match_id", *[F.col(p).alias(f"d_{p}") for p in C.PROBS])
    same = [F.col(p).eqNullSafe(F.col(f"d_{p}")) for p in C.PROBS]
    out = again.select("match_id", "pred_result", *C.PROBS).join(direct, "match_id", "full")
    return rounded(out.select("match_id", "pred_result", *C.PROBS, (same[0] & same[1] & same[2]).alias("same")), *C.PROBS)


@query("h20_backtest")
def _(t):
    return rounded(agg.focus_evaluation(_backtest(t), ["league_id", "model", "season"], LEARN.focus_team), *_SCORES, "focus_accuracy")


# --- projection, explanation, presentation, streams --------------------------------------------

from contestry.operators import tables as shown  # noqa: E402
from contestry.plans import ablation, projection  # noqa: E402
from contestry.streaming import ingest as stream_ingest  # noqa: E402
from contestry.streaming import ratings as stream_ratings  # noqa: E402
from contestry.streaming import refresh as stream_refresh  # noqa: E402


@query("i7_projection")
def _(t):
    counts = projection.project(_bundle(t), _feature_frame(t), CURRENT_SEASON, FROM_MATCHDAY, n=N_SIMS)
    return scenarios.projection_table(counts, LEARN.league.zones)


def _tree_parts(t: ContestTables):
    def build():
        rows = walkforward.with_linear_inputs(_feature_frame(t)).filter(F.col("result").isNotNull())
        model = _bundle(t).tree_models[keys.NO_MARKET]
        return model, materialise(rows.select("league_id", "match_id", "season", "result", *model.columns))

    return _once(t, "tree_parts", build)


def _contributions(t: ContestTables) -> DataFrame:
    return _once(t, "contributions", lambda: materialise(trees.contributions(*_tree_parts(t))))


@query("j1_contributions")
def _(t):
    c = F.col("contributions")
    return _contributions(t).select(
        "match_id", "class", "base",
        (F.col("base") + F.aggregate(c, F.lit(0.0), lambda a, x: a + x)).alias("raw"),
        F.size(c).alias("n_features"), F.array_max(F.transform(c, lambda x: F.abs(x))).alias("largest"),
    )


@query("j2_global_importance")
def _(t):
    model, _rows = _tree_parts(t)
    return trees.global_importance(trees.contribution_rows(_contributions(t), model.columns))


@query("j3_contest_contributions")
def _(t):
    model, rows = _tree_parts(t)
    newest = rows.agg(F.max("match_id")).first()[0]
    return trees.contest_contributions(trees.contribution_rows(_contributions(t), model.columns), newest, "H")


@query("j4_swarm")
def _(t):
    model, _rows = _tree_parts(t)
    return trees.swarm(trees.contribution_rows(_contributions(t), model.columns))


@query("j4_swarm_values")
def _(t):
    out = trees.swarm_values(t.finished(), ["home_xg", "away_xg", "home_goals"])
    return rounded(out, "shade")


@query("j5_partial_dependence")
def _(t):
    model, rows = _tree_parts(t)
    return trees.partial_dependence(model, rows, "rating_own_diff", 20)


@query("j6_block_ablation")
def _(t):
    return ablation.run_ablation(_feature_frame(t), LEARN)


@query("k1_focus_timeline")
def _(t):
    base = with_matchdays(t)
    sides = form.side_form(form.side_rows(base), (5,), ("points",))
    frame = base.join(form.fold_to_contests(sides, ["points_ma5"]), "match_id").join(joins.external_ratings(base, t.ratings()), "match_id")
    return shown.focus_timeline(frame, t.alias_config(), SETTINGS.focus_team, "2000")


@query("k2_registry_table")
def _(t):
    return tables.registry_table(_registry(t))


@query("k3_backtest_means")
def _(t):
    scores = agg.evaluate(_backtest(t), ["league_id", "model", "season"])
    return rounded(agg.mean_of_seasons(scores, ["league_id", "model"]), *_SCORES)


@query("k3_backtest_gates")
def _(t):
    scores = agg.evaluate(_backtest(t), ["league_id", "model", "season"])
    preds = baselines.run_baselines(_feature_frame(t), t.odds(), 3)
    base = agg.evaluate(preds, ["league_id", "baseline", "season"])
    means = agg.mean_of_seasons(scores, ["league_id", "model"]), agg.mean_of_seasons(base, ["league_id", "baseline"])
    return rounded(agg.acceptance(*means), "ours", "limit")


@query("k3_backtest_reliability")
def _(t):
    rows = _backtest(t).filter(F.col("model") == "ensemble_no_market")
    return rounded(agg.reliability(rows), "mean_predicted", "observed")


@query("k4_top_importance")
def _(t):
    model, _rows = _tree_parts(t)
    ranked = trees.global_importance(trees.contribution_rows(_contributions(t), model.columns))
    return selection.top_rows(ranked, "importance", "feature", 15)


def _inbox(t: ContestTables, rows: DataFrame, cuts: list[str]) -> str:
    """Rows written as one file per date range, oldest first: the batches of a replay."""
    path = scratch_dir(t.spark)
    edges = ["0001-01-01", *cuts, "9999-12-31"]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        day = F.col("date")
        part = rows.filter((day >= F.lit(lo).cast("date")) & (day < F.lit(hi).cast("date")))
        part.repartition(1).write.mode("append").parquet(path)
    return path


@query("l1_incremental_ingest")
def _(t):
    cols = ["match_id", "league_id", "season", "date", "home_id", "away_id", "home_goals", "away_goals", "home_xg", "away_xg"]
    stored = t.finished().filter(F.col("match_id") % 4 != 0).select(*cols)
    path = scratch_dir(t.spark)
    stored_table = stream_ingest.contest_table(t.spark, path, stored.schema)
    stored_table.replace(stored)
    rejects = scratch_dir(t.spark)
    arriving = t.second_source().drop("matchday")
    aliases = materialise(keys.explode_aliases(t.alias_config()))
    stream_ingest.run_ingest(
        t.spark, _inbox(t, arriving, ["1998-01-01"]), arriving.schema, path, stored.schema, aliases, "schedule", scratch_dir(t.spark), rejects
    )
    done = stored_table.read().select(*cols, F.lit(False).alias("rejected"))
    refused = t.spark.read.option("recursiveFileLookup", "true").schema(stored.schema).parquet(rejects)
    return done.unionByName(refused.select(*cols, F.lit(True).alias("rejected")))


@query("l1_reconciled_ingest")
def _(t):
    """A second source joins the stored contests only where it agrees with them; what contradicts is told apart."""
    cols = ["match_id", "league_id", "season", "date", "home_id", "away_id", "home_goals", "away_goals", "home_xg", "away_xg"]
    empty = F.lit(None).cast("double")
    stored = t.finished().filter(F.col("match_id") % 40 != 3).select(*cols[:-2], empty.alias("home_xg"), empty.alias("away_xg"))
    path, rejects = scratch_dir(t.spark), scratch_dir(t.spark)
    stored_table = stream_ingest.contest_table(t.spark, path, stored.schema)
    stored_table.replace(stored)
    arriving = t.second_source().drop("matchday")
    aliases = materialise(keys.explode_aliases(t.alias_config()))
    stream_ingest.run_ingest(
        t.spark, _inbox(t, arriving, ["1995-01-01"]), arriving.schema, path, stored.schema, aliases, "schedule", scratch_dir(t.spark), rejects,
        agreeing=True,
    )
    done = stored_table.read().select(*cols, F.lit(None).cast("string").alias("violation"))
    told = T.StructType([*stored.schema, T.StructField("violation", T.StringType())])
    refused = t.spark.read.option("recursiveFileLookup", "true").schema(told).parquet(rejects)
    return done.unionByName(refused.select(*cols, "violation"))


@query("l1_feature_refresh")
def _(t):
    """Features after three batches: most contests, late ones, then corrected results and moved days."""
    k, goals = F.col("match_id"), F.col("home_goals")
    rows = materialise(t.contests())
    fixed = rows.withColumns({"home_goals": F.when(k % 97 == 0, goals + 1).otherwise(goals), "date": F.when(k % 89 == 0, F.date_add("date", 3)).otherwise(F.col("date"))})
    batches = [rows.filter(k % 50 != 7), rows.filter(k % 50 == 7), fixed.filter((k % 97 == 0) | (k % 89 == 0))]
    ratings, prices = materialise(t.ratings()), materialise(t.odds())
    state = stream_refresh.FeatureState(t.spark, scratch_dir(t.spark), rows.schema, ratings, prices, LEARN.features)
    for n, batch in enumerate(batches):
        state.apply(lambda table, b=batch, tag=f"batch{n}": table.upsert(b, tag=tag), f"batch{n}")
    out = state.features.read()
    out = out.select("match_id", "league_id", "season", "as_of_date", "result", *keys.feature_columns(out.columns))
    return rounded(out, "rating_own_home", "rating_own_away", "rating_own_diff", *keys.MARKET_COLUMNS, "h2h_home_ppg")


@query("l2_incremental_ratings")
def _(t):
    rows = t.contests().select("league_id", "match_id", "date", "home_id", "away_id", "home_goals", "away_goals")
    # A first batch with every other contest of all years, then the rest: half of all contests come late.
    inbox = _inbox(t, rows.filter("match_id % 2 = 0"), [])
    rows.filter("match_id % 2 = 1").repartition(1).write.mode("append").parquet(inbox)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    state = stream_ratings.run_ratings(t.spark, stream, SETTINGS.features.rating, scratch_dir(t.spark), scratch_dir(t.spark))
    cols = ["rating_own_home", "rating_own_away", "rating_own_home_post", "rating_own_away_post"]
    return rounded(state.ratings.read().select("match_id", *cols), *cols)
