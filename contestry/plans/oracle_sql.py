"""DuckDB statements that state, in plain SQL, what each registered query must return."""

from __future__ import annotations

import re

from contestry.plans.adapt import BOOKMAKERS, FIRST_SEASON, LEG_STEPS, SCHEDULED_FROM

_CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}
# Per statement: tables that it sees otherwise.
_CHANGED: dict[str, dict[str, str]] = {}


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql.strip()


def _needed(sql: str) -> list[str]:
    """Names the statement uses, directly or through others; a name uses earlier ones only."""
    texts, found = [sql], []
    for name in reversed(_CTES):
        if any(re.search(rf"\b{name}\b", t) for t in texts):
            found.append(name)
            texts.append(_CTES[name])
    return found[::-1]


def compose(sql: str, recursive: bool = False, changed: dict[str, str] | None = None) -> str:
    """The statement behind the tables it needs; `changed` states some of them otherwise, by their own name."""
    order = _needed(sql)
    bodies = {**_CTES, **(changed or {})}
    if not order:
        return sql.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = sql.strip()
    body = "," + body[4:] if body.startswith("WITH ") else body
    return head + ",\n".join(f"{n} AS ({bodies[n]})" for n in order) + "\n" + body


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def all_oracles() -> dict[str, str]:
    return {n: compose(s, "rating_steps" in _needed(s), _CHANGED.get(n)) for n, s in ORACLES.items()}


# --- adapted tables ----------------------------------------------------------------------------

cte("line_counts", """
SELECT l_orderkey,
       count(*) FILTER (WHERE l_returnflag = 'R') AS r,
       count(*) FILTER (WHERE l_returnflag = 'A') AS a,
       count(*) FILTER (WHERE l_returnflag = 'N') AS n
FROM lineitem GROUP BY l_orderkey""")

cte("contests", f"""
SELECT o.o_orderkey AS match_id, o.o_custkey % 4 AS league_id,
       CAST(year(o.o_orderdate) AS VARCHAR) AS season, CAST(o.o_orderdate AS DATE) AS date,
       c.c_nationkey AS home_id, CAST(o.o_orderkey % 25 AS INTEGER) AS away_id,
       CASE WHEN o.o_orderstatus = 'P' AND o.o_orderdate >= DATE '{SCHEDULED_FROM}'
            THEN 'scheduled' ELSE 'finished' END AS status,
       CASE WHEN NOT (o.o_orderstatus = 'P' AND o.o_orderdate >= DATE '{SCHEDULED_FROM}')
            THEN CAST(coalesce(lc.r, 0) AS INTEGER) END AS home_goals,
       CASE WHEN NOT (o.o_orderstatus = 'P' AND o.o_orderdate >= DATE '{SCHEDULED_FROM}')
            THEN CAST(coalesce(lc.a, 0) AS INTEGER) END AS away_goals,
       CAST(0.5 * lc.r + 0.25 * lc.n AS DOUBLE) AS home_xg,
       CAST(0.5 * lc.a + 0.25 * lc.n AS DOUBLE) AS away_xg
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN line_counts lc ON lc.l_orderkey = o.o_orderkey
WHERE c.c_nationkey <> o.o_orderkey % 25""")

cte("labelled", """
SELECT *, CASE WHEN home_goals IS NULL OR away_goals IS NULL THEN NULL
               WHEN home_goals > away_goals THEN 'H'
               WHEN home_goals = away_goals THEN 'D' ELSE 'A' END AS result
FROM contests""")

cte("side_stats", """
SELECT match_id, league_id, season, home_id AS team_id, 1 AS is_home, home_xg AS xg FROM contests
UNION ALL
SELECT match_id, league_id, season, away_id, 0, away_xg FROM contests""")

cte("ratings", """
SELECT s.s_nationkey AS team_id, CAST(l.l_shipdate AS DATE) AS date,
       1300 + 10 * max(l.l_quantity) AS rating
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2""")


def _odds_rows() -> str:
    parts = []
    for b in BOOKMAKERS:
        legs = []
        for leg, step in zip("hda", LEG_STEPS[b], strict=True):
            op = f"1 + ((match_id * {step}) % 400 + 5) / 100.0::DOUBLE"
            cl = f"1 + ((match_id * {step} + 7) % 400 + 5) / 100.0::DOUBLE"
            if b == "market_avg":
                op = f"CASE WHEN match_id % 7 <> 0 THEN {op} END"
            cl_when = f"season <> '{FIRST_SEASON}'" + (" AND match_id % 11 <> 0" if leg == "d" else "")
            cl = f"CASE WHEN {cl_when} THEN {cl} END"
            legs += [f"{op} AS open_{leg}", f"{cl} AS close_{leg}"]
        parts.append(
            f"SELECT match_id, '{b}' AS bookmaker, {', '.join(legs)} FROM contests WHERE match_id % 13 <> 0"
        )
    return "\nUNION ALL\n".join(parts)


cte("odds", _odds_rows())

cte("probs", "\nUNION ALL\n".join(
    f"""SELECT match_id, league_id, season, home_id, away_id, result, '{name}' AS component,
  (1 + match_id % {a}) / CAST(3 + match_id % {a} + match_id % {b} + match_id % {c} AS DOUBLE) AS p_home,
  (1 + match_id % {b}) / CAST(3 + match_id % {a} + match_id % {b} + match_id % {c} AS DOUBLE) AS p_draw,
  (1 + match_id % {c}) / CAST(3 + match_id % {a} + match_id % {b} + match_id % {c} AS DOUBLE) AS p_away
FROM labelled WHERE status = 'finished'"""
    for name, a, b, c in (("score_model", 7, 5, 3), ("trees", 5, 4, 6), ("third", 4, 3, 8))
))

cte("params", """
SELECT league_id, team_id, CAST(((team_id * 3 + league_id) % 9 - 4) / 8.0 AS DOUBLE) AS attack,
       CAST(((team_id * 5 + league_id) % 7 - 3) / 8.0 AS DOUBLE) AS defence
FROM (SELECT DISTINCT league_id, team_id FROM side_stats) WHERE (team_id + league_id) % 12 <> 0""")

cte("aliases", """
SELECT 'results' AS source, n_name AS alias, n_nationkey AS team_id FROM nation
UNION ALL SELECT 'schedule', lower(n_name), n_nationkey FROM nation WHERE n_nationkey <> 24
UNION ALL SELECT 'schedule', n_name || ' FC', n_nationkey FROM nation
UNION ALL SELECT 'feed', upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)), n_nationkey FROM nation""")

cte("second_source", """
SELECT match_id, league_id, season, '  ' || lower(h.n_name) AS home_name, lower(a.n_name) AS away_name,
       home_id, away_id,
       CASE WHEN match_id % 89 = 0 THEN date + 3 ELSE date END AS date,
       home_goals + CASE WHEN match_id % 97 = 0 THEN 1 ELSE 0 END AS home_goals, away_goals,
       CASE WHEN match_id % 5 = 0 THEN home_xg END AS home_xg,
       CASE WHEN match_id % 5 = 0 THEN away_xg END AS away_xg,
       CASE WHEN match_id % 3 = 0 THEN CAST(match_id % 38 + 1 AS INTEGER) END AS matchday
FROM contests c JOIN nation h ON h.n_nationkey = c.home_id JOIN nation a ON a.n_nationkey = c.away_id
WHERE status = 'finished'""")

cte("sides", """
SELECT *, CASE WHEN goals_for IS NOT NULL THEN CASE WHEN goals_for > goals_against THEN 3.0::DOUBLE
               WHEN goals_for = goals_against THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS points,
       CASE WHEN goals_for IS NOT NULL THEN CAST(goals_for > goals_against AS INTEGER) END AS won,
       CASE WHEN goals_for IS NOT NULL THEN CAST(goals_for < goals_against AS INTEGER) END AS lost,
       goals_for - xg_for AS g_minus_xg
FROM (
  SELECT match_id, league_id, season, date, home_id AS team, away_id AS opponent, true AS is_home,
         home_goals AS goals_for, away_goals AS goals_against, home_xg AS xg_for, away_xg AS xg_against
  FROM contests
  UNION ALL
  SELECT match_id, league_id, season, date, away_id, home_id, false,
         away_goals, home_goals, away_xg, home_xg FROM contests)""")

cte("matchdays", """
SELECT match_id, CAST(max(n) AS INTEGER) AS matchday FROM (
  SELECT match_id, row_number() OVER (PARTITION BY league_id, season, team ORDER BY date, match_id) AS n
  FROM sides) GROUP BY match_id""")

STATS = ("points", "goals_for", "goals_against", "xg_for", "xg_against", "g_minus_xg")


def _ma(venue: bool) -> str:
    w = "wv" if venue else "wt"
    tag = "_venue" if venue else ""
    return ",\n".join(
        f"avg({s}) OVER ({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS {s}{tag}_ma{n}"
        for n in (5, 10)
        for s in STATS
    )


_WINDOWS = """
WINDOW wt AS (PARTITION BY league_id, team ORDER BY date, match_id),
       wv AS (PARTITION BY league_id, team, is_home ORDER BY date, match_id)"""

cte("form_all", f"SELECT match_id, team, is_home, {_ma(False)} FROM sides {_WINDOWS}")
cte("form_venue", f"SELECT match_id, team, is_home, {_ma(True)} FROM sides {_WINDOWS}")

cte("rest", """
SELECT match_id, team, is_home, CAST(date_diff('day', lag(date) OVER w, date) AS INTEGER) AS rest_days
FROM sides WINDOW w AS (PARTITION BY league_id, team ORDER BY date, match_id)""")

cte("streaks", """
SELECT match_id, team, is_home,
  CAST(wins_before - coalesce(max(CASE WHEN won = 0 THEN wins END) OVER past, 0) AS INTEGER) AS win_streak,
  CAST(losses_before - coalesce(max(CASE WHEN lost = 0 THEN losses END) OVER past, 0) AS INTEGER) AS loss_streak
FROM (SELECT *, coalesce(sum(won) OVER past, 0) AS wins_before, coalesce(sum(won) OVER seen, 0) AS wins,
             coalesce(sum(lost) OVER past, 0) AS losses_before, coalesce(sum(lost) OVER seen, 0) AS losses
      FROM sides
      WINDOW past AS (PARTITION BY league_id, team ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             seen AS (PARTITION BY league_id, team ORDER BY date, match_id ROWS UNBOUNDED PRECEDING))
WINDOW past AS (PARTITION BY league_id, team ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

cte("meetings", """
SELECT *, row_number() OVER (PARTITION BY league_id, lo, hi ORDER BY date, match_id) AS k
FROM (SELECT match_id, league_id, date, home_id, home_goals, away_goals,
             least(home_id, away_id) AS lo, greatest(home_id, away_id) AS hi FROM contests)""")

cte("h2h_ranked", """
SELECT m.match_id,
       CASE WHEN p.home_goals = p.away_goals THEN 1.0
            WHEN (p.home_goals > p.away_goals) = (p.home_id = m.home_id) THEN 3.0 ELSE 0.0 END AS pts,
       row_number() OVER (PARTITION BY m.match_id ORDER BY p.k DESC) AS back
FROM meetings m JOIN meetings p
  ON p.league_id = m.league_id AND p.lo = m.lo AND p.hi = m.hi AND p.k < m.k
WHERE p.home_goals IS NOT NULL AND p.away_goals IS NOT NULL""")

cte("h2h", """
SELECT c.match_id, avg(r.pts)::DOUBLE AS h2h_home_ppg
FROM contests c LEFT JOIN h2h_ranked r ON r.match_id = c.match_id AND r.back <= 5
GROUP BY c.match_id""")

cte("ext_ratings", """
SELECT c.match_id,
  (SELECT max_by(rating, date) FROM ratings r WHERE r.team_id = c.home_id AND r.date <= c.date - 1) AS rating_ext_home,
  (SELECT max_by(rating, date) FROM ratings r WHERE r.team_id = c.away_id AND r.date <= c.date - 1) AS rating_ext_away
FROM contests c""")

cte("asof_ext", """
SELECT h.match_id, h.rating AS rating_ext_home, a.rating AS rating_ext_away FROM
 (SELECT c.match_id, r.rating FROM contests c ASOF LEFT JOIN ratings r
    ON r.team_id = c.home_id AND r.date <= c.date - 1) h
 JOIN (SELECT c.match_id, r.rating FROM contests c ASOF LEFT JOIN ratings r
    ON r.team_id = c.away_id AND r.date <= c.date - 1) a ON a.match_id = h.match_id""")

cte("team_seasons", "SELECT DISTINCT league_id, season, team_id FROM side_stats")
cte("season_prev", """
SELECT league_id, season, lag(season) OVER (PARTITION BY league_id ORDER BY season) AS prev
FROM (SELECT DISTINCT league_id, season FROM contests)""")
cte("promotions", """
SELECT t.league_id, t.season, t.team_id,
       CASE WHEN p.prev IS NULL OR b.team_id IS NOT NULL THEN 0 ELSE 1 END AS flag
FROM team_seasons t JOIN season_prev p ON p.league_id = t.league_id AND p.season = t.season
LEFT JOIN team_seasons b ON b.league_id = t.league_id AND b.season = p.prev AND b.team_id = t.team_id""")

cte("opening", """
SELECT match_id, (1 / open_h) / (1 / open_h + 1 / open_d + 1 / open_a) AS imp_home,
       (1 / open_d) / (1 / open_h + 1 / open_d + 1 / open_a) AS imp_draw,
       (1 / open_a) / (1 / open_h + 1 / open_d + 1 / open_a) AS imp_away
FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY bookmaker <> 'market_avg') AS rn
      FROM odds WHERE bookmaker IN ('market_avg', 'bet365')
        AND open_h IS NOT NULL AND open_d IS NOT NULL AND open_a IS NOT NULL) WHERE rn = 1""")

cte("closing", """
SELECT match_id, (1 / h) / (1 / h + 1 / d + 1 / a) AS p_home, (1 / d) / (1 / h + 1 / d + 1 / a) AS p_draw,
       (1 / a) / (1 / h + 1 / d + 1 / a) AS p_away
FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY bookmaker <> 'market_avg') AS rn FROM (
        SELECT match_id, bookmaker, coalesce(close_h, open_h) AS h, coalesce(close_d, open_d) AS d,
               coalesce(close_a, open_a) AS a
        FROM odds WHERE bookmaker IN ('market_avg', 'bet365'))
      WHERE h IS NOT NULL AND d IS NOT NULL AND a IS NOT NULL) WHERE rn = 1""")

cte("standings", """
SELECT league_id, season, team_id, count(*) AS played, CAST(sum(p) AS BIGINT) AS points,
       CAST(sum(g) AS BIGINT) AS goal_diff FROM (
  SELECT league_id, season, home_id AS team_id, home_goals - away_goals AS g,
         CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS p
  FROM contests WHERE home_goals IS NOT NULL
  UNION ALL
  SELECT league_id, season, away_id, away_goals - home_goals,
         CASE WHEN away_goals > home_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END
  FROM contests WHERE home_goals IS NOT NULL) GROUP BY 1, 2, 3""")

# --- sources and sinks -------------------------------------------------------------------------

_FILE = "FROM labelled c JOIN nation h ON h.n_nationkey = c.home_id JOIN nation a ON a.n_nationkey = c.away_id WHERE status = 'finished' AND match_id % 50 <> 0"
oracle("a1_results_csv", f"""
SELECT match_id, date, h.n_name AS home_name, a.n_name AS away_name, home_goals, away_goals,
       CASE WHEN match_id % 101 = 0 THEN 'X' ELSE result END AS file_result,
       CASE WHEN match_id % 4 <> 0 THEN CAST(match_id % 20 AS INTEGER) END AS home_shots,
       CAST(match_id % 17 AS INTEGER) AS away_shots, CAST(NULL AS INTEGER) AS home_corners
{_FILE}""")
oracle("a2_odds_unpivot", """
SELECT o.match_id, bookmaker,
       CASE WHEN open_ok THEN open_h END AS open_h, CASE WHEN open_ok THEN open_d END AS open_d,
       CASE WHEN open_ok THEN open_a END AS open_a, CASE WHEN close_ok THEN close_h END AS close_h,
       CASE WHEN close_ok THEN close_d END AS close_d, CASE WHEN close_ok THEN close_a END AS close_a
FROM (SELECT *, open_h IS NOT NULL AND open_d IS NOT NULL AND open_a IS NOT NULL AS open_ok,
             close_h IS NOT NULL AND close_d IS NOT NULL AND close_a IS NOT NULL AS close_ok FROM odds) o
JOIN contests c ON c.match_id = o.match_id
WHERE c.status = 'finished' AND o.match_id % 50 <> 0 AND (open_ok OR close_ok)""")
oracle("a3_side_statistics", """
SELECT match_id, home_id AS team_id, 1 AS is_home,
       CASE WHEN match_id % 4 <> 0 THEN CAST(match_id % 20 AS INTEGER) END AS shots, CAST(NULL AS INTEGER) AS fouls
FROM contests WHERE status = 'finished' AND match_id % 50 <> 0
UNION ALL
SELECT match_id, away_id, 0, CAST(match_id % 17 AS INTEGER), NULL
FROM contests WHERE status = 'finished' AND match_id % 50 <> 0""")
oracle("a4_schedule_pages", """
SELECT league_id, CAST(match_id % 38 + 1 AS INTEGER) AS matchday, date, h.n_name || ' & Co' AS home_name,
       a.n_name AS away_name, home_goals, away_goals, home_xg, away_xg
FROM contests c JOIN nation h ON h.n_nationkey = c.home_id JOIN nation a ON a.n_nationkey = c.away_id
WHERE status = 'finished'""")
oracle("a4_page_links", r"""
SELECT page_id, CAST(u.i - 1 AS INTEGER) AS pos, l[u.i] AS href
FROM (SELECT page_id, regexp_extract_all(html, '<a\b[^>]*\bhref="([^"]*)"', 1, 'is') AS l FROM pages) p,
     LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u""")
oracle("a5_league_feed", """
SELECT league_id, CAST(match_id AS VARCHAR) AS feed_id, date, CAST(home_id AS VARCHAR) AS home_name,
       CAST(away_id AS VARCHAR) AS away_name, home_goals, away_goals, home_xg, away_xg
FROM contests WHERE status = 'finished'""")
oracle("a5_event_properties", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
WHERE json_extract_string(props, '$.k') IS NOT NULL""")
oracle("a6_rating_history", "SELECT team_id, date, rating FROM ratings WHERE date >= DATE '1997-07-01'")
cte("stamps", "SELECT user_id, event_type, event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events")
oracle("a7_archive_index", "SELECT DISTINCT stamp FROM stamps WHERE event_id % 10 <> 0")
oracle("a7_archive_index_all", "SELECT DISTINCT user_id, stamp FROM stamps WHERE event_id % 10 <> 0")
oracle("a8_best_snapshot", """
SELECT user_id, stamp, has_xg FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY has_xg DESC, stamp DESC) AS pick FROM (
    SELECT user_id, stamp, bool_or(event_type = 'purchase') AS has_xg, bool_and(event_type <> 'error') AS usable,
           row_number() OVER (PARTITION BY user_id ORDER BY stamp DESC) AS rn
    FROM stamps GROUP BY user_id, stamp) WHERE usable) WHERE pick = 1""")
oracle("a9_feature_snapshot", "SELECT match_id, league_id, season, date - 1 AS as_of_date, result, home_xg FROM labelled")
oracle("a10_payload", """
SELECT match_id, 'v1' AS version, league_id, season, date, home_id, away_id, status, home_goals, away_goals, home_xg, away_xg,
       result, CAST(month(date) AS INTEGER) AS month, CAST(season = '1997' AS INTEGER) AS no_crowd FROM labelled""")
oracle("a11_prediction_log", """
SELECT match_id, component, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away
FROM probs WHERE component IN ('score_model', 'third')""")
cte("stored_xg", """
SELECT match_id, CASE WHEN match_id % 3 <> 0 THEN home_xg END AS home_xg,
       CASE WHEN match_id % 3 <> 0 THEN away_xg END AS away_xg, 'results' AS source
FROM contests WHERE status = 'finished' AND match_id % 4 <> 0""")
for _name in ("a12_keyed_upsert", "a12_versioned_upsert"):
    oracle(_name, """
SELECT coalesce(n.match_id, o.match_id) AS match_id, coalesce(n.home_xg, o.home_xg) AS home_xg,
       coalesce(n.away_xg, o.away_xg) AS away_xg, coalesce(n.source, o.source) AS source
FROM stored_xg o FULL OUTER JOIN (SELECT *, 'feed' AS source FROM second_source) n ON n.match_id = o.match_id""")
oracle("a13_provenance_tags", """
SELECT match_id, CASE match_id % 4 WHEN 0 THEN 'feed' WHEN 1 THEN 'results+feed' WHEN 2 THEN 'results+feed' ELSE 'feed' END AS source
FROM contests""")
oracle("a14_table_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}"
    for n in ("orders", "customer", "lineitem", "supplier", "part", "nation", "region")))
oracle("a14_season_status", """
SELECT league_id, season, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM contests GROUP BY 1, 2""")
cte("registry", """
SELECT league_id, 'v1-' || lpad(CAST(match_id AS VARCHAR), 10, '0') AS model_version, CAST(date AS VARCHAR) AS trained_at,
       '1995..' || season AS train_window, season AS val_season, 0.9 + (match_id % 211) / 1000.0 AS loss,
       match_id % 3 <> 2 AS promoted FROM contests""")
oracle("a15_latest_promoted", """
SELECT league_id, model_version, trained_at FROM (
  SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY trained_at DESC, model_version DESC) AS rn
  FROM registry WHERE promoted) WHERE rn = 1""")

# --- keys, labels, filters ---------------------------------------------------------------------

oracle("b1_natural_key", "SELECT match_id, season || '_' || home_id || '_' || away_id AS natural_key FROM contests")
oracle("b2_season_forms", """
SELECT o_orderkey, y || '-' || right(CAST(y + 1 AS VARCHAR), 2) AS season,
       right(CAST(y AS VARCHAR), 2) || right(CAST(y + 1 AS VARCHAR), 2) AS code,
       y || '-' || (y + 1) AS span, CAST(y AS INTEGER) AS start_year
FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""")
oracle("b3_alias_rows", "SELECT source, alias, team_id FROM aliases")
oracle("b4_result_label", "SELECT match_id, result FROM labelled")
oracle("b5_cutoff_and_month", "SELECT match_id, date - 1 AS as_of_date, CAST(month(date) AS INTEGER) AS month FROM contests")
oracle("b6_season_flag", "SELECT match_id, CAST(season IN ('1997') AS INTEGER) AS no_crowd FROM contests")
oracle("b7_derby_flag", """
SELECT match_id, CAST((least(home_id, away_id), greatest(home_id, away_id)) IN ((3, 7), (5, 12), (20, 21)) AS INTEGER) AS derby
FROM contests""")
oracle("b8_differences", """
SELECT match_id, CAST(home_goals - away_goals AS DOUBLE) AS goal_diff, home_xg - away_xg AS xg_diff,
       CAST(NULL AS DOUBLE) AS absent_diff FROM contests""")
oracle("b9_status_filter", "SELECT match_id, status FROM contests WHERE status = 'finished'")
oracle("b9_status_filter_all", "SELECT match_id, status FROM contests")
oracle("b10_variant_columns", "SELECT match_id, CAST(month(date) AS INTEGER) AS month, 0 AS no_crowd FROM contests")
oracle("b11_side_points", "SELECT match_id, team, is_home, points, won, lost, g_minus_xg FROM sides")
oracle("b12_season_split", """
SELECT 'played' AS part, count(*) FILTER (WHERE result IS NOT NULL) AS n FROM labelled WHERE season = '2001'
UNION ALL SELECT 'remaining', count(*) FILTER (WHERE result IS NULL) FROM labelled WHERE season = '2001'
UNION ALL SELECT 'before_10', count(*) FILTER (WHERE matchday < 10) FROM contests JOIN matchdays USING (match_id) WHERE season = '2001'
UNION ALL SELECT 'from_10', count(*) FILTER (WHERE matchday >= 10) FROM contests JOIN matchdays USING (match_id) WHERE season = '2001'""")
oracle("b13_variant_choice", """
SELECT league_id, season, home_id, CASE WHEN bool_and(imp_home IS NOT NULL) THEN 'with_market' ELSE 'no_market' END AS variant
FROM contests LEFT JOIN opening USING (match_id) GROUP BY 1, 2, 3""")
_ARGMAX = "CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END"
oracle("b14_predicted_class", f"SELECT match_id, component, {_ARGMAX} AS pred_result FROM probs")

# --- joins -------------------------------------------------------------------------------------

oracle("c1_side_xg", """
SELECT c.match_id, h.xg AS home_xg, a.xg AS away_xg FROM contests c
LEFT JOIN side_stats h ON h.match_id = c.match_id AND h.is_home = 1
LEFT JOIN side_stats a ON a.match_id = c.match_id AND a.is_home = 0""")
oracle("c2_asof_ratings", "SELECT * FROM asof_ext")
oracle("c2_asof_events", """
SELECT p.event_id, v.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts <= p.ts""")
oracle("c3_feature_blocks", """
SELECT c.match_id, h.points_ma5 AS home_points_ma5, hr.rest_days AS home_rest_days,
       a.points_ma5 AS away_points_ma5, ar.rest_days AS away_rest_days, round(o.imp_home, 6) AS imp_home
FROM contests c JOIN form_all h ON h.match_id = c.match_id AND h.is_home
JOIN form_all a ON a.match_id = c.match_id AND NOT a.is_home
JOIN rest hr ON hr.match_id = c.match_id AND hr.is_home JOIN rest ar ON ar.match_id = c.match_id AND NOT ar.is_home
LEFT JOIN opening o ON o.match_id = c.match_id""")
oracle("c4_alias_lookup", """
SELECT match_id, CASE WHEN home_id <> 24 THEN home_id END AS home_id, CASE WHEN away_id <> 24 THEN away_id END AS away_id
FROM second_source""")
oracle("c5_unknown_names", """
SELECT DISTINCT name FROM (SELECT trim(home_name) AS name FROM second_source UNION ALL SELECT trim(away_name) FROM second_source)
WHERE name NOT IN (SELECT alias FROM aliases WHERE source = 'schedule')""")
oracle("c6_reconciliation", """
SELECT s.match_id, CASE WHEN s.match_id % 83 = 0 THEN 'missing' WHEN s.home_goals <> b.home_goals THEN 'score' ELSE 'date' END AS violation
FROM second_source s JOIN contests b ON b.match_id = s.match_id
WHERE s.match_id % 83 = 0 OR s.home_goals <> b.home_goals OR abs(date_diff('day', s.date, b.date)) > 1""")
oracle("c7_official_matchday", """
SELECT m.match_id, coalesce(s.matchday, m.matchday) AS matchday FROM matchdays m LEFT JOIN second_source s ON s.match_id = m.match_id""")
oracle("c8_gap_fill", """
SELECT c.match_id, CASE WHEN use THEN s.home_xg ELSE o.home_xg END AS home_xg,
       CASE WHEN use THEN s.away_xg ELSE o.away_xg END AS away_xg,
       CASE WHEN use THEN coalesce(o.source || '+feed', 'feed') ELSE o.source END AS source
FROM contests c LEFT JOIN stored_xg o ON o.match_id = c.match_id LEFT JOIN second_source s ON s.match_id = c.match_id,
LATERAL (SELECT (o.home_xg IS NULL OR o.away_xg IS NULL) AND s.home_xg IS NOT NULL AND s.away_xg IS NOT NULL AS use) u
WHERE c.status = 'finished'""")
oracle("c9_semi_join", "SELECT match_id, bookmaker FROM odds WHERE match_id IN (SELECT match_id FROM contests WHERE season = '1999')")
oracle("c10_test_with_closing", """
SELECT l.match_id, season, result, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away
FROM labelled l JOIN closing c ON c.match_id = l.match_id WHERE status = 'finished' AND season >= '1999'""")
oracle("c11_unrated_teams", """
SELECT DISTINCT team_id FROM side_stats s WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.team_id % 5 <> 0 AND r.team_id = s.team_id)""")
oracle("c12_promoted_flags", """
WITH thin AS (SELECT * FROM contests WHERE (home_id + CAST(season AS INTEGER)) % 6 <> 0 AND (away_id + CAST(season AS INTEGER)) % 6 <> 0),
ts AS (SELECT league_id, season, home_id AS team FROM thin UNION SELECT league_id, season, away_id FROM thin),
prev AS (SELECT league_id, season, lag(season) OVER (PARTITION BY league_id ORDER BY season) AS prev FROM (SELECT DISTINCT league_id, season FROM thin))
SELECT match_id,
  CAST(p.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ts WHERE ts.league_id = t.league_id AND ts.season = p.prev AND ts.team = t.home_id) AS INTEGER) AS promoted_home,
  CAST(p.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ts WHERE ts.league_id = t.league_id AND ts.season = p.prev AND ts.team = t.away_id) AS INTEGER) AS promoted_away
FROM thin t JOIN prev p ON p.league_id = t.league_id AND p.season = t.season""")
cte("prediction_log", f"""
SELECT p.match_id, p.component, {_ARGMAX} AS pred_result, l.league_id, l.result,
       CASE WHEN l.result IS NOT NULL THEN ({_ARGMAX}) = l.result END AS hit
FROM probs p JOIN labelled l ON l.match_id = p.match_id""")
oracle("c13_log_with_outcome", "SELECT * FROM prediction_log")
_LABEL = "CASE {0} WHEN 'H' THEN '1 (local)' WHEN 'D' THEN 'X (empate)' WHEN 'A' THEN '2 (visitante)' ELSE '—' END"
oracle("c14_matchday_view", f"""
SELECT p.match_id, p.home_id, p.away_id, {_ARGMAX} AS pred_result, l.result, h.n_name AS home_name, a.n_name AS away_name,
       {_LABEL.format('(' + _ARGMAX + ')')} AS predicted, {_LABEL.format('l.result')} AS actual
FROM probs p JOIN labelled l ON l.match_id = p.match_id JOIN matchdays m ON m.match_id = p.match_id
JOIN nation h ON h.n_nationkey = p.home_id JOIN nation a ON a.n_nationkey = p.away_id
WHERE component = 'third' AND l.season = '2000' AND m.matchday = 7""")
oracle("c15_walk_forward_pairs", """
SELECT t.league_id, t.season AS test_season, f.season AS train_season
FROM (SELECT DISTINCT league_id, season FROM contests) t JOIN (SELECT DISTINCT league_id, season FROM contests) f
ON f.league_id = t.league_id AND f.season < t.season""")

# --- aggregates --------------------------------------------------------------------------------

oracle("d1_standings", "SELECT * FROM standings")
oracle("d2_ranked_standings", """
SELECT *, CAST(row_number() OVER (PARTITION BY league_id, season ORDER BY points DESC, goal_diff DESC, team_id) AS INTEGER) AS pos FROM standings""")
oracle("d3_teams_per_season", "SELECT league_id, season, count(DISTINCT team_id) AS n_teams FROM side_stats GROUP BY 1, 2")
oracle("d4_off_schedule_teams", """
SELECT league_id, season, team_id, count(*) AS n FROM side_stats GROUP BY 1, 2, 3 HAVING count(*) <> 40""")
cte("value_checks", """
SELECT league_id, season, count(*) AS n,
  count(*) FILTER (WHERE status = 'finished' AND (home_goals IS NULL OR away_goals IS NULL)) AS null_goals,
  count(*) FILTER (WHERE matchday IS NULL OR matchday < 1 OR matchday > 38) AS bad_matchday,
  count(*) FILTER (WHERE matchday IS NULL OR matchday < 1 OR matchday > 48) AS bad_matchday_48,
  count(*) FILTER (WHERE home_goals < 0 OR away_goals < 0 OR home_goals > 15 OR away_goals > 15) AS weird_scores
FROM contests JOIN matchdays USING (match_id) GROUP BY 1, 2""")
oracle("d5_value_checks", "SELECT league_id, season, n, null_goals, bad_matchday, weird_scores FROM value_checks")
cte("coverage", """
SELECT league_id, season, count(*) AS n, CAST(sum(x.xg_rows) AS BIGINT) AS xg_rows,
       count(*) FILTER (WHERE x.xg_rows = 2) AS xg_contests, count(o.match_id) AS odds_contests
FROM contests c LEFT JOIN (SELECT match_id, count(xg) AS xg_rows FROM side_stats GROUP BY 1) x ON x.match_id = c.match_id
LEFT JOIN (SELECT DISTINCT match_id FROM odds) o ON o.match_id = c.match_id GROUP BY 1, 2""")
oracle("d6_coverage", "SELECT * FROM coverage")
oracle("d7_check_suite", """
WITH expected AS (SELECT league_id, s.season FROM (SELECT DISTINCT league_id FROM contests),
  (VALUES ('1995'), ('1996'), ('1997'), ('1998'), ('1999'), ('2000'), ('2001'), ('2002')) s(season)),
counts AS (SELECT league_id, season, team_id, count(*) AS n FROM side_stats GROUP BY 1, 2, 3),
off AS (SELECT league_id, season, string_agg(team_id || '=' || n, ', ' ORDER BY team_id) AS bad FROM counts WHERE n <> 48 GROUP BY 1, 2),
tm AS (SELECT league_id, season, count(*) AS k FROM counts GROUP BY 1, 2),
s AS (SELECT e.league_id, e.season, coalesce(v.n, 0) AS n, v.null_goals, v.bad_matchday_48 AS bm, tm.k, off.bad, cv.xg_rows, cv.odds_contests
  FROM expected e LEFT JOIN value_checks v USING (league_id, season) LEFT JOIN tm USING (league_id, season)
  LEFT JOIN off USING (league_id, season) LEFT JOIN coverage cv USING (league_id, season)),
un AS (SELECT string_agg(DISTINCT CAST(team_id AS VARCHAR), ', ' ORDER BY CAST(team_id AS VARCHAR)) AS t FROM side_stats
  WHERE team_id NOT IN (SELECT team_id FROM ratings WHERE team_id % 5 <> 0))
SELECT league_id, '[' || season || '] contests' AS name, n = 600 AS passed, n || '/600' AS detail FROM s
UNION ALL SELECT league_id, '[' || season || '] teams', k = 25, k || '/25' FROM s WHERE n > 0
UNION ALL SELECT league_id, '[' || season || '] contests per team', bad IS NULL, coalesce(bad, 'all play 48') FROM s WHERE n > 0
UNION ALL SELECT league_id, '[' || season || '] goals known', null_goals = 0, null_goals || ' rows with NULL' FROM s WHERE n > 0
UNION ALL SELECT league_id, '[' || season || '] matchdays within 1-48', bm = 0, bm || ' out of range' FROM s WHERE n > 0
UNION ALL SELECT league_id, '[' || season || '] xg coverage', xg_rows = 2 * n, xg_rows || '/' || (2 * n) FROM s WHERE n > 0
UNION ALL SELECT league_id, '[' || season || '] odds coverage', odds_contests = n, odds_contests || '/' || n FROM s WHERE n > 0
UNION ALL SELECT NULL, '[all] rating for every team', t IS NULL, coalesce('unrated: ' || t, 'ok') FROM un
UNION ALL SELECT NULL, '[all] plausible scores', sum(weird_scores) = 0, CAST(sum(weird_scores) AS BIGINT) || ' suspicious' FROM value_checks""")
cte("frequencies", """
SELECT league_id, season, CAST(h + d + a AS BIGINT) AS n_train, h / CAST(h + d + a AS DOUBLE) AS p_home,
       d / CAST(h + d + a AS DOUBLE) AS p_draw, a / CAST(h + d + a AS DOUBLE) AS p_away FROM (
  SELECT t.league_id, t.season, count(*) FILTER (WHERE l.result = 'H') AS h, count(*) FILTER (WHERE l.result = 'D') AS d,
         count(*) FILTER (WHERE l.result = 'A') AS a
  FROM (SELECT DISTINCT league_id, season FROM labelled WHERE result IS NOT NULL) t
  JOIN labelled l ON l.league_id = t.league_id AND l.season < t.season AND l.result IS NOT NULL GROUP BY 1, 2)""")
_R3 = "round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away"
oracle("d8_training_frequencies", f"SELECT league_id, season, n_train, {_R3} FROM frequencies")
_PTRUE = "CASE result WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END"
_Y = {o: f"CAST(result = '{o}' AS INTEGER)" for o in "HDA"}
_LL = f"avg(-ln(greatest({_PTRUE}, 1e-15)))"
_BR = f"avg((p_home - {_Y['H']}) ** 2 + (p_draw - {_Y['D']}) ** 2 + (p_away - {_Y['A']}) ** 2)"
_RPS = f"avg(((p_home - {_Y['H']}) ** 2 + (p_home + p_draw - {_Y['H']} - {_Y['D']}) ** 2) / 2)"
_ACC = f"avg(CAST(({_ARGMAX}) = result AS DOUBLE))"
_EVAL = f"round({_LL}, 6) AS log_loss, round({_BR}, 6) AS brier, round({_RPS}, 6) AS rps, round({_ACC}, 6) AS accuracy"
for _name, _expr in (("d9_log_loss", _LL), ("d10_brier", _BR), ("d11_rps", _RPS), ("d12_accuracy", _ACC)):
    oracle(_name, f"SELECT component, league_id, round({_expr}, 6) AS value FROM probs GROUP BY 1, 2")
oracle("d13_scores_by_season", f"""
SELECT league_id, component, season, count(*) AS n, {_EVAL},
       round(avg(CASE WHEN home_id = 3 OR away_id = 3 THEN CAST(({_ARGMAX}) = result AS DOUBLE) END), 6) AS focus_accuracy,
       count(*) FILTER (WHERE home_id = 3 OR away_id = 3) AS focus_n
FROM probs GROUP BY 1, 2, 3""")
_RAW_EVAL = f"{_LL} AS log_loss, {_BR} AS brier, {_RPS} AS rps, {_ACC} AS accuracy"
oracle("d14_mean_scores", f"""
SELECT component, round(avg(log_loss), 6) AS log_loss, round(avg(brier), 6) AS brier, round(avg(rps), 6) AS rps, round(avg(accuracy), 6) AS accuracy
FROM (SELECT component, season, {_RAW_EVAL} FROM probs GROUP BY 1, 2) GROUP BY 1""")
cte("league_means", f"""
SELECT league_id, component, avg(log_loss) AS loss FROM (SELECT league_id, component, season, {_LL} AS log_loss FROM probs GROUP BY 1, 2, 3) GROUP BY 1, 2""")
oracle("d15_acceptance_gates", f"""
WITH closing_mean AS (SELECT league_id, avg(log_loss) AS loss FROM (
  SELECT league_id, season, {_LL} AS log_loss FROM labelled l JOIN closing c ON c.match_id = l.match_id WHERE result IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT o.league_id, 'ensemble without market < rating baseline' AS gate, round(o.loss, 6) AS ours, round(b.loss, 6) AS "limit", o.loss < b.loss AS passed
FROM league_means o JOIN league_means b ON b.league_id = o.league_id AND b.component = 'score_model' WHERE o.component = 'trees'
UNION ALL
SELECT o.league_id, 'ensemble with market <= closing odds + 0.01', round(o.loss, 6), round(b.loss + 0.01, 6), o.loss <= b.loss + 0.01
FROM league_means o JOIN closing_mean b ON b.league_id = o.league_id WHERE o.component = 'third'""")
oracle("d16_reliability", """
WITH long AS (SELECT component, result, 'H' AS class, p_home AS p FROM probs UNION ALL SELECT component, result, 'D', p_draw FROM probs
  UNION ALL SELECT component, result, 'A', p_away FROM probs),
edges AS (SELECT CASE WHEN i = 10 THEN 1.0::DOUBLE ELSE i * 0.1::DOUBLE END AS e FROM range(0, 11) r(i)),
binned AS (SELECT component, class, result, p, CAST(least(9, greatest(0, (SELECT count(*) FROM edges WHERE e <= p) - 1)) AS INTEGER) AS bin FROM long)
SELECT component, class, bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(CAST(result = class AS DOUBLE)), 6) AS observed
FROM binned GROUP BY 1, 2, 3""")
cte("test_seasons", """
SELECT league_id, season FROM (
  SELECT league_id, season, row_number() OVER (PARTITION BY league_id ORDER BY season DESC) AS b,
         row_number() OVER (PARTITION BY league_id ORDER BY season) AS f
  FROM (SELECT DISTINCT league_id, season FROM contests WHERE status = 'finished')) WHERE b <= 3 AND f > 1""")
oracle("d17_baselines_sql", f"""
SELECT league_id, baseline, season, count(*) AS n, {_EVAL} FROM (
  SELECT l.league_id, l.season, result, 'frequencies' AS baseline, p_home, p_draw, p_away
  FROM labelled l JOIN test_seasons USING (league_id, season) JOIN frequencies USING (league_id, season) WHERE status = 'finished'
  UNION ALL
  SELECT l.league_id, l.season, result, 'closing_odds', p_home, p_draw, p_away
  FROM labelled l JOIN test_seasons USING (league_id, season) JOIN closing USING (match_id) WHERE status = 'finished')
GROUP BY 1, 2, 3""")
oracle("d18_hit_rate", """
SELECT component, league_id, round(avg(CAST(hit AS DOUBLE)), 6) AS hit_rate, count(*) AS resolved
FROM prediction_log WHERE hit IS NOT NULL GROUP BY 1, 2""")

# --- windows -----------------------------------------------------------------------------------

oracle("e1_trailing_form", "SELECT * FROM form_all")
oracle("e2_venue_form", "SELECT * FROM form_venue")
oracle("e1_e2_trailing_form_split", """
SELECT a.*, v.* EXCLUDE (match_id, team, is_home), r.rest_days, s.win_streak, s.loss_streak
FROM form_all a JOIN form_venue v ON v.match_id = a.match_id AND v.is_home = a.is_home
JOIN rest r ON r.match_id = a.match_id AND r.is_home = a.is_home JOIN streaks s ON s.match_id = a.match_id AND s.is_home = a.is_home""")
oracle("e3_rest_days", "SELECT * FROM rest")
oracle("e4_streaks", "SELECT * FROM streaks")
oracle("e5_head_to_head", "SELECT * FROM h2h")
oracle("e5_head_to_head_split", "SELECT * FROM h2h")
oracle("e6_counted_matchday", "SELECT * FROM matchdays")
oracle("e6_counted_matchday_split", "SELECT * FROM matchdays")
oracle("e7_opening_probabilities", """
SELECT match_id, round(imp_home, 6) AS imp_home, round(imp_draw, 6) AS imp_draw, round(imp_away, 6) AS imp_away FROM opening""")
oracle("e8_closing_probabilities", f"SELECT match_id, {_R3} FROM closing")
oracle("e10_expanding_statistics", """
SELECT t.league_id, t.season, count(home_xg) AS home_xg_n, round(avg(home_xg), 6) AS home_xg_mean, round(stddev_pop(home_xg), 6) AS home_xg_std,
       count(away_xg) AS away_xg_n, round(avg(away_xg), 6) AS away_xg_mean, round(stddev_pop(away_xg), 6) AS away_xg_std
FROM (SELECT DISTINCT league_id, season FROM contests WHERE status = 'finished') t
LEFT JOIN contests c ON c.league_id = t.league_id AND c.season < t.season AND c.status = 'finished' GROUP BY 1, 2""")

# --- order, limit, samples, sets ---------------------------------------------------------------

oracle("f1_chronological", "SELECT match_id, row_number() OVER (PARTITION BY league_id ORDER BY date, match_id) AS position FROM contests")
oracle("f2_next_matchday", """
WITH o AS (SELECT match_id, league_id, matchday FROM contests JOIN matchdays USING (match_id) WHERE season = '2001' AND status = 'scheduled')
SELECT * FROM o WHERE (league_id, matchday) IN (SELECT (league_id, min(matchday)) FROM o GROUP BY league_id)""")
oracle("f3_matchdays", "SELECT DISTINCT league_id, matchday FROM contests JOIN matchdays USING (match_id) WHERE season = '2000'")
oracle("f4_best_candidate", """
SELECT league_id, component, round(loss, 6) AS log_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY loss, component) AS rn FROM league_means) WHERE rn = 1""")
oracle("f5_weakest_teams", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY league_id ORDER BY attack + defence, team_id) AS INTEGER) AS rank FROM params) WHERE rank <= 3""")
oracle("f6_top_rows", "SELECT match_id, home_xg FROM contests ORDER BY home_xg DESC NULLS LAST, match_id LIMIT 15")
oracle("f7_ordered_projection", "SELECT league_id, season, team_id, points FROM standings")
oracle("f8_seeded_sample", "SELECT match_id, league_id FROM contests ORDER BY md5('42|' || match_id), match_id LIMIT 400")
oracle("g1_team_set", "SELECT DISTINCT league_id, team_id FROM side_stats")
oracle("g2_side_rows", "SELECT match_id, team, opponent, is_home, goals_for, xg_for FROM sides")
oracle("g3_other_seasons", """
WITH pool AS (SELECT league_id, season, match_id FROM probs WHERE component = 'third')
SELECT s.league_id, s.season AS held_out, count(*) AS n FROM (SELECT DISTINCT league_id, season FROM pool) s
JOIN pool o ON o.league_id = s.league_id AND o.season <> s.season GROUP BY 1, 2""")

# --- score model and blends --------------------------------------------------------------------

cte("weak_three", """
SELECT league_id, avg(attack) AS pa, avg(defence) AS pd FROM (
  SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY attack + defence, team_id) AS rank FROM params) WHERE rank <= 3 GROUP BY 1""")
cte("goals", """
SELECT c.*, exp(coalesce(h.attack, w.pa) - coalesce(a.defence, w.pd) + 0.25) AS lam,
       exp(coalesce(a.attack, w.pa) - coalesce(h.defence, w.pd)) AS mu
FROM contests c JOIN weak_three w ON w.league_id = c.league_id
LEFT JOIN params h ON h.league_id = c.league_id AND h.team_id = c.home_id
LEFT JOIN params a ON a.league_id = c.league_id AND a.team_id = c.away_id""")
_TAU = """CASE WHEN {x} = 0 AND {y} = 0 THEN 1 - lam * mu * (-0.1) WHEN {x} = 0 AND {y} = 1 THEN 1 + lam * (-0.1)
  WHEN {x} = 1 AND {y} = 0 THEN 1 + mu * (-0.1) WHEN {x} = 1 AND {y} = 1 THEN 1 + 0.1 ELSE 1.0 END"""
cte("grid", f"""
SELECT match_id, hg, ag, raw / sum(raw) OVER (PARTITION BY match_id) AS p FROM (
  SELECT match_id, i.i AS hg, j.j AS ag, greatest(0.0, exp(-lam) * pow(lam, i.i) / factorial(CAST(i.i AS INTEGER))
    * exp(-mu) * pow(mu, j.j) / factorial(CAST(j.j AS INTEGER)) * ({_TAU.format(x='i.i', y='j.j')})) AS raw
  FROM goals, (SELECT CAST(range AS INTEGER) AS i FROM range(0, 11)) i, (SELECT CAST(range AS INTEGER) AS j FROM range(0, 11)) j)""")
oracle("d19_negative_log_likelihood", f"""
SELECT g.league_id, round(-sum(exp(-0.0019 * date_diff('day', date, last)) *
   (ln(greatest(1e-10, {_TAU.format(x='home_goals', y='away_goals')})) + home_goals * ln(lam) - lam + away_goals * ln(mu) - mu)), 4) AS nll
FROM goals g JOIN (SELECT league_id, max(date) AS last FROM contests WHERE status = 'finished' GROUP BY 1) m ON m.league_id = g.league_id
WHERE status = 'finished' GROUP BY 1""")
cte("true_probs", f"""
SELECT league_id, match_id, max(CASE WHEN component = 'score_model' THEN {_PTRUE} END) AS q0,
       max(CASE WHEN component = 'trees' THEN {_PTRUE} END) AS q1, max(CASE WHEN component = 'third' THEN {_PTRUE} END) AS q2
FROM probs GROUP BY 1, 2""")
cte("best_weights", """
SELECT league_id, i, j, loss FROM (
  SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY loss, i, j) AS rn FROM (
    SELECT league_id, i, j, avg(-ln(greatest(i * 0.05::DOUBLE * q0 + j * 0.05::DOUBLE * q1 + (20 - i - j) * 0.05::DOUBLE * q2, 1e-15))) AS loss
    FROM true_probs, (SELECT range AS i FROM range(0, 21)) a, (SELECT range AS j FROM range(0, 21)) b WHERE i + j <= 20 GROUP BY 1, 2, 3)) WHERE rn = 1""")
cte("weight_rows", """
SELECT league_id, loss, 'score_model' AS component, i * 0.05::DOUBLE AS weight FROM best_weights
UNION ALL SELECT league_id, loss, 'trees', j * 0.05::DOUBLE FROM best_weights
UNION ALL SELECT league_id, loss, 'third', (20 - i - j) * 0.05::DOUBLE FROM best_weights""")
oracle("h7_optimal_weights", "SELECT league_id, round(loss, 6) AS loss, component, round(weight, 6) AS weight FROM weight_rows")
oracle("h8_optimal_pair_weight", """
SELECT league_id, round(i * 0.05::DOUBLE, 6) AS weight, round(loss, 6) AS loss FROM (
  SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY loss, i) AS rn FROM (
    SELECT league_id, i, avg(-ln(greatest(i * 0.05::DOUBLE * q0 + (1 - i * 0.05::DOUBLE) * q1, 1e-15))) AS loss
    FROM true_probs, (SELECT range AS i FROM range(0, 21)) a GROUP BY 1, 2)) WHERE rn = 1""")
oracle("h8_pair_blend", """
SELECT a.match_id, round(0.35 * a.p_home + 0.65 * b.p_home, 6) AS p_home, round(0.35 * a.p_draw + 0.65 * b.p_draw, 6) AS p_draw,
       round(0.35 * a.p_away + 0.65 * b.p_away, 6) AS p_away
FROM probs a JOIN probs b ON b.match_id = a.match_id WHERE a.component = 'score_model' AND b.component = 'trees'""")
oracle("h9_weighted_blend", """
SELECT p.league_id, p.match_id, max(result) AS result, round(sum(weight * p_home), 6) AS p_home, round(sum(weight * p_draw), 6) AS p_draw,
       round(sum(weight * p_away), 6) AS p_away
FROM probs p JOIN weight_rows w ON w.league_id = p.league_id AND w.component = p.component GROUP BY 1, 2""")
oracle("h10_time_weights", """
SELECT match_id, round(exp(-0.0019 * date_diff('day', date, last)), 6) AS weight FROM contests c
JOIN (SELECT league_id, max(date) AS last FROM contests WHERE status = 'finished' GROUP BY 1) m ON m.league_id = c.league_id
WHERE status = 'finished'""")
oracle("h12_expected_goals", "SELECT match_id, round(lam, 6) AS lam, round(mu, 6) AS mu FROM goals")
oracle("h13_score_grid", """
SELECT DISTINCT league_id, home_id, away_id, hg, ag, round(p, 8) AS p FROM grid JOIN contests USING (match_id)""")
oracle("h14_score_outcomes", """
SELECT match_id, round(sum(p) FILTER (WHERE hg > ag), 6) AS p_home, round(sum(p) FILTER (WHERE hg = ag), 6) AS p_draw,
       round(sum(p) FILTER (WHERE hg < ag), 6) AS p_away FROM grid GROUP BY 1""")
oracle("h15_likely_score", """
SELECT match_id, hg || '-' || ag AS pred_score, round(p, 6) AS pred_score_prob FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, hg, ag) AS rn FROM grid) WHERE rn = 1""")
oracle("h16_market_or_fallback", """
SELECT p.match_id, round(coalesce(imp_home, p_home), 6) AS p_home, round(coalesce(imp_draw, p_draw), 6) AS p_draw,
       round(coalesce(imp_away, p_away), 6) AS p_away
FROM probs p LEFT JOIN opening o ON o.match_id = p.match_id WHERE component = 'score_model'""")
oracle("h19_promotion_gate", """
SELECT match_id AS candidate, round(0.9 + (match_id % 307) / 1000.0::DOUBLE, 6) AS val_loss, model_version AS previous_version,
       round(loss::DOUBLE, 6) AS previous_loss, 0.9::DOUBLE + (match_id % 307) / 1000.0::DOUBLE <= loss::DOUBLE * 1.1::DOUBLE AS promoted
FROM contests, (SELECT model_version, loss FROM registry WHERE promoted ORDER BY trained_at DESC, model_version DESC LIMIT 1) r""")

cte("rating_order", """
SELECT league_id, match_id, home_id, away_id, home_goals, away_goals,
       row_number() OVER (PARTITION BY league_id ORDER BY date, match_id) AS rn FROM contests""")
cte("rating_steps", """
SELECT league_id, 0::BIGINT AS rn, NULL::BIGINT AS match_id, NULL::DOUBLE AS pre_h, NULL::DOUBLE AS pre_a, NULL::DOUBLE AS delta,
       list_resize([]::DOUBLE[], 25, 1500.0::DOUBLE) AS r, 0 AS h, 0 AS a FROM (SELECT DISTINCT league_id FROM contests)
UNION ALL
SELECT league_id, rn, match_id, pre_h, pre_a, delta,
       list_transform(r, lambda x, i: CASE WHEN delta IS NULL THEN x WHEN i = h THEN x + delta WHEN i = a THEN x - delta ELSE x END), h, a
FROM (SELECT o.league_id, o.rn, o.match_id, s.r, o.home_id + 1 AS h, o.away_id + 1 AS a, s.r[o.home_id + 1] AS pre_h, s.r[o.away_id + 1] AS pre_a,
        CASE WHEN o.home_goals IS NOT NULL THEN 20.0::DOUBLE * (CASE WHEN o.home_goals > o.away_goals THEN 1.0::DOUBLE WHEN o.home_goals = o.away_goals THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
          - 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, -((s.r[o.home_id + 1] + 60.0::DOUBLE) - s.r[o.away_id + 1]) / 400.0::DOUBLE))) END AS delta
      FROM rating_steps s JOIN rating_order o ON o.league_id = s.league_id AND o.rn = s.rn + 1)""")
cte("own_ratings", """
SELECT match_id, league_id, pre_h AS rating_own_home, pre_a AS rating_own_away, pre_h + delta AS rating_own_home_post, pre_a - delta AS rating_own_away_post
FROM rating_steps WHERE match_id IS NOT NULL""")
for _name in ("h21_own_ratings", "h21_own_ratings_blocks"):
    oracle(_name, """
SELECT match_id, round(rating_own_home, 6) AS rating_own_home, round(rating_own_away, 6) AS rating_own_away,
       round(rating_own_home_post, 6) AS rating_own_home_post, round(rating_own_away_post, 6) AS rating_own_away_post FROM own_ratings""")
oracle("h22_rating_log", """
SELECT c.home_id AS team_id, c.match_id, c.date, round(rating_own_home_post, 2) AS rating, 'own' AS rating_kind
FROM own_ratings o JOIN contests c ON c.match_id = o.match_id WHERE rating_own_home_post IS NOT NULL
UNION ALL
SELECT c.away_id, c.match_id, c.date, round(rating_own_away_post, 2), 'own'
FROM own_ratings o JOIN contests c ON c.match_id = o.match_id WHERE rating_own_home_post IS NOT NULL""")

# --- scenarios ---------------------------------------------------------------------------------

cte("remaining", """
SELECT c.*, (1 + match_id % 7) / CAST(3 + match_id % 7 + match_id % 5 + match_id % 3 AS DOUBLE) AS p_home,
       (1 + match_id % 5) / CAST(3 + match_id % 7 + match_id % 5 + match_id % 3 AS DOUBLE) AS p_draw,
       (1 + match_id % 3) / CAST(3 + match_id % 7 + match_id % 5 + match_id % 3 AS DOUBLE) AS p_away
FROM contests c JOIN matchdays USING (match_id) WHERE season = '2001' AND matchday >= 20""")
cte("margins", """
SELECT match_id, abs(hg - ag) AS margin, sum(p) FILTER (WHERE hg > ag) / sum(sum(p) FILTER (WHERE hg > ag)) OVER w AS hm,
       sum(p) FILTER (WHERE hg < ag) / sum(sum(p) FILTER (WHERE hg < ag)) OVER w AS am
FROM grid JOIN remaining USING (match_id) WHERE hg <> ag GROUP BY 1, 2 WINDOW w AS (PARTITION BY match_id)""")
cte("margin_cdfs", """
SELECT match_id, margin, sum(hm) OVER w AS hc, sum(am) OVER w AS ac FROM margins WINDOW w AS (PARTITION BY match_id ORDER BY margin)""")
oracle("i1_margin_distribution", "SELECT match_id, margin, round(hm, 8) AS p_home_margin, round(am, 8) AS p_away_margin FROM margins")
oracle("i2_remaining_table", f"""
SELECT match_id, {_R3}, margin, round(hc, 6) AS home_cdf, round(ac, 6) AS away_cdf FROM remaining JOIN margin_cdfs USING (match_id)""")
_U = "CAST('0x' || substr(md5('42|' || sim || '|' || {key} || '|{tag}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
cte("draws", f"""
SELECT sim, match_id, league_id, home_id, away_id, outcome,
  CAST(CASE outcome WHEN 'H' THEN 1 + len(list_filter(hl[1:9], lambda x: x <= v)) WHEN 'A' THEN -(1 + len(list_filter(al[1:9], lambda x: x <= v))) ELSE 0 END AS INTEGER) AS goal_diff
FROM (SELECT *, CASE WHEN u < p_home THEN 'H' WHEN u < p_home + p_draw THEN 'D' ELSE 'A' END AS outcome FROM (
  SELECT CAST(sim AS INTEGER) AS sim, r.*, hl, al, {_U.format(key='match_id', tag='outcome')} AS u, {_U.format(key='match_id', tag='margin')} AS v
  FROM remaining r JOIN (SELECT match_id, list(hc ORDER BY margin) AS hl, list(ac ORDER BY margin) AS al FROM margin_cdfs GROUP BY 1) USING (match_id),
       (SELECT range AS sim FROM range(0, 200)) s))""")
oracle("i3_scenario_draws", "SELECT sim, match_id, outcome, goal_diff FROM draws")
cte("played_now", """
SELECT league_id, team_id, sum(p) AS points, sum(g) AS gd FROM (
  SELECT c.league_id, c.home_id AS team_id, home_goals - away_goals AS g, CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS p
  FROM contests c JOIN matchdays USING (match_id) WHERE season = '2001' AND matchday < 20 AND home_goals IS NOT NULL
  UNION ALL
  SELECT c.league_id, c.away_id, away_goals - home_goals, CASE WHEN away_goals > home_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END
  FROM contests c JOIN matchdays USING (match_id) WHERE season = '2001' AND matchday < 20 AND home_goals IS NOT NULL) GROUP BY 1, 2""")
cte("scenario_tables", """
SELECT t.league_id, CAST(s.sim AS INTEGER) AS sim, t.team_id, CAST(coalesce(p.points, 0) + coalesce(d.points, 0) AS BIGINT) AS points,
       CAST(coalesce(p.gd, 0) + coalesce(d.gd, 0) AS BIGINT) AS goal_diff
FROM (SELECT DISTINCT league_id, team_id FROM side_stats WHERE season = '2001') t, (SELECT range AS sim FROM range(0, 200)) s
LEFT JOIN played_now p ON p.league_id = t.league_id AND p.team_id = t.team_id
LEFT JOIN (SELECT league_id, sim, team_id, sum(p) AS points, sum(g) AS gd FROM (
   SELECT league_id, sim, home_id AS team_id, goal_diff AS g, CASE outcome WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS p FROM draws
   UNION ALL SELECT league_id, sim, away_id, -goal_diff, CASE outcome WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END FROM draws) GROUP BY 1, 2, 3) d
  ON d.league_id = t.league_id AND d.sim = s.sim AND d.team_id = t.team_id""")
_TIE_KEY = "league_id || ':2001:' || team_id"
cte("scenario_ranks", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY league_id, sim ORDER BY points DESC, goal_diff DESC, {_U.format(key=_TIE_KEY, tag='tie')} DESC, team_id) AS INTEGER) AS pos
FROM scenario_tables""")
oracle("i4_scenario_tables", "SELECT league_id, sim, team_id, points, goal_diff FROM scenario_tables")
oracle("e9_scenario_rank", "SELECT league_id, sim, team_id, pos FROM scenario_ranks")
oracle("i5_position_counts", """
SELECT league_id, team_id, pos, count(*) AS n, round(count(*) / 200.0::DOUBLE, 6) AS p FROM scenario_ranks GROUP BY 1, 2, 3""")
oracle("i5_position_summary", """
SELECT league_id, team_id, count(*) AS n_sims, round(avg(pos), 6) AS expected_pos, round(avg(points), 6) AS expected_points FROM scenario_ranks GROUP BY 1, 2""")
_ZONES = {"titulo": (1, 1), "champions": (1, 4), "europa": (5, 6), "conference": (7, 7), "descenso": (18, 20)}
oracle("i6_zone_probabilities", " UNION ALL ".join(
    f"SELECT league_id, team_id, '{z}' AS zone, round(avg(CAST(pos BETWEEN {lo} AND {hi} AS INTEGER)), 6) AS p FROM scenario_ranks GROUP BY 1, 2"
    for z, (lo, hi) in _ZONES.items()))
oracle("i8_position_matrix", "SELECT league_id, team_id, round(avg(pos), 6) AS expected_pos, " + ", ".join(
    f"round(avg(CAST(pos = {k} AS INTEGER)), 6) AS pos_{k}" for k in range(1, 26)) + " FROM scenario_ranks GROUP BY 1, 2")
oracle("i9_projection_table", "SELECT league_id, team_id, round(avg(points), 1) AS expected_points, round(avg(pos), 1) AS expected_pos, " + ", ".join(
    f"round(avg(CAST(pos BETWEEN {lo} AND {hi} AS INTEGER)), 6) AS p_{z}" for z, (lo, hi) in _ZONES.items()) + " FROM scenario_ranks GROUP BY 1, 2")

# --- features ----------------------------------------------------------------------------------

_FORM = [f"{s}{v}_ma{n}" for n in (5, 10) for s in STATS for v in ("", "_venue")]


def _side_columns(prefix: str) -> str:
    out = [f"{prefix}{'v' if '_venue' in c else 'f'}.{c} AS {'home' if prefix == 'h' else 'away'}_{c}" for c in _FORM]
    name = "home" if prefix == "h" else "away"
    out += [f"{prefix}r.rest_days AS {name}_rest_days", f"{prefix}k.win_streak AS {name}_win_streak", f"{prefix}k.loss_streak AS {name}_loss_streak"]
    return ", ".join(out)


def _side_joins(prefix: str, test: str) -> str:
    return " ".join(
        f"JOIN {cte_name} {prefix}{k} ON {prefix}{k}.match_id = c.match_id AND {test.format(prefix + k)}"
        for k, cte_name in (("f", "form_all"), ("v", "form_venue"), ("r", "rest"), ("k", "streaks"))
    )


oracle("h23_feature_set", f"""
SELECT c.match_id, c.league_id, c.season, c.date - 1 AS as_of_date, c.result, m.matchday, CAST(month(c.date) AS INTEGER) AS month,
       CAST(c.season IN ('1997') AS INTEGER) AS no_crowd,
       CAST((least(c.home_id, c.away_id), greatest(c.home_id, c.away_id)) IN ((3, 7), (5, 12), (20, 21)) AS INTEGER) AS derby,
       ph.flag AS promoted_home, pa.flag AS promoted_away, round(h2h.h2h_home_ppg, 6) AS h2h_home_ppg,
       round(o.rating_own_home, 6) AS rating_own_home, round(o.rating_own_away, 6) AS rating_own_away,
       round(o.rating_own_home - o.rating_own_away, 6) + 0.0::DOUBLE AS rating_own_diff,
       e.rating_ext_home, e.rating_ext_away, e.rating_ext_home - e.rating_ext_away AS rating_ext_diff,
       {_side_columns("h")}, {_side_columns("a")},
       round(imp_home, 6) AS imp_home, round(imp_draw, 6) AS imp_draw, round(imp_away, 6) AS imp_away
FROM labelled c JOIN matchdays m ON m.match_id = c.match_id JOIN own_ratings o ON o.match_id = c.match_id
JOIN asof_ext e ON e.match_id = c.match_id JOIN h2h ON h2h.match_id = c.match_id
JOIN promotions ph ON ph.league_id = c.league_id AND ph.season = c.season AND ph.team_id = c.home_id
JOIN promotions pa ON pa.league_id = c.league_id AND pa.season = c.season AND pa.team_id = c.away_id
{_side_joins("h", "{0}.is_home")} {_side_joins("a", "NOT {0}.is_home")}
LEFT JOIN opening i ON i.match_id = c.match_id""")

# --- explanation, presentation, streams --------------------------------------------------------

oracle("j4_swarm_values", """
WITH long AS (SELECT match_id, 'home_xg' AS feature, home_xg AS value FROM contests WHERE status = 'finished'
  UNION ALL SELECT match_id, 'away_xg', away_xg FROM contests WHERE status = 'finished'
  UNION ALL SELECT match_id, 'home_goals', CAST(home_goals AS DOUBLE) FROM contests WHERE status = 'finished'),
st AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY 1)
SELECT match_id, l.feature, value, CASE WHEN value IS NOT NULL THEN
  round(greatest(-2.0, least(2.0, (value - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END)), 6) + 0.0::DOUBLE END AS shade
FROM long l JOIN st ON st.feature = l.feature""")
oracle("k1_focus_timeline", """
SELECT c.league_id, c.match_id, m.matchday, c.date, CASE WHEN c.home_id = 3 THEN c.away_id ELSE c.home_id END AS opponent_id,
       c.home_id = 3 AS at_home, CASE WHEN c.home_id = 3 THEN e.rating_ext_home ELSE e.rating_ext_away END AS rating,
       CASE WHEN c.home_id = 3 THEN c.home_xg ELSE c.away_xg END AS xg_for, CASE WHEN c.home_id = 3 THEN c.away_xg ELSE c.home_xg END AS xg_against,
       f.points_ma5 AS form_points_ma5, n.n_name AS opponent
FROM contests c JOIN matchdays m ON m.match_id = c.match_id JOIN asof_ext e ON e.match_id = c.match_id
JOIN form_all f ON f.match_id = c.match_id AND f.team = 3
JOIN nation n ON n.n_nationkey = CASE WHEN c.home_id = 3 THEN c.away_id ELSE c.home_id END
WHERE c.season = '2000' AND (c.home_id = 3 OR c.away_id = 3)""")
oracle("k2_registry_table", """
SELECT model_version, trained_at, train_window, val_season, round(loss::DOUBLE, 4) AS reference_logloss, promoted FROM registry""")
oracle("l1_incremental_ingest", """
WITH stored AS (SELECT * FROM contests WHERE status = 'finished' AND match_id % 4 <> 0),
arriving AS (SELECT * FROM second_source WHERE home_id <> 24 AND away_id <> 24)
SELECT coalesce(n.match_id, o.match_id) AS match_id, coalesce(n.league_id, o.league_id) AS league_id, coalesce(n.season, o.season) AS season,
       coalesce(n.date, o.date) AS date, coalesce(n.home_id, o.home_id) AS home_id, coalesce(n.away_id, o.away_id) AS away_id,
       coalesce(n.home_goals, o.home_goals) AS home_goals, coalesce(n.away_goals, o.away_goals) AS away_goals,
       coalesce(n.home_xg, o.home_xg) AS home_xg, coalesce(n.away_xg, o.away_xg) AS away_xg, false AS rejected
FROM stored o FULL OUTER JOIN arriving n ON n.match_id = o.match_id
UNION ALL
SELECT match_id, league_id, season, date, nullif(home_id, 24), nullif(away_id, 24), home_goals, away_goals, home_xg, away_xg, true
FROM second_source WHERE home_id = 24 OR away_id = 24""")
oracle("l1_reconciled_ingest", """
WITH stored AS (SELECT * FROM contests WHERE status = 'finished' AND match_id % 40 <> 3),
checked AS (SELECT n.*, CASE WHEN n.home_id = 24 OR n.away_id = 24 THEN 'unknown name' WHEN o.match_id IS NULL THEN 'missing'
    WHEN o.home_goals <> n.home_goals OR o.away_goals <> n.away_goals THEN 'score' WHEN abs(n.date - o.date) > 1 THEN 'date' END AS violation
  FROM second_source n LEFT JOIN stored o ON o.match_id = n.match_id)
SELECT o.match_id, o.league_id, o.season, o.date, o.home_id, o.away_id, o.home_goals, o.away_goals, n.home_xg, n.away_xg, NULL AS violation
FROM stored o LEFT JOIN checked n ON n.match_id = o.match_id AND n.violation IS NULL
UNION ALL
SELECT match_id, league_id, season, date, nullif(home_id, 24), nullif(away_id, 24), home_goals, away_goals, home_xg, away_xg, violation
FROM checked WHERE violation IS NOT NULL""")
oracle("l1_feature_refresh", ORACLES["h23_feature_set"])
_CHANGED["l1_feature_refresh"] = {"contests": f"""
SELECT * REPLACE (home_goals + CASE WHEN match_id % 97 = 0 THEN 1 ELSE 0 END AS home_goals,
                  CASE WHEN match_id % 89 = 0 THEN date + 3 ELSE date END AS date)
FROM ({_CTES["contests"]})"""}
oracle("l2_incremental_ratings", """
SELECT match_id, round(rating_own_home, 6) AS rating_own_home, round(rating_own_away, 6) AS rating_own_away,
       round(rating_own_home_post, 6) AS rating_own_home_post, round(rating_own_away_post, 6) AS rating_own_away_post FROM own_ratings""")
