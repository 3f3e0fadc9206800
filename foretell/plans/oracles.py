"""The queries in SQL for another engine, over the same tables."""

from __future__ import annotations

import re

from foretell.schema import ALIASES, DELTAS, EWM, FEATURES, GOAL_FEATURES, MOMENTA, RATES, SCOPES, SHOT_FEATURES, SIDES, TEAM_METRICS, VENUE_MEANS, VENUE_SUMS, WINDOW_MEANS, WINDOW_SUMS
from foretell.sources.derived import FORMULAS, MATCHES_CTE

_METRICS = ["points", "form_score", "goal_diff", "goals_for", "goals_against", "shots", "sot", "corners", "fouls", "yellow_cards", "red_cards", "shots_against", "sot_against", "corners_against"]
_KEYS = "League, MatchDate, Team"


def _r(sql: str, name: str) -> str:
    return f"round({sql}, 6) + 0.0 AS {name}"


def _sides() -> str:
    """Two rows a match; metrics of unplayed matches are null."""

    def side(own: str, other: str) -> str:
        gf, ga = f"FullTime{own}Goals", f"FullTime{other}Goals"
        values = {
            "points": f"CASE WHEN {gf} > {ga} THEN 3.0 WHEN {gf} = {ga} THEN 1.0 ELSE 0.0 END", "form_score": f"sign({gf} - {ga})", "goal_diff": f"{gf} - {ga}", "goals_for": gf, "goals_against": ga,
            "shots": f"{own}Shots", "sot": f"{own}ShotsOnTarget", "corners": f"{own}Corners", "fouls": "NULL", "yellow_cards": f"{own}YellowCards", "red_cards": f"{own}RedCards",
            "shots_against": f"{other}Shots", "sot_against": f"{other}ShotsOnTarget", "corners_against": f"{other}Corners",
        }
        columns = ", ".join(f"CASE WHEN FullTimeResult IS NOT NULL THEN CAST({v} AS DOUBLE) END AS {m}" for m, v in values.items())
        return f"SELECT MatchKey, League, Season, MatchDate, date_diff('day', DATE '1970-01-01', MatchDate) AS day, {own}Team AS Team, {other}Team AS Opponent, {'true' if own == 'Home' else 'false'} AS IsHome, CASE WHEN FullTimeResult IS NOT NULL THEN 1 END AS played, {columns} FROM matches"

    return f"sides AS ({side('Home', 'Away')} UNION ALL {side('Away', 'Home')})"


_BEFORE = "ORDER BY day RANGE BETWEEN {days} PRECEDING AND 1 PRECEDING"
_LONG = f"""{_sides()},
long AS (
  SELECT *, count(played) OVER (PARTITION BY League, Team {_BEFORE.format(days="UNBOUNDED")}) AS seq,
    count(played) OVER (PARTITION BY League, Team, IsHome {_BEFORE.format(days="UNBOUNDED")}) AS venue_seq FROM sides)"""
_FRAMES = ", ".join(
    [f"f{k} AS (PARTITION BY League, Team ORDER BY seq RANGE BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (3, 5, 8, 10)]
    + [f"v{k} AS (PARTITION BY League, Team, IsHome ORDER BY venue_seq RANGE BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (5, 10)]
    + [f"ever AS (PARTITION BY League, Team {_BEFORE.format(days='UNBOUNDED')})", f"days14 AS (PARTITION BY League, Team {_BEFORE.format(days=14)})", f"years3 AS (PARTITION BY League, Team {_BEFORE.format(days=1095)})", f"season AS (PARTITION BY League, Season, Team {_BEFORE.format(days='UNBOUNDED')})"]
)


def _whole(metric: str, frame: str) -> str:
    return f"CASE WHEN count({metric}) OVER {frame} > 0 AND count({metric}) OVER {frame} = count(played) OVER {frame} THEN sum({metric}) OVER {frame} END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} END"


def _windows(columns: dict[str, str]) -> str:
    return f"WITH {MATCHES_CTE}, {_LONG} SELECT {_KEYS}, {', '.join(_r(sql, n) if not n.startswith('=') else f'{sql} AS {n[1:]}' for n, sql in columns.items())} FROM long WINDOW {_FRAMES}"


_SUMS = {n: _whole(m, f"f{k}") for n, (m, k) in WINDOW_SUMS.items()}
_MEANS = {n: f"avg({m}) OVER f{k}" for n, (m, k) in WINDOW_MEANS.items()} | {n: f"avg(CASE WHEN form_score = {s} THEN 1.0 WHEN form_score IS NOT NULL THEN 0.0 END) OVER f5" for n, s in RATES.items()} | {n: f"avg({m}) OVER f3 - avg({m}) OVER f10" for n, m in MOMENTA.items()}
_VENUE = {f"venue_{n}": _whole(m, "v5") for n, m in VENUE_SUMS.items()} | {f"venue_{n}": f"avg(points) OVER v{k}" for n, k in VENUE_MEANS.items()}
_EFFICIENCY = {"shot_accuracy_l5": _ratio(_whole("sot", "f5"), f"({_whole('shots', 'f5')})"), "sot_conversion_l5": _ratio(_whole("goals_for", "f5"), f"({_whole('sot', 'f5')})")}
_CONTEXT = {
    "=history_matches": "seq", "=history_matches_l10": "least(seq, 10)", "=shot_observations_l10": "count(shots) OVER f10",
    "=rest_days": "day - max(CASE WHEN played = 1 THEN day END) OVER ever", "=matches_last_14_days": "count(played) OVER days14",
    "shot_share_l10": _ratio("sum(CASE WHEN shots_against IS NOT NULL THEN shots END) OVER f10", "sum(shots + shots_against) OVER f10"),
    "sot_share_l10": _ratio("sum(CASE WHEN sot_against IS NOT NULL THEN sot END) OVER f10", "sum(sot + sot_against) OVER f10"),
    "sot_diff_per_match_l10": "avg(sot - sot_against) OVER f10", "goal_diff_std_l10": "stddev_samp(goal_diff) OVER f10",
}
_WEIGHT = "pow(CAST(2 AS DOUBLE), (day - 14610) / CAST(60 AS DOUBLE))"
_DECAYED = {f"{n}_ewm": f"sum({m} * {_WEIGHT}) OVER years3 / sum(CASE WHEN {m} IS NOT NULL THEN {_WEIGHT} END) OVER years3" for n, m in EWM.items()}
_SEASON = {"season_points": "coalesce(sum(points) OVER season, 0)", "points_per_game": "avg(points) OVER season"}
_LEVELS = f"""{_LONG}, daily AS (
  SELECT League, Season, MatchDate, sum(FullTimeHomeGoals + FullTimeAwayGoals) AS goals, count(FullTimeResult) AS n FROM matches GROUP BY ALL),
upto AS (
  SELECT League, Season, MatchDate, sum(goals) OVER w AS goals, sum(n) OVER w AS n FROM daily
  WINDOW w AS (PARTITION BY League, Season ORDER BY MatchDate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT League, Season, MatchDate, CASE WHEN n > 0 THEN goals / (2 * n) END AS league_level FROM upto)"""

_ELO_RATED = f"""{MATCHES_CTE},
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY League ORDER BY MatchDate, HomeTeam) AS n FROM matches),
walk AS (
  SELECT League, CAST(0 AS BIGINT) AS n, MAP {{'': CAST(1500 AS DOUBLE)}} AS ratings, CAST(NULL AS DATE) AS MatchDate, CAST('' AS VARCHAR) AS HomeTeam, CAST('' AS VARCHAR) AS AwayTeam,
    CAST(0 AS DOUBLE) AS home_elo, CAST(0 AS DOUBLE) AS away_elo
  FROM (SELECT DISTINCT League FROM steps)
  UNION ALL
  SELECT League, n, CASE WHEN score IS NULL THEN ratings ELSE map_concat(ratings, MAP {{HomeTeam: h + 32 * (score - 1 / (1 + pow(CAST(10 AS DOUBLE), -(h + 60 - a) / 400))), AwayTeam: a - 32 * (score - 1 / (1 + pow(CAST(10 AS DOUBLE), -(h + 60 - a) / 400)))}}) END,
    MatchDate, HomeTeam, AwayTeam, h, a
  FROM (
    SELECT s.League, s.n, w.ratings, s.MatchDate, s.HomeTeam, s.AwayTeam, coalesce(w.ratings[s.HomeTeam], 1500) AS h, coalesce(w.ratings[s.AwayTeam], 1500) AS a,
      CASE s.FullTimeResult WHEN 'H' THEN 1.0::DOUBLE WHEN 'D' THEN 0.5::DOUBLE WHEN 'A' THEN 0.0::DOUBLE END AS score
    FROM walk w JOIN steps s ON s.League = w.League AND s.n = w.n + 1)),
rated AS (SELECT *, 1 / (1 + pow(CAST(10 AS DOUBLE), -(home_elo + 60 - away_elo) / 400)) AS expected FROM walk WHERE n > 0)"""

_ELO_FORM = f"""scored AS (SELECT r.*, CASE m.FullTimeResult WHEN 'H' THEN 1.0 WHEN 'D' THEN 0.5 WHEN 'A' THEN 0.0 END AS score FROM rated r JOIN matches m USING (League, MatchDate, HomeTeam, AwayTeam)),
both_ AS (
  SELECT League, MatchDate, date_diff('day', DATE '1970-01-01', MatchDate) AS day, HomeTeam AS Team, CASE WHEN score IS NOT NULL THEN away_elo END AS other, score - expected AS over_ FROM scored
  UNION ALL SELECT League, MatchDate, date_diff('day', DATE '1970-01-01', MatchDate), AwayTeam, CASE WHEN score IS NOT NULL THEN home_elo END, (1 - score) - (1 - expected) FROM scored),
numbered AS (SELECT *, count(other) OVER (PARTITION BY League, Team {_BEFORE.format(days="UNBOUNDED")}) AS seq FROM both_)"""

_PLACED = """members AS (
  SELECT League, Season, MatchDate, day, Team, Opponent, unnest([Team, Opponent]) AS Club FROM sides
  UNION SELECT s.League, s.Season, s.MatchDate, s.day, s.Team, s.Opponent, p.Team FROM sides s
  JOIN (SELECT League, Season, Team, min(day) AS first FROM sides WHERE played = 1 GROUP BY ALL) p ON s.League = p.League AND s.Season = p.Season AND p.first < s.day),
totals AS (
  SELECT League, Season, Team, day, sum(points) OVER w AS p, sum(goal_diff) OVER w AS d, sum(goals_for) OVER w AS g, max(day) OVER w AS last
  FROM sides WHERE played = 1 WINDOW w AS (PARTITION BY League, Season, Team ORDER BY day)),
placed AS (
  SELECT m.League, m.MatchDate, m.Team, m.Club,
    row_number() OVER (PARTITION BY m.League, m.Season, m.day, m.Team ORDER BY coalesce(p, 0) DESC, coalesce(d, 0) DESC, coalesce(g, 0) DESC, m.Club) AS position
  FROM members m ASOF LEFT JOIN totals t ON m.League = t.League AND m.Season = t.Season AND m.Club = t.Team AND m.day > t.day)"""
_STANDINGS = f"""WITH {MATCHES_CTE}, {_LONG}, {_PLACED}
SELECT League, MatchDate, Team, CAST(position AS INT) AS position FROM placed WHERE Club = Team"""

_ID = "League || '_' || strftime(MatchDate, '%Y%m%d') || '_' || HomeTeam || '_' || AwayTeam"
_IMPLIED = [f"(1 / B365{r}) / (1 / B365H + 1 / B365D + 1 / B365A)" for r in "HDA"]
_PLAYED = f"""WITH {MATCHES_CTE}, played AS (
  SELECT MatchKey, League, Season, CASE FullTimeResult WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS y, {", ".join(f"{p} AS p{k}" for k, p in enumerate(_IMPLIED))}
  FROM matches WHERE FullTimeResult IS NOT NULL),
apart AS ({" UNION ALL ".join(f"SELECT League, {k} AS k, p{k} AS p, CASE WHEN y = {k} THEN 1 ELSE 0 END AS hit, CASE WHEN {best} THEN 1 ELSE 0 END AS chosen FROM played" for k, best in enumerate(("p0 >= p1 AND p0 >= p2", "p1 > p0 AND p1 >= p2", "p2 > p0 AND p2 > p1")))})"""
_OWN = "CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END"
_RIGHT = "CASE WHEN y = CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END THEN 1.0 ELSE 0.0 END"
_USABLE = "FullTimeResult IS NOT NULL AND PSCH > 1 AND PSCD > 1 AND PSCA > 1"
_PRICED = f"""WITH {MATCHES_CTE}, priced AS (
  SELECT {_ID} AS MatchId, Season, League, FullTimeResult AS result, {", ".join(f"{p} AS {r}" for p, r in zip(_IMPLIED, "HDA"))},
    {", ".join(f"PSC{r} AS price_{r}, (1 / PSC{r}) / (1 / PSCH + 1 / PSCD + 1 / PSCA) AS market_{r}" for r in "HDA")}
  FROM matches WHERE {_USABLE}),
bets AS ({" UNION ALL ".join(f"SELECT MatchId, Season, League, '{r}' AS outcome, price_{r} AS price, {r} AS model_prob, market_{r} AS market_prob, {r} * price_{r} - 1 AS expected_value, CASE WHEN result = '{r}' THEN price_{r} - 1 ELSE -1.0 END AS profit, result = '{r}' AS won FROM priced" for r in "HDA")})"""


def _team() -> str:
    def side(own: str, other: str) -> str:
        win, loss = ("H", "A") if own == "Home" else ("A", "H")
        values = {
            "points": f"CASE FullTimeResult WHEN '{win}' THEN 3 WHEN 'D' THEN 1 WHEN '{loss}' THEN 0 END", "goals_for": f"FullTime{own}Goals", "goals_against": f"FullTime{other}Goals", "goal_diff": f"FullTime{own}Goals - FullTime{other}Goals",
            "shots_for": f"{own}Shots", "shots_against": f"{other}Shots", "sot_for": f"{own}ShotsOnTarget", "sot_against": f"{other}ShotsOnTarget", "corners_for": f"{own}Corners", "corners_against": f"{other}Corners",
            "yellow_cards": f"{own}YellowCards", "red_cards": f"{own}RedCards",
        } | {o: f"coalesce(CAST(FullTimeResult = '{r}' AS INT), 0)" for o, r in (("win", win), ("draw", "D"), ("loss", loss))}
        return f"SELECT {_ID} AS MatchId, MatchDate, {own}Team AS Team, {int(own == 'Home')} AS IsHome, {', '.join(f'CAST({v} AS DOUBLE) AS _{m}' for m, v in values.items())} FROM matches"

    inside = {"total": "1", "home": "IsHome", "away": "(1 - IsHome)"}
    counts = ", ".join(f"coalesce(sum({inside[s]}) OVER w, 0) AS n_{s}" for s in SCOPES)
    return f"""WITH {MATCHES_CTE}, rows_ AS ({side("Home", "Away")} UNION ALL {side("Away", "Home")}),
team AS (SELECT *, {counts} FROM rows_ WINDOW w AS (PARTITION BY Team ORDER BY MatchDate, MatchId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _team_sum(m: str, s: str, k: int) -> str:
    only = {"total": "TRUE", "home": "IsHome = 1", "away": "IsHome = 0"}[s]
    return f"sum(CASE WHEN {only} THEN _{m} END) OVER {s}{k}"


_TEAM_FRAMES = ", ".join(f"{s}{k} AS (PARTITION BY Team ORDER BY n_{s} RANGE BETWEEN {k} PRECEDING AND 1 PRECEDING)" for s in SCOPES for k in (5, 10))
_SK = [(s, k) for s in SCOPES for k in (5, 10)]
_EDGES = f"""WITH {MATCHES_CTE}, edges AS (
  SELECT MatchKey, 0.45::DOUBLE - {_IMPLIED[0]} AS h, 0.25::DOUBLE - {_IMPLIED[1]} AS d, 0.3::DOUBLE - {_IMPLIED[2]} AS a FROM matches),
rounded AS (SELECT MatchKey, {_r("h", "edge_home")}, {_r("d", "edge_draw")}, {_r("a", "edge_away")}, {_r("greatest(h, d, a)", "best_edge")} FROM edges)
SELECT * FROM rounded"""
_LABEL = "CASE FullTimeResult WHEN 'H' THEN 0 WHEN 'D' THEN 1 WHEN 'A' THEN 2 END"
_PLAIN = ["MatchKey", "League", "MatchDate", "HomeTeam", "AwayTeam", "FullTimeResult", "Season"]


def _named(columns: dict[str, str]) -> str:
    return ", ".join(f"CAST({sql} AS DOUBLE) AS {n.removeprefix('=')}" for n, sql in columns.items())


#: Features of one side, each with its place in ``side``, and the frame of a match, all without the count models' columns.
_SIDE = _SEASON
_ENGINEERED = f"""WITH RECURSIVE {_ELO_RATED}, {_LEVELS}, {_ELO_FORM}, {_PLACED},
formed AS (
  SELECT {_KEYS}, avg(other) OVER f AS opponent_elo_mean_l5, avg(over_) OVER f AS result_overperformance_l5 FROM numbered
  WINDOW f AS (PARTITION BY League, Team ORDER BY seq RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)),
own AS (
  SELECT League, Season, MatchDate, Team, {_named(_SIDE)}, avg(goals_for) OVER f10 AS scored_l10, avg(goals_against) OVER f10 AS conceded_l10 FROM long WINDOW {_FRAMES}),
side AS MATERIALIZED (
  SELECT o.*, {_ratio("scored_l10", "league_level")} AS attack_strength_l10, {_ratio("conceded_l10", "league_level")} AS defensive_strength_l10,
    CAST(p.position AS DOUBLE) AS position, f.opponent_elo_mean_l5, f.result_overperformance_l5
  FROM own o JOIN levels USING (League, Season, MatchDate) JOIN formed f USING (League, MatchDate, Team)
  JOIN (SELECT * FROM placed WHERE Club = Team) p USING (League, MatchDate, Team)),
paired AS (
  SELECT m.MatchKey, m.Season, m.MatchDate, m.HomeTeam, m.AwayTeam, {_ID.replace("League", "m.League").replace("MatchDate", "m.MatchDate").replace("HomeTeam", "m.HomeTeam").replace("AwayTeam", "m.AwayTeam")} AS MatchId, r.home_elo, r.away_elo, h AS home, a AS away
  FROM matches m JOIN rated r USING (League, MatchDate, HomeTeam, AwayTeam)
  JOIN side h ON m.League = h.League AND m.MatchDate = h.MatchDate AND m.HomeTeam = h.Team
  JOIN side a ON m.League = a.League AND m.MatchDate = a.MatchDate AND m.AwayTeam = a.Team)"""


def _paired(columns: dict[str, str]) -> str:
    """Matches with both sides' plain window columns."""
    return f"""WITH {MATCHES_CTE}, {_LONG},
own AS MATERIALIZED (SELECT League, MatchDate, Team, {_named(columns)} FROM long WINDOW {_FRAMES}),
paired AS (
  SELECT m.MatchKey, h AS home, a AS away FROM matches m
  JOIN own h ON m.League = h.League AND m.MatchDate = h.MatchDate AND m.HomeTeam = h.Team
  JOIN own a ON m.League = a.League AND m.MatchDate = a.MatchDate AND m.AwayTeam = a.Team)"""


def _feature(name: str) -> str:
    name = ALIASES.get(name, name)
    if name in DELTAS:
        return f"home.{DELTAS[name]} - away.{DELTAS[name]}"
    lead = "(home_elo + 60 - away_elo)"
    chance = f"1 / (1 + pow(CAST(10 AS DOUBLE), -{lead} / 400))"
    special = {"home_adjusted_elo_diff": lead, "home_elo_expected": chance, "away_elo_expected": f"1 - {chance}", "home_elo": "home_elo", "away_elo": "away_elo", "elo_diff": "home_elo - away_elo"}
    if name in special:
        return special[name]
    side, _, rest = name.partition("_")
    if side not in SIDES:
        return f"home.{name.removesuffix('_diff')} - away.{name.removesuffix('_diff')}"
    if rest.startswith(f"{side}_"):
        return f"{side}.venue_{rest.removeprefix(f'{side}_')}"
    return f"{side}.{'season_points' if rest == 'points' else rest}"


_FORMED, _SEASONED = _SUMS | _MEANS | _VENUE | _EFFICIENCY, _CONTEXT | _DECAYED | _SEASON
#: The features that rest on windows of results, on the calendar, decay and season, and on ratings and standings.
FORM_FEATURES, CALENDAR_FEATURES, STRENGTH_FEATURES = [], [], []


def _deal_features() -> None:
    windowed, calendar = ({n.removeprefix("=") for n in x} for x in (_FORMED, _SEASONED))
    for name in FEATURES:
        if name in GOAL_FEATURES + SHOT_FEATURES:
            continue
        sql = _feature(name)
        used = set(re.findall(r"(?:home|away)\.(\w+)", sql))
        (FORM_FEATURES if used and used <= windowed else CALENDAR_FEATURES if used and used <= calendar else STRENGTH_FEATURES).append(name)


_deal_features()


def _selected(names: list[str]) -> str:
    return f"SELECT MatchKey, {', '.join(_r(_feature(c), c) for c in names)} FROM paired"


_SEEN = {"position": "position", "season_points": "season_points", "season_ppg": "points_per_game"}


def _perspective(own: str, other: str) -> str:
    columns = {f"{who}_{n}": f"{s}.{c}" for who, s in (("team", own), ("opponent", other)) for n, c in _SEEN.items()}
    columns |= {"team_elo": f"{own}_elo", "opponent_elo": f"{other}_elo", "team_elo_expected": _feature(f"{own}_elo_expected"), "position_advantage": f"{other}.position - {own}.position", "elo_difference": f"{own}_elo - {other}_elo"}
    return f"SELECT MatchId, {own.capitalize()}Team AS Team, {', '.join(_r(sql, n) for n, sql in columns.items())} FROM paired"


_BRIER = " + ".join(f"pow(p{k} - CASE WHEN y = {k} THEN 1 ELSE 0 END, 2)" for k in range(3))
_DAYS = f"""WITH {MATCHES_CTE}, rows_ AS (SELECT MatchDate FROM matches WHERE FullTimeResult IS NOT NULL),
days AS (SELECT MatchDate, row_number() OVER (ORDER BY MatchDate) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT MatchDate FROM rows_))"""
_SIDED = f"""{_PLAYED}, told AS (
  SELECT 2 - y AS y, p2 AS p0, p1, p0 AS p2 FROM played UNION ALL SELECT y, p0, p1, p2 FROM played),
split AS ({" UNION ALL ".join(f"SELECT {k} AS k, p{k} AS p, CASE WHEN y = {k} THEN 1 ELSE 0 END AS hit FROM told" for k in range(3))}),
ranked AS (SELECT k, hit, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0 AS r FROM split),
areas AS (SELECT k, sum(hit)::DOUBLE AS h, count(*)::DOUBLE - sum(hit) AS m, sum(CASE WHEN hit = 1 THEN r END)::DOUBLE AS s FROM ranked GROUP BY k),
ginis AS (SELECT {", ".join(f"max(CASE WHEN k = {k} AND h > 0 AND m > 0 THEN 2 * (s - h * (h + 1) / 2) / (h * m) - 1 END) AS g{k}" for k in range(3))} FROM areas),
shares AS (SELECT {", ".join(f"avg(CASE WHEN y = {k} THEN 1.0::DOUBLE ELSE 0.0 END) AS s{k}" for k in range(3))} FROM told)"""

ORACLES: dict[str, str] = {
    "p6_date_split": f"""{_DAYS}, cut AS (SELECT *, least(greatest(1, CAST(floor(n * 0.65::DOUBLE) AS BIGINT)), n - 2) AS a FROM days),
cuts AS (SELECT MatchDate, CASE WHEN i < a THEN 'train' WHEN i < least(greatest(a + 1, CAST(floor(n * 0.85::DOUBLE) AS BIGINT)), n - 1) THEN 'validation' ELSE 'test' END AS part FROM cut)
SELECT part, count(*) AS rows, min(MatchDate) AS first, max(MatchDate) AS last FROM rows_ JOIN cuts USING (MatchDate) GROUP BY part""",
    "p13_preview": f"""WITH {MATCHES_CTE} SELECT MatchDate, League, HomeTeam, AwayTeam, HomeShots, FullTimeResult AS target FROM matches
WHERE FullTimeResult IS NOT NULL AND MatchDate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' ORDER BY MatchDate DESC, League, HomeTeam, AwayTeam LIMIT 100""",
    "e1_folds": f"""{_DAYS}, kept AS (SELECT *, least(CAST(floor(n * 0.85::DOUBLE) AS BIGINT), n - 1) AS h FROM days),
placed AS (SELECT *, i - h // 2 AS j, h - h // 2 AS rest FROM kept),
folds AS (SELECT *, CASE WHEN j < rest % 3 * (rest // 3 + 1) THEN j // (rest // 3 + 1) ELSE rest % 3 + (j - rest % 3 * (rest // 3 + 1)) // (rest // 3) END + 1 AS fold FROM placed WHERE i < h AND j >= 0),
spans AS (SELECT fold, min(MatchDate) AS eval_start, max(MatchDate) AS eval_end FROM folds GROUP BY fold)
SELECT CAST(fold AS INT) AS fold, count(*) FILTER (WHERE MatchDate < eval_start) AS train_rows, max(MatchDate) FILTER (WHERE MatchDate < eval_start) AS train_end, eval_start, eval_end,
  count(*) FILTER (WHERE MatchDate BETWEEN eval_start AND eval_end) AS eval_rows, (SELECT min(MatchDate) FROM kept WHERE i = h) AS holdout_start
FROM rows_ CROSS JOIN spans GROUP BY fold, eval_start, eval_end""",
    "p9_outcomes": f"""{_PLAYED}, sure AS (SELECT *, greatest(p0, p1, p2) >= 0.5 AS kept FROM played)
{" UNION ALL ".join(f"SELECT League, '{o}' AS outcome, {_r(f'avg(p{k}) FILTER (WHERE kept)', 'model_probability')}, {_r(f'avg(CASE WHEN y = {k} THEN 1.0 ELSE 0.0 END) FILTER (WHERE kept)', 'observed_frequency')} FROM sure GROUP BY League" for k, o in enumerate(("home", "draw", "away")))}""",
    "p9_unfiltered": f"""{_PLAYED} SELECT League, count(*) AS total, count(*) AS kept, {_r(f"avg({_RIGHT})", "accuracy_kept")}, CAST(0 AS BIGINT) AS filtered_out, 1.0::DOUBLE AS share_kept FROM played GROUP BY League""",
    "a3_market_summary": f"""{_PLAYED}, seasons AS (SELECT League, Season, count(*) AS n, avg(-ln({_OWN})) AS l, avg({_BRIER}) AS b, avg({_RIGHT}) AS a FROM played GROUP BY League, Season)
SELECT League, CAST(sum(n) AS BIGINT) AS rows, {_r("sum(l * n) / sum(n)", "log_loss")}, {_r("sum(b * n) / sum(n)", "brier_score")}, {_r("sum(a * n) / sum(n)", "accuracy")} FROM seasons GROUP BY League""",
    "m9_evaluation": f"""{_SIDED} SELECT count(*) AS rows, {_r(f"avg({_RIGHT})", "accuracy")}, {_r(f"avg(-ln({_OWN}))", "log_loss")},
  {", ".join(_r(f"any_value(g{k})", f"gini_{o}") for k, o in enumerate(("loss", "draw", "win")))}, {_r("any_value((g0 + g1 + g2) / 3)", "gini_macro")},
  {_r("avg(CASE WHEN y = CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END THEN 1.0 ELSE 0.0 END)", "dummy_accuracy")},
  {_r("avg(-ln(CASE y WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END))", "dummy_log_loss")}, {", ".join(_r(f"any_value(s{k})", f"dummy_prior_{o}") for k, o in enumerate(("loss", "draw", "win")))}
FROM told CROSS JOIN ginis CROSS JOIN shares""",
    "s8_matches": f"WITH {MATCHES_CTE} SELECT {', '.join([*_PLAIN, *[_r(c, c) for c in FORMULAS]])} FROM matches",
    "s6_ragged_files": f"""WITH {MATCHES_CTE}, told AS (SELECT *, year(MatchDate) % 2 = 0 AS even FROM matches)
SELECT League AS Div, MatchDate, HomeTeam, AwayTeam, FullTimeHomeGoals, FullTimeAwayGoals, CASE WHEN NOT even THEN HomeShots END AS HomeShots, CASE WHEN NOT even THEN AwayShots END AS AwayShots,
  {_r("CASE WHEN NOT even THEN B365H END", "B365H")}, {_r("B365H", "AvgH")} FROM told""",
    "p1_prepared": f"WITH {MATCHES_CTE} SELECT MatchKey, League, Season, MatchDate, HomeTeam, AwayTeam, FullTimeResult AS target, {_LABEL} AS target_label FROM matches",
    "p5_modeling_rows": f"WITH {MATCHES_CTE} SELECT MatchKey, {_LABEL} AS target_label FROM matches WHERE FullTimeResult IS NOT NULL",
    "p6_time_split": f"""WITH {MATCHES_CTE} SELECT CASE WHEN year(MatchDate) <= 1996 THEN 'train' WHEN year(MatchDate) <= 1998 THEN 'validation' ELSE 'test' END AS part,
  count(*) AS rows, min(MatchDate) AS first, max(MatchDate) AS last FROM matches WHERE FullTimeResult IS NOT NULL GROUP BY part""",
    "p17_match_ids": f"""WITH {MATCHES_CTE} SELECT MatchKey, {_ID} AS MatchId, year(MatchDate) || '/' || lpad(CAST((year(MatchDate) + 1) % 100 AS VARCHAR), 2, '0') AS season_label,
  lpad(CAST(year(MatchDate) % 100 AS VARCHAR), 2, '0') || lpad(CAST((year(MatchDate) + 1) % 100 AS VARCHAR), 2, '0') AS season_code FROM matches""",
    "u1_long_form": f"WITH {MATCHES_CTE}, {_sides()} SELECT League, Season, MatchDate, Team, Opponent, IsHome, played, {', '.join(_METRICS)} FROM sides",
    "u3_repeated_appearances": f"WITH {MATCHES_CTE} SELECT MatchDate, Team, count(*) AS n FROM (SELECT MatchDate, HomeTeam AS Team FROM matches UNION ALL SELECT MatchDate, AwayTeam FROM matches) GROUP BY ALL HAVING count(*) > 1",
    "w1_window_sums": _windows(_SUMS),
    "w3_window_means": _windows(_MEANS),
    "w6_venue_windows": _windows(_VENUE),
    "w7_efficiency": _windows(_EFFICIENCY),
    "w9_context": _windows(_CONTEXT),
    "w15_decayed_means": _windows(_DECAYED),
    "w16_season_points": _windows(_SEASON),
    "features_form": f"{_paired(_FORMED)} {_selected(FORM_FEATURES)}",
    "features_calendar": f"{_paired(_SEASONED)} {_selected(CALENDAR_FEATURES)}",
    "features_strength": f"{_ENGINEERED} {_selected(STRENGTH_FEATURES)}",
    "t6_strengths": f"{_ENGINEERED} {_perspective('home', 'away')} UNION ALL {_perspective('away', 'home')}",
    "a12_league_level": f"WITH {MATCHES_CTE}, {_LEVELS} SELECT League, Season, MatchDate, {_r('league_level', 'league_level')} FROM levels",
    "w8_strengths": f"WITH {MATCHES_CTE}, {_LEVELS}, met AS (SELECT * FROM long JOIN levels USING (League, Season, MatchDate)) SELECT {_KEYS}, {_r(_ratio('avg(goals_for) OVER f10', 'league_level'), 'attack_strength_l10')}, {_r(_ratio('avg(goals_against) OVER f10', 'league_level'), 'defensive_strength_l10')} FROM met WINDOW {_FRAMES}",
    "w17_standings": _STANDINGS,
    "w18_elo": f"WITH RECURSIVE {_ELO_RATED} SELECT League, MatchDate, HomeTeam, AwayTeam, {_r('home_elo', 'home_elo')}, {_r('away_elo', 'away_elo')}, {_r('expected', 'home_elo_expected')} FROM rated",
    "w13_opponent_elo": f"""WITH RECURSIVE {_ELO_RATED}, {_ELO_FORM}
SELECT {_KEYS}, {_r("avg(other) OVER f", "opponent_elo_mean_l5")}, {_r("avg(over_) OVER f", "result_overperformance_l5")} FROM numbered
WINDOW f AS (PARTITION BY League, Team ORDER BY seq RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
    "t1_team_history": f"{_team()} SELECT MatchId, Team, {', '.join([f'CAST(n_{s} AS BIGINT) AS history_matches_{s}' for s in SCOPES] + [f'CAST(least(n_{s}, {k}) AS BIGINT) AS matches_{s}_l{k}' for s, k in _SK])} FROM team",
    "t3_team_sums": f"{_team()} SELECT MatchId, Team, {', '.join(_r(_team_sum(m, s, k), f'{m}_{s}_l{k}') for s, k in _SK for m in TEAM_METRICS)} FROM team WINDOW {_TEAM_FRAMES}",
    "t4_team_rates": f"{_team()} SELECT MatchId, Team, {', '.join(_r(f'{_team_sum(m, s, k)} / nullif(least(n_{s}, {k}), 0)', n) for s, k in _SK for m, n in [('points', f'ppg_{s}_l{k}'), *[(o, f'{o}_rate_{s}_l{k}') for o in ('win', 'draw', 'loss')]])} FROM team WINDOW {_TEAM_FRAMES}",
    "a4_priors": f"{_PLAYED} SELECT {', '.join(_r(f'avg(CASE WHEN y = {k} THEN 1.0 ELSE 0.0 END)', f'prior_{k}') for k in range(3))} FROM played",
    "a5_calibration": f"""{_PLAYED} SELECT CASE k WHEN 0 THEN 'H' WHEN 1 THEN 'D' ELSE 'A' END AS outcome, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS count,
  {_r("avg(p)", "mean_probability")}, {_r("avg(hit)", "observed_frequency")} FROM apart GROUP BY 1, 2""",
    "a6_metrics": f"{_PLAYED} SELECT League, count(*) AS rows, {_r(f'avg(-ln({_OWN}))', 'log_loss')}, {_r(f'avg({_RIGHT})', 'accuracy')}, {_r('avg(' + ' + '.join(f'pow(p{k} - CASE WHEN y = {k} THEN 1 ELSE 0 END, 2)' for k in range(3)) + ')', 'brier_score')} FROM played GROUP BY League",
    "a7_gini": f"""{_PLAYED}, ranked AS (
  SELECT League, k, hit, rank() OVER (PARTITION BY League, k ORDER BY p) + (count(*) OVER (PARTITION BY League, k, p) - 1) / 2.0 AS r FROM apart),
areas AS (SELECT League, k, sum(hit)::DOUBLE AS h, count(*)::DOUBLE - sum(hit) AS m, sum(CASE WHEN hit = 1 THEN r END)::DOUBLE AS s FROM ranked GROUP BY ALL),
ginis AS (SELECT League, {", ".join(f"max(CASE WHEN k = {k} AND h > 0 AND m > 0 THEN 2 * (s - h * (h + 1) / 2) / (h * m) - 1 END) AS g{k}" for k in range(3))} FROM areas GROUP BY League)
SELECT League, {_r("g0", "gini_home")}, {_r("g1", "gini_draw")}, {_r("g2", "gini_away")}, {_r("(g0 + g1 + g2) / 3", "gini_macro")} FROM ginis""",
    "a7_binary_metrics": f"{_PLAYED} SELECT League, {', '.join(_r(f'avg(-ln(CASE WHEN y = {k} THEN p{k} ELSE 1 - p{k} END))', f'log_loss_{o}') + ', ' + _r(f'avg(pow(p{k} - CASE WHEN y = {k} THEN 1 ELSE 0 END, 2))', f'brier_{o}') for k, o in enumerate(('home', 'draw', 'away')))} FROM played GROUP BY League",
    "a8_roc": f"""{_PLAYED}, scores AS (SELECT League, k, p, sum(hit) AS hits, count(*) - sum(hit) AS misses FROM apart GROUP BY ALL),
curve AS (
  SELECT *, sum(hits) OVER d AS tp, sum(misses) OVER d AS fp, lead(hits) OVER o AS more_h, lead(misses) OVER o AS more_m, sum(hits) OVER t AS h, sum(misses) OVER t AS m
  FROM scores WINDOW d AS (PARTITION BY League, k ORDER BY p DESC ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY League, k ORDER BY p DESC), t AS (PARTITION BY League, k)),
corners AS (SELECT League, k, fp, tp, h, m FROM curve WHERE h > 0 AND m > 0 AND (more_h IS NULL OR more_h * misses <> more_m * hits)
  UNION ALL SELECT DISTINCT League, k, 0, 0, h, m FROM curve WHERE h > 0 AND m > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY League, k ORDER BY fp, tp) - 1 AS i, count(*) OVER (PARTITION BY League, k) AS n FROM corners)
SELECT League, CASE k WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS outcome, {_r("fp / m", "fpr")}, {_r("tp / h", "tpr")} FROM placed
WHERE n <= 300 OR floor(ceil(i * 299 / (n - 1)) * (n - 1) / 299) = i""",
    "a9_outcomes": f"{_PLAYED} SELECT League, CASE k WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS outcome, {_r('avg(p)', 'model_probability')}, {_r('avg(hit)', 'observed_frequency')}, {_r('avg(chosen)', 'predicted_share')} FROM apart GROUP BY ALL",
    "a13_missing_rates": f"WITH {MATCHES_CTE} SELECT League, {', '.join(_r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', f'missing_{c}') for c in ('FullTimeHomeGoals', 'HomeShots', 'HomeShotsOnTarget', 'PSCH'))} FROM matches GROUP BY League",
    "p9_confidence": f"""{_PLAYED}, marked AS (SELECT *, greatest(p0, p1, p2) >= 0.5 AS sure, {_RIGHT} AS correct FROM played)
SELECT League, count(*) AS total, count(*) FILTER (WHERE sure) AS kept, {_r("avg(correct) FILTER (WHERE sure)", "accuracy_kept")}, count(*) - count(*) FILTER (WHERE sure) AS filtered_out,
  {_r("count(*) FILTER (WHERE sure) / count(*)", "share_kept")} FROM marked GROUP BY League""",
    "e9_market": f"{_PRICED} SELECT MatchId, {', '.join(_r(f'market_{r}', f'market_{r}') for r in 'HDA')}, {', '.join(_r(f'price_{r}', f'price_{r}') for r in 'HDA')}, result, League FROM priced",
    "e10_bets": f"{_PRICED} SELECT MatchId, Season, League, outcome, {', '.join(_r(c, c) for c in ('price', 'model_prob', 'market_prob', 'expected_value', 'profit'))}, won FROM bets WHERE expected_value > 0.05",
    "e12_edges": _EDGES,
    "o4_best_edges": f"{_EDGES} WHERE best_edge >= 0.05 ORDER BY best_edge DESC, MatchKey LIMIT 50",
    "a10_roi": f"{_PRICED} SELECT t AS edge_threshold, count(*) AS bets, {_r('avg(CASE WHEN won THEN 1.0 ELSE 0.0 END)', 'win_rate')}, {_r('avg(profit)', 'roi')}, {_r('sum(profit)', 'profit_units')} FROM bets JOIN (SELECT unnest([0.0, 0.05, 0.1, 0.2]::DOUBLE[]) AS t) ON expected_value > t GROUP BY t",
    "a2_by_season": f"{_PRICED} SELECT Season, count(*) AS bets, {_r('avg(profit)', 'roi')}, {_r('sum(profit)', 'profit_units')} FROM bets WHERE expected_value > 0.05 GROUP BY Season",
    "a1_pooled": f"{_PRICED}, mixed AS (SELECT MatchId, Season, (H + H * 0.9::DOUBLE) / 2 AS h, D AS d, A AS a FROM priced) SELECT MatchId, Season, {', '.join(_r(f'{c} / (h + d + a)', c.upper()) for c in 'hda')} FROM mixed",
}
