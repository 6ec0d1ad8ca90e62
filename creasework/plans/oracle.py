"""The same results in DuckDB SQL: shared definitions and one select for each query."""

from math import ceil, exp, factorial

_PH = ("pp", "mid", "death")
#: Numbers of 31 bits from which on an innings counts once more, twice more .. in a draw: Poisson with mean 1.
_POISSON = [ceil(sum(exp(-1) / factorial(j) for j in range(k + 1)) * 2**31) for k in range(8)]


def _phase_sums(what: str, cond: str) -> str:
    return ", ".join(f"sum(case when phase={i} and {cond} then {what} else 0 end)" + " as {p}".replace("{p}", f"{p}_@") for i, p in enumerate(_PH))


def _rate(num: str, den: str, scale: str = "1.0", digits: int = 2) -> str:
    return f"round_even(case when {den} > 0 then {num} * {scale}::double / {den} end, {digits})"


_BAT_PHASE = ", ".join(f"sum(case when phase={i} and is_legal then bat_runs else 0 end) as {p}_runs, sum(case when phase={i} and is_legal then 1 else 0 end) as {p}_balls" for i, p in enumerate(_PH))
_BOWL_PHASE = ", ".join(f"sum(case when phase={i} and is_legal then 1 else 0 end) as {p}_balls, sum(case when phase={i} and is_legal then total_runs - bye - leg_bye else 0 end) as {p}_runs, sum(case when phase={i} and bowler_wicket then 1 else 0 end) as {p}_wickets" for i, p in enumerate(_PH))
_BAT4 = "count(*) as innings, sum(case when not_out then 1 else 0 end) as not_outs, sum(runs) as runs, sum(balls_faced) as balls"
_BAT8 = _BAT4 + ", max(runs) as highest, sum(case when runs between 50 and 99 then 1 else 0 end) as fifties, sum(case when runs >= 100 then 1 else 0 end) as hundreds, sum(case when runs = 0 and not not_out then 1 else 0 end) as ducks"
_BOWL4 = "count(*) as innings, sum(balls_bowled) as balls, sum(runs_conceded) as runs, sum(wickets) as wickets"
_AVG = _rate("runs", "(innings - not_outs)") + " as average"
_SR = _rate("runs", "balls", "100.0") + " as strike_rate"
_PHASE_SR = ", ".join(_rate(f"{p}_runs", f"{p}_balls", "100.0") + f" as {p}_sr" for p in _PH)
_PHASE_ECO = ", ".join(_rate(f"{p}_runs", f"{p}_balls", "6.0") + f" as {p}_economy" for p in _PH)


def _score(name: str, value: str, higher: bool = True, source: str = "x") -> str:
    sign = "-0.8" if higher else "0.8"
    return f"round(case when sd_{name} is null or sd_{name} < 1e-6 then 50.0 else 100 / (1 + exp({sign} * (v_{name} - av_{name}) / sd_{name})) end, 6) as {name}"


def _scored(prefix: str, source: str, metrics: dict[str, tuple[str, bool]], extra: str) -> str:
    """CTEs: median-filled values, their statistics, scores."""
    filled = ", ".join(f"coalesce(({v})::double, (select coalesce(median(({v})::double), 0.0) from {source})) as v_{n}" for n, (v, _) in metrics.items())
    stats = ", ".join(f"avg(v_{n}) as av_{n}, stddev_samp(v_{n}) as sd_{n}" for n in metrics)
    scores = ", ".join(_score(n, v, h) for n, (v, h) in metrics.items())
    return f"""{prefix}_v as (select *, {filled} from {source}), {prefix}_st as (select {stats} from {prefix}_v),
{prefix}_s as (select player_id, {extra}, {scores} from {prefix}_v, {prefix}_st)"""


def _both(cte: str, keys: str, how: str, bat: str = "batting", bowl: str = "bowling") -> str:
    ks = [k.strip() for k in keys.split(",")]
    nn = " and ".join(f"{k} is not null" for k in ks)
    cols = ", ".join(f"coalesce(a.bat_{c}, 0) as bat_{c}" if c not in ("average", "strike_rate") else f"a.bat_{c}" for c in ("innings", "not_outs", "runs", "balls", "highest", "average", "strike_rate", "fifties", "hundreds", "ducks"))
    bcols = ", ".join(f"coalesce(b.bowl_{c}, 0) as bowl_{c}" if c not in ("average", "economy") else f"b.bowl_{c}" for c in ("innings", "balls", "runs", "wickets", "economy", "average"))
    return f"""{cte}_a as (select player_id, {keys}, innings as bat_innings, not_outs as bat_not_outs, runs as bat_runs, balls as bat_balls, highest as bat_highest, {_AVG.replace(' as average', ' as bat_average')}, {_SR.replace(' as strike_rate', ' as bat_strike_rate')}, fifties as bat_fifties, hundreds as bat_hundreds, ducks as bat_ducks
 from (select player_id, {keys}, {_BAT8} from {bat} where {nn} group by all)),
{cte}_b as (select player_id, {keys}, innings as bowl_innings, balls as bowl_balls, runs as bowl_runs, wickets as bowl_wickets, {_rate('runs', 'balls', '6.0')} as bowl_economy, {_rate('runs', 'wickets')} as bowl_average
 from (select player_id, {keys}, {_BOWL4} from {bowl} where {nn} group by all)),
{cte} as (select player_id, {keys}, {cols}, {bcols} from {cte}_a a {how} join {cte}_b b using (player_id, {keys}))"""


_BAT_METRICS = {
    "s_avg": ("adj_average", True),
    "s_sr": ("adj_strike_rate", True),
    "s_pp_sr": ("pp_sr", True),
    "s_mid_sr": ("mid_sr", True),
    "s_death_sr": ("death_sr", True),
    "s_chase": ("coalesce(chase_avg,0)*0.5::double + coalesce(chase_sr,0)*0.3::double + coalesce(hp_sr,0)*0.2::double", True),
    "s_first": ("coalesce(first_avg,0)*0.6::double + coalesce(first_sr,0)*0.4::double", True),
    "s_finishes": ("coalesce(finishes,0)", True),
}
_BOWL_METRICS = {"s_economy": ("adj_economy", False), "s_bowl_avg": ("average", False), "s_bowl_sr": ("strike_rate", False), "s_dot": ("dot_pct", True), "s_pp_bowl": ("pp_economy", False), "s_mid_bowl": ("mid_economy", False), "s_death_bowl": ("death_economy", False)}

SHARED = f"""WITH sides as (select c_custkey as match_id, c_mktsegment as tournament, c_nationkey::bigint as team1_id, ((c_nationkey + 1 + c_custkey % 24) % 25)::bigint as team2_id, c_custkey * 7 % 25 as venue_id from customer),
raw0 as (select s.*, l.*, 1 + o_orderkey % 2 as innings_number, l_quantity::int % 9 as q, round(l_discount * 100)::int as dsc, round(l_tax * 100)::int as tx,
  case when o_orderkey % 2 = 0 then team1_id else team2_id end as bat_team, case when o_orderkey % 2 = 0 then team2_id else team1_id end as bowl_team
  from lineitem l join orders on l_orderkey = o_orderkey join sides s on o_custkey = s.match_id),
raw as (select match_id, match_id * 10 + innings_number as innings_id, innings_number::int as innings_number, bat_team, bowl_team,
  row_number() over (partition by match_id, innings_number order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ball_number,
  (1 + (l_partkey + l_linenumber) % 20)::int as over_number, bat_team * 11 + l_suppkey % 11 as batter_id, bowl_team * 11 + l_partkey % 11 as bowler_id,
  case when q in (5,7,8) then 0 else q end as bat_runs, (tx = 8)::int as wide, (tx = 7)::int as no_ball, 0 as bye, 0 as leg_bye, dsc >= 9 as is_wicket,
  case when dsc >= 9 then case l_returnflag || l_linestatus when 'AF' then 'bowled' when 'AO' then 'caught' when 'NF' then 'lbw' when 'NO' then 'run out' when 'RF' then 'caught and bowled' else 'stumped' end end as wicket_kind from raw0),
scores as (select match_id, sum(case when innings_number = 1 then bat_runs + wide + no_ball end) as first_total, sum(case when innings_number = 2 then bat_runs + wide + no_ball end) as second_total from raw group by 1),
balls as (select r.*, wide + no_ball as extras, bat_runs + wide + no_ball as total_runs, case when is_wicket then batter_id end as player_out_id, case when innings_number = 2 then first_total + 1 end as target,
  case when over_number between 1 and 6 then 0 when over_number between 7 and 15 then 1 else 2 end as phase, wide = 0 and no_ball = 0 as is_legal, bat_runs = 4 as is_four, bat_runs = 6 as is_six,
  wide = 0 and no_ball = 0 and bat_runs = 0 as is_dot, is_wicket and coalesce(wicket_kind not in ('run out','obstructing the field','retired hurt','retired out','timed out','handled the ball'), true) as bowler_wicket
  from raw r join scores using (match_id)),
matches as (select s.*, min(o_orderdate)::date as match_date, any_value(case when first_total > second_total then team1_id when second_total > first_total then team2_id end) as winner_id,
  case when s.match_id % 2 = 0 then team1_id else team2_id end as toss_winner_id, year(min(o_orderdate))::varchar as season
  from sides s join orders on o_custkey = s.match_id join scores using (match_id) group by all),
inn as (select innings_id, match_id, innings_number, sum(total_runs) as total_runs, sum(is_wicket::int) as total_wickets, sum(is_legal::int) as total_balls, sum(extras) as extras, max(target) as target from balls group by all),
innings as (select *, case when innings_number = 2 and target is not null then total_wickets < 10 and total_runs >= target end as chase_successful, case when innings_number = 2 and target is not null then target / 20 end as required_rr_start from inn),
bi0 as (select match_id, innings_id, innings_number, batter_id, sum(bat_runs) as runs, sum(is_legal::int) as balls_faced, sum(is_four::int) as fours, sum(is_six::int) as sixes, min(ball_number) as first_ball, {_BAT_PHASE} from balls group by all),
outs as (select innings_id, player_out_id as batter_id, arg_min(wicket_kind, ball_number) as dismissal_kind from balls where is_wicket group by all),
batter_innings as (select b.* exclude (first_ball), dismissal_kind, row_number() over (partition by b.innings_id order by first_ball, b.batter_id) as batting_position, dismissal_kind is null as not_out from bi0 b left join outs using (innings_id, batter_id)),
bowler_innings as (select *, round_even(balls_bowled / 6, 1) as overs_bowled from (select match_id, innings_id, innings_number, bowler_id, sum(is_legal::int) as balls_bowled, sum(case when is_legal then total_runs else 0 end) as runs_conceded,
  sum(bowler_wicket::int) as wickets, sum(is_dot::int) as dot_balls, sum(wide) as wides, sum(no_ball) as no_balls, sum((is_four or is_six)::int) as boundaries_con, {_BOWL_PHASE} from balls group by all)),
batting as (select b.* exclude (batter_id), b.batter_id as player_id, m.* exclude (match_id), i.required_rr_start, coalesce(i.chase_successful, false) as chase_won, b.innings_number = 2 as is_chase,
  case when b.innings_number = 1 then team1_id else team2_id end as team_id, case when b.innings_number = 1 then team2_id else team1_id end as opponent_id
  from batter_innings b join matches m using (match_id) join innings i on i.innings_id = b.innings_id),
bowling as (select b.* exclude (bowler_id), b.bowler_id as player_id, m.* exclude (match_id), case when b.innings_number = 1 then team2_id else team1_id end as team_id, case when b.innings_number = 1 then team1_id else team2_id end as opponent_id
  from bowler_innings b join matches m using (match_id)),
vd as (select venue_id, sum((is_four or is_six)::int)::double / greatest(count(*), 1) as boundary_rate, sum((is_wicket and wicket_kind in ('bowled','lbw','caught','caught and bowled','hit wicket'))::int)::double / greatest(sum(is_wicket::int), 1) as pace_index from balls join sides using (match_id) group by 1),
vp as (select venue_id, sum((innings_number = 1)::int) as n, sum(case when innings_number = 1 then total_runs else 0 end) as runs, avg(case when innings_number = 1 then total_wickets end) as avg_first_inn_wickets, avg(case when innings_number = 2 then total_runs end) as avg_second_inn_runs
  from innings join sides using (match_id) group by 1 having sum((innings_number = 1)::int) >= 5),
vm as (select sum(runs) / sum(n) as mean from vp),
venue_factors as (select vp.venue_id, n as first_innings, runs / n as avg_first_inn_runs, avg_first_inn_wickets, avg_second_inn_runs, round_even(((runs + 20 * mean) / (n + 20)) / mean, 6) as bat_factor, round_even(mean / ((runs + 20 * mean) / (n + 20)), 6) as bowl_factor,
  boundary_rate, pace_index, 1 - pace_index as spin_index from vp, vm left join vd on vd.venue_id = vp.venue_id),
cbat0 as (select player_id, case when grouping(tournament) = 1 then 'ALL' else tournament end as tournament, {_BAT8}, sum(fours) as fours, sum(sixes) as sixes, {", ".join(f"sum({p}_{w}) as {p}_{w}" for p in _PH for w in ("runs", "balls"))},
  median(runs) as median_runs, sum((runs between 30 and 49)::int) as thirties, sum((batting_position <= 2)::int) as times_opened, sum(round_even(runs / coalesce(bat_factor, 1.0), 6)::decimal(20,6))::double as adj_runs
  from batting left join venue_factors using (venue_id) group by grouping sets ((player_id), (player_id, tournament))),
career_batting as (select * exclude (adj_runs), {_AVG}, {_SR}, {_rate('adj_runs', '(innings - not_outs)')} as adj_average, {_rate('runs', 'balls', '100.0')} as adj_strike_rate, {_PHASE_SR} from cbat0),
cbowl0 as (select player_id, case when grouping(tournament) = 1 then 'ALL' else tournament end as tournament, {_BOWL4}, {", ".join(f"sum({p}_{w}) as {p}_{w}" for p in _PH for w in ("balls", "runs", "wickets"))}, sum(dot_balls) as dots,
  sum(round_even(runs_conceded / coalesce(bat_factor, 1.0), 6)::decimal(20,6))::double as adj_runs from bowling left join venue_factors using (venue_id) group by grouping sets ((player_id), (player_id, tournament))),
career_bowling as (select * exclude (adj_runs), {_rate('runs', 'balls', '6.0')} as economy, {_rate('runs', 'wickets')} as average, {_rate('balls', 'wickets')} as strike_rate, {_rate('dots', 'balls', '100.0')} as dot_pct, {_rate('adj_runs', 'balls', '6.0')} as adj_economy, {_PHASE_ECO} from cbowl0),
ch0 as (select player_id, is_chase, {_BAT4}, sum((is_chase and required_rr_start > 10)::int) as hp_n, sum(case when is_chase and required_rr_start > 10 then runs else 0 end) as hp_runs, sum(case when is_chase and required_rr_start > 10 then balls_faced else 0 end) as hp_balls, sum((is_chase and not_out and chase_won)::int) as fin from batting group by all),
chase_split as (select player_id, innings, not_outs, runs, balls, {_AVG}, {_SR}, case when is_chase then 'chase' else 'first' end as innings_type, case when is_chase then hp_n end as hp_innings, case when is_chase then {_rate('hp_runs', 'hp_balls', '100.0')} end as hp_sr, case when is_chase then fin end as finishes from ch0),
vbat as (select *, {_AVG}, {_SR} from (select player_id, venue_id, {_BAT4}, max(runs) as highest from batting group by all)),
vbowl as (select *, {_rate('runs', 'balls', '6.0')} as economy, {_rate('runs', 'wickets')} as average from (select player_id, venue_id, {_BOWL4} from bowling group by all)),
sp as (select player_id, max(case when innings_type='chase' then average end) as chase_avg, max(case when innings_type='chase' then strike_rate end) as chase_sr, max(case when innings_type='chase' then hp_sr end) as hp_sr, max(case when innings_type='chase' then finishes end) as finishes,
  max(case when innings_type='first' then average end) as first_avg, max(case when innings_type='first' then strike_rate end) as first_sr from chase_split group by 1),
rb as (select * from career_batting left join sp using (player_id) where tournament = 'ALL' and innings >= 10),
{_scored("rb", "rb", _BAT_METRICS, "adj_average, adj_strike_rate")},
batting_ratings as (select * exclude (s_finishes), round(s_first*0.4::double + s_pp_sr*0.4::double + s_avg*0.2::double, 4) as s_opener, round(s_death_sr*0.5::double + s_chase*0.3::double + s_finishes*0.2::double, 4) as s_finisher, round(s_avg*0.5::double + s_chase*0.3::double + s_mid_sr*0.2::double, 4) as s_anchor,
  round(s_avg*0.30::double + s_sr*0.20::double + s_pp_sr*0.10::double + s_mid_sr*0.10::double + s_death_sr*0.10::double + s_chase*0.20::double, 1) as bat_rating from rb_s),
rw as (select * from career_bowling where tournament = 'ALL' and innings >= 10),
{_scored("rw", "rw", _BOWL_METRICS, "adj_economy")},
bowling_ratings as (select *, round(s_economy*0.25::double + s_bowl_avg*0.20::double + s_bowl_sr*0.15::double + s_dot*0.15::double + s_pp_bowl*0.08::double + s_mid_bowl*0.08::double + s_death_bowl*0.09::double, 1) as bowl_rating from rw_s),
ov0 as (select player_id, coalesce(bat_rating, 0.0) as bat_rating, s_opener, s_finisher, s_anchor, s_pp_sr, s_death_sr, s_chase, adj_average, adj_strike_rate, coalesce(bowl_rating, 0.0) as bowl_rating, s_pp_bowl, s_mid_bowl, s_death_bowl, adj_economy from batting_ratings full join bowling_ratings using (player_id)),
overall_ratings as (select *, round(bat_rating * 0.6::double + bowl_rating * 0.4::double, 1) as overall_rating from ov0),
form as (select *, innings_total >= 10 and avg_10 > career_avg * 1.2::double as breakout_flag, avg_10 - career_avg as breakout_delta from (select player_id, count(*) as innings_total, avg(runs) as career_avg, sum(runs) / nullif(sum(balls), 0) * 100 as career_sr, case when avg(runs) > 0 then stddev_pop(runs) / avg(runs) * 100 end as cv,
  {", ".join(f"case when count(*) >= 3 then avg(case when back <= {w} then runs end) end as avg_{w}, case when count(*) >= 3 then sum(case when back <= {w} then runs else 0 end) / nullif(sum(case when back <= {w} then balls else 0 end), 0) * 100 end as sr_{w}" for w in (5, 10, 20))}
  from (select *, row_number() over (partition by player_id order by ts desc, event_id desc) as back from (select user_id as player_id, ts, event_id, value as runs, 1 + event_id % 30 as balls from events)) group by 1)),
ps as (select batter_id, bowler_id, sum((wide = 0)::int) as balls, sum(bat_runs) as runs, sum(is_wicket::int) as dismissals, sum(is_wicket::int) as wickets, sum(is_dot::int) as dots, sum((is_four or is_six)::int) as boundaries from balls group by all)"""

_RATES = f"{_rate('runs', 'balls', '100.0', 1)} as strike_rate, {_rate('runs', 'dismissals', '1.0', 1)} as average, {_rate('dots', 'balls', '100.0', 1)} as dot_pct, {_rate('boundaries', 'balls', '100.0', 1)} as boundary_pct"
_PAIR = "sum((wide = 0)::int) as balls, sum(bat_runs) as runs, sum(is_wicket::int) as dismissals, sum(is_wicket::int) as wickets, sum(is_dot::int) as dots, sum((is_four or is_six)::int) as boundaries"
_FORM_COLS = "player_id, innings_total, breakout_flag, " + ", ".join(f"round({c}, 6) as {c}" for c in ("career_avg", "career_sr", "cv", "avg_5", "avg_10", "avg_20", "sr_5", "sr_10", "sr_20", "breakout_delta"))
_RESULT = "case when winner_id is null or team_id is null then 'no_result' when winner_id = team_id then 'won' else 'lost' end as result"

_D = {
    "sr": "coalesce(nullif(b.strike_rate, 0), 120.0)",
    "avg": "coalesce(nullif(b.average, 0), 25.0)",
    "eco": "coalesce(nullif(w.economy, 0), 8.0)",
    "bpw": "coalesce(nullif(w.strike_rate, 0), 20.0)",
    "dot": "coalesce(nullif(w.dot_pct, 0) / 100, 0.35)",
}

SELECTS = {
    "ball_context": """select innings_id, ball_number, phase, is_legal, is_dot, case when is_legal then sum(is_legal::int) over (partition by innings_id, over_number order by ball_number) else 0 end as ball_in_over, cum_runs, cum_legal,
 case when innings_number = 2 and target is not null then round_even(cum_runs / greatest(1, cum_legal) * 6, 2) end as crr_at_ball, case when innings_number = 2 and target is not null then round_even(greatest(0, target - cum_runs) / greatest(1, 120 - cum_legal) * 6, 2) end as req_rate_at_ball
 from (select *, sum(total_runs) over (partition by innings_id order by ball_number) as cum_runs, sum(is_legal::int) over (partition by innings_id order by ball_number) as cum_legal from balls)""",
    "innings_totals": "select * replace (chase_successful::int as chase_successful) from innings",
    "batter_innings": "select * from batter_innings",
    "bowler_innings": "select * from bowler_innings",
    "milestones": """select * from (select match_id, innings_id, batter_id as player_id, case when runs >= 30 then 'hundred' when runs >= 20 then 'fifty' when runs >= 10 then 'thirty' when runs = 0 and not not_out then 'duck' end as milestone, runs as value from batter_innings
 union all select match_id, innings_id, bowler_id, case when wickets >= 3 then 'five_wicket_haul' when wickets = 2 then 'four_wicket_haul' end, wickets from bowler_innings) where milestone is not null""",
    "career_batting": "select * from career_batting",
    "career_bowling": "select * from career_bowling",
    "career_batting_merged": "select * from career_batting",
    "career_bowling_merged": "select * from career_bowling",
    "chase_split": "select * from chase_split",
    "position_split": f"select player_id, batting_position, innings, not_outs, runs, balls, {_AVG}, {_SR}, {_PHASE_SR} from (select player_id, batting_position, {_BAT4}, {', '.join(f'sum({p}_{w}) as {p}_{w}' for p in _PH for w in ('runs', 'balls'))} from batting where batting_position between 1 and 11 group by all)",
    "venue_batting": "select * from vbat",
    "venue_bowling": "select * from vbowl",
    "by_opponent": "|" + _both("z", "opponent_id", "full") + "|select * from z",
    "by_team": "|" + _both("z", "team_id", "full") + "|select * from z",
    "by_result": f"|brt as (select *, {_RESULT} from batting), wrt as (select *, {_RESULT} from bowling), " + _both("z", "result", "full", "brt", "wrt") + "|select * from z",
    "by_season": "|b2 as (select * from batting union all select * replace ('ALL' as tournament) from batting), w2 as (select * from bowling union all select * replace ('ALL' as tournament) from bowling), " + _both("z", "season, tournament", "left", "b2", "w2") + "|select * from z",
    "dismissal_batting": "select player_id, kind, n, round_even(n * 100.0::double / sum(n) over (partition by player_id), 1) as pct from (select player_id, dismissal_kind as kind, count(*) as n from batting where not not_out group by all)",
    "dismissal_bowling": "select player_id, kind, n, round_even(n * 100.0::double / sum(n) over (partition by player_id), 1) as pct from (select bowler_id as player_id, wicket_kind as kind, count(*) as n from balls where bowler_wicket group by all)",
    "caught_and_bowled": "select player_id, case when grouping(tournament) = 1 then 'ALL' else tournament end as tournament, sum(n) as catches, max(n) as most_in_innings from (select match_id, innings_id, bowler_id as player_id, count(*) as n from balls where wicket_kind = 'caught and bowled' group by all) join sides using (match_id) group by grouping sets ((player_id), (player_id, tournament))",
    "style_matchups": f"select *, {_RATES} from (select batter_id, case bowler_id % 8 when 0 then 'Right-arm fast' when 1 then 'Right-arm fast-medium' when 2 then 'Right-arm off-break' when 3 then 'Right-arm leg-break googly' when 4 then 'Left-arm fast' when 5 then 'Left-arm fast-medium' when 6 then 'Slow left-arm orthodox' else 'Left-arm wrist-spin' end as style, {_PAIR} from balls group by all) where balls >= 24",
    "partnerships": "select innings_id, wicket_number, sum(total_runs) as runs, sum(is_legal::int) as balls, max(is_wicket::int) as ended from (select *, 1 + coalesce(sum(is_wicket::int) over (partition by innings_id order by ball_number rows between unbounded preceding and 1 preceding), 0) as wicket_number from balls) group by all",
    "venue_factors": "select * from venue_factors",
    "venue_factor_ci": f"""|d as (select venue_id, total_runs, (concat('0x', substr(md5(innings_id::varchar), 1, 7))::bigint + draw * 2654435761) & 2147483647 as a, draw from innings join sides using (match_id) join vp using (venue_id), (select unnest(range(1, 501)) as draw) where innings_number = 1),
 e as (select *, (xor(a, a >> 15) * 739982445) & 2147483647 as b from d), f as (select *, (xor(b, b >> 12) * 695872825) & 2147483647 as c from e), g as (select venue_id, total_runs, xor(c, c >> 15) as x, draw from f),
 h as (select venue_id, sum(total_runs * times) / nullif(sum(times), 0) as m from (select venue_id, draw, total_runs, {" + ".join(f"(x >= {c})::int" for c in _POISSON)} as times from g) group by venue_id, draw)|select venue_id, round_even(quantile_cont(m, 0.05) / any_value(mean), 6) as bat_factor_lo, round_even(quantile_cont(m, 0.95) / any_value(mean), 6) as bat_factor_hi from h, vm group by venue_id""",
    "batting_ratings": "select player_id, s_avg, s_sr, s_pp_sr, s_mid_sr, s_death_sr, s_chase, s_first, s_opener, s_finisher, s_anchor, bat_rating, adj_average, adj_strike_rate from batting_ratings",
    "bowling_ratings": "select * from bowling_ratings",
    "overall_ratings": "select * from overall_ratings",
    "leaderboard": "select *, row_number() over (order by overall_rating desc nulls last, player_id) as rank from overall_ratings order by rank limit 20",
    "explorer_filter": f"select player_id, country, innings, bat_rating, bowl_rating from (select player_id, n_name as country, innings, bat_rating, bowl_rating from career_batting left join overall_ratings using (player_id) left join nation on n_nationkey = player_id // 11 where tournament = 'ALL') where innings >= 10 and player_id in (select batter_id from (select batter_id, {_PAIR} from balls where bowler_id % 8 = 0 group by all) where balls >= 24 and {_rate('runs', 'balls', '100.0', 1)} >= 130) order by bat_rating desc nulls last, player_id limit 200",
    "breakouts": f"select {_FORM_COLS} from form where breakout_flag order by form.breakout_delta desc, player_id limit 30",
    "venue_extremes": "select * from (select venue_id, bat_factor, 'highest' as list from venue_factors order by bat_factor desc, venue_id limit 8) union all select * from (select venue_id, bat_factor, 'lowest' from venue_factors order by bat_factor, venue_id limit 8)",
    "venue_top_players": "select * from (select player_id, 'bat' as side, innings, average as value from vbat where venue_id = 7 and innings >= 3 order by average desc nulls last, player_id limit 15) union all select * from (select player_id, 'bowl', innings, economy from vbowl where venue_id = 7 and innings >= 3 order by economy nulls last, player_id limit 15)",
    "form_last_n": f"select {_FORM_COLS} from form",
    "rolling_form": """select player_id, inning_number, case when count(runs) over w >= 3 then round(avg(runs) over w, 6) end as rolling_avg, case when count(sr) over w >= 3 then round(avg(sr) over w, 6) end as rolling_sr
 from (select user_id as player_id, value as runs, value * 100.0::double / (1 + event_id % 30) as sr, row_number() over (partition by user_id order by ts, event_id) as inning_number from events) window w as (partition by player_id order by inning_number rows between 9 preceding and current row)""",
    "role_similarity": """|u as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), p as (select a.vec_id as id_a, b.vec_id as id_b, round_even(list_cosine_similarity(a.e, b.e), 4) as similarity from u a join u b on a.vec_id <> b.vec_id)|select id_a, id_b, similarity, rank from (select *, row_number() over (partition by id_a order by similarity desc, id_b) as rank from p) where rank <= 20""",
    "batter_vs_bowler": f"select *, {_RATES} from (select batter_id, bowler_id, balls, runs, dismissals, wickets, dots, boundaries from ps where batter_id = 100) where balls >= 6 order by balls desc, bowler_id limit 50",
    "pair_phase": f"select *, {_RATES}, case phase when 0 then 'powerplay' when 1 then 'middle' else 'death' end as phase_name from (select phase, {_PAIR} from balls where (batter_id, bowler_id) = (select (batter_id, bowler_id) from ps order by balls desc, batter_id, bowler_id limit 1) group by all)",
    "all_opponents_of_bowler": f"select *, {_RATES} from (select bowler_id, batter_id, balls, runs, dismissals, wickets, dots, boundaries from ps where bowler_id = 100) where balls >= 6",
    "matchup_matrix": f"select batter_id, bowler_id, coalesce(balls, 0) as balls, coalesce(runs, 0) as runs, coalesce(dismissals, 0) as dismissals, coalesce(wickets, 0) as wickets, coalesce(dots, 0) as dots, coalesce(boundaries, 0) as boundaries, {_RATES} from (select * from (select 44 + unnest(range(6)) as batter_id), (select 160 + unnest(range(5)) as bowler_id)) left join ps using (batter_id, bowler_id)",
    "matchup_extremes": f"|r as (select *, {_RATES} from ps where balls >= 3)|" + " union all ".join(f"select * from (select batter_id, bowler_id, balls, strike_rate, dismissals, '{n}' as list from r order by {o}, batter_id, bowler_id limit 10)" for n, o in (("best", "strike_rate desc"), ("worst", "strike_rate"), ("most_dismissed", "dismissals desc"))),
    "dismissal_phase_pivot": "select batter_id, wicket_kind, sum((phase = 0)::int) as powerplay, sum((phase = 1)::int) as middle, sum((phase = 2)::int) as death from balls where is_wicket group by all",
    "predicted_matchup": f"""|d as (select b.player_id as batter_id, w.player_id as bowler_id, {_D['sr']} as sr, {_D['avg']} as av, {_D['eco']} as eco, {_D['bpw']} as bpw, {_D['dot']} as dot, coalesce(nullif(b.pp_sr,0),{_D['sr']}) as bpp, coalesce(nullif(b.mid_sr,0),{_D['sr']}) as bmid, coalesce(nullif(b.death_sr,0),{_D['sr']}) as bdth,
 coalesce(nullif(w.pp_economy,0),{_D['eco']}) as wpp, coalesce(nullif(w.mid_economy,0),{_D['eco']}) as wmid, coalesce(nullif(w.death_economy,0),{_D['eco']}) as wdth from career_batting b, career_bowling w where b.tournament = 'ALL' and w.tournament = 'ALL'),
 e as (select *, greatest(-1, least(1, (sr - eco*100/6) / greatest(eco*100/6, 1) * 2)) as d1, greatest(-1, least(1, (case when wpp <= wmid and wpp <= wdth then bpp when wmid <= wdth then bmid else bdth end - sr) / greatest(sr, 1) * 3)) as d2, greatest(-1, least(1, av*100/greatest(sr,1)/greatest(bpw,1) - 1)) as d3, greatest(-1, least(1, sr/greatest(av,1)/5 - dot*2)) as d4 from d),
 f as (select *, round(greatest(-1, least(1, d1*0.30::double + d2*0.25::double + d3*0.25::double + d4*0.20::double)), 6) as edge from e)|select batter_id, bowler_id, round(d1, 6) as rate_clash, round(d2, 6) as phase_threat, round(d3, 6) as wicket_vulnerability, round(d4, 6) as pressure, edge,
 case when edge > 0.4 then 'batter dominates' when edge > 0.15 then 'batter has the edge' when edge > 0 then 'slight batter advantage' when edge > -0.15 then 'slight bowler advantage' when edge > -0.4 then 'bowler has the edge' else 'bowler dominates' end as verdict from f""",
    "country_opponents_semi": "|" + _both("z", "opponent_id", "full") + "|select player_id, opponent_id, bat_runs, bowl_wickets from z where opponent_id in (select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA')",
    "club_opponents_anti": "|" + _both("z", "opponent_id", "full") + "|select player_id, opponent_id, bat_runs, bowl_wickets from z where opponent_id not in (select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA')",
    "venue_facets": """|v as (select r_name as country, n_name as venue, concat(case when bat_factor is null then 'Unknown scoring' when bat_factor > 1.10 then 'High-scoring' when bat_factor < 0.90 then 'Low-scoring' else 'Balanced scoring' end, ' · ', case when pace_index is null then 'unknown surface' when pace_index > 0.65 then 'pace-friendly surface' when pace_index < 0.35 then 'spin-friendly surface' else 'balanced surface' end, '.', case when boundary_rate is null then '' when boundary_rate > 0.16 then ' Short boundaries.' when boundary_rate < 0.10 then ' Large ground.' else ' Standard dimensions.' end) as pitch_type, case when first_innings >= 20 then 'busy' else 'quiet' end as status
 from nation join region on n_regionkey = r_regionkey left join venue_factors on venue_id = n_nationkey where r_name = 'ASIA')|select facet, value, count(*) as venues from (select 'country' as facet, country as value from v union all select 'venue', venue from v union all select 'pitch_type', pitch_type from v union all select 'status', status from v) where value is not null group by all""",
    "matchup_threats": "select bowler_id, batter_id, count(*) as balls, round_even(sum(bat_runs) * 100.0::double / count(*), 0)::bigint as strike_rate, sum(is_wicket::int) as wickets from balls where batter_id between 44 and 54 and bowler_id between 0 and 274 group by all having count(*) >= 3",
    "xi_rating": """|sq as (select * from (select 'home' as side, 44 + unnest(range(11)) as player_id, 1 + unnest(range(11)) as slot) union all select * from (select 'away', 99 + unnest(range(11)), 1 + unnest(range(11)))), qr as (select sq.*, o.* exclude (player_id), o.player_id is not null as known from sq left join overall_ratings o using (player_id)),
 x as (select side, round_even(sum(case when known then coalesce(bat_rating, 50.0) * (case when slot <= 6 then 2 else 1 end) end) / sum(case when slot <= 6 then 2 else 1 end), 1) as batting, round_even(sum(case when known then coalesce(bowl_rating, 50.0) * (case when slot <= 6 then 1 else 2 end) end) / sum(case when slot <= 6 then 1 else 2 end), 1) as bowling,
 round_even(sum((known and coalesce(bat_rating, 0) > 45)::int) * 100.0::double / count(*), 1) as depth, coalesce(avg(case when slot > 6 and known then coalesce(nullif(bowl_rating, 0), 50.0) end), 50.0) as low, coalesce(avg(case when known then coalesce(s_death_sr, 50.0) end), 50.0) as death from qr group by side),
 y as (select x.*, coalesce(nullif(pace_index, 0), 0.5) as pace, coalesce(nullif(bat_factor, 0), 1.0) as factor from x, venue_factors where venue_id = 7),
 z as (select *, round_even((low * pace + (100 - low) * (1 - pace)) * 0.5::double + greatest(0.0::double, least(100.0::double, death * (factor - 0.7::double) / 0.6::double)) * 0.3::double + 10, 1) as venue_fit from y),
 o as (select *, round_even(batting * 0.35::double + bowling * 0.35::double + depth * 0.15::double + venue_fit * 0.15::double, 1) as overall from z)|select side, batting, bowling, depth, venue_fit, overall, case when overall >= 80 then 'A+' when overall >= 72 then 'A' when overall >= 65 then 'B+' when overall >= 58 then 'B' when overall >= 50 then 'C+' else 'C' end as grade from o""",
    "match_prediction": """|sq as (select * from (select 'home' as side, 44 + unnest(range(11)) as player_id, 1 + unnest(range(11)) as slot) union all select * from (select 'away', 99 + unnest(range(11)), 1 + unnest(range(11)))), qr as (select sq.*, o.* exclude (player_id), o.player_id is not null as known from sq left join overall_ratings o using (player_id)),
 x as (select side, sum(case when known then coalesce(nullif(bat_rating, 0), 50.0) else 0 end * (case when slot <= 6 then 2 else 1 end)) / sum(case when slot <= 6 then 2 else 1 end) as bat, sum(case when known then coalesce(nullif(bowl_rating, 0), 50.0) else 0 end * (case when slot <= 6 then 1 else 2 end)) / sum(case when slot <= 6 then 1 else 2 end) as bowl from qr group by side),
 y as (select greatest(130.0::double, least(185.0::double, coalesce(nullif(avg_first_inn_runs, 0), 158.0))) as base, case when coalesce(nullif(bat_factor, 0), 1.0) > 1.05 then 5.0::double else 0.0 end as dew, a.bat as ab, a.bowl as aw, b.bat as bb, b.bowl as bw from venue_factors, x a, x b where venue_id = 7 and a.side = 'home' and b.side = 'away'),
 z as (select round(greatest(110.0::double, least(210.0::double, base + (ab - bw) * 0.3::double - dew)) + 12, 1) as first_total, round(greatest(110.0::double, least(210.0::double, base + (bb - aw) * 0.3::double + dew)) + 12, 1) as second_total from y),
 w as (select *, round(100 / (1 + exp(-(first_total - second_total) / 20)), 1) as first_win_pct from z)|select *, round(100 - first_win_pct, 1) as second_win_pct, round(abs(first_total - second_total), 1) as margin from w""",
    "all_team_ids": "select team1_id as team_id from matches union select team2_id from matches",
    "shared_venues": "select a.venue_id, a.innings as innings_a, a.average as average_a, a.strike_rate as strike_rate_a, b.innings as innings_b, b.average as average_b, b.strike_rate as strike_rate_b from vbat a join vbat b using (venue_id) where a.player_id = 50 and b.player_id = 51",
    "missing_ids": "select distinct c_custkey as id from customer where c_custkey not in (select o_custkey from orders)",
    "compare_players": "|m as (select unnest(['bat_rating','bowl_rating','overall_rating','s_opener','s_finisher','s_anchor']) as metric), v as (select player_id, unnest(['bat_rating','bowl_rating','overall_rating','s_opener','s_finisher','s_anchor']) as metric, unnest([bat_rating, bowl_rating, overall_rating, s_opener, s_finisher, s_anchor]) as v from overall_ratings)|select metric, a.v as value_a, b.v as value_b, case when a.v > b.v then 'a' when b.v > a.v then 'b' else 'tie' end as winner from m left join (select * from v where player_id = 50) a using (metric) left join (select * from v where player_id = 51) b using (metric)",
    "match_profiles": "select m.match_id, m.tournament, m.season, m.match_date, a.n_name as team1, b.n_name as team2, t.n_name as toss_winner, w.n_name as winner, v.n_name as venue from matches m left join nation a on a.n_nationkey = team1_id left join nation b on b.n_nationkey = team2_id left join nation t on t.n_nationkey = toss_winner_id left join nation w on w.n_nationkey = winner_id left join nation v on v.n_nationkey = venue_id",
    "venue_dedup": "select match_id, coalesce(case when venue_id between 20 and 24 then venue_id - 20 end, venue_id) as venue_id from sides",
    "style_coverage": "select count(*) as balls, sum((bowler_id % 8 < 5)::int) as styled, floor(sum((bowler_id % 8 < 5)::int) * 100 / count(*))::bigint as coverage_pct from balls",
    "coverage_by_tournament": "select tournament, count(*) as matches, min(match_date) as first_date, max(match_date) as last_date, count(distinct venue_id) as venues, count(distinct team1_id) as teams, round(count(*) * 100.0::double / (select count(*) from matches), 2) as share_pct from matches group by 1",
    "matches_per_year": "select year(match_date) as year, count(*) as matches from matches group by 1",
    "table_audit": "select *, case when n_rows = 0 then 'Empty' when n_rows < 50 then 'Low' else 'OK' end as status from (" + " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in ("batter_innings", "bowler_innings", "innings", "matches", "nation", "region")) + ")",
    "pitch_labels": "select venue_id, concat(case when bat_factor > 1.10 then 'High-scoring' when bat_factor < 0.90 then 'Low-scoring' else 'Balanced scoring' end, ' · ', case when pace_index > 0.65 then 'pace-friendly surface' when pace_index < 0.35 then 'spin-friendly surface' else 'balanced surface' end, '.', case when boundary_rate > 0.16 then ' Short boundaries.' when boundary_rate < 0.10 then ' Large ground.' else ' Standard dimensions.' end) as label from venue_factors",
    "batting_features": """select innings_id, b.player_id, runs, least(greatest(coalesce(bat_factor, 1.0), 0.5), 2.0)::double as venue_bat_factor, least(greatest(coalesce(boundary_rate, 0.12), 0.05), 0.25)::double as boundary_rate, least(greatest(coalesce(pace_index, 0.5), 0), 1)::double as pace_index, least(greatest(batting_position, 1), 11)::double as batting_position, is_chase::int::double as is_chase, least(greatest(coalesce(required_rr_start, 0), 0), 20)::double as req_rr,
 least(greatest(coalesce(c.adj_average, 20), 0), 80)::double as career_adj_avg, least(greatest(coalesce(c.adj_strike_rate, 120), 50), 250)::double as career_adj_sr, least(greatest(coalesce(c.innings, 1), 1), 300)::double as career_innings, least(greatest(coalesce(chase_avg, 20), 0), 80)::double as chase_avg, least(greatest(coalesce(first_avg, 20), 0), 80)::double as first_avg, least(greatest(coalesce(chase_sr, 120), 50), 250)::double as chase_sr,
 least(b.pp_runs * 100.0::double / greatest(b.pp_balls, 1), 300) as pp_sr, least(b.mid_runs * 100.0::double / greatest(b.mid_balls, 1), 300) as mid_sr, least(b.death_runs * 100.0::double / greatest(b.death_balls, 1), 300) as death_sr, 5.0::double as tournament_enc
 from batting b left join venue_factors using (venue_id) left join (select player_id, adj_average, adj_strike_rate, innings from career_batting where tournament = 'ALL') c using (player_id) left join sp using (player_id) where balls_faced >= 4""",
    "bowling_features": """select innings_id, b.player_id, runs_conceded * 6.0::double / b.balls_bowled as economy_target, least(greatest(coalesce(bat_factor, 1.0), 0.5), 2.0)::double as venue_bat_factor, least(greatest(coalesce(boundary_rate, 0.12), 0.05), 0.25)::double as boundary_rate, least(greatest(coalesce(pace_index, 0.5), 0), 1)::double as pace_index,
 least(greatest(coalesce(c.adj_economy, 8.5), 4), 18)::double as career_adj_econ, least(greatest(coalesce(c.dot_pct, 33), 10), 70)::double as career_dot_pct, least(greatest(coalesce(c.innings, 1), 1), 300)::double as career_bowl_inn, least(greatest(coalesce(c.pp_economy, 8.0), 4), 18)::double as pp_economy, least(greatest(coalesce(c.mid_economy, 8.0), 4), 18)::double as mid_economy, least(greatest(coalesce(c.death_economy, 9.5), 4), 20)::double as death_economy, 5.0::double as tournament_enc
 from bowling b left join venue_factors using (venue_id) left join (select player_id, adj_economy, dot_pct, innings, pp_economy, mid_economy, death_economy from career_bowling where tournament = 'ALL') c using (player_id) where b.balls_bowled >= 3 and runs_conceded * 6.0::double / b.balls_bowled > 2 and runs_conceded * 6.0::double / b.balls_bowled < 24""",
    # figures before a day: the facts of earlier days, found by a join of the facts with themselves
    "bowling_features_before": f"""|bf as (select b.*, round_even(runs_conceded / coalesce(bat_factor, 1.0), 6)::decimal(20,6) as adj from bowling b left join venue_factors using (venue_id)),
 bb as (select x.player_id, x.innings_id, count(y.innings_id) as innings, sum(y.balls_bowled) as balls, sum(y.dot_balls) as dots, sum(y.adj)::double as adj_runs, {', '.join(f'sum(y.{p}_{w}) as {p}_{w}' for p in _PH for w in ('balls', 'runs'))} from bf x left join bf y on x.player_id = y.player_id and y.match_date < x.match_date group by all),
 bc as (select player_id, innings_id, nullif(innings, 0) as innings, {_rate('dots', 'balls', '100.0')} as dot_pct, {_rate('adj_runs', 'balls', '6.0')} as adj_economy, {_PHASE_ECO} from bb)|select innings_id, b.player_id, runs_conceded * 6.0::double / b.balls_bowled as economy_target, least(greatest(coalesce(bat_factor, 1.0), 0.5), 2.0)::double as venue_bat_factor, least(greatest(coalesce(boundary_rate, 0.12), 0.05), 0.25)::double as boundary_rate, least(greatest(coalesce(pace_index, 0.5), 0), 1)::double as pace_index,
 least(greatest(coalesce(c.adj_economy, 8.5), 4), 18)::double as career_adj_econ, least(greatest(coalesce(c.dot_pct, 33), 10), 70)::double as career_dot_pct, least(greatest(coalesce(c.innings, 1), 1), 300)::double as career_bowl_inn, least(greatest(coalesce(c.pp_economy, 8.0), 4), 18)::double as pp_economy, least(greatest(coalesce(c.mid_economy, 8.0), 4), 18)::double as mid_economy, least(greatest(coalesce(c.death_economy, 9.5), 4), 20)::double as death_economy, 5.0::double as tournament_enc
 from bowling b left join venue_factors using (venue_id) left join bc c using (player_id, innings_id) where b.balls_bowled >= 3 and runs_conceded * 6.0::double / b.balls_bowled > 2 and runs_conceded * 6.0::double / b.balls_bowled < 24""",
    "batting_features_before": f"""|tf as (select b.*, round_even(runs / coalesce(bat_factor, 1.0), 6)::decimal(20,6) as adj from batting b left join venue_factors using (venue_id)),
 tb as (select x.player_id, x.innings_id, nullif(count(y.innings_id), 0) as innings, sum((not y.not_out)::int) as outs, sum(y.runs) as runs, sum(y.balls_faced) as balls, sum(y.adj)::double as adj_runs, {', '.join(f"coalesce(sum(y.{p}_{w}), 0) as {p}_{w}" for p in _PH for w in ('runs', 'balls'))},
  {', '.join(f"sum(case when {k} then y.runs end) as {n}_runs, sum(case when {k} then y.balls_faced end) as {n}_balls, sum(case when {k} then (not y.not_out)::int end) as {n}_outs" for n, k in (('chase', 'y.is_chase'), ('first', 'not y.is_chase')))} from tf x left join tf y on x.player_id = y.player_id and y.match_date < x.match_date group by all),
 tc as (select player_id, innings_id, innings, {_rate('adj_runs', 'outs')} as adj_average, {_rate('runs', 'balls', '100.0')} as adj_sr, {_rate('chase_runs', 'chase_outs')} as ca, {_rate('first_runs', 'first_outs')} as fa, {_rate('chase_runs', 'chase_balls', '100.0')} as cs, {', '.join(f"least({p}_runs * 100.0::double / greatest({p}_balls, 1), 300) as {p}_sr" for p in _PH)} from tb)|select innings_id, b.player_id, b.runs, least(greatest(coalesce(bat_factor, 1.0), 0.5), 2.0)::double as venue_bat_factor, least(greatest(coalesce(boundary_rate, 0.12), 0.05), 0.25)::double as boundary_rate, least(greatest(coalesce(pace_index, 0.5), 0), 1)::double as pace_index, least(greatest(batting_position, 1), 11)::double as batting_position, is_chase::int::double as is_chase, least(greatest(coalesce(required_rr_start, 0), 0), 20)::double as req_rr,
 least(greatest(coalesce(c.adj_average, 20), 0), 80)::double as career_adj_avg, least(greatest(coalesce(c.adj_sr, 120), 50), 250)::double as career_adj_sr, least(greatest(coalesce(c.innings, 1), 1), 300)::double as career_innings, least(greatest(coalesce(c.ca, 20), 0), 80)::double as chase_avg, least(greatest(coalesce(c.fa, 20), 0), 80)::double as first_avg, least(greatest(coalesce(c.cs, 120), 50), 250)::double as chase_sr, c.pp_sr::double as pp_sr, c.mid_sr::double as mid_sr, c.death_sr::double as death_sr, 5.0::double as tournament_enc
 from batting b left join venue_factors using (venue_id) left join tc c using (player_id, innings_id) where b.balls_faced >= 4""",
    "captains_before_match": "|asked as (select match_id, match_date, unnest([team1_id, team2_id]) as team_id from matches)|select a.match_id, a.match_date, a.team_id, a.team_id * 11 as player_id, count(b.innings_id) as innings, coalesce(sum(b.runs), 0)::bigint as runs, coalesce(sum(b.balls_faced), 0)::bigint as balls from asked a left join batting b on b.player_id = a.team_id * 11 and b.match_date < a.match_date group by all",
}
SELECTS["name_search"] = "select p_partkey, p_name, pattern from part, (values ('%BLUE%'), ('%d gi_m%'), ('hot%ge%'), ('%no such%'), ('%o_t')) x(pattern) where p_name ilike pattern"
#: A stream of the same balls gives the same scores.
SELECTS["ball_context_streamed"] = SELECTS["ball_context"]


def sql() -> dict[str, str]:
    """The full statement of each query; a select may bring definitions of its own as |definitions|select."""
    out = {}
    for name, text in SELECTS.items():
        own, select = text[1:].split("|", 1) if text.startswith("|") else ("", text)
        out[name] = SHARED + (", " + own if own else "") + "\n" + select
    return out
