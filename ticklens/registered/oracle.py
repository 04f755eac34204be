"""SQL for DuckDB that computes each registered query from the same tables.

Written from the definitions (ordered `first`, plain filters), not from the Spark
plans, so that the two can disagree.
"""

from __future__ import annotations

_TICKS = """
ticks as (
  select strftime(ts, '%Y%m%d') "day", ts, strftime(ts, '%Y%m%d %H%M%S%g') trade_dt,
         ['EURUSD','GBPUSD','USDJPY'][(user_id % 3)::int + 1] curr_pair,
         cast(value as decimal(12,6)) bid,
         cast(cast(value as decimal(12,6)) + cast(event_id % 10 as decimal(12,6)) * 0.0001
              as decimal(12,6)) ask
  from events)"""

_EDGE_TICKS = _TICKS.replace("ticks as", "moving_ticks as", 1) + """,
ticks as (
  select * from moving_ticks
  union all
  select * replace (time_bucket(interval 30 minute, ts) as ts) from moving_ticks)"""

_PARSED = """
parsed as (
  select trade_dt, substr(trade_dt, 1, 8) "day", cast(substr(trade_dt, 10, 2) as int) "hour",
         cast(substr(trade_dt, 12, 2) as int) "min", cast(substr(trade_dt, 14, 2) as int) sec,
         cast(substr(trade_dt, 16, 3) as int) milli, bid, ask, curr_pair
  from ticks)"""

_RAW = """
daily as (
  select strftime(ts, '%Y%m%d') d, min(ts) m, cast(count(*) as int) a,
         cast(2 * count(*) filter (where user_id % 2 = 0) as int) f
  from events group by 1),
releases_raw as (
  select strftime(m, '%b %d, %Y') release_date, '08:30' release_time, concat(a, 'K') actual,
         concat(f, 'K') forecast, coalesce(lag(a) over (order by d) || 'K', '') previous
  from daily)"""

_HEADER = """
releases_text as (
  select 'Release Date' release_date, 'Time' release_time, 'Actual' actual,
         'Forecast' forecast, 'Previous' previous
  union all select * from releases_raw)"""

_TWO_RAW = """
releases_two as (
  select * from releases_raw
  union all
  select release_date, '14:05', previous, forecast, actual from releases_raw)"""


_DENSE_RAW = """
releases_dense as (
  select release_date, printf('%02d:%02d', slot // 2, slot % 2 * 30) release_time, actual, forecast,
         previous
  from (select *, unnest(range(48)) slot from releases_raw))"""


def _releases(source: str) -> str:
    return f"""
releases as (
  select release_date, release_time,
         try_cast(replace(actual, 'K', '') as int) actual,
         try_cast(replace(forecast, 'K', '') as int) forecast,
         try_cast(replace(previous, 'K', '') as int) previous,
         concat(substr(release_date, 9, 4),
                coalesce(strftime(try_strptime(substr(release_date, 1, 3), '%b'), '%m'), 'NA'),
                substr(release_date, 5, 2)) trading_day,
         cast(split_part(release_time, ':', 1) as int) trading_hour,
         cast(split_part(release_time, ':', 2) as int) trading_min
  from {source} where release_time <> 'Time')"""


_TIMED = """
timed as (
  select *, strptime(trading_day || ' ' || release_time, '%Y%m%d %H:%M') t0 from releases)"""

_JOINED = """
joined as (
  select t.*, r.* exclude (release_date, release_time)
  from ticks t join timed r on t."day" = r.trading_day)"""


def _with(*tables: str) -> str:
    return "with " + ",".join(tables)


_BASE = _with(_TICKS, _RAW, _releases("releases_raw"), _TIMED, _JOINED)
_BASE_DENSE = _with(
    _TICKS, _RAW, _DENSE_RAW, _releases("releases_dense"), _TIMED, _JOINED
)
_BASE_EDGES = _with(_EDGE_TICKS, _RAW, _releases("releases_raw"), _TIMED, _JOINED)
_BASE_TWO = _with(_TICKS, _RAW, _TWO_RAW, _releases("releases_two"), _TIMED, _JOINED)


def _inside(minutes: int, bounds: str = "open") -> str:
    end = "<" if bounds == "open" else "<="
    return f"ts > t0 and ts {end} t0 + interval {minutes} minute"


# Order that puts the point of a kind first.
_ORDER = {
    "open": "ts, {p}",
    "close": "ts desc, {p} desc",
    "high": "{p} desc, ts desc",
    "low": "{p}, ts",
}


def _point(kind: str, price: str, name: str, ts_name: str, where: str) -> str:
    order = _ORDER[kind].format(p=price)
    return (
        f"first({price} order by {order}) filter (where {where}) {name}, "
        f"first(ts order by {order}) filter (where {where}) {ts_name}"
    )


def _single(
    kinds: list[str], minutes: int = 60, price: str = "ask", bounds: str = "open"
) -> str:
    points = ", ".join(
        _point(k, price, f"{k}_price", f"{k}_price_ts", _inside(minutes, bounds)) for k in kinds
    )
    return f"""{_BASE}
select curr_pair || "day" "key", curr_pair, "day", trading_hour, trading_min, {points}
from joined group by all"""


def _open_close_columns(frames: list[int]) -> str:
    return ", ".join(
        _point(k, "ask", f"{k}_price_{n}", f"{k}_price_ts_{n}", _inside(n))
        for n in frames
        for k in ("open", "close")
    )


def _edge_columns(frames: list[int], bounds: str) -> str:
    return ", ".join(
        _point(k, "ask", f"{k}_price_{n}", f"{k}_price_ts_{n}", _inside(n, bounds))
        for n in frames
        for k in ("open", "close", "high", "low")
    )


def _wide(frames: list[int], base: str = _BASE, columns: str | None = None) -> str:
    return f"""{base},
grouped as (
  select curr_pair, "day", trading_hour, trading_min, previous, forecast, actual,
         {columns or _open_close_columns(frames)}
  from joined group by all)
select curr_pair || "day" key0, concat(trading_hour, trading_min) "time",
       * exclude (trading_hour, trading_min)
from grouped"""


def _summary(frames: list[int]) -> str:
    columns = ", ".join(
        _point(kind, p, f"{name}_{p}_{n}", f"{name}_{p}_dt_{n}", _inside(n, "half_open"))
        for n in frames
        for p in ("ask", "bid")
        for name, kind in (("max", "high"), ("close", "close"))
    )
    return f"""{_BASE}
select curr_pair, "day", trading_hour, trading_min, previous, forecast, actual, {columns}
from joined group by all"""


def _frame_rows(bounds: str, base: str = _BASE) -> str:
    return f"""{base}
select curr_pair, "day", trading_hour, trading_min, ts, bid, ask
from joined where {_inside(60, bounds)}"""


def _gaps(end_day: bool = False) -> str:
    extra = ", substr(b, 1, 8) end_day" if end_day else ""
    # Fixed value: the line of the feed, as in functions/text.py.
    pattern = "^Gap of ([0-9]+)s found between ([0-9]+) and ([0-9]+).$"
    return f"""{_with(_TICKS)},
next_ticks as (
  select curr_pair, ts, lead(ts) over (partition by curr_pair order by ts) nx from ticks),
gap_lines as (
  select curr_pair,
         concat('Gap of ',
                date_diff('second', date_trunc('second', ts), date_trunc('second', nx)),
                's found between ', strftime(ts, '%Y%m%d%H%M%S'), ' and ',
                strftime(nx, '%Y%m%d%H%M%S'), '.') line
  from next_ticks where nx is not null),
matched as (
  select curr_pair, cast(regexp_extract(line, '{pattern}', 1) as int) gap,
         regexp_extract(line, '{pattern}', 2) a, regexp_extract(line, '{pattern}', 3) b
  from gap_lines where regexp_matches(line, '{pattern}'))
select curr_pair, gap, substr(a, 1, 8) "day", substr(a, 9, 2) start_hour,
       substr(a, 11, 2) start_min, substr(a, 13, 2) start_sec, substr(b, 9, 2) end_hour,
       substr(b, 11, 2) end_min, substr(b, 13, 2) end_sec{extra}
from matched where gap <> 0"""


_GAPS_TWICE = _gaps() + """
union all
""" + "select * from (" + _gaps() + ") where curr_pair = 'EURUSD'"

_REJECTS = f"""{_with(_TICKS, _RAW)},
bad as (
  select ['EURUSD','GBPUSD','USDJPY'][(user_id % 3)::int + 1] curr_pair, event_id // 97 k
  from events where event_id % 97 = 0),
next_ticks as (
  select curr_pair, ts, lead(ts) over (partition by curr_pair order by ts) nx from ticks),
no_gaps as (
  select curr_pair, unnest(range(case curr_pair when 'EURUSD' then 2 else 1 end))
  from next_ticks where date_trunc('second', ts) = date_trunc('second', nx))
select feed, curr_pair, reason, count(*) n from (
  select 'ticks' feed, curr_pair, ['fields', 'time', 'bid', 'ask', 'vol'][k % 5 + 1] reason from bad
  union all
  select 'gaps', curr_pair, ['no gap report', 'gap too long', 'no gap'][k % 3 + 1] from bad
  union all
  select 'gaps', curr_pair, 'no gap' from no_gaps
  union all
  select 'releases', null, 'actual' from releases_raw)
group by all"""


_HISTORY = f"""{_with(_RAW, _releases("releases_raw"))},
history as (
  select trading_day, concat(trading_hour, ':', trading_min) trading_time, actual, forecast,
         previous
  from releases)"""

_PARSED_JOIN = """
select "day", "hour", "min", sec, milli, bid, ask, curr_pair, trading_day, trading_hour,
       trading_min, previous, forecast, actual"""


def all_oracles() -> dict[str, str]:
    short, script, summary = [1, 2, 3, 4, 5], [1, 5, 10, 20], [1, 5, 15, 60]
    frame_ends = ", ".join(f"t0 + interval {n} minute frame_end_{n}" for n in short)
    clean = _with(_RAW, _HEADER, _releases("releases_text")) + " select * from releases"
    parsed = _with(_TICKS, _PARSED) + " select * from parsed"
    per_release = f"""{_BASE},
per_release as (
  select curr_pair, "day", count(*) n_ticks from joined group by all)"""
    return {
        "scan_ticks_csv": _with(_TICKS)
        + " select trade_dt, bid, ask, cast(0 as tinyint) vol, curr_pair from ticks",
        "scan_releases_csv": _with(_RAW, _HEADER) + " select * from releases_text",
        "scan_ticks_parquet": _with(_TICKS, _PARSED)
        + ' select "day", "hour", "min", sec, milli, bid, ask, curr_pair from parsed',
        "write_releases": clean,
        "write_ticks_partitioned": parsed,
        "write_reaction_table": _wide(short),
        "write_summary_table": _summary(summary),
        "load_checked_ticks": parsed,
        "load_checked_releases": clean,
        "load_checked_gaps": _GAPS_TWICE,
        "load_rejects": _REJECTS,
        "release_history_view": f"{_HISTORY} select * from history",
        "tick_parse": parsed,
        "tick_timestamp": _with(_TICKS)
        + " select curr_pair, trade_dt, date_trunc('millisecond', ts) tick_ts from ticks",
        "release_clean": clean,
        "release_timestamp": f"""{_with(_RAW, _releases("releases_raw"), _TIMED)}
select trading_day, trading_hour, trading_min, t0 release_ts, {frame_ends} from timed""",
        "release_surprise": f"""{_HISTORY}
select trading_day, trading_time, actual, actual - forecast diff_forecast,
       actual - previous diff_previous
from history""",
        "pair_filter": _with(_TICKS, _PARSED)
        + ' select curr_pair, "day", "hour", "min", sec, milli, bid, ask from parsed'
        + " where curr_pair = 'EURUSD'",
        "tick_release_join": _with(_TICKS, _PARSED, _RAW, _releases("releases_raw"))
        + _PARSED_JOIN
        + ' from parsed join releases on "day" = trading_day',
        "tick_release_join_large": _with(_TICKS, _PARSED, _RAW, _releases("releases_raw"))
        + _PARSED_JOIN
        + ' from parsed join releases on "day" = trading_day',
        "tick_release_broadcast": _with(
            _TICKS, _PARSED, _RAW, _TWO_RAW, _releases("releases_two")
        )
        + """,
last_release as (
  select * from releases
  qualify row_number() over (
    partition by trading_day order by trading_hour desc, trading_min desc) = 1)"""
        + _PARSED_JOIN
        + """ from parsed join last_release on "day" = trading_day where curr_pair = 'EURUSD'""",
        "frame_ticks_open": _frame_rows("open"),
        "frame_ticks_half_open": _frame_rows("half_open"),
        "frame_ticks_edges_open": _frame_rows("open", _BASE_EDGES),
        "frame_ticks_edges_half_open": _frame_rows("half_open", _BASE_EDGES),
        "reaction_edges_open": _wide([], _BASE_EDGES, _edge_columns([30, 60], "open")),
        "reaction_edges_half_open": _wide([], _BASE_EDGES, _edge_columns([30, 60], "half_open")),
        "reaction_1m": _single(["open", "close"], 1),
        "reaction_5m": _single(["open", "close"], 5),
        "reaction_15m": _single(["open", "close"], 15),
        "reaction_60m": _single(["open", "close"]),
        "reaction_half_open": _single(["open", "close"], bounds="half_open"),
        "reaction_bid": _single(["open", "close"], price="bid"),
        "reaction_high_low": _single(["high", "low"]),
        "agg_open": _single(["open"]),
        "agg_close": _single(["close"]),
        "agg_high": _single(["high"]),
        "max_ask_bid": f"""{_BASE}
select curr_pair, "day", trading_hour, trading_min,
       max(ask) filter (where {_inside(5, "half_open")}) max_ask,
       max(bid) filter (where {_inside(5, "half_open")}) max_bid
from joined group by all""",
        "reaction_wide": _wide(short),
        "reaction_wide_1_5_10_20": _wide(script),
        "reaction_wide_chained": _wide(short),
        "reaction_two_releases_per_day": _wide(summary, _BASE_TWO),
        "reaction_dense_calendar": _wide(summary, _BASE_DENSE),
        "reaction_large_calendar": _wide(summary, _BASE_DENSE),
        "reaction_day_layout": _wide(summary, _BASE.replace(" ts,", " date_trunc('millisecond', ts) ts,")),
        "price_summary_wide": _summary(summary),
        "release_facts_distinct": f"""{_BASE}
select distinct curr_pair || "day" key0, previous, forecast, actual, curr_pair, "day",
       concat(trading_hour, trading_min) "time"
from joined""",
        "ticks_per_release": f"{per_release} select * from per_release",
        "release_group_count": f"{per_release} select count(*) n_groups from per_release",
        "gap_parse": _gaps(),
        "gap_parse_end_day": _gaps(end_day=True),
        "gap_union": _gaps(),
        **{
            name: f"""{base}
select curr_pair, "day", trading_hour, trading_min, {_open_close_columns(summary)}
from joined group by all"""
            for name, base in {
                "reaction_from_chunks": _BASE,
                "incremental_reaction": _BASE,
                "incremental_two_feeds": _BASE,
                "incremental_compacted": _BASE,
                "incremental_late_release": _BASE_TWO,
            }.items()
        },
        "incremental_wide": _wide(summary),
        "closed_frame_stream": f"""{_BASE},
last_quote as (select date_trunc('millisecond', max(ts)) last_ts from ticks)
select curr_pair, "day", trading_hour, trading_min, frame,
       first(ask order by ts, ask) open_price, first(ts order by ts, ask) open_price_ts,
       first(ask order by ts desc, ask desc) close_price,
       first(ts order by ts desc, ask desc) close_price_ts
from joined, (select unnest({summary})::int frame), last_quote
where ts > t0 and ts < t0 + frame * interval 1 minute
  and t0 + frame * interval 1 minute <= last_ts
group by all""",
    }
