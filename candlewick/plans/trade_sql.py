"""DuckDB text of the trade chain: signals, fills, outcomes, single position, P&L."""

from candlewick import bindings as b
from candlewick.plans import indicator_sql as isql


def uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"


def noise(tag: str, *parts: str) -> str:
    return f"(0.85 + 0.3 * {uniform(repr(tag), *parts)})"


PIP = "(CASE WHEN digits IN (3, 5) THEN point * 10 ELSE point END)"


def vol(r: str) -> str:
    return (f"(CASE WHEN {r} IS NULL OR {r} = 0 THEN 1.0 WHEN {r} < 0.7 THEN 0.9 WHEN {r} < 1.3 THEN 1.0 "
            f"WHEN {r} < 2.0 THEN 1.4 ELSE 2.0 END)")


def sess(s: str) -> str:
    return (f"(CASE {s} WHEN 'NEW_YORK' THEN 1.1 WHEN 'LONDON_OPEN' THEN 1.3 WHEN 'NY_OPEN' THEN 1.2 WHEN 'ASIAN' THEN 1.5 "
            f"WHEN 'DEAD_ZONE' THEN 2.5 ELSE 1.0 END)")


def lots(capital: str, risk: str, dist: str) -> str:
    per = f"(({dist}) / tick_size * tick_value)"
    step = f"(floor((({capital}) * ({risk}) / 100.0 / {per}) + 1e-9) / volume_step) * volume_step)".replace(
        "floor(((", "floor(((", 1)
    raw = f"(floor(((({capital}) * ({risk}) / 100.0) / {per} + 1e-9) / volume_step) * volume_step)"
    dec = "pow(10.0, CASE WHEN volume_step < 1 THEN greatest(0, round(-log10(volume_step))) ELSE 0 END)"
    sized = f"(floor({raw} * {dec} + 0.5) / {dec})"
    del step
    return (f"(CASE WHEN ({dist}) <= 0 OR ({capital}) <= 0 OR ({risk}) <= 0 THEN 0.0 WHEN {sized} <= volume_min THEN "
            f"CASE WHEN volume_min * {per} > ({capital}) * ({risk}) / 100.0 * 1.5 THEN 0.0 ELSE volume_min END "
            f"ELSE CASE WHEN volume_max > 0 THEN least(volume_max, {sized}) ELSE {sized} END END)")


NIGHTS = """(SELECT coalesce(sum(CASE isodow(m) WHEN 3 THEN 3 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 1 END), 0)::BIGINT FROM
 (SELECT {e}::DATE::TIMESTAMP + INTERVAL 21 HOUR + to_days(k::INT) AS m FROM range(0, 60) r(k)) x WHERE m > {e} AND m < {x})"""


def nights(e: str, x: str) -> str:
    """21:00 marks counted one by one (positions of up to 59 days)."""
    return NIGHTS.format(e=e, x=x)


SIDE = {
    "ma_crossover": ("sma_fast_prev <= sma_slow_prev AND sma_fast > sma_slow", "sma_fast_prev >= sma_slow_prev AND sma_fast < sma_slow"),
    "rsi_reversion": ("rsi_prev < {lo} AND rsi >= {lo}", "rsi_prev > {hi} AND rsi <= {hi}"),
    "donchian_breakout": ("close > donchian_upper_entry", "close < donchian_lower_entry"),
    "hybrid_confluence": ("close > sma_slow AND adx >= {adx} AND rsi_prev < {lo} AND rsi >= {lo}",
                          "close < sma_slow AND adx >= {adx} AND rsi_prev > {hi} AND rsi <= {hi}"),
}
NEEDS = {"ma_crossover": "sma_fast sma_slow atr close", "rsi_reversion": "rsi rsi_prev atr close",
         "donchian_breakout": "donchian_upper_entry donchian_lower_entry atr close",
         "hybrid_confluence": "close sma_slow rsi rsi_prev adx atr"}
EXITS = {"ma_crossover": ("sma_fast_prev >= sma_slow_prev AND sma_fast < sma_slow", "sma_fast_prev <= sma_slow_prev AND sma_fast > sma_slow"),
         "rsi_reversion": ("rsi >= 50", "rsi <= 50"),
         "donchian_breakout": ("close < donchian_lower_exit", "close > donchian_upper_exit"),
         "hybrid_confluence": ("rsi_prev >= 50 AND rsi < 50", "rsi_prev <= 50 AND rsi > 50")}


def signal_case(name: str, adx: float = 0, lo: float = 30, hi: float = 70, extra_block: str = "false", thr_block: bool = True) -> str:
    up, down = (x.format(lo=lo, hi=hi, adx=adx) for x in SIDE[name])
    miss = " OR ".join(f"{c} IS NULL" for c in NEEDS[name].split())
    low = f" OR adx IS NULL OR adx < {adx}" if adx > 0 and name != "hybrid_confluence" and thr_block else ""
    return (f"CASE WHEN {miss} OR session = 'DEAD_ZONE' OR {extra_block}{low} THEN 'HOLD' WHEN {up} THEN 'BUY' WHEN {down} THEN 'SELL' "
            f"ELSE 'HOLD' END")


def feats(**kw) -> str:
    """Feature CTEs plus ``ff``: warm-up defaults applied, and the instrument rows."""
    return isql.features(**kw) + ", " + b.SQL["specs"] + """, ff AS MATERIALIZED (SELECT * REPLACE (coalesce(rsi, 50) AS rsi, coalesce(rsi_prev, 50) AS rsi_prev,
 coalesce(bb_pct, 0.5) AS bb_pct, coalesce(atr, 0) AS atr, coalesce(adx, 0) AS adx, coalesce(atr_ratio, 1) AS atr_ratio,
 coalesce(volume_rel, 1) AS volume_rel) FROM feats)"""


def fills(name: str, sl: float, rr: float, capital: float, risk: float = 1.0, start: str | None = None, reanchor: bool = False, **kw) -> str:
    """``start``: signals from then on only. ``reanchor``: stop and target move with the fill's distance from the signal's close."""
    since = f" AND ts >= TIMESTAMP '{start}'" if start else ""
    moved = "SELECT * REPLACE (sl_price + entry_price - signal_close AS sl_price, tp_price + entry_price - signal_close AS tp_price) FROM f1b" if reanchor else "SELECT * FROM f1b"
    return f""", sg AS (SELECT *, {signal_case(name, **kw)} AS signal FROM ff),
 s2 AS (SELECT symbol, close AS signal_close, row_no AS signal_no, row_no + 1 AS row_no, signal AS direction, ts AS signal_time,
  close + CASE signal WHEN 'BUY' THEN -1 ELSE 1 END * atr * {sl} AS sl_price, close + CASE signal WHEN 'BUY' THEN 1 ELSE -1 END * atr * {sl} * {rr} AS tp_price
  FROM sg WHERE signal <> 'HOLD'{since}),
 f0 AS (SELECT s2.*, f.ts AS entry_time, f.open AS fill_open, f.session, f.regime, f.sma_fast, f.atr_ratio, f.rsi, f.bb_pct, f.atr, f.volume_rel, specs.* EXCLUDE (symbol),
  spread_typical * point / {PIP} * {sess('f.session')} * {vol('f.atr_ratio')} * {noise('spread', 'f.symbol', 'f.row_no')} * {PIP} / 2 AS half,
  0.3 * {vol('f.atr_ratio')} * {noise('slip', 'f.symbol', 'f.row_no')} * {PIP} AS slip FROM s2 JOIN ff f USING (symbol, row_no) JOIN specs USING (symbol)),
 f1b AS (SELECT *, fill_open + CASE direction WHEN 'BUY' THEN 1 ELSE -1 END * (half + slip) AS entry_price FROM f0),
 fills AS MATERIALIZED (SELECT *, row_no AS entry_no FROM (SELECT *, {lots(str(capital), str(risk), 'abs(entry_price - sl_price)')} AS lots FROM ({moved})
  WHERE CASE direction WHEN 'BUY' THEN sl_price < entry_price ELSE sl_price > entry_price END) WHERE lots > 0)"""


TOUCH = """, hits AS (SELECT c.symbol, c.signal_no, min(f.row_no) AS touch_no FROM fills c JOIN ff f ON f.symbol = c.symbol AND f.row_no >= c.entry_no
 AND CASE c.direction WHEN 'BUY' THEN f.low <= c.sl_price OR f.high >= c.tp_price ELSE f.high >= c.sl_price OR f.low <= c.tp_price END GROUP BY ALL),
 touched AS MATERIALIZED (SELECT c.*, h.touch_no, CASE WHEN h.touch_no IS NULL THEN NULL WHEN CASE c.direction WHEN 'BUY' THEN f.low <= c.sl_price ELSE f.high >= c.sl_price END THEN 'SL_HIT' ELSE 'TP_HIT' END AS touch_reason,
 CASE WHEN h.touch_no IS NULL THEN NULL WHEN c.direction = 'BUY' AND f.low <= c.sl_price THEN least(c.sl_price, f.open) WHEN c.direction = 'SELL' AND f.high >= c.sl_price
 THEN greatest(c.sl_price, f.open) ELSE c.tp_price END AS touch_price FROM fills c LEFT JOIN hits h USING (symbol, signal_no) LEFT JOIN ff f ON f.symbol = c.symbol AND f.row_no = h.touch_no)"""


def resolved(exit_name: str | None) -> str:
    if exit_name is None:
        flag = "NULL::BIGINT"
    else:
        be, se = EXITS[exit_name]
        flag = (f"(SELECT min(f.row_no) FROM ff f WHERE f.symbol = t.symbol AND f.row_no >= t.entry_no AND f.session <> 'DEAD_ZONE' "
                f"AND CASE t.direction WHEN 'BUY' THEN {be} ELSE {se} END)")
    return f""", lastbar AS (SELECT symbol, max(row_no) AS last_no FROM ff GROUP BY symbol),
 r0 AS MATERIALIZED (SELECT t.*, last_no, {flag} AS flag_no FROM touched t JOIN lastbar USING (symbol)),
 r1 AS (SELECT *, CASE WHEN touch_no IS NOT NULL AND (flag_no IS NULL OR touch_no <= flag_no) THEN touch_reason WHEN flag_no < last_no THEN 'EXIT_SIGNAL' ELSE 'END_OF_DATA' END AS close_reason,
  CASE WHEN touch_no IS NOT NULL AND (flag_no IS NULL OR touch_no <= flag_no) THEN touch_no WHEN flag_no < last_no THEN flag_no + 1 ELSE last_no END AS exit_no FROM r0),
 resolved AS MATERIALIZED (SELECT r1.*, x.ts AS exit_time, x.session AS exit_session, CASE close_reason WHEN 'END_OF_DATA' THEN x.close WHEN 'EXIT_SIGNAL' THEN x.open ELSE touch_price END AS exit_price,
  r1.exit_no - r1.entry_no + CASE close_reason WHEN 'END_OF_DATA' THEN 1 ELSE 0 END AS duration_candles FROM r1 JOIN ff x ON x.symbol = r1.symbol AND x.row_no = r1.exit_no)"""


PNL = f""", pnl0 AS (SELECT *, CASE direction WHEN 'BUY' THEN 1 ELSE -1 END * (exit_price - entry_price) / tick_size * lots * tick_value AS gross_pnl, lots * 7.0 AS commission,
 CASE direction WHEN 'BUY' THEN swap_long ELSE swap_short END * lots * {nights('entry_time', 'exit_time')} AS swap_cost FROM resolved),
 pnl AS MATERIALIZED (SELECT *, gross_pnl - commission + swap_cost AS net_pnl FROM pnl0)"""

KEPT = """, kept AS (SELECT c.symbol, c.signal_no, c.exit_no FROM pnl c JOIN (SELECT symbol, min(signal_no) AS s FROM pnl GROUP BY symbol) m ON m.symbol = c.symbol AND m.s = c.signal_no
 UNION ALL SELECT symbol, signal_no, exit_no FROM (SELECT c.symbol, c.signal_no, c.exit_no, row_number() OVER (PARTITION BY c.symbol ORDER BY c.signal_no) AS rn
 FROM kept k JOIN pnl c ON c.symbol = k.symbol AND c.signal_no >= k.exit_no) WHERE rn = 1)"""
