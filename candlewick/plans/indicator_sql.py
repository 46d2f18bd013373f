"""DuckDB text for the sequential indicator definitions: plain recursions, bar by bar."""

from candlewick import bindings as b


def recursion(name: str, source: str, col: str, n: int, alpha: float, first_row: int = 1) -> str:
    """CTE ``name(symbol, row_no, y)``: seeded with the mean of the first n values, then one step per bar."""
    seed_row = first_row + n - 1
    return f""", {name} AS (
 SELECT symbol, {seed_row}::BIGINT AS row_no, avg({col}) AS y FROM {source} WHERE row_no BETWEEN {first_row} AND {seed_row}
 GROUP BY symbol HAVING count(*) = {n}
 UNION ALL SELECT i.symbol, i.row_no, r.y + {alpha!r} * (i.{col} - r.y) FROM {name} r JOIN {source} i
 ON i.symbol = r.symbol AND i.row_no = r.row_no + 1)"""


def base(bars: str = "indexed") -> str:
    """WITH clause up to ``ix``: indexed bars with step, true range and directional moves."""
    start = b.with_sql(bars) if bars == "indexed" else b.with_sql("daily") + ", " + b.SQL["indexed"]
    return start + """, lagged AS MATERIALIZED (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl
  FROM indexed WINDOW w AS (PARTITION BY symbol ORDER BY row_no)),
 ix AS MATERIALIZED (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain,
  CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss,
  CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  CASE WHEN pc IS NOT NULL THEN CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END END AS up,
  CASE WHEN pc IS NOT NULL THEN CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END END AS dn FROM lagged)"""


def rsi(n: int = 14) -> str:
    a = 1.0 / n
    return (recursion("ag", "ix", "gain", n, a, 2) + recursion("al", "ix", "loss", n, a, 2)
            + """, rsi AS MATERIALIZED (SELECT symbol, row_no, CASE WHEN ag.y + al.y <> 0 THEN 100 * ag.y / (ag.y + al.y) END AS rsi
 FROM ag JOIN al USING (symbol, row_no))""")


def atr(n: int = 14) -> str:
    return recursion("atr0", "ix", "tr", n, 1.0 / n, 2) + ", atr AS MATERIALIZED (SELECT symbol, row_no, y AS atr FROM atr0)"


def adx(n: int = 14) -> str:
    """Needs ``atr`` with the same period."""
    a = 1.0 / n
    return (recursion("au", "ix", "up", n, a, 2) + recursion("ad", "ix", "dn", n, a, 2)
            + """, di AS MATERIALIZED (SELECT symbol, row_no, CASE WHEN atr <> 0 THEN 100 * au.y / atr ELSE 0 END AS dmp,
 CASE WHEN atr <> 0 THEN 100 * ad.y / atr ELSE 0 END AS dmn FROM au JOIN ad USING (symbol, row_no) JOIN atr USING (symbol, row_no)),
 dx AS MATERIALIZED (SELECT *, CASE WHEN dmp + dmn <> 0 THEN 100 * abs(dmp - dmn) / (dmp + dmn) ELSE 0 END AS dx FROM di)"""
            + recursion("adx0", "dx", "dx", n, a, n + 1)
            + ", adx AS MATERIALIZED (SELECT di.symbol, di.row_no, dmp, dmn, y AS adx FROM di LEFT JOIN adx0 USING (symbol, row_no))")


REGIME = """CASE WHEN adx IS NULL OR atr_ratio IS NULL THEN NULL WHEN atr_ratio < 0.7 THEN 'QUIET' WHEN atr_ratio > 1.5 THEN 'VOLATILE'
 WHEN adx > 25 THEN 'TRENDING' WHEN adx < 20 THEN 'RANGING' ELSE 'TRANSITIONING' END"""


def features(fast: int = 10, slow: int = 50, channel: int = 20, exit_: int = 10, bars: str = "indexed") -> str:
    """WITH clause up to ``feats``: the wide feature table."""
    def full(expr, n, off=0):
        return f"CASE WHEN row_no >= {n + off} THEN {expr} OVER (PARTITION BY symbol ORDER BY row_no ROWS BETWEEN {n - 1 + off} PRECEDING AND {f'{off} PRECEDING' if off else 'CURRENT ROW'}) END"

    return base(bars) + rsi() + atr() + adx() + f""", f1 AS MATERIALIZED (SELECT ix.*, rsi, atr, adx, dmp, dmn,
 {full('avg(close)', fast)} AS sma_fast, {full('avg(close)', slow)} AS sma_slow, {full('avg(volume)', 20)} AS volume_sma,
 {full('avg(close)', 20)} AS bb_mid, {full('stddev_pop(close)', 20)} AS sd,
 {full('max(high)', channel, 1)} AS donchian_upper_entry, {full('min(low)', channel, 1)} AS donchian_lower_entry,
 {full('max(high)', exit_, 1)} AS donchian_upper_exit, {full('min(low)', exit_, 1)} AS donchian_lower_exit
 FROM ix LEFT JOIN rsi USING (symbol, row_no) LEFT JOIN atr USING (symbol, row_no) LEFT JOIN adx USING (symbol, row_no)),
 f2 AS (SELECT *, CASE WHEN sd > 0 THEN (close - (bb_mid - 2 * sd)) / (4 * sd) END AS bb_pct,
 CASE WHEN volume_sma <> 0 THEN volume / volume_sma END AS volume_rel,
 CASE WHEN row_no >= 34 THEN avg(atr) OVER (PARTITION BY symbol ORDER BY row_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS atr_sma20 FROM f1),
 f3 AS (SELECT *, CASE WHEN atr_sma20 <> 0 THEN atr / atr_sma20 END AS atr_ratio, {b.session_sql('ts')} AS session FROM f2),
 feats AS MATERIALIZED (SELECT *, {REGIME} AS regime, lag(sma_fast) OVER w AS sma_fast_prev, lag(sma_slow) OVER w AS sma_slow_prev,
 lag(rsi) OVER w AS rsi_prev FROM f3 WINDOW w AS (PARTITION BY symbol ORDER BY row_no))"""
