"""Instrument arithmetic: pips, sizing, spread, slippage, commission, swap, P&L."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spread multiplier per session.
SESSION_SPREAD = {
    "LONDON": 1.0, "LONDON_NY_OVERLAP": 1.0, "NEW_YORK": 1.1, "LONDON_OPEN": 1.3,
    "NY_OPEN": 1.2, "ASIAN": 1.5, "DEAD_ZONE": 2.5,
}
# Plausible tick value per symbol (low, high); any other symbol uses the default.
TICK_VALUE_RANGE = {
    "EURUSD": (0.50, 1.50), "GBPUSD": (0.50, 1.50), "USDJPY": (0.30, 1.20),
    "USDCAD": (0.30, 1.20), "XAUUSD": (0.05, 0.20),
}
TICK_VALUE_DEFAULT = (0.01, 10.0)

BASE_SLIPPAGE_PIPS = 0.3
COMMISSION_PER_LOT = 7.0


def is_buy(direction: Column) -> Column:
    return direction == "BUY"


def signed(direction: Column, x: Column) -> Column:
    return F.when(is_buy(direction), x).otherwise(-x)


def pip_size(digits: Column, point: Column) -> Column:
    return F.when(digits.isin(3, 5), point * 10).otherwise(point)


def pip_value(tick_value: Column, tick_size: Column, pip: Column) -> Column:
    return F.when(tick_size == 0, F.lit(0.0)).otherwise(tick_value * F.try_divide(pip, tick_size))


def price_to_pips(distance: Column, pip: Column) -> Column:
    return F.when(pip == 0, F.lit(0.0)).otherwise(F.try_divide(distance, pip))


def pips_to_price(pips: Column, pip: Column) -> Column:
    return pips * pip


def lots_for_risk(capital: Column, risk_pct: Column, stop_distance: Column, tick_size: Column, tick_value: Column,
                  volume_min: Column, volume_step: Column, volume_max: Column) -> Column:
    """Lots that risk ``risk_pct`` of ``capital`` at ``stop_distance``, floored to the volume step.

    0 when inputs make no sense or when even the smallest lot risks over 1.5 times the allowance.
    """
    allowance = capital * risk_pct / F.lit(100.0)
    per_lot = F.try_divide(stop_distance, tick_size) * tick_value
    step = F.when(volume_step > 0, volume_step).otherwise(F.lit(0.01))
    decimals = F.when(step < 1, F.greatest(F.lit(0), F.round(-F.log10(step)).cast("int"))).otherwise(F.lit(0))
    scale = F.pow(F.lit(10.0), decimals)
    raw = F.floor((F.try_divide(allowance, per_lot) + F.lit(1e-9)) / step) * step
    sized = F.floor(raw * scale + F.lit(0.5)) / scale
    small = F.when(volume_min * per_lot > allowance * 1.5, F.lit(0.0)).otherwise(volume_min)
    capped = F.when(volume_max > 0, F.least(volume_max, sized)).otherwise(sized)
    valid = ((stop_distance > 0) & (capital > 0) & (risk_pct > 0) & (tick_size > 0) & (tick_value > 0))
    return F.when(valid, F.when(sized <= volume_min, small).otherwise(capped)).otherwise(F.lit(0.0))


def stop_far_enough(entry: Column, stop: Column, point: Column, stops_level: Column) -> Column:
    return F.abs(entry - stop) / point >= stops_level


def tick_value_sane(symbol: Column, tick_value: Column) -> Column:
    lo, hi = F.lit(TICK_VALUE_DEFAULT[0]), F.lit(TICK_VALUE_DEFAULT[1])
    for name, (low, high) in TICK_VALUE_RANGE.items():
        lo = F.when(symbol == name, F.lit(low)).otherwise(lo)
        hi = F.when(symbol == name, F.lit(high)).otherwise(hi)
    return (tick_value >= lo) & (tick_value <= hi)


def session_multiplier(session: Column) -> Column:
    out = F.lit(1.0)
    for name, mult in SESSION_SPREAD.items():
        out = F.when(session == name, F.lit(mult)).otherwise(out)
    return out


def volatility_multiplier(atr_ratio: Column) -> Column:
    # NULL and zero ratios count as 1
    r = F.when(atr_ratio.isNull() | (atr_ratio == 0), F.lit(1.0)).otherwise(atr_ratio)
    return F.when(r < 0.7, 0.9).when(r < 1.3, 1.0).when(r < 2.0, 1.4).otherwise(2.0)


def uniform_hash(*parts: Column) -> Column:
    """Repeatable number in [0, 1) from the first 32 bits of an MD5 over the parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def cost_noise(*parts: Column) -> Column:
    """Repeatable factor in [0.85, 1.15)."""
    return F.lit(0.85) + F.lit(0.3) * uniform_hash(*parts)


def spread_pips(typical_points: Column, point: Column, pip: Column, session: Column, atr_ratio: Column,
                noise: Column) -> Column:
    base = F.when(pip > 0, price_to_pips(typical_points * point, pip)).otherwise(F.lit(1.0))
    return base * session_multiplier(session) * volatility_multiplier(atr_ratio) * noise


def slippage_pips(atr_ratio: Column, noise: Column, base: float = BASE_SLIPPAGE_PIPS) -> Column:
    return F.lit(base) * volatility_multiplier(atr_ratio) * noise


def swap_cost(direction: Column, swap_long: Column, swap_short: Column, lots: Column, nights: Column) -> Column:
    return F.when(is_buy(direction), swap_long).otherwise(swap_short) * lots * nights


def gross_pnl(direction: Column, entry: Column, exit_: Column, lots: Column, tick_size: Column,
              tick_value: Column) -> Column:
    return signed(direction, F.try_divide(exit_ - entry, tick_size)) * lots * tick_value


def leg_commission(lots: Column, per_lot: Column) -> Column:
    return lots * per_lot / F.lit(2.0)


def quoted_spread_pips(bid: Column, ask: Column, pip: Column) -> Column:
    """Live spread; 1 when a quote is missing or not positive."""
    value = F.try_divide(ask - bid, F.when(pip > 0, pip))
    return F.when(value > 0, value).otherwise(F.lit(1.0))
