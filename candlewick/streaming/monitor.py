"""Streaming degradation monitoring: keyed detector state that survives restarts through checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from candlewick.operators.monitor import (
    ALERTS_BEFORE_RERUN, MAX_LOSS_STREAK, MIN_TRADES, PF_RATIO, ROLLING, STALE_MINUTES, THRESHOLD, WIN_RATE_RATIO, cusum_reference_value,
)

STATE_OUT = ("strategy_id bigint, trade_id bigint, closed_at timestamp, trade_no bigint, net_pnl double, rolling_trades bigint, rolling_win_rate double, rolling_pf double, "
             "rolling_net_pnl double, loss_streak bigint, max_loss_streak bigint, wins bigint, alerts array<string>, alert_count int, cusum_score double, "
             "cusum_tripped boolean, trip_no bigint, status string, rerun_recommended boolean")
_COUNTERS = ("score double, alert_count int, trades bigint, wins bigint, max_loss_streak bigint, trip_no bigint, status string, rerun boolean, last_us bigint")
_TRADE = "closed_us bigint, trade_id bigint, net_pnl double, p0 double, wf_median_pf double, wf_win_rate double"
_FIELDS = [c.split()[0] for c in _TRADE.split(", ")]


def _reflected(start: float, steps: np.ndarray) -> np.ndarray:
    """max(0, s + step) after every step: the total minus its running minimum, which begins at the state."""
    total = start + np.cumsum(steps)
    return total - np.minimum.accumulate(np.minimum(total, 0.0))


def _carried(values: list, first) -> list:
    """Each value, or the latest one before it where it is None."""
    out = []
    for v in values:
        first = first if v is None else v
        out.append(first)
    return out


def advance(counters: tuple, recent: list[float], t: pd.DataFrame) -> tuple[tuple, list[float], pd.DataFrame]:
    """Counters and the ring of recent results after the trades ``t``, in order, and one row per trade.

    Rolling figures are sliding windows over ring and new trades together; score and alert counter are reflected walks.
    """
    score, alert_count, seen, wins, worst, trip_no, status, rerun, _ = counters
    pnl, n = t["net_pnl"].to_numpy(), len(t)
    ring = np.concatenate([np.zeros(ROLLING - 1 - len(recent)), recent, pnl])
    real = np.concatenate([np.zeros(ROLLING - 1 - len(recent), bool), np.ones(len(recent) + n, bool)])
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, ROLLING)
    count, won = view(real).sum(1), (pnl > 0).astype(float)
    gain, loss = view(np.where(ring > 0, ring, 0.0)).sum(1), np.abs(view(np.where(ring <= 0, ring, 0.0)).sum(1))
    pf = np.where(loss > 0, gain / np.where(loss > 0, loss, 1.0), np.where(gain > 0, np.inf, 0.0))
    rate = (view(ring > 0).sum(1)) / count
    at = np.arange(len(ring))
    last_win = np.maximum.accumulate(np.where(ring > 0, at, -1))[ROLLING - 1:]
    streak = np.where(last_win > at[ROLLING - 1:] - ROLLING, np.minimum(at[ROLLING - 1:] - last_win, count), count)
    active = count >= MIN_TRADES
    base_pf, base_rate = t["wf_median_pf"].to_numpy(), t["wf_win_rate"].to_numpy()
    tests = [("PF_DEGRADATION", (base_pf > 0) & (pf < base_pf * PF_RATIO)), ("CONSECUTIVE_LOSSES", streak >= MAX_LOSS_STREAK),
             ("WIN_RATE_DEGRADATION", (base_rate > 0) & (rate < base_rate * WIN_RATE_RATIO))]
    alerts = [[name for name, fired in tests if active[i] and fired[i]] for i in range(n)]
    fired = np.array([bool(a) for a in alerts])
    alert = _reflected(float(alert_count), np.where(fired, 1.0, np.where(active, -1.0, 0.0))).round().astype(int)
    k = {p: cusum_reference_value(p) for p in set(t["p0"])}
    cusum, number = _reflected(score, t["p0"].map(k).to_numpy() - won), seen + np.arange(1, n + 1)
    over = np.flatnonzero((number >= MIN_TRADES) & (cusum >= THRESHOLD))
    if trip_no is None and len(over):
        trip_no = int(number[over[0]])
    tripped = np.zeros(n, bool) if trip_no is None else number >= trip_no
    clear = ~fired & active & (alert == 0)
    level = [("DEGRADED" if a >= ALERTS_BEFORE_RERUN else "WARNING") if f else ("OK" if c else None) for f, a, c in zip(fired, alert, clear, strict=True)]
    again = [True if f and a >= ALERTS_BEFORE_RERUN else (False if c else None) for f, a, c in zip(fired, alert, clear, strict=True)]
    level, again = _carried(level, status), _carried(again, rerun)
    streaks = np.maximum.accumulate(np.maximum(streak, worst))
    rows = pd.DataFrame({
        "trade_id": t["trade_id"].to_numpy(), "closed_at": pd.to_datetime(t["closed_us"].to_numpy(), unit="us"), "trade_no": number, "net_pnl": pnl, "rolling_trades": count,
        "rolling_win_rate": rate, "rolling_pf": pf, "rolling_net_pnl": view(ring).sum(1), "loss_streak": streak, "max_loss_streak": streaks, "wins": wins + won.cumsum().astype(int),
        "alerts": alerts, "alert_count": alert, "cusum_score": cusum, "cusum_tripped": tripped, "trip_no": [trip_no if x else None for x in tripped],
        "status": np.where(tripped, "DEGRADED", level), "rerun_recommended": tripped | np.array(again, bool)})
    rows["trip_no"] = rows["trip_no"].astype("Int64")
    new = (float(cusum[-1]), int(alert[-1]), seen + n, int(wins + won.sum()), int(streaks[-1]), trip_no, level[-1], again[-1], int(t["closed_us"].iloc[-1]))
    return new, [*recent, *pnl.tolist()][-(ROLLING - 1):], rows


class Monitor(StatefulProcessor):
    """Keyed state of the monitor: counters (a value), the ring of recent results and the trades the watermark has not passed (lists).

    Trades wait until the watermark has passed their closing time, so they are counted in closing order whatever the order of arrival. A timer
    at the earliest waiting trade releases them. With ``forget_days`` a strategy without trades for so long loses its state.
    """

    START = (0.0, 0, 0, 0, 0, None, "OK", False, 0)

    def __init__(self, forget_days: int | None = None):
        self.forget_ms = None if forget_days is None else forget_days * 86_400_000

    def init(self, handle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", _COUNTERS)
        self.recent = handle.getListState("recent", "net_pnl double")
        self.waiting = handle.getListState("waiting", _TRADE)

    def _wake(self, now_ms: int, waiting: pd.DataFrame, last_us: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if len(waiting):
            self.handle.registerTimer(max(-(-int(waiting["closed_us"].min()) // 1000), now_ms + 1))
        elif self.forget_ms is not None and last_us is not None:
            self.handle.registerTimer(max(last_us // 1000 + self.forget_ms, now_ms + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([f[_FIELDS] for f in rows])
        self.waiting.appendList([tuple(r) for r in new.itertuples(index=False)])
        self._wake(max(timerValues.getCurrentWatermarkInMs(), 0), new if not self.waiting.exists() else self._frame(), None)
        return iter(())

    def _frame(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=_FIELDS) if self.waiting.exists() else pd.DataFrame(columns=_FIELDS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, waiting = timerValues.getCurrentWatermarkInMs(), self._frame()
        ready = waiting[waiting["closed_us"] <= now * 1000].sort_values(["closed_us", "trade_id"])
        counters = tuple(self.counters.get()) if self.counters.exists() else None
        if not len(ready):
            if not len(waiting) and counters is not None and self.forget_ms is not None and counters[-1] // 1000 + self.forget_ms <= now:
                for state in (self.counters, self.recent, self.waiting):
                    state.clear()
            return iter(())
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        counters, recent, out = advance(counters or self.START, recent, ready)
        self.counters.update(counters)
        self.recent.put([(x,) for x in recent])
        left = waiting[waiting["closed_us"] > now * 1000]
        self.waiting.put([tuple(r) for r in left.itertuples(index=False)]) if len(left) else self.waiting.clear()
        self._wake(now, left, counters[-1])
        out.insert(0, "strategy_id", key[0])
        return iter((out,))

    def close(self) -> None:
        pass


def degradation_stream(trades: DataFrame, baselines: DataFrame, late_by: str = "1 hour", forget_days: int | None = None) -> DataFrame:
    """The batch monitor's row after every closed trade of a stream (strategy_id, trade_id, net_pnl, closed_at): rolling figures,
    alerts, alert counter, detector score, status.

    Trades may arrive up to ``late_by`` out of order; later ones are dropped. ``baselines``: strategy_id, p0, wf_median_pf, wf_win_rate.
    State is one small row, 29 numbers and the waiting trades per strategy. The session must use the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), which keyed timers need.
    """
    joined = trades.withWatermark("closed_at", late_by).join(baselines.select("strategy_id", "p0", "wf_median_pf", "wf_win_rate"), "strategy_id")
    flat = joined.select("strategy_id", "closed_at", F.unix_micros("closed_at").alias("closed_us"), *_FIELDS[1:])
    return flat.groupBy("strategy_id").transformWithStateInPandas(Monitor(forget_days), STATE_OUT, "append", "EventTime")


def cusum_stream(trades: DataFrame, baselines: DataFrame, late_by: str = "1 hour", forget_days: int | None = None) -> DataFrame:
    """The detector's part of ``degradation_stream``."""
    rows = degradation_stream(trades, baselines, late_by, forget_days)
    return rows.select("strategy_id", "trade_id", "closed_at", "trade_no", "cusum_score", "cusum_tripped")


def staleness_stream(bars: DataFrame, minutes: int = STALE_MINUTES, late_by: str = "1 minute") -> DataFrame:
    """Emit a row per symbol when its newest bar was seen and when it then went stale (event time)."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"symbol": [key[0]], "last_candle": [pd.Timestamp(last, unit="us")], "stale": [True]})
            return
        newest = max(int(f["micros"].max()) for f in frames)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        # a timer in the past fires with the next watermark
        state.setTimeoutTimestamp(max(newest // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"symbol": [key[0]], "last_candle": [pd.Timestamp(newest, unit="us")], "stale": [False]})

    # only the newest time per symbol and batch matters
    src = bars.withWatermark("ts", late_by).select("symbol", "ts", F.unix_micros("ts").alias("micros"))
    return src.groupBy("symbol").applyInPandasWithState(watch, "symbol string, last_candle timestamp, stale boolean", "last bigint", "append",
                                                        GroupStateTimeout.EventTimeTimeout)


def new_trade_files(spark, path: str, schema, max_files: int = 1000) -> DataFrame:
    """Stream of trade-log files; the query checkpoint remembers which files were processed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def event_sink(path: str):
    """``foreachBatch`` function that appends candle events (with checklist) one folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("record_type", F.lit("EVENT")).write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write
