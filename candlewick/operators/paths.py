"""Order-dependent rules over trades: equity, single position, guards, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions import forest, ordered


def equity_path(trades: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None,
                initial_equity: float, pnl: Column | None = None, extra: dict | None = None) -> DataFrame:
    """Add equity after each trade, its peak so far, the drawdown, and any ``extra`` running specs."""
    step = F.col("net_pnl") if pnl is None else pnl
    out = ordered.running(trades, keys, order, chunk, {"_walk": ("walk", step), **(extra or {})})
    start = F.lit(float(initial_equity))
    return (out.withColumn("equity", start + F.col("_walk")).withColumn("peak_equity", start + F.col("_walk_high"))
            .withColumn("drawdown", F.col("peak_equity") - F.col("equity"))
            .drop("_walk", "_walk_high", "_walk_low"))


def equity_curve(trades: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None,
                 initial_equity: float, digits: int = 2) -> DataFrame:
    """Curve points (keys, seq, time, equity) with an anchor at the entry of the first trade."""
    numbered = ordered.index_rows(trades, keys, [F.col(c) for c in order], chunk, out="seq")
    slices = None if chunk is None else F.floor((F.col("seq") - 1) / ordered.CHUNK_ROWS)
    path = equity_path(numbered, keys, ["seq"], slices, initial_equity)
    points = path.select(*keys, "seq", F.col("exit_time").alias("time"), F.round("equity", digits).alias("equity"))
    anchor = numbered.filter("seq = 1").select(*keys, F.lit(0).cast("bigint").alias("seq"),
                                               F.col("entry_time").alias("time"),
                                               F.lit(float(initial_equity)).alias("equity"))
    return anchor.unionByName(points)


def one_position(cands: DataFrame, keys: Sequence[str], size: int = forest.SLOT) -> DataFrame:
    """Keep the candidates a single-position account would take.

    Needs ``signal_no`` and ``exit_no`` (bar numbers, unique signal per key): a candidate is taken when flat at its signal bar, so
    each candidate leads to the first one at or after its exit. Those links are a forest (see ``functions.forest``), of which the
    path from a key's first candidate is kept, however long candidates overlap. ``cands`` is read several times.
    """
    return forest.path(cands, keys, "signal_no", "exit_no", size)


def guard_columns(taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What guards of an account look at when a taken trade signals, as plain columns.

    Needs ``signal_no, exit_no, direction, net_pnl, signal_day, exit_day``, and the midline crossings counted up to the signal bar and
    before the exit bar, ``cross_at_signal, cross_before_exit``. Adds

    * ``day_low``: the lowest the day's realised P&L had been, over earlier trades closed on the signal's day (NULL without one);
    * ``side_lost``: the trade before lost on the same side and the midline was not crossed since.

    Trades are those of the path without guards: a guard filters them, it does not time later ones anew.
    """
    day = F.struct(*[F.col(k) for k in keys], "exit_day")
    w = Window.partitionBy(day).orderBy("signal_no")
    rows = taken.withColumn("_day_sum", F.sum("net_pnl").over(w)).withColumn("_day_low", F.min("_day_sum").over(w))
    last = F.struct("exit_day", "_day_low", "direction", "net_pnl", "cross_before_exit")
    seen = ordered.running(rows, keys, ["signal_no"], F.floor(F.col("signal_no") / ordered.CHUNK_ROWS), {"_before": ("last", last, True)})
    b = lambda c: F.col(f"_before.{c}")
    lost = (b("net_pnl") < 0) & (b("direction") == F.col("direction")) & (F.col("cross_at_signal") <= b("cross_before_exit"))
    return (seen.withColumn("day_low", F.when(b("exit_day") == F.col("signal_day"), b("_day_low")))
            .withColumn("side_lost", F.coalesce(lost, F.lit(False))).drop("_day_sum", "_day_low", "_before"))


def guarded(taken: DataFrame, keys: Sequence[str], capital: float, halt_pct: Column, cooldown: Column) -> DataFrame:
    """Leave out trades signalled on a day whose realised loss had reached ``halt_pct`` of ``capital`` (0: no limit), and, with
    ``cooldown``, trades on a side that just lost before the midline was crossed."""
    return let_through(guard_columns(taken, keys), capital, halt_pct, cooldown)


def let_through(marked: DataFrame, capital: float, halt_pct: Column, cooldown: Column) -> DataFrame:
    """The filter of ``guarded`` over trades that have their ``guard_columns``."""
    halted = (halt_pct > 0) & (F.col("day_low") / capital * 100 <= -halt_pct)
    return marked.filter(~F.coalesce(halted, F.lit(False)) & ~(F.coalesce(cooldown, F.lit(False)) & F.col("side_lost"))).drop("day_low", "side_lost")


# Broker deal reason codes.
DEAL_REASONS = {4: "SL_HIT", 5: "TP_HIT", 0: "MANUAL_CLOSE", 3: "MARGIN_STOP_OUT"}


def close_reason(code: Column, comment: Column) -> Column:
    out = F.coalesce(F.when(comment != "", comment), F.lit("BROKER_CLOSE"))
    for value, name in DEAL_REASONS.items():
        out = F.when(code == value, F.lit(name)).otherwise(out)
    return out


def closed_positions(previous: DataFrame, current: DataFrame, deals: DataFrame) -> DataFrame:
    """Tickets that vanished between two snapshots, with their exit deal.

    The exit deal is the latest with ``entry_type = 1`` (any deal if there is none); opening price is
    that of the ticket's first deal.
    """
    gone = previous.join(current.select("account", "ticket"), ["account", "ticket"], "left_anti")
    out = F.when(F.col("entry_type") == 1, F.lit(1)).otherwise(F.lit(0))
    last = F.struct(out.alias("is_out"), F.col("deal_time"), F.col("deal_id"))
    per_ticket = (deals.join(gone.select("account", "ticket"), ["account", "ticket"], "left_semi")
                  .groupBy("account", "ticket")
                  .agg(F.max_by(F.struct("deal_time", "price", "volume", "profit", "swap", "commission", "reason_code",
                                         "comment"), last).alias("_d"),
                       F.min_by("price", F.struct("deal_time", "deal_id")).alias("open_price")))
    return gone.select("account", "ticket").join(per_ticket, ["account", "ticket"]).select(
        "account", "ticket", "open_price", F.col("_d.price").alias("close_price"), F.col("_d.volume").alias("volume"),
        (F.col("_d.profit") + F.coalesce("_d.swap", F.lit(0.0)) + F.coalesce("_d.commission", F.lit(0.0))).alias("net_profit"),
        F.col("_d.deal_time").alias("closed_at"), close_reason(F.col("_d.reason_code"), F.col("_d.comment")).alias("close_reason"))


def owned(positions: DataFrame, magic: int | None) -> DataFrame:
    """Rows of one strategy's magic number; rows without a number count as owned."""
    return positions if magic is None else positions.filter(F.col("magic").isNull() | (F.col("magic") == magic))


def last_closed_trade(trades: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    best = F.max_by(F.struct(*fields), F.struct(*order))
    return trades.groupBy(*keys).agg(best.alias("_t")).select(*keys, *[F.col(f"_t.{f}").alias(f) for f in fields])
