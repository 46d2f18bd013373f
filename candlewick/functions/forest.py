"""Paths through a forest of successors, for any number of nodes per key.

A node is a row with a place ``at`` (unique per key) and a place ``free``: its successor is the first node of the key at
or after ``free``. ``path`` returns the nodes met from the first node of each key on.

Following links one by one is sequential; here places are cut into slots of ``size``, slots into groups of ``fan`` slots, and so on:

* *up*: inside a slot all links are followed at once (pointer doubling, from right to left in effect) until they leave it. Only the
  nodes at which links from outside arrive stay for the next level, each with the node at which its own path leaves the wider slot;
* *down*: at the top one slot holds the path of each key; the nodes on it are the entries of the slots below.

A task holds whole slots one after the other, never a key. Paths that have met stay together, so each level has few nodes; at worst a
slot of an upper level holds ``fan`` times the nodes that one link can leap over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from candlewick.functions import ordered
from candlewick.functions.staging import stage

SLOT, FAN = 1 << 16, 64


def _whole_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut anew at slot borders (rows come sorted by slot and place; ``_pos`` is 1 where a slot begins)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        begins = np.flatnonzero(b.column("_pos").to_numpy() == 1)
        if len(begins):
            last = int(begins[-1])
            if held or last:
                yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _links(rows: pa.Table, size: int) -> np.ndarray:
    """The index of each row's successor inside its slot, or -1."""
    at, free = rows.column("_at").to_numpy(), rows.column("_free").to_numpy()
    slot, inside = np.cumsum(rows.column("_pos").to_numpy() == 1) * (size + 1), at % size
    found = np.searchsorted(slot + inside, slot + np.minimum(free - at + inside, size))
    same = found < len(at)
    same[same] = slot[found[same]] == slot[same]
    return np.where(same, found, -1)


def _leaving(rows: pa.Table, size: int) -> pa.Table:
    """``_free`` becomes that of the last node of each row's path inside its slot."""
    nxt = _links(rows, size)
    jump = np.where(nxt < 0, np.arange(len(nxt)), nxt)
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    return rows.set_column(rows.column_names.index("_free"), "_free", pa.array(rows.column("_free").to_numpy()[jump]))


def _on_path(rows: pa.Table, size: int) -> pa.Table:
    """The rows met from the entries on, inside their slots; without entries from the first row of each slot."""
    known = "_entry" in rows.column_names
    met = rows.column("_entry").to_numpy().astype(bool) if known else rows.column("_pos").to_numpy() == 1
    nxt, here = _links(rows, size), np.flatnonzero(met)
    while len(here):
        here = nxt[here]
        here = here[here >= 0]
        met[here] = True
    return rows.filter(pa.array(met))


def _by_slot(nodes: DataFrame, size: int, fn: Callable[[pa.Table, int], pa.Table]) -> DataFrame:
    names = [c for c in nodes.columns if c != "_entry"]
    schema = StructType([nodes.schema[c] for c in names])
    slot = F.struct("_k", F.floor(F.col("_at") / size).alias("slot"))
    cut = nodes.withColumn("_g", slot).withColumn("_pos", F.row_number().over(Window.partitionBy("_g").orderBy("_at"))).drop("_g")

    def run(batches):
        for rows in _whole_slots(batches):
            yield from fn(rows, size).select(names).to_batches()

    return cut.mapInArrow(run, schema)


def _met(nodes: DataFrame, size: int, entries: DataFrame | None) -> DataFrame:
    if entries is not None:
        marks = entries.withColumn("_entry", F.lit(True))
        nodes = nodes.join(marks.hint("merge"), ["_k", "_at"], "left").withColumn("_entry", F.col("_entry").isNotNull())
    return _by_slot(nodes, size, _on_path)


def _landing(places: DataFrame, lookups: DataFrame, size: int) -> DataFrame:
    """The first of ``places`` (_k, _at) at or after each of ``lookups`` (_k, _free): _k, _free, _land."""
    both = places.select("_k", F.col("_at").alias("_p"), F.lit(1).alias("_node")).unionByName(lookups.select("_k", F.col("_free").alias("_p"), F.lit(0).alias("_node")))
    found = ordered.running(both, ["_k"], ["_p", "_node"], F.floor(F.col("_p") / size), {"_land": ("min", F.when(F.col("_node") == 1, F.col("_p")))}, descending=True)
    return found.where("_node = 0").select("_k", F.col("_p").alias("_free"), "_land")


def path(nodes: DataFrame, keys: Sequence[str], at: str, free: str, size: int = SLOT, fan: int = FAN) -> DataFrame:
    """The rows of ``nodes`` on the path of their key. ``nodes`` is read several times: hand in a scan.

    Null keys are keys like others; rows without a place are never met, a null ``free`` ends the path, one at or before the row's own
    place leads to the next row.
    """
    rows = nodes.where(F.col(at).isNotNull())
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    if lo is None:
        return rows
    end = int(hi) - int(lo) + 1
    place = lambda c: F.col(c).cast("bigint") - int(lo)
    rows = rows.withColumns({"_at": place(at), "_free": F.when(F.col(free).isNull(), end).otherwise(F.least(F.greatest(place(free), place(at) + 1), F.lit(end))), "_k": F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_"))})
    levels, width, current = [], size, rows.select("_k", "_at", "_free")
    while width < end:
        left = stage(_by_slot(current, width, _leaving))
        land = stage(_landing(current, left.select("_k", "_free").distinct(), width))
        doors = land.where("_land IS NOT NULL").select("_k", F.col("_land").alias("_at")).unionByName(current.groupBy("_k").agg(F.min("_at").alias("_at"))).distinct()
        levels.append((current, width))
        current = stage(left.join(doors, ["_k", "_at"], "left_semi").join(land, ["_k", "_free"], "left").select("_k", "_at", F.coalesce("_land", F.lit(end)).alias("_free")))
        width *= fan
    entries = None
    for level, wide in reversed([*levels[1:], (current, width)] if levels else []):
        entries = stage(_met(level, wide, entries).select("_k", "_at"))
    return _met(rows, size if levels else width, entries).select(*nodes.columns)
