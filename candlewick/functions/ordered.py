"""Ordered computations over keyed rows, cut into chunks of bounded size.

A window over ``partitionBy(symbol)`` puts a whole symbol into one task. Everything here splits an
ordered key into chunks first, so the largest sort is one chunk, however hot the key is:

* ``index_rows``       row number per key from chunk counts plus their running sum;
* ``spread``           equal chunks by row number, each with the preceding rows it needs (its halo),
                       for every window with a bounded frame;
* ``running``          unbounded running sum/max/min/last and walks (a sum with its extremes: drawdown,
                       reflected walks): local window plus the carry of earlier chunks;
* ``averages``         first-order linear recurrences (EMA, Wilder averages) as affine maps composed along the chunks;
* ``recurrence``       the same inside a chunk and its halo, where many short averages share one shuffle.

``chunk`` arguments are columns that never decrease along the row order. Only the per-chunk summary
(one row per key and chunk) is ever ordered as a whole. Where no key has more than WHOLE_ROWS rows (see ``chunk_unless_small``), ``chunk`` is
None: keys are whole, rows are shuffled once and there is no summary to carry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

CHUNK_ROWS = 4096
# rows of one key that plain windows take in one task; they run over its sorted rows
WHOLE_ROWS = 1 << 18
# chunk of ``averages``: weights of alpha up to 2/3 stay in range
AVERAGE_ROWS = 512
# exp(-41.5) is below 1e-18: older inputs cannot change a double.
_FORGET = 41.5
# keeps (1 - alpha)^-rows below 1e250 inside one chunk
_GROWTH = 575.0


def time_chunk(ts: Column, seconds: int) -> Column:
    """Index of the fixed-length time slot holding ``ts``."""
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def time_slices(df: DataFrame, keys: Sequence[str], ts: str, out: str, rows: int = CHUNK_ROWS, slot: int = 86400) -> DataFrame:
    """Add a chunk column that follows the density of each key: the times that occur in a slot of ``slot`` seconds are
    cut into equal slices, as many as bring about ``rows`` rows into each."""
    at = F.unix_micros(ts)
    tagged = df.withColumn("_slot", F.floor(at / (slot * 1_000_000))).withColumn("_g", F.struct(*keys, "_slot"))
    found = tagged.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / rows).cast("bigint").alias("_parts"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    inside = F.floor((at - F.col("_lo")) * F.col("_parts") / (F.col("_hi") - F.col("_lo") + 1))
    return tagged.join(found, "_g").withColumn(out, F.col("_slot") * (1 << 24) + inside).drop("_g", "_slot", "_parts", "_lo", "_hi")


def _largest(df: DataFrame, *by: Column | str) -> int:
    """Rows of the largest group; they are counted before the shuffle."""
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def chunk_unless_small(df: DataFrame, keys: Sequence[str], chunk: Column, rows: int = WHOLE_ROWS) -> Column | None:
    """``chunk``, or None if no key has more than ``rows`` rows."""
    return None if _largest(df, *keys) <= rows else chunk


def tasks_unless_large(df: DataFrame, keys: Sequence[str], rows: int = WHOLE_ROWS) -> int | None:
    """How many tasks take whole keys, about ``rows`` rows or one key each, or None if a key has more than ``rows`` rows.

    For rows that are dealt once by ``keys``, after which windows and sums of any finer keys need no shuffle of their own.
    """
    total, densest = df.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
    return None if (densest or 0) > rows else max(df.sparkSession.sparkContext.defaultParallelism, math.ceil((total or 0) / rows))


def time_chunk_unless_small(df: DataFrame, keys: Sequence[str], ts: Column, seconds: int, rows: int = WHOLE_ROWS) -> Column | None:
    """Slots of time, or None if no key has more than ``rows`` rows.

    Slots are ``seconds`` times a power of two: the longest that hold no more than ``rows`` rows of any key, or one where none
    do. They are tried from the longest down, never shorter than the densest one asks for, so few counts are needed.
    """
    densest = _largest(df, *keys)
    if densest <= rows:
        return None
    span = df.agg(F.max(F.unix_seconds(ts)) - F.min(F.unix_seconds(ts))).first()[0] or 0
    doublings = (span // seconds).bit_length()
    while doublings and densest > rows:
        doublings = max(0, doublings - math.ceil(math.log2(densest / rows)))
        densest = _largest(df, *keys, time_chunk(ts, seconds << doublings))
    return time_chunk(ts, seconds << doublings)


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _group(keys: Sequence[str]) -> Column:
    """Key and chunk as one value that is never NULL itself: rows with a NULL key or chunk form groups as well."""
    return F.struct(*[F.col(c) for c in keys], F.col("_chunk"))


def _with(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows with the columns of their group's summary. Rows are already dealt and sorted by group, so only the
    summary moves; merging keeps the optimizer from broadcasting rows whose number it underestimates."""
    return rows.join(summary.hint("merge"), "_g").drop("_g")


def index_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column | None,
               out: str = "row_no") -> DataFrame:
    """Add the 1-based position of each row within its key, in ``order``."""
    if chunk is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    tagged = df.withColumn("_chunk", chunk)
    counts = tagged.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(_group(keys).alias("_g"), F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_offset"))
    tagged = tagged.withColumn("_g", _group(keys))
    local = Window.partitionBy("_g").orderBy(*order)
    return (tagged.withColumn("_pos", F.row_number().over(local))
            .transform(_with, offsets)
            .withColumn(out, F.col("_offset") + F.col("_pos"))
            .drop("_chunk", "_pos", "_offset"))


def spread(df: DataFrame, halo: int, size: int = CHUNK_ROWS, seq: str = "row_no") -> DataFrame:
    """Cut rows into chunks of ``size`` and repeat the ``halo`` rows before each chunk inside it.

    Adds ``_chunk`` and ``_own`` (false on halo copies). Windows with a frame of at most ``halo``
    preceding rows give full results on own rows; ``own_rows`` drops the copies afterwards.
    """
    at = F.col(seq) - 1
    first = F.floor(at / size)
    return (df.withColumn("_chunk", F.explode(F.sequence(first, F.floor((at + halo) / size))))
            .withColumn("_own", F.col("_chunk") == first))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_chunk", "_own")


def chunk_window(keys: Sequence[str], seq: str = "row_no"):
    return Window.partitionBy(*keys, "_chunk").orderBy(seq)


def full_frame(agg: Column, keys: Sequence[str], n: int, seq: str = "row_no",
               start: int | None = None, end: int = 0) -> Column:
    """``agg`` over the last ``n`` rows ending ``-end`` rows ago; NULL until that many rows exist."""
    lo = end - (n - 1) if start is None else start
    w = chunk_window(keys, seq).rowsBetween(lo, end)
    return F.when(F.col(seq) >= n - end, agg.over(w))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None,
            specs: Mapping[str, tuple], descending: bool = False, exclusive: bool = False) -> DataFrame:
    """Unbounded running aggregates, one pass for any number of them.

    ``specs`` maps an output name to ``(kind, expression)`` or ``(kind, expression, exclusive)``:

    * ``sum`` / ``max`` / ``min``; ``last`` is the latest non-NULL value;
    * ``walk`` is a running sum from 0 that also yields ``<name>_high`` and ``<name>_low``, its
      extremes so far (0 included).

    Exclusive aggregates leave the current row out. With ``descending`` the direction is from the
    end of the order backwards.
    """
    full = {n: (s[0], s[1], s[2] if len(s) > 2 else exclusive) for n, s in specs.items()}
    side = F.desc if descending else F.asc
    if chunk is None:
        return _running_whole(df, Window.partitionBy(*keys).orderBy(*[side(c) for c in order]), full)
    latest = F.min_by if descending else F.max_by
    place = F.struct(*[F.col(c) for c in order])
    part = Window.partitionBy("_g").orderBy(*[side(c) for c in order])
    before = Window.partitionBy(*keys).orderBy(side("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    has_walk = any(kind == "walk" for kind, _, _ in full.values())
    rows = df.withColumn("_chunk", chunk).withColumns({f"_x_{n}": x for n, (_, x, _) in full.items()}).withColumn("_g", _group(keys))
    local, totals, carries, merged = rows, [], {}, {}
    for n, (kind, _, excl) in full.items():
        x, t, c, v = F.col(f"_x_{n}"), f"_t_{n}", f"_c_{n}", f"_l_{n}"
        w = part.rowsBetween(Window.unboundedPreceding, -1 if excl else 0)
        if kind in ("sum", "walk"):
            totals.append(F.sum(x).alias(t))
            carries[c] = F.coalesce(F.sum(t).over(before), F.lit(0))
            local = local.withColumn(v, F.coalesce(F.sum(x).over(w), F.lit(0)))
            merged[n] = F.col(c) + F.col(v)
            if kind == "walk":
                local = (local.withColumn(f"{v}_hi", F.max(v).over(w)).withColumn(f"{v}_lo", F.min(v).over(w)))
                totals += [F.max(v).alias(f"{t}_hi"), F.min(v).alias(f"{t}_lo")]
                carries[f"{c}_hi"] = F.max(F.col(c) + F.col(f"{t}_hi")).over(before)
                carries[f"{c}_lo"] = F.min(F.col(c) + F.col(f"{t}_lo")).over(before)
                merged[f"{n}_high"] = F.greatest(F.lit(0.0), F.col(f"{c}_hi"), F.col(c) + F.col(f"{v}_hi"))
                merged[f"{n}_low"] = F.least(F.lit(0.0), F.col(f"{c}_lo"), F.col(c) + F.col(f"{v}_lo"))
        elif kind in ("max", "min"):
            fn, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            totals.append(fn(x).alias(t))
            carries[c] = fn(t).over(before)
            local = local.withColumn(v, fn(x).over(w))
            merged[n] = pick(F.col(c), F.col(v))
        elif kind == "last":
            totals.append(latest(x, F.when(x.isNotNull(), place)).alias(t))
            carries[c] = F.last(t, ignorenulls=True).over(before)
            local = local.withColumn(v, F.last(x, ignorenulls=True).over(w))
            merged[n] = F.coalesce(F.col(v), F.col(c))
        else:
            raise ValueError(f"unknown running aggregate {kind!r}")
    # Without walks the totals come straight from the input and combine before the shuffle.
    summary = (local if has_walk else rows).groupBy(*keys, "_chunk").agg(*totals)
    for c, expr in carries.items():
        summary = summary.withColumn(c, expr)
    joined = _with(local, summary.select(_group(keys).alias("_g"), *carries)).withColumns(merged)
    return joined.select(*[c for c in df.columns if c not in merged], *merged)


def _running_whole(df: DataFrame, part, specs: Mapping[str, tuple]) -> DataFrame:
    """``running`` over whole keys: plain windows, which share one shuffle with others of the same keys."""
    out, plain = df, {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda x: F.last(x, ignorenulls=True)}
    # inputs first: an output may carry the name of a column that a later input reads
    out = out.withColumns({f"_x_{n}": x for n, (_, x, _) in specs.items()})
    values = {}
    for n, (kind, _, excl) in specs.items():
        if kind != "walk" and kind not in plain:
            raise ValueError(f"unknown running aggregate {kind!r}")
        w = part.rowsBetween(Window.unboundedPreceding, -1 if excl else 0)
        x = F.col(f"_x_{n}")
        values[n] = f"_l_{n}"
        out = out.withColumn(values[n], F.coalesce(F.sum(x).over(w), F.lit(0)) if kind in ("sum", "walk") else plain[kind](x).over(w))
        if kind == "walk":
            for end, fn, pick in (("high", F.max, F.greatest), ("low", F.min, F.least)):
                values[f"{n}_{end}"] = f"_l_{n}_{end}"
                out = out.withColumn(f"_l_{n}_{end}", pick(F.lit(0.0), fn(f"_l_{n}").over(w)))
    return out.select(*[c for c in df.columns if c not in values], *[F.col(v).alias(n) for n, v in values.items()])


def _rate(alpha: float) -> float:
    return -math.log1p(-alpha) if alpha < 1 else math.inf


def recurrence_halo(alpha: float) -> int:
    """Rows after which a start value no longer shows in double precision."""
    return 0 if alpha >= 1 else math.ceil(_FORGET / _rate(alpha))


def recurrence_rows(alpha: float) -> int:
    """Longest chunk, halo included, that ``recurrence`` can scan without overflow."""
    return 1 << 30 if alpha >= 1 else int(_GROWTH / _rate(alpha))


def _layout(chains: Sequence[Sequence[float]], lookback: int) -> tuple[int, int]:
    halo = max([lookback, *(sum(recurrence_halo(a) for a in chain) + lookback for chain in chains)])
    longest = min([1 << 30, *(recurrence_rows(a) for chain in chains for a in chain)])
    return halo, min(longest - halo, max(CHUNK_ROWS, 4 * halo))


def fits(chains: Sequence[Sequence[float]], lookback: int = 0) -> bool:
    """Whether recurrences of these alphas can share chunks: the slowest one's halo must not outgrow the fastest one's range."""
    halo, size = _layout(chains, lookback)
    return size >= max(1, halo // 64)


def chunk_plan(chains: Sequence[Sequence[float]], lookback: int = 0) -> tuple[int, int]:
    """(halo, size) for recurrences with the given alphas that ``fits``; inner lists are applied one after another."""
    return _layout(chains, lookback)


def laid_out(rows: DataFrame, halo: int, size: int, **more: int) -> DataFrame:
    """Note on ``_chunk`` how ``spread`` has cut the rows, so that a table of them can be read back as chunks."""
    return rows.withMetadata("_chunk", {"halo": halo, "size": size, **more})


def layout_of(df: DataFrame) -> dict | None:
    return next((f.metadata for f in df.schema.fields if f.name == "_chunk" and "halo" in f.metadata), None)


def plain(df: DataFrame) -> DataFrame:
    """Rows without the copies that a noted layout brings along; other rows as they are."""
    return own_rows(df) if layout_of(df) else df


def chunked(df: DataFrame, lookback: int, chains: Sequence[Sequence[float]] = ()) -> tuple[DataFrame, int, int]:
    """(rows, halo, size) for windows over ``lookback`` rows and recurrences: rows that come in chunks wide enough are taken as they are."""
    halo, size = _layout(chains, lookback)
    have = layout_of(df)
    if have and have["halo"] >= halo and have["halo"] + have["size"] <= min([1 << 30, *(recurrence_rows(a) for chain in chains for a in chain)]):
        return df, have["halo"], have["size"]
    return spread(plain(df), halo, size), halo, size


def known(x: Column) -> Column:
    """NaN becomes NULL: a missing input, whichever way it is missing, leaves an average as it is."""
    return F.when(~F.isnan(x), x)


def recurrence(term: Column, seed: Column, seed_row: int, alpha: float, keys: Sequence[str],
               halo: int, size: int, seq: str = "row_no") -> Column:
    """``y = y + alpha * (x - y)`` seeded with ``seed`` at row ``seed_row``; NULL before it, unchanged where x is missing.

    Needs rows from ``spread(halo, size)``. Inputs are scaled by a weight that grows with every known input, summed with an
    ordinary running sum, and scaled back. Where most inputs of a halo are missing, use ``averages``.
    """
    x = known(term)
    w = chunk_window(keys, seq).rowsBetween(Window.unboundedPreceding, 0)
    if alpha >= 1:
        return F.when(F.col(seq) >= seed_row, F.last(F.when(F.col(seq) > seed_row, x).otherwise(seed), ignorenulls=True).over(w))
    pos, lost = F.col(seq) - (F.col("_chunk") * size + 1 - halo), F.count_if(x.isNull()).over(w)
    keep = F.lit(1.0 - alpha)
    scaled = (F.when(F.col(seq) == seed_row, seed)
              .when((F.col(seq) > seed_row) & x.isNotNull(), F.lit(alpha) * x)
              .otherwise(F.lit(0.0)) * F.pow(keep, lost - pos))
    return F.when(F.col(seq) >= seed_row, F.sum(scaled).over(w) * F.pow(keep, pos - lost))


def _affine_scan(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Maps ``_a<i> * y + _b<i>`` of the chunks of a key, in order (``_n`` counts from 1), to the value each chunk starts from, ``_c<i>``.

    Composing maps is associative, so doubling distances reach all earlier chunks of a key in logarithmically many
    passes over arrays. A key that spans batches goes on from the last value of the batch before.
    """
    carry = np.zeros(n)
    for batch in batches:
        place = batch.column("_n").to_numpy()
        at, out = np.arange(len(place)), list(batch.columns)
        if not len(at):
            continue
        begun = at - place + 1  # where the key began, negative if in an earlier batch
        for i in range(n):
            a, b = (batch.column(f"_{c}{i}").to_numpy() for c in "ab")
            step = 1
            while step < len(at):
                there = np.maximum(at - step, 0)
                ok = at - step >= np.maximum(begun, 0)
                a, b = np.where(ok, a * a[there], a), np.where(ok, a * b[there] + b, b)
                step *= 2
            end = np.where(begun < 0, a * carry[i] + b, b)
            out.append(pa.array(np.where(place == 1, 0.0, np.concatenate([carry[i:i + 1], end[:-1]]))))
            carry[i] = end[-1]
        yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *[f"_c{i}" for i in range(n)]])


def averages(df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, int, float, int]], size: int = AVERAGE_ROWS, seq: str = "row_no") -> DataFrame:
    """Averages ``y = y + alpha * (x - y)``, seeded with the plain mean of their first inputs, for any alpha and any length of history.

    ``specs`` maps an output to (source column, n, alpha, first row): the seed is the mean of rows first .. first + n - 1 and stands at
    the last of them; before it the output is NULL. Missing inputs (NULL or NaN) leave the average as it is and are left out
    of the seed; without any input for the seed there is no average, the output stays NULL.

    Over a chunk such an average is an affine map a * y + b of the value it starts from. Each chunk's map is found on its own, the maps are
    composed along the key (one summary row per chunk), and every row applies its chunk's map so far to the chunk's start. So
    no row is computed twice and nothing depends on where chunks begin. Chunks shrink where ``size`` rows would not keep the weights in range.
    """
    parts = list(enumerate(specs.items()))
    size = min([size, *(recurrence_rows(alpha) for _, _, alpha, _ in specs.values())])
    seed_row = [first + n - 1 for _, n, _, first in specs.values()]
    rows = df.withColumn("_chunk", F.floor((F.col(seq) - 1) / size)).withColumn("_g", _group(keys))
    w = Window.partitionBy("_g").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    maps, ends, seeds = {}, [], []
    for i, (_, (src, n, alpha, first)) in parts:
        x, keep = known(F.col(src).cast("double")), F.lit(1.0 - alpha)
        seeds.append(F.avg(F.when(F.col(seq).between(first, first + n - 1), x)).alias(f"_s{i}"))
        later = F.when(F.col(seq) > seed_row[i], x)
        count = F.count(later).over(w)  # inputs since the chunk's start: the exponent of its map so far
        scaled = F.last(later, ignorenulls=True).over(w) if alpha >= 1 else F.sum(later * alpha * F.pow(keep, -count)).over(w) * F.pow(keep, count)
        maps |= {f"_m{i}": count, f"_l{i}": F.coalesce(scaled, F.lit(0.0))}
        ends += [F.pow(keep, F.max(f"_m{i}")).alias(f"_a{i}"), F.max_by(f"_l{i}", seq).alias(f"_b{i}")]
    local = rows.withColumns(maps)
    summary = local.groupBy("_g").agg(*ends).withColumn("_k", F.struct(*[F.col(f"_g.{k}").alias(k) for k in keys], F.lit(0).alias("_")))
    seeded = (df.filter(F.col(seq) <= max(seed_row)).groupBy(F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_")).alias("_k")).agg(*seeds))
    summary = summary.join(seeded, "_k", "left")
    chunk = F.col("_g._chunk")
    for i, _ in parts:
        holder, a, b = (seed_row[i] - 1) // size, F.col(f"_a{i}"), F.col(f"_b{i}")
        # NaN marks a key without a seed, also in all later chunks
        seed = F.coalesce(f"_s{i}", F.lit(float("nan")))
        summary = summary.withColumns({f"_s{i}": seed, f"_a{i}": F.when(chunk > holder, a).otherwise(0.0), f"_b{i}": F.when(chunk > holder, b).when(chunk == holder, a * seed + b).otherwise(0.0)})
    summary = summary.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(chunk))).drop("_k")
    count = len(parts)
    kind = StructType([*summary.schema.fields, *[StructField(f"_c{i}", DoubleType()) for i, _ in parts]])
    starts = summary.mapInArrow(lambda batches: _affine_scan(batches, count), kind).drop("_n", *[f"_{c}{i}" for i, _ in parts for c in "ab"])
    out, values = _with(local, starts), {}
    for i, (name, (_, _, alpha, _)) in parts:
        start = F.when(F.col("_chunk") == (seed_row[i] - 1) // size, F.col(f"_s{i}")).otherwise(F.col(f"_c{i}"))
        values[name] = F.when(F.col(seq) >= seed_row[i], known(F.pow(F.lit(1.0 - alpha), F.col(f"_m{i}")) * start + F.col(f"_l{i}")))
    return out.withColumns(values).drop("_chunk", *[f"_{c}{i}" for i, _ in parts for c in "mlsc"])
