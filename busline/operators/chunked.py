"""Order-dependent work on keys of any size.

A bus, a stop or a passenger may own a third of all rows. A key's history is cut into *chunks* (ranges of its order
column), rows are shuffled by (key, chunk), and what a row needs from before its chunk comes from small per-chunk
summaries, a table with one row per (key, chunk). The same is done at every size:

* :func:`carry`          running last / max / min / sum over everything before the row
* :func:`next_value`     the value of the following row
* :func:`row_halo`       each chunk preceded by the k rows before it
* :func:`range_halo`     each chunk preceded by the rows of the last ``lookback`` units
* :func:`scan`           a state machine whose effect on a chunk can be summed up: the rows are shuffled once
* :func:`paced`          greedy selection with a minimum gap (cooldowns, rate limits, streaks), by ``scan``

Building a plan starts no job, and nothing is stored: summaries read only the columns that they need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK = "_chunk"
HOUR_MS = 3_600_000
#: ``arrival`` units per millisecond in the broker's order: two bits for the topic's rank, twenty for the offset.
ARRIVAL_PER_MS = 1 << 22
#: An hour of broker arrivals, and the width for tables that number ``arrival`` by hand.
BROKER_CHUNK = HOUR_MS * ARRIVAL_PER_MS
ARRIVAL_CHUNK = 1_000_000


def with_chunk(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(order) / width).cast("long"))


@dataclass(frozen=True)
class Carry:
    """One running value: ``kind`` is last, max, min or sum; NULLs of ``expr`` are skipped."""

    kind: str
    expr: Column


def _merge(kind: str, prior: Column, local: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, prior)
    if kind == "max":
        return F.greatest(local, prior)
    if kind == "min":
        return F.least(local, prior)
    return F.coalesce(local, F.lit(0)) + F.coalesce(prior, F.lit(0))


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"max": F.max, "min": F.min, "sum": F.sum}[kind](value).over(window)


def _packed(df: DataFrame, key: list[str], order: str, width: int, more: dict[str, Column]) -> DataFrame:
    """Rows as (_g: key and chunk, order, _row, more), dealt by _g.

    The summaries and the rows themselves are both taken from this one shuffle. The other columns travel as one value that neither side
    takes apart below the shuffle, and the summaries read it (:func:`_touch`), so both sides have the same plan and the shuffle is
    reused. Key and chunk are one struct, which is never NULL: joins on it need no further shuffle and no NULL rules.
    """
    rest = [c for c in df.columns if c not in (*key, order)]
    group = F.struct(*key, F.floor(F.col(order) / width).cast("long").alias(CHUNK))
    packed = df.select(group.alias("_g"), order, F.struct(*rest, F.lit(0).alias("_")).alias("_row"), *[c.alias(n) for n, c in more.items()])
    return packed.repartition("_g")


def _touch() -> Column:
    """Reads the packed columns; NULL for no chunk that has a row."""
    return F.max(F.hash("_row")).alias("_touch")


def _by_chunk(key: list[str]):
    return Window.partitionBy(*[F.col(f"_g.{k}") for k in key])


def _unpacked(rows: DataFrame, key: list[str], order: str, more: list[Column], columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"_g.{k}").alias(k) for k in key], order, *more, F.inline(F.array("_row"))).select(*columns)


def carry(df: DataFrame, key: list[str], order: str, specs: dict[str, Carry], width: int,
          inclusive: bool = False) -> DataFrame:
    """Add one column per spec: its running value over the rows of the key before this one.

    ``order`` must be unique within the key. ``inclusive`` also counts the row itself.
    Inside a chunk this is a plain window. The value at the chunk's start is a window over the
    per-chunk summaries, joined back by chunk: the window output is already partitioned
    and sorted that way, so the join adds no shuffle of the big side, and the summaries read the same shuffle. Do not
    chain calls where one call or a ``scan`` can do: each doubles the plan.
    """
    rows = _packed(df, key, order, width, {f"_v_{n}": s.expr for n, s in specs.items()})
    local = Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = _by_chunk(key).orderBy(f"_g.{CHUNK}").rowsBetween(Window.unboundedPreceding, -1)

    summary_aggs, prior_cols, local_cols = [], [], {}
    for name, spec in specs.items():
        value = F.col(f"_v_{name}")
        if spec.kind == "last":
            agg = F.max_by(value, F.when(value.isNotNull(), F.col(order)))
        else:
            agg = {"max": F.max, "min": F.min, "sum": F.sum}[spec.kind](value)
        summary_aggs.append(agg.alias(f"_s_{name}"))
        prior_cols.append(_over(spec.kind, F.col(f"_s_{name}"), before).alias(f"_p_{name}"))
        local_cols[f"_l_{name}"] = _over(spec.kind, value, local)

    priors = rows.groupBy("_g").agg(*summary_aggs, _touch()).select("_g", "_touch", *prior_cols)
    joined = rows.withColumns(local_cols).join(priors, "_g").filter("_touch IS NOT NULL")
    out = [_merge(spec.kind, F.col(f"_p_{name}"), F.col(f"_l_{name}")).alias(name) for name, spec in specs.items()]
    return _unpacked(joined, key, order, out, [*[c for c in df.columns if c not in specs], *specs])


def next_value(df: DataFrame, key: list[str], order: str, value: str, out: str, width: int) -> DataFrame:
    """Add the ``value`` of the row that follows in the key (NULL on its last row)."""
    rows = _packed(df, key, order, width, {"_value": F.col(value)})
    after = _by_chunk(key).orderBy(F.desc(f"_g.{CHUNK}")).rowsBetween(-1, -1)
    firsts = (rows.groupBy("_g").agg(F.min_by("_value", order).alias("_first"), _touch())
              .select("_g", "_touch", F.first("_first").over(after).alias("_after")))
    in_chunk = Window.partitionBy("_g").orderBy(order)
    met = rows.withColumns({"_lead": F.lead("_value").over(in_chunk), "_edge": F.lead(order).over(in_chunk).isNull()}).join(firsts, "_g")
    following = F.when(F.col("_edge"), F.col("_after")).otherwise(F.col("_lead")).alias(out)
    return _unpacked(met.filter("_touch IS NOT NULL"), key, order, [following], [*df.columns, out])


def row_halo(df: DataFrame, key: list[str], order: str, k: int, width: int) -> DataFrame:
    """Rows plus, per (key, chunk), copies of the ``k`` rows that precede the chunk.

    Copies carry ``_halo = true``. A window over (key, _chunk) that looks back at most ``k`` rows
    is then exact for the original rows. Every chunk that exists has at least one row, so the
    last ``k`` chunks hold enough of them. The rows and the last rows of the chunks are read from one shuffle.
    """
    rows = _packed(df, key, order, width, {})
    latest = Window.partitionBy("_g").orderBy(F.desc(order))
    tails = (rows.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= k)
             .groupBy("_g").agg(F.array_sort(F.collect_list(F.struct(order, "_row")), lambda a, b: F.when(a[order] < b[order], -1).otherwise(1)).alias("_tail")))
    before = _by_chunk(key).orderBy(f"_g.{CHUNK}").rowsBetween(-k, -1)
    joined_tails = F.flatten(F.collect_list("_tail").over(before))
    halo = (tails.withColumn("_all", joined_tails)
            .withColumn("_take", F.slice("_all", F.greatest(F.lit(1), F.size("_all") - k + 1), F.lit(k)))
            .select("_g", F.inline("_take")).withColumn("_halo", F.lit(True)))
    both = rows.withColumn("_halo", F.lit(False)).unionByName(halo)
    return _unpacked(both, key, order, [F.col(f"_g.{CHUNK}").alias(CHUNK), F.col("_halo")], [*df.columns, CHUNK, "_halo"])


def range_halo(df: DataFrame, order: str, lookback: int, width: int) -> DataFrame:
    """Rows plus copies of each chunk's last ``lookback`` units in the following chunk."""
    if lookback > width:
        raise ValueError("the chunk must be at least as wide as the lookback")
    at = F.floor(F.col(order) / width).cast("long")
    near_end = F.col(order) - at * width >= width - lookback
    copies = F.when(near_end, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (df.withColumn("_copy", F.explode(copies))
            .withColumn(CHUNK, at + F.col("_copy"))
            .withColumn("_halo", F.col("_copy") == 1).drop("_copy"))


# --- state machines ----------------------------------------------------------------------------

State = tuple


def scan(rows: DataFrame, key: list[str], order: str, width: int, *, summary: str, summarise: Callable[[pa.Table], tuple],
         state: str, step: Callable[[State | None, tuple], State], added: str, apply: Callable[[pa.Table, State | None, int], list],
         tally: Callable[[pa.Table, State | None], int] | None = None) -> DataFrame:
    """``rows`` with the columns ``added`` that a state machine gives them in ``order`` within ``key``.

    ``summarise`` says what a chunk (its rows in order) does to a state, in columns ``summary``; ``step`` applies that to the
    state (columns ``state``, None before the first row); ``apply`` gives the added columns of a chunk that is entered in a
    state. ``tally`` counts something in a chunk, and ``apply`` gets the sum over all chunks before. The chunks' summaries
    stream through each key in order; the rows themselves are shuffled once, by (key, chunk), and that shuffle is
    read by each of these passes.
    """
    group = [*key, CHUNK]
    # key and chunk are also one struct, which is never NULL, for the shuffle and the joins on it
    placed = with_chunk(rows, order, width).withColumn("_g", F.struct(*group)).repartition("_g")
    head = T.StructType([placed.schema[c] for c in group])
    sums, states = (T.StructType(head.fields + T.StructType.fromDDL(x).fields) for x in (summary, state))
    more = T.StructType.fromDDL(added)
    whole = T.StructType([*rows.schema.fields, *more.fields])
    counts = T.StructType([*head.fields, T.StructField("_tally", T.LongType())])
    ends = T.StructType([*states.fields, T.StructField("_entered", T.BooleanType())])
    width_of_key, n_group = len(key), len(group)
    columns = rows.columns

    def place(table: pa.Table) -> list:
        return [table.column(c)[0].as_py() for c in group]

    def packed(made: list[list], names: T.StructType) -> pa.RecordBatch:
        schema = to_arrow_schema(names)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _groups(batches, group):
            yield packed([[*place(part), *summarise(part)] for part in _parts(table, edges)], sums)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, None
        for batch in batches:
            out = []
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != values[:width_of_key]:
                    now, at = values[:width_of_key], None
                out.append((*values[:n_group], *(at if at is not None else [None] * (len(states) - n_group)), at is not None))
                at = step(at, values[n_group:])
            if out:
                yield packed(out, ends)

    def entry(met: pa.Table) -> State | None:
        return tuple(met.column(f"_at_{c}")[0].as_py() for c in states.names[n_group:]) if met.column("_entered")[0].as_py() else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _groups(batches, group):
            yield packed([[*place(part), tally(part.select(columns), entry(part))] for part in _parts(table, edges)], counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _groups(batches, group):
            made = [apply(part.select(columns), entry(part), part.column("_base")[0].as_py() if tally else 0) for part in _parts(table, edges)]
            table = table.select(columns)
            for field, values in zip(to_arrow_schema(more), zip(*made, strict=True), strict=True):
                table = table.append_column(field, pa.chunked_array([v if isinstance(v, pa.Array) else pa.array(v, field.type) for v in values], field.type))
            yield from table.combine_chunks().to_batches()

    def in_order(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions("_g", order).drop("_g")

    def entered(states_of: DataFrame, *extra: str) -> DataFrame:
        mine = states_of.select(F.struct(*group).alias("_g"), *[F.col(c).alias(f"_at_{c}") for c in states.names[n_group:]], "_entered", *extra)
        return in_order(placed.join(mine, "_g"))

    entries = in_order(placed).mapInArrow(sum_up, sums).repartition(*key).sortWithinPartitions(*group).mapInArrow(enter, ends)
    if tally:
        counted = entered(entries).mapInArrow(count, counts)
        before = F.sum("_tally").over(Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
        both = entries.unionByName(counted, allowMissingColumns=True).groupBy(*group).agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ends.names[n_group:]], F.max("_tally").alias("_tally"))
        entries = both.withColumn("_base", F.coalesce(before, F.lit(0))).drop("_tally")
    return entered(entries, *(["_base"] if tally else [])).mapInArrow(run, whole)


def _groups(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups and the groups' edges, from rows that come group by group; a group may span batches.

    Many small groups share one table, so that a chunk of a few rows costs no call of its own between Spark and Python.
    """
    held, last = [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        fresh = np.zeros(table.num_rows, bool)
        for c in group:
            codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            fresh[1:] |= codes[1:] != codes[:-1]
        fresh[0] = last is not None and last != [table.column(c)[0].as_py() for c in group]
        last = [table.column(c)[-1].as_py() for c in group]
        edges = np.flatnonzero(fresh).tolist()
        if not edges:
            held.append(table)
            continue
        whole = pa.concat_tables([*held, table.slice(0, edges[-1])]).combine_chunks()
        shift = whole.num_rows - edges[-1]
        yield whole, [0, *[e + shift for e in edges]]
        held = [table.slice(edges[-1])]
    if held:
        whole = pa.concat_tables(held).combine_chunks()
        yield whole, [0, whole.num_rows]


def _parts(table: pa.Table, edges: list[int]) -> Iterator[pa.Table]:
    return (table.slice(a, b - a) for a, b in zip(edges, edges[1:]))


# Greedy selection: select the first value of a key, then repeatedly the first one at least ``gap`` after the last selected.
# What a chunk does to the last selected value is a step function: sorted pairs (upto, exit) meaning "if the first
# eligible value is at or before ``upto``, the chunk is left with ``exit``"; past the last step nothing is
# selected. Only values above all earlier ones of the chunk can be selected.


def _long(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64)


def _segments(reset: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows between resets, the first one (which the entry reaches) always present, be it empty."""
    edges = np.flatnonzero(reset)
    starts, stops = np.append(0, edges + 1), np.append(edges, len(reset))
    return [(int(a), int(b)) for n, (a, b) in enumerate(zip(starts, stops, strict=True)) if a < b or n == 0]


def _records(values: np.ndarray) -> np.ndarray:
    """Positions of the values above all before them."""
    if not len(values):
        return np.zeros(0, np.int64)
    top = np.maximum.accumulate(values)
    return np.flatnonzero(np.append(True, values[1:] > top[:-1]))


def _following(times: np.ndarray, gap: int, strict: bool) -> list[int]:
    return np.searchsorted(times, times + gap, side="right" if strict else "left").tolist()


def _first(times: np.ndarray, last: int | None, gap: int, strict: bool) -> int:
    return 0 if last is None else int(np.searchsorted(times, last + gap, side="right" if strict else "left"))


def _selected(values: np.ndarray, last: int | None, gap: int, strict: bool) -> list[int]:
    """Positions of the selected values of one run of rows."""
    record = _records(values)
    times = values[record]
    following, at, out = _following(times, gap, strict), _first(times, last, gap, strict), []
    while at < len(times):
        out.append(int(record[at]))
        at = following[at]
    return out


def paced(rows: DataFrame, key: list[str], order: str, gap: int, strict: bool = False, width: int = HOUR_MS,
          value: str | None = None, reset: str | None = None, ordinal: bool = False) -> DataFrame:
    """Greedy selection of rows in ``order``: ``value`` (else the order itself) at least ``gap`` after the last selected one.

    ``strict`` asks for more than the gap. A row whose boolean column ``reset`` is true is never selected and forgets what was. Adds
    ``chosen``, ``last`` (value of the last selected row before this one), ``nth`` (place of the row, from 1, among those
    that count since the last selected one, itself included) and, if asked for, ``ordinal`` (selected rows before this one).
    """
    value = value or order

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        resets = table.column(reset).to_numpy(zero_copy_only=False).astype(bool) if reset else np.zeros(table.num_rows, bool)
        return _long(table, value), resets

    def summarise(table: pa.Table) -> tuple:
        values, resets = read(table)
        runs = _segments(resets)
        (_, stop), (begin, end) = runs[0], runs[-1]
        first = values[:stop]
        record = _records(first)
        times = first[record]
        following, leave = _following(times, gap, strict), [0] * len(times)
        for n in range(len(times) - 1, -1, -1):
            leave[n] = n if following[n] == len(times) else leave[following[n]]
        leave = np.array(leave, np.int64)
        edge = np.flatnonzero(np.append(leave[1:] != leave[:-1], True)) if len(leave) else np.zeros(0, np.int64)
        steps = (times[edge].tolist(), times[leave[edge]].tolist(), (stop - record[leave[edge]]).tolist())
        if not resets.any():
            return (*steps, stop, False, None, 0)
        after = _selected(values[begin:end], None, gap, strict) if not resets[-1] else []
        return (*steps, stop, True, int(values[begin + after[-1]]) if after else None, end - begin - after[-1] if after else 0)

    def step(state: State | None, chunk: tuple) -> State:
        uptos, exits, tails, held, forgotten, left, tail = chunk
        if forgotten:
            return left, tail
        last, since = state or (None, 0)
        at = _first(np.array(uptos, np.int64), last, gap, strict) if uptos else 0
        return (exits[at], tails[at]) if at < len(uptos) else (last, since + held)

    def chosen(table: pa.Table, state: State | None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], list[int]]:
        values, resets = read(table)
        runs, picked = _segments(resets), []
        for n, (begin, end) in enumerate(runs):
            last = state[0] if state and n == 0 else None
            picked += [begin + x for x in _selected(values[begin:end], last, gap, strict)]
        return values, resets, runs, picked

    def apply(table: pa.Table, state: State | None, base: int) -> list:
        values, resets, runs, picked = chosen(table, state)
        place = np.arange(len(values))
        taken = np.zeros(len(values), bool)
        taken[picked] = True
        spots = np.array(picked, np.int64)
        run_of = np.cumsum(resets)

        def latest(side: str) -> tuple[np.ndarray, np.ndarray]:
            """(index into ``picked`` of the last selected row up to each row, whether it is in the row's own run)."""
            n = np.searchsorted(spots, place, side=side) - 1
            own = n >= 0
            own[own] = run_of[spots[n[own]]] == run_of[place[own]]
            return n, own

        n, own = latest("left")
        entered = (run_of == 0) & ~own & (not (state is None or state[0] is None))
        last = np.where(own, values[spots[np.maximum(n, 0)]] if len(spots) else 0, state[0] if entered.any() else 0)
        m, held = latest("right")
        since = np.where(held, place - (spots[np.maximum(m, 0)] if len(spots) else 0) + 1, place + 1 + (state[1] if state else 0))
        counted = (held | ((run_of == 0) & (not (state is None or state[0] is None)))) & ~resets
        out = [taken, pa.array(last, pa.int64(), mask=~(own | entered) | resets), pa.array(since, pa.int64(), mask=~counted)]
        return [*out, base + np.searchsorted(spots, place)] if ordinal else out

    added = "chosen boolean, last long, nth long" + (", ordinal long" if ordinal else "")
    return scan(rows, key, order, width, summary="uptos array<long>, exits array<long>, tails array<long>, held long, forgotten boolean, left long, tail long",
                summarise=summarise, state="last long, tail long", step=step, added=added, apply=apply,
                tally=(lambda table, state: len(chosen(table, state)[3])) if ordinal else None)


def spaced(df: DataFrame, key: list[str], time: str, gap: int, strict: bool = False, width: int = HOUR_MS) -> DataFrame:
    """Distinct (key, time) points chosen greedily at least ``gap`` apart (``strict``: more than)."""
    points = df.select(*key, F.col(time).cast("long").alias(time)).distinct()
    return paced(points, key, time, gap, strict, width).filter("chosen").select(*key, time)
