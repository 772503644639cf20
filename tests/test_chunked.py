"""The chunked primitives against brute force, with chunks small enough to cross many borders."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from busline.operators import chunked, context, validate
from busline.operators.chunked import Carry, carry, next_value, paced, range_halo, row_halo, spaced
from busline.sources import readers


#: A width that puts all rows of a key in one chunk.
WHOLE = 1 << 60


def table(spark, seed=1, n=400, keys=3, spread=2000):
    rng = random.Random(seed)
    rows = []
    for key in range(keys):
        # key 0 holds most rows, as a hot bus would
        for t in sorted(rng.sample(range(spread), n if key == 0 else 20)):
            rows.append((f"k{key}", t, rng.choice([None, rng.randint(0, 99)])))
    return spark.createDataFrame(rows, "k string, t long, v long")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_carry_equals_unbounded_window(spark):
    df = table(spark)
    whole = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "t", F.last("v", True).over(whole).alias("l"), F.max("v").over(whole).alias("m"),
                     F.min("v").over(whole).alias("n"), F.coalesce(F.sum("v").over(whole), F.lit(0)).alias("s"))
    got = carry(df, ["k"], "t", {"l": Carry("last", F.col("v")), "m": Carry("max", F.col("v")),
                                 "n": Carry("min", F.col("v")), "s": Carry("sum", F.col("v"))}, 37)
    assert rows_of(got.select("k", "t", "l", "m", "n", "s")) == rows_of(want)


def test_next_value_equals_lead(spark):
    df = table(spark, 2)
    want = df.select("k", "t", F.lead("t").over(Window.partitionBy("k").orderBy("t")).alias("nx"))
    got = next_value(df, ["k"], "t", "t", "nx", 50).select("k", "t", "nx")
    assert rows_of(got) == rows_of(want)


def test_row_halo_gives_exact_row_windows(spark):
    df = table(spark, 3, n=120)
    back = Window.partitionBy("k").orderBy("t").rowsBetween(-9, 0)
    want = df.select("k", "t", F.count("*").over(back).alias("c"), F.min("t").over(back).alias("first"))
    part = Window.partitionBy("k", "_chunk").orderBy("t").rowsBetween(-9, 0)
    got = (row_halo(df, ["k"], "t", 9, 30)
           .select("k", "t", "_halo", F.count("*").over(part).alias("c"), F.min("t").over(part).alias("first"))
           .filter("not _halo").drop("_halo"))
    assert rows_of(got) == rows_of(want)


def test_range_halo_gives_exact_range_windows(spark):
    df = table(spark, 4)
    back = Window.partitionBy("k").orderBy("t").rangeBetween(-25, 0)
    part = Window.partitionBy("k", "_chunk").orderBy("t").rangeBetween(-25, 0)
    want = df.select("k", "t", F.count("*").over(back).alias("c"))
    got = (range_halo(df, "t", 25, 60).select("k", "t", "_halo", F.count("*").over(part).alias("c"))
           .filter("not _halo").drop("_halo"))
    assert rows_of(got) == rows_of(want)


def greedy(times, gap, strict):
    chosen = []
    for t in sorted(set(times)):
        if not chosen or (t - chosen[-1] > gap if strict else t - chosen[-1] >= gap):
            chosen.append(t)
    return chosen


def test_spaced_equals_greedy_scan(spark):
    for seed, gap, strict, width in [(5, 7, False, 40), (6, 7, True, 25), (7, 30, False, 35), (7, 30, False, WHOLE)]:
        df = table(spark, seed)
        data = {}
        for r in df.collect():
            data.setdefault(r.k, []).append(r.t)
        want = sorted((k, t) for k, ts in data.items() for t in greedy(ts, gap, strict))
        assert rows_of(spaced(df, ["k"], "t", gap, strict, width)) == want


def paced_rows(rows, gap, strict):
    """(key, order, chosen, last, nth, ordinal) of ``paced`` by a plain loop."""
    out, state = [], {}
    for k, at, v, reset in sorted(rows, key=lambda r: (r[0], r[1])):
        last, nth, ordinal = state.get(k, (None, None, 0))
        if reset:
            out.append((k, at, False, None, None, ordinal))
            state[k] = (None, None, ordinal)
            continue
        chosen = last is None or (v - last > gap if strict else v - last >= gap)
        out.append((k, at, chosen, last, 1 if chosen else nth + 1, ordinal))
        state[k] = (v, 1, ordinal + 1) if chosen else (last, nth + 1, ordinal)
    return sorted(out, key=str)


def test_paced_equals_a_plain_loop(spark):
    """Values that run ahead of and behind their order, resets, and chunks that select nothing."""
    for seed, gap, strict, width in [(1, 7, False, 9), (2, 7, True, 30), (3, 1, False, 4), (4, 60, True, 25), (5, 40, False, 10), (6, 7, False, WHOLE)]:
        rng = random.Random(seed)
        rows = []
        for k, n in (("hot", 300), ("b", 12), ("c", 1), (None, 30)):
            for at in rng.sample(range(600), n):
                rows.append((k, at, at + rng.choice([0, 0, 0, -20, 35, 3]), rng.random() < 0.1))
        df = spark.createDataFrame(rows, "k string, at long, v long, off boolean")
        got = paced(df, ["k"], "at", gap, strict, width, value="v", reset="off", ordinal=True).select("k", "at", "chosen", "last", "nth", "ordinal")
        named = [(k or "", *r) for k, *r in rows]
        want = [(k or None, *r) for k, *r in paced_rows(named, gap, strict)]
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
        plain = paced(df, ["k"], "at", gap, strict, width).select("k", "at", "chosen", "last", "nth")
        want = [(k or None, *r[:-1]) for k, *r in paced_rows([(k, at, at, False) for k, at, *_ in named], gap, strict)]
        assert sorted((tuple(r) for r in plain.collect()), key=str) == sorted(want, key=str)
    assert paced(df.limit(0), ["k"], "at", 5).count() == 0


def test_scan_shuffles_its_rows_once(spark):
    df = table(spark, 9).withColumn("wide", F.lit("x"))
    out = paced(df, ["k"], "t", 7, width=40, ordinal=True)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the pass over the summaries is the one exchange by key alone
    full = [line for line in plan.splitlines() if " Exchange hashpartitioning(k#" in line and "_chunk#" in line and "ENSURE" in line]
    assert plan.count("ReusedExchange") + plan.count("Reused") >= 1 and full


def test_broker_arrivals_of_a_hot_key_share_chunks(spark, monkeypatch):
    """Three hours of one bus, a message each four seconds: a summary for each hour, not for each message."""
    records = spark.range(2700).select(F.lit("b").alias("key"), F.lit("{}").alias("value"), F.col("id").alias("offset"),
                                       F.timestamp_millis(F.lit(1_700_000_000_000) + 4000 * F.col("id")).alias("timestamp"))
    rows = readers.from_broker(records, "telemetry").select(
        F.col("key").alias("bus_id"), "arrival", (F.unix_millis("received_at") - 9000 * F.pmod(F.col("arrival"), F.lit(2))).alias("t"),
        F.lit("r").alias("trip_id"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    seen, real = [], chunked.with_chunk

    def counted(df, order, width):
        out = real(df, order, width)
        if order == "arrival":
            seen.append(out.select("bus_id", "_chunk").distinct().count())
        return out

    monkeypatch.setattr(chunked, "with_chunk", counted)
    assert rows_of(context.strictly_newer(rows)) == rows_of(context.strictly_newer(rows, WHOLE))
    verdicts = validate.stateful_ingest(rows).select("arrival", "verdict")
    assert rows_of(verdicts) == rows_of(validate.stateful_ingest(rows, width=WHOLE).select("arrival", "verdict"))
    assert seen and max(seen) <= 4


def test_many_small_groups_share_one_call(spark):
    """A call between Spark and Python for every key and chunk took most of the time of the ingest rules."""
    rows = [(None if i % 50 == 0 else f"k{i % 50}", i * 7 % 1009) for i in range(1009)] + [("big", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long").dropDuplicates()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        out = paced(df, ["k"], "t", 9, width=250, ordinal=True)
        got = {(r.k, r.t): (r.chosen, r.ordinal) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = {}, {}
    for k, t in sorted(set(rows), key=lambda r: (str(r[0]), r[1])):
        at, n = last.get(k, (None, 0))
        chosen = at is None or t - at >= 9
        want[k, t] = (chosen, n)
        if chosen:
            last[k] = (t, n + 1)
    assert got == want
    assert "GroupsInArrow" not in out._jdf.queryExecution().executedPlan().toString()
