"""Exact quantiles, head sums and ordered splits without sorting a table in one task.

A rank over a whole table would need one global sort window. The operators here need only the
rows around the wanted rank. Values are counted in monotone bins (a few thousand per octave, combined
on the map side); a running sum over the bins, whose number does not grow with the rows, tells which
bin holds the rank; only that bin's distinct values are then counted and walked, cut by cut. Every step is
exact, ties included, and a value shared by a third of the rows is one counted value.

Orders of any type (text ids, several columns) are cut by ``repartitionByRange`` instead, stored once with the
number of the range, so that positions follow from one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

BINS_PER_OCTAVE = 4096
_OCTAVES = 1100
#: Even cuts of the values of one bin; numbers far from zero may all share a bin.
CUTS = 4096


def value_bin(value: Column) -> Column:
    """Bin number that never decreases as the value grows (any finite number)."""
    v = value.cast("double")

    def magnitude(x: Column) -> Column:
        return F.floor(F.log2(x) * BINS_PER_OCTAVE) + _OCTAVES * BINS_PER_OCTAVE

    zero = F.lit(0).cast("bigint")
    return F.when(v > 0, magnitude(v)).when(v < 0, -magnitude(-v)).otherwise(zero)


def finite(value: Column) -> Column:
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def running_counts(counted: DataFrame, keys: list[str], value: str, down: bool = False) -> DataFrame:
    """``counted`` (one row per keys and value, with ``_c``) with ``_run``: the counts up to and with the value.

    The span of the values of a key is cut evenly and summed per cut first, so one task walks one cut only. The counts
    are used for the span, the sums and the walk, so they are stored once.
    """
    counted = materialize(counted, "counted")
    v = F.col(value).cast("double")
    edges = counted.groupBy(*keys).agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    place = F.when(F.col("_high") > F.col("_low"), F.floor((v - F.col("_low")) / (F.col("_high") - F.col("_low")) * CUTS)).otherwise(F.lit(0))
    placed = counted.join(edges, keys).withColumn("_cut", place.cast("bigint"))

    def direction(name: str) -> Column:
        return F.col(name).desc() if down else F.col(name).asc()

    before = W.partitionBy(*keys).orderBy(direction("_cut")).rowsBetween(W.unboundedPreceding, -1)
    cuts = placed.groupBy(*keys, "_cut").agg(F.sum("_c").alias("_w"))
    cuts = cuts.select(*keys, "_cut", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_cut").orderBy(direction(value)).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = F.col("_start") + F.sum("_c").over(inside)
    return placed.join(cuts, [*keys, "_cut"]).withColumn("_run", run).drop("_low", "_high", "_cut", "_start")


def ranged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` stored with ``_part``: all rows of a smaller part come before those of a larger one."""
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the position of every row from 1 in a total order; no task sees more than one range."""
    placed = ranged(df, order, "numbered")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    starts = sizes.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return placed.join(starts, "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_start")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per key: ``keys..., n, q`` with ``q`` in the order of ``probs``.

    Meant for a small number of keys (columns of a table, calendar periods). The join side that
    names the bins to look into has at most ``2 * len(probs)`` rows per key; Spark broadcasts it by its size.
    """
    rows = df.filter(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_bin", value_bin(F.col("_v")))
    per_key = W.partitionBy(*keys)
    running = per_key.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    bins = bins.withColumns({"_to": F.sum("_c").over(running), "n": F.sum("_c").over(per_key)})

    def ranks(p: float) -> tuple[Column, Column, Column]:
        position = (F.col("n") - 1) * F.lit(float(p))
        low = F.floor(position)
        return low, F.ceil(position), position - low

    def holds(rank: Column, first: Column, last: Column) -> Column:
        return (rank >= first) & (rank < last)

    wanted = F.lit(False)
    for p in probs:
        low, high, _ = ranks(p)
        first = F.col("_to") - F.col("_c")
        wanted = wanted | holds(low, first, F.col("_to")) | holds(high, first, F.col("_to"))
    targets = bins.filter(wanted).select(*keys, "_bin", (F.col("_to") - F.col("_c")).alias("_before"), "n")

    near = rows.join(targets, [*keys, "_bin"])
    counted = near.groupBy(*keys, "_bin", "_before", "n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    counted = running_counts(counted, [*keys, "_bin"], "_v").withColumn("_to", F.col("_before") + F.col("_run"))
    counted = counted.withColumn("_from", F.col("_to") - F.col("_c"))
    picks = []
    for i, p in enumerate(probs):
        low, high, _ = ranks(p)
        picks.append(F.max(F.when(holds(low, F.col("_from"), F.col("_to")), F.col("_v"))).alias(f"_l{i}"))
        picks.append(F.max(F.when(holds(high, F.col("_from"), F.col("_to")), F.col("_v"))).alias(f"_h{i}"))
    found = counted.groupBy(*keys, "n").agg(*picks)
    values = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * ranks(p)[2] for i, p in enumerate(probs)]
    return found.select(*keys, "n", F.array(*values).alias("q"))


def unpivot(df: DataFrame, columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """Long form of numeric columns: one row per (column, value)."""
    return df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])).alias("_e")
    ).select("_e.*")


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    return exact_quantiles(unpivot(df, columns), ["column"], "value", probs)


def head_sums(df: DataFrame, value: str, heads: dict[str, Column]) -> DataFrame:
    """Sums of the k largest values for several k, next to the overall count and sum.

    ``heads`` maps a result name to k, an expression over the column ``n`` (row count). The result
    has one row: n, total and, per head, ``<name>_k`` and ``<name>_sum``.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v")).withColumn("_bin", value_bin(F.col("_v")))
    everything = W.partitionBy(F.lit(0))
    running = everything.orderBy(F.col("_bin").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = rows.groupBy("_bin").agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"))
    bins = bins.withColumns(
        {
            "_to": F.sum("_c").over(running),
            "_sum_to": F.sum("_s").over(running),
            "n": F.sum("_c").over(everything),
            "total": F.sum("_s").over(everything),
        }
    )
    long = bins.select(
        "*",
        F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.least(k.cast("bigint"), F.col("n")).alias("k")) for h, k in heads.items()])).alias("_h"),
    ).select("*", "_h.head", "_h.k")
    first = F.col("_to") - F.col("_c")
    cut = long.filter((F.col("k") > first) & (F.col("k") <= F.col("_to"))).select(
        "head", "k", "_bin", "n", "total", first.alias("_before"), (F.col("_sum_to") - F.col("_s")).alias("_sum_before")
    )
    # One row per head: bounded by the number of heads asked for.
    near = rows.join(F.broadcast(cut), "_bin")
    by_head = ["head", "k", "n", "total", "_before", "_sum_before"]
    counted = near.groupBy(*by_head, "_v").agg(F.count(F.lit(1)).alias("_c"))
    counted = running_counts(counted, ["head"], "_v", down=True)
    counted = counted.withColumn("_rest", F.col("k") - F.col("_before") - F.col("_run") + F.col("_c"))
    taken = F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_rest")))
    solved = counted.groupBy(*by_head).agg(F.sum(F.col("_v") * taken).alias("_part"))
    solved = solved.withColumn("s", F.col("_sum_before") + F.col("_part"))
    columns = []
    for h in heads:
        here = F.col("head") == h
        columns += [F.max(F.when(here, F.col("k"))).alias(f"{h}_k"), F.max(F.when(here, F.col("s"))).alias(f"{h}_sum")]
    return solved.groupBy("n", "total").agg(*columns)


def half_split(df: DataFrame, moment: str, tie: str, value: str) -> DataFrame:
    """Sums of the first ``n // 2`` rows and of the rest, in the order (day of moment, tie, value).

    Days are summed first and walked by a running total (their number is bounded by the calendar).
    Only the boundary day is looked into: its distinct (tie, value) are cut into ranges, so ties may be of any
    type that has an order, and only the boundary range is walked. NULL ties come first in their day.
    """
    rows = df.filter(F.col(moment).isNotNull()).select(
        F.to_date(moment).alias("_d"), F.col(tie).alias("_t"), F.coalesce(F.col(value), F.lit(0)).alias("_v")
    )
    everything = W.partitionBy(F.lit(0))

    def cumulate(grouped: DataFrame, by: str) -> DataFrame:
        running = everything.orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
        return grouped.withColumns({"_to": F.sum("_c").over(running), "_sum_to": F.sum("_s").over(running)})

    def cut(frame: DataFrame, by: str, need: Column, extra: list[str]) -> Column:
        fields = F.struct(
            F.col(by).alias("at"), (F.col("_to") - F.col("_c")).alias("before"), (F.col("_sum_to") - F.col("_s")).alias("sum"), *extra
        )
        return frame.filter(F.col("_to") >= need).agg(F.min_by(fields, F.col(by)).alias("cut")).scalar()

    # Each cut is one row. It joins a frame as one scalar column, so its plan appears only where needed.
    days = cumulate(rows.groupBy("_d").agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s")), "_d")
    days = days.withColumns({"_n": F.sum("_c").over(everything), "_all": F.sum("_s").over(everything)})
    days = days.withColumn("_half", F.floor(F.col("_n") / 2))
    found = rows.sparkSession.range(1).select(cut(days, "_d", F.col("_half"), ["_n", "_all", "_half"]).alias("_day"))
    d = materialize(found, "half-split-day").scalar()
    day = rows.filter(F.col("_d") == d["at"]).groupBy("_t", "_v").agg(F.count(F.lit(1)).alias("_c"))
    day = ranged(day, [F.col("_t"), F.col("_v")], "half-split")
    parts = day.groupBy("_part").agg(F.sum("_c").alias("_c"), F.sum(F.col("_v") * F.col("_c")).alias("_s"))
    parts = cumulate(parts, "_part").withColumn("_day", d)
    need = F.col("_day._half") - F.col("_day.before")
    b = cut(parts.withColumn("_need", need), "_part", need, ["_need", "_day"])
    walk = everything.orderBy("_t", "_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = day.filter(F.col("_part") == b["at"]).withColumn("_bin", b)
    last = last.withColumn("_rest", F.col("_bin._need") - F.col("_bin.before") - F.sum("_c").over(walk) + F.col("_c"))
    taken = F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_rest")))
    part = last.agg(F.sum(F.col("_v") * taken).alias("_part"), F.first("_bin").alias("_bin"))
    part = part.filter(F.col("_bin").isNotNull())
    first = F.col("_bin._day.sum") + F.col("_bin.sum") + F.col("_part")
    return part.select(
        F.col("_bin._day._n").alias("rows"),
        F.col("_bin._day._half").alias("first_rows"),
        first.alias("first_sum"),
        (F.col("_bin._day._all") - first).alias("second_sum"),
    )
