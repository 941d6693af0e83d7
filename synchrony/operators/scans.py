"""Running values along the order of a recording, without a recording in one task.

The order is cut into buckets. Each bucket is summed up to one row (its last value, its first, its least, its sum), these rows are
carried on over the buckets of a recording, and every row takes what is carried to its bucket if its own bucket has
nothing before it. Rows meet in windows of a bucket only; the window over a recording sees a row per bucket. What follows
a row is what comes before it in the reversed order: a frame up to the end of a window is worked out anew for every row,
which is the square of the bucket's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import large

#: Places of an order by number, and seconds of one by time, that make up a bucket.
PLACES, SECONDS = 4096, 1024.0


def previous(value: Column, current: bool = False) -> tuple[str, Column, bool]:
    """The last value that is not null before the row, or up to it."""
    return "previous", value, current


def following(value: Column, current: bool = False) -> tuple[str, Column, bool]:
    """The first value that is not null after the row, or from it on."""
    return "following", value, current


def sum_before(value: Column, current: bool = False) -> tuple[str, Column, bool]:
    """The sum of the rows before, or up to the row; 0 if there is none."""
    return "sum", value, current


def sum_of_all(value: Column) -> tuple[str, Column, bool]:
    """The sum of all rows inside the keys."""
    return "all", value, True


def least_before(value: Column, current: bool = False) -> tuple[str, Column, bool]:
    """The least value of the rows before, or up to the row; nulls left out."""
    return "least_before", value, current


def least_after(value: Column, current: bool = False) -> tuple[str, Column, bool]:
    """The least value of the rows after, or from the row on; nulls left out."""
    return "least_after", value, current


def scan(rows: DataFrame, bucket: Column, order: list[Column], keys: tuple[str, ...] = ("video_id",), **asked: tuple[str, Column, bool]) -> DataFrame:
    """+ a column for each thing asked for. ``order`` ascends, is total inside the keys, and ``bucket`` ascends with it."""
    own, carried = {n: f"{n}_own__" for n in asked}, {n: f"{n}_carried__" for n in asked}
    rows = rows.withColumn("bucket__", bucket).withColumns({own[n]: v for n, (_, v, _) in asked.items()})
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])

    def total(kind: str, column: str) -> Column:
        here = F.when(F.col(column).isNotNull(), place)
        if kind.startswith("least"):
            return F.min(column)
        return F.sum(column) if kind in ("sum", "all") else F.max_by(column, here) if kind == "previous" else F.min_by(column, here)

    up = Window.partitionBy(*keys).orderBy("bucket__")
    down = Window.partitionBy(*keys).orderBy(F.desc("bucket__"))
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (up, down))

    def carry(kind: str, column: str) -> Column:
        if kind.startswith("least"):
            return F.min(column).over(before if kind == "least_before" else after)
        if kind == "all":
            return F.sum(column).over(Window.partitionBy(*keys))
        return F.sum(column).over(before) if kind == "sum" else F.last(column, True).over(before if kind == "previous" else after)

    per = rows.groupBy(*keys, "bucket__").agg(*[total(k, own[n]).alias(n) for n, (k, _, _) in asked.items()])
    named = {k: f"{k}_key__" for k in (*keys, "bucket__")}
    per = per.select(*[F.col(k).alias(v) for k, v in named.items()], *[carry(k, n).alias(carried[n]) for n, (k, _, _) in asked.items()])
    met = rows.join(large(per), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()]))
    inside = Window.partitionBy(*keys, "bucket__")
    forth, reverse = inside.orderBy(*order), inside.orderBy(*[c.desc() for c in order])

    def value(name: str, kind: str, current: bool) -> Column:
        back, on = (w.rowsBetween(Window.unboundedPreceding, 0 if current else -1) for w in (forth, reverse))
        if kind == "all":
            return F.col(carried[name])
        if kind == "sum":
            return F.coalesce(F.sum(own[name]).over(back), F.lit(0)) + F.coalesce(carried[name], F.lit(0))
        if kind.startswith("least"):
            return F.least(F.min(own[name]).over(back if kind == "least_before" else on), carried[name])
        return F.coalesce(F.last(own[name], True).over(back if kind == "previous" else on), F.col(carried[name]))

    out = met.withColumns({n: value(n, k, c) for n, (k, _, c) in asked.items()})
    return out.drop("bucket__", *own.values(), *carried.values(), *named.values())


def quantiles(rows: DataFrame, keys: list[str], **asked: tuple[Column, float]) -> DataFrame:
    """keys and one column for each quantile asked for (a value and a share), exact and interpolated as ``percentile`` does,
    nulls left out. Values are counted first and summed up along their order by a scan, so no task holds a group's
    values; groups without a value are not there."""
    items = F.array(*[F.struct(F.lit(i).alias("which"), value.cast("double").alias("x")) for i, (value, _) in enumerate(asked.values())])
    counts = rows.select(*keys, F.explode(items).alias("i")).select(*keys, "i.*").where("x is not null").groupBy(*keys, "which", "x").agg(F.count(F.lit(1)).alias("n"))
    met = scan(counts, F.floor("x"), [F.col("x")], (*keys, "which"), upto=sum_before(F.col("n"), current=True), total=sum_of_all(F.col("n")))
    out = []
    for i, (name, (_, share)) in enumerate(asked.items()):
        place = share * (F.col("total") - 1)
        low, high = (F.min(F.when((F.col("which") == i) & (F.col("upto") > at), F.col("x"))) for at in (F.floor(place), F.ceil(place)))
        part = F.max(F.when(F.col("which") == i, place - F.floor(place)))
        out.append(F.when(part > 0, (1 - part) * low + part * high).otherwise(low).alias(name))
    return met.groupBy(*keys).agg(*out)
