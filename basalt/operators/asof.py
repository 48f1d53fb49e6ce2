"""As-of joins and point-in-interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.columns import first_by, valid_at


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: dict[str, str], inner: bool = False) -> DataFrame:
    """``left`` with, from the last row of ``right`` strictly before its time, the columns ``take`` (name there: name here).

    Both sides are put into one stream per key, ordered by time with left rows
    first among equal times, and the last right row is carried along: one
    shuffle, linear in both sides, however many rows a key has on the right.
    """
    names = left.columns
    l_rows = left.select(*by, F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*names).alias("_left"))
    r_rows = right.select(*by, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(a).alias(b) for a, b in take.items()]).alias("_right"))
    rows = l_rows.unionByName(r_rows, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_t"), "_side").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter("_side = 0")
    if inner:
        out = out.filter("_found is not null")
    return out.select("_left.*", "_found.*") if take else out.select("_left.*")


def interval_join(facts: DataFrame, ranges: DataFrame, keys: list[str], day: str, row_key: list[str], latest: bool = True) -> DataFrame:
    """``facts`` left-joined with the range of ``ranges`` (keys, valid_from, valid_to) that contains ``day``.

    With ``latest``, of several ranges the one that begins last is taken for
    each ``row_key``. An equi-join on the keys with the interval as a residual;
    facts without a range keep nulls.
    """
    r = ranges.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    cond = valid_at(day, "valid_from", "valid_to")
    for c in on:
        cond = c & cond
    out = facts.join(r, cond, "left").drop(*[f"_{k}" for k in keys])
    return first_by(out, row_key, F.desc_nulls_last("valid_from")) if latest else out
