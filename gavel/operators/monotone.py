"""Monotone maps of scores (M11-M16), fitted and applied by ranges, with no task that holds all scores or blocks.

Fitting pools adjacent violators. Each range of scores pools its own; then groups of `FAN` neighbouring ranges are
merged, level by level. A level moves only the blocks that a border may still change: those whose mean is not below
every later range's first block and above every earlier range's last one. Blocks between two such have means between
theirs, so what is left out can't be in the way. Several maps (one for each value of `keys`) are fitted in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.sources.logs import kept

#: Neighbouring ranges that a level merges.
FAN = 16


class Stack:
    """Blocks (lo, hi, sum, weight) of rising means; a pushed one pools with those before it while they are not lower."""

    def __init__(self) -> None:
        self.blocks: list[tuple[float, float, float, float]] = []

    def push(self, lo: float, hi: float, s: float, w: float) -> None:
        while self.blocks and self.blocks[-1][2] * w >= s * self.blocks[-1][3]:
            a, _, t, v = self.blocks.pop()
            lo, s, w = a, s + t, w + v
        self.blocks.append((lo, hi, s, w))


def _frame(key: tuple, keys: list[str], found: Stack, r: int) -> pd.DataFrame:
    out = pd.DataFrame(found.blocks, columns=["lo", "hi", "s", "w"]).assign(r=r)
    for c, v in zip(keys, key, strict=True):
        out[c] = v
    return out


def blocks(cells: DataFrame, keys: list[str], parts: int | None = None, fan: int = FAN) -> DataFrame:
    """(keys, lo, hi, s, w): the blocks of the monotone fits of cells (keys, x, s: weighted sum, w: weight)."""
    parts = parts or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(cells.dtypes)
    schema = "".join(f"{c} {kinds[c]}, " for c in keys) + "lo double, hi double, s double, w double, r int"
    names = [*keys, "lo", "hi", "s", "w", "r"]

    def pool_range(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        r, last, held = TaskContext.get().partitionId(), None, Stack()
        for pdf in frames:
            for key, part in pdf.groupby(keys, sort=False) if keys else [((), pdf)]:
                if last is not None and key != last:
                    yield _frame(last, keys, held, r)[names]
                    held = Stack()
                last = key
                for row in part[["x", "x", "s", "w"]].itertuples(index=False, name=None):
                    held.push(*row)
        if last is not None:
            yield _frame(last, keys, held, r)[names]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        held = Stack()
        for row in pdf.sort_values("lo")[["lo", "hi", "s", "w"]].itertuples(index=False, name=None):
            held.push(*row)
        return _frame(tuple(pdf[c].iloc[0] for c in keys), keys, held, int(pdf["r"].min()))[names]

    used = cells.where((F.col("w") > 0) & F.col("x").isNotNull() & ~F.isnan("x")).select(*keys, F.col("x").cast("double").alias("x"), F.col("s").cast("double").alias("s"), F.col("w").cast("double").alias("w"))
    held = kept(used.repartitionByRange(parts, *keys, "x").sortWithinPartitions(*keys, "x").mapInPandas(pool_range, schema), "blocks")
    span, mean = 1, F.col("s") / F.col("w")
    while span < parts:
        group, side = F.floor(F.col("r") / (span * fan)), F.floor(F.col("r") / span) % fan
        here = held.withColumns({"_g": group, "_side": side, "_m": mean})
        ends = here.groupBy(*keys, "_g", "_side").agg(F.min("_m").alias("lowest"), F.max("_m").alias("highest"))
        ends = ends.groupBy(*keys, "_g").agg(F.collect_list(F.struct("_side", "lowest", "highest")).alias("_ends")).where(F.size("_ends") > 1)  # at most `fan`
        met = here.join(ends, [*keys, "_g"], "left")
        later = F.array_min(F.transform(F.filter("_ends", lambda e: e["_side"] > F.col("_side")), lambda e: e["lowest"]))
        earlier = F.array_max(F.transform(F.filter("_ends", lambda e: e["_side"] < F.col("_side")), lambda e: e["highest"]))
        met = kept(met.withColumn("_open", F.coalesce(F.col("_m") >= later, F.lit(False)) | F.coalesce(F.col("_m") <= earlier, F.lit(False))).select(*names, "_g", "_open"), "blocks")
        merged = met.where("_open").groupBy(*keys, "_g").applyInPandas(lambda pdf: merge(pdf), schema)
        held, span = kept(met.where("not _open").select(*names).unionByName(merged), "blocks"), span * fan
    return held.drop("r")


def values(points: DataFrame, fitted: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """(keys, x, g): the maps of fitted (see `blocks`) at the distinct scores of points (keys, x): linear between blocks, and the nearest block's value outside them.

    Block ends and scores are ordered by ranges; a range takes the ends next to it from a table of one row for each range and map.
    """
    parts = parts or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col("s") / F.col("w")
    ends = fitted.select(*keys, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), value.alias("v"))
    asked = points.where(F.col("x").isNotNull() & ~F.isnan("x")).select(*keys, F.col("x").cast("double").alias("x"), F.lit(None).cast("double").alias("v")).distinct()
    both = ends.unionByName(asked).repartitionByRange(parts, *keys, "x")
    both = kept(both.select("*", F.spark_partition_id().alias("_r"), F.when(F.col("v").isNotNull(), F.struct("x", "v")).alias("_end")), "scores")
    order = Window.partitionBy(*keys, "_r").orderBy("x", F.col("v").isNull())
    low = F.last("_end", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("_end", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    ranges = both.groupBy(*keys, "_r").agg(F.min("_end").alias("a"), F.max("_end").alias("z"))
    beside = Window.partitionBy(*keys).orderBy("_r")
    ranges = ranges.select(*keys, "_r", F.last("z", True).over(beside.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("a", True).over(beside.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    out = both.select("*", low.alias("_low"), high.alias("_high")).where("v is null").join(ranges, [*keys, "_r"])
    lo, hi = F.coalesce("_low", "_before"), F.coalesce("_high", "_after")
    inside = lo["v"] + (hi["v"] - lo["v"]) * (F.col("x") - lo["x"]) / (hi["x"] - lo["x"])
    g = F.when(lo.isNull(), hi["v"]).when(hi.isNull() | (lo["x"] == F.col("x")), lo["v"]).when(hi["x"] == F.col("x"), hi["v"]).otherwise(inside)
    return out.select(*keys, "x", g.alias("g"))


def mapped(df: DataFrame, p: str, fitted: DataFrame, keys: list[str], out: str) -> DataFrame:
    """df with `out`, the value of its own map (by its columns `keys`) at its score p; null without a score or a map."""
    got = kept(values(df.select(*keys, F.col(p).alias("x")), fitted, keys), "maps")
    names = {c: f"_k_{c}" for c in keys}
    found = got.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("x").alias("_at_x"), F.col("g").alias(out))
    same: Column = F.col(p) == F.col("_at_x")
    for c, n in names.items():
        same = same & (F.col(c) == F.col(n))
    return df.join(found, same, "left").drop("_at_x", *names.values())
