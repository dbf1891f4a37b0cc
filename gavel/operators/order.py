"""Places, running sums, quantiles and lowest rows in the order of a whole table, with no task that holds all its rows.

A table is cut into ranges first: numbers by cells that keep their order, other keys by bounds that one
range-partitioned job over the key columns alone finds. Sums of ranges are small tables; windows run inside ranges.
Bounds are literals in the plan, so every branch of it cuts the rows at the same places; of very many ranges, only those
of groups of ranges are, and the rest is a small table with one row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

Totals = dict[str, Column]
#: Bounds that are literals in a plan.
LITERALS = 256


def cell(value: str) -> Column:
    """A whole number that never falls as value rises: its sign and its logarithm in steps of 1/512, so outliers don't empty the other cells."""
    v = F.col(value).cast("double")
    size = F.floor((F.log2(F.abs(v)) + 1100) * 512) + 1
    return F.when(v == 0, F.lit(0)).otherwise((F.signum(v) * size).cast("long"))


def _literal(df: DataFrame, order: list[str], row: Row) -> Column:
    types = dict(df.dtypes)
    return F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in order])


def _bounds(df: DataFrame, order: list[str]) -> list[Row]:
    """(low, n) of about as many ranges as there are shuffle partitions, ascending; low is the least order key in the range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.select(*order).repartitionByRange(parts, *order)
    return spread.groupBy(F.spark_partition_id().alias("_r")).agg(F.min(F.struct(*order)).alias("low"), F.count("*").alias("n")).orderBy("low").collect()


def _range_of(df: DataFrame, order: list[str], lows: list[Row]) -> Column:
    """Which range a row is in, by halving."""
    key = F.struct(*order)

    def halve(a: int, b: int) -> Column:
        if b - a <= 1:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(key < _literal(df, order, lows[m]), halve(a, m)).otherwise(halve(m, b))

    return halve(0, len(lows))


def _with_range(df: DataFrame, order: list[str], lows: list[Row], starts: list[int]) -> DataFrame:
    """df with its rows' ranges, _r, and the ranges' first places, _start.

    Beyond LITERALS ranges, a row's group of ranges is found by literals, and its range among the group's bounds, which
    are joined to it: as many bounds as shuffle partitions at most, so that table is broadcast.
    """
    if len(lows) <= LITERALS:
        ranged = df.withColumn("_r", _range_of(df, order, lows))
        return ranged.withColumn("_start", F.array(*map(F.lit, starts or [0]))[F.col("_r")].cast("long"))
    width = -(-len(lows) // LITERALS)
    groups = [(k // width, lows[k : k + width], starts[k : k + width]) for k in range(0, len(lows), width)]
    fields = [StructField("_g", IntegerType()), StructField("_lows", ArrayType(df.select(*order).schema)), StructField("_starts", ArrayType(LongType()))]
    grouped = df.withColumn("_g", _range_of(df, order, lows[::width])).join(F.broadcast(df.sparkSession.createDataFrame(groups, StructType(fields))), "_g")
    inside = F.greatest(F.size(F.filter("_lows", lambda low: low <= F.struct(*order))) - 1, F.lit(0))
    ranged = grouped.withColumn("_r", inside).withColumn("_start", F.col("_starts")[F.col("_r")])
    return ranged.withColumn("_r", F.col("_g") * width + F.col("_r")).select(*df.columns, "_r", "_start")


def add_place(df: DataFrame, order: list[str], name: str = "_at") -> DataFrame:
    """Each row's place from 0 in ascending order (nulls first) of the whole table."""
    got = _bounds(df, order)
    before, total = [], 0
    for r in got:
        before.append(total)
        total += r["n"]
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(*order)) - 1
    return _with_range(df, order, [r["low"] for r in got], before).withColumn(name, F.col("_start") + inside).drop("_r", "_start")


def _marks(wanted: set[int], n: int) -> list[int]:
    """The first of n ranges and where wanted ranges begin and end: other ranges need not be told apart, so a row is compared with few bounds."""
    return sorted({0} | {j for k in wanted for j in (k, k + 1) if j < n})


def rows_at(df: DataFrame, order: list[str], places: list[int]) -> dict[int, Row]:
    """The order keys at some places (from 0) of the whole table; places beyond it are left out. Only the ranges that hold them are sorted."""
    got = _bounds(df, order)
    lows, starts, wanted, total = [r["low"] for r in got], [], {}, 0
    for k, r in enumerate(got):
        starts.append(total)
        wanted |= {(k, p - total): p for p in set(places) if total <= p < total + r["n"]}
        total += r["n"]
    if not wanted:
        return {}
    marks = _marks({k for k, _ in wanted}, len(lows))
    wanted = {(marks.index(k), p): place for (k, p), place in wanted.items()}
    ranged = _with_range(df.select(*order), order, [lows[k] for k in marks], [starts[k] for k in marks]).where(F.col("_r").isin(sorted({k for k, _ in wanted})))
    at = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_r").orderBy(*order)) - 1)
    pairs = F.array(*[F.struct(F.lit(k).alias("r"), F.lit(p).alias("p")) for k, p in sorted(wanted)])
    return {wanted[r["_r"], r["_at"]]: r for r in at.where(F.array_contains(pairs, F.struct(F.col("_r").alias("r"), F.col("_at").alias("p")))).collect()}


def below(df: DataFrame, order: list[str], row: Row) -> Column:
    """Whether a row comes before a given one."""
    return F.struct(*order) < _literal(df, order, row)


def add_sums_before(df: DataFrame, value: str, sums: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """<s>_before: the sum of s over the rows of lower value, of the same keys; df has one row for each (keys, value)."""
    celled = df.withColumn("_cell", cell(value))
    run = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy(*keys, "_cell").agg(*[F.sum(s).alias(f"_{s}_cell") for s in sums])
    cells = cells.select(*keys, "_cell", *[F.coalesce(F.sum(f"_{s}_cell").over(run), F.lit(0)).alias(f"_{s}_cell") for s in sums])
    inside = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = celled.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_cell")]
    joined = out.alias("a").join(cells.alias("b"), match)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], *[(F.col(f"a.{s}_before") + F.col(f"b._{s}_cell")).alias(f"{s}_before") for s in sums])


def quantiles(df: DataFrame, value: str, qs: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, q, edge): exact quantiles with linear interpolation. Values are counted, then cumulated by cells; nulls are left out."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    run = add_sums_before(counted, "_v", ["_n"], keys)
    total = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    places = total.withColumn("q", F.explode(F.array(*map(F.lit, qs)))).withColumn("_at", F.col("q") * (F.col("_all") - 1))
    places = places.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "q", "_at", F.floor("_at").alias("_lo"), F.ceil("_at").alias("_hi"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    holds = lambda at: (F.col("_n_before") <= F.col(at)) & (F.col(at) < F.col("_n_before") + F.col("_n"))
    cond = holds("_lo") | holds("_hi")
    for s in same:
        cond = cond & s
    found = run.join(F.broadcast(places), cond)  # one row for each key and quantile
    lo, hi = F.max(F.when(holds("_lo"), F.col("_v"))), F.max(F.when(holds("_hi"), F.col("_v")))
    at = F.first("_at")
    edge = lo + (hi - lo) * (at - F.first("_lo"))  # between equal values exactly their value, so that rows at an edge are all on one side
    return found.groupBy(*keys, "q").agg(edge.alias("edge"))


def lowest(df: DataFrame, by: Column, key: str, n: int) -> DataFrame:
    """The n rows of the lowest hash (a 64-bit number), ties by key: whole cells of hashes, and the first rows of the next one."""
    celled = df.withColumns({"_h": by, "_cell": F.shiftright(by, 48)})
    cells = celled.groupBy("_cell").agg(F.count("*").alias("_n"))  # 65,536 rows at most
    ends = cells.select("_cell", "_n", F.sum("_n").over(Window.orderBy("_cell")).alias("_end"))
    last = ends.where(F.col("_end") >= n).orderBy("_cell").first()
    if last is None:
        return df
    rest = celled.where(F.col("_cell") == last["_cell"]).orderBy("_h", key).limit(max(0, n - (last["_end"] - last["_n"])))
    return celled.where(F.col("_cell") < last["_cell"]).unionByName(rest).drop("_h", "_cell")
