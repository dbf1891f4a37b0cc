"""Exploration of the bid funnel (E) and of user tags (U)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.columns import guarded
from gavel.operators.order import add_place, add_sums_before
from gavel.sources.logs import kept


def funnel(df: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates of each group; rates of an empty denominator have it at 1."""
    sums = df.groupBy(*keys).agg(F.count("*").alias("n_bids"), F.sum("win").alias("n_wins"), F.sum("click").alias("n_clicks"), F.sum("conversion").alias("n_conversions"), F.avg("bidprice").alias("mean_bid"))
    return rates(sums)


def rates(sums: DataFrame) -> DataFrame:
    return sums.withColumns({"win_rate": guarded("n_wins", "n_bids"), "ctr": guarded("n_clicks", "n_wins"), "cvr": guarded("n_conversions", "n_clicks"), "ctcvr": guarded("n_conversions", "n_wins")})


def roll_up(sums: DataFrame, key: str) -> DataFrame:
    """Groups of groups: sums added, rates made again."""
    names = ["n_bids", "n_wins", "n_clicks", "n_conversions"]
    return rates(sums.groupBy(key).agg(*[F.sum(n).alias(n) for n in names]))


@dataclass
class GroupSpec:
    """One grouping: keys, aggregates by name, a function applied after, an order and a number of rows."""

    name: str
    keys: list[str]
    aggs: dict[str, Column]
    post: object = None
    order: list = field(default_factory=list)
    head: int | None = None


def run_groupings(df: DataFrame, specs: list[GroupSpec]) -> dict[str, DataFrame]:
    """The tables of several groupings; Spark runs them as their results are asked for."""
    out = {}
    for s in specs:
        got = df.groupBy(*s.keys).agg(*[c.alias(n) for n, c in s.aggs.items()])
        got = s.post(got) if s.post else got
        got = got.orderBy(*s.order) if s.order else got
        out[s.name] = got.limit(s.head) if s.head else got
    return out


def reduce_counts(df: DataFrame, keys: list[str], value: str, reducers: dict[str, object], into: str = "double") -> DataFrame:
    """Groups reduced by Python functions of (values, counts), two pandas Series that give one number.

    Rows are counted by (keys, value) first, so what a function gets is a group's distinct values; use it for columns
    whose values are few, such as prices. Functions become grouped pandas aggregates and run side by side.
    """
    from pyspark.sql.pandas.functions import PandasUDFType, pandas_udf

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    made = {n: pandas_udf(f, into, PandasUDFType.GROUPED_AGG) for n, f in reducers.items()}
    return counts.groupBy(*keys).agg(*[u(F.col(value), F.col("_n")).alias(n) for n, u in made.items()])


def win_rate_by(df: DataFrame, key: str) -> DataFrame:
    """Rows and win rate of each value, with the value as text."""
    return df.groupBy(F.col(key).cast("string").alias("value")).agg(F.count("*").alias("n"), F.avg("win").alias("win_rate")).withColumn("dimension", F.lit(key))


def pivot_rate(df: DataFrame, row: str, column: str, values: list, measure: str = "win") -> DataFrame:
    """Mean of measure by row and column; columns are <column>_<value>."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(measure)).select(row, *[F.col(f"`{v}`").alias(f"{column}_{v}") for v in values])


def attribution(df: DataFrame, *keys: str) -> DataFrame:
    """E5: conversions after a click and after a view only."""
    through = F.sum(((F.col("conversion") == 1) & (F.col("click") == 1)).cast("int"))
    view = F.sum(((F.col("conversion") == 1) & (F.col("click") == 0)).cast("int"))
    return df.groupBy(*keys).agg(through.alias("click_through"), view.alias("view_through"))


def least_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of groups of n rows at least."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(key), key, "left_semi")


def describe(df: DataFrame, value: str, *keys: str, name: str = "") -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of a value."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most"), q.alias("q"))
    return got.select(*keys, "n", "mean", "std", "least", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "most")


def flat_bids(df: DataFrame, *keys: str) -> DataFrame:
    """Whether bids hardly vary (coefficient of variation below 1 % or 5 %), and what first-price winners overpay on average."""
    g = df.groupBy(*keys).agg(F.avg("bidprice").alias("mean_bid"), F.coalesce(F.stddev_samp("bidprice"), F.lit(0.0)).alias("std_bid"), F.min("bidprice").alias("min_bid"), F.max("bidprice").alias("max_bid"), F.percentile("bidprice", F.lit(0.5)).alias("median_bid"), F.avg(F.when(F.col("win") == 1, F.col("bidprice") - F.col("payprice"))).alias("saving"))
    cv = F.col("std_bid") / F.col("mean_bid")
    return g.withColumns({"cv": cv, "kind": F.when(cv < 0.01, "flat").when(cv < 0.05, "near_flat").otherwise("varied")})


def shares(df: DataFrame, key: str, within: list[str] | None = None, name: str = "share") -> DataFrame:
    """Share of a grouped table's n in all rows or within other keys; the window holds one row for each group."""
    return df.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*(within or []))))


def pareto(df: DataFrame, key: str, level: float = 0.8) -> DataFrame:
    """Keys by falling count with their cumulative share; `reach`: keys needed for the level.

    Keys are counted first, then placed by ranges of (count, key), and cumulated by blocks of places.
    """
    counts = kept(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")), "counts")  # several passes
    ranked = add_place(counts.withColumn("_down", -F.col("n")), ["_down", key], "_place")
    run = add_sums_before(ranked, "_place", ["n"])
    total = counts.agg(F.sum("n").alias("_all"))
    got = run.crossJoin(F.broadcast(total)).select(key, "n", ((F.col("n_before") + F.col("n")) / F.col("_all")).alias("cumulative"))
    reach = got.agg((F.count_if(F.col("cumulative") < level) + 1).alias("reach"))
    return got.crossJoin(F.broadcast(reach))


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def invalid_traffic(df: DataFrame, least: int) -> DataFrame:
    """Domains of `least` bids with no win, with over 90 % wins, or with as many wins and no click."""
    g = df.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"), F.sum("win").alias("w"), F.sum("click").alias("c")).where(F.col("n") >= least)
    flag = F.when(F.col("w") == 0, "zero_win").when(F.col("w") > 0.9 * F.col("n"), "high_win").when((F.col("w") >= least) & (F.col("c") == 0), "zero_click")
    return g.withColumn("flag", flag).where("flag is not null")


def positivity(df: DataFrame, keys: list[str]) -> DataFrame:
    """Strata, those never won or of extreme rates, and their share of rows."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("win").alias("r"))
    odd = (F.col("r") < 0.01) | (F.col("r") > 0.99)
    return g.agg(F.count("*").alias("n_strata"), F.count_if(F.col("r") == 0).alias("n_zero"), F.count_if(odd).alias("n_extreme"), (F.coalesce(F.sum(F.when(odd, F.col("n"))), F.lit(0)) / F.sum("n")).alias("extreme_share"))


def total_variation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Half the sum of differences of two tables' shares of each value."""
    def part(df: DataFrame, name: str) -> DataFrame:
        g = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"))
        return shares(g, "_k", name=name).drop("n")

    both = part(a, "_a").join(part(b, "_b").withColumnRenamed("_k", "_k2"), F.col("_k").eqNullSafe(F.col("_k2")), "full_outer")
    return both.agg((0.5 * F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))))).alias("distance"))


def ks(df: DataFrame, group: Column, value: str, *keys: str) -> DataFrame:
    """Largest distance of the distributions of value in the rows of group 1 and group 0; values are counted before windows run."""
    g = df.withColumn("_g", group.cast("int")).where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum("_g").alias("_a"), F.sum(1 - F.col("_g")).alias("_b"))
    run = add_sums_before(g, value, ["_a", "_b"], keys)
    total = g.groupBy(*keys).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n0"))
    both = run.join(F.broadcast(total), list(keys)) if keys else run.crossJoin(F.broadcast(total))
    gap = F.abs((F.col("_a_before") + F.col("_a")) / F.col("n1") - (F.col("_b_before") + F.col("_b")) / F.col("n0"))
    return both.groupBy(*keys, "n1", "n0").agg(F.max(gap).alias("ks")).select(*keys, "ks", "n1", "n0")


# --- user tags -------------------------------------------------------------


def tag_rows(df: DataFrame, key: str = "bidid", column: str = "usertag") -> DataFrame:
    """(key, place, tag): a row for each tag, by a Python table function in Arrow batches; the place counts from 0. Rows without tags give none."""
    from pyspark.sql.functions import udtf

    class Tags:
        def eval(self, text: str):
            parts = [x.strip() for x in (text or "").split(",")]
            if all(x.isdigit() for x in parts):
                for place, x in enumerate(parts):
                    yield place, int(x)

    rows = udtf(Tags, returnType="place: int, tag: int", useArrow=True)
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    tags = kept(texts.lateralJoin(rows(F.col(column).outer())).select(F.col(column).alias("_text"), "place", "tag"), "tags")
    return df.select(key, column).join(tags, F.col(column) == F.col("_text")).select(key, "place", "tag")


def parse_tags(tags: str = "usertag") -> Column:
    """Whole numbers of a comma-separated string; null, empty, "null", "nan" and strings with any bad part give an empty array."""
    parts = F.transform(F.split(F.col(tags), ","), lambda x: F.trim(x).try_cast("bigint"))
    good = F.col(tags).isNotNull() & ~F.lower(F.trim(tags)).isin("", "null", "nan") & ~F.exists(parts, lambda x: x.isNull())
    return F.when(good, parts).otherwise(F.array().cast("array<bigint>"))


def add_tags(df: DataFrame) -> DataFrame:
    """Tags, n_tags, has_tags."""
    return df.withColumn("tags", parse_tags()).withColumns({"n_tags": F.size("tags"), "has_tags": (F.size("tags") > 0).cast("int")})


def tag_vocabulary(df: DataFrame, top: int, least: int) -> DataFrame:
    """(tag, n, idx) of the most frequent tags; idx from 1 by rank, ties by tag. The ordered window holds the chosen tags only."""
    counts = df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "tag").limit(top).withColumn("idx", F.row_number().over(Window.orderBy(F.desc("n"), "tag")))


def tag_indexes(df: DataFrame, vocab: DataFrame, key: str = "bidid") -> DataFrame:
    """One row for each tag of each row, idx 0 for tags outside the vocabulary."""
    return df.select(key, F.size("tags").alias("size"), F.explode("tags").alias("tag")).join(F.broadcast(vocab.select("tag", "idx")), "tag", "left").withColumn("idx", F.coalesce("idx", F.lit(0)))


def multi_hot(df: DataFrame, vocab: DataFrame, key: str = "bidid") -> DataFrame:
    """U4: (key, idx, value 1.0), each idx once."""
    return tag_indexes(df, vocab, key).select(key, "idx").distinct().withColumn("value", F.lit(1.0))


def tag_counts(df: DataFrame, vocab: DataFrame, normalise: bool = False, key: str = "bidid") -> DataFrame:
    """(key, idx, value): occurrences, over the row's number of tags if asked."""
    g = tag_indexes(df, vocab, key).groupBy(key, "idx").agg(F.count("*").cast("double").alias("value"), F.max("size").alias("size"))
    return g.select(key, "idx", (F.col("value") / F.col("size") if normalise else F.col("value")).alias("value"))


def tag_hashes(df: DataFrame, n: int, seed: int = 42, key: str = "bidid") -> DataFrame:
    """(key, idx, value): signed sums of hashed tags."""
    h = F.xxhash64("tag", F.lit(seed))
    sign = F.when(F.pmod(F.xxhash64("tag", F.lit(seed + 1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return df.select(key, F.explode("tags").alias("tag")).groupBy(key, F.pmod(h, F.lit(n)).alias("idx")).agg(F.sum(sign).alias("value"))


def with_tag_columns(df: DataFrame, encoded: DataFrame, n: int, key: str = "bidid") -> DataFrame:
    """Columns tag_0 .. tag_n of an encoding."""
    wide = encoded.groupBy(key).pivot("idx", list(range(n + 1))).agg(F.first("value"))
    wide = wide.select(key, *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"tag_{i}") for i in range(n + 1)])
    return df.join(wide, key, "left").fillna(0.0, [f"tag_{i}" for i in range(n + 1)])


def tag_statistics(df: DataFrame, top: int = 100) -> DataFrame:
    """U8: the most frequent tags with their percentage of rows."""
    total = df.agg(F.count("*").alias("rows"))
    counts = df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("tag", "n", (100 * F.col("n") / F.col("rows")).alias("percent")).orderBy(F.desc("n"), "tag").limit(top)


def tag_coverage(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Share of tag occurrences in the vocabulary."""
    return tag_indexes(df, vocab).agg(F.avg((F.col("idx") > 0).cast("int")).alias("coverage"))


