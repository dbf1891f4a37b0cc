"""Win-rate curves and the distribution of market prices under censoring (W)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.columns import col, wilson
from gavel.operators.features import bin_right_closed, quantile_edges
from gavel.operators.newton import newton
from gavel.sources.logs import kept

TOP_PRICE = 300


def win_rate_curve(df: DataFrame, bins: int = 50, least: int = 100) -> DataFrame:
    """Win rate and its interval at each bid level, or in each quantile bin where there are more levels than bins."""
    levels = df.select("bidprice").distinct().count()
    if levels <= bins:
        g = df.groupBy(F.col("bidprice").cast("double").alias("price"))
    else:
        edges = quantile_edges(df, "bidprice", [i / bins for i in range(bins + 1)])
        middle = F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:], strict=False)])
        g = df.groupBy(middle[bin_right_closed(F.col("bidprice"), edges)].alias("price"))
    got = g.agg(F.count("*").alias("n"), F.sum("win").alias("k")).where(F.col("n") >= least)
    lo, hi = wilson("k", "n")
    return got.select("price", "n", (F.col("k") / F.col("n")).alias("win_rate"), lo.alias("ci_lo"), hi.alias("ci_hi"))


def equal_width_curve(df: DataFrame, segment: str, bins: int = 20) -> DataFrame:
    """Win rate by segment in equal-width bins of the bid up to its 99th percentile."""
    top = df.agg(F.percentile("bidprice", F.lit(0.99)).alias("_top"))
    at = F.least(F.floor(F.col("bidprice") * bins / F.col("_top")), F.lit(bins - 1)).cast("int")
    return df.crossJoin(F.broadcast(top)).where("bidprice <= _top").groupBy(segment, at.alias("bin")).agg(F.count("*").alias("n"), F.avg("win").alias("win_rate"))


def price_stats(df: DataFrame, *keys: str) -> DataFrame:
    """winners' prices: mean, population deviation, quantiles, number, and share within 1 of the floor."""
    q = F.percentile("payprice", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95))))
    bound = F.avg((F.abs(F.col("payprice") - F.col("slotprice")) < 1).cast("int"))
    got = df.where("win = 1").groupBy(*keys).agg(F.count("*").alias("n"), F.avg("payprice").alias("mean"), F.stddev_pop("payprice").alias("std"), bound.alias("floor_binding"), q.alias("q"))
    return got.select(*keys, "n", "mean", "std", "floor_binding", *[F.col("q")[i].alias(x) for i, x in enumerate(("p25", "median", "p75", "p90", "p95"))])


def empirical_cdf(df: DataFrame, points: int = 200) -> DataFrame:
    """Distribution of winners' prices on an even grid from their least to their largest; prices are counted first."""
    counts = df.where("win = 1").groupBy("payprice").agg(F.count("*").alias("n"))
    run = counts.select("payprice", (F.sum("n").over(Window.orderBy("payprice").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())).alias("c"), F.lead("payprice").over(Window.orderBy("payprice")).alias("next"))
    ends = counts.agg(F.min("payprice").alias("lo"), F.max("payprice").alias("hi"))
    grid = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)).alias("price"))
    # A grid point's step is that of the largest price not above it: whole prices make this an equi-join.
    return grid.withColumn("at", F.floor(F.round("price", 9))).join(run.select(F.explode(F.sequence("payprice", F.coalesce(F.col("next") - 1, F.col("payprice")))).alias("at"), "c"), "at").select("i", "price", F.col("c").alias("cdf"))


def durations(df: DataFrame) -> DataFrame:
    """What the log says of the market price: `t` (paid, or the bid that lost, 0.01 at least) and `event` (paid)."""
    return df.withColumns({"t": F.greatest(F.when(F.col("win") == 1, F.col("payprice")).otherwise(F.col("bidprice")).cast("double"), F.lit(0.01)), "event": F.col("win")})


def kaplan_meier(df: DataFrame, *keys: str, least: int = 0, z: float = 1.959964) -> DataFrame:
    """Survival of the market price with its log-log band, by segment; segments of fewer than `least` rows go.

    Rows are counted by (segment, price) first, so the ordered windows hold one row for each price.
    """
    g = durations(df).groupBy(*keys, "t").agg(F.count("*").alias("n"), F.sum("event").alias("d"))
    up = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"at_risk": F.sum("n").over(down), "_all": F.sum("n").over(Window.partitionBy(*keys))}).where(F.col("_all") >= least)
    step = F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk")))
    var = F.when(F.col("d") < F.col("at_risk"), F.col("d") / (F.col("at_risk") * (F.col("at_risk") - F.col("d")).cast("double")))
    over = F.max((F.col("d") >= F.col("at_risk")).cast("int")).over(up)
    g = g.withColumns({"survival": F.when(over == 1, 0.0).otherwise(F.exp(F.coalesce(F.sum(step).over(up), F.lit(0.0)))), "_v": F.coalesce(F.sum(var).over(up), F.lit(0.0))})
    inside = (F.col("survival") > 0) & (F.col("survival") < 1)
    ll, half = F.log(-F.log("survival")), z * F.sqrt("_v") / F.abs(F.log("survival"))
    return g.select(*keys, F.col("t").alias("price"), "at_risk", F.col("d").alias("events"), "survival", (1 - F.col("survival")).alias("cdf"), F.when(inside, F.exp(-F.exp(ll + half))).otherwise(F.col("survival")).alias("ci_lo"), F.when(inside, F.exp(-F.exp(ll - half))).otherwise(F.col("survival")).alias("ci_hi"))


def km_median(curve: DataFrame, *keys: str) -> DataFrame:
    """Least price of a survival of at most a half; null if none is."""
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("price"))).alias("median"))


def on_grid(curve: DataFrame, *keys: str, top: int = TOP_PRICE) -> DataFrame:
    """The step curve on whole prices 0..top: (segment, price, cdf, survival)."""
    grid = curve.select(*keys).distinct() if keys else curve.limit(1).select(F.lit(1).alias("_one"))
    grid = grid.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("price", F.col("_p").cast("double"))
    points = grid.select(*keys, "price", F.lit(None).cast("double").alias("survival"), F.lit(1).alias("_g")).unionByName(curve.select(*keys, "price", "survival", F.lit(0).alias("_g")))
    last = F.last("survival", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("price", "_g").rowsBetween(Window.unboundedPreceding, 0))
    got = points.withColumn("survival", F.coalesce(last, F.lit(1.0))).where("_g = 1").drop("_g")
    return got.withColumn("cdf", 1 - F.col("survival"))


def market_model(grid: DataFrame, *keys: str) -> DataFrame:
    """The curve with spend up to each price: running sum of middle price times mass."""
    w = Window.partitionBy(*keys).orderBy("price")
    mass = F.col("cdf") - F.coalesce(F.lag("cdf").over(w), F.col("cdf"))
    mid = (F.col("price") + F.coalesce(F.lag("price").over(w), F.col("price"))) / 2
    return grid.withColumn("_m", mass * mid).withColumn("spend", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_m")


def as_arrays(model: DataFrame, *keys: str, values: tuple[str, ...] = ("cdf", "spend")) -> DataFrame:
    """One row for each segment with its values on whole prices as arrays; `top` + 1 numbers each."""
    packed = F.array_sort(F.collect_list(F.struct("price", *values)))
    return model.groupBy(*keys).agg(packed.alias("_a")).select(*keys, *[F.col(f"_a.{v}").alias(f"{v}_grid") for v in values])


def interpolate(grid: Column | str, price: Column) -> Column:
    """Linear interpolation in an array on whole prices from 0; 0 below it and its end above."""
    g = col(grid)
    at = F.least(F.greatest(F.floor(price), F.lit(0)), F.size(g) - 2).cast("int")
    part = F.least(price - at, F.lit(1.0))
    return F.when(price < 0, 0.0).otherwise(F.element_at(g, at + 1) * (1 - part) + F.element_at(g, at + 2) * part)


def with_market(df: DataFrame, arrays: DataFrame, key: str, default: DataFrame | None = None) -> DataFrame:
    """df with its segment's arrays; segments without any get the default row's (W7, W18). Curves are as many as segments: a few rows of TOP_PRICE numbers."""
    out = df.join(arrays, key, "left")
    if default is not None:
        names = [c for c in arrays.columns if c != key]
        out = out.crossJoin(F.broadcast(default.select(*[F.col(c).alias(f"_{c}") for c in names]))).withColumns({c: F.coalesce(c, f"_{c}") for c in names}).drop(*[f"_{c}" for c in names])
    return out


def win_rate_lookup(df: DataFrame, segment: str, least: int = 200, top: int = TOP_PRICE) -> DataFrame:
    """By segment and whole price, the win rate interpolated between bid levels (flat outside them); segments of few rows or one level go."""
    levels = df.groupBy(segment, F.col("bidprice").cast("double").alias("x")).agg(F.count("*").alias("n"), F.avg("win").alias("y"))
    w = Window.partitionBy(segment)
    levels = levels.withColumns({"_n": F.sum("n").over(w), "_k": F.count("*").over(w)}).where(f"_n >= {least} and _k >= 2")
    o = w.orderBy("x")
    parts = levels.withColumns({"x2": F.lead("x").over(o), "y2": F.lead("y").over(o), "x0": F.min("x").over(w)})
    inner = parts.select(segment, "x", "y", "x2", "y2", F.when(F.col("x") == F.col("x0"), 0.0).otherwise(F.col("x")).alias("lo"), F.coalesce(F.col("x2") - 1, F.lit(float(top))).alias("hi"))
    grid = inner.where("lo <= hi").withColumn("price", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))))
    value = F.when((F.col("price") <= F.col("x")) | F.col("x2").isNull(), F.col("y")).otherwise(F.col("y") + (F.col("y2") - F.col("y")) * (F.col("price") - F.col("x")) / (F.col("x2") - F.col("x")))
    return grid.select(segment, "price", value.alias("win_prob"))


# --- parametric fits: the parameters are logarithms, except the log-normal's mean ---


def _upper_tail(z: Column) -> Column:
    """Log of the standard normal's upper tail at z; the relative error of the tail is about 1e-7."""
    # A published rational Chebyshev fit of the complementary error function.
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    u = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + u / 2)
    poly: Column = F.lit(fit[-1])
    for c in reversed(fit[:-1]):
        poly = poly * t + c
    log_tail = F.log(t) - u * u + poly - math.log(2)
    return F.when(z >= 0, log_tail).otherwise(F.log(1 - F.exp(log_tail)))


def _exponential(v: list[float]) -> tuple[Column, list[Column], list[Column]]:
    t, e = F.col("t"), F.col("event")
    r = t * math.exp(-v[0])
    return -e * v[0] - r, [r - e], [-r]


def _weibull(v: list[float]) -> tuple[Column, list[Column], list[Column]]:
    t, e, k = F.col("t"), F.col("event"), math.exp(v[1])
    z = k * (F.log(t) - v[0])
    x = F.exp(F.least(z, F.lit(50.0)))
    return e * (v[1] + z - F.log(t)) - x, [k * (x - e), e * (1 + z) - z * x], [-k * k * x, k * (x - e) + k * z * x, z * (e - x) - z * z * x]


def _log_normal(v: list[float]) -> tuple[Column, list[Column], list[Column]]:
    t, e, s = F.col("t"), F.col("event"), math.exp(v[1])
    z = (F.log(t) - v[0]) / s
    tail = _upper_tail(z)
    h = F.exp(-z * z / 2 - 0.5 * math.log(2 * math.pi) - tail)  # hazard
    d = h * (h - z)
    paid = -F.log(t) - v[1] - 0.5 * math.log(2 * math.pi) - z * z / 2
    either = lambda a, b: F.when(e == 1, a).otherwise(b)
    first = [either(z / s, h / s), either(z * z - 1, h * z)]
    return either(paid, tail), first, [either(F.lit(-1 / s**2), -d / s**2), either(-2 * z / s, -(z * d + h) / s), either(-2 * z * z, -z * z * d - h * z)]


def parametric_fits(df: DataFrame) -> DataFrame:
    """Exponential, Weibull and log-normal fits to censored prices with AIC, best first; floor-bound winners are left out.

    a and b are the logarithms of scale and shape, or the mean and the log of the deviation of log prices. Rows are
    counted by (price, event) and stored; every Newton step is one aggregate of that table. `converged` is 0 where
    the gradient didn't vanish.
    """
    used = durations(df).where("not (win = 1 and slotprice > 0 and payprice = slotprice)")
    table = kept(used.groupBy("t", "event").agg(F.count("*").alias("n")), "durations")
    n = F.col("n")
    log = F.log("t")
    sums = table.agg(F.sum(n), F.sum(n * F.col("event")), F.sum(n * F.col("t")), F.sum(n * log), F.sum(n * log * log)).first()
    count, events, time, l1, l2 = (float(x or 0.0) for x in sums)
    scale = math.log(time / events) if time and events else 0.0
    mean = l1 / count if count else 0.0
    spread = math.log(max(math.sqrt(max(l2 / count - mean * mean, 0.0)), 1e-3)) if count else 0.0
    fits = []
    for name, terms, start in (("exponential", _exponential, [scale]), ("weibull", _weibull, [scale, 0.0]), ("lognormal", _log_normal, [mean, spread])):
        fit = newton(table, terms, start)
        p, best = len(start), fit.log_likelihood
        fits.append((name, p, *(fit.at + [0.0])[:2], best, 2 * p - 2 * best, p * math.log(max(count, 1.0)) - 2 * best, int(fit.converged)))
    return df.sparkSession.createDataFrame(fits, "distribution string, n_params int, a double, b double, log_likelihood double, aic double, bic double, converged int").orderBy("aic")


def parametric_curves(fits: DataFrame, top: int = TOP_PRICE) -> DataFrame:
    """Distribution and density of fits (distribution, a, b) on the prices 1 to top."""
    grid = fits.select("distribution", "a", "b").withColumn("price", F.explode(F.sequence(F.lit(1), F.lit(top)))).withColumn("price", F.col("price").cast("double"))
    t, a, k = F.col("price"), F.col("a"), F.when(F.col("distribution") == "weibull", F.exp("b")).otherwise(1.0)
    power = F.exp(k * (F.log(t) - a))
    s = F.exp("b")
    z = (F.log(t) - a) / s
    normal = F.col("distribution") == "lognormal"
    cdf = F.when(normal, 1 - F.exp(_upper_tail(z))).otherwise(1 - F.exp(-power))
    pdf = F.when(normal, F.exp(-z * z / 2) / (t * s * math.sqrt(2 * math.pi))).otherwise(k / t * power * F.exp(-power))
    return grid.select("distribution", "price", cdf.alias("cdf"), pdf.alias("pdf"))


def compare_cdfs(df: DataFrame, top: int = TOP_PRICE) -> DataFrame:
    """Mean and largest distance of the censored curve from winners' prices alone, on whole prices."""
    km = on_grid(kaplan_meier(df), top=top)
    won = on_grid(kaplan_meier(df.where("win = 1")), top=top)
    gap = F.abs(F.col("a.cdf") - F.col("b.cdf"))
    return km.alias("a").join(won.alias("b"), "price").agg(F.avg(gap).alias("mean_abs"), F.max(gap).alias("ks"))


def audit(df: DataFrame, model: DataFrame, segment: str, least: int) -> DataFrame:
    """At each segment's bid levels, the model's F beside the realised win rate's interval."""
    cells = df.groupBy(segment, "bidprice").agg(F.count("*").alias("n"), F.sum("win").alias("k")).where(F.col("n") >= least)
    lo, hi = wilson("k", "n")
    out = with_market(cells, as_arrays(model, segment, values=("cdf",)), segment).withColumns({"f": interpolate("cdf_grid", F.col("bidprice").cast("double")), "win_rate": F.col("k") / F.col("n"), "ci_lo": lo, "ci_hi": hi})
    return out.withColumn("inside", F.col("f").between(F.col("ci_lo"), F.col("ci_hi")).cast("int")).drop("cdf_grid", "k")


def logistic_win_rate(df: DataFrame, segment: str) -> DataFrame:
    """Logistic win rate on the log of bid over floor (floor 0 counts as 1), and mean elasticity beta (1 - p) by segment.

    Rows are counted by (segment, bid, floor) and stored; every Newton step is one aggregate of that table. `converged`
    is 0 where there is no maximum (a bid level above which all bids win, for example).
    """
    cells = kept(df.groupBy(segment, "bidprice", "slotprice").agg(F.count("*").alias("n"), F.avg("win").alias("y")), "cells")
    x = F.log(F.col("bidprice") / F.greatest(F.col("slotprice"), F.lit(1)).cast("double"))

    def terms(v: list[float]) -> tuple[Column, list[Column], list[Column]]:
        z = v[0] + v[1] * x
        p = 1 / (1 + F.exp(-z))
        # log(1 + exp(z)) without overflow
        value = F.col("y") * z - F.greatest(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))
        q = p * (1 - p)
        return value, [F.col("y") - p, (F.col("y") - p) * x], [-q, -q * x, -q * x * x]

    fit = newton(cells, terms, [0.0, 0.0])
    p, beta, n = 1 / (1 + F.exp(-(fit.at[0] + fit.at[1] * x))), fit.at[1], F.col("n")
    got = cells.groupBy(segment).agg((F.sum(n * p) / F.sum(n)).alias("mean_p"), (F.sum(n * beta * (1 - p)) / F.sum(n)).alias("elasticity"))
    return got.withColumns({"beta": F.lit(beta), "converged": F.lit(int(fit.converged))})


def log_normal_mle(df: DataFrame, *keys: str) -> DataFrame:
    """Mean and population deviation of winners' log prices."""
    return df.where("win = 1 and payprice > 0").groupBy(*keys).agg(F.avg(F.log("payprice")).alias("mu"), F.stddev_pop(F.log("payprice")).alias("sigma"))
