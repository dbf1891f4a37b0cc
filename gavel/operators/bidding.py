"""Values, bids, auction replay and the value of a policy (B), and budget pacing (G)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.columns import col, ratio, uniform
from gavel.operators.market import as_arrays, interpolate, with_market
from gavel.operators.order import add_place
from gavel.sources.logs import kept

CPC = 200_000.0
MIN_BID, MAX_BID = 1.0, 300.0


def value(p: Column | str, cpc: float = CPC) -> Column:
    """B1: value of an impression by its click probability."""
    return col(p) * cpc


def value_cpm(cpm: float) -> Column:
    """B1: value of an impression sold by the thousand, the same for each."""
    return F.lit(cpm / 1000)


def value_cpa(p_ctr: Column | str, p_cvr: Column | str, cpa: float) -> Column:
    """B2."""
    return col(p_ctr) * col(p_cvr) * cpa


def value_summary(df: DataFrame, market_median: float, *keys: str, v: str = "v") -> DataFrame:
    """Mean, median, deviation, quartiles and the share above the market's median."""
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), q.alias("q"), F.avg((F.col(v) > market_median).cast("int")).alias("above_market"))
    return got.select(*keys, "n", "mean", "std", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "above_market", (F.col("mean") / market_median).alias("overbid_ratio"))


def linear_bid(v: Column | str, alpha: float) -> Column:
    """B5."""
    return F.least(F.greatest(col(v) * alpha, F.lit(MIN_BID)), F.lit(MAX_BID))


def percentile_price(grid: DataFrame, q: float, *keys: str) -> DataFrame:
    """Least price with F >= q."""
    return grid.where(F.col("cdf") >= q).groupBy(*keys).agg(F.min("price").alias("percentile_price"))


def envelope(model: DataFrame, key: str, second_price: bool = False) -> DataFrame:
    """For each segment, the values at which the best bid changes and the bids: (key, breaks, best).

    A bid's objective is linear in the value (slope F, less b F or the spend up to b), so the best bids are the lines of
    the upper envelope; a segment's curve has as many points as whole prices, and each is solved by itself.
    """

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["price"] >= MIN_BID].sort_values("price")
        slope, cut = pdf["cdf"].to_numpy(), pdf["spend"].to_numpy() if second_price else (pdf["price"] * pdf["cdf"]).to_numpy()
        lines: list[tuple[float, float, float, float]] = []  # from value, slope, cut, bid
        for s, c, b in zip(slope, cut, pdf["price"], strict=True):
            if lines and s <= lines[-1][1]:
                continue
            start = 0.0
            while lines:
                start = (c - lines[-1][2]) / (s - lines[-1][1])
                if start > lines[-1][0]:
                    break
                lines.pop()
                start = 0.0
            lines.append((start, s, c, b))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "breaks": [[x[0] for x in lines]], "best": [[float(x[3]) for x in lines]]})

    return model.select(key, "price", "cdf", "spend").groupBy(key).applyInPandas(hull, f"{key} {dict(model.dtypes)[key]}, breaks array<double>, best array<double>")


def best_bid(v: Column, breaks: str = "breaks", best: str = "best") -> Column:
    """The envelope's bid for a value; ties take the lower bid."""
    return F.element_at(F.col(best), F.greatest(F.size(F.filter(breaks, lambda x: x < v - 1e-6)), F.lit(1)))


def dual_regime(v: Column, floor: Column, optimal: Column, factor: float = 1.05) -> tuple[Column, Column]:
    """(bid, 1 if the floor binds): just above a floor of over a tenth of the value, capped by the value; else the optimal bid."""
    bound = (floor > 0) & (floor > 0.1 * v)
    bid = F.when(bound, F.least(F.greatest(floor * factor, F.lit(MIN_BID)), v)).otherwise(optimal)
    return F.least(F.greatest(bid, F.lit(MIN_BID)), F.lit(MAX_BID)), bound.cast("int")


def strategies(df: DataFrame, model: DataFrame, overall: DataFrame, key: str = "adexchange") -> DataFrame:
    """One row for each bid and strategy: strategy, bid, regime, win_prob. df has v (value); model and overall are market models (price, cdf, spend).

    A segment's arrays are one row of what is kept; the overall market's are one row in all.
    """
    one = overall.withColumn("_k", F.lit(0))
    default = kept(as_arrays(one, "_k", values=("cdf",)).join(envelope(one, "_k"), "_k").drop("_k"), "market")
    arrays = kept(as_arrays(model, key, values=("cdf",)).join(envelope(model, key), key), "markets")
    everywhere = default.select(F.col("breaks").alias("breaks0"), F.col("best").alias("best0"))
    out = with_market(df, arrays, key, default).crossJoin(F.broadcast(everywhere))
    v = F.col("v")
    low = F.least(F.greatest(v, F.lit(MIN_BID)), F.lit(MAX_BID))
    opt0 = best_bid(v, "breaks0", "best0")
    opt = best_bid(v)
    dual, regime = dual_regime(v, F.col("slotprice"), opt0)
    rows = [("flat", F.col("bidprice").cast("double"), F.lit(0)), ("truthful", low, F.lit(0)), ("linear_80", linear_bid(v, 0.8), F.lit(0)), ("linear_60", linear_bid(v, 0.6), F.lit(0)), ("optimal", opt0, F.lit(0)), ("optimal_exchange", opt, F.lit(0)), ("dual_regime", dual, regime)]
    # Each strategy's chance is looked up where the curves still are; what the explode copies are numbers.
    parts = F.array(*[F.struct(F.lit(n).alias("strategy"), b.cast("double").alias("bid"), r.alias("regime")) for n, b, r in rows])
    chances = F.transform(parts, lambda x: F.struct(x["strategy"].alias("strategy"), x["bid"].alias("bid"), x["regime"].alias("regime"), interpolate("cdf_grid", x["bid"]).alias("win_prob")))
    return out.select(*[F.col(c) for c in df.columns], chances.alias("_s")).withColumn("_s", F.explode("_s")).select(*df.columns, "_s.*")


def settle(df: DataFrame, second_price: bool, price: str = "payprice") -> DataFrame:
    """Won, payment, surplus and clicks of `bid` against the logged price."""
    won = (F.col("bid") >= F.col(price)).cast("int")
    paid = F.when(won == 1, F.col(price).cast("double") if second_price else F.col("bid")).otherwise(0.0)
    return df.withColumns({"won": won, "payment": paid, "surplus": (F.col("v") - paid) * won, "won_clicks": F.col("click") * won})


def settlement_metrics(df: DataFrame, *keys: str, cpc: float = CPC, price: str = "payprice") -> DataFrame:
    """Wins, rates, spend, surplus, CPM, CPC, overpayment and ROI; ratios of an empty denominator are null."""
    over = F.avg(F.when((F.col("won") == 1) & (F.col(price) > 0), (F.col("bid") - F.col(price)) / F.col(price)))
    got = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("won").alias("wins"), F.sum("won_clicks").alias("clicks"), F.sum("payment").alias("spend"), F.sum("surplus").alias("surplus"), over.alias("overpayment"))
    return got.withColumns({"win_rate": ratio("wins", "n"), "ctr": ratio("clicks", "wins"), "cpm": ratio("spend", "wins"), "cpc": ratio("spend", "clicks"), "surplus_per_win": ratio("surplus", "wins"), "roi": ratio(F.col("clicks") * cpc, "spend")})


def won_only(df: DataFrame) -> DataFrame:
    """Won rows with a price; null scores are 0."""
    return df.where("win = 1 and payprice > 0").fillna(0.0, ["p_a", "p_b"])


def sweep(df: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Each row with each of a fixed list of values."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def policy_value(df: DataFrame, key: str = "adexchange", cpc: float = CPC) -> DataFrame:
    """Rows with surplus `s` and `modelled` (1 where it rests on the market model). df has p, bid (the policy's), and cdf_grid, spend_grid."""
    lost = (F.col("win") == 0) & (F.col("bid") > F.col("bidprice"))
    f = lambda g, b: interpolate(g, b)
    logged = F.col("bidprice").cast("double")
    model = F.col("p") * cpc * (f("cdf_grid", F.col("bid")) - f("cdf_grid", logged)) - (f("spend_grid", F.col("bid")) - f("spend_grid", logged))
    exact = F.when((F.col("win") == 1) & (F.col("payprice") <= F.col("bid")), F.col("click") * cpc - F.col("payprice")).otherwise(0.0)
    return df.withColumns({"s": F.when(lost, model).otherwise(exact), "modelled": lost.cast("int"), "rewon": ((F.col("win") == 1) & (F.col("payprice") <= F.col("bid"))).cast("int")})


def policy_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Total, exact and modelled value, the modelled share, and row counts."""
    got = df.groupBy(*keys).agg(F.sum("s").alias("total"), F.sum(F.when(F.col("modelled") == 0, F.col("s")).otherwise(0.0)).alias("v_exact"), F.sum(F.when(F.col("modelled") == 1, F.col("s")).otherwise(0.0)).alias("v_model"), F.sum("modelled").alias("n_modelled"), F.sum("rewon").alias("n_rewon"), F.count("*").alias("n"))
    return got.withColumns({"share_modelled": ratio(F.abs("v_model"), F.abs("v_exact") + F.abs("v_model")), "rows_modelled": ratio("n_modelled", "n")})


def decompose(df: DataFrame, *keys: str) -> DataFrame:
    """Mean bid, wins, surplus, and wins that cost more than they are worth."""
    bad = (F.col("won") == 1) & (F.col("surplus") < 0)
    return df.groupBy(*keys).agg(F.avg("bid").alias("mean_bid"), F.sum("won").alias("wins"), F.sum("surplus").alias("surplus"), F.sum(bad.cast("int")).alias("bad_wins"), ratio(F.sum(bad.cast("int")), F.sum("won")).alias("bad_share"))


def regret(surplus: DataFrame, key: str, oracle: str, biased: str, debiased: str) -> DataFrame:
    """By key, from rows (key, model, surplus): each one's regret against the oracle and the edge of debiasing in points."""
    wide = surplus.groupBy(key).pivot("model", [oracle, biased, debiased]).agg(F.sum("surplus"))
    r = lambda m: (F.col(oracle) - F.col(m)) / F.col(oracle)
    return wide.select(key, r(biased).alias("regret_biased"), r(debiased).alias("regret_debiased"), (100 * (r(biased) - r(debiased))).alias("edge"))


#: Where a uniform number passes to the next count of a Poisson draw of mean 1.
POISSON_EDGES = [float(x) for x in np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) if k else np.exp(-1.0) for k in range(8)])]


def replicate_sums(df: DataFrame, a: str, b: str, draws: int = 500, seed: int = 7, key: str = "bidid") -> DataFrame:
    """(rep, gap): Poisson bootstrap sums of a - b, exact for every row.

    A row's weight in a replicate is a Poisson draw made of its key's hash and the replicate's number. A task folds its
    rows into one array of `draws` sums, and Spark adds the arrays up: no row leaves its task.
    """
    edges = np.array(POISSON_EDGES)
    salts = np.random.default_rng(seed).integers(1, 1 << 63, draws, dtype=np.uint64)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(draws)
        for pdf in frames:
            d, h = pdf["d"].to_numpy(float), pdf["h"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(d), 2_000):
                x = h[at : at + 2_000, None] ^ salts
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = (x >> np.uint64(11)).astype(float) / float(1 << 53)
                total += d[at : at + 2_000] @ np.searchsorted(edges, u, "right")
        yield pd.DataFrame({"rep": np.arange(draws), "gap": total})

    d = df.select((F.col(a) - F.col(b)).cast("double").alias("d"), F.xxhash64(key, F.lit(seed)).alias("h")).where("d is not null")
    return d.mapInPandas(fold, "rep long, gap double").groupBy("rep").agg(F.sum("gap").alias("gap"))


def replicate_interval(reps: DataFrame) -> DataFrame:
    """95 % interval, share of positive gaps and standard error of replicates (a row each)."""
    return reps.agg(F.percentile("gap", F.lit(0.025)).alias("ci_lo"), F.percentile("gap", F.lit(0.975)).alias("ci_hi"), F.avg((F.col("gap") > 0).cast("int")).alias("p_positive"), F.stddev_samp("gap").alias("se"))


def _replicates(sampler, draws: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf["id"], "gap": [sampler(np.random.default_rng([seed, int(i)])) for i in pdf["id"]]})

    return run


def paired_bootstrap(df: DataFrame, a: str, b: str, draws: int = 1000, seed: int = 7, heavy: int = 20_000) -> DataFrame:
    """Poisson bootstrap of the sum of a - b: gap, 95 % interval and P(gap > 0).

    The `heavy` rows of the largest differences are drawn one by one; the sum of all others is drawn from its normal
    limit, whose moments Spark sums. The heavy rows travel to the tasks: at most `heavy` numbers whatever the table.
    """
    d = df.select((F.col(a) - F.col(b)).alias("d"), F.xxhash64("bidid").alias("h"))
    total = d.agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss")).first()
    top = np.array([r["d"] for r in d.orderBy(F.desc(F.abs("d")), "h").limit(heavy).collect()])
    rest, spread = float(total["s"] or 0) - top.sum(), max(0.0, float(total["ss"] or 0) - (top**2).sum()) ** 0.5

    def sampler(rng: np.random.Generator) -> float:
        return float((rng.poisson(1.0, len(top)) * top).sum() + rest + spread * rng.standard_normal())

    reps = df.sparkSession.range(draws).mapInPandas(_replicates(sampler, draws, seed), "rep long, gap double")
    return replicate_interval(reps).withColumn("gap", F.lit(float(total["s"] or 0)))


def cluster_bootstrap(df: DataFrame, cluster: str, a: str, b: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Bootstrap over clusters: Spark sums each cluster, replicates weigh clusters, which are whole numbers below 2^20, by Poisson draws that are a function of (replicate, cluster)."""
    sums = df.groupBy(cluster).agg(F.sum(F.col(a) - F.col(b)).alias("d"))
    reps = df.sparkSession.range(draws).withColumnRenamed("id", "rep").crossJoin(F.broadcast(sums))  # clusters are few: advertisers
    unit = F.col("rep") * (1 << 20) + F.col(cluster).cast("long")
    u = F.pmod(F.xxhash64(unit, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight = sum(((u >= e).cast("int") for e in POISSON_EDGES), F.lit(0))
    g = reps.groupBy("rep").agg(F.sum(weight * F.col("d")).alias("gap"))
    return g.agg(F.percentile("gap", F.lit(0.025)).alias("ci_lo"), F.percentile("gap", F.lit(0.975)).alias("ci_hi"), F.avg((F.col("gap") > 0).cast("int")).alias("p_positive")).crossJoin(sums.agg(F.sum("d").alias("gap"), F.count("*").alias("n_clusters")))


# --- pacing -------------------------------------------------------------------


def hourly_weights(df: DataFrame) -> DataFrame:
    """G1: 24 hours with weight win rate x volume of mean 1; an hour without bids counts with rate 0.2 and volume 1."""
    spine = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    g = spine.join(df.groupBy("hour").agg(F.avg("win").alias("r"), F.count("*").alias("n")), "hour", "left")
    raw = F.coalesce("r", F.lit(0.2)) * F.coalesce("n", F.lit(1))
    return g.select("hour", (24 * raw / F.sum(raw).over(Window.partitionBy())).alias("weight"))


def ideal_spend(weights: DataFrame, budget: float) -> DataFrame:
    """Cumulative budget by hour; an hour's own share is included."""
    run = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)  # 24 rows
    return weights.withColumn("ideal", budget * F.sum("weight").over(run) / F.sum("weight").over(Window.partitionBy()))


def pid_replay(hours: DataFrame, ideal: DataFrame, budget: float, kp: float = 0.3, ki: float = 0.05, kd: float = 0.1, lo: float = 0.3, hi: float = 2.0) -> DataFrame:
    """Hour-by-hour multipliers of each campaign day (advertiser, day, hour, spend), one fold over an array of 24 hours inside a row."""
    norm = max(0.1 * budget, 1.0)
    days = hours.select("advertiser", "day").distinct().crossJoin(F.broadcast(ideal.select("hour", "ideal")))  # 24 rows
    full = days.join(hours, ["advertiser", "day", "hour"], "left").select("advertiser", "day", "hour", "ideal", F.coalesce(F.col("spend").cast("double"), F.lit(0.0)).alias("spend"))
    rows = full.groupBy("advertiser", "day").agg(F.array_sort(F.collect_list(F.struct("hour", "ideal", "spend"))).alias("h"))
    zero = F.struct(F.lit(0.0).alias("spent"), F.lit(0.0).alias("integral"), F.lit(0.0).alias("prev"), F.array().cast("array<struct<hour:int,spent:double,ideal:double,multiplier:double,spend:double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        error = x["ideal"] - s["spent"]
        integral = s["integral"] + error
        m = F.least(F.greatest(1 + (kp * error + ki * integral + kd * (error - s["prev"])) / norm, F.lit(lo)), F.lit(hi))
        spend = x["spend"] * m
        snap = F.struct(x["hour"].alias("hour"), (s["spent"] + spend).alias("spent"), x["ideal"].alias("ideal"), m.alias("multiplier"), spend.alias("spend"))
        return F.struct((s["spent"] + spend).alias("spent"), integral.alias("integral"), error.alias("prev"), F.concat(s["out"], F.array(snap)).alias("out"))

    out = rows.select("advertiser", "day", F.explode(F.aggregate("h", zero, step, lambda s: s["out"])).alias("x")).select("advertiser", "day", "x.*")
    last = Window.partitionBy("advertiser", "day")
    return out.withColumn("utilisation_full", F.max("spent").over(last) / budget).withColumn("utilisation", F.least("utilisation_full", F.lit(1.0)))


def throttle(df: DataFrame, budget: float, seed: int = 5) -> DataFrame:
    """`joins` of each bid (1 if it takes part), by its hour and what was spent before it."""
    left = F.greatest(24 - F.col("hour"), F.lit(1))
    ideal = (budget - F.col("spent_before")) / left
    rate = F.when(F.col("hour") > 0, F.col("spent_before") / F.greatest("hour", F.lit(1))).otherwise(ideal)
    over = rate > 1.2 * ideal
    return df.withColumn("joins", F.when(over, (uniform("bidid", seed) > 1 - ideal / rate).cast("int")).otherwise(1))


#: Bids of one block of a campaign day's hour, in the order of bidid.
PACE_BLOCK = 10_000


def paced_auction(df: DataFrame, ideal: dict[int, float], budget: float, kp: float = 0.3, ki: float = 0.05, kd: float = 0.1, block: int = PACE_BLOCK) -> DataFrame:
    """Bid-level replay of each (advertiser, day): hourly multipliers on bids, first price, stop at the budget.

    An hour's multiplier needs the spend before it, so there is a round for each hour, of all campaign days at once.
    Within the hour it is fixed, and what still fits the budget is a running sum in the order of bidid. Bids are cut
    into blocks of that order beforehand; a round sums blocks, cumulates the sums, and takes blocks whole except for
    the one of a campaign day in which the budget ends, whose bids are cumulated one by one.
    """
    key = ["advertiser", "day"]
    rows = add_place(df.select(*key, "hour", "bidid", "v", "payprice", "click"), [*key, "hour", "bidid"])
    rows = kept(rows.withColumn("block", F.floor(F.col("_at") / block)).drop("_at"), "auction", "hour")
    none = {c: F.lit(0.0) for c in ("spent", "integral", "prev")} | {c: F.lit(0).cast("long") for c in ("wins", "clicks")}
    state = kept(rows.select(*key).distinct().withColumns(none), "pace")
    for hour in range(24):
        error = F.lit(float(ideal[hour])) - F.col("spent")
        m = 1 + (kp * error + ki * (F.col("integral") + error) + kd * (error - F.col("prev"))) / max(0.1 * budget, 1.0)
        now = state.select(*key, "spent", "wins", "clicks", (F.col("integral") + error).alias("integral"), error.alias("prev"), F.least(F.greatest(m, F.lit(0.3)), F.lit(2.0)).alias("m"))
        bid = F.least(F.col("v") * F.col("m"), F.lit(MAX_BID))
        hits = rows.where(F.col("hour") == hour).join(now.select(*key, "spent", "m"), key).withColumn("bid", bid).where("bid >= payprice")
        sums = hits.groupBy(*key, "block").agg(F.sum("bid").alias("s"), F.count("*").alias("n"), F.sum("click").alias("c"), F.first("spent").alias("spent"))
        before = F.col("spent") + F.coalesce(F.sum("s").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        sums = sums.withColumn("base", before)
        whole = sums.where(F.col("base") + F.col("s") <= budget).select(*key, "s", "n", "c")
        ends = sums.where((F.col("base") <= budget) & (F.col("base") + F.col("s") > budget)).select(*key, "block", "base")
        inside = Window.partitionBy(*key, "block").orderBy("bidid").rowsBetween(Window.unboundedPreceding, 0)
        part = hits.join(ends, [*key, "block"]).withColumn("cum", F.col("base") + F.sum("bid").over(inside)).where(F.col("cum") <= budget)
        taken = whole.unionByName(part.select(*key, F.col("bid").alias("s"), F.lit(1).cast("long").alias("n"), F.col("click").cast("long").alias("c")))
        taken = taken.groupBy(*key).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("c").alias("c"))
        add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        state = kept(now.join(taken, key, "left").select(*key, add("spent", "s"), "integral", "prev", add("wins", "n"), add("clicks", "c")), "pace")
    return state.select(*key, "spent", "wins", "clicks")


def hour_greedy(df: DataFrame, shares: DataFrame, budgets: list[float]) -> DataFrame:
    """Within each hour, the most profitable winnable rows up to the hour's budget; by weighting and budget.

    shares: (weighting, hour, share). The running sum of an hour is taken in two steps (blocks of profit, then rows),
    so that an hour's rows needn't fit one task.
    """
    bid = F.least(F.col("v"), F.lit(MAX_BID))
    won = df.where(bid >= F.col("payprice")).withColumn("profit", F.col("v") - F.col("payprice")).select("hour", "bidid", "profit", "payprice", "click")
    block = F.floor(F.col("profit") / 5).cast("long")
    won = won.withColumn("block", block)
    above = won.groupBy("hour", "block").agg(F.sum("payprice").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("hour").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("hour", "block").orderBy(F.desc("profit"), "bidid").rowsBetween(Window.unboundedPreceding, 0)
    run = won.withColumn("within", F.sum("payprice").over(inside)).join(above.select("hour", "block", "before"), ["hour", "block"]).withColumn("cum", F.col("before") + F.col("within"))
    cells = sweep(shares, "budget", budgets)
    taken = run.join(F.broadcast(cells), "hour").where(F.col("cum") <= F.col("budget") * F.col("share"))
    return taken.groupBy("weighting", "budget").agg(F.count("*").alias("wins"), F.sum("payprice").alias("spend"), F.sum("profit").alias("surplus"), F.sum("click").alias("clicks")).withColumn("utilisation", F.col("spend") / F.col("budget"))


def marginal(df: DataFrame, step: str, value_: str, *keys: str) -> DataFrame:
    """Change of a value from one budget to the next."""
    return df.withColumn("marginal", F.col(value_) - F.lag(value_).over(Window.partitionBy(*keys).orderBy(step)))
