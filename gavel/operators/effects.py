"""Contrasts of bids and inference over clusters (C)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions import tails
from gavel.functions.columns import uniform
from gavel.operators.debias import FEATURES, apply_probability, assemble, dealt, fit_probability
from gavel.operators.order import add_place
from gavel.sources.logs import kept


def varied(df: DataFrame, key: str = "advertiser", least: int = 2) -> DataFrame:
    """Rows of keys with `least` bid levels at least."""
    keep = df.groupBy(key).agg(F.count_distinct("bidprice").alias("_n")).where(F.col("_n") >= least)
    return df.join(kept(keep.select(key), "varied"), key, "left_semi")  # broadcast where it is small, so that a key of very many rows is no hot one


def treatment_table(df: DataFrame, cpc: float) -> DataFrame:
    """Treatment (bid), outcomes and confounders: payment on wins, surplus of p_a's value on wins."""
    return df.withColumns({"t": F.col("bidprice"), "payment": F.when(F.col("win") == 1, F.col("payprice")).otherwise(0), "v": F.col("p_a") * cpc, "surplus": F.when(F.col("win") == 1, F.col("p_a") * cpc - F.col("payprice")).otherwise(0.0)})


def strata(taxonomy: str = "taxonomy") -> Column:
    """Taxonomy, exchange and quarter of the day."""
    return F.concat_ws("_", taxonomy, F.col("adexchange").cast("string"), F.least(F.floor(F.col("hour") / 6), F.lit(3)).cast("string"))


def arms(df: DataFrame, key: str = "advertiser") -> DataFrame:
    """`arm`: 1 at a key's highest bid, 0 at its lowest; others go."""
    w = df.groupBy(key).agg(F.max("bidprice").alias("_hi"), F.min("bidprice").alias("_lo"))
    return df.join(kept(w, "levels"), key).where("_hi > _lo and (bidprice = _hi or bidprice = _lo)").withColumn("arm", (F.col("bidprice") == F.col("_hi")).cast("int")).drop("_hi", "_lo")


def stratified_effect(df: DataFrame, outcome: str, stratum: str = "stratum", least: int = 5) -> DataFrame:
    """C4: effect, standard error and sizes of strata with `least` rows in each arm."""
    hi, lo = F.when(F.col("arm") == 1, F.col(outcome)), F.when(F.col("arm") == 0, F.col(outcome))
    g = df.groupBy(stratum).agg(F.avg(hi).alias("m1"), F.avg(lo).alias("m0"), F.var_pop(hi).alias("v1"), F.var_pop(lo).alias("v0"), F.count(hi).alias("n1"), F.count(lo).alias("n0"))
    return g.where((F.col("n1") >= least) & (F.col("n0") >= least)).select(stratum, (F.col("m1") - F.col("m0")).alias("cate"), F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")).alias("se"), "n1", "n0")


def average_effect(table: DataFrame) -> DataFrame:
    """C4: size-weighted effect with both standard errors: sqrt of the mean square (as published) and of the sum of squared weights times squares."""
    n = F.col("n1") + F.col("n0")
    return table.agg((F.sum(n * F.col("cate")) / F.sum(n)).alias("ate"), F.sqrt(F.sum(n * F.col("se") * F.col("se")) / F.sum(n)).alias("se_ref"), (F.sqrt(F.sum(n * n * F.col("se") * F.col("se"))) / F.sum(n)).alias("se"), F.count("*").alias("n_strata"))


def map_back(df: DataFrame, table: DataFrame, stratum: str = "stratum") -> DataFrame:
    """C4: `cate` of each row; the average where its stratum has none."""
    return df.join(table.select(stratum, "cate"), stratum, "left").crossJoin(F.broadcast(average_effect(table).select("ate"))).withColumn("cate", F.coalesce("cate", "ate")).drop("ate")


def t_learner(df: DataFrame, outcome: str, features: list[str] = FEATURES) -> DataFrame:
    """Difference of two tree regressions, one for each arm, for all rows."""
    from pyspark.ml.regression import GBTRegressor

    held = kept(df, "arms")
    rows = assemble(held, features)
    for arm in (0, 1):
        train = dealt(held.where(F.col("arm") == arm).select(outcome, *features), "arm")
        model = GBTRegressor(labelCol=outcome, predictionCol=f"_m{arm}", maxIter=6, maxDepth=3, seed=7).fit(assemble(train, features))
        rows = model.transform(rows)
    return rows.withColumn("cate", F.col("_m1") - F.col("_m0")).drop("_m0", "_m1", "features")


def naive_contrast(df: DataFrame, outcomes: list[str], key: str = "advertiser") -> DataFrame:
    """Highest against lowest bid within each key, by outcome; and the size-weighted mean (key null)."""
    rows = arms(df, key)
    diff = [(F.avg(F.when(F.col("arm") == 1, F.col(o))) - F.avg(F.when(F.col("arm") == 0, F.col(o)))).alias(f"tau_{o}") for o in outcomes]
    g = rows.groupBy(key).agg(F.count("*").alias("n"), *diff)
    total = g.agg(F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.col(f"tau_{o}")) / F.sum("n")).alias(f"tau_{o}") for o in outcomes])
    return g.unionByName(total, allowMissingColumns=True)


def check_decomposition(df: DataFrame, direct: str, tau_win: str, tau_pay: str, v: str = "v") -> DataFrame:
    """Direct effect on surplus beside value times effect on wins less effect on payments."""
    built = F.col(v) * F.col(tau_win) - F.col(tau_pay)
    return df.agg(F.corr(F.col(direct), built).alias("correlation"), F.avg(F.abs(F.col(direct) - built)).alias("mae"), F.avg(F.col(direct) - built).alias("bias"))


def mediation(df: DataFrame, *keys: str, total: str, tau_win: str, v: str = "v") -> DataFrame:
    """The part of the effect through wins (NIE) and the rest (NDE)."""
    nie = F.avg(F.col(v) * F.col(tau_win))
    return df.groupBy(*keys).agg(nie.alias("nie"), (F.avg(total) - nie).alias("nde"), F.count("*").alias("n"))


def effect_summary(df: DataFrame, *keys: str, effect: str = "cate") -> DataFrame:
    """Mean, deviation and rows by segment."""
    return df.groupBy(*keys).agg(F.avg(effect).alias("mean"), F.stddev_samp(effect).alias("std"), F.count("*").alias("n"))


def effect_pivot(df: DataFrame, row: str = "adexchange", effect: str = "cate") -> DataFrame:
    """Mean effect by row key and quarter of the day, as columns q0 to q3."""
    quarter = F.least(F.floor(F.col("hour") / 6), F.lit(3)).cast("int")
    wide = df.withColumn("_q", quarter).groupBy(row).pivot("_q", [0, 1, 2, 3]).agg(F.avg(effect))
    return wide.select(row, *[F.col(str(k)).alias(f"q{k}") for k in range(4)])


def dr_learner(df: DataFrame, outcome: str, features: list[str] = FEATURES) -> DataFrame:
    """Doubly robust pseudo-outcomes with a cross-fitted propensity clipped at 0.01, regressed by trees. Honest-forest intervals are not reproduced; `effect_interval` gives those of means."""
    from pyspark.ml.regression import GBTRegressor

    df, names = kept(df.withColumn("_half", (uniform("bidid", 11) < 0.5).cast("int")), "halves"), [f for f in features if f != "bidprice"]
    parts = []
    for side in (0, 1):
        train, held = df.where(F.col("_half") != side), df.where(F.col("_half") == side)
        h_rows = assemble(apply_probability(fit_probability(train, "arm", names), held, "_e"), names)
        for arm in (0, 1):
            own = dealt(train.where(F.col("arm") == arm).select(outcome, *names), "arm")
            h_rows = GBTRegressor(labelCol=outcome, predictionCol=f"_m{arm}", maxIter=5, maxDepth=3, seed=7).fit(assemble(own, names)).transform(h_rows)
        parts.append(h_rows.drop("features"))
    rows = parts[0].unionByName(parts[1])
    e = F.least(F.greatest(F.col("_e"), F.lit(0.01)), F.lit(0.99))
    rows = kept(rows.withColumn("psi", pseudo_outcome(F.col(outcome), F.col("_m1"), F.col("_m0"), e)).drop("_e", "_m0", "_m1", "_half"), "psi")
    train = assemble(dealt(rows.select("psi", *names), "psi"), names)
    return GBTRegressor(labelCol="psi", predictionCol="cate", maxIter=5, maxDepth=3, seed=7).fit(train).transform(assemble(rows, names)).drop("features")


def stratified_psi(df: DataFrame, outcome: str, stratum: str = "stratum", least: int = 5) -> DataFrame:
    """`psi`, the doubly robust pseudo-outcome whose nuisances are the means of strata with `least` rows in each arm; rows of others go."""
    hi, lo = F.when(F.col("arm") == 1, F.col(outcome)), F.when(F.col("arm") == 0, F.col(outcome))
    cells = df.groupBy(stratum).agg(F.avg(hi).alias("_m1"), F.avg(lo).alias("_m0"), F.avg("arm").alias("_e"), F.count(hi).alias("_n1"), F.count(lo).alias("_n0"))
    rows = df.join(cells.where((F.col("_n1") >= least) & (F.col("_n0") >= least)), stratum)
    return rows.withColumn("psi", pseudo_outcome(F.col(outcome), F.col("_m1"), F.col("_m0"), F.col("_e"))).drop("_m1", "_m0", "_e", "_n1", "_n0")


def pseudo_outcome(y: Column, m1: Column, m0: Column, e: Column) -> Column:
    """The doubly robust pseudo-outcome of a row of column `arm`."""
    return m1 - m0 + F.when(F.col("arm") == 1, (y - m1) / e).otherwise(-(y - m0) / (1 - e))


def effect_interval(df: DataFrame, *keys: str, psi: str = "psi", cluster: str | None = None, z: float = 1.959964) -> DataFrame:
    """Mean effect of pseudo-outcomes with its influence-function standard error and 95 % interval, of rows or of clusters.

    An average's influence function is psi less the average, so its variance is one aggregate; with clusters it is that
    of their sums, and rows are summed by cluster first. An interval of fewer than two units is null.
    """
    unit = df.where(F.col(psi).isNotNull())
    unit = unit.groupBy(*keys, cluster).agg(F.sum(psi).alias("_s"), F.count("*").cast("double").alias("_c")) if cluster else unit.select(*keys, F.col(psi).cast("double").alias("_s"), F.lit(1.0).alias("_c"))
    g = unit.groupBy(*keys).agg(F.sum("_c").cast("long").alias("n"), F.count("*").alias("units"), (F.sum("_s") / F.sum("_c")).alias("effect"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.sum(F.col("_s") * F.col("_c")).alias("_sc"), F.sum(F.col("_c") * F.col("_c")).alias("_cc"))
    t = F.col("effect")
    spread = F.greatest(F.col("_ss") - 2 * t * F.col("_sc") + t * t * F.col("_cc"), F.lit(0.0))
    se = F.sqrt(spread * F.col("units") / F.when(F.col("units") > 1, F.col("units") - 1)) / F.col("n")
    return g.select(*keys, "n", "units", "effect", se.alias("se"), (t - z * se).alias("ci_lo"), (t + z * se).alias("ci_hi"))


def back_door(df: DataFrame, outcome: str, controls: list[str], treatment: str = "bidprice") -> DataFrame:
    """C11: the treatment's coefficient in a linear regression with controls, its interval, and the weighted contrast of arms."""
    from pyspark.ml.regression import LinearRegression

    df = kept(df.select(*dict.fromkeys([outcome, "arm", treatment, *controls])), "controlled")
    rows = assemble(df, [treatment, *controls])
    fit = LinearRegression(labelCol=outcome, solver="normal").fit(rows)
    beta, se = float(fit.coefficients[0]), float(fit.summary.coefficientStandardErrors[0])
    weighted = apply_probability(fit_probability(df, "arm", controls), df, "_e")
    w1, w0 = F.col("arm") / F.greatest("_e", F.lit(0.01)), (1 - F.col("arm")) / F.greatest(1 - F.col("_e"), F.lit(0.01))
    ipw = weighted.agg((F.sum(w1 * F.col(outcome)) / F.sum(w1) - F.sum(w0 * F.col(outcome)) / F.sum(w0)).alias("ipw"))
    return ipw.withColumns({"beta": F.lit(beta), "ci_lo": F.lit(beta - 1.959964 * se), "ci_hi": F.lit(beta + 1.959964 * se)})


def permuted(df: DataFrame, column: str, key: str = "bidid", seeds: tuple[int, int] = (4, 5)) -> DataFrame:
    """df with a column's values dealt anew over the whole table: the row in k-th place by one hash gets the value of that in k-th place by another.

    Both orders are ranges, so no task holds more than one range of rows.
    """
    placed = lambda rows, seed: add_place(rows.withColumn("_h", F.xxhash64(key, F.lit(seed))), ["_h", key], "_k").drop("_h")
    return placed(df.drop(column), seeds[0]).join(placed(df.select(key, column), seeds[1]).select("_k", column), "_k").drop("_k")


def refute(df: DataFrame, outcome: str, controls: list[str], treatment: str = "bidprice") -> DataFrame:
    """The coefficient again with a random control, with the treatment permuted, and on 80 % of rows; `passed` within a tenth of the effect."""
    from pyspark.ml.regression import LinearRegression

    def beta(rows: DataFrame, names: list[str]) -> float:
        return float(LinearRegression(labelCol=outcome, solver="normal").fit(assemble(rows, names)).coefficients[0])

    df = kept(df.select(*dict.fromkeys(["bidid", outcome, treatment, *controls])), "refuted")
    base = beta(df, [treatment, *controls])
    noise = df.withColumn("_r", uniform("bidid", 21))
    rows = [("random_control", beta(noise, [treatment, *controls, "_r"])), ("permuted", beta(permuted(df, treatment), [treatment, *controls])), ("subset", beta(df.where(uniform("bidid", 6) < 0.8), [treatment, *controls]))]
    found = [(n, base, b, int(abs(b) <= 0.1 * abs(base) if n == "permuted" else abs(b - base) <= 0.1 * abs(base))) for n, b in rows]
    return df.sparkSession.createDataFrame(found, "test string, effect double, again double, passed int")


# --- clusters: tables of a few rows ------------------------------------------------


def heterogeneity(gaps: pd.DataFrame) -> dict[str, float]:
    """Cochran's Q with its p-value, I squared, tau squared and the fixed effect of (gap, se) rows."""
    w = 1 / (gaps["se"] ** 2).clip(lower=1e-30)
    mean = float((w * gaps["gap"]).sum() / w.sum())
    q = float((w * (gaps["gap"] - mean) ** 2).sum())
    df = len(gaps) - 1
    c = float(w.sum() - (w**2).sum() / w.sum())
    return {"q": q, "df": float(df), "p_value": tails.chi2_sf(q, df) if df > 0 else float("nan"), "i2": max(0.0, (q - df) / q) if q > 0 else 0.0, "tau2": max(0.0, (q - df) / c) if c > 0 else 0.0, "fixed_effect": mean}


def detectable(gaps: pd.Series, alpha: float = 0.05, power: float = 0.8) -> dict[str, float]:
    """C14: least detectable mean gap by cluster t, and clusters needed for the observed one."""
    k, mean, sd = len(gaps), float(gaps.mean()), float(gaps.std(ddof=1)) if len(gaps) > 1 else float("nan")
    se = sd / k**0.5
    mde = (tails.t_quantile(1 - alpha / 2, k - 1) + tails.t_quantile(power, k - 1)) * se if k > 1 else float("nan")
    z = tails.normal_quantile(1 - alpha / 2) + tails.normal_quantile(power)
    return {"k": float(k), "mean_gap": mean, "sd_between": sd, "mde_80": mde, "n_needed": (z * sd / abs(mean)) ** 2 if mean and k > 1 else float("inf")}


def sign_test(gaps: pd.Series) -> dict[str, float]:
    """C15."""
    k = int((gaps > 0).sum())
    return {"k_pos": float(k), "n": float(len(gaps)), "p_greater": tails.binomial_upper(k, len(gaps)) if len(gaps) else float("nan")}


def leave_one_out(gaps: DataFrame, cluster: str, gap: str = "gap") -> DataFrame:
    """Mean of the other clusters."""
    w = Window.partitionBy()
    n = F.count("*").over(w)
    return gaps.withColumn("loo_mean", (F.sum(gap).over(w) - F.col(gap)) / F.when(n > 1, n - 1))


def icc(df: DataFrame, cluster: str, cell: str, gap: str, least: int) -> DataFrame:
    """One-way intraclass correlation of cell means of `least` rows within clusters."""
    cells = df.groupBy(cluster, cell).agg(F.avg(gap).alias("y"), F.count("*").alias("c")).where(F.col("c") >= least)
    g = cells.groupBy(cluster).agg(F.count("*").cast("double").alias("n"), F.avg("y").alias("m"), F.coalesce(F.sum(F.col("y") * F.col("y")) - F.count("*") * F.avg("y") * F.avg("y"), F.lit(0.0)).alias("ss"))
    t = g.agg(F.sum("n").alias("N"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nm2"))
    msb = (F.col("nm2") - F.col("N") * F.col("grand") * F.col("grand")) / (F.col("k") - 1)
    msw = F.col("within") / (F.col("N") - F.col("k"))
    n0 = (F.col("N") - F.col("n2") / F.col("N")) / (F.col("k") - 1)
    return t.select(((msb - msw) / (msb + (n0 - 1) * msw)).alias("icc"), F.col("k").alias("n_clusters"), F.col("N").cast("long").alias("n_cells"))


def report(gaps: DataFrame, name: str) -> DataFrame:
    """C17: heterogeneity, detectable effect, sign test and verdict of a table (cluster, gap, se) of a few clusters."""
    pdf = gaps.toPandas()
    found = heterogeneity(pdf) | detectable(pdf["gap"]) | sign_test(pdf["gap"])
    found["verdict"] = "heterogeneous" if found["p_value"] < 0.05 else "detectable" if abs(found["mean_gap"]) > found["mde_80"] else "inconclusive"
    keys = ["q", "df", "p_value", "i2", "tau2", "fixed_effect", "mean_gap", "mde_80", "k_pos", "p_greater"]
    return gaps.sparkSession.createDataFrame([(name, *[float(found[k]) for k in keys], found["verdict"])], "comparison string, " + ", ".join(f"{k} double" for k in keys) + ", verdict string")
