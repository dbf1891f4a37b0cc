"""Ranking and calibration of scores (M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.columns import cross_entropy, fold
from gavel.operators import monotone
from gavel.operators.features import bin_right_closed, quantile_edges
from gavel.operators.order import quantiles
from gavel.sources.logs import kept

_RANGES = 4096


# Where `count` names a column, each row stands for that many equal ones.


def _sum(x: Column, count: str | None) -> Column:
    return F.sum(x * F.col(count)) if count else F.sum(x)


def _avg(x: Column, count: str | None) -> Column:
    return F.sum(x * F.col(count)) / F.sum(F.when(x.isNotNull(), F.col(count))) if count else F.avg(x)


def _rows(count: str | None) -> Column:
    return F.sum(count) if count else F.count("*")


def _counts(df: DataFrame, keys: tuple[str, ...], y: str, p: str, count: str | None = None) -> DataFrame:
    """Positives and others of each score, with the positives and others of all lower scores.

    Scores are counted first; running sums are taken over ranges of scores, then inside each range, so that no window
    holds all the scores of a key.
    """
    g = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(_sum(F.col(y), count).cast("double").alias("_pos"), _sum(1 - F.col(y), count).cast("double").alias("_neg"))
    g = g.withColumn("_r", F.floor(F.col("_p") * _RANGES))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = g.groupBy(*keys, "_r").agg(F.sum("_pos").alias("a"), F.sum("_neg").alias("b"))
    ranges = ranges.select(*keys, "_r", F.coalesce(F.sum("a").over(before), F.lit(0.0)).alias("_a"), F.coalesce(F.sum("b").over(before), F.lit(0.0)).alias("_b"))
    inside = Window.partitionBy(*keys, "_r").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    out = g.join(ranges, [*keys, "_r"])
    return out.withColumns({"_pos_before": F.col("_a") + F.coalesce(F.sum("_pos").over(inside), F.lit(0.0)), "_neg_before": F.col("_b") + F.coalesce(F.sum("_neg").over(inside), F.lit(0.0))})


def auc(df: DataFrame, *keys: str, y: str = "click", p: str = "p", count: str | None = None) -> DataFrame:
    """M1: area under the ROC curve with ties at their average rank; null where one class is missing."""
    c = _counts(df, keys, y, p, count)
    area = F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / 2))
    pairs = F.sum("_pos") * F.sum("_neg")
    return c.groupBy(*keys).agg((area / F.when(pairs > 0, pairs)).alias("auc"))


def roc_points(df: DataFrame, *keys: str, y: str = "click", p: str = "p") -> DataFrame:
    """(p, tpr, fpr) at each score, from the highest."""
    c = _counts(df, keys, y, p)
    total = c.groupBy(*keys).agg(F.sum("_pos").alias("_allpos"), F.sum("_neg").alias("_allneg"))
    both = c.join(F.broadcast(total), list(keys)) if keys else c.crossJoin(F.broadcast(total))
    return both.select(*keys, F.col("_p").alias("p"), (1 - F.col("_pos_before") / F.col("_allpos")).alias("tpr"), (1 - F.col("_neg_before") / F.col("_allneg")).alias("fpr"))


def histogram(df: DataFrame, *keys: str, p: str = "p", bins: int = 20, top: float = 0.995) -> DataFrame:
    """Scores up to a quantile in equal bins."""
    edge = quantiles(df, p, [top], keys).select(*keys, F.col("edge").alias("_top"))
    rows = df.join(F.broadcast(edge), list(keys)) if keys else df.crossJoin(F.broadcast(edge))
    at = F.least(F.floor(F.col(p) * bins / F.col("_top")), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(p) <= F.col("_top")).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def equal_width(df: DataFrame, *keys: str, y: str = "click", p: str = "p", n: int = 10, count: str | None = None) -> DataFrame:
    """Rows, mean score and mean label in n equal bins [lo, hi); a score of exactly 1 is in none."""
    b = F.floor(F.col(p) * n).cast("int")
    return df.where((F.col(p) >= 0) & (F.col(p) < 1)).groupBy(*keys, b.alias("bin")).agg(_rows(count).alias("n"), _avg(F.col(p), count).alias("mean_p"), _avg(F.col(y), count).alias("mean_y"))


def ece(df: DataFrame, *keys: str, y: str = "click", p: str = "p", n: int = 10, count: str | None = None) -> DataFrame:
    """M2: gaps of equal bins, weighted by rows of all scores."""
    total = df.groupBy(*keys).agg(_rows(count).alias("_t"))
    gap = equal_width(df, *keys, y=y, p=p, n=n, count=count).groupBy(*keys).agg(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))).alias("_g"))
    both = total.join(gap, list(keys), "left") if keys else total.crossJoin(gap)
    return both.select(*keys, (F.coalesce("_g", F.lit(0.0)) / F.col("_t")).alias("ece"))


def mean_gap(df: DataFrame, *keys: str, y: str = "click", p: str = "p", n: int = 10) -> DataFrame:
    """M5: unweighted mean of the gaps of non-empty equal bins."""
    return equal_width(df, *keys, y=y, p=p, n=n).groupBy(*keys).agg(F.avg(F.abs(F.col("mean_p") - F.col("mean_y"))).alias("mean_gap"), F.count("*").alias("n_bins"))


def slice_summary(table: DataFrame) -> DataFrame:
    """M9: over a table of slices, the largest and the row-weighted mean absolute bias."""
    size = F.abs("bias")
    return table.agg(F.max(size).alias("max_bias"), (F.sum(F.col("n") * size) / F.sum("n")).alias("weighted_bias"), F.count("*").alias("n_slices"))


def ieb(y: str = "click", p: str = "p", count: str | None = None) -> Column:
    """M3: relative difference of means, by an aggregate."""
    mean_p, mean_y = _avg(F.col(p), count), _avg(F.col(y), count)
    return F.abs(mean_p - mean_y) / F.greatest(mean_y, F.lit(1e-8))


def rel_bias(y: str = "click", p: str = "p") -> Column:
    """Signed relative difference of means, positive where scores are too high."""
    return (F.avg(p) - F.avg(y)) / F.greatest(F.avg(y), F.lit(1e-8))


def bundle(df: DataFrame, *keys: str, y: str = "click", p: str = "p", cut: float = 0.5, count: str | None = None) -> DataFrame:
    """M4, M5: AUC, log-loss, accuracy, precision, recall, F1, ECE, IEB, Brier; rows with NaN scores go."""
    df = df.where(~F.isnan(p) & F.col(p).isNotNull())
    hit, true = (F.col(p) >= cut).cast("int"), F.col(y)
    tp, fp, fn = _sum(hit * true, count), _sum(hit * (1 - true), count), _sum((1 - hit) * true, count)
    safe = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    got = df.groupBy(*keys).agg(_rows(count).alias("n"), _avg(cross_entropy(p, y), count).alias("log_loss"), _avg((hit == true).cast("int"), count).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), ieb(y, p, count).alias("ieb"), _avg((F.col(p) - true) * (F.col(p) - true), count).alias("brier"))
    return got.join(auc(df, *keys, y=y, p=p, count=count), list(keys)).join(ece(df, *keys, y=y, p=p, count=count), list(keys))


def quantile_bins(df: DataFrame, p: str, n: int) -> Column:
    """M6: index of a score's quantile bin, right-closed, repeated edges dropped; one bin where scores are all equal."""
    edges = quantile_edges(df, p, [i / n for i in range(n + 1)])
    return bin_right_closed(F.col(p), edges) if len(edges) > 2 else F.lit(0)


def reliability(df: DataFrame, *keys: str, y: str = "click", p: str = "p", n: int = 10, left_closed: bool = False) -> DataFrame:
    """M7, M8: rows, mean score, mean label and bias of each quantile bin, with bins numbered densely. keys share the edges."""
    edges = quantile_edges(df, p, [i / n for i in range(n + 1)])
    if left_closed:
        at = sum(((F.col(p) >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    else:
        at = bin_right_closed(F.col(p), edges) if len(edges) > 2 else F.lit(0)
    g = df.groupBy(*keys, at.alias("_b")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    return g.withColumns({"bin": F.row_number().over(Window.partitionBy(*keys).orderBy("_b")) - 1, "bias": F.col("mean_p") - F.col("mean_y")}).drop("_b")


def quantile_ece(table: DataFrame, *keys: str) -> DataFrame:
    """Row-weighted mean of the bins' absolute biases, and the largest."""
    return table.groupBy(*keys).agg((F.sum(F.col("n") * F.abs("bias")) / F.sum("n")).alias("quantile_ece"), F.max(F.abs("bias")).alias("max_bias"), F.count("*").alias("n_bins"))


def slices(df: DataFrame, key: str, y: str = "click", p: str = "p", n: int = 10) -> DataFrame:
    """M9: signed bias and ECE within each slice."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    return g.withColumn("bias", F.col("mean_p") - F.col("mean_y")).join(ece(df, key, y=y, p=p, n=n), key)


def decile_off(table: DataFrame, *keys: str) -> DataFrame:
    """Bins whose mean score is under 0.8 or over 1.25 times the mean label, and signs of biases."""
    r = F.col("mean_p") / F.when(F.col("mean_y") > 0, F.col("mean_y"))
    return table.groupBy(*keys).agg(F.count_if(r < 0.8).alias("under"), F.count_if(r > 1.25).alias("over"), F.count_if(F.col("bias") > 0).alias("positive"), F.count_if(F.col("bias") < 0).alias("negative"))


def by_group(df: DataFrame, key: str, y: str = "click", p: str = "p") -> DataFrame:
    """Rows, AUC and IEB of each group."""
    return df.groupBy(key).agg(F.count("*").alias("n"), ieb(y, p).alias("ieb"), rel_bias(y, p).alias("rel_bias")).join(auc(df, key, y=y, p=p), key)


def _cells(df: DataFrame, y: str, p: str, weight: str | None, *keys: str) -> DataFrame:
    """Sums of labels and weights of each score."""
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(*keys, F.col(p).alias("x")).agg(F.sum(F.col(y) * w).alias("s"), F.sum(w).alias("w"))


def _other_folds(cells: DataFrame, k: int, *keys: str) -> DataFrame:
    """Cells by fold `_f` as the cells that each fold's map is fitted on: those of all other folds."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i != F.col("_f"))
    return cells.withColumn("_f", F.explode(others)).groupBy(*keys, "_f", "x").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def isotonic(train: DataFrame, df: DataFrame, y: str = "click", p: str = "p", out: str = "calibrated", weight: str | None = None) -> DataFrame:
    """A monotone map fitted on train and applied to df, clipped outside train's scores."""
    return monotone.mapped(df, p, monotone.blocks(_cells(train, y, p, weight), []), [], out)


def cross_fit(df: DataFrame, k: int = 5, y: str = "click", p: str = "p", key: str = "bidid") -> DataFrame:
    """Each fold gets the map of the other folds; the k maps are fitted in one pass."""
    df = df.withColumn("_f", fold(key, k))
    fitted = monotone.blocks(_other_folds(_cells(df, y, p, None, "_f"), k), ["_f"])
    return monotone.mapped(df, p, fitted, ["_f"], "calibrated").drop("_f")


def averaged_maps(train: DataFrame, df: DataFrame, k: int = 5, y: str = "click", p: str = "p", key: str = "bidid") -> DataFrame:
    """The mean of k out-of-fold maps, applied to all rows."""
    fitted = monotone.blocks(_other_folds(_cells(train.withColumn("_f", fold(key, k)), y, p, None, "_f"), k), ["_f"])
    points = df.select(F.col(p).alias("x")).distinct().withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    means = kept(monotone.values(points, fitted, ["_f"]).groupBy(F.col("x").alias("_x")).agg((F.sum("g") / k).alias("calibrated")), "maps")
    return df.join(means, F.col(p) == F.col("_x"), "left").drop("_x")


def segment_cross_fit(df: DataFrame, segment: str, k: int = 5, least: int = 50, y: str = "click", p: str = "p", key: str = "bidid") -> DataFrame:
    """Cross-fitted maps by segment where the other folds have `least` positives, else the global map's value.

    The segments' maps are fitted on score cells of 1e-4, all in one pass.
    """
    df = df.withColumns({"_f": fold(key, k), "_x": F.bround(F.col(p), 4)})
    train = _other_folds(_cells(df, y, "_x", None, segment, "_f"), k, segment)
    enough = train.groupBy(segment, "_f").agg(F.sum("s").alias("_n")).where(F.col("_n") >= least).drop("_n")
    fitted = monotone.blocks(train.join(enough, [segment, "_f"]), [segment, "_f"])
    own = monotone.mapped(cross_fit(df.drop("_f"), k, y, p, key).withColumn("_f", fold(key, k)), "_x", fitted, [segment, "_f"], "own")
    return own.withColumn("calibrated", F.coalesce("own", "calibrated")).drop("own", "_f", "_x")


def feature_ranks(df: DataFrame, p: str, features: list[str]) -> DataFrame:
    """A model's features ranked by the size of their correlation with its scores: feature, rank."""
    strengths = df.agg(*[F.abs(F.corr(c, p)).alias(c) for c in features]).unpivot([], features, "feature", "strength")
    return strengths.select("feature", F.rank().over(Window.orderBy(F.desc("strength"))).alias("rank"))  # one row for each feature


def average_ranks(df: DataFrame, *columns: str) -> DataFrame:
    """<c>_rank, average ranks of a small table's columns."""
    for c in columns:
        df = df.withColumn(f"{c}_rank", F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2)
    return df


def best_flags(df: DataFrame, higher: list[str], lower: list[str]) -> DataFrame:
    """best_<metric> is 1 for the best row of a model table."""
    for m in higher + lower:
        order = F.desc(m) if m in higher else F.asc(m)
        df = df.withColumn(f"best_{m}", (F.rank().over(Window.orderBy(order)) == 1).cast("int"))
    return df
