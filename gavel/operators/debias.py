"""Selection bias: propensities, weights, diagnosis and debiased fits (D)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.columns import cross_entropy, effect_label, fold
from gavel.functions.tails import ks_p
from gavel.operators import metrics
from gavel.operators.explore import ks
from gavel.operators.features import bin_right_closed, quantile_edges
from gavel.operators.order import add_sums_before
from gavel.sources.logs import kept

FEATURES = ["slotprice", "bidprice", "hour", "region", "slotwidth", "slotheight"]


def assemble(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


#: Rows of a task of a fit.
FIT_ROWS = 200_000


def dealt(df: DataFrame, name: str) -> DataFrame:
    """df's rows, stored, in tasks of about FIT_ROWS rows: fits unpack a task's rows several times over, however few bytes they take in files."""
    held = kept(df, name)
    n = held.count()
    return held.repartition(-(-n // FIT_ROWS)) if n > FIT_ROWS else held


@dataclass
class LinearProbability:
    """A logistic regression as numbers: it scores by a column expression, whatever session or training data it comes from."""

    features: list[str]
    centre: list[float]
    slope: list[float]  # per unit of the feature
    intercept: float

    def column(self) -> Column:
        """The probability; a missing feature makes it NaN, as in fitted pipelines."""
        z: Column = F.lit(self.intercept)
        for c, m, k in zip(self.features, self.centre, self.slope, strict=True):
            z = z + (F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) - m) * k
        return 1 / (1 + F.exp(-z))


def fit_pipeline(train: DataFrame, label: str, features: list[str] = FEATURES, kind: str = "linear", weight: str | None = None):
    """A pipeline, which can be saved and loaded, that gives `probability` of label: scaled logistic regression or boosted trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    extra = {"weightCol": weight} if weight else {}
    train = dealt(train.select(*dict.fromkeys([*features, label, *extra.values()])), "train")  # fits read it several times
    join = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep")
    if kind == "linear":
        stages = [join, StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=25, **extra)]
    else:
        stages = [join, GBTClassifier(featuresCol="raw", labelCol=label, maxIter=8, maxDepth=4, seed=7, **extra)]
    return Pipeline(stages=stages).fit(train)


def fit_probability(train: DataFrame, label: str, features: list[str] = FEATURES, kind: str = "linear", weight: str | None = None):
    """fit_pipeline's model; a linear one as a LinearProbability, as Spark's own drags its training session along."""
    model = fit_pipeline(train, label, features, kind, weight)
    if kind != "linear":
        return model
    _, scaler, fit = model.stages
    spread, beta = scaler.std.toArray(), fit.coefficients.toArray()
    slope = [float(b / s) if s else 0.0 for b, s in zip(beta, spread, strict=True)]
    return LinearProbability(list(features), [float(m) for m in scaler.mean], slope, float(fit.intercept))


def moments(df: DataFrame, columns: list[str], count: str) -> tuple[dict[str, float], dict[str, float]]:
    """Means and deviations (0 of a single row) of columns of which a row stands for `count` equal ones."""
    rows = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col(count)))
    mean = df.agg(*[(F.sum(F.col(c).cast("double") * F.col(count)) / rows(c)).alias(c) for c in columns]).first().asDict()
    off = lambda c: F.col(c) - F.lit(mean[c])
    spread = df.agg(*[F.sqrt(F.sum(off(c) * off(c) * F.col(count)) / F.nullif(rows(c) - 1, F.lit(0))).alias(c) for c in columns]).first().asDict()
    return mean, {c: x or 0.0 for c, x in spread.items()}


def fit_counted(train: DataFrame, label: str, features: list[str] = FEATURES, kind: str = "linear", count: str = "_n"):
    """fit_probability's model of stored rows that stand for `count` equal ones each: the same likelihood and gains, of fewer rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    if kind != "linear":
        join = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep")
        return Pipeline(stages=[join, GBTClassifier(featuresCol="raw", labelCol=label, weightCol=count, maxIter=8, maxDepth=4, seed=7)]).fit(train)
    mean, spread = moments(train, features, count)
    scaled = [((F.col(c) - mean[c]) / spread[c] if spread[c] else F.lit(0.0)).alias(c) for c in features]
    fit = LogisticRegression(labelCol=label, weightCol=count, maxIter=25).fit(assemble(train.select(*scaled, label, count), features))
    slope = [float(b / spread[c]) if spread[c] else 0.0 for b, c in zip(fit.coefficients.toArray(), features, strict=True)]
    return LinearProbability(list(features), [float(mean[c]) for c in features], slope, float(fit.intercept))


def apply_probability(model, df: DataFrame, out: str) -> DataFrame:
    if isinstance(model, LinearProbability):
        return df.withColumn(out, model.column())
    from pyspark.ml.functions import vector_to_array

    keep = [F.col(c) for c in df.columns]
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(out))


def importances(model, features: list[str], spread: dict[str, float]) -> list[tuple[str, float]]:
    """How much each feature counts, in shares: split gains of trees, or slopes of a linear model in deviations of its features (`spread`)."""
    if isinstance(model, LinearProbability):
        raw = [abs(k) * spread[c] for c, k in zip(model.features, model.slope, strict=True)]
    else:
        raw = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    total = sum(raw)
    return [(c, x / total if total else 0.0) for c, x in zip(features, raw, strict=True)]


def cross_fit_propensity(df: DataFrame, label: str = "win", k: int = 3, features: list[str] = FEATURES, kind: str = "linear", calibrate: bool = False, out: str = "e") -> DataFrame:
    """Out-of-fold probability of winning; with calibrate, an isotonic map fitted on the other folds' scores."""
    df = kept(df.withColumn("_f", fold("bidid", k)), "folds")
    parts = []
    for i in range(k):
        train = df.where(F.col("_f") != i)
        model = fit_probability(train, label, features, kind)
        held = apply_probability(model, df.where(F.col("_f") == i), out)
        if calibrate:
            held = metrics.isotonic(apply_probability(model, train, out), held, label, out, "_c").withColumn(out, F.col("_c")).drop("_c")
        parts.append(held)
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result.drop("_f")


def ensemble_propensity(train: DataFrame, df: DataFrame, label: str = "win", k: int = 3, out: str = "e") -> DataFrame:
    """The mean over the folds' models on new rows."""
    train = kept(train.withColumn("_f", fold("bidid", k)), "folds")
    for i in range(k):
        df = apply_probability(fit_probability(train.where(F.col("_f") != i), label), df, f"_e{i}")
    return df.withColumn(out, sum((F.col(f"_e{i}") for i in range(k)), F.lit(0.0)) / k).drop(*[f"_e{i}" for i in range(k)])


def clipped(p: str, lo: float = 0.01, hi: float = 0.99) -> Column:
    return F.least(F.greatest(F.col(p), F.lit(lo)), F.lit(hi))


def win_weights(df: DataFrame, p: str = "e", lo: float = 0.01, hi: float = 0.99, normalise: bool = True) -> DataFrame:
    """`w` = win / clipped p, scaled to sum to the rows if asked."""
    out = df.withColumn("w", F.col("win") / clipped(p, lo, hi))
    if not normalise:
        return out
    total = out.agg((F.count("*") / F.greatest(F.sum("w"), F.lit(1e-8))).alias("_k"))
    return out.crossJoin(F.broadcast(total)).withColumn("w", F.col("w") * F.col("_k")).drop("_k")


def diagnose(df: DataFrame, p: str = "e") -> DataFrame:
    """AUC, overlap, extremes, effective sample size, and whether positivity looks violated."""
    w = F.col("win") / clipped(p)
    share = lambda c: F.avg(c.cast("int"))
    got = df.agg(share((F.col(p) > 0.1) & (F.col(p) < 0.9)).alias("overlap_10"), share((F.col(p) > 0.05) & (F.col(p) < 0.95)).alias("overlap_05"), share(F.col(p) < 0.01).alias("extreme_low"), share(F.col(p) > 0.99).alias("extreme_high"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"), F.count("*").alias("n"))
    return got.crossJoin(metrics.auc(df, y="win", p=p)).withColumns({"ess_ratio": F.col("ess") / F.col("n"), "violated": (F.col("auc") > 0.9).cast("int")})


def weight_statistics(df: DataFrame, w: str = "w") -> DataFrame:
    """Moments, extremes and effective sample size of weights, over all rows and over winners."""
    won = F.when(F.col("win") == 1, F.col(w))
    return df.agg(F.avg(w).alias("mean"), F.stddev_pop(w).alias("std"), F.max(w).alias("most"), (F.sum(w) * F.sum(w) / F.sum(F.col(w) * F.col(w))).alias("ess"), (F.sum(won) * F.sum(won) / F.sum(won * won) / F.count(won)).alias("won_ess_ratio"))


def covariate_shift(df: DataFrame, group: str, features: list[str], alpha: float = 0.05) -> DataFrame:
    """By feature, KS distance of the two groups, its p-value, Cohen's d with its label, and significance; largest first."""
    from pyspark.sql.types import DoubleType

    long = df.select(F.col(group).alias("_g"), *[F.col(c).cast("double") for c in features]).unpivot(["_g"], features, "feature", "v")
    a, b = F.when(F.col("_g") == 1, F.col("v")), F.when(F.col("_g") == 0, F.col("v"))
    d = long.groupBy("feature").agg(((F.avg(a) - F.avg(b)) / F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)).alias("cohens_d"))
    table = ks(long, F.col("_g") == 1, "v", "feature").join(d, "feature")
    tail = F.udf(lambda x, m, n: float(ks_p(x, m * n / (m + n))) if m and n else None, DoubleType())  # one row for each feature
    return table.withColumn("p_value", tail("ks", "n1", "n0")).withColumns({"label": effect_label("cohens_d"), "significant": (F.col("p_value") < alpha).cast("int")}).orderBy(F.desc("ks"), "feature")


def _ctr(p: str, lo: float = 0.01, hi: float = 0.99) -> list[Column]:
    w = F.col("win") / clipped(p, lo, hi)
    top = F.sum(F.col("click") * w)
    return [F.count("*").alias("n"), F.sum("win").alias("n_wins"), F.sum("click").alias("n_clicks"), (F.sum("click") / F.greatest(F.sum("win"), F.lit(1)).cast("double")).alias("naive_ctr"), (top / F.greatest(F.sum(w), F.lit(1e-8))).alias("ipw_ctr"), (top / F.count("*")).alias("ht_ctr"), (F.sum(w) * F.sum(w) / F.greatest(F.sum(w * w), F.lit(1e-8))).alias("ess")]


def bucket_ctr(df: DataFrame, p: str = "e", buckets: int = 10, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Naive, self-normalised and Horvitz-Thompson CTR by propensity decile, and (bucket -1) over all rows."""
    df = df.withColumn("_p", clipped(p, lo, hi))
    edges = quantile_edges(df, "_p", [i / buckets for i in range(buckets + 1)])
    rows = df.groupBy((bin_right_closed(F.col("_p"), edges) if len(edges) > 2 else F.lit(0)).alias("bucket")).agg(*_ctr(p, lo, hi))
    return rows.unionByName(df.agg(*_ctr(p, lo, hi)).withColumn("bucket", F.lit(-1)))


def subgroup_bias(df: DataFrame, key: str, p: str = "e", least: int = 1) -> DataFrame:
    """Naive against weighted CTR by group of `least` clicks, percent bias and whether signs differ."""
    g = df.groupBy(key).agg(*_ctr(p)).where(F.col("n_clicks") >= least)
    g = g.withColumn("bias_pct", 100 * (F.col("naive_ctr") - F.col("ipw_ctr")) / F.greatest("ipw_ctr", F.lit(1e-8))).select(key, "n", "n_clicks", "naive_ctr", "ipw_ctr", "bias_pct")
    signs = g.agg((F.count_distinct(F.signum("bias_pct")) > 1).cast("int").alias("mixed"), F.max(F.abs("bias_pct")).alias("max_bias"))
    return g.crossJoin(F.broadcast(signs))


def feature_sensitivity(df: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Weighted CTR under propensities of several feature sets."""
    out = None
    for name, features in sets.items():
        row = cross_fit_propensity(df.select(*dict.fromkeys(["bidid", "win", "click", *features])), k=2, features=features).agg(*_ctr("e")).withColumn("features", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def clip_sensitivity(df: DataFrame, clips: list[tuple[float, float]], p: str = "e") -> DataFrame:
    """Weighted CTR and sample size under several clips."""
    cells = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in clips])
    rows = df.withColumn("_c", F.explode(cells)).select("*", "_c.*")
    w = F.col("win") / F.least(F.greatest(F.col(p), F.col("lo")), F.col("hi"))
    return rows.groupBy("lo", "hi").agg((F.sum(F.col("click") * w) / F.sum(w)).alias("ipw_ctr"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))


def bias_summary(df: DataFrame, outcome: str = "click", p: str = "e") -> DataFrame:
    """Naive and weighted mean of winners' outcome (weights clipped to 0.1..10) and their difference."""
    w = F.least(F.greatest(1 / F.col(p), F.lit(0.1)), F.lit(10.0))
    got = df.where("win = 1").agg(F.avg(outcome).alias("naive"), (F.sum(F.col(outcome) * w) / F.sum(w)).alias("ipw"))
    return got.withColumns({"bias": F.col("naive") - F.col("ipw"), "bias_pct": 100 * (F.col("naive") - F.col("ipw")) / F.col("ipw")})


def propensity_correlation(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Pearson and average-rank Spearman correlation of two score columns; scores are counted before they are ranked."""
    def ranks(c: str) -> DataFrame:
        g = df.groupBy(*keys, c).agg(F.count("*").alias("_n"))
        return add_sums_before(g, c, ["_n"], keys).select(*keys, c, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(f"{c}_rank"))

    both = df.join(ranks(a), [*keys, a]).join(ranks(b), [*keys, b])
    return both.groupBy(*keys).agg(F.corr(a, b).alias("pearson"), F.corr(f"{a}_rank", f"{b}_rank").alias("spearman"), F.avg(((F.col(a) > 0.1) & (F.col(a) < 0.9) & (F.col(b) > 0.001)).cast("int")).alias("joint_overlap"))


def click_models(df: DataFrame, p: str = "e", kind: str = "linear") -> DataFrame:
    """p_biased (fitted on winners) and p_ipw (winners weighted by 1 / clipped propensity), for all rows."""
    won = df.where("win = 1").withColumn("_w", 1 / F.greatest(F.col(p), F.lit(0.05)))
    out = apply_probability(fit_probability(won, "click", kind=kind), df, "p_biased")
    return apply_probability(fit_probability(won, "click", kind=kind, weight="_w"), out, "p_ipw")


def doubly_robust(df: DataFrame, p: str = "e") -> DataFrame:
    """p_dr: pseudo-labels clip(g + win / e (click - g), 0, 1) of an imputation g from winners, regressed on all rows."""
    from pyspark.ml.regression import LinearRegression

    with_g = apply_probability(fit_probability(df.where("win = 1"), "click"), df, "_g")
    pseudo = F.least(F.greatest(F.col("_g") + F.col("win") / F.greatest(F.col(p), F.lit(0.05)) * (F.col("click") - F.col("_g")), F.lit(0.0)), F.lit(1.0))
    rows = assemble(with_g.withColumn("_y", pseudo))
    model = LinearRegression(labelCol="_y", solver="normal").fit(rows)
    value: Column = F.lit(float(model.intercept))
    for c, k in zip(FEATURES, model.coefficients.toArray(), strict=True):
        value = value + F.col(c) * float(k)
    return with_g.withColumn("p_dr", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).drop("_g")


#: D16's tasks: name, label and the rows that it is fitted on.
TASKS = (("ctr", "click", "win = 1"), ("win", "win", "1 = 1"), ("ctr_all", "click", "1 = 1"))


def baseline_fits(df: DataFrame, split: str = "split", features: list[str] = FEATURES) -> tuple[DataFrame, dict]:
    """The distinct rows of the columns that the fits use, counted (_n) and stored, and by (task, model) the linear and tree fits on train."""
    used = kept(df.groupBy(*features, "win", "click", split).agg(F.count("*").alias("_n")), "baselines")
    fits = {}
    for task, label, where in TASKS:
        train = _task_train(used, label, where, split, features)
        for kind in ("linear", "trees"):
            fits[task, kind] = fit_counted(train, label, features, kind)
    return used, fits


def _task_train(used: DataFrame, label: str, where: str, split: str, features: list[str]) -> DataFrame:
    """A task's counted train rows, stored; in an order, as tree fits sample their split points by places."""
    rows = used.where(where).where(F.col(split) == "train").groupBy(*features, label).agg(F.sum("_n").alias("_n"))
    return dealt(rows.sortWithinPartitions(*features, label), "train")


def baseline_scores(used: DataFrame, fits: dict, split: str = "split") -> DataFrame:
    """(task, model, split, y, p, n) of each task's counted rows, stored, so that no metric scores them again."""
    out = None
    for task, label, where in TASKS:
        for kind in ("linear", "trees"):
            scored = apply_probability(fits[task, kind], used.where(where), "p")
            got = scored.select(F.lit(task).alias("task"), F.lit(kind).alias("model"), split, F.col(label).alias("y"), "p", F.col("_n").alias("n"))
            out = got if out is None else out.unionByName(got)
    return kept(out, "scored")


def baselines(df: DataFrame, split: str = "split") -> DataFrame:
    """For the tasks ctr (winners), win (all) and ctr_all (all, click), linear and tree fits on train and AUC on each split."""
    scored = baseline_scores(*baseline_fits(df, split), split)
    return metrics.auc(scored, split, "task", "model", y="y", p="p", count="n").select(split, "auc", "task", "model")


def baseline_metrics(df: DataFrame, split: str = "split", features: list[str] = FEATURES) -> DataFrame:
    """(task, model, split, M4's bundle) of linear and tree fits on train."""
    return _baseline_metrics(*baseline_fits(df, split, features), split)


def baseline_importances(df: DataFrame, split: str = "split", features: list[str] = FEATURES) -> DataFrame:
    """(task, model, feature, importance, rank) of linear and tree fits on train."""
    return _baseline_importances(*baseline_fits(df, split, features), split, features)


def baseline_report(df: DataFrame, split: str = "split", features: list[str] = FEATURES) -> tuple[DataFrame, DataFrame]:
    """baseline_metrics and baseline_importances of the same fits."""
    used, fits = baseline_fits(df, split, features)
    return _baseline_metrics(used, fits, split), _baseline_importances(used, fits, split, features)


def _baseline_metrics(used: DataFrame, fits: dict, split: str) -> DataFrame:
    return metrics.bundle(baseline_scores(used, fits, split), split, "task", "model", y="y", p="p", count="n")


def _baseline_importances(used: DataFrame, fits: dict, split: str, features: list[str]) -> DataFrame:
    weights = []
    for task, _, where in TASKS:
        train = used.where(where).where(F.col(split) == "train")
        _, spread = moments(train, features, "_n")
        for kind in ("linear", "trees"):
            weights += [(task, kind, c, x) for c, x in importances(fits[task, kind], features, spread)]
    table = used.sparkSession.createDataFrame(weights, "task string, model string, feature string, importance double")  # a row for each fit and feature
    return table.withColumn("rank", F.rank().over(Window.partitionBy("task", "model").orderBy(F.desc("importance"))))


def segment_weights(df: DataFrame, keys: list[str], p: str = "e") -> DataFrame:
    """Mean stabilised weight of each segment."""
    rate = df.agg(F.avg("win").alias("_r"))
    w = F.least(F.greatest(F.col("_r") / clipped(p, 0.05, 0.95), F.lit(0.5)), F.lit(5.0))
    return df.crossJoin(F.broadcast(rate)).groupBy(*keys).agg(F.avg(w).alias("weight"), F.count("*").alias("n"))


def tower_losses(df: DataFrame, p_win: str, p_ctr: str, imputed: str) -> DataFrame:
    """The terms of the joint objectives, averaged over a scored table: win, click on winners, weighted click, joint, imputation error and doubly robust risk."""
    e = F.greatest(F.col(p_win), F.lit(0.05))
    loss = cross_entropy(p_ctr, "click")
    miss = F.col("win") / e * (loss - F.col(imputed))
    joint = F.col(p_win) * F.col(p_ctr)
    return df.withColumn("_j", joint).agg(F.avg(cross_entropy(p_win, "win")).alias("win_loss"), F.avg(F.when(F.col("win") == 1, loss)).alias("ctr_loss"), F.avg(F.col("win") / e * loss).alias("ipw_loss"), F.avg(cross_entropy("_j", "click")).alias("joint_loss"), F.avg(F.when(F.col("win") == 1, (loss - F.col(imputed)) * (loss - F.col(imputed)))).alias("imputation_loss"), F.avg(F.col(imputed) + miss).alias("dr_loss"))
