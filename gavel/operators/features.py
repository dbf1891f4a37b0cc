"""Feature operators: time, slot, encodings, catalogue (F), splits (P) and statistics joined back to rows (J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gavel.functions.columns import bid_floor_ratio, col, fold, guarded, hash_bucket, is_peak, ts_hour, ts_minute, uniform, weekday
from gavel.operators.order import add_place, below, lowest, quantiles, rows_at
from gavel.sources.logs import kept

# Slot sizes (width, height) and their groups.
SLOT_GROUPS = {
    (120, 600): "skyscraper", (160, 600): "skyscraper", (300, 600): "skyscraper",
    (200, 200): "square", (250, 250): "square",
    (300, 250): "medium_rectangle", (336, 280): "medium_rectangle",
    (300, 50): "mobile", (320, 50): "mobile", (320, 100): "mobile",
    (468, 60): "banner",
    (728, 90): "leaderboard", (970, 90): "leaderboard", (970, 250): "leaderboard",
}
# Advertisers and their campaign kinds, and the kinds' codes.
TAXONOMY = {1458: "branding", 2259: "retargeting", 2261: "branding", 2821: "retargeting", 2997: "branding", 3358: "retargeting", 3386: "branding", 3427: "branding", 3476: "mixed"}
TAXONOMY_CODES = {"branding": 0, "retargeting": 1, "mixed": 2}
CATEGORICAL = ["region", "city", "adexchange", "slotwidth", "slotheight", "slotvisibility", "slotformat", "advertiser", "hour", "minute", "weekday", "is_weekend", "is_peak_hour"]
NUMERICAL = ["slotprice", "bidprice", "hour_sin", "hour_cos", "slot_area", "slot_area_log", "slot_aspect_ratio", "bid_floor_ratio"]


def add_time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """hour, minute, weekday, weekend, peak hour and the hour's angle; a bad date gives nulls."""
    day = weekday(ts)
    angle = 2 * 3.141592653589793 * ts_hour(ts) / 24
    return df.withColumns({"hour": ts_hour(ts), "minute": ts_minute(ts), "weekday": day, "is_weekend": (day >= 5).cast("int"), "is_peak_hour": is_peak(ts_hour(ts)), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle)})


def season_of(ts: str = "timestamp") -> Column:
    """the season by month."""
    return F.when(F.substring(ts, 5, 2) == "06", 2).otherwise(3)


def _lookup(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed list as a table; it is broadcast, as its size does not depend on data."""
    names = schema.split(", ")
    values = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    return F.broadcast(df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n.split()[0] for n in names)})"))


def add_slot_features(df: DataFrame) -> DataFrame:
    """area, its log, aspect ratio (height 0 counts as 1) and size group; other pairs are `other`, null sides `unknown`."""
    groups = _lookup(df, [(w, h, g) for (w, h), g in SLOT_GROUPS.items()], "slotwidth int, slotheight int, _group string")
    area = F.col("slotwidth").cast("double") * F.col("slotheight")
    height = F.when(F.col("slotheight") == 0, 1).otherwise(F.col("slotheight"))
    out = df.withColumns({"slot_area": area, "slot_area_log": F.log1p(area), "slot_aspect_ratio": F.bround(F.col("slotwidth") / height.cast("double"), 2)}).join(groups, ["slotwidth", "slotheight"], "left")
    group = F.when(F.col("slotwidth").isNull() | F.col("slotheight").isNull(), "unknown").otherwise(F.coalesce("_group", F.lit("other")))
    return out.withColumn("slot_size_group", group).drop("_group")


def add_bid_floor_ratio(df: DataFrame) -> DataFrame:
    """F6."""
    return df.withColumn("bid_floor_ratio", bid_floor_ratio("bidprice", "slotprice"))


def add_hash_buckets(df: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """columns <name>_hash."""
    return df.withColumns({f"{c}_hash": hash_bucket(c, buckets) for c in columns})


def add_frequency(df: DataFrame, key: str, fit_on: DataFrame | None = None) -> DataFrame:
    """F8: <key>_freq and its log1p; counted on fit_on (default: df); unseen and null keys are 0.

    Counts are stored, so that Spark knows their size: where they are small, df's rows are not shuffled to meet them.
    """
    counts = kept((df if fit_on is None else fit_on).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"{key}_freq")), "counts")
    out = df.join(counts, key, "left").withColumn(f"{key}_freq", F.coalesce(f"{key}_freq", F.lit(0)))
    return out.withColumn(f"{key}_freq_log", F.log1p(F.col(f"{key}_freq").cast("double")))


def quantile_edges(df: DataFrame, value: str, qs: list[float]) -> list[float]:
    """Distinct exact quantiles, ascending: as many values as qs at most."""
    return sorted({r["edge"] for r in quantiles(df, value, qs).collect()})


def bin_right_closed(value: Column, edges: list[float]) -> Column:
    """Index of the bin (edge[i], edge[i+1]] of a value, the first closed on both sides."""
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + (value > e).cast("int")
    return out


def add_frequency_group(df: DataFrame, freq: str, out: str) -> DataFrame:
    """quartile group of a frequency over rows, with repeated edges dropped; `medium` where only one bin is left."""
    edges = quantile_edges(df, freq, [0.0, 0.25, 0.5, 0.75, 1.0])
    if len(edges) < 3:
        return df.withColumn(out, F.lit("medium"))
    names = F.array(*[F.lit(x) for x in ("low", "medium", "high", "very_high")][: len(edges) - 1])
    return df.withColumn(out, names[bin_right_closed(F.col(freq), edges)])


def catalogue(df: DataFrame, skip: set[str] = frozenset({"bidid", "timestamp", "win", "click", "conversion", "payprice", "market_truth", "usertag"})) -> DataFrame:
    """feature, kind (categorical by the explicit set, else numerical by type), group, and vocabulary size (largest code + 2; null for others)."""
    rows = []
    for name, kind in df.dtypes:
        if name in skip or (name not in CATEGORICAL and kind == "string"):
            continue
        group = "time" if name in ("hour", "minute", "weekday", "is_weekend", "is_peak_hour", "hour_sin", "hour_cos") else "slot" if name.startswith("slot") else "geo" if name in ("region", "city") else "price" if "price" in name or "ratio" in name else "campaign" if name in ("advertiser", "adexchange") else "other"
        rows.append((name, "categorical" if name in CATEGORICAL else "numerical", group))
    sizes = df.agg(*[F.max(F.col(n)).cast("long").alias(n) for n, k, _ in rows if k == "categorical"])
    cats = [n for n, k, _ in rows if k == "categorical"]
    long = sizes.unpivot([], cats, "feature", "top").select("feature", (F.col("top") + 2).alias("vocab_size"))
    return _lookup(df, rows, "feature string, kind string, grp string").join(long, "feature", "left").select("feature", "kind", F.col("grp").alias("feature_group"), "vocab_size")


def engineer(df: DataFrame, *, time: bool = True, slot: bool = True, competition: bool = True, hashes: bool = True, frequency: bool = True) -> DataFrame:
    """the switched steps, one after another; frequencies are counted on the rows as they come in."""
    raw = df
    steps = [(time, add_time_features), (slot, add_slot_features), (competition, add_bid_floor_ratio), (hashes, lambda d: add_hash_buckets(d, ["domain", "creative"], 10_000)), (frequency, lambda d: add_frequency(add_frequency(d, "domain", raw), "creative", raw))]
    for on, step in steps:
        df = df.transform(step) if on else df
    return df


def normalisation_stats(df: DataFrame, columns: list[str], sample: bool = False) -> DataFrame:
    """One row of <c>_mean and <c>_std; population deviation floored at 1e-8, or (sample) sample deviation with a floor to 1."""
    dev = F.stddev_samp if sample else F.stddev_pop
    aggs = []
    for c in columns:
        s = dev(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), (F.when(s < 1e-8, 1.0).otherwise(s) if sample else F.greatest(s, F.lit(1e-8))).alias(f"{c}_std")]
    return df.agg(*aggs)


def z_score(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """columns replaced by z-scores of a one-row stats table."""
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).drop(*stats.columns)


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """nulls of categorical codes become 0, then whole numbers."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in columns})


def code_strings(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """<c>_code, places of strings in the sorted list of all values of fit_on; null and unseen are -1.

    Values are made distinct before they are ordered, and ordered by ranges.
    """
    for c in columns:
        values = (df if fit_on is None else fit_on).select(c).where(F.col(c).isNotNull()).distinct()
        codes = add_place(values, [c], "_code")
        df = df.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce("_code", F.lit(-1)).cast("int")).drop("_code")
    return df


def one_hot(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """`features` vectors of one-hot codes of columns and the plain numbers of keep."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    index = StringIndexer(inputCols=columns, outputCols=[f"{c}_ix" for c in columns], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_ix" for c in columns], outputCols=[f"{c}_hot" for c in columns])
    join = VectorAssembler(inputCols=[f"{c}_hot" for c in columns] + keep, outputCol="features")
    return Pipeline(stages=[index, hot, join]).fit(df).transform(df).drop(*[f"{c}_{s}" for c in columns for s in ("ix", "hot")])


def add_taxonomy(df: DataFrame) -> DataFrame:
    """F16: campaign kind and its code; unknown and -1 for other advertisers."""
    dim = _lookup(df, [(a, k, TAXONOMY_CODES[k]) for a, k in TAXONOMY.items()], "advertiser int, _kind string, _code int")
    return df.join(dim, "advertiser", "left").withColumns({"taxonomy": F.coalesce("_kind", F.lit("unknown")), "taxonomy_code": F.coalesce("_code", F.lit(-1))}).drop("_kind", "_code")


def quality_flags(df: DataFrame, least: int = 20, top: int = 10) -> DataFrame:
    """domain tier, popup, unknown visibility, binding floor and top-domain group of each row."""
    stats = df.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"), F.sum("win").alias("w"), F.sum("click").alias("c"))
    leaders = stats.orderBy(F.desc("n"), "domain").limit(top).select("domain", F.lit(1).alias("lead"))
    tier = F.when((F.col("n") >= least) & (F.col("w") == 0), "zero_win").when((F.col("w") >= least) & (F.col("c") == 0), "zero_click").otherwise("normal")
    out = df.join(stats.select("domain", tier.alias("tier")), "domain", "left").join(F.broadcast(leaders), "domain", "left")
    return out.withColumns({"domain_tier": F.coalesce("tier", F.lit("normal")), "is_popup": (F.col("slotformat") == 5).cast("int"), "visibility_unknown": (F.col("slotvisibility") == 255).cast("int"), "floor_binding": ((F.col("win") == 1) & (F.col("slotprice") > 0) & (F.col("payprice") == F.col("slotprice"))).cast("int"), "domain_group": F.when(F.col("lead") == 1, F.col("domain")).otherwise("other")}).drop("tier", "lead")


# --- splits -------------------------------------------------------------


def split_temporal(df: DataFrame, order: list[str], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """`split` by place in time, cut at whole numbers of n times the shares.

    The order keys at the two cuts are found over the key columns alone, which are stored for the passes over them;
    rows are then compared with the cuts where they are, without a shuffle. order should tell rows apart: rows of
    equal keys stay together.
    """
    keyed = kept(df.select(*order), "keys")
    n = keyed.count()
    a, b = int(n * train), int(n * (train + val))
    cuts = rows_at(keyed, order, [a, b])
    before = lambda at: below(df, order, cuts[at]) if at in cuts else F.lit(True)
    return df.withColumn("split", F.when(before(a), "train").when(before(b), "val").otherwise("test"))


def split_days(df: DataFrame, train: list[int], val: list[int], test: list[int]) -> DataFrame:
    """`split` by lists of days; other days go."""
    named = F.when(F.col("day").isin(train), "train").when(F.col("day").isin(val), "val").when(F.col("day").isin(test), "test")
    return df.where(F.col("day").isin(train + val + test)).withColumn("split", named)


def _first_at(n: int, share: float) -> int:
    """The first whole number i with i / n of at least share."""
    i = max(0, int(n * share) - 1)
    while i < n and i / n < share:
        i += 1
    return i


def split_by_group(df: DataFrame, group: str, order: list[str], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """`split` by place in time within each group.

    As in split_temporal, the keys at each group's cuts are found over key columns alone, however large a group is;
    the cuts, a row for each group, are joined back. Groups are few: their sizes and cuts pass through the driver.
    """
    keys = [group, *[c for c in order if c != group]]
    keyed = kept(df.select(*keys), "keys")
    sizes = keyed.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.col(group).asc_nulls_first()).collect()
    places, at = [], 0
    for r in sizes:
        # A cut behind the group's last row is no place of the group.
        places.append([at + i if i < r["n"] else None for i in (_first_at(r["n"], train), _first_at(r["n"], round(train + val, 9)))])
        at += r["n"]
    found = rows_at(keyed, keys, [p for pair in places for p in pair if p is not None])
    fields = [f for f in df.select(*keys[1:]).schema.fields]
    cut = StructType([StructField(f.name, f.dataType) for f in fields])
    schema = StructType([StructField("_g", df.schema[group].dataType), StructField("_a", cut), StructField("_b", cut)])
    rows = [(r[group], *[None if p is None else tuple(found[p][c] for c in keys[1:]) for p in pair]) for r, pair in zip(sizes, places, strict=True)]
    cuts = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # one row for each group
    own = F.struct(*keys[1:])
    named = F.when(F.col("_a").isNull() | (own < F.col("_a")), "train").when(F.col("_b").isNull() | (own < F.col("_b")), "val").otherwise("test")
    return df.join(cuts, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("split", named).drop("_g", "_a", "_b")


def vocabulary_audit(df: DataFrame, column: str) -> DataFrame:
    """Of each split: distinct values, those that train has too, and whether all are."""
    seen = df.select("split", column).distinct()
    train = seen.where("split = 'train'").select(column).distinct()
    both = seen.join(train, column, "left_semi").groupBy("split").agg(F.count("*").alias("shared"))
    return seen.groupBy("split").agg(F.count("*").alias("n_values")).join(both, "split", "left").select("split", "n_values", F.coalesce("shared", F.lit(0)).alias("shared"), (F.col("n_values") == F.coalesce("shared", F.lit(0))).cast("int").alias("is_subset"))


def stratified_sample(df: DataFrame, label: str, n: int, key: str = "bidid", seed: int = 42) -> DataFrame:
    """P5: about n rows with the label's shares kept: in each stratum, the rows of a hash below n / rows."""
    total = df.count()
    return df.where(uniform(key, seed) < (n / total if total else 0.0))


def keep_positives(df: DataFrame, label: str, n: int, key: str = "bidid", seed: int = 42) -> DataFrame:
    """All positives, and negatives of the lowest hash up to n rows."""
    positives = df.where(F.col(label) == 1)
    rest = max(0, n - positives.count())
    return positives.unionByName(lowest(df.where(F.col(label) == 0), F.xxhash64(key, F.lit(seed)), key, rest))


def add_fold(df: DataFrame, k: int, key: str = "bidid", label: str | None = None, seed: int = 42) -> DataFrame:
    """`fold` by hash; with a label, by turns within each label and block of hashes, so that folds have equal shares."""
    if label is None:
        return df.withColumn("fold", fold(key, k, seed))
    h = F.xxhash64(key, F.lit(seed))
    turn = F.row_number().over(Window.partitionBy(label, F.pmod(F.shiftright(h, 20), F.lit(64))).orderBy(h, key))
    return df.withColumn("fold", F.pmod(turn, F.lit(k)).cast("int"))


# --- statistics joined back ----------------------------------------------


def region_stats(train: DataFrame) -> DataFrame:
    """J1."""
    return train.groupBy("region").agg(F.count("*").alias("n_bids"), F.sum("win").alias("n_wins"), F.sum("click").alias("n_clicks")).withColumns({"win_rate": F.col("n_wins") / F.col("n_bids"), "ctr": guarded("n_clicks", "n_wins")})


def join_region_ctr(df: DataFrame, stats: DataFrame) -> DataFrame:
    """`region_ctr`; regions without one get the mean over regions."""
    mean = stats.agg(F.avg("ctr").alias("_m"))
    return df.join(stats.select("region", "ctr"), "region", "left").crossJoin(F.broadcast(mean)).withColumn("region_ctr", F.coalesce("ctr", "_m")).drop("ctr", "_m")


def market_stats(train: DataFrame, keys: tuple[str, ...] = ("adexchange", "slot_size_group")) -> DataFrame:
    """Mean, sample deviation (0 for one row) and number of winners' prices."""
    return train.where("win = 1").groupBy(*keys).agg(F.avg("payprice").alias("market_mean"), F.coalesce(F.stddev_samp("payprice"), F.lit(0.0)).alias("market_std"), F.count("*").alias("market_n"))


def join_market_stats(df: DataFrame, stats: DataFrame, keys: tuple[str, ...] = ("adexchange", "slot_size_group")) -> DataFrame:
    """market_mean and market_std; groups without them get the means over groups."""
    means = stats.agg(F.avg("market_mean").alias("_a"), F.avg("market_std").alias("_b"))
    out = df.join(stats.drop("market_n"), list(keys), "left").crossJoin(F.broadcast(means))
    return out.withColumns({"market_mean": F.coalesce("market_mean", "_a"), "market_std": F.coalesce("market_std", "_b")}).drop("_a", "_b")


def target_encode(train: DataFrame, other: DataFrame, column: str, target: str, smoothing: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold smoothed means for train (with `fold`), full-train ones for other; unseen values get train's mean.

    A value's out-of-fold sums are its totals less its own fold's, so one aggregate by value and fold, which is stored,
    has them, the whole sums and the mean.
    """
    name = f"{column}_te"
    sums = kept(train.groupBy(column, "fold").agg(F.sum(target).cast("double").alias("_s"), F.count("*").alias("_n"), F.count(target).alias("_m")), "cells")
    mean = sums.agg((F.sum("_s") / F.sum("_m")).alias("_g"))
    w = Window.partitionBy(column)
    cells = sums.withColumns({"_os": F.sum("_s").over(w) - F.col("_s"), "_on": F.sum("_n").over(w) - F.col("_n")}).crossJoin(F.broadcast(mean))
    smooth = lambda s, n: F.when(col(n) > 0, (col(s) + smoothing * F.col("_g")) / (col(n) + smoothing)).otherwise(F.col("_g"))
    oof = cells.select(F.col(column).alias("_k"), F.col("fold").alias("_f"), smooth("_os", "_on").alias(name))
    whole = sums.groupBy(column).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).crossJoin(F.broadcast(mean)).select(F.col(column).alias("_k"), smooth("_s", "_n").alias(name))
    enc_train = train.join(oof, F.col(column).eqNullSafe(F.col("_k")) & (F.col("fold") == F.col("_f")), "left").drop("_k", "_f")
    enc_other = other.join(whole, F.col(column).eqNullSafe(F.col("_k")), "left").drop("_k").crossJoin(F.broadcast(mean)).withColumn(name, F.coalesce(name, "_g")).drop("_g")
    return enc_train, enc_other
