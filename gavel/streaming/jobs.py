"""Streaming jobs over bids and events: KPIs with alerts, drift, budgets, blocklists and bid decisions.

Each function takes a streaming (or plain) DataFrame and returns one; `drain` runs a stream over the files that are
there and gives what it wrote, for tests and for jobs that run once a day. `replay` lets rows arrive in parts: each
part's files are a micro-batch of their own, and the job starts anew from its checkpoint for each, as after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.operators.bidding import best_bid, dual_regime
from gavel.operators.debias import apply_probability
from gavel.operators.explore import invalid_traffic
from gavel.operators.market import interpolate
from gavel.sources.logs import fresh, kept
from gavel.streaming.hard_stop import BudgetGate


def event_time(ts: str = "timestamp") -> Column:
    return F.try_to_timestamp(F.substring(ts, 1, 14), F.lit("yyyyMMddHHmmss"))


def stream_of(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df written as files in the shared folder and read as a stream, a micro-batch for each quarter of the files: as many files a batch as cores, if not said."""
    files = files or 4 * df.sparkSession.sparkContext.defaultParallelism
    path = fresh(df.sparkSession, name)
    df.repartition(files).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all present files, with its checkpoint and Parquet output in the shared folder; return the output."""
    spark = stream.sparkSession
    out, state = fresh(spark, f"{name}-out"), fresh(spark, f"{name}-state")
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        # Complete results replace those of the batch before.
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def arrivals(df: DataFrame, parts: int, delay: Column, ts: str = "ts") -> DataFrame:
    """df with `part`, in which a row arrives: its days cut the table's span into equal parts, and `delay` is added (the last part takes what would come later).

    df's rows are stored, so that finding the span and what follows don't evaluate them again.
    """
    df = kept(df, "arriving")
    number = F.datediff(F.col(ts), F.lit("1970-01-01"))
    ends = df.agg(F.min(number).alias("lo"), F.max(number).alias("hi")).first()
    if ends["lo"] is None:
        return df.withColumn("part", F.lit(0))
    part = F.floor(parts * (number - ends["lo"]) / (ends["hi"] - ends["lo"] + 1)) + delay
    return df.withColumn("part", F.least(part, F.lit(parts - 1)).cast("int"))


def replay(df: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, parts: int, conf: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What `build` of a stream appends when df's rows arrive part by part, and (part, watermark): the watermark that each part met.

    Every part is written as files behind those of the parts before it and handled by a new start of the job from the
    checkpoint. conf is set while the job starts (a state store, for example). A row behind the watermark is dropped
    by Spark; what the watermark hasn't passed stays in the state for later parts.
    """
    spark = df.sparkSession
    held = kept(df, name, "part")  # a part reads its own files only
    path, out, state = (fresh(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    marks, schema = [], held.drop("part").schema
    for k in range(parts):
        held.where(F.col("part") == k).drop("part").write.mode("append").parquet(path)
        result = build(spark.readStream.schema(schema).parquet(path))
        before = {c: spark.conf.get(c, None) for c in conf or {}}
        try:
            for c, v in (conf or {}).items():
                spark.conf.set(c, v)
            query = result.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        finally:
            for c, v in before.items():
                spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
        query.awaitTermination()
        met = [p["eventTime"]["watermark"] for p in query.recentProgress if p["numInputRows"] and "watermark" in p["eventTime"]]
        marks.append((k, met[0] if met else None))
    watermarks = spark.createDataFrame(marks, "part int, watermark string").select("part", F.to_timestamp("watermark").alias("watermark"))  # a row for each part
    return spark.read.schema(result.schema).parquet(out), watermarks


def late_rows(df: DataFrame, watermarks: DataFrame, end: Column) -> DataFrame:
    """How many rows of each part came behind the watermark that the part met; end: when a row's window ends."""
    late = F.coalesce(end <= F.col("watermark"), F.lit(False)).cast("long")
    return df.join(F.broadcast(watermarks), "part").groupBy("part").agg(F.count("*").alias("n"), F.sum(late).alias("late"))


def kpis(df: DataFrame, keys: list[str], size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", least_win_rate: float = 0.1, most_price: float = 150.0) -> DataFrame:
    """Rolling volume, win rate, CTR and mean price by window, with an alert where a threshold is passed. df has `ts`."""
    g = df.withWatermark("ts", late).groupBy(F.window("ts", size, slide), *keys).agg(F.count("*").alias("n"), F.avg("win").alias("win_rate"), (F.sum("click") / F.greatest(F.sum("win"), F.lit(1))).alias("ctr"), F.avg(F.when(F.col("win") == 1, F.col("payprice"))).alias("mean_price"))
    alert = F.when(F.col("win_rate") < least_win_rate, "low_win_rate").when(F.col("mean_price") > most_price, "high_price")
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "win_rate", "ctr", "mean_price", alert.alias("alert"))


def sessions(df: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows of a key's events."""
    g = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drift(df: DataFrame, reference: DataFrame, size: str = "30 days", late: str = "1 day", p: str = "p_a", bins: int = 50) -> DataFrame:
    """Histogram KS distance of each window's scores from a reference, with levels at 0.10, 0.15 and 0.20."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    total = reference.count()
    fixed = {r["b"]: r["c"] for r in reference.groupBy(at.alias("b")).agg((F.count("*") / total).alias("c")).collect()}  # at most `bins` rows
    shares = F.array(*[F.lit(float(fixed.get(i, 0.0))) for i in range(bins)])
    counts = [F.sum((at == i).cast("int")).alias(f"_{i}") for i in range(bins)]
    g = df.withWatermark("ts", late).groupBy(F.window("ts", size)).agg(F.count("*").alias("n"), *counts)
    now = F.array(*[F.col(f"_{i}") / F.col("n") for i in range(bins)])
    gaps = F.zip_with(now, shares, lambda a, b: a - b)
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("most"))
    ks = F.aggregate(gaps, zero, lambda s, x: F.struct((s["run"] + x).alias("run"), F.greatest(s["most"], F.abs(s["run"] + x)).alias("most")), lambda s: s["most"])
    got = g.select(F.col("window.start").alias("start"), "n", ks.alias("ks"))
    return got.withColumn("level", F.when(F.col("ks") >= 0.2, "severe").when(F.col("ks") >= 0.15, "moderate").when(F.col("ks") >= 0.1, "mild").otherwise("none"))


def budgets(df: DataFrame, budget: float, late: str = "1 day") -> DataFrame:
    """What each campaign day has spent and has left, and whether it is exhausted."""
    g = df.withWatermark("ts", late).groupBy("advertiser", F.window("ts", "1 day")).agg(F.sum("payprice").alias("spent"))
    return g.select("advertiser", F.col("window.start").alias("day"), "spent", F.greatest(F.lit(budget) - F.col("spent"), F.lit(0.0)).alias("left"), (F.col("spent") >= budget).cast("int").alias("exhausted"))


#: A state store that keeps arbitrary state.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def hard_stop(df: DataFrame, budget: float, late: str = "1 day") -> DataFrame:
    """Each paid bid (ts, bidid, advertiser, cost) with what its campaign day has spent with it and whether it is accepted.

    One state is a campaign day. Bids wait in it until the watermark has passed them, so that they are taken in the
    order of (ts, bidid) however they arrived; the first that doesn't fit the budget closes the day, and all behind it
    are refused. A bid behind the watermark is dropped, as its place in that order is gone. The state goes when the
    watermark has passed the day. Needs STATE_STORE.
    """
    day = F.unix_micros(F.date_trunc("day", "ts"))
    rows = df.withWatermark("ts", late).select("advertiser", day.alias("day"), "ts", F.unix_micros("ts").alias("at"), F.col("bidid").cast("long").alias("bidid"), F.col("cost").cast("double").alias("cost"))
    got = rows.groupBy("advertiser", "day").transformWithStateInPandas(BudgetGate(budget), BudgetGate.OUTPUT, "Append", "EventTime")
    return got.withColumn("day", F.timestamp_micros("day"))


def blocklist(history: DataFrame, least: int) -> DataFrame:
    """Domains that never won in `least` bids."""
    return invalid_traffic(history, least).where("flag = 'zero_win'").select("domain")


def apply_blocklist(df: DataFrame, blocked: DataFrame) -> DataFrame:
    """Bids on other domains; a stream against a static table. Bids without a domain stay."""
    return df.join(blocked, "domain", "left_anti")


def decide(df: DataFrame, markets: DataFrame, cpc: float, model=None) -> DataFrame:
    """Bid decisions: click probability (of a fitted pipeline or a LinearProbability, or p_a), value, shaded bid of at most the value, its chance to win, regime and the curve used.

    markets: a row for each exchange: breaks and best (see `envelope`) and cdf_grid (see `as_arrays`). A bid on an
    exchange without a curve is its value, of unknown chance.
    """
    df = apply_probability(model, df, "pctr") if model is not None else df.withColumn("pctr", F.col("p_a"))
    df = df.withColumn("v", F.col("pctr") * cpc).join(markets, "adexchange", "left")
    opt = F.when(F.col("best").isNotNull(), best_bid(F.col("v"))).otherwise(F.least("v", F.lit(300.0)))
    bid, regime = dual_regime(F.col("v"), F.col("slotprice"), opt)
    known = F.col("best").isNotNull()
    out = df.withColumns({"bid": F.least(bid, F.col("v")), "regime": regime, "curve": F.when(known, F.col("adexchange").cast("string")).otherwise("none")})
    return out.select("bidid", "adexchange", "pctr", "v", "bid", interpolate("cdf_grid", F.col("bid")).alias("win_prob"), "regime", "curve")
