"""Streams run over the present files (Z6-Z9, B31), with their batch twins in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators import bidding as b
from gavel.operators.debias import FEATURES, LinearProbability, fit_pipeline
from gavel.operators.market import as_arrays
from gavel.plans.bidding_queries import CPC, _best_sql
from gavel.plans.market_queries import model
from gavel.registry import query, r6
from gavel.sources.logs import fresh, kept
from gavel.streaming import jobs as j
from gavel.tables import bids, table


def _stream(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = bids(spark, sf_dir).withColumn("ts", j.event_time())
    return j.stream_of(df.select("ts", *columns), "bids")


#: In how many parts the replayed tables arrive.
PARTS = 5


def _arrivals_sql(src: str, key: str, delay: str) -> str:
    """CTEs over src (with ts): part_rows (with `part`), met (part, wm: the watermark that the part meets) and ended (the last watermark)."""
    return f"""span AS (SELECT min(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))) AS lo, max(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))) AS hi FROM {src}),
part_rows AS (SELECT s.*, least({PARTS} * (date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) - lo) // (hi - lo + 1) + CASE WHEN {key} % 97 = 0 THEN 1 WHEN {key} % 101 = 0 THEN 2 ELSE 0 END, {PARTS - 1}) AS part FROM {src} s, span),
tops AS (SELECT part, date_trunc('milliseconds', max(ts)) AS m FROM part_rows GROUP BY 1),
met AS (SELECT i AS part, (SELECT max(m) FROM tops WHERE tops.part < i) - INTERVAL {delay} AS wm FROM range({PARTS}) r(i)),
ended AS (SELECT max(m) - INTERVAL {delay} AS wm FROM tops)"""


def _arriving(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Bids in parts: most with the part of their day, some one or two parts later."""
    df = bids(spark, sf_dir).withColumn("ts", j.event_time()).select("ts", "bidid", *columns)
    return j.arrivals(df, PARTS, _behind("bidid"))


def _behind(key: str) -> Column:
    return F.when(F.col(key) % 97 == 0, 1).when(F.col(key) % 101 == 0, 2).otherwise(0)


_TS = "tb AS (SELECT *, strptime(substr(timestamp, 1, 14), '%Y%m%d%H%M%S') AS ts FROM bids)"

_LATE_KPIS = f""", {_TS}, {_arrivals_sql('tb', 'bidid', "'200 days'")},
kp AS (SELECT date_trunc('day', ts) AS start, adexchange, count(*) AS n, avg(win) AS wr, sum(click) / CAST(greatest(sum(win), 1) AS DOUBLE) AS ctr, avg(CASE WHEN win = 1 THEN payprice END) AS mp FROM part_rows JOIN met USING (part) WHERE wm IS NULL OR date_trunc('day', ts) + INTERVAL '1 day' > wm GROUP BY 1, 2)
SELECT strftime(start, '%Y-%m-%d') AS start, adexchange, CAST(n AS BIGINT) AS n, round(wr, 6) AS win_rate, round(ctr, 6) AS ctr, round(mp, 6) AS mean_price, CASE WHEN wr < 0.1 THEN 'low_win_rate' WHEN mp > 150 THEN 'high_price' END AS alert FROM kp, ended WHERE start + INTERVAL '1 day' <= wm"""


@query("z6_late_kpis", _LATE_KPIS)
def z6l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows that the watermark has closed, of bids that arrive in parts, some of them late; rows behind the watermark are in no window."""
    rows = _arriving(spark, sf_dir, "adexchange", "win", "click", "payprice")
    got, _ = j.replay(rows, lambda s: j.kpis(s, ["adexchange"], "1 day", late="200 days"), "kpis", PARTS)
    return r6(got.drop("end").withColumn("start", F.date_format("start", "yyyy-MM-dd")))


@query("z6_late_rows", f""", {_TS}, {_arrivals_sql('tb', 'bidid', "'200 days'")} SELECT CAST(part AS INT) AS part, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (date_trunc('day', ts) + INTERVAL '1 day' <= wm) AS BIGINT) AS late FROM part_rows JOIN met USING (part) GROUP BY 1""")
def z6r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each part were behind the watermark that the running job reported."""
    rows = _arriving(spark, sf_dir, "adexchange", "win", "click", "payprice")
    _, marks = j.replay(rows, lambda s: j.kpis(s, ["adexchange"], "1 day", late="200 days"), "kpis", PARTS)
    return j.late_rows(rows, marks, F.date_trunc("day", "ts") + F.expr("interval 1 day"))


def _part_sql(k: int) -> str:
    """CTEs of a part: open_k (sessions that the part meets, and its events that aren't late, by start), done_k (as one where they overlap) with the watermark behind the part."""
    met = f"SELECT user_id, ts AS a, ts + INTERVAL '12 hours' AS b, 1 AS n FROM part_rows JOIN met USING (part) WHERE part = {k} AND (wm IS NULL OR ts + INTERVAL '12 hours' > wm)"
    held = f" UNION ALL SELECT user_id, a, b, n FROM done_{k - 1} WHERE wm IS NULL OR b > wm" if k else ""
    return f"""open_{k} AS ({met}{held}),
at_{k} AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM open_{k}),
run_{k} AS (SELECT *, sum(CASE WHEN a <= top THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS s FROM at_{k}),
done_{k} AS (SELECT user_id, min(a) AS a, max(b) AS b, sum(n) AS n, {f'(SELECT wm FROM met WHERE part = {k + 1})' if k + 1 < PARTS else '(SELECT wm FROM ended)'} AS wm FROM run_{k} GROUP BY user_id, s)"""


# A session goes out when the watermark has passed its end; events that come later start another one, so parts are told one after another.
_SPANNING = f"""WITH ev AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id FROM events), {_arrivals_sql('ev', 'event_id', "'2 days'")},
{', '.join(map(_part_sql, range(PARTS)))},
g AS ({' UNION ALL '.join(f'SELECT user_id, a, b, n FROM done_{k} WHERE b <= wm' for k in range(PARTS))})
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(b, '%Y-%m-%d %H:%M:%S') AS "end", CAST(n AS BIGINT) AS n FROM g"""


@query("z6_spanning_sessions", _SPANNING, bids=False)
def z6p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users whose events arrive in parts: one that spans parts is one session; those still open at the end are left out.

    A session that the watermark has passed is out; an event that comes later, but isn't late itself, starts another one.
    """
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    rows = j.arrivals(e, PARTS, _behind("event_id"))
    got, _ = j.replay(rows, lambda s: j.sessions(s, "user_id", "12 hours", late="2 days"), "sessions", PARTS)
    return got.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


_KPIS = """, kp AS (SELECT strftime(strptime(CAST(day AS VARCHAR), '%Y%m%d'), '%Y-%m-%d') AS start, adexchange, count(*) AS n, avg(win) AS wr, sum(click) / CAST(greatest(sum(win), 1) AS DOUBLE) AS ctr, avg(CASE WHEN win = 1 THEN payprice END) AS mp FROM bids GROUP BY 1, 2)
SELECT start, adexchange, CAST(n AS BIGINT) AS n, round(wr, 6) AS win_rate, round(ctr, 6) AS ctr, round(mp, 6) AS mean_price, CASE WHEN wr < 0.1 THEN 'low_win_rate' WHEN mp > 150 THEN 'high_price' END AS alert FROM kp"""


@query("z6_rolling_kpis", _KPIS)
def z6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows by exchange with their rates, mean price and alerts; the output is complete, so windows open at the stream's end are seen."""
    s = _stream(spark, sf_dir, "adexchange", "win", "click", "payprice")
    got = j.drain(j.kpis(s, ["adexchange"], "1 day", late="100000 days"), "kpis", "complete")
    return r6(got.drop("end").withColumn("start", F.date_format("start", "yyyy-MM-dd")))


@query("z6_event_windows", "SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2", bids=False)
def z6e(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    g = j.stream_of(e, "events").withWatermark("ts", "1 hour").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    got = j.drain(g.select(F.col("window.start").alias("start"), "event_type", "n"), "windows", "complete")
    return got.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("z6_sessions", ", x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS f FROM events), y AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, CAST(count(DISTINCT s) AS BIGINT) AS sessions, CAST(count(*) AS BIGINT) AS events FROM y GROUP BY 1".replace(", x AS", "WITH x AS", 1), bids=False)
def z6s(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    got = j.drain(j.sessions(j.stream_of(e, "events"), "user_id", late="100000 days"), "sessions", "complete")
    return got.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


_DRIFT = """, b AS (SELECT season, floor(date_diff('day', DATE '1970-01-01', CAST(strptime(CAST(day AS VARCHAR), '%Y%m%d') AS DATE)) / 30) * 30 AS d, CAST(least(floor(p_a * 50), 49) AS INT) AS bin FROM bids),
r AS (SELECT bin, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS c FROM b WHERE season = 2 GROUP BY 1),
t AS (SELECT d, count(*) AS n FROM b GROUP BY 1), c AS (SELECT d, bin, count(*) AS c FROM b GROUP BY 1, 2),
g AS (SELECT t.d, n, abs(sum(coalesce(c.c, 0) / CAST(n AS DOUBLE) - coalesce(r.c, 0)) OVER (PARTITION BY t.d ORDER BY i)) AS gap FROM t CROSS JOIN (SELECT unnest(range(50)) AS i) LEFT JOIN c ON c.d = t.d AND c.bin = i LEFT JOIN r ON r.bin = i),
worst AS (SELECT d, n, max(gap) AS ks FROM g GROUP BY 1, 2)
SELECT strftime(DATE '1970-01-01' + CAST(d AS INT), '%Y-%m-%d') AS start, CAST(n AS BIGINT) AS n, round(ks, 6) AS ks, CASE WHEN ks >= 0.2 THEN 'severe' WHEN ks >= 0.15 THEN 'moderate' WHEN ks >= 0.1 THEN 'mild' ELSE 'none' END AS level FROM worst"""


@query("z7_score_drift", _DRIFT)
def z7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = bids(spark, sf_dir).where("season = 2").select("p_a")
    got = j.drain(j.drift(_stream(spark, sf_dir, "p_a"), ref, late="100000 days"), "drift", "complete")
    return r6(got.withColumn("start", F.date_format("start", "yyyy-MM-dd")))


_ROLLING = f""", {_TS}, {_arrivals_sql('tb', 'bidid', "'200 days'")},
b AS (SELECT to_timestamp(floor(epoch(ts) / 2592000) * 2592000) AT TIME ZONE 'UTC' AS d, CAST(least(floor(p_a * 50), 49) AS INT) AS bin FROM part_rows JOIN met USING (part) WHERE wm IS NULL OR (to_timestamp(floor(epoch(ts) / 2592000 + 1) * 2592000) AT TIME ZONE 'UTC') > wm),
r AS (SELECT CAST(least(floor(p_a * 50), 49) AS INT) AS bin, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS c FROM bids WHERE season = 2 GROUP BY 1),
t AS (SELECT d, count(*) AS n FROM b GROUP BY 1), c AS (SELECT d, bin, count(*) AS c FROM b GROUP BY 1, 2),
g AS (SELECT t.d, n, abs(sum(coalesce(c.c, 0) / CAST(n AS DOUBLE) - coalesce(r.c, 0)) OVER (PARTITION BY t.d ORDER BY i)) AS gap FROM t CROSS JOIN (SELECT unnest(range(50)) AS i) LEFT JOIN c ON c.d = t.d AND c.bin = i LEFT JOIN r ON r.bin = i),
worst AS (SELECT d, n, max(gap) AS ks FROM g GROUP BY 1, 2)
SELECT strftime(d, '%Y-%m-%d') AS start, CAST(n AS BIGINT) AS n, round(ks, 6) AS ks, CASE WHEN ks >= 0.2 THEN 'severe' WHEN ks >= 0.15 THEN 'moderate' WHEN ks >= 0.1 THEN 'mild' ELSE 'none' END AS level FROM worst, ended WHERE d + INTERVAL '30 days' <= wm"""


@query("z7_rolling_drift", _ROLLING)
def z7r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of windows that the watermark has closed, of scores that arrive in parts, some late."""
    ref = bids(spark, sf_dir).where("season = 2").select("p_a")
    got, _ = j.replay(_arriving(spark, sf_dir, "p_a"), lambda s: j.drift(s, ref, late="200 days"), "drift", PARTS)
    return r6(got.withColumn("start", F.date_format("start", "yyyy-MM-dd")))


_STOP = f""", {_TS}, paid AS (SELECT ts, bidid, advertiser, payprice AS cost FROM tb WHERE win = 1), {_arrivals_sql('paid', 'bidid', "'200 days'")},
x AS (SELECT advertiser, date_trunc('day', ts) AS day, ts, bidid, cost FROM part_rows JOIN met USING (part) WHERE wm IS NULL OR ts > wm),
y AS (SELECT *, sum(cost) OVER (PARTITION BY advertiser, day ORDER BY ts, bidid ROWS UNBOUNDED PRECEDING) AS cum FROM x),
z AS (SELECT *, CAST(cum <= 300 AS INT) AS accepted FROM y)
SELECT advertiser, strftime(day, '%Y-%m-%d') AS day, bidid, CAST(cost AS DOUBLE) AS cost, CAST(coalesce(max(CASE WHEN accepted = 1 THEN cum END) OVER (PARTITION BY advertiser, day ORDER BY ts, bidid ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS spent, accepted FROM z, ended WHERE ts <= wm"""


@query("z8_hard_stop", _STOP)
def z8h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid bids in parts against a budget of 300 a campaign day, which stops it: a state for each day, over restarts."""
    rows = j.arrivals(bids(spark, sf_dir).where("win = 1").select(j.event_time().alias("ts"), "bidid", "advertiser", F.col("payprice").alias("cost")), PARTS, _behind("bidid"))
    got, _ = j.replay(rows, lambda s: j.hard_stop(s, 300.0, "200 days"), "stop", PARTS, j.STATE_STORE)
    return got.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("z8_budgets", "SELECT advertiser, day, CAST(sum(payprice) AS BIGINT) AS spent, CAST(greatest(500 - sum(payprice), 0) AS DOUBLE) AS left, CAST(sum(payprice) >= 500 AS INT) AS exhausted FROM bids GROUP BY 1, 2".replace("AS left", 'AS "left"'))
def z8(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = j.drain(j.budgets(_stream(spark, sf_dir, "advertiser", "payprice"), 500.0, late="100000 days"), "budgets", "complete")
    return got.withColumn("day", F.date_format("day", "yyyyMMdd").cast("long"))


@query("z9_blocklist", ", bl AS (SELECT domain FROM bids WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND sum(win) = 0) SELECT bidid FROM bids WHERE domain IS NULL OR domain NOT IN (SELECT domain FROM bl)")
def z9(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = j.blocklist(bids(spark, sf_dir), 2)
    return j.drain(j.apply_blocklist(_stream(spark, sf_dir, "bidid", "domain"), blocked).select("bidid"), "allowed")


def _decisions_sql(p: str = "p_a", where: str = "") -> str:
    return f"""{_best_sql('(v - price) * cdf', p)},
x AS (SELECT bidid, bids.adexchange, {p} AS p, {p} * {CPC} AS v, slotprice > 0 AND slotprice > 0.1 * {p} * {CPC} AS bound, slotprice, be.bid AS opt FROM bids JOIN be ON bids.adexchange = be.adexchange AND {p} * {CPC} = be.v {where}),
y AS (SELECT *, least(least(greatest(CASE WHEN bound THEN least(greatest(slotprice * 1.05, 1.0), v) ELSE opt END, 1.0), 300.0), v) AS bid FROM x),
z AS (SELECT *, CAST(least(floor(bid), 299) AS DOUBLE) AS low FROM y)
SELECT bidid, z.adexchange, round(p, 6) AS pctr, round(v, 6) AS v, round(bid, 6) AS bid, round(a.cdf * (1 - least(bid - low, 1.0)) + b.cdf * least(bid - low, 1.0), 6) AS win_prob, CAST(bound AS INT) AS regime, CAST(z.adexchange AS VARCHAR) AS curve FROM z JOIN mo a ON a.adexchange = z.adexchange AND a.price = low JOIN mo b ON b.adexchange = z.adexchange AND b.price = low + 1"""


def _markets(df: DataFrame) -> DataFrame:
    """A row for each exchange: its envelope and its curve on whole prices."""
    grid = model(df, "adexchange")
    return kept(b.envelope(grid, "adexchange").join(as_arrays(grid, "adexchange", values=("cdf",)), "adexchange"), "markets")


@query("b31_decisions", _decisions_sql())
def b31(spark: SparkSession, sf_dir: str) -> DataFrame:
    markets = _markets(bids(spark, sf_dir))
    return r6(j.drain(j.decide(_stream(spark, sf_dir, "bidid", "adexchange", "p_a", "slotprice"), markets, CPC), "decisions"))


#: A linear model with set numbers.
SET_MODEL = LinearProbability(["hour", "slotprice"], [12.0, 40.0], [0.05, -0.01], -4.0)


@query("b31_set_model", _decisions_sql("(1 / (1 + exp(-(-4.0 + (hour - 12.0) * 0.05 + (slotprice - 40.0) * -0.01))))"))
def b31s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a stream by a linear model of set numbers."""
    stream = _stream(spark, sf_dir, "bidid", "adexchange", "hour", "slotprice")
    return r6(j.drain(j.decide(stream, _markets(bids(spark, sf_dir)), CPC, SET_MODEL), "decisions"))


@query("b31_fitted_pipeline")
def b31f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline fitted on winners of the earlier season, saved, loaded, and applied to a stream of the later one with the earlier market's curves."""
    from pyspark.ml import PipelineModel

    df = bids(spark, sf_dir)
    early, late = df.where("season = 2"), df.where("season = 3").withColumn("ts", j.event_time())
    path = fresh(spark, "pipeline")
    fit_pipeline(early.where("win = 1"), "click", FEATURES).write().save(path)
    stream = j.stream_of(late.select("ts", "bidid", "adexchange", *FEATURES), "bids")
    return r6(j.drain(j.decide(stream, _markets(early), CPC, PipelineModel.load(path)), "decisions"))
