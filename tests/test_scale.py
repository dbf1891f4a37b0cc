"""Work that is done once, and tasks that stay small, as tables grow."""

import pytest
from pyspark.sql import functions as F

from gavel.operators import debias, effects, explore, features, metrics
from gavel.plans import debias_queries, source_queries
from gavel.streaming import jobs


@pytest.fixture
def rows(spark, tmp_path):
    """Bids in files, so that a plan shows whether it still reads them."""
    path = str(tmp_path / "rows")
    cols = [(F.col("id") % k).cast("int").alias(c) for c, k in zip(debias.FEATURES, (7, 5, 24, 35, 3, 2), strict=True)]
    made = spark.range(600).select(F.col("id").alias("bidid"), (F.col("id") % 3).cast("int").alias("advertiser"), *cols, (F.col("id") % 3 > 0).cast("int").alias("win"), (F.col("id") % 6 == 1).cast("int").alias("click"), F.element_at(F.array(*map(F.lit, ("train", "train", "val", "test"))), (F.col("id") % 4 + 1).cast("int")).alias("split"))
    made.write.parquet(path)
    return spark.read.parquet(path)


def test_baselines_score_rows_once(rows):
    got = debias.baselines(rows)
    assert got.inputFiles() and all("scored-" in f for f in got.inputFiles())
    assert {(r.split, r.task, r.model) for r in got.collect()} == {(s, t, m) for s in ("train", "val", "test") for t in ("ctr", "win", "ctr_all") for m in ("linear", "trees")}


def repeated(rows):
    """The rows in one to four copies, with some noise in their labels."""
    odd = rows.withColumns({"win": F.when(F.col("bidid") % 11 == 0, 1 - F.col("win")).otherwise(F.col("win"))})
    return odd.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("bidid") % 4).cast("int"))))


def test_baselines_fit_and_score_distinct_rows(rows):
    many = repeated(rows)
    used, fits = debias.baseline_fits(many)
    columns = [*debias.FEATURES, "win", "click", "split"]
    assert used.count() == many.select(*columns).distinct().count() < many.count() == used.agg(F.sum("_n")).first()[0]
    scored = debias.baseline_scores(used, fits)
    won = used.where("win = 1").count()
    assert scored.count() == 4 * used.count() + 2 * won
    assert scored.where("task = 'win' and model = 'trees'").agg(F.sum("n")).first()[0] == many.count()


@pytest.mark.parametrize("kind", ["linear", "trees"])
def test_a_counted_fit_is_the_fit_of_all_rows(rows, kind):
    many = repeated(rows)
    counted = many.groupBy(*debias.FEATURES, "win").agg(F.count("*").alias("_n"))
    got = debias.apply_probability(debias.fit_counted(counted, "win", kind=kind), rows, "e").orderBy("bidid").toPandas()["e"]
    want = debias.apply_probability(debias.fit_probability(many, "win", kind=kind), rows, "e").orderBy("bidid").toPandas()["e"]
    assert got.nunique() > 5 and abs(got - want).max() < 1e-6


def test_counted_metrics_are_those_of_all_rows(rows):
    many = repeated(rows).withColumns({"p": F.when(F.col("hour") == 7, F.lit(float("nan"))).otherwise((F.col("hour") + 1) / 30), "y": F.col("win")})
    counted = many.groupBy("split", "p", "y").agg(F.count("*").alias("copies"))
    want = metrics.bundle(many, "split", y="y").orderBy("split").toPandas()
    got = metrics.bundle(counted, "split", y="y", count="copies").orderBy("split").toPandas()
    assert list(got.columns) == list(want.columns) and len(got) == 3 and (got["n"] == want["n"]).all()
    assert abs(got.drop(columns="split") - want.drop(columns="split")).max().max() < 1e-9


def test_importances_of_counted_rows_are_those_of_all_rows(rows):
    many = repeated(rows)
    got = {(r.task, r.model, r.feature): r.importance for r in debias.baseline_importances(many).collect()}
    train = many.where("split = 'train'")
    spread = train.agg(*[F.stddev_samp(c).alias(c) for c in debias.FEATURES]).first().asDict()
    counted = train.groupBy(*debias.FEATURES).agg(F.count("*").alias("_n"))
    assert debias.moments(counted, debias.FEATURES, "_n")[1] == pytest.approx(spread, abs=1e-9)
    for kind in ("linear", "trees"):
        want = debias.importances(debias.fit_probability(train, "win", kind=kind), debias.FEATURES, spread)
        assert {c: got["win", kind, c] for c, _ in want} == pytest.approx(dict(want), abs=1e-5) and max(x for _, x in want) < 1
    assert len(got) == 36 and debias.moments(counted.limit(1).withColumn("_n", F.lit(1)), ["hour"], "_n")[1] == {"hour": 0.0}


def test_fits_deal_rows_to_tasks(spark):
    held = debias.dealt(spark.range(2 * debias.FIT_ROWS + 1).coalesce(1), "rows")
    assert held.rdd.getNumPartitions() == 3


def test_arms_meet_a_stored_table_of_levels(rows):
    """A table of a row for each key whose size Spark knows, so that a key of very many rows is no hot one."""
    assert any("levels-" in f for f in effects.arms(rows).inputFiles())
    assert any("varied-" in f for f in effects.varied(rows).inputFiles())


def test_effect_fits_read_stored_rows(rows):
    two = rows.withColumns({"advertiser": F.col("bidid") % 3, "arm": (F.col("bidid") % 2).cast("int"), "y": F.col("hour") * 1.0})
    for got in (effects.t_learner(two, "y"), effects.dr_learner(two, "y")):
        assert not set(got.inputFiles()) & set(rows.inputFiles()) and got.count() == 600


def test_propensities_read_stored_rows(rows):
    got = debias.cross_fit_propensity(rows, calibrate=True)
    assert not set(got.inputFiles()) & set(rows.inputFiles()) and got.where("e is not null").count() == 600


def test_a_text_of_tags_is_split_once(spark, rows):
    df = rows.select("bidid", F.when(F.col("bidid") % 2 == 0, "7,9").when(F.col("bidid") % 5 > 0, "4").alias("usertag"))
    got = explore.tag_rows(df)
    assert any("tags-" in f for f in got.inputFiles())
    assert got.where("tag = 9 and place = 1").count() == 300 and got.where("tag = 4").count() == 240 and got.count() == 840


def test_a_micro_batch_has_a_file_for_each_core(spark):
    stream = jobs.stream_of(spark.range(5000).withColumnRenamed("id", "v"), "many")
    batches = jobs.drain(stream.withColumn("file", F.input_file_name()), "many-out")
    assert batches.select("file").distinct().count() == 4 * spark.sparkContext.defaultParallelism and batches.count() == 5000


def test_frequencies_meet_rows_without_a_shuffle(spark, rows):
    """Counts are a stored table whose size Spark knows, however large it takes the rows to be."""
    df = rows.select("bidid", F.col("hour").cast("string").alias("domain"), F.col("advertiser").cast("string").alias("creative"))
    got = features.engineer(df, time=False, slot=False, competition=False, hashes=False)
    assert sum("counts-" in f for f in got.inputFiles()) >= 2
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().sparkPlan().toString() and "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.where("domain_freq = 25 and creative_freq = 200").count() == 600


def test_four_logs_are_written_from_stored_bids(spark, monkeypatch):
    seen, write = [], source_queries.s.write_logs
    monkeypatch.setattr(source_queries.s, "write_logs", lambda df, path, columns: (seen.append(df.inputFiles()), write(df, path, columns)))
    raw = source_queries._raw(spark, "/root/testdata/sf0.001")
    assert len(seen) == 4 and all(files and all("logged-" in f for f in files) for files in seen)
    assert raw["bid"].count() > raw["imp"].count() > raw["clk"].count() > 0 and all(f.endswith(".bz2") for f in raw["bid"].inputFiles())


def test_baseline_rows_are_split_where_they_are_stored(spark):
    got = debias_queries._task_rows(spark, "/root/testdata/sf0.001")
    assert any("rows-" in f for f in got.inputFiles()) and not any("lineitem" in f for f in got.inputFiles())
    want = features.split_by_group(debias_queries.bids(spark, "/root/testdata/sf0.001"), "advertiser", debias_queries._KEY[1:])
    columns = ["bidid", *debias.FEATURES, "win", "click", "split"]
    assert got.count() == want.count() and got.select(*columns).exceptAll(want.select(*columns)).count() == 0
