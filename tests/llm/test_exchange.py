import numpy as np
import pytest

from gavel.llm.exchange import BLOCK_SQL, answered, blocks_of, joined_answers, levels


def test_levels():
    assert [levels(n) for n in (1, 512, 513, 512 * 64, 512 * 64 + 1)] == [1, 1, 2, 2, 3]


@pytest.mark.parametrize(("direct", "bits"), [(512, 48), (8, 64), (1, 48)])
def test_every_key_is_answered(spark, direct, bits):
    """How many chunks hold each key, and the largest number beside it, whatever the levels between."""
    n = 130 if direct == 1 else 70
    rng = np.random.default_rng(direct)
    pool = rng.integers(0, 1 << min(bits, 63), 400, dtype=np.uint64)
    keys = {c: np.unique(rng.choice(pool, rng.integers(0, 60))) for c in range(n)}
    weight = {c: rng.integers(0, 9, len(keys[c])).astype(np.int64) for c in keys}

    def emit(table):
        c = table.column("chunk")[0].as_py()
        return blocks_of(keys[c], [weight[c]], c, bits)

    def count(values, columns):
        _, at, times = np.unique(values, return_inverse=True, return_counts=True)
        top = np.zeros(len(times), np.int64)
        np.maximum.at(top, at, columns[0])
        return np.minimum(times, 20)[at] * 10 + top[at]

    blocks = spark.createDataFrame([(c,) for c in range(n)], "chunk int").groupBy("chunk").applyInArrow(emit, BLOCK_SQL)
    got = answered(blocks, n, bits, ["<i8"], count, direct).toArrow()
    chunk = got.column("chunk").to_numpy()
    for c in keys:
        want = [10 * min(20, sum(k in keys[o] for o in keys)) + max(weight[o][keys[o] == k].max() for o in keys if k in keys[o]) for k in keys[c]]
        assert joined_answers(got.take(np.flatnonzero(chunk == c))).tolist() == want


def test_width_follows_the_bytes(spark):
    from pyspark.sql import functions as F

    from gavel.llm.store import width

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(3000).select(F.repeat(F.lit("x"), 1000).alias("text"))
    unknown = spark.createDataFrame(df.rdd, df.schema)  # its plan has no size
    assert width(unknown, 30_000) == -(-3000 * 1008 // 30_000) and width(unknown) == least
    assert width(unknown.where("1 = 0"), 1) == least
