import itertools

import numpy as np
import pytest

from gavel.llm.hamming import chunk_keys, distance_found, groups, min_hashes

from .conftest import shape
from .test_duplicates import brute_groups, key, near_copies

COLUMNS = ["doc_id", "n_shingles", "component_id"]


@pytest.mark.parametrize(("values", "chunks", "errors"), [(64, 12, 1), (24, 5, 2), (16, 8, 0)])
def test_all_signatures_within_the_distance_share_a_key(values, chunks, errors):
    rng = np.random.default_rng(3)
    most = distance_found(values, chunks, errors)
    base = rng.integers(0, 1 << 16, (400, values)).astype(np.uint16)
    other = base.copy()
    for i in range(len(base)):
        at = rng.choice(values, most, replace=False)
        other[i, at] ^= np.uint16(rng.integers(1, 1 << 16))
    # The worst case: as many errors as allowed in all chunks, one more in all but one.
    ends = np.linspace(0, values, chunks + 1).astype(int)
    other[0] = base[0]
    for k, (lo, hi) in enumerate(itertools.pairwise(ends)):
        other[0, lo : lo + min(errors + (k > 0), hi - lo)] ^= np.uint16(1)
    assert np.count_nonzero(base[0] != other[0]) == most
    a, b = chunk_keys(base, chunks, errors), chunk_keys(other, chunks, errors)
    assert (a == b).any(1).all()
    assert not (a == chunk_keys(np.roll(base, 1, 0), chunks, errors)).any()
    with pytest.raises(ValueError):
        distance_found(8, 8, 1)


def test_min_hashes_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(4)
    sets, first = [], [0]
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 230, dtype=np.uint64)
        for part in (pool[:215], pool[15:]):
            sets.append(np.sort(part))
            first.append(first[-1] + len(part))
    v = min_hashes(np.concatenate(sets), np.array(first))
    same = (v[::2] == v[1::2]).mean(1)
    assert abs(same.mean() - 200 / 230) < 0.01 and same.std() < 0.06
    assert not min_hashes(np.zeros(0, np.uint64), np.array([0, 0])).any()


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_against_all_pairs(spark, seed):
    rows = near_copies(seed, 200)
    got = groups(shape(spark, rows)).toPandas()
    want = brute_groups(rows, 5, 85)
    assert len({c for _, _, c in want}) < len(want)
    assert sorted(map(key, got[COLUMNS].itertuples(index=False))) == sorted(map(key, want))
    assert (got["kept"] == (got["doc_id"] == got["component_id"])).all()


def test_groups_whose_head_is_no_partner(spark, monkeypatch):
    """One base of which each text changes other words: many texts share keys but not groups, in several blocks."""
    monkeypatch.setattr("gavel.llm.hamming.BLOCK_NODES", 40)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        text = [f"w{k}" for k in range(200)]
        kind = int(rng.integers(0, 6))
        for k in rng.choice(200, int(rng.integers(0, 4)), replace=False):
            text[k] = f"edit{rng.integers(0, 9)}"
        for k in range(kind):
            text[30 * k] = f"kind{kind}"
        rows.append((int(i * 37 % 301), " ".join(text)))
    want = brute_groups(rows, 5, 85)
    assert 1 < len({c for _, _, c in want}) < 300
    got = groups(shape(spark, rows)).toPandas()
    assert sorted(map(key, got[COLUMNS].itertuples(index=False))) == sorted(map(key, want))


def test_groups_of_odd_rows(spark, odd_rows):
    got = groups(shape(spark, odd_rows)).toPandas()
    assert sorted(map(key, got[COLUMNS].itertuples(index=False))) == sorted(map(key, brute_groups(odd_rows, 5, 85)))
    assert set(got.columns) == {*COLUMNS, "kept"} and got["kept"].notna().all()
    assert groups(shape(spark, [])).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, folder):
    from gavel.llm.queries import queries

    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text").toPandas()
    got = queries()["op13_minhash"](spark, f"/root/testdata/{folder}").toPandas()
    want = brute_groups(list(docs.itertuples(index=False, name=None)), 5, 85)
    assert sorted(map(key, got[COLUMNS].itertuples(index=False))) == sorted(map(key, want))
