import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gavel.llm.components import components
from gavel.llm.jaccard import groups, overlap_needed
from gavel.llm.recompression import dedup, symbols
from gavel.llm.words import words

from .conftest import LOWER, WORD, shape


def brute_groups(rows, size, similar):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        s = {tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.append((1 << 63 if i is None else i, s))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and 100 * both >= similar * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    out = []
    for (i, s) in sets:
        label = find(i) if s else i
        out.append((None if i == 1 << 63 else i, len(s), None if label == 1 << 63 else label))
    return out


def key(r):
    return tuple(-1 << 62 if v is None or v != v else int(v) for v in r)


def near_copies(seed, n=120):
    """Families of texts with a few words changed, sharing a passage, and texts of their own."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(n):
        family = int(rng.integers(0, 8))
        base = [f"f{family}w{k}" for k in range(70)] if family < 5 else [f"own{i}w{k}" for k in range(int(rng.integers(1, 60)))]
        for _ in range(int(rng.integers(0, 6))):
            base[int(rng.integers(0, len(base)))] = f"edit{rng.integers(0, 50)}"
        rows.append((int(rng.permutation(1000)[0]) * 1000 + i, " ".join(base + passage * int(rng.integers(0, 2)))))
    return rows


@pytest.mark.parametrize(("size", "similar", "seed"), [(4, 85, 0), (5, 80, 1), (3, 60, 2)])
def test_groups_against_all_pairs(spark, size, similar, seed):
    rows = near_copies(seed)
    got = groups(shape(spark, rows), size, similar).toPandas()
    assert sorted(map(key, got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False))) == sorted(map(key, brute_groups(rows, size, similar)))


def test_groups_of_long_lists(spark):
    """Lists of three lengths: a passage that all texts hold, families of about 140 texts, and edited copies of few."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(700):
        family = int(rng.integers(0, 5))
        base = [f"p{k}" for k in range(25)] + [f"f{family}w{k}" for k in range(12 * int(rng.integers(0, 2)))] + [f"own{i // 6}w{k}" for k in range(int(rng.integers(0, 9)))]
        if rng.random() < 0.3:
            base[int(rng.integers(0, len(base)))] = f"edit{rng.integers(0, 400)}"
        rows.append((i * 7, " ".join(base)))
    want = brute_groups(rows, 4, 85)
    assert 5 < len({c for _, _, c in want}) < 650
    got = groups(shape(spark, rows), 4, 85).toPandas()
    assert sorted(map(key, got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False))) == sorted(map(key, want))


def test_groups_of_odd_rows(spark, odd_rows):
    got = groups(shape(spark, odd_rows)).toPandas()
    assert sorted(map(key, got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False))) == sorted(map(key, brute_groups(odd_rows, 4, 85)))
    assert groups(shape(spark, [])).count() == 0


@given(st.integers(1, 500), st.integers(1, 500), st.integers(1, 99))
def test_overlap_bound(n, m, similar):
    least = int(overlap_needed(np.int64(n), np.int64(m), similar))
    for both in range(min(n, m) + 1):
        assert (both >= least) == (100 * both >= similar * (n + m - both))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20))
def test_symbols_depend_on_their_spans(middle, before, after):
    """A symbol whose span lies in a text's inside stands wherever that text stands again."""
    make = lambda x: np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    name, lo, hi = symbols(make(middle), np.zeros(len(middle), np.int64))
    whole = before + middle + after
    name2, lo2, hi2 = symbols(make(whole), np.zeros(len(whole), np.int64))
    there = set(zip(name2.tolist(), lo2.tolist(), hi2.tolist(), strict=True))
    for n, a, b in zip(name.tolist(), lo.tolist(), hi.tolist(), strict=True):
        if a >= 0 and b <= len(middle):
            assert (n, a + len(before), b + len(before)) in there


def brute_dedup(rows, window):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    first, out = set(), []
    for i, t in order:
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in first:
                gone[p : p + window] = True
            first.add(k)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def text_key(r):
    return tuple("" if v is None or v != v else f"{int(v):020d}" if not isinstance(v, str) else v for v in r)


@pytest.mark.parametrize("seed", [0, 1])
def test_dedup_against_all_windows(spark, seed):
    rng = np.random.default_rng(seed)
    passages = [[f"s{k}w{i}" for i in range(40)] for k in range(6)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            p = passages[int(rng.integers(0, 6))]
            a = int(rng.integers(0, 15))
            parts += p[a : a + int(rng.integers(5, 40))] if rng.random() < 0.6 else [f"u{i}{rng.integers(0, 10**6)}" for _ in range(15)]
            parts += ["run"] * int(rng.integers(0, 30))
        rows.append((i * 7 % 80, " ".join(parts)))
    got = dedup(shape(spark, rows), digests=True).toPandas()
    assert sorted(map(text_key, got[["doc_id", "n_words", "n_removed", "kept_sha256"]].itertuples(index=False))) == sorted(map(text_key, brute_dedup(rows, 20)))
    untouched = got[got["n_removed"] == 0].set_index("doc_id")["text"].to_dict()
    assert all(dict(rows)[i] == t for i, t in untouched.items())


def test_dedup_of_odd_rows(spark, odd_rows):
    got = dedup(shape(spark, odd_rows), digests=True).toPandas()
    assert sorted(map(text_key, got[["doc_id", "n_words", "n_removed", "kept_sha256"]].itertuples(index=False))) == sorted(map(text_key, brute_dedup(odd_rows, 20)))
    assert got.loc[got["doc_id"] == 3, "text"].isna().all() and "chunk" in got.columns
    assert dedup(shape(spark, [])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_words(texts):
    import pyarrow as pa

    w = words(pa.array(texts, pa.string()))
    want = [WORD.findall(t) for t in texts]
    assert w.count().tolist() == [len(x) for x in want]
    flat = [x.encode() for x in sum(want, [])]
    assert [w.data[a:b].tobytes() for a, b in zip(w.begin, w.end, strict=True)] == flat
    by_hash = {}
    for h, x in zip(w.hash.tolist(), flat, strict=True):
        assert by_hash.setdefault(h, x) == x
    assert len(by_hash) == len(set(flat))


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "a long, b long")
    want = {x: find(x) for x in parent}
    assert {r.node: r.label for r in components(df).collect()} == want
    monkeypatch.setattr("gavel.llm.components.TASK_EDGES", 10)
    assert {r.node: r.label for r in components(df).collect()} == want
    assert components(df.where("1 = 0")).count() == 0
