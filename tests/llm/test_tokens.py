import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gavel.llm import tokens
from gavel.llm.packing import matched, opened, pack, sweep
from gavel.llm.tokens import Encoder
from gavel.llm.wavelet import WaveletMatrix, lookup, read_shard, token_output, write_shard, write_tokens

from .conftest import shape

ENCODERS = [Encoder(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
TEXT = st.one_of(st.text(alphabet=st.sampled_from(list("abTheé ,.!'\n\t-|<>5Σß\x01\x02  İé ́中%$")), max_size=40), st.text(max_size=20), st.just("<|endoftext|> a"))


def ids_of(encoder, texts):
    return [np.array(e.ids, "<u4") for e in encoder.plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_units_equal_whole_texts(texts):
    for e in ENCODERS:
        ids, first = e.encode(pa.array(texts, pa.string()), end=7)
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [[*x.tolist(), 7] for x in ids_of(e, texts)]


def test_long_texts_and_full_tables(monkeypatch):
    text = "".join(f"word{i % 5003}{'  ' if i % 97 == 0 else ' '}Other-{i}, \n" if i % 3 else f"x{i} " for i in range(200_000))
    monkeypatch.setattr(tokens, "CACHE_PARTS", 50_000)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(public_tokenizers.path(name))
        assert e.encode(pa.array([text]))[0].tolist() == ids_of(e, [text])[0].tolist()
        assert e.encode(pa.array([text[:900_000], None, text[50_000:60_000]]))[0].tolist() == np.concatenate(ids_of(e, [text[:900_000], text[50_000:60_000]])).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(0, 5))
def test_wavelet_matrix(values, often):
    x = np.array(values + [7] * often, np.uint16)
    _, _, m = read_shard(write_shard([None, 3], np.array([0, len(x)]), x))
    assert (m.decode() == x).all()
    at = np.arange(len(x))
    assert (m.access(at) == x).all() if len(x) else True
    for v in {7, *values[:3]}:
        assert m.occurrences(v).tolist() == np.flatnonzero(x == v).tolist()
        assert m.rank(v, len(x) // 2) == (x[: len(x) // 2] == v).sum()
    with pytest.raises(IndexError):
        WaveletMatrix.build(x).select(9, np.array([len(x)]))


def test_token_output(spark, odd_rows):
    got = token_output(shape(spark, odd_rows), public_tokenizers.path("byte_bpe_50k.json"), 2).orderBy("start").toPandas()
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [np.append(x, 2).astype("<u4") for x in ids_of(ENCODERS[0], [t for _, t in rows])]
    n = np.array([len(x) for x in ids])
    assert got["n_tokens"].tolist() == n.tolist() and got["start"].tolist() == (np.cumsum(n) - n).tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(x.tobytes()) for x in ids]


def test_lookup_in_shards(spark, tmp_path):
    rows = [(i, "alpha beta" if i % 3 else "beta gamma beta") for i in range(30)]
    write_tokens(shape(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), 2, str(tmp_path / "s"), shard_tokens=20)
    token = int(ids_of(ENCODERS[0], [" beta"])[0][0])
    got = lookup(spark.read.parquet(str(tmp_path / "s")), token).toPandas()
    want = {i: sum(int(x) == token for x in ids_of(ENCODERS[0], [t])[0]) for i, t in rows}
    assert {r.doc_id: r.n for r in got.itertuples()} == {i: n for i, n in want.items() if n}


def plan_in_ranges(counts, capacity, ranges=4):
    """The rounds of `matched`, with plain loops in place of Spark."""
    pieces, gaps, plan, sequences = [(s, 0, c) for s, c in counts.items() if c], [], [], 0
    while pieces:
        parts = [sweep(*[[r for r in runs if r[0] * ranges // (capacity + 1) == k] for runs in (pieces, gaps)], capacity) for k in range(ranges)]
        rest = sweep(*[[r for p in parts for r in p[i]] for i in (0, 1)], capacity)
        found = [m for p in [*parts, rest] for m in p[3]]
        gaps = rest[1] + [g for p in [*parts, rest] for g in p[2]]
        pieces = rest[0]
        if not found:
            pieces, gaps, found = opened(pieces, sequences, capacity)
        sequences = max([sequences, *[m[3] + m[2] for m in found]])
        plan += found
    return plan


def check_plan(plan, counts, capacity):
    fill: dict[int, list[tuple[int, int]]] = {}
    for size, _, n, sequence, offset in plan:
        for k in range(n):
            fill.setdefault(sequence + k, []).append((offset, size))
    seen: dict[int, int] = {}
    for parts in fill.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
            seen[size] = seen.get(size, 0) + 1
        assert at <= capacity
    assert seen == {s: c for s, c in counts.items() if c}
    # Not worse than best-fit decreasing, by more than a few.
    gaps: list[int] = []
    for size in sorted((s for s, c in counts.items() for _ in range(c)), reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - size)
    assert len(fill) <= 1.1 * len(gaps) + 2


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 40), max_size=20), st.integers(1, 6))
def test_plan_places_every_piece_once(counts, ranges):
    check_plan(plan_in_ranges(counts, 50, ranges), counts, 50)
    # Ranges change who sweeps, not what is matched.
    assert sorted(plan_in_ranges(counts, 50, ranges)) == sorted(plan_in_ranges(counts, 50, 1))


def test_rounds_in_spark(spark):
    counts = {s: 1 + s * 7 % 11 for s in range(1, 50, 3)}
    got = matched(spark.createDataFrame(list(counts.items()), "size int, count long"), 50).collect()
    assert sorted(map(tuple, got)) == sorted(plan_in_ranges(counts, 50, 1))


def test_packing(spark, odd_rows):
    got = pack(shape(spark, odd_rows), public_tokenizers.path("word_bpe_49k.json"), 0, 2048).toPandas()
    want = []
    for (i, _), ids in zip(odd_rows, ids_of(ENCODERS[1], [t for _, t in odd_rows]), strict=True):
        ids = np.append(ids, 0).astype("<u4")
        want += [(i, at // 2048, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for at in range(0, len(ids), 2048)]
    key = lambda r: tuple(-1 << 62 if v is None or v != v else int(v) for v in r)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == (part["length"].cumsum() - part["length"]).tolist() and part["length"].sum() <= 2048


def test_empty_tables(spark):
    empty = shape(spark, [])
    assert token_output(empty, public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0
    assert pack(empty, public_tokenizers.path("word_bpe_49k.json"), 0).count() == 0
