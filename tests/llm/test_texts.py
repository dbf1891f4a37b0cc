import base64
import hashlib
import io
import wave
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tests.conftest import same

from gavel.llm import audio, decontam, licenses, quality, queries, toxicity, warc

from .conftest import SF, shape


def test_license_twin(spark, duck):
    same(queries.queries()["op3_licenses"](spark, SF).toPandas(), duck.execute(queries.oracle_sql()["op3_licenses"]).df())


def test_license_forms(spark, odd_rows):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, f"MIT License\n\nCopyright (c) 2024 Somebody\n\n{mit}"), (2, mit.upper().replace(",", " ;")), (3, f"Copyright 2020 by X\n{mit}\nAll rights reserved."), (4, "foo\nReleased under the MIT Licence!\nbar\nreleased under the mit license."), (5, mit + " more")]
    got = {(r.doc_id, r.license_id, r.scope, r.n) for r in licenses.scan(shape(spark, rows)).collect()}
    assert {(2, "MIT", "text", 1), (3, "MIT", "text", 1), (4, "MIT", "line", 2)} <= got
    assert not any(d == 5 for d, *_ in got)
    assert licenses.scan(shape(spark, odd_rows)).count() == 0 and licenses.scan(shape(spark, [])).count() == 0


def brute_tiles(doc, item, least):
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best, found = least, []
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and free_d[a + n] and free_i[b + n] and doc[a + n] == item[b + n]:
                    n += 1
                if n > best:
                    best, found = n, [(a, b)]
                elif n == best:
                    found.append((a, b))
        if not found:
            return tiles
        for a, b in found:
            if all(free_d[a : a + best]) and all(free_i[b : b + best]):
                free_d[a : a + best] = free_i[b : b + best] = [False] * best
                tiles.append((a, b, best))


@pytest.mark.parametrize("seed", range(25))
def test_tiles_against_greedy(seed):
    rng = np.random.default_rng(seed)
    item = rng.integers(0, 6, int(rng.integers(5, 40)))
    doc = np.concatenate([item[10:], rng.integers(0, 6, 10), item[:12], rng.integers(0, 6, 10)])
    h = lambda x: x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = decontam.tile(h(doc), h(item))
    want = sum(n for _, _, n in brute_tiles(doc.tolist(), item.tolist(), 5))
    assert abs(sum(n for _, _, n in got) - want) <= 6  # ties may be marked in another order
    used_d, used_i = set(), set()
    for a, b, n in got:
        assert n >= 5 and (doc[a : a + n] == item[b : b + n]).all()
        assert not used_d & set(range(a, a + n)) and not used_i & set(range(b, b + n))
        used_d |= set(range(a, a + n))
        used_i |= set(range(b, b + n))


def test_decontamination(spark, odd_rows):
    items = [(1, " ".join(f"q{i}" for i in range(30))), (2, None), (3, "too short"), (4, " ".join(f"z{i}" for i in range(20)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    q = [f"Q{i}," for i in range(30)]
    rows = odd_rows + [(20, "before " + " ".join(q) + " after"), (21, " ".join(q[15:] + ["mid"] + q[:15])), (22, " ".join(q[:10])), (23, " ".join(f"z{i}" for i in range(12)))]
    got = {(r.doc_id, r.item_id, r.covered_words) for r in decontam.contaminated(shape(spark, rows), bench).collect()}
    assert got == {(20, 1, 30), (21, 1, 30), (23, 4, 12)}
    assert {(r.doc_id, r.item_id, r.covered_words) for r in decontam.contaminated(shape(spark, rows), bench, block_words=5).collect()} == got
    kept = decontam.clean(shape(spark, rows), bench)
    assert kept.count() == len(rows) - 3 and "chunk" in kept.columns
    assert decontam.contaminated(shape(spark, []), bench).count() == 0
    assert decontam.contaminated(shape(spark, rows), bench.where("1 = 0")).count() == 0


def test_wav_is_read_by_others():
    data = audio.wav(b"abc")
    with wave.open(io.BytesIO(data)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(10)) == (1, 1, b"abc")
    assert audio.wav_samples(data) == b"abc"


def test_resampling_keeps_a_tone():
    t = np.arange(9600)
    x = np.sin(2 * np.pi * 500 * t / audio.RATE)
    y = audio.resample(x)
    want = np.sin(2 * np.pi * 500 * np.arange(len(y)) * 3 / 2 / audio.RATE)
    lag = np.argmax([np.dot(y[200 : 6000], want[200 - k : 6000 - k]) for k in range(0, 24)])
    assert len(y) == 6400 and np.corrcoef(y[200:6000], want[200 - lag : 6000 - lag])[0, 1] > 0.98


def plain_log_mel(samples):
    """The levels by sums over single samples, with no shared code but the fixed values."""
    x = [(b - 128) / 128 for b in samples] + [0.0] * (-len(samples) % 192)
    mean = sum(x) / len(x)
    x = [v - mean for v in x]
    taps = 12
    ideal = [np.sinc((k - (2 * taps - 1) / 2) / 3) * (0.54 - 0.46 * np.cos(2 * np.pi * k / (2 * taps - 1))) for k in range(2 * taps)]
    y = []
    for m in range(len(x) * 2 // 3):
        h = ideal[m % 2 :: 2][::-1]
        at = 3 * (m // 2) + (m % 2) * 3 // 2 - taps // 2
        y.append(sum(c * (x[at + k] if 0 <= at + k < len(x) else 0.0) for k, c in enumerate(h)) / sum(h))
    y = np.array(y + [0.0] * 128)
    k = np.arange(256)
    dft = np.exp(-2j * np.pi * np.outer(k, np.arange(129)) / 256)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * k / 256)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (v / 2595) - 1) for v in np.linspace(0, mel(4000), 34)]
    out = []
    for a in range(0, len(y) - 255, 128):
        power = np.abs((y[a : a + 256] * window) @ dft) ** 2
        row = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:]):
            f = np.arange(129) * 4000 / 128
            row.append(10 * np.log10(float(np.clip(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0, None) @ power) + 1e-6))
        out.append(row)
    return np.clip(np.rint(2 * (np.array(out) + 60)), 0, 255)


def test_log_mel_against_plain_sums(monkeypatch):
    rng = np.random.default_rng(8)
    for n in (192, 500, 3000):
        samples = rng.integers(32, 127, n, dtype=np.uint8).tobytes()
        levels, energy = audio.log_mel(samples)
        want = plain_log_mel(samples)
        assert levels.shape == want.shape and (np.abs(levels - want) <= 1).all() and (levels == want).mean() > 0.99
        monkeypatch.setattr(audio, "BLOCK_FRAMES", 3)
        again, energy2 = audio.log_mel(samples)
        assert (again == levels).all() and np.allclose(energy, energy2)
        monkeypatch.undo()


def test_ordinal_fit_is_an_optimum():
    """No small change of weights or thresholds makes the grades likelier."""
    rng = np.random.default_rng(2)
    x = rng.poisson(1.0, (400, 5)).astype(float)
    raw = x @ np.array([1.0, -1.0, 0.5, 0.0, 2.0]) + rng.logistic(0, 1, 400)
    grade = np.digitize(raw, [1.0, 2.5, 4.0])
    row, feature = np.nonzero(x)
    w, cut = toxicity.fit_ordinal(row, feature, x[row, feature], grade, 5, steps=3000)

    def loss(w, cut):
        tail = np.concatenate([np.ones((400, 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - cut))), np.zeros((400, 1))], 1)
        i = np.arange(400)
        return -np.log(tail[i, grade] - tail[i, grade + 1]).mean() + 0.5e-4 * (w @ w)

    best = loss(w, cut)
    for k in range(8):
        for d in (-0.02, 0.02):
            v, c = w.copy(), cut.copy()
            if k < 5:
                v[k] += d
            else:
                c[k - 5] += d
            assert loss(v, c) > best - 1e-6


def test_hysteresis():
    assert audio.segments(np.array([0, 0, 2, 0.5, -0.5, -2, 0, 0, 3.0])) == [(2, 5), (8, 9)]
    assert audio.segments(np.zeros(0)) == [] and audio.segments(np.zeros(5)) == []


def test_audio(spark, odd_rows):
    got = audio.features(audio.store_text(shape(spark, odd_rows))).toPandas()
    assert len(got) == len(odd_rows)
    for r in got.itertuples():
        texts = [t or "" for i, t in odd_rows if (i is None and r.doc_id != r.doc_id) or i == r.doc_id]
        pay = [x.encode().ljust(max(1, -(-len(x.encode()) // 192)) * 192, b" ") for x in texts]
        assert r.payload_sha256 in [hashlib.sha256(p).hexdigest() for p in pay]
        assert r.tail_crc32 in [zlib.crc32(p[-16:]) for p in pay]
        table = pa.ipc.open_stream(r.tensors).read_all()
        assert table.column("tensor").type.shape == [64, 32] and table.num_rows == max(1, -(-r.n_frames // 64))
    assert got.groupby("payload_sha256")["feature"].nunique().max() == 1
    assert audio.features(audio.store_text(shape(spark, []))).count() == 0


def test_warc(spark):
    rows = [(1, "u", "same"), (5, "u", "same"), (5, "u", "same"), (3, None, ""), (4, "v", None), (None, "v", ""), (6, "a\r\nb", "é" * 50_000), (7, "w", "\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as frame", "3 as refers_to")
    got = warc.archive(pages).toPandas()
    assert len(got) == len(rows)
    by = {(None if r.page_id != r.page_id else int(r.page_id)): r for r in got.itertuples()}
    for i, _, h in rows:
        raw = (h or "").encode()
        assert by[i].payload_bytes == len(raw) and by[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    kind = {k: (r.record_type, None if r.refers_to != r.refers_to else r.refers_to) for k, r in by.items()}
    assert kind == {1: ("revisit", 5), 5: ("response", None), 3: ("revisit", 4), 4: ("response", None), None: ("revisit", 4), 6: ("response", None), 7: ("response", None)}
    assert warc.archive(pages.where("1 = 0")).count() == 0


def test_bundle_frames(spark, tmp_path):
    import zstandard

    rows = [(i, "u", f"page {i} " * 50) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_bundles(warc.roles(pages), str(tmp_path / "w"), frame_bytes=4000, bundle_bytes=3000)
    bundles = spark.read.parquet(str(tmp_path / "w"))
    assert bundles.count() > 1
    data = bundles.first()["data"]
    table = warc.seek_table(data)
    assert len(table) > 1
    plain = b"".join(warc.open_frame(data, f) for f in table)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == plain
    got = {r.page_id: bytes(r.payload).decode() for r in warc.fetch(bundles, spark.createDataFrame([(3,), (150,)], "page_id long")).collect()}
    assert got == {3: rows[3][2], 150: rows[150][2]}


def held_out(pdf):
    return pdf["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()["op8_quality"](spark, sf).toPandas()
    assert (got["held_out"] == held_out(got)).all() and got["score"].between(0, 1).all()
    both = got[got["held_out"]].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (both["predicted"] == both["quality"]).mean() > 0.95


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.queries()["op10_toxicity"](spark, sf).toPandas()
    both = got[held_out(got)].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id", suffixes=("", "_label"))
    bad, good = both[both["toxic_label"] == 1], both[both["toxic_label"] == 0]
    assert bad["toxic"].mean() > 0.8 and good["toxic"].mean() < 0.02
    assert got["expected_severity"].between(0, 3).all()


def test_trees_split_what_is_split():
    x = np.random.default_rng(0).random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = quality.fit_trees(x, y).score(x)
    assert ((p > 0.5) == y).mean() > 0.97


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 6, 400)
    row = np.flatnonzero(n)
    w, cut = toxicity.fit_ordinal(row, np.zeros(len(row), np.int64), n[row].astype(float), np.minimum(n // 2 + (n > 0), 3), 1)
    assert w[0] > 0 and (np.diff(cut) > 0).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_models_of_odd_rows(spark, odd_rows, module):
    docs = shape(spark, odd_rows)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, None), (4, 1, 0), (6, 0, 1), (8, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.where("1 = 0")):
        model = module.fit(docs, lab)
        assert module.score(docs, model).count() == len(odd_rows)
    assert module.score(shape(spark, []), module.fit(shape(spark, []), labels)).count() == 0


def test_entire_licenses(spark):
    """Entire texts with titles, and wrapped ones within code and prose."""
    import textwrap
    from pathlib import Path

    from gavel.llm import license_forms

    mit = licenses.TEXTS["MIT"]
    cut = [mit.index("The above copyright notice"), mit.index("THE SOFTWARE IS")]
    wrapped = "\n\n".join(textwrap.fill(x, 70) for x in (mit[: cut[0]], mit[cut[0] : cut[1]], mit[cut[1] :]))
    comment = "\n".join(f"# {x}".rstrip() for x in wrapped.split("\n"))
    by = dict(license_forms.bodies(licenses.TEXTS))
    bsd = textwrap.fill(next(x for k, x in license_forms.bodies(licenses.TEXTS) if k == "BSD-3-Clause" and "1. Redis" in x and "COPYRIGHT OWNER OR" in x and "the copyright holder nor the names of its" in x), 70)
    bsd = bsd.replace("COPYRIGHT OWNER", "COPYRIGHT\nOWNER").replace("2. Redis", "\n\n2. Redis")
    published = license_forms.published()
    files = {p.stem: p.read_text() for p in (Path(license_forms.__file__).parent / "license_texts").glob("*.txt")}
    assert len(files) == 7 and len(published) == 11 and files.items() <= published.items() and set(by) == set(licenses.NAMES)
    rows = [
        (1, f"MIT License\n\nCopyright (c) 2024 Somebody\n\n{mit}"),
        (2, f"import os\n\n{comment}\n#\nimport sys\nprint('x')\n"),
        (3, f"Some prose before.\n\n{wrapped}\n\nMore prose.\n\n{wrapped}"),
        (4, f"/*\n * Copyright (c) 2020, X\n * All rights reserved.\n *\n{textwrap.indent(bsd, ' * ')}\n */\nint main;"),
        (5, f"BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n{bsd}"),
        (6, f"prose\n{textwrap.fill(by['Unlicense'], 60)}\n"),
        (7, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n\nx = 1"),
        (8, f"{wrapped} and more on the last line"),
        (9, wrapped.replace("without limitation the rights", "no limitation the rights")),
        (None, f"x\n{wrapped}"),
    ]
    rows += [(20 + i, text) for i, (_, text) in enumerate(sorted(published.items()))]
    rows += [(50 + i, f"prose\n{text}\ncode") for i, (_, text) in enumerate(sorted(published.items()))]
    rows += [(40, rows[1][1]), (40, rows[1][1])]
    rows += [(70 + i, f"prose\n{textwrap.fill(text, 50)}\ncode") for i, (k, text) in enumerate(sorted(published.items())) if k.startswith("CC-BY")]
    docs = shape(spark, rows)
    got = {(r.doc_id, r.license_id, r.scope, r.n) for r in licenses.scan(docs).collect()}
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    twin = con.execute(licenses.scan_sql()).fetchall()
    assert len(twin) == len(got) and set(twin) == got, (set(twin) - got, got - set(twin))
    wants = {(1, "MIT", "text", 1), (1, "MIT", "block", 1), (2, "MIT", "block", 1), (3, "MIT", "block", 2), (4, "BSD-3-Clause", "block", 1), (5, "BSD-3-Clause", "text", 1), (6, "Unlicense", "block", 1), (7, "MPL-2.0", "block", 1), (None, "MIT", "block", 1), (40, "MIT", "block", 2)}
    wants |= {(20 + i, k, "text", 1) for i, k in enumerate(sorted(published))}
    assert wants <= got, wants - got
    assert {(d, k) for d, k, s, _ in got if s == "block" and d and d >= 50 and d < 61} >= {(50 + i, k) for i, k in enumerate(sorted(published))}
    assert not any(d in (8, 9) for d, *_ in got)
    forms = [(x, n) for x, n, _ in licenses.block_forms(spark)]
    assert len(forms) == len(set(forms))
    assert not {k for d, k, s, _ in got if d and d < 20 and s == "block"} - {"MIT", "BSD-3-Clause", "Unlicense", "MPL-2.0"}


def test_stored_tensors(spark):
    """The query writes tensors of every document, and `feature` is that of what was written."""
    from pathlib import Path

    from gavel.llm import store

    folder = Path(store.shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("tensors-*"))
    got = queries.queries()["op5_audio_features"](spark, SF).toPandas().set_index("doc_id")
    (path,) = set(folder.glob("tensors-*")) - before
    rows = {r.doc_id: r for r in spark.read.parquet(str(path)).collect()}
    assert len(rows) == len(got) > 0 and set(rows) == set(got.index)
    for text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        raw = (text.text or "").encode()
        levels, energy = audio.log_mel(raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" "))
        row, r = rows[text.doc_id], got.loc[text.doc_id]
        table = pa.ipc.open_stream(row.tensors).read_all()
        assert (audio.stored_levels(row.tensors) == levels).all() and len(levels) == r.n_frames
        assert table.column("start_ms").to_pylist() == [1024.0 * i for i in range(table.num_rows)] and table.column("end_ms")[-1].as_py() == 16.0 * len(levels)
        active = audio.segments(energy)
        assert row.segments == [[16.0 * a, 16.0 * b] for a, b in active]
        assert r.feature == hashlib.sha256(levels.tobytes() + repr(active).encode()).hexdigest()
    one = spark.createDataFrame([rows[min(rows)]], spark.read.parquet(str(path)).schema)
    other = one.drop("tensors").crossJoin(spark.createDataFrame([(bytearray(audio.tensors(np.ones((3, 32), np.uint8))),)], "tensors binary"))
    assert audio.from_stored(one).first().feature == got.loc[min(rows)].feature != audio.from_stored(other).first().feature
    assert audio.stored_levels(audio.tensors(np.zeros((0, 32), np.uint8))).shape == (0, 32)


def test_short_items(spark):
    """Items of one to four words are found as whole documents and lines only."""
    items = [(1, "Yes!"), (2, "so it goes"), (3, "one two three four"), (4, "one two three four five"), (5, "..."), (6, "yes"), (7, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "YES"), (2, "yes and no"), (3, "before\r\n  so it, goes.\r\nafter"), (4, "so it\ngoes"), (5, "and so it goes on"), (6, "one two three four"), (7, "one two three four five"), (8, "a\nyes\nb\nyes"), (9, None), (10, ""), (11, "x so\nit goes"), (12, "so it"), (13, "goes"), (None, "yes")]
    one = {(1, 1, 1), (1, 6, 1), (8, 1, 1), (8, 6, 1), (None, 1, 1), (None, 6, 1), (3, 2, 3), (4, 2, 3), (6, 3, 4), (7, 4, 5)}
    docs = shape(spark, rows)
    got = [(r.doc_id, r.item_id, r.covered_words) for r in decontam.contaminated(docs.coalesce(1), bench).collect()]
    assert set(got) == one and len(got) == len(one)
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {2, 5, 9, 10, 11, 12, 13}
    only = bench.where("item_id = 2")
    assert {(r.doc_id, r.item_id, r.tiles, r.coverage) for r in decontam.contaminated(docs, only).collect()} == {(3, 2, 1, 1.0), (4, 2, 1, 1.0)}
    assert decontam.contaminated(docs.where("doc_id in (9, 10)"), bench).count() == 0


def test_a_stem_of_many_items_leads_to_none(spark):
    """Items that share a stem are candidates only where more than the stem is in a document, and none is lost."""
    stem = " ".join(f"stem{i}" for i in range(8))
    items = [(k, f"{stem} " + " ".join(f"i{k}x{i}" for i in range(12))) for k in range(3000)]
    rest = lambda k, n: " ".join(f"i{k}x{i}" for i in range(n))
    rows = [(1, f"a {stem} b"), (2, f"{stem} {rest(7, 12)}"), (3, f"{rest(9, 12)} middle {stem}"), (4, f"{stem} end {rest(11, 5)}"), (5, rest(12, 9)), (6, rest(12, 10)), (7, f"{stem} {stem}")]
    got = {(r.doc_id, r.item_id, r.covered_words) for r in decontam.contaminated(shape(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(2, 7, 20), (3, 9, 20), (4, 11, 13), (6, 12, 10)}
    hashed = [(k, decontam.words(pa.array([t]), plain=True).hash) for k, t in items]
    held = (hashed, *decontam.seeds(hashed), {})
    w = decontam.words(pa.array([t for _, t in rows]), plain=True)
    h, doc = decontam.rolled(w.hash, decontam.LEAST), w.doc()
    at = np.flatnonzero((doc[: len(h)] == doc[decontam.LEAST - 1 :]) & np.isin(h, held[1]))
    led = [(d, k) for d, k, _ in decontam._candidates(h, at, doc, held)]
    assert len(led) == len(set(led)) <= 6 and {(1, 7), (2, 9), (3, 11), (5, 12)} <= set(led)


@pytest.mark.parametrize("coverage", [0.3, 0.5, 0.8])
def test_decontamination_of_a_table(spark, coverage):
    """Every pair of a document and an item of the whole tables, by plain greedy tiling."""
    parted = str.maketrans({**{chr(i): chr(i + 32) for i in range(65, 91)}, **{chr(i): " " for i in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), *range(0x09, 0x0E))}})
    plain = lambda t: [x for x in (t or "").translate(parted).split(" ") if x]
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    grams = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    of_item = {k: grams(x) for k, x in items.items()}
    want = {}
    for r in docs.collect():
        x = plain(r.text)
        own = grams(x)
        # Only windows that an item has can be tiled; others are kept apart by a word of no item.
        for k, g in of_item.items():
            if len(items[k]) >= 5 and own & g:
                stay = [False] * len(x)
                for i in range(len(x) - 4):
                    if tuple(x[i : i + 5]) in g:
                        stay[i : i + 5] = [True] * 5
                kept = [y if s else None for i, (y, s) in enumerate(zip(x, stay, strict=True)) if s or (i and stay[i - 1])]
                want[r.doc_id, k] = sum(n for _, _, n in brute_tiles(kept, items[k], 5)), len(items[k])
    sure = {p for p, (n, size) in want.items() if n - 6 >= coverage * size}
    may = {p for p, (n, size) in want.items() if n + 6 >= coverage * size}
    got = {(r.doc_id, r.item_id): r.covered_words for r in decontam.contaminated(docs, bench, coverage).collect() if r.item_words >= 5}
    assert sure and sure <= set(got) <= may
    assert all(abs(n - want[p][0]) <= 6 for p, n in got.items())
    assert sum(n == want[p][0] for p, n in got.items()) >= 0.95 * len(got)
