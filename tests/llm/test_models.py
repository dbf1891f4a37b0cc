"""Statistics, trees and word counts of the classifiers against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from gavel.llm.quality import DEPTH, FEATURES, fit_trees, statistics
from gavel.llm.toxicity import Ordinal, counts, score
from gavel.llm.words import words

from .conftest import SF, shape

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
EDGES = ["", None, " \n\t", "one", "one\n", "\n\none two\n", "A AB ABc Ab aB É É", "x\nx\nx y\ny x\n", "a a a b b a", "1|2|3 *$% .,;:?", "日本 日本 日本", "\r\na\r\na"]


def by_hand(text):
    raw = (text or "").encode()
    w = SPLIT.findall(raw)
    some, n = max(len(raw), 1), max(len(w), 1)
    share = lambda kind: sum(b in kind for b in raw) / some
    capital = set(range(65, 91))
    run = best = 0
    for i, x in enumerate(w):
        run = run + 1 if i and x == w[i - 1] else 1
        best = max(best, run)
    tri = list(zip(w, w[1:], w[2:], strict=False))
    lines = raw.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    kinds = {tuple(sorted(Counter(SPLIT.findall(x)).items())) for x in lines}
    return [
        math.log1p(len(raw)), math.log1p(len(w)), sum(map(len, w)) / n, max(map(len, w), default=0),
        share(capital | set(range(97, 123))), share(capital), share(set(range(48, 58))), share(set(range(128, 256))), share(set(b"*$%&#!@^~<>=+{}[]\\_")), share({ord("|")}), share(set(b".,;:?")),
        (raw.count(b"\n") + 1) / some, len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, len(set(tri)) / max(len(tri), 1), math.log1p(best),
        sum(len(x) > 1 and x[0] in capital and x[1] <= 90 for x in w) / n, 1 - len(kinds) / max(len(lines), 1),
    ]


def test_statistics_by_hand(spark):
    texts = EDGES + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    got = statistics(pa.array(texts, pa.string()))
    want = np.array([by_hand(t) for t in texts])
    for k, name in enumerate(FEATURES):
        assert np.allclose(got[:, k], want[:, k], atol=1e-9), (name, [(texts[i][:40], got[i, k], want[i, k]) for i in np.flatnonzero(~np.isclose(got[:, k], want[:, k]))[:3]])


def test_trees_are_walked_as_by_recursion():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_trees(x, y)

    def leaf(tree, row, node=0, depth=0):
        if depth == DEPTH:
            return model.leaf[tree, node - ((1 << DEPTH) - 1)]
        right = row[model.feature[tree, node]] > model.threshold[tree, node]
        return leaf(tree, row, 2 * node + 1 + int(right), depth + 1)

    want = [1 / (1 + math.exp(-(model.base + sum(leaf(t, row) for t in range(len(model.feature)))))) for row in x]
    assert np.allclose(model.score(x), want)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def plain_words(text):
    raw = bytearray((text or "").encode())
    for i, b in enumerate(raw):
        if 65 <= b <= 90:
            raw[i] = b + 32
        elif b < 128 and chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
            raw[i] = 32
    return [w.decode() for w in SPLIT.findall(bytes(raw))]


def test_severity_by_hand(spark, odd_rows):
    texts = [t for _, t in odd_rows] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    known = [w for w, n in Counter(w for t in texts for w in set(plain_words(t))).items() if n > 3][:40]
    hashes = np.array([words(pa.array([w]), plain=True).hash[0] for w in known])
    order = np.argsort(hashes)
    weight = np.linspace(-1, 2, len(known))
    model = Ordinal(hashes[order], weight[order], np.array([0.5, 1.5, 3.0]))
    row, feature, n = counts(pa.array(texts, pa.string()), model.vocabulary)
    got = {(r, known[order[f]]): c for r, f, c in zip(row.tolist(), feature.tolist(), n.tolist(), strict=True)}
    assert got == {(i, w): c for i, t in enumerate(texts) for w, c in Counter(plain_words(t)).items() if w in known}
    place = {w: weight[i] for i, w in enumerate(known)}
    scored = score(shape(spark, list(enumerate(texts))), model).select("doc_id", "expected_severity", "at_least").collect()
    for r in scored:
        raw = sum(place[w] * math.log1p(c) for w, c in Counter(plain_words(texts[r.doc_id])).items() if w in place)
        want = [1 / (1 + math.exp(-(raw - c))) for c in (0.5, 1.5, 3.0)]
        assert np.allclose(r.at_least, want) and math.isclose(r.expected_severity, sum(want), abs_tol=1e-9)


def test_a_payload_of_most_pages(spark):
    """Roles of pages of which most share a payload, by hand."""
    from gavel.llm.warc import roles

    rng = np.random.default_rng(5)
    rows = [(int(i), "u", None if rng.random() < 0.4 else "same" if rng.random() < 0.5 else f"own{rng.integers(0, 30)}") for i in rng.permutation(300)] + [(None, "u", "same"), (7, "u", "same"), (7, "u", "same")]
    head = {}
    for i, _, html in rows:
        head[html or ""] = max(head.get(html or "", -1), -1 if i is None else i)
    n = Counter(html or "" for _, _, html in rows)
    want = Counter((i, html, head[html or ""] if n[html or ""] > 1 and (i is None or i < head[html or ""]) else None) for i, _, html in rows)
    got = roles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.html, r.refers_to) for r in got) == want and all(r.revisit == (r.refers_to is not None) for r in got)
