import collections
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gavel.llm.alignment import _loaded, align, aligned

from .conftest import SF, shape

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, n = {chr(x): x for x in keep}, 0
    for x in range(256):
        if x not in keep:
            chars[chr(256 + n)] = x
            n += 1
    return a, b, chars


def brute(rows):
    """Every text encoded whole by the libraries, tokens aligned one by one."""
    a, b, chars = libraries()
    docs = []
    for i, text in rows:
        ta, tb = [], []
        if text:
            e = a.encode(" " + text, add_special_tokens=False)
            ta = [(k, bytes(chars[c] for c in t)) for k, t in zip(e.ids, e.tokens, strict=True)]
            for k in b.encode(text):
                p = b.id_to_piece(k)
                tb.append((k, bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()))
            if not (b"".join(x for _, x in ta) == b"".join(x for _, x in tb) == (" " + text).encode()):
                ta, tb = [], []
        ends = []
        for t in (ta, tb):
            total, out = 0, {}
            for at, (k, x) in enumerate(t):
                total += len(x)
                out[total] = (at, k)
            ends.append(out)
        common = sorted(set(ends[0]) & set(ends[1]))
        parts, pa_, pb = [], 0, 0
        for e in common:
            qa, qb = ends[0][e][0] + 1, ends[1][e][0] + 1
            parts.append(",".join(str(k) for k, _ in ta[pa_:qa]) + "|" + ",".join(str(k) for k, _ in tb[pb:qb]))
            pa_, pb = qa, qb
        docs.append((i, len(ta), len(tb), [(ends[0][e][1], ends[1][e][1]) for e in common], hashlib.sha256(";".join(parts).encode()).hexdigest() if ta else ""))
    counts = collections.Counter(p for d in docs for p in d[3])
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, na, nb, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), h) for i, na, nb, x, h in docs]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


ODD = ["a  b", " a", "a ", "  ", " ", "x \n y", "tab\there", "a▁b", "▁", "\x00a", "ﬁ Å x́", "\r\n", "a　b", "𝒳 ½ 日本語 テキスト", "<unk> <s> </s> <|endoftext|> <0x41>", "x" * 3000, "  lead   and   trail   ", "1234567 3.14", "don't can't", " nbsp em"]


def test_odd_texts(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "a b"), (None, None), (50, None), (51, ""), (7, "again"), (7, "again")]
    assert rows_of(align(shape(spark, rows), A, B)) == sorted(brute(rows), key=str)


def test_odd_rows(spark, odd_rows):
    df = shape(spark, odd_rows).selectExpr("*", "'x' as unit", "'x' as pairs", "'x' as links", "'x' as pair")
    assert rows_of(align(df, A, B)) == sorted(brute(odd_rows), key=str)
    assert align(shape(spark, []), A, B).count() == 0


def test_units_of_any_size(spark, monkeypatch):
    """Counts are of all units: many small ones give what one gives."""
    rows = [(i, f"the {i % 7} words of text {i} stand here, and the words stand there") for i in range(200)]
    monkeypatch.setattr("gavel.llm.alignment.UNIT_BYTES", 300)
    assert rows_of(align(shape(spark, rows).repartition(5), A, B)) == sorted(brute(rows), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .,\n\t'é▁日 1"), max_size=40), min_size=1, max_size=5))
def test_units_give_the_ids_of_whole_texts(texts):
    b = libraries()[1]
    pieces = _loaded(A, B)[2]
    import numpy as np

    raw = [(" " + t).encode() for t in texts]
    ids, first = pieces.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
    for k, t in enumerate(texts):
        got = ids[first[k] : first[k + 1]].to_pylist()
        assert got == (b.encode(t.replace("▁", " ")) if "▁" in t else b.encode(t)) or not t or "▁" in t


def test_ends_of_a_block():
    rows, links = aligned(pa.array(["ab cd", None, "ab"]), A, B)
    assert rows.column("n_links").to_pylist()[1] == 0 and set(links.column("doc").to_pylist()) == {0, 2}


@pytest.mark.parametrize("folder", [SF])
def test_query_against_the_libraries(spark, folder):
    from gavel.llm.queries import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries()["op12_alignment"](spark, folder)) == sorted(brute(docs), key=str)
