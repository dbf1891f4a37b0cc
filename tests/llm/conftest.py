import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shape(spark, rows, clash=True):
    """documents rows (doc_id, text), with columns whose names are used inside the operators."""
    df = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        for name in ("chunk", "bucket", "bits", "n_words", "label", "rank", "digest", "feature", "score", "expected_severity", "at_least", "sequence_id", "offset", "_chunk_"):
            df = df.selectExpr("*", f"cast('x' as string) as {name}")
    return df


@pytest.fixture
def odd_rows():
    """Nulls, empties, white space, ties, repeated rows, one long text, exotic characters."""
    base = " ".join(f"w{i}" for i in range(60))
    return [
        (1, base),
        (2, base),
        (2, base),
        (2, "another text of the same id with some more words than a shingle has"),
        (None, base),
        (None, "no id at all"),
        (3, None),
        (4, ""),
        (5, " \t\n\x0b "),
        (6, "one"),
        (7, "The THE the, the!    İ <|endoftext|> a\x01b\x1cc é"),
        (8, " ".join(f"long{i % 997}x{i}" for i in range(30_000))),
        (9, "x " * 500),
        (-3, "negative id " + base),
    ]
