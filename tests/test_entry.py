"""The driver's contract."""

import importlib


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as e

    with monkeypatch.context() as m:
        m.setitem(sys.modules, "corpus_pipeline", None)
        for name in [n for n in sys.modules if n.startswith("gavel.llm")]:
            m.delitem(sys.modules, name)
        m.setitem(sys.modules, "gavel.llm", None)
        plain = importlib.reload(e)
        assert plain.llm is None and "flagship" in plain.queries() and "pipeline" not in plain.queries()
    importlib.reload(e)
