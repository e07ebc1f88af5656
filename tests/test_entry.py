import importlib
import sys

import __spark_entry__


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["case_id", "title", "status", "high", "medium", "low", "pending", "updated", "full_name"]
    assert 0 < df.count() <= 15
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_optional_parts(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("ledgerloom.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("ledgerloom.llm", "ledgerloom.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    bare = importlib.reload(__spark_entry__)
    assert "A10_needs_attention" in bare.queries() and not any(n.startswith("op") for n in bare.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
