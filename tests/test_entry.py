"""The driver's contract, with and without the training-data operators."""

import importlib
import sys

import __spark_entry__


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "g01_topk_vector" in __spark_entry__.queries()


def test_runs_without_the_llm_folder(monkeypatch):
    monkeypatch.setitem(sys.modules, "weftline.llm", None)
    monkeypatch.delitem(sys.modules, "weftline.llm.queries", raising=False)
    again = importlib.reload(__spark_entry__)
    assert again.queries() and not any(n.startswith("p1_") for n in again.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_flagship(spark, data):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["id", "vector_score", "rank"] and out.count() == 20
