"""The driver contract and the shared folder."""

import importlib

import pytest

import __spark_entry__ as entry
from quern import scratch
from quern.plans import catalogue


def test_queries_without_the_training_data_operators(monkeypatch):
    real = importlib.import_module

    def broken(name, *args):
        if name.startswith(("corpus_pipeline", "quern.llm")):
            raise ImportError(name)
        return real(name, *args)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    assert set(entry.queries()) == set(catalogue.queries()) and set(entry.oracle_sql()) == set(catalogue.oracle_sql())


def test_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


class _Session:
    def __init__(self, master, named=None):
        self.sparkContext, self._named = type("C", (), {"master": master})(), named

    @property
    def conf(self):
        named = self._named
        return type("Conf", (), {"get": lambda self, key, default: named or default})()


def test_shared_folder():
    assert scratch.scratch_dir(_Session("spark://h:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert scratch.scratch_dir(_Session("local[8]")).startswith("file://")
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            scratch.scratch_dir(_Session(master))
