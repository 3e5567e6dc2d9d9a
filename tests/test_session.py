from __future__ import annotations

import builtins
import importlib
import os
from types import SimpleNamespace

import pytest

from skein import session


def test_package_reaches_workers_and_folder_is_kept(spark, sf):
    session.ship(spark)
    session.ship(spark)

    def run(batches):
        from skein.operators.context import count_tokens

        for b in batches:
            assert count_tokens("a b") == 2
            yield b

    assert spark.range(5).mapInArrow(run, "id long").count() == 5
    assert session.shared_folder(spark) == session.shared_folder(spark)
    assert session.load(spark, sf, "region").count() == 5


def test_stored_tables_are_swept(spark):
    path = session.new_folder(spark, "x")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local) and session.sweep(spark) >= 1 and not os.path.isdir(local) and session.sweep(spark) == 0


def test_no_folder_of_one_machine_on_a_cluster():
    def fake(master):
        return SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None, master=master), conf=SimpleNamespace(get=lambda k, d: d))

    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(fake(master))
    session.shared_folder(fake("local[4]"))


def test_other_queries_stay_without_what_the_corpus_operators_need(monkeypatch):
    import __spark_entry__ as entry

    real = builtins.__import__

    def refuse(name, *args, **named):
        if name == "skein.llm" or name.startswith("skein.llm."):
            raise ImportError("no module")
        return real(name, *args, **named)

    importlib.reload(entry)
    monkeypatch.setattr(builtins, "__import__", refuse)
    with pytest.warns(UserWarning, match="left out"):
        names = set(entry.queries())
    assert len(names) > 180 and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
