from __future__ import annotations

import os

import __spark_entry__ as entry


def test_sql_has_queries():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 90


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_only_the_entry_names_the_optional_part():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "cairn")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "cairn.llm" not in open(os.path.join(folder, f)).read(), f
