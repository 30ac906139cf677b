"""Each registered network query against its SQL on the smallest tables."""

from __future__ import annotations

import ast
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from netloom.plans import catalog

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((plain(list(r)) for r in df.select(*columns).collect()), key=repr)
    assert got
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name])
        assert sorted(want.columns) == columns
        places = [want.columns.index(c) for c in columns]
        assert got == sorted(([plain(r[i]) for i in places] for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_does_not_need_the_text_operators(monkeypatch):
    for path in (Path(__file__).parents[1] / "netloom").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n for n in names), path
    monkeypatch.setitem(sys.modules, "netloom.llm", None)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.SQL)


def test_no_name_of_a_query_module_is_bound_twice():
    """A second binding would change what the queries above it read when they run."""
    for path in (Path(__file__).parents[1] / "netloom" / "plans").glob("*.py"):
        names = []
        for node in ast.parse(path.read_text()).body:
            if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
                names.append(node.name)
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                names += [n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name)]
        assert len(names) == len(set(names)), (path.name, sorted(n for n in names if names.count(n) > 1))
