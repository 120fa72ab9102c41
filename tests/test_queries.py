"""Every query against its SQL in DuckDB."""

import pytest
from conftest import same

from startline.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, data, name):
    same(catalog.queries()[name](spark, data).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["sport", "label", "entries", "labels"]
    assert found.count() > 0


def test_entry_works_without_the_training_data_operators(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", None)
    assert set(entry.queries()) == set(catalog.queries())
    assert set(entry.oracle_sql()) == set(SQL)


def test_nothing_else_imports_the_training_data_operators():
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] != "llm":
            assert "startline.llm" not in path.read_text(), path


def test_plans_prune_columns_and_join_without_cartesian_products(spark, data):
    found = catalog.queries()["event_organiser_join"](spark, data)
    plan = found._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in plan
    for name in ("event_distance_tree", "entries_by_sport_type", "upsert_events", "candidate_links"):
        assert "CartesianProduct" not in catalog.queries()[name](spark, data)._jdf.queryExecution().toString()
