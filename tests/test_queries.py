"""Every registered query of the library proper against its SQL in DuckDB, over the smallest tables."""

import inspect
import math
import os

import duckdb
import pytest

from marlstone.plans import catalog

TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "date": "DATE"}


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for name in os.listdir(data):
        c.execute(f"create view {name[:-8]} as select * from '{data}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, data, con, name):
    df = catalog.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(catalog.oracle_sql()[name])
    named = [x[0] for x in cursor.description]
    assert sorted(named) == columns
    kinds = {x[0]: str(x[1]) for x in cursor.description}
    assert {c: TYPES.get(k, k) for c, k in df.dtypes} == kinds
    assert rows == sorted((tuple(plain(dict(zip(named, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_every_query_is_documented():
    assert all(f.__doc__ for f in catalog.queries().values())


@pytest.mark.parametrize("name", ["bootstrap_medians", "spline_curve"])
def test_runs_without_sql(spark, data, name):
    rows = catalog.queries()[name](spark, data).collect()
    assert rows and all(x is not None for x in rows[0])


@pytest.mark.parametrize(("name", "told"), [("bootstrap_medians", {"replicates": 500}), ("cluster_range", {"ks": list(range(3, 16))}), ("forest_comparison", {"seeds": [42, 52, 62], "trees": 60, "depth": 16})])
def test_registered_with_the_parameters_of_the_reference(spark, data, monkeypatch, name, told):
    from marlstone.operators import models

    whole, seen = getattr(models, name), {}

    def spy(*args, **named):
        seen.update(inspect.signature(whole).bind(*args, **named).arguments)
        raise StopIteration

    monkeypatch.setattr(models, name, spy)
    with pytest.raises(StopIteration):
        catalog.queries()[name](spark, data)
    assert {k: list(seen[k]) if k in ("ks", "seeds") else seen[k] for k in told} == told
